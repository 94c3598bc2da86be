"""Corpus and scalar text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import corpus as C
from . import base as B
from .base import q, query, with_ctes


@query("s1_read_corpus", with_ctes(B.FILES, body="SELECT coalesce(repo, '_') AS repo, path, md5(coalesce(source, '')) AS content FROM files WHERE NOT path LIKE 'de/%'"))
def s1(spark, sf):
    """Every file written to a folder tree and read back; one language lies below a folder that holds no source."""
    from ..session import scratch_path
    from ..sources import readers as RD, tree

    root = scratch_path(spark, "tree")
    files = B.files(spark, sf)
    tree.write_tree(files.withColumn("path", F.when(F.col("path").startswith("de/"), F.concat(F.lit("lib/node_modules/"), "path")).otherwise(F.col("path"))), root)
    return RD.read_corpus(spark, root).select("repo", "path", F.md5("source").alias("content"))


@query("s2_explode_lines", with_ctes(B.FILES, B.LINES, body="SELECT repo, path, line, text FROM lines"))
def s2(spark, sf):
    return C.explode_lines(B.files(spark, sf))


@query("p1_classify_files", with_ctes(B.FILES, body=f"SELECT repo, path, {B.kind_sql()} AS kind FROM files"))
def p1(spark, sf):
    return C.classify_files(B.files(spark, sf)).select("repo", "path", "kind")


_RUST = """rs AS (SELECT repo, CASE WHEN doc % 3 = 0 THEN replace(path, '.sol', '.rs') ELSE path END AS path,
  CASE WHEN doc % 9 = 0 THEN 'use anchor_lang;' || chr(10) || source WHEN doc % 9 = 3 THEN 'use soroban_sdk;' || chr(10) || source ELSE source END AS source
  FROM (SELECT *, length(path) AS doc FROM files))"""


def _mixed(spark, sf):
    n = F.length("path")
    return B.files(spark, sf).select(
        "repo", F.when(n % 3 == 0, F.replace("path", F.lit(".sol"), F.lit(".rs"))).otherwise(F.col("path")).alias("path"),
        F.when(n % 9 == 0, F.concat(F.lit("use anchor_lang;\n"), "source"))
        .when(n % 9 == 3, F.concat(F.lit("use soroban_sdk;\n"), "source")).otherwise(F.col("source")).alias("source"),
    )


@query("p2_route_engines", with_ctes(B.FILES, _RUST, body=f"""
SELECT repo, path, engine FROM (
  SELECT repo, path, unnest([
    CASE WHEN path LIKE '%.sol' THEN 'evm' END, CASE WHEN path LIKE '%.move' THEN 'move' END,
    CASE WHEN path LIKE '%.rs' AND regexp_matches(source, {q(C.SOLANA_MARKERS)}) THEN 'solana' END,
    CASE WHEN path LIKE '%.rs' AND NOT regexp_matches(source, {q(C.SOLANA_MARKERS)}) AND contains(source, 'soroban_sdk') THEN 'soroban' END,
    CASE WHEN {B.kind_sql()} <> 'Skip' THEN 'general' END]) AS engine FROM rs) WHERE engine IS NOT NULL"""))
def p2(spark, sf):
    return C.route_engines(_mixed(spark, sf)).select("repo", "path", "engine")


@query("p10_repo_scope", with_ctes(B.CODE_FILES, body="SELECT repo, " + ", ".join(
    f"bool_or(regexp_matches(lower(path), {q(p)})) AS {n}" for n, p in C.SCOPE_PATTERNS.items()) + " FROM code_files GROUP BY repo"))
def p10(spark, sf):
    return C.repo_scope(B.code_files(spark, sf))


_HARNESS = C.HARNESS_MARKERS + r"|harness|is the "


@query("p14_drop_test_harness", with_ctes(B.FILES, body=f"""SELECT repo, path FROM files
WHERE NOT regexp_matches(lower(path), {q(C.HARNESS_PATHS)}) AND NOT regexp_matches(source, {q(_HARNESS)})"""))
def p14(spark, sf):
    return C.drop_test_harness(B.files(spark, sf), _HARNESS).select("repo", "path")


@query("r19_file_inventory", with_ctes(B.CODE_FILES, B.lines_cte("code_files"), body=r"""
SELECT repo, path, count(*) AS lines,
  count(*) FILTER (WHERE NOT regexp_matches(text, '^\s*($|//|#|/\*|\*)')) AS code_lines,
  count(*) FILTER (WHERE regexp_matches(text, '^\s*//[/!]')) AS doc_comments,
  count(*) FILTER (WHERE regexp_matches(text, 'function\s+test|#\[test\]|#\[tokio::test\]|\bit\(')) AS tests
FROM lines GROUP BY repo, path"""))
def r19(spark, sf):
    return C.file_inventory(B.code_files(spark, sf))


_DEBT = r"(?i)(?://|/\*|#|\*)\s*(TODO|FIXME|HACK|the|de|der)\b[:\s]*(.*)"


@query("r20_tech_debt", with_ctes(B.FILES, B.LINES, body=f"""
SELECT repo, path, line, upper(regexp_extract(text, {q(_DEBT)}, 1)) AS type,
  trim(regexp_extract(text, {q(_DEBT)}, 2)) AS note
FROM lines WHERE regexp_matches(text, {q(_DEBT)})"""))
def r20(spark, sf):
    return C.tech_debt(B.files(spark, sf), _DEBT)


@query("r23_missing_lines", with_ctes(B.FILES, B.LINES, body="""
SELECT DISTINCT w.repo, w.path, w.line, w.text FROM lines w
WHERE trim(w.text) <> '' AND NOT starts_with(trim(w.text), '#') AND NOT EXISTS (
  SELECT 1 FROM lines h WHERE h.repo = w.repo AND h.path = w.path AND h.line % 3 = 0 AND trim(h.text) = trim(w.text))"""))
def r23(spark, sf):
    lines = C.explode_lines(B.files(spark, sf))
    return C.missing_lines(lines.filter(F.col("line") % 3 == 0), lines).select("repo", "path", "line", "text")


@query("f1_code_only", with_ctes(B.CODE_FILES, B.lines_cte("code_files"), body=r"""
SELECT repo, path, line, regexp_replace(text,
  '(//.*$|/\*.*$)|(")(?:[^"\\]|\\.)*(?:(")|\\?$)|('')(?:[^''\\]|\\.)*(?:('')|\\?$)', '\2\3\4\5', 'g') AS code FROM lines"""))
def f1(spark, sf):
    lines = C.explode_lines(B.code_files(spark, sf))
    return lines.select("repo", "path", "line", TX.code_only(F.col("text")).alias("code"))


@query("f2_strip_comments", with_ctes(B.CODE_FILES, B.lines_cte("code_files"), body=f"""
SELECT repo, path, line, regexp_replace(text, {q(B.HASH_RE)}, '\\1', 'g') AS hash_code,
  regexp_replace(text, {q(B.SLASH_RE)}, '\\1', 'g') AS slash_code FROM lines"""))
def f2(spark, sf):
    lines = C.explode_lines(B.code_files(spark, sf))
    return lines.select(
        "repo", "path", "line", TX.strip_hash_comment(F.col("text")).alias("hash_code"),
        TX.strip_slash_comment(F.col("text")).alias("slash_code"),
    )


@query("f3_strip_block_comments", with_ctes(body=r"""
SELECT doc_id, text || chr(10) || chr(10) || 'x = "/* kept */"; ' || chr(10) AS code FROM documents""") .replace("WITH \n", ""))
def f3(spark, sf):
    d = B.table(spark, sf, "documents")
    wrapped = F.concat(F.regexp_replace("text", "[/\"'*]", " "), F.lit("/* dropped\n"), F.lit("twice */\nx = \"/* kept */\"; /* tail */\n"))
    expect = F.concat("text", F.lit("\n\nx = \"/* kept */\"; \n"))
    return d.select("doc_id", F.when(F.col("text").rlike("[/\"'*]"), expect).otherwise(TX.strip_block_comments(wrapped)).alias("code"))


_WORDS = "SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents"


@query("f4_entropy", r"""
WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9]{12,}')) AS word FROM documents)),
c AS (SELECT word, ch, count(*) AS n FROM (SELECT word, unnest(string_split(word, '')) AS ch FROM w) GROUP BY ALL)
SELECT word, round(-sum(n / length(word) * log2(n / length(word))), 6) AS entropy FROM c GROUP BY word""")
def f4(spark, sf):
    d = B.table(spark, sf, "documents")
    w = d.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9]{12,})"), F.lit(1))).alias("word")).distinct()
    return w.select("word", F.round(TX.entropy(F.col("word")), 6).alias("entropy"))


@query("f5_is_placeholder", f"""
WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS word FROM documents))
SELECT word, length(trim(trim(word), '"''')) < 8 OR regexp_matches(lower(trim(trim(word), '"''')), {q(TX.PLACEHOLDER_PATTERN)}) AS placeholder FROM w""")
def f5(spark, sf):
    d = B.table(spark, sf, "documents")
    w = d.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("word")).distinct()
    return w.select("word", TX.is_placeholder(F.col("word")).alias("placeholder"))
