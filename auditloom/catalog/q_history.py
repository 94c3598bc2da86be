"""Change-history queries over orders as commits and line items as commit files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as C, history as H
from . import base as B
from .base import q, query, ql, with_ctes

WORDS = ("fix overflow in price feed", "feat: add permit", "docs: typo", "urgent hotfix", "harden validation of owner", "refactor storage", "audit remarks", "bump seed", "misc change", "patch broken upgrade")
# Twenty repositories that share the names of their paths.
COMMITS = f"""commits AS (SELECT 'r' || (o_orderkey % 20) AS repo, 'k' || o_orderkey AS sha, CAST(o_orderdate AS DATE) AS date, 'a' || (o_custkey % 200) AS author, {ql(WORDS)}[CAST(o_orderkey % 10 AS INT) + 1] || ' ' || o_orderpriority AS subject, o_orderstatus = 'P' AS is_merge FROM orders)"""
CFILES = """cfiles AS (SELECT 'r' || (l_orderkey % 20) AS repo, 'k' || l_orderkey AS sha, 'p' || (l_partkey % 40) AS path, CAST(l_quantity * 9 AS BIGINT) AS added, CAST(round(l_tax * 1000) AS BIGINT) AS deleted, l_returnflag <> 'R' AS is_source, l_returnflag = 'R' AS is_test FROM lineitem)"""
AREA_NAMES = ("oracle_price", "fund_flows", "signatures", "access_control", "upgrades")
AREA = f"""areas AS (SELECT DISTINCT 'r' || (p_partkey % 20) AS repo, 'p' || (p_partkey // 20 % 40) AS path, {ql(AREA_NAMES)}[CAST(p_size % 5 AS INT) + 1] AS area FROM part)"""


def _repo(key):
    return F.concat(F.lit("r"), (key % 20).cast("string")).alias("repo")


def commits(spark, sf):
    o, k = B.table(spark, sf, "orders"), F.col("o_orderkey")
    return o.select(
        _repo(k), F.concat(F.lit("k"), k.cast("string")).alias("sha"), F.col("o_orderdate").cast("date").alias("date"),
        F.concat(F.lit("a"), (F.col("o_custkey") % 200).cast("string")).alias("author"),
        F.concat(F.get(F.array(*[F.lit(w) for w in WORDS]), (k % 10).cast("int")), F.lit(" "), "o_orderpriority").alias("subject"),
        (F.col("o_orderstatus") == "P").alias("is_merge"))


def cfiles(spark, sf):
    l = B.table(spark, sf, "lineitem")
    return l.select(
        _repo(F.col("l_orderkey")), F.concat(F.lit("k"), F.col("l_orderkey").cast("string")).alias("sha"), F.concat(F.lit("p"), (F.col("l_partkey") % 40).cast("string")).alias("path"),
        (F.col("l_quantity") * 9).cast("long").alias("added"), F.round(F.col("l_tax") * 1000).cast("long").alias("deleted"),
        (F.col("l_returnflag") != "R").alias("is_source"), (F.col("l_returnflag") == "R").alias("is_test"))


def areas(spark, sf):
    k = F.col("p_partkey")
    return B.table(spark, sf, "part").select(
        _repo(k), F.concat(F.lit("p"), (F.floor(k / 20) % 40).cast("string")).alias("path"),
        F.get(F.array(*[F.lit(n) for n in AREA_NAMES]), (F.col("p_size") % 5).cast("int")).alias("area")).distinct()


_m = lambda p, c="subject": f"regexp_matches({c}, {q(p)})"
CAT = "CASE " + " ".join(f"WHEN {_m(p)} THEN {q(n)}" for n, p, _, _ in H.INTENT) + " ELSE 'unclassified' END"
BASE_SCORE = "CASE " + " ".join(f"WHEN {_m(p)} THEN {s}" for _, p, s, _ in H.INTENT) + " ELSE 0 END"
TAGS = " + ".join(
    f"(CASE WHEN {_m(p)}" + (f" AND {CAT} <> 'security_explicit'" if t == H.KNOWN_VULNERABILITY else "") + " THEN 1 ELSE 0 END)" for p, t in H.TOPICS)
INTENT = f"(CASE WHEN {BASE_SCORE} >= 0 THEN {BASE_SCORE} + 2 * ({TAGS}) ELSE {BASE_SCORE} END)"


@query("f22_commit_intent", with_ctes(COMMITS, body=f"SELECT sha, {CAT} AS category, CAST({INTENT} AS INT) AS intent_score, CASE WHEN {BASE_SCORE} >= 0 THEN {TAGS} ELSE 0 END + 1 AS n_reasons FROM commits"))
def f22(spark, sf):
    i = H.commit_intent(F.col("subject"))
    return commits(spark, sf).select("sha", i["category"].alias("category"), i["intent_score"].alias("intent_score"), F.size(i["intent_reasons"]).alias("n_reasons"))


# Diffs made from line items: guard and accounting lines added and removed.
DIFF = """diffs AS (SELECT l_orderkey, string_agg(CASE WHEN l_returnflag = 'A' THEN '+ require(x);' WHEN l_returnflag = 'N' THEN '- require(y);' ELSE '+ balance = ' || l_linenumber END, chr(10) ORDER BY l_linenumber, l_returnflag) || CASE WHEN l_orderkey % 4 = 0 THEN chr(10) || '+ function f() onlyOwner {' ELSE '' END AS diff FROM lineitem GROUP BY l_orderkey)"""


@query("f23_diff_structure", with_ctes(DIFF, body=r"""
, g AS (SELECT *, len(regexp_extract_all(diff, '(?m)^\+[^+].*\brequire\b')) AS a, len(regexp_extract_all(diff, '(?m)^-[^-].*\brequire\b')) AS r, l_orderkey % 4 = 0 AS own, contains(diff, 'balance') AS bal FROM diffs)
SELECT l_orderkey, CAST((CASE WHEN a + r = 0 THEN 0 WHEN a = r THEN 2 ELSE 3 END) + (CASE WHEN own THEN 3 ELSE 0 END) + (CASE WHEN bal THEN 1 ELSE 0 END) AS INT) AS points,
  CASE WHEN a + r = 0 THEN CASE WHEN own THEN 'tightens access control (+1/-0)' WHEN bal THEN 'changes accounting/balance logic' END WHEN a > r THEN 'adds runtime guards (+' || a || '/-' || r || ')' WHEN r > a THEN 'removes runtime guards (+' || a || '/-' || r || ')' ELSE 'rewrites runtime guards (+' || a || '/-' || r || ')' END AS first_reason FROM g"""))
def f23(spark, sf):
    d = diffs(spark, sf)
    return d.select("l_orderkey", H.diff_points(F.col("diff")).alias("points"), F.get(H.diff_structure(F.col("diff")), F.lit(0))["reason"].alias("first_reason"))


SHAPE = "shape AS (SELECT repo, sha, count(*) FILTER (WHERE is_source) AS ns, count(*) FILTER (WHERE is_test) AS nt, CAST(sum(CASE WHEN is_source THEN added ELSE 0 END) AS BIGINT) AS sa, CAST(sum(CASE WHEN is_source THEN deleted ELSE 0 END) AS BIGINT) AS sd FROM cfiles GROUP BY repo, sha)"
SCORED = f"""dom AS (SELECT repo, sha, count(DISTINCT area) AS nd FROM cfiles JOIN areas USING (repo, path) WHERE is_source GROUP BY repo, sha),
sc0 AS (SELECT c.*, coalesce(ns, 0) AS ns, coalesce(nt, 0) AS nt, coalesce(sa, 0) AS sa, coalesce(sd, 0) AS sd, coalesce(nd, 0) AS nd FROM commits c LEFT JOIN shape USING (repo, sha) LEFT JOIN dom USING (repo, sha) WHERE NOT is_merge),
scored AS (SELECT repo, sha, date, ns, nt, sa + sd AS churn, nd, CAST(greatest({INTENT} + CASE WHEN ns > 0 THEN (CASE WHEN nd >= 2 THEN 3 WHEN nd = 1 THEN 1 ELSE 0 END) + (CASE WHEN ns BETWEEN 1 AND 3 THEN 2 ELSE 0 END)
  + (CASE WHEN sd > sa THEN 1 ELSE 0 END) - (CASE WHEN sa + sd > 2000 THEN 4 WHEN sa + sd > 500 THEN 2 ELSE 0 END) + (CASE WHEN nt > 0 THEN 1 ELSE 0 END) ELSE 0 END, 0) AS BIGINT) AS score FROM sc0)"""
BASE_CTES = (COMMITS, CFILES, AREA, SHAPE, SCORED)


def scored(spark, sf):
    return H.score_commits(commits(spark, sf), cfiles(spark, sf), areas(spark, sf))


# Diffs of commits, scored like the ones above.
_PTS = r"""g AS (SELECT *, len(regexp_extract_all(diff, '(?m)^\+[^+].*\brequire\b')) AS a, len(regexp_extract_all(diff, '(?m)^-[^-].*\brequire\b')) AS r, l_orderkey % 4 = 0 AS own, contains(diff, 'balance') AS bal FROM diffs),
pts AS (SELECT 'k' || l_orderkey AS sha, CASE WHEN a + r = 0 THEN 0 WHEN a = r THEN 2 ELSE 3 END + CASE WHEN own THEN 3 ELSE 0 END + CASE WHEN bal THEN 1 ELSE 0 END AS pts FROM g)"""
WITH_DIFF = (COMMITS, CFILES, AREA, SHAPE, DIFF, _PTS, SCORED.replace("CASE WHEN ns > 0 THEN (CASE WHEN nd", "CASE WHEN ns > 0 THEN coalesce(pts, 0) + (CASE WHEN nd").replace("LEFT JOIN dom USING (repo, sha)", "LEFT JOIN dom USING (repo, sha) LEFT JOIN pts USING (sha)").replace("AS nd FROM commits c", "AS nd, pts FROM commits c"))


def diffs(spark, sf):
    l = B.table(spark, sf, "lineitem")
    piece = F.when(F.col("l_returnflag") == "A", "+ require(x);").when(F.col("l_returnflag") == "N", "- require(y);").otherwise(
        F.concat(F.lit("+ balance = "), F.col("l_linenumber").cast("string")))
    d = l.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", piece.alias("p")))), lambda x: x["p"]), "\n").alias("diff"))
    return d.withColumn("diff", F.concat("diff", F.when(F.col("l_orderkey") % 4 == 0, "\n+ function f() onlyOwner {").otherwise("")))


@query("f24_commit_score", with_ctes(*WITH_DIFF, body="SELECT repo, sha, score, churn AS source_churn, nd AS n_domains FROM scored"))
def f24(spark, sf):
    told = diffs(spark, sf).select(F.concat(F.lit("k"), F.col("l_orderkey").cast("string")).alias("sha"), "diff")
    rows = H.score_commits(commits(spark, sf).join(told, "sha", "left"), cfiles(spark, sf), areas(spark, sf), "diff")
    return rows.select("repo", "sha", "score", "source_churn", "n_domains")


@query("w9_fix_candidates", with_ctes(*BASE_CTES, body="""SELECT repo, sha, date::VARCHAR AS date, score FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY repo ORDER BY score DESC, scored.date DESC, sha DESC) <= 50"""))
def w9(spark, sf):
    return H.fix_candidates(scored(spark, sf), 50).select("repo", "sha", F.col("date").cast("string").alias("date"), "score")


FIXST = "fx AS (SELECT repo, path, count(*) AS fix_commits, CAST(sum(score) AS BIGINT) AS fix_score FROM cfiles JOIN scored USING (repo, sha) WHERE is_source AND score >= 5 GROUP BY repo, path)"


@query("a18_fix_prone_files", with_ctes(*BASE_CTES, FIXST, body="""SELECT repo, path, fix_commits, fix_score FROM fx
QUALIFY row_number() OVER (PARTITION BY repo ORDER BY fix_score DESC, fix_commits DESC, path) <= 20"""))
def a18(spark, sf):
    return H.fix_prone_files(scored(spark, sf), cfiles(spark, sf), 20)


@query("a17_churn_hotspots", with_ctes(*BASE_CTES, FIXST, body="""
, t AS (SELECT repo, path, count(*) AS changes, max(date) AS last_touched FROM cfiles JOIN commits USING (repo, sha) WHERE is_source AND NOT is_merge GROUP BY repo, path)
SELECT repo, path, changes, coalesce(fix_commits, 0) AS fix_commits, round(coalesce(fix_commits, 0) / changes, 6) AS fix_ratio, last_touched::VARCHAR AS last_touched
FROM t LEFT JOIN fx USING (repo, path) WHERE (repo, path) IN (SELECT ('r' || (p_partkey % 20), 'p' || (p_partkey // 20 % 40)) FROM part WHERE p_size % 2 = 0)
QUALIFY row_number() OVER (PARTITION BY repo ORDER BY changes DESC, path) <= 10"""))
def a17(spark, sf):
    k = F.col("p_partkey")
    live = B.table(spark, sf, "part").filter(F.col("p_size") % 2 == 0).select(_repo(k), F.concat(F.lit("p"), (F.floor(k / 20) % 40).cast("string")).alias("path"))
    c, f = commits(spark, sf), cfiles(spark, sf)
    h = H.churn_hotspots(c, f, live, H.fix_stats(scored(spark, sf), f), 10)
    return h.withColumns({"fix_ratio": F.round("fix_ratio", 6), "last_touched": F.col("last_touched").cast("string")})


@query("a16_repo_shape", with_ctes(COMMITS, CFILES, SHAPE, body="""
, s AS (SELECT shape.* FROM shape SEMI JOIN commits USING (repo, sha) WHERE ns > 0),
t AS (SELECT repo, count(*) AS n, sum(sa) AS added, max(row(sa, sha)) AS big FROM s GROUP BY repo),
o AS (SELECT repo, count(*) AS commits, min(date) AS f, max(date) AS l, count(*) FILTER (WHERE is_merge) AS merges, count(DISTINCT author) AS contributors FROM commits GROUP BY repo),
a AS (SELECT repo, max(n) AS top FROM (SELECT repo, author, count(*) AS n FROM commits GROUP BY ALL) GROUP BY repo)
SELECT repo, CASE WHEN commits = 0 THEN 'empty' WHEN coalesce(n, 0) <= 1 THEN 'squashed_import' WHEN n <= 3 AND l - f < 7 THEN 'squashed_import' ELSE 'normal_dev' END AS classification,
  commits, coalesce(n, 0) AS source_commits, CAST(l - f AS BIGINT) AS spread_days, contributors, round(top / commits, 3) AS top_author_share, merges, CASE WHEN big[1] / added > 0.85 THEN big[2] END AS bulk_import
FROM o JOIN a USING (repo) LEFT JOIN t USING (repo)"""))
def a16(spark, sf):
    return H.repo_shape(commits(spark, sf), cfiles(spark, sf))


@query("a19_dangerous_areas", with_ctes(COMMITS, CFILES, AREA, body="SELECT repo, area, count(DISTINCT sha) AS commits, count(DISTINCT path) AS files FROM cfiles JOIN areas USING (repo, path) JOIN commits USING (repo, sha) WHERE NOT is_merge GROUP BY repo, area"))
def a19(spark, sf):
    return H.dangerous_areas(commits(spark, sf), cfiles(spark, sf), areas(spark, sf))


@query("a19_area_commits", with_ctes(COMMITS, CFILES, AREA, body="""
SELECT repo, sha, area, date::VARCHAR AS date, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo, area ORDER BY date DESC, sha DESC) AS rank
  FROM (SELECT DISTINCT repo, sha, area, date FROM cfiles JOIN areas USING (repo, path) JOIN commits USING (repo, sha) WHERE NOT is_merge)) WHERE rank <= 15"""))
def a19b(spark, sf):
    return H.area_commits(commits(spark, sf), cfiles(spark, sf), areas(spark, sf)).withColumn("date", F.col("date").cast("string"))


@query("j19_commit_domains", with_ctes(CFILES, AREA, body="SELECT DISTINCT repo, sha, area FROM cfiles JOIN areas USING (repo, path)"))
def j19(spark, sf):
    return H.commit_domains(cfiles(spark, sf), areas(spark, sf))


@query("a20_late_changes", with_ctes(COMMITS, CFILES, SHAPE, body="""
SELECT repo, sha, author, sa + sd AS source_churn, nt > 0 AS test_changed FROM commits JOIN shape USING (repo, sha) JOIN (SELECT repo, max(date) AS newest FROM commits GROUP BY repo) USING (repo) WHERE ns > 0 AND date >= newest - 120"""))
def a20(spark, sf):
    return H.late_changes(commits(spark, sf), cfiles(spark, sf), 120).select("repo", "sha", "author", "source_churn", "test_changed")


@query("a21_dev_patterns", with_ctes(*BASE_CTES, body="""
, s AS (SELECT shape.*, author FROM shape JOIN commits USING (repo, sha) WHERE ns > 0 AND NOT is_merge),
p AS (SELECT repo, max(lines) AS lines, arg_max(author, row(lines, author)) AS author FROM (SELECT repo, author, sum(sa) AS lines FROM s GROUP BY ALL) GROUP BY repo),
f AS (SELECT repo, round(avg(CASE WHEN nt = 0 THEN 1.0 ELSE 0 END), 3) AS fix_without_test FROM scored WHERE score > 0 GROUP BY repo),
b AS (SELECT repo, CASE WHEN max(row(sa, sha))[1] / sum(sa) > 0.85 THEN max(row(sa, sha))[2] END AS bulk FROM (SELECT shape.* FROM shape SEMI JOIN commits USING (repo, sha) WHERE ns > 0) GROUP BY repo)
SELECT repo, round(avg(CASE WHEN nt > 0 THEN 1.0 ELSE 0 END), 3) AS test_co_change, any_value(fix_without_test) AS fix_without_test,
  round(avg(sa + sd) FILTER (WHERE coalesce(sha <> bulk, true)), 1) AS avg_commit_size, round(any_value(p.lines) / sum(sa), 3) AS top_share, any_value(p.author) AS top_author FROM s JOIN p USING (repo) LEFT JOIN f USING (repo) LEFT JOIN b USING (repo) GROUP BY repo"""))
def a21(spark, sf):
    c, f = commits(spark, sf), cfiles(spark, sf)
    return H.dev_patterns(c, f, scored(spark, sf), H.repo_shape(c, f).select("repo", "bulk_import"))


@query("a21_contributor_shares", with_ctes(COMMITS, CFILES, SHAPE, body="""
, p AS (SELECT repo, author, CAST(sum(sa) AS BIGINT) AS lines_added FROM shape JOIN commits USING (repo, sha) WHERE ns > 0 AND NOT is_merge GROUP BY repo, author)
SELECT repo, author, lines_added, round(lines_added / sum(lines_added) OVER (PARTITION BY repo), 6) AS share FROM p"""))
def a21b(spark, sf):
    return H.contributor_shares(commits(spark, sf), cfiles(spark, sf))


_AREAS = {"fund_flows": r"token|approve", "oracle_price": r"[Ff]eed|ention|que", "access_control": r"onlyOwner|\bund der\b", "signatures": r"nonce|digest|the th"}


@query("f25_file_areas", with_ctes(B.CODE_FILES, body=" UNION ALL ".join(f"SELECT repo, path, {q(a)} AS area FROM code_files WHERE regexp_matches(source, {q(p)})" for a, p in {**_AREAS, **{k: v for k, v in H.AREAS.items() if k not in _AREAS}}.items())))
def f25(spark, sf):
    merged = {**_AREAS, **{k: v for k, v in H.AREAS.items() if k not in _AREAS}}
    return H.file_areas(B.code_files(spark, sf), merged)


_D = r"(?i)(?://|/\*|#|\*)\s*(TODO|FIXME|HACK|the|de|der)\b[:\s]*(.*)"


@query("j18_blame", with_ctes(B.FILES, B.LINES, body=f"""
, d AS (SELECT repo, path, line FROM lines WHERE regexp_matches(text, {q(_D)})),
f AS (SELECT repo, path FROM (SELECT DISTINCT repo, path FROM d) QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path) <= 5)
SELECT d.repo, d.path, d.line, CASE WHEN d.line % 3 > 0 AND EXISTS (SELECT 1 FROM f WHERE f.repo = d.repo AND f.path = d.path) THEN 'who' || (d.line % 7) END AS author FROM d"""))
def j18(spark, sf):
    files = B.files(spark, sf)
    items = C.tech_debt(files, _D).select("repo", "path", "line")
    rows = C.explode_lines(files).filter(F.col("line") % 3 > 0).select("repo", "path", "line", F.concat(F.lit("who"), (F.col("line") % 7).cast("string")).alias("author"))
    return H.blame(items, rows, 5)


VEND = ("lib/openzeppelin-contracts", "lib/my-solady", "vendor/unknown-thing", "deps/v3-core", "lib/forge-std", "lib/anchor-lang")


@query("a22_vendor_drift", f"""
WITH v AS (SELECT 'r' || (doc_id % 7) AS repo, {ql(VEND)}[CAST(doc_id % 6 AS INT) + 1] AS dir, doc_id, doc_id % 5 AS pr, doc_id % 4 = 0 AS edited FROM documents)
SELECT repo, dir, CASE dir WHEN 'lib/openzeppelin-contracts' THEN 'OpenZeppelin' WHEN 'lib/my-solady' THEN 'Solady' WHEN 'deps/v3-core' THEN 'Uniswap V3' WHEN 'lib/anchor-lang' THEN 'Anchor (Solana)' END AS upstream,
  count(*) AS source_files, count(*) FILTER (WHERE pr > 0 AND ((dir IN ('lib/openzeppelin-contracts', 'lib/my-solady') AND pr % 2 = 1) OR (dir = 'deps/v3-core'))) AS pragma_mismatches,
  count(*) FILTER (WHERE edited) AS locally_modified, NOT (dir = 'lib/my-solady') AS internalized FROM v WHERE dir <> 'lib/forge-std' GROUP BY repo, dir""")
def a22(spark, sf):
    d, k = B.table(spark, sf, "documents"), F.col("doc_id")
    pr = F.when(k % 5 == 0, "").when(k % 5 % 2 == 1, "pragma solidity ^0.4.1;\n").otherwise("pragma solidity ^0.8.20;\n")
    files = d.select(
        F.concat(F.lit("r"), (k % 7).cast("string")).alias("repo"),
        F.concat(F.get(F.array(*[F.lit(v) for v in VEND]), (k % 6).cast("int")), F.lit("/src/c"), k.cast("string"), F.lit(".sol")).alias("path"),
        F.concat(F.lit("// x\n"), pr, "text").alias("source"), "doc_id")
    touched = files.filter(k % 4 == 0).select("repo", "path")
    subs = files.select("repo").distinct().withColumn("path", F.lit("lib/my-solady"))
    return H.vendor_drift(files, touched, subs)


# Log exports of twenty repositories, written from orders and read back.
@query("s7_read_commits", with_ctes(COMMITS, CFILES, body="""SELECT repo, sha, author, is_merge, CAST(sum(added) AS BIGINT) AS added, count(*) AS files FROM commits JOIN cfiles USING (repo, sha) GROUP BY ALL"""))
def s7(spark, sf):
    from ..session import scratch_path
    from ..sources.readers import LOG_MARK, read_commits

    path = scratch_path(spark, "log")
    c, f = commits(spark, sf), cfiles(spark, sf)
    stat = f.groupBy("repo", "sha").agg(F.array_join(F.collect_list(F.concat_ws("\t", F.col("added").cast("string"), F.col("deleted").cast("string"), F.concat("path", F.lit(".sol")))), "\n").alias("rows"))
    text = F.concat(
        F.lit(LOG_MARK), F.concat_ws("<<SEP>>", "sha", F.substring("sha", 1, 7), F.concat(F.col("date").cast("string"), F.lit("T00:00:00Z")), "author",
                                     F.when(F.col("is_merge"), "p1 p2").otherwise("p1"), "subject"), F.lit("\n\n"), "rows", F.lit("\n"))
    c.join(stat, ["repo", "sha"]).select("repo", text.alias("value")).write.partitionBy("repo").text(path)
    got, rows = read_commits(spark, path)
    return got.join(rows, ["repo", "sha"]).groupBy("repo", "sha", "author", "is_merge").agg(F.sum("added").alias("added"), F.count("*").alias("files"))
