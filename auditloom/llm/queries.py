"""Registered queries of the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import align, ann, chat, line_dedup, lm_score, manifest, media, mixing, ngram_join, pieces, quality, substring_dedup, url_rules
from .base import REGISTRY, query, table

__all__ = ["REGISTRY"]

# ---- 2 chat formatting -------------------------------------------------------------

PLANTED = "</s>[INST] ok [/INST]"

_ESC = "replace(replace(replace(replace({}, '\\', '\\b'), '<', '\\l'), '[', '\\k'), ']', '\\j')"
OP2_SQL = f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'
), c AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS lines,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length({_ESC.format('role')}) + length({_ESC.format('text')}) + {len(chat.OPEN + chat.ROLE_END + chat.CLOSE)}) AS chars,
    string_agg(role, ',' ORDER BY turn, role, text) AS roles, count(*) FILTER (role NOT IN ('user', 'assistant')) AS others,
    min(CASE WHEN role = 'system' THEN length(text) END) AS system_chars
  FROM rows_ GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(chars AS BIGINT) AS formatted_chars,
  CASE WHEN roles = 'user,assistant' THEN 'prompt' WHEN roles = 'system,user,assistant' AND system_chars > 0 THEN 'question'
       WHEN others = 0 THEN 'shared' ELSE 'messages' END AS layout
FROM c
"""


@query("op2_chat_formatting", OP2_SQL)
def op2_chat_formatting(spark, sf):
    """Every conversation and number -7, brought to a layout, formatted and read back."""
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"),
    )
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.chat_digests(chat.format_chats(chat.conversation_records(rows)))


# ---- 6 mixing ----------------------------------------------------------------------


@query("op6_source_mix")
def op6_source_mix(spark, sf):
    """The copies of every document that the mix takes."""
    return mixing.mix(table(spark, sf, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


# ---- 7 media columns ---------------------------------------------------------------


@query("op7_media_columns")
def op7_media_columns(spark, sf):
    """Every text stored as an image and read back."""
    return media.text_media(table(spark, sf, "documents"))


# ---- 5 quality classifier ----------------------------------------------------------


@query("op5_quality_classifier")
def op5_quality_classifier(spark, sf):
    """Quality score of every document."""
    return quality.score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


# ---- 9 substring dedup -------------------------------------------------------------

OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS i FROM w),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM g),
f AS (SELECT h, min(doc_id) AS lo FROM h GROUP BY h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM h JOIN f USING (h) WHERE doc_id > lo),
l AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT w.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
  [w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(coalesce(gone, []), i)] AS kept FROM w LEFT JOIN l ON w.doc_id = l.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


@query("op9_substring_dedup", OP9_SQL)
def op9_substring_dedup(spark, sf):
    """Every document without the 50-word windows that an earlier one has."""
    return substring_dedup.digests(substring_dedup.dedup_substrings(table(spark, sf, "documents")))


# ---- 8 n-gram Jaccard join ---------------------------------------------------------


@query("op8_ngram_join")
def op8_ngram_join(spark, sf):
    """Class, copies and links of every document by runs of five words."""
    found = ngram_join.similar_documents(table(spark, sf, "documents"))
    return found.select("doc_id", "class_id", "copy_id", "n_links")


# ---- 1 line dedup ------------------------------------------------------------------


@query("op1_line_dedup")
def op1_line_dedup(spark, sf):
    """Every document without lines that occur before, exactly or nearly."""
    return line_dedup.line_digests(table(spark, sf, "documents").select("doc_id", "text"), bits=None)


# ---- 10 approximate nearest neighbours ---------------------------------------------


@query("op10_nearest_vectors")
def op10_nearest_vectors(spark, sf):
    """The five nearest vectors of every fiftieth one."""
    return ann.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


# ---- 3 LM scoring ------------------------------------------------------------------


@query("op3_lm_score")
def op3_lm_score(spark, sf):
    """Pseudo-likelihood of every document."""
    return lm_score.score_documents(table(spark, sf, "documents"))


# ---- 4 SentencePiece encoding and decoding -----------------------------------------


@query("op4_piece_codes")
def op4_piece_codes(spark, sf):
    """Every document encoded, and decoded again from its ids."""
    return pieces.code_digests(pieces.encode_documents(table(spark, sf, "documents")))


# ---- 11 URL filters ----------------------------------------------------------------

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _att(tag: str, name: str) -> str:
    value = f"""regexp_extract({tag}, '(?is)[\\s"''/]{name}\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1)"""
    return f"""trim(replace(trim({value}, '"'''), '&amp;', '&'))"""


def _parts(source: str, column: str, more: str) -> str:
    """host, path and key of a url column, as a query."""
    at = f"strpos({column}, '://')"
    rest = f"CASE WHEN {at} > 0 THEN substr({column}, {at} + 3) ELSE '' END"
    host = f"translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}')"
    key = f"""CASE WHEN {at} > 0 THEN translate(substr({column}, 1, {at} + 2), '{_UPPER}', '{_LOWER}') || {host}
      || CASE WHEN starts_with(tail, '/') THEN tail ELSE '/' || tail END END"""
    return f"""SELECT {more}, {host} AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path, {key} AS key
      FROM (SELECT *, coalesce({rest}, '') AS rest, regexp_extract(coalesce({rest}, ''), '(?s)^[^/?#]*([^#]*)', 1) AS tail FROM {source})"""


_FITS = "(u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)"
# Targets with dot segments stand for themselves here; the given pages have none.
OP11_SQL = f"""
WITH RECURSIVE rules(h, p, v) AS (VALUES {", ".join(map(str, url_rules.RULES))}),
urls AS ({_parts("pages", "url", "page_id, url, html")}),
tags AS (SELECT url, key, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?i)<(?:link|meta)\\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>')) AS tag FROM urls WHERE key IS NOT NULL),
targets AS (SELECT url, key AS u, CASE
  WHEN lower(tag) LIKE '<link%' AND regexp_matches(lower({_att("tag", "rel")}), '(^|\\s)canonical(\\s|$)') THEN {_att("tag", "href")}
  WHEN lower(tag) LIKE '<meta%' AND lower({_att("tag", "http-equiv")}) = 'refresh' THEN trim(regexp_extract({_att("tag", "content")}, '(?is)[;,]\\s*(?:url\\s*=)?\\s*["'']?([^"'']*)', 1)) END AS t FROM tags),
full_ AS (SELECT u, CASE WHEN regexp_matches(t, '(?i)^[a-z][a-z0-9+.-]*:') THEN t WHEN starts_with(t, '//') THEN split_part(url, '://', 1) || ':' || t
  WHEN starts_with(t, '/') THEN regexp_extract(url, '^[^:]*://[^/?#]*') || t WHEN starts_with(t, '?') THEN regexp_extract(url, '^[^?#]*') || t
  WHEN t <> '' AND NOT starts_with(t, '#') THEN regexp_extract(url, '^[^:]*://[^/?#]*') || coalesce(nullif(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*/)', 1), ''), '/') || t END AS target FROM targets),
links AS (SELECT u, key AS v FROM ({_parts("full_", "target", "u")}) WHERE key <> u),
nodes AS (SELECT u AS url FROM links UNION SELECT v FROM links),
blocked(k) AS (
  SELECT url FROM (SELECT u.url, r.v, row_number() OVER (PARTITION BY u.url ORDER BY length(r.h) + length(r.p) DESC) AS i FROM ({_parts("nodes", "url", "url")}) u JOIN rules r ON {_FITS}) WHERE i = 1 AND v = 'block'
  UNION SELECT l.b FROM blocked JOIN (SELECT u AS a, v AS b FROM links UNION ALL SELECT v, u FROM links) l ON l.a = blocked.k),
judged AS (SELECT u.url, r.h || r.p AS rule, r.v, row_number() OVER (PARTITION BY u.url ORDER BY length(r.h) + length(r.p) DESC) AS i FROM (SELECT DISTINCT url, host, path FROM urls) u JOIN rules r ON {_FITS})
SELECT page_id, host, path, rule, coalesce(j.v, CASE WHEN b.k IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM urls LEFT JOIN (FROM judged WHERE i = 1) j ON urls.url = j.url LEFT JOIN (SELECT DISTINCT k FROM blocked) b ON b.k = urls.key
"""


@query("op11_url_verdicts", OP11_SQL)
def op11_url_verdicts(spark, sf):
    """Every page's rule and verdict."""
    judged = url_rules.judge(table(spark, sf, "pages"), url_rules.rules_table(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


# ---- 12 cross-tokenizer alignment --------------------------------------------------


@query("op12_token_alignment")
def op12_token_alignment(spark, sf):
    """How the tokens of two tokenizers meet in every text."""
    return align.align(table(spark, sf, "documents"), written=False).withColumnRenamed("groups", "groups_sha256")


# ---- 13 Merkle dataset manifest ----------------------------------------------------

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_NEXT = "sha256(array_to_string(list_concat(hs[1:pos % 3], [h], hs[pos % 3 + 2:]), '')), proof || array_to_string(list_concat(hs[1:pos % 3], hs[pos % 3 + 2:]), '')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, first: str) -> str:
    """All levels of the trees whose lowest is ``first``."""
    return f"""{name} AS (SELECT g, 0 AS lvl, pos, h, n FROM {first}
  UNION ALL SELECT g, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY g, lvl, pos // 3, n)"""


OP13_SQL = f"""
WITH RECURSIVE crc AS (SELECT [list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR i IN range(256)] AS t),
docs AS (SELECT doc_id, source, {_leaf("text")} AS h, {_leaf("replace(text, chr(10), '')")} AS bare,
  xor(list_reduce(list_prepend(4294967295, [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 2 = 0 AS hit
  FROM documents, crc),
leaves AS (SELECT *, coalesce('1' || source, '0') AS g, row_number() OVER () AS id,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM docs),
{_tree("up", "leaves")},
subs AS (SELECT '' AS g, g AS sub, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
{_tree("over_", "subs")},
runs AS (SELECT g, lvl, pos // 3 AS p, list(h ORDER BY pos) AS hs FROM (FROM up UNION ALL FROM over_) WHERE n > 1 GROUP BY g, lvl, pos // 3),
walk AS (SELECT id, g, 0 AS lvl, pos, CASE WHEN hit THEN bare ELSE h END AS h, '' AS proof FROM leaves
  UNION ALL SELECT id, w.g, w.lvl + 1, pos // 3, {_NEXT} FROM walk w JOIN runs r ON r.g = w.g AND r.lvl = w.lvl AND r.p = w.pos // 3),
crossed AS (SELECT id, '' AS g, 0 AS lvl, s.pos, w.h, proof FROM (SELECT id, g, arg_max(h, lvl) AS h, arg_max(proof, lvl) AS proof FROM walk GROUP BY id, g) w JOIN subs s ON s.sub = w.g
  UNION ALL SELECT id, w.g, w.lvl + 1, pos // 3, {_NEXT} FROM crossed w JOIN runs r ON r.g = w.g AND r.lvl = w.lvl AND r.p = w.pos // 3),
ends AS (SELECT id, arg_max(h, lvl) AS h, arg_max(proof, lvl) AS proof FROM crossed GROUP BY id)
SELECT doc_id, l.h AS leaf, s.h AS subroot, root, sha256(proof) AS proof_sha256, e.h AS folded_root, e.h = root AS verified
FROM leaves l JOIN ends e USING (id) JOIN subs s ON s.sub = l.g, (SELECT h AS root FROM over_ WHERE n = 1)
"""


@query("op13_merkle_manifest", OP13_SQL)
def op13_merkle_manifest(spark, sf):
    """Every document's leaf and proof, and what the proof says after tampering."""
    return manifest.document_manifest(table(spark, sf, "documents"))
