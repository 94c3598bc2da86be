"""Findings algebra: filters, de-duplication, counts, merges, the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import findings as FD
from ..sources import writers as WR
from ..operators import risk as RK
from . import base as B
from .base import q, query, ql, with_ctes

GATE = "CASE lower(severity) WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"
RANK = "CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END"
ID = "repo, invariant_id, file, line"


def fsql(body: str, *more: str) -> str:
    return with_ctes(B.FINDINGS, *more, body=body)


@query("p3_filter_min_severity", fsql(f"SELECT ord, severity FROM findings WHERE {GATE} >= 2"))
def p3(spark, sf):
    return FD.filter_min_severity(B.findings(spark, sf), "high").select("ord", "severity")


@query("p4_filter_rule", fsql("SELECT ord, invariant_id FROM findings WHERE contains(invariant_id, 'iac') OR contains(invariant_id, 'rt_')"))
def p4(spark, sf):
    return FD.filter_rule(B.findings(spark, sf), ["iac", "rt_"]).select("ord", "invariant_id")


_FIX = "CASE WHEN ord % 3 = 0 THEN 'a/corpus/' || file WHEN ord % 7 = 0 THEN 'b/fixtures/' || file ELSE file END"


def _fixture_paths(f):
    return f.withColumn("file", F.when(F.col("ord") % 3 == 0, F.concat(F.lit("a/corpus/"), "file"))
                        .when(F.col("ord") % 7 == 0, F.concat(F.lit("b/fixtures/"), "file")).otherwise(F.col("file")))


@query("p5_drop_fixture_paths", fsql(f"SELECT ord, {_FIX} AS file FROM findings WHERE NOT regexp_matches({_FIX}, '/(corpus|fixtures)/')"))
def p5(spark, sf):
    return FD.drop_fixture_paths(_fixture_paths(B.findings(spark, sf))).select("ord", "file")


@query("p6_gate", fsql(f"SELECT repo, bool_or({GATE} >= 2 AND evidence = 'proven') AS blocked FROM findings GROUP BY repo"))
def p6(spark, sf):
    return FD.gate(B.findings(spark, sf), "high", leads=False)


@query("p8_chain_of", fsql("""SELECT ord, CASE string_split(invariant_id, '_')[1] WHEN 'evm' THEN 'evm' WHEN 'sol' THEN 'solana'
  WHEN 'move' THEN 'move' WHEN 'sor' THEN 'soroban' WHEN 'gen' THEN 'general' WHEN 'sca' THEN 'supply-chain' WHEN 'rt' THEN 'runtime' END AS chain FROM findings"""))
def p8(spark, sf):
    return B.findings(spark, sf).select("ord", S.chain_of(F.col("invariant_id")).alias("chain"))


_T = "replace(regexp_replace(invariant_id, '^(evm|sol|move|sor|gen|sca|rt)_', ''), '_', ' ')"


@query("p9_title_of", fsql(f"SELECT ord, upper({_T}[1]) || substr({_T}, 2) AS title FROM findings"))
def p9(spark, sf):
    return B.findings(spark, sf).select("ord", S.title_of(F.col("invariant_id")).alias("title"))


_RAW = """raw AS (SELECT 'scan' || (event_id % 50) AS scan_id, CASE user_id % 6 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'High' WHEN 2 THEN 'medium' WHEN 3 THEN 'bogus' WHEN 4 THEN NULL ELSE 'info' END AS severity,
  CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN '' ELSE event_type END AS invariant_id,
  CASE WHEN event_id % 4 = 0 THEN event_type || ' title' END AS title, props AS message,
  CASE WHEN event_id % 3 = 0 THEN 'src/f' || user_id END AS file, CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS BIGINT) END AS line,
  CASE WHEN event_id % 3 = 1 THEN 'src/g' || user_id || ':' || (event_id % 90) WHEN event_id % 3 = 2 THEN 'plain place' END AS location,
  CASE WHEN event_id % 10 = 0 THEN 'proven' ELSE 'guess' END AS evidence, CASE WHEN event_id % 2 = 0 THEN 'LIKELY' ELSE 'MAYBE' END AS exploitability,
  CASE WHEN event_id % 6 = 0 THEN 'do this' END AS fix, CASE WHEN event_id % 6 = 1 THEN 'or that' END AS recommendation, props AS snippet, event_id FROM events)"""


def _raw(spark, sf):
    e, i = B.table(spark, sf, "events"), F.col("event_id")
    u = F.col("user_id")
    sev = F.when(u % 6 == 0, "CRITICAL").when(u % 6 == 1, "High").when(u % 6 == 2, "medium").when(u % 6 == 3, "bogus").when(u % 6 == 5, "info")
    return e.select(
        F.concat(F.lit("scan"), (i % 50).cast("string")).alias("scan_id"), sev.alias("severity"),
        F.when(i % 5 == 1, "").when(i % 5 != 0, F.col("event_type")).alias("invariant_id"),
        F.when(i % 4 == 0, F.concat("event_type", F.lit(" title"))).alias("title"), F.col("props").alias("message"),
        F.when(i % 3 == 0, F.concat(F.lit("src/f"), u.cast("string"))).alias("file"), F.when(i % 3 == 0, u).alias("line"),
        F.when(i % 3 == 1, F.concat(F.lit("src/g"), u.cast("string"), F.lit(":"), (i % 90).cast("string"))).when(i % 3 == 2, "plain place").alias("location"),
        F.when(i % 10 == 0, "proven").otherwise("guess").alias("evidence"), F.when(i % 2 == 0, "LIKELY").otherwise("MAYBE").alias("exploitability"),
        F.when(i % 6 == 0, "do this").alias("fix"), F.when(i % 6 == 1, "or that").alias("recommendation"), F.col("props").alias("snippet"),
    )


_NORM = """n AS (SELECT *, CASE WHEN lower(coalesce(severity, 'low')) IN ('critical', 'high', 'medium', 'low', 'info') THEN lower(coalesce(severity, 'low')) ELSE 'low' END AS sev,
  nullif(invariant_id, '') AS rule, CASE WHEN coalesce(file, '') <> '' THEN file WHEN regexp_matches(location, '^(.*):(\\d+)$') THEN regexp_extract(location, '^(.*):(\\d+)$', 1) ELSE nullif(location, '') END AS f2,
  nullif(CASE WHEN line > 0 THEN line WHEN coalesce(file, '') = '' AND regexp_matches(location, '^(.*):(\\d+)$') THEN CAST(regexp_extract(location, '^(.*):(\\d+)$', 2) AS BIGINT) END, 0) AS l2 FROM raw),
m AS (SELECT *, coalesce(nullif(title, ''), replace(rule, '_', ' '), 'security finding') AS t2 FROM n)"""


@query("p11_normalize_scan_row", with_ctes(_RAW, _NORM, body="""
SELECT scan_id, sev AS severity, t2 AS title, rule AS invariant_id, coalesce(nullif(message, ''), 'Security issue detected') AS description,
  f2 AS file, l2 AS line, CASE WHEN evidence = 'proven' THEN 'proven' ELSE 'lead' END AS evidence, CASE WHEN exploitability = 'LIKELY' THEN exploitability END AS exploitability,
  coalesce(nullif(fix, ''), nullif(recommendation, ''), 'Review this finding and apply the relevant invariant guidance.') AS recommendation, snippet,
  sha256(sev || chr(0) || coalesce(rule, t2) || chr(0) || coalesce(f2, '') || chr(0) || coalesce(CAST(l2 AS VARCHAR), '')) AS fingerprint FROM m"""))
def p11(spark, sf):
    return FD.normalize_scan_row(_raw(spark, sf))


@query("f14_fingerprint", fsql("SELECT ord, sha256(severity || chr(0) || invariant_id || chr(0) || file || chr(0) || line) AS fingerprint FROM findings"))
def f14(spark, sf):
    return B.findings(spark, sf).select("ord", S.fingerprint(F.col("severity"), F.col("invariant_id"), F.col("file"), F.col("line")).alias("fingerprint"))


@query("w1_dedup_findings", fsql(f"SELECT {ID}, ord, severity, message FROM findings QUALIFY row_number() OVER (PARTITION BY {ID} ORDER BY ord) = 1"))
def w1(spark, sf):
    return FD.dedup_findings(B.findings(spark, sf)).select("repo", "invariant_id", "file", "line", "ord", "severity", "message")


@query("w2_order_findings", fsql(f"SELECT ord, {RANK} AS rank, line FROM findings ORDER BY rank DESC, line, ord"))
def w2(spark, sf):
    return FD.order_findings(B.findings(spark, sf)).select("ord", S.severity_rank(F.col("severity")).alias("rank"), "line")


@query("u1_union_findings", fsql("""SELECT ord, invariant_id, severity, NULL AS tool FROM findings WHERE severity = 'Critical'
UNION ALL SELECT ord, invariant_id, NULL, 'probe' FROM findings WHERE evidence = 'proven'"""))
def u1(spark, sf):
    f = B.findings(spark, sf)
    return FD.union_findings(
        f.filter(F.col("severity") == "Critical").select("ord", "invariant_id", "severity"),
        f.filter(F.col("evidence") == "proven").select("ord", "invariant_id", F.lit("probe").alias("tool")),
    )


_HALVES = "a AS (SELECT DISTINCT repo, invariant_id, file, line FROM findings WHERE ts < '2024-01-18'), b AS (SELECT DISTINCT repo, invariant_id, file, line FROM findings WHERE ts >= '2024-01-12')"


def _halves(spark, sf):
    f = B.findings(spark, sf)
    return f.filter(F.col("ts") < "2024-01-18"), f.filter(F.col("ts") >= "2024-01-12")


@query("u2_new_and_fixed", fsql("SELECT *, 'new' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'fixed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)", _HALVES))
def u2(spark, sf):
    return FD.new_and_fixed(*_halves(spark, sf))


@query("u3_common_findings", fsql("SELECT * FROM a INTERSECT SELECT * FROM b", _HALVES))
def u3(spark, sf):
    return FD.common_findings(*_halves(spark, sf))


@query("j17_golden_diff", fsql("""
SELECT d.repo, d.file, d.invariant_id, d.severity, d.line, CASE WHEN moved THEN 'moved' WHEN na > ne THEN 'added' ELSE 'removed' END AS change, na - ne AS delta
FROM d JOIN (SELECT repo, file, invariant_id, severity, sum(na) = sum(ne) AND sum(na) > 0 AS moved FROM d GROUP BY ALL) g USING (repo, file, invariant_id, severity)""",
"x AS (SELECT repo, file, invariant_id, severity, line, count(*) FILTER (WHERE ts >= '2024-01-12') AS na, count(*) FILTER (WHERE ts < '2024-01-18') AS ne FROM findings GROUP BY ALL)",
"d AS (SELECT * FROM x WHERE na <> ne)"))
def j17(spark, sf):
    expected, actual = _halves(spark, sf)
    return FD.golden_diff(actual, expected)


_STATS = ", ".join(f"count(*) FILTER (WHERE severity = '{l}') AS {l.lower()}" for l in FD.LEVELS)


@query("a1_severity_stats", fsql(f"SELECT repo, {_STATS}, count(*) AS total FROM findings GROUP BY repo"))
def a1(spark, sf):
    return FD.severity_stats(B.findings(spark, sf), ["repo"])


@query("a2_risk_score_weighted", fsql("SELECT invariant_id, round((100.0 * critical + 75 * high + 50 * medium + 25 * low + 10 * info) / (100 * total), 9)::DOUBLE AS risk FROM s",
                                    f"s AS (SELECT invariant_id, {_STATS}, count(*) AS total FROM findings GROUP BY 1)"))
def a2(spark, sf):
    stats = FD.severity_stats(B.findings(spark, sf), ["invariant_id"])
    return FD.risk_score_weighted(stats).select("invariant_id", F.round("risk", 9).alias("risk"))


@query("a3_risk_score_capped", fsql("SELECT file, least(25 * critical + 15 * high + 8 * medium + 3 * low, 100) AS risk_score, critical = 0 AND high = 0 AS passed FROM s",
                                  f"s AS (SELECT file, {_STATS} FROM findings GROUP BY 1)"))
def a3(spark, sf):
    return FD.risk_score_capped(FD.severity_stats(B.findings(spark, sf), ["file"])).select("file", "risk_score", "passed")


@query("a4_scan_summary", fsql(f"""SELECT repo, count(*) AS violations, count(*) FILTER (WHERE evidence = 'proven') AS proven, count(*) FILTER (WHERE evidence <> 'proven') AS leads,
  count(*) FILTER (WHERE {GATE} = 3) AS critical, count(*) FILTER (WHERE {GATE} = 2) AS high, count(*) FILTER (WHERE {GATE} = 1) AS medium, count(*) FILTER (WHERE {GATE} = 0) AS low FROM findings GROUP BY repo"""))
def a4(spark, sf):
    return FD.scan_summary(B.findings(spark, sf))


@query("a5_rule_counts", fsql("SELECT repo, invariant_id, count(*) AS n FROM findings WHERE severity <> 'Info' GROUP BY ALL"))
def a5(spark, sf):
    return FD.rule_counts(B.findings(spark, sf))


_Q = "SELECT lang, tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 9) AS f1, p >= 0.9 AND r >= 0.9 AND (CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END) >= 0.9 AS passes FROM k"


def _qsql(empty: str) -> str:
    return f"""WITH c AS (SELECT d.lang || (d.doc_id % 40) AS lang, count(*) FILTER (WHERE e AND f) AS tp, count(*) FILTER (WHERE NOT e AND f) AS fp, count(*) FILTER (WHERE e AND NOT f) AS fn
  FROM (SELECT *, toxic = 1 AS e, quality = 0 AS f FROM labels) l JOIN documents d USING (doc_id) GROUP BY 1),
k AS (SELECT *, CASE WHEN tp + fp = 0 THEN {empty} ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN {empty} ELSE tp / (tp + fn) END AS r FROM c) {_Q}"""


def _cases(spark, sf):
    l, d = B.table(spark, sf, "labels"), B.table(spark, sf, "documents").select("doc_id", "lang")
    return l.join(d, "doc_id").select(
        F.concat("lang", (F.col("doc_id") % 40).cast("string")).alias("lang"),
        (F.col("toxic") == 1).alias("expected"), (F.col("quality") == 0).alias("fired"),
    )


_ROUND = ["lang", "tp", "fp", "fn"]


def _rounded(df):
    return df.select(*_ROUND, *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "passes")


@query("a10_detector_quality", _qsql("1.0"))
def a10(spark, sf):
    return _rounded(FD.detector_quality(_cases(spark, sf), ["lang"]))


@query("a11_fuzz_quality", _qsql("0.0"))
def a11(spark, sf):
    return _rounded(FD.fuzz_quality(_cases(spark, sf), ["lang"]))


CLASSES = {
    "english": (r"\sthe\s|\swith\s", ["doc_email", "doc_credential"]),
    "german": (r"\sund\s|\sder\s", ["doc_licence", "doc_ipv4"]),
    "french": (r"\sles\s|\sque\s", ["doc_credential"]),
}


@query("a12_class_recall", "WITH t AS (SELECT doc_id AS id, lower(text) AS t, lang FROM documents), h AS (SELECT doc_id AS id, unnest([CASE WHEN regexp_matches(text, '[a-z]@[a-z]') THEN 'doc_email' END, CASE WHEN contains(text, 'token = ') THEN 'doc_credential' END, CASE WHEN regexp_matches(text, '(?i)licen[cs]e') THEN 'doc_licence' END]) AS r FROM documents), r AS (SELECT id, list(r) FILTER (WHERE r IS NOT NULL) AS hits FROM h GROUP BY id)\n"
       + "\nUNION ALL\n".join(
           f"SELECT {q(n)} AS class, count(*) AS n, count(*) FILTER (WHERE list_has_any(coalesce(hits, []), {ql(ids)})) AS class_fired, count(*) FILTER (WHERE len(coalesce(hits, [])) > 0) AS any_fired FROM t LEFT JOIN r USING (id) WHERE regexp_matches(t, {q(rx)}) HAVING count(*) > 0"
           for n, (rx, ids) in CLASSES.items()))
def a12(spark, sf):
    d = B.table(spark, sf, "documents").withColumnRenamed("doc_id", "id")
    fired = d.select("id", F.explode(F.array_compact(F.array(
        F.when(F.col("text").rlike("[a-z]@[a-z]"), "doc_email"), F.when(F.contains("text", F.lit("token = ")), "doc_credential"),
        F.when(F.col("text").rlike("(?i)licen[cs]e"), "doc_licence")))).alias("invariant_id"))
    return FD.class_recall(d, fired, CLASSES)


@query("a24_symbolic_stats", """SELECT 'u' || (user_id % 20) AS repo, count(*) FILTER (WHERE c = 0) AS passed, count(*) FILTER (WHERE c = 1) AS counterexamples,
  count(*) FILTER (WHERE c = 1 AND m) AS proven, count(*) FILTER (WHERE c NOT IN (0, 1)) AS unresolved FROM (SELECT *, event_id % 4 AS c, value > 50 AS m FROM events) GROUP BY 1""")
def a24(spark, sf):
    e = B.table(spark, sf, "events")
    return FD.symbolic_stats(e.select(
        F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("repo"),
        (F.col("event_id") % 4).alias("exitcode"), (F.col("value") > 50).alias("valid_model")))


@query("a30_rule_cardinality", fsql("SELECT invariant_id, count(DISTINCT file) AS files, count(DISTINCT repo) AS repos, true AS sketch_close FROM findings GROUP BY 1"))
def a30(spark, sf):
    r = FD.approx_rule_cardinality(B.findings(spark, sf))
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.greatest(F.col(b) * 0.1, F.lit(1))
    return r.select("invariant_id", "files", "repos", (close("approx_files", "files") & close("approx_repos", "repos")).alias("sketch_close"))


@query("a30_sketches_by_day", fsql("SELECT invariant_id, count(DISTINCT file) AS files, count(DISTINCT repo) AS repos, true AS close FROM findings WHERE ts IS NOT NULL GROUP BY 1"))
def a30b(spark, sf):
    from ..session import cut_lineage

    f = B.findings(spark, sf).filter("ts is not null")
    merged = FD.sketched_cardinality(cut_lineage(FD.rule_sketches(f, F.col("ts").cast("date")), "sketches"))
    exact = f.groupBy("invariant_id").agg(F.countDistinct("file").alias("files"), F.countDistinct("repo").alias("repos"))
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.greatest(F.col(b) * 0.03, F.lit(1))
    return exact.join(merged, "invariant_id").select("invariant_id", "files", "repos", (close("approx_files", "files") & close("approx_repos", "repos")).alias("close"))


# ---- runs and the ledger ---------------------------------------------------------

_KR = "CASE kind WHEN 'FINDING' THEN 1 ELSE 0 END"
_TR = "CASE tier WHEN 'VERIFIED-PROVEN' THEN 3 WHEN 'VERIFIED-STATIC' THEN 2 WHEN 'REASONED' THEN 1 ELSE 0 END"
MERGED = f"""best AS (SELECT key, kind, tier, confidence, pass FROM runs QUALIFY row_number() OVER (PARTITION BY key ORDER BY {_KR} DESC, {_TR} DESC, coalesce(confidence, -1) DESC, pass DESC) = 1),
seen AS (SELECT key, CASE WHEN bool_or(engine) THEN 7 ELSE count(DISTINCT run) END AS seen_in FROM runs GROUP BY key),
merged AS (SELECT * FROM best JOIN seen USING (key))"""


@query("w4_merge_runs", with_ctes(B.RUNS, MERGED, body="SELECT key, kind, tier, confidence, pass, CAST(seen_in AS BIGINT) AS seen_in FROM merged"))
def w4(spark, sf):
    return FD.merge_runs(B.runs(spark, sf), total_runs=7).drop("run")


LEDGER = """ledger AS (SELECT CAST(p_partkey AS VARCHAR) AS key, 'KNOWN' AS status, CAST(p_size AS BIGINT) AS scans, 'sha' || p_size AS sha, p_name AS title, 'LEAD' AS kind FROM part WHERE p_size % 3 > 0
  UNION ALL SELECT 'gone' || p_partkey, 'NEW', 1, 'sha0', p_name, 'FINDING' FROM part WHERE p_size % 3 = 0)"""


def ledger(spark, sf):
    p = B.table(spark, sf, "part")
    a = p.filter(F.col("p_size") % 3 > 0).select(
        F.col("p_partkey").cast("string").alias("key"), F.lit("KNOWN").alias("status"), F.col("p_size").cast("long").alias("scans"),
        F.concat(F.lit("sha"), F.col("p_size").cast("string")).alias("sha"), F.col("p_name").alias("title"), F.lit("LEAD").alias("kind"))
    b = p.filter(F.col("p_size") % 3 == 0).select(
        F.concat(F.lit("gone"), F.col("p_partkey").cast("string")).alias("key"), F.lit("NEW").alias("status"), F.lit(1).cast("long").alias("scans"),
        F.lit("sha0").alias("sha"), F.col("p_name").alias("title"), F.lit("FINDING").alias("kind"))
    return a.unionByName(b)


@query("w5_tag_known", with_ctes(B.RUNS, MERGED, LEDGER, body="""SELECT m.key, CASE WHEN l.key IS NULL THEN 'NEW' ELSE 'KNOWN (' || (l.scans + 1) || ' scans)' END AS memory
FROM merged m LEFT JOIN ledger l ON l.key = m.key"""))
def w5(spark, sf):
    return FD.tag_known(FD.merge_runs(B.runs(spark, sf), 7), ledger(spark, sf)).select("key", "memory")


@query("w6_order_report", with_ctes(B.RUNS, MERGED, body=f"SELECT key, kind, tier, confidence FROM merged ORDER BY kind, {_TR} DESC, confidence DESC, key"))
def w6(spark, sf):
    rows = FD.merge_runs(B.runs(spark, sf), 7).withColumn("severity", F.lit("high"))
    return FD.order_report(rows).select("key", "kind", "tier", "confidence")


_KNOWN = """known AS (SELECT DISTINCT 'c' || (p_partkey % 50) AS contract, 'f' || p_partkey AS "function", 'label-' || (1995 + p_size % 10) AS label FROM part WHERE p_size % 2 = 0)"""


@query("w7_canonical_label", with_ctes(B.RUNS, _KNOWN, body="""
, v AS (SELECT contract, "function", label, count(DISTINCT agent) AS a FROM runs GROUP BY ALL),
s AS (SELECT v.*, CASE WHEN k.label IS NULL THEN 0 ELSE 1 END AS known FROM v LEFT JOIN known k ON k.contract = v.contract AND k."function" = v."function" AND k.label = v.label)
SELECT contract, "function", first(label ORDER BY known DESC, a DESC, length(label), label) AS label, count(*) AS labels FROM s GROUP BY ALL"""))
def w7(spark, sf):
    p = B.table(spark, sf, "part")
    known = p.filter(F.col("p_size") % 2 == 0).select(
        F.concat(F.lit("c"), (F.col("p_partkey") % 50).cast("string")).alias("contract"),
        F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("function"),
        F.concat(F.lit("label-"), (1995 + F.col("p_size") % 10).cast("string")).alias("label"))
    return FD.canonical_label(B.runs(spark, sf), known)


@query("w8_promote_leads", with_ctes(B.RUNS, body="""
, k AS (SELECT key, count(DISTINCT agent) AS agents, max(CASE WHEN kind = 'FINDING' THEN 1 ELSE 0 END) AS f, max(confidence) AS c FROM runs GROUP BY key)
SELECT key, agents, CASE WHEN f = 1 OR agents >= 2 THEN 'FINDING' ELSE 'LEAD' END AS kind, CASE WHEN f = 0 AND agents >= 2 THEN 75.0 ELSE c END AS confidence, f = 0 AND agents >= 2 AS promoted FROM k"""))
def w8(spark, sf):
    return FD.promote_leads(B.runs(spark, sf))


@query("w8b_compose_chain", """
WITH a AS (SELECT l_orderkey AS link, 'k' || l_partkey AS key, max(l_quantity) AS c FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL),
b AS (SELECT l_orderkey AS link, 'k' || l_partkey AS key, max(l_quantity) AS c FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL)
SELECT link, a.key AS key_a, b.key AS key_b, least(a.c, b.c) AS confidence FROM a JOIN b USING (link)""")
def w8b(spark, sf):
    l = B.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("link"), F.concat(F.lit("k"), F.col("l_partkey").cast("string")).alias("key"),
        F.col("l_quantity").alias("confidence"), "l_returnflag")
    return FD.compose_chain(l.filter("l_returnflag <> 'N'"), l.filter("l_returnflag = 'N'"), "link")


_SCAN = """scan AS (SELECT key, arg_max(struct_pack(sha := 'r' || run, title := label, kind := kind), (ord, 'r' || run, label, kind)) AS n FROM runs WHERE pass > 3 GROUP BY key)"""


@query("j16_ledger_merge", with_ctes(B.RUNS, LEDGER, _SCAN, body="""
SELECT coalesce(o.key, s.key) AS key, CASE WHEN o.key IS NOT NULL AND s.key IS NOT NULL THEN 'KNOWN' WHEN o.key IS NOT NULL THEN o.status ELSE 'NEW' END AS status,
  CAST(CASE WHEN o.key IS NOT NULL AND s.key IS NOT NULL THEN o.scans + 1 WHEN o.key IS NOT NULL THEN o.scans ELSE 1 END AS BIGINT) AS scans,
  CASE WHEN s.key IS NOT NULL THEN n.sha ELSE o.sha END AS sha, CASE WHEN s.key IS NOT NULL THEN n.title ELSE o.title END AS title, CASE WHEN s.key IS NOT NULL THEN n.kind ELSE o.kind END AS kind
FROM ledger o FULL JOIN scan s ON o.key = s.key"""))
def j16(spark, sf):
    rows = B.runs(spark, sf).filter("pass > 3").select("key", "ord", F.concat(F.lit("r"), "run").alias("sha"), F.col("label").alias("title"), "kind")
    return FD.ledger_merge(ledger(spark, sf), rows)


@query("a29_completeness", with_ctes(B.RUNS, body="""SELECT DISTINCT contract, "function" FROM runs WHERE (contract, "function") NOT IN (SELECT contract, "function" FROM runs WHERE confidence > 97)"""))
def a29(spark, sf):
    r = B.runs(spark, sf)
    return FD.completeness(r, r.filter("confidence > 97"))


@query("a31_distinct_fixes", with_ctes(B.RUNS, body="""SELECT contract, "function", fix, count(DISTINCT agent) AS agents FROM runs WHERE fix IS NOT NULL GROUP BY ALL"""))
def a31(spark, sf):
    return FD.distinct_fixes(B.runs(spark, sf))


@query("a32_bucket_check", with_ctes(B.RUNS, body="""
, k AS (SELECT run, count(*) AS findings, count(*) FILTER (WHERE confidence BETWEEN 90 AND 100) AS a, count(*) FILTER (WHERE confidence >= 75 AND confidence < 90) AS b, count(*) FILTER (WHERE confidence < 75) AS c,
  count(*) FILTER (WHERE tier = 'VERIFIED-PROVEN') AS proven, count(*) FILTER (WHERE tier = 'VERIFIED-STATIC') AS static, count(*) FILTER (WHERE tier = 'REASONED') AS reasoned FROM runs GROUP BY run)
SELECT *, a + b + c = findings AND proven + static + reasoned = findings AS sums FROM k"""))
def a32(spark, sf):
    return FD.bucket_check(B.runs(spark, sf), ["run"])


@query("w14_trend", fsql("""
, p AS (SELECT DISTINCT repo, strftime(ts, '%Y-%m-%d') AS scan, invariant_id || file AS fp FROM findings),
s AS (SELECT repo, scan, row_number() OVER (PARTITION BY repo ORDER BY scan) AS no FROM (SELECT DISTINCT repo, scan FROM p)),
n AS (SELECT repo, no, fp FROM p JOIN s USING (repo, scan)),
j AS (SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.no, b.no + 1) AS no, a.fp AS now, b.fp AS before FROM n a FULL JOIN n b ON a.repo = b.repo AND a.no = b.no + 1 AND a.fp = b.fp)
SELECT repo, scan, count(*) FILTER (WHERE before IS NULL) AS new, count(*) FILTER (WHERE now IS NOT NULL AND before IS NOT NULL) AS persisting, count(*) FILTER (WHERE now IS NULL) AS fixed
FROM j JOIN s USING (repo, no) GROUP BY repo, scan"""))
def w14(spark, sf):
    f = B.findings(spark, sf).select("repo", F.date_format("ts", "yyyy-MM-dd").alias("scan"), F.concat("invariant_id", "file").alias("fingerprint"))
    return FD.trend(f)


# ---- report tables ------------------------------------------------------------------

@query("s12_sarif_rules", fsql("""
, f AS (SELECT repo, invariant_id, ord, severity, message FROM findings QUALIFY row_number() OVER (PARTITION BY repo, invariant_id ORDER BY ord) = 1)
SELECT repo, invariant_id, row_number() OVER (PARTITION BY repo ORDER BY ord, invariant_id) - 1 AS rule_index, string_split(message, chr(10))[1] AS short_description,
  CASE severity WHEN 'Critical' THEN 'error' WHEN 'High' THEN 'error' WHEN 'Medium' THEN 'warning' ELSE 'note' END AS level,
  CASE severity WHEN 'Critical' THEN '9.5' WHEN 'High' THEN '8.0' WHEN 'Medium' THEN '5.5' WHEN 'Low' THEN '3.0' ELSE '1.0' END AS security_severity FROM f"""))
def s12(spark, sf):
    return WR.sarif_rules(B.findings(spark, sf))


_RI = ", f AS (SELECT repo, invariant_id, min(ord) AS o FROM findings GROUP BY ALL), r AS (SELECT repo, invariant_id, row_number() OVER (PARTITION BY repo ORDER BY o, invariant_id) - 1 AS rule_index FROM f)"


@query("s12_sarif_results", fsql(_RI + " SELECT f.repo, f.invariant_id, rule_index, evidence, file, line AS start_line, col + 1 AS start_column FROM findings f JOIN r ON r.repo = f.repo AND r.invariant_id = f.invariant_id"))
def s12b(spark, sf):
    f = B.findings(spark, sf)
    return WR.sarif_results(f, WR.sarif_rules(f)).drop("level", "message")


_TAX = "tax AS (SELECT * FROM (VALUES " + ", ".join(
    f"({q(r)}, {ql([f'CWE-{c}' for c in cwe])}, {ql(attack) if attack else 'CAST([] AS VARCHAR[])'})" for r, (cwe, attack) in RK.REF.TAXONOMY.items()
) + ") t(invariant_id, cwe, attack))"


@query("s12_sarif_taxa", fsql("""
, c AS (SELECT DISTINCT repo, cwe FROM (SELECT f.repo, unnest(t.cwe) AS cwe FROM findings f JOIN tax t USING (invariant_id)))
SELECT repo, cwe, row_number() OVER (PARTITION BY repo ORDER BY CAST(substr(cwe, 5) AS INT)) - 1 AS taxon_index FROM c""", _TAX))
def s12c(spark, sf):
    return WR.sarif_taxa(WR.sarif_rules(B.findings(spark, sf)), RK.taxonomy_table(spark))


@query("s11_csv_rows", fsql("""SELECT severity AS Severity, invariant_id AS Vulnerability_ID, coalesce(array_to_string(cwe, '; '), '') AS CWE, '' AS SWC, '' AS OWASP_SC, file AS File, line AS Line, message AS Message
FROM findings LEFT JOIN tax USING (invariant_id)""", _TAX))
def s11(spark, sf):
    return WR.csv_rows(B.findings(spark, sf), RK.taxonomy_table(spark))


@query("s14_upsert_findings", fsql("""
SELECT 'scan' || (ord % 5) AS scan_id, count(DISTINCT invariant_id || file || line) AS n FROM findings GROUP BY 1"""))
def s14(spark, sf):
    from ..session import scratch_path

    target = scratch_path(spark, "upsert")
    f = B.findings(spark, sf).select(
        F.concat(F.lit("scan"), (F.col("ord") % 5).cast("string")).alias("scan_id"),
        F.concat("invariant_id", "file", F.col("line").cast("string")).alias("fingerprint"), "severity")
    WR.upsert_findings(f.filter(F.col("severity") == "High"), target)
    WR.upsert_findings(f, target)
    return spark.read.parquet(target).groupBy("scan_id").agg(F.count("*").alias("n"))


@query("s10_ndjson_round_trip", fsql("SELECT ord, invariant_id, line FROM findings"))
def s10(spark, sf):
    from .. import schemas
    from ..session import scratch_path

    path = scratch_path(spark, "ndjson")
    WR.write_ndjson(B.findings(spark, sf).drop("ts"), path)
    return spark.read.schema(schemas.FINDING).json(path).select("ord", "invariant_id", "line")


# ---- readers: given tables written out and read back -----------------------------------------


@query("s3_read_findings_json", fsql("""
SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY ord) - 1 AS ord, invariant_id, severity, file, line, evidence FROM findings"""))
def s3(spark, sf):
    from ..session import scratch_path
    from ..sources import readers as RD, tree

    path = scratch_path(spark, "reports")
    f = B.findings(spark, sf)
    fields = F.struct("ord", *[c for c in f.columns if c not in ("repo", "ord", "ts")])
    reports = f.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(fields)), lambda x: x.dropFields("ord")).alias("findings"))
    documents = reports.select("repo", F.lit("report.json").alias("path"), F.to_json(F.struct("repo", F.lit(True).alias("ran"), "findings")).alias("source"))
    tree.write_tree(documents, path)
    return RD.read_findings_json(spark, path + "/*/report.json").select("repo", "ord", "invariant_id", "severity", "file", "line", "evidence")


@query("s8_read_exploits", """SELECT 'e' || p_partkey AS id, p_name AS name, CASE p_size % 2 WHEN 0 THEN 'evm' ELSE 'solana' END AS chain, CAST(DATE '2024-01-01' + CAST(p_size AS INT) AS VARCHAR) AS date, CAST(round(p_retailprice * 100) AS BIGINT) AS loss_usd, p_brand || ',' || p_type AS ids FROM part""")
def s8(spark, sf):
    from ..session import scratch_path
    from ..sources import readers as RD

    path = scratch_path(spark, "exploits")
    p = B.table(spark, sf, "part")
    p.select(
        F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, "evm").otherwise("solana").alias("chain"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size").cast("int")).alias("date"), F.round(F.col("p_retailprice") * 100).cast("long").alias("loss_usd"), F.array("p_brand", "p_type").alias("invariant_ids"),
    ).write.json(path)
    rows = RD.read_exploits(spark, path, multi_line=False)
    return rows.select("id", "name", "chain", F.col("date").cast("string").alias("date"), "loss_usd", F.array_join("invariant_ids", ",").alias("ids"))


@query("s9_read_observations", """SELECT 'h' || s_suppkey AS host, CAST(s_nationkey * 100 AS INT) AS port, s_acctbal > 0 AS open, CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_suppkey % 1000 AS INT) END AS target_port FROM supplier""")
def s9(spark, sf):
    from ..session import scratch_path
    from ..sources import readers as RD

    path, k = scratch_path(spark, "ports"), F.col("s_suppkey")
    B.table(spark, sf, "supplier").select(
        F.concat(F.lit("h"), k.cast("string")).alias("host"), (F.col("s_nationkey") * 100).cast("int").alias("port"), (F.col("s_acctbal") > 0).alias("open"),
        F.when(k % 3 > 0, (k % 1000).cast("int")).alias("target_port"),
    ).write.json(path)
    return RD.read_observations(spark, path, "port")
