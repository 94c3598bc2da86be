"""Scan-operation queries: leases, metering, credits, entitlement, skills."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..dims import reference as REF
from ..operators import ops as O
from . import base as B
from .base import q, query, ql, with_ctes

SCANS = """scans AS (SELECT event_id AS scan_id, user_id, ts AS created_at, CASE event_type WHEN 'view' THEN 'complete' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'processing' ELSE 'queued' END AS status, event_id % 5 AS attempts,
  ts AS claimed_at, event_id * 13 % 9001 AS duration_ms, ['free', 'builder', 'team', 'professional'][CAST(user_id % 4 AS INT) + 1] AS plan FROM events)"""
NOW = "2024-01-31 00:00:00"


def scans(spark, sf):
    e, k, t = B.table(spark, sf, "events"), F.col("event_id"), F.col("event_type")
    return e.select(
        k.alias("scan_id"), "user_id", F.col("ts").alias("created_at"),
        F.when(t == "view", "complete").when(t == "error", "failed").when(t == "click", "processing").otherwise("queued").alias("status"),
        (k % 5).alias("attempts"), F.col("ts").alias("claimed_at"), (k * 13 % 9001).alias("duration_ms"),
        F.get(F.array(*[F.lit(p) for p in ("free", "builder", "team", "professional")]), (F.col("user_id") % 4).cast("int")).alias("plan"))


def now():
    return F.lit(NOW).cast("timestamp")


@query("st8_expire_leases", with_ctes(SCANS, body="""SELECT scan_id, CASE WHEN status = 'processing' AND claimed_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 MINUTE THEN CASE WHEN attempts < 3 THEN 'queued' ELSE 'failed' END ELSE status END AS next_status FROM scans"""))
def st8(spark, sf):
    return O.expire_leases(scans(spark, sf), F.lit("2024-01-20 00:00:00").cast("timestamp")).select("scan_id", "next_status")


@query("p15_expired_reports", with_ctes(SCANS, body=f"""SELECT scan_id FROM scans WHERE CASE plan {" ".join(f"WHEN {q(p)} THEN CAST(created_at AS DATE) < DATE '2024-01-31' - {d}" for p, (_, d) in REF.PLANS.items() if d)} ELSE false END"""))
def p15(spark, sf):
    return O.expired_reports(scans(spark, sf), now()).select("scan_id")


@query("a27_usage_by_period", with_ctes(SCANS, body="SELECT user_id, strftime(created_at, '%Y-%m') AS period, count(*) AS used FROM scans GROUP BY ALL"))
def a27(spark, sf):
    return O.usage_by_period(scans(spark, sf))


CREDITS = """credits AS (SELECT o_orderkey AS credit_id, o_custkey % 150 AS user_id, o_orderkey AS ord, o_orderkey % 4 AS remaining, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END AS expires_at FROM orders)"""


def credits(spark, sf):
    o, k = B.table(spark, sf, "orders"), F.col("o_orderkey")
    return o.select(k.alias("credit_id"), (F.col("o_custkey") % 150).alias("user_id"), k.alias("ord"), (k % 4).alias("remaining"), F.when(k % 3 > 0, F.col("o_orderdate").cast("timestamp")).alias("expires_at"))


@query("a28_live_credits", with_ctes(CREDITS, body="SELECT user_id, CAST(sum(remaining) AS BIGINT) AS credits FROM credits WHERE remaining > 0 AND (expires_at IS NULL OR expires_at > TIMESTAMP '1998-01-01') GROUP BY user_id"))
def a28(spark, sf):
    return O.live_credits(credits(spark, sf), F.lit("1998-01-01").cast("timestamp"))


@query("f26_entitlement", """
WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN ['builder', 'team', 'enterprise', 'gone'][CAST(c_custkey % 4 AS INT) + 1] END AS sp, CASE WHEN c_custkey % 5 > 1 THEN 'active' ELSE 'canceled' END AS st,
  CASE WHEN c_custkey % 4 > 0 THEN TIMESTAMP '2024-01-01' + INTERVAL (c_custkey % 60) HOUR END AS te, c_custkey % 3 AS credits, c_custkey % 120 AS used, TIMESTAMP '2024-01-02' AS now FROM customer),
b AS (SELECT *, CASE WHEN sp IN ('free', 'builder', 'team', 'professional', 'enterprise') AND st IN ('active', 'trialing', 'past_due') THEN 'subscription' WHEN te > now THEN 'trial' ELSE 'free' END AS source FROM a),
c AS (SELECT *, CASE source WHEN 'subscription' THEN sp WHEN 'trial' THEN 'builder' ELSE 'free' END AS plan FROM b),
d AS (SELECT *, CASE plan WHEN 'free' THEN 5 WHEN 'builder' THEN 100 WHEN 'team' THEN 1000 WHEN 'professional' THEN 10000 END AS quota FROM c)
SELECT c_custkey, source, plan, CAST(quota AS BIGINT) AS quota, CASE WHEN quota IS NOT NULL THEN CAST(greatest(quota - used, 0) AS BIGINT) END AS remaining, quota IS NULL OR quota - used > 0 OR credits > 0 AS can_scan,
  CASE WHEN source = 'trial' THEN CAST(greatest(ceil(epoch(te - now) / 86400), 1) AS BIGINT) END AS trial_days_left FROM d""")
def f26(spark, sf):
    c, k = B.table(spark, sf, "customer"), F.col("c_custkey")
    base = F.lit("2024-01-01").cast("timestamp")
    a = c.select(
        "c_custkey", F.when(k % 3 == 0, F.get(F.array(*[F.lit(p) for p in ("builder", "team", "enterprise", "gone")]), (k % 4).cast("int"))).alias("subscription_plan"),
        F.when(k % 5 > 1, "active").otherwise("canceled").alias("subscription_status"), F.when(k % 4 > 0, base + F.make_dt_interval(hours=(k % 60).cast("int"))).alias("trial_ends_at"),
        (k % 3).alias("credits"), (k % 120).alias("used"), F.lit("2024-01-02").cast("timestamp").alias("now"))
    return O.entitlement(a).select("c_custkey", "source", "plan", "quota", "remaining", "can_scan", "trial_days_left")


@query("a26_dashboard_stats", with_ctes(SCANS, B.FINDINGS, body="""
, d AS (SELECT user_id, count(*) FILTER (WHERE status = 'complete') AS completed, round(avg(duration_ms) FILTER (WHERE status = 'complete'), 6) AS avg_duration_ms FROM scans GROUP BY 1),
f AS (SELECT e.user_id, count(*) FILTER (WHERE severity = 'Critical') AS critical, count(*) FILTER (WHERE evidence = 'proven') AS proven, count(*) FILTER (WHERE evidence = 'lead' AND ord % 4 = 0) AS likely, count(*) FILTER (WHERE ord % 3 > 0) AS open, count(*) FILTER (WHERE ord % 3 = 0) AS resolved FROM findings JOIN events e ON e.event_id = ord GROUP BY 1)
SELECT user_id, completed, avg_duration_ms, coalesce(critical, 0) AS critical, coalesce(proven, 0) AS proven, coalesce(likely, 0) AS likely, coalesce(open, 0) AS open, coalesce(resolved, 0) AS resolved FROM d LEFT JOIN f USING (user_id)"""))
def a26(spark, sf):
    f = B.findings(spark, sf)
    users = B.table(spark, sf, "events").select(F.col("event_id").alias("ord"), "user_id")
    rated = f.withColumn("evidence", F.when((F.col("evidence") == "lead") & (F.col("ord") % 4 == 0), "likely").otherwise(F.col("evidence")))
    rows = rated.join(users, "ord").withColumn("status", F.when(F.col("ord") % 3 > 0, "open").otherwise("resolved"))
    return O.dashboard_stats(scans(spark, sf), rows).withColumn("avg_duration_ms", F.round("avg_duration_ms", 6))


@query("w12_recent_scans", with_ctes(SCANS, B.FINDINGS, body="""
, r AS (SELECT scan_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, scan_id DESC) AS rank FROM scans),
f AS (SELECT ord - ord % 3 AS scan_id, count(*) FILTER (WHERE severity = 'Critical') AS critical, count(*) FILTER (WHERE severity = 'High') AS high, count(*) FILTER (WHERE severity = 'Medium') AS medium, count(*) FILTER (WHERE severity = 'Low') AS low, count(*) FILTER (WHERE severity = 'Info') AS info FROM findings GROUP BY 1)
SELECT scan_id, user_id, rank, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(info, 0) AS info FROM r LEFT JOIN f USING (scan_id) WHERE rank <= 5"""))
def w12(spark, sf):
    f = B.findings(spark, sf).withColumn("scan_id", F.col("ord") - F.col("ord") % 3)
    return O.recent_scans(scans(spark, sf), f, 5).select("scan_id", "user_id", "rank", "critical", "high", "medium", "low", "info")


@query("w13_allocate_credits", with_ctes(CREDITS, body="""
, d AS (SELECT user_id, 's' || event_id AS scan_id, 1 + event_id % 2 AS amount, CAST(sum(1 + event_id % 2) OVER (PARTITION BY user_id ORDER BY event_id) AS DOUBLE) AS hi FROM events),
c AS (SELECT user_id, 'c' || credit_id AS credit_id, remaining AS amount, CAST(sum(remaining) OVER (PARTITION BY user_id ORDER BY ord) AS DOUBLE) AS hi FROM credits WHERE remaining > 0)
SELECT user_id, scan_id, credit_id, least(d.hi, c.hi) - greatest(d.hi - d.amount, c.hi - c.amount) AS amount FROM d JOIN c USING (user_id) WHERE least(d.hi, c.hi) > greatest(d.hi - d.amount, c.hi - c.amount)"""))
def w13(spark, sf):
    k = F.col("event_id")
    d = B.table(spark, sf, "events").select("user_id", k.alias("ord"), F.concat(F.lit("s"), k.cast("string")).alias("scan_id"), (1 + k % 2).alias("amount"))
    c = credits(spark, sf).filter("remaining > 0").select("user_id", "ord", F.concat(F.lit("c"), F.col("credit_id").cast("string")).alias("credit_id"), F.col("remaining").alias("amount"))
    return O.allocate_credits(d, c).withColumn("amount", F.col("amount").cast("double"))


# ---- skills: documents as a catalogue ---------------------------------------------------

SKILLS = "skills AS (SELECT doc_id, 'skill' || (doc_id % 300) AS name, source, CASE WHEN doc_id % 5 > 0 THEN lang END AS subdomain, text AS description, doc_id % 4 = 0 AS engine_backed FROM documents)"


def skills(spark, sf):
    d, k = B.table(spark, sf, "documents"), F.col("doc_id")
    return d.select("doc_id", F.concat(F.lit("skill"), (k % 300).cast("string")).alias("name"), "source", F.when(k % 5 > 0, F.col("lang")).alias("subdomain"), F.col("text").alias("description"), (k % 4 == 0).alias("engine_backed"))


@query("a25_catalog_counts", with_ctes(SKILLS, body="SELECT coalesce(subdomain, '—') AS subdomain, count(*) AS n FROM skills GROUP BY 1 ORDER BY n DESC, 1"))
def a25(spark, sf):
    return O.catalog_counts(skills(spark, sf))


@query("a25_source_counts", with_ctes(SKILLS, body="SELECT source, count(*) AS n FROM skills GROUP BY 1"))
def a25b(spark, sf):
    return O.catalog_source_counts(skills(spark, sf))


@query("w11_catalog_order", with_ctes(SKILLS, body="SELECT doc_id, name FROM skills ORDER BY engine_backed DESC, name, source"))
def w11(spark, sf):
    return O.catalog_order(skills(spark, sf)).select("doc_id", "name")


@query("f27_keyword_search", with_ctes(SKILLS, body="SELECT doc_id FROM skills WHERE subdomain = 'en' AND (contains(lower(name), 'the ') OR contains(lower(description), 'the ')) AND (contains(lower(name), 'that') OR contains(lower(description), 'that'))"))
def f27(spark, sf):
    return O.keyword_search(skills(spark, sf), ["The ", "that"], ["name", "description", "subdomain"], subdomain="en").select("doc_id")


@query("f28_qualified_lookup", with_ctes(SKILLS, body="SELECT source, name FROM skills WHERE name = 'skill7' ORDER BY engine_backed DESC, source LIMIT 1"))
def f28(spark, sf):
    return O.qualified_lookup(skills(spark, sf), "skill7").select("source", "name")


@query("f29_tool_mentions", """
WITH t AS (SELECT doc_id AS id, '# x' || chr(10) || 'curl outside' || chr(10) || '```sh' || chr(10) || CASE doc_id % 4 WHEN 0 THEN '$curl -s x | jq . && git pull' WHEN 1 THEN 'ls; nmap -p 1 host' WHEN 2 THEN 'echo docker' ELSE '  openssl s_client' END || chr(10) || '```' || chr(10) || replace(text, '`', ' ') || chr(10) || '```' || chr(10) || 'git status' AS text FROM documents)
SELECT id, unnest(CASE id % 4 WHEN 0 THEN ['curl', 'jq', 'git'] WHEN 1 THEN ['nmap', 'git'] WHEN 2 THEN ['git'] ELSE ['openssl', 'git'] END) AS tool FROM t""")
def f29(spark, sf):
    d, k = B.table(spark, sf, "documents"), F.col("doc_id")
    cmd = F.when(k % 4 == 0, "$curl -s x | jq . && git pull").when(k % 4 == 1, "ls; nmap -p 1 host").when(k % 4 == 2, "echo docker").otherwise("  openssl s_client")
    text = F.concat(F.lit("# x\ncurl outside\n```sh\n"), cmd, F.lit("\n```\n"), F.replace("text", F.lit("`"), F.lit(" ")), F.lit("\n```\ngit status"))
    return O.tool_mentions(d.select(k.alias("id"), text.alias("text")))
