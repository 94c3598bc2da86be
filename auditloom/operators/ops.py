"""Scan operations: metering, credits, entitlement, retention, skill catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..dims import reference as REF
from ..functions import scoring as S
from ..session import cut_lineage
from .keyed import running_total


def expire_leases(scans: DataFrame, now: Column, lease: str = "10 minutes", max_attempts: int = 3) -> DataFrame:
    """Processing scans past their lease: queued again while attempts are left, else failed."""
    stale = (F.col("status") == "processing") & (F.col("claimed_at") < now - F.expr(f"interval {lease}"))
    return scans.withColumn(
        "next_status",
        F.when(stale & (F.col("attempts") < max_attempts), "queued").when(stale, "failed").otherwise(F.col("status")),
    )


def expired_reports(scans: DataFrame, now: Column) -> DataFrame:
    """Reports older than their plan keeps them."""
    days = S.lookup({p: d for p, (_, d) in REF.PLANS.items() if d is not None}, F.col("plan"))
    return scans.filter(days.isNotNull() & (F.col("created_at").cast("date") < F.date_sub(now.cast("date"), days)))


def usage_by_period(scans: DataFrame) -> DataFrame:
    """Scans per user and UTC month."""
    return scans.groupBy("user_id", F.date_format("created_at", "yyyy-MM").alias("period")).agg(F.count("*").alias("used"))


def live_credits(credits: DataFrame, now: Column) -> DataFrame:
    live = (F.col("remaining") > 0) & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return credits.filter(live).groupBy("user_id").agg(F.sum("remaining").alias("credits"))


def entitlement(accounts: DataFrame) -> DataFrame:
    """Effective plan and what it allows: subscription over trial over free."""
    subscribed = F.col("subscription_plan").isin(*REF.PLANS) & F.col("subscription_status").isin(*REF.ACTIVE_STATUSES)
    trial = F.col("trial_ends_at") > F.col("now")
    source = F.when(subscribed, "subscription").when(trial, "trial").otherwise("free")
    plan = F.when(subscribed, F.col("subscription_plan")).when(trial, REF.TRIAL_PLAN).otherwise("free")
    quota = S.lookup({p: q for p, (q, _) in REF.PLANS.items() if q is not None}, F.col("plan"))
    out = accounts.withColumn("source", source).withColumn("plan", plan).withColumn("quota", quota)
    remaining = F.when(F.col("quota").isNotNull(), F.greatest(F.col("quota") - F.col("used"), F.lit(0)))
    left = F.ceil((F.col("trial_ends_at").cast("double") - F.col("now").cast("double")) / 86400)
    return out.select(
        *accounts.columns, "source", "plan", F.col("quota").cast("long").alias("quota"),
        remaining.cast("long").alias("remaining"),
        (remaining.isNull() | (remaining > 0) | (F.col("credits") > 0)).alias("can_scan"),
        F.when(F.col("source") == "trial", F.greatest(left, F.lit(1))).cast("long").alias("trial_days_left"),
    )


def dashboard_stats(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Per user: completed scans, average duration, critical, proven and likely findings."""
    done = scans.groupBy("user_id").agg(
        F.count_if(F.col("status") == "complete").alias("completed"),
        F.avg(F.when(F.col("status") == "complete", F.col("duration_ms"))).alias("avg_duration_ms"),
    )
    sev = findings.groupBy("user_id").agg(
        F.count_if(F.lower("severity") == "critical").alias("critical"),
        F.count_if(F.col("evidence") == "proven").alias("proven"),
        F.count_if(F.col("evidence") == "likely").alias("likely"),
        F.count_if(F.col("status") == "open").alias("open"),
        F.count_if(F.col("status") == "resolved").alias("resolved"),
    )
    return done.join(sev, "user_id", "left").na.fill(0, ["critical", "proven", "likely", "open", "resolved"])


def recent_scans(scans: DataFrame, findings: DataFrame, n: int) -> DataFrame:
    """The newest n scans of every user with severity counts.

    The per-user limit is applied before the shuffle (window group limit), so a
    user with a third of all scans contributes n rows per task.
    """
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("scan_id"))
    newest = scans.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)
    counts = findings.groupBy("scan_id").agg(
        *[F.count_if(F.lower("severity") == s).alias(s) for s in ("critical", "high", "medium", "low", "info")]
    )
    return newest.join(counts, "scan_id", "left").na.fill(0)


def allocate_credits(demand: DataFrame, credits: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Oldest credit first: which credit pays for how much of each request.

    Requests and credits become intervals of running totals per user; an amount
    is paid where the two overlap. Both sides are merged on one time line of
    interval ends, so the overlap needs a window, not a pairwise join.
    ``demand(user_id, ord, scan_id, amount)``, ``credits(user_id, ord, credit_id, amount)``. Amounts are exact to six
    decimal places; either side is read twice.
    """
    exact = "decimal(38,6)"
    part = chunk if chunk is not None else F.floor(F.col("ord") / 100_000)
    d = running_total(demand, ["user_id"], ["ord"], part, F.col("amount").cast("decimal(28,6)"), "upto").select(
        "user_id", F.col("upto").cast(exact).alias("upto"), "scan_id", F.lit(None).cast("string").alias("credit_id")
    )
    c = running_total(credits, ["user_id"], ["ord"], part, F.col("amount").cast("decimal(28,6)"), "upto").select(
        "user_id", F.col("upto").cast(exact).alias("upto"), F.lit(None).cast("string").alias("scan_id"), "credit_id"
    )
    # Ends at the same height merge; each segment up to an end belongs to the
    # next request and the next credit at or above it.
    ends = d.unionByName(c).groupBy("user_id", "upto").agg(
        F.max("scan_id").alias("scan_id"), F.max("credit_id").alias("credit_id")
    )
    width = F.floor(F.col("upto") / 100_000)
    ends = cut_lineage(ends.withColumn("chunk", width), "ends")
    heads = ends.groupBy("user_id", "chunk").agg(
        F.min_by("scan_id", F.when(F.col("scan_id").isNotNull(), F.col("upto"))).alias("next_scan"),
        F.min_by("credit_id", F.when(F.col("credit_id").isNotNull(), F.col("upto"))).alias("next_credit"),
        F.max("upto").alias("top"),
    )
    # The next one is looked for walking backwards: a frame that only grows costs one step a row.
    per_user = Window.partitionBy("user_id")
    after = per_user.orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    before = per_user.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    edges = heads.select(
        "user_id", "chunk",
        F.last("next_scan", ignorenulls=True).over(after).alias("_scan"),
        F.last("next_credit", ignorenulls=True).over(after).alias("_credit"),
        F.max("top").over(before).alias("_below"),
    )
    part_of = Window.partitionBy("user_id", "chunk")
    inside = part_of.orderBy("upto")
    ahead = part_of.orderBy(F.desc("upto")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seg = ends.join(edges, ["user_id", "chunk"]).select(
        "user_id", "upto",
        F.coalesce(F.last("scan_id", ignorenulls=True).over(ahead), "_scan").alias("scan_id"),
        F.coalesce(F.last("credit_id", ignorenulls=True).over(ahead), "_credit").alias("credit_id"),
        (F.col("upto") - F.coalesce(F.lag("upto").over(inside), F.col("_below"), F.lit(0).cast(exact))).alias("amount"),
    )
    return seg.filter(F.col("scan_id").isNotNull() & F.col("credit_id").isNotNull() & (F.col("amount") > 0)).groupBy(
        "user_id", "scan_id", "credit_id"
    ).agg(F.sum("amount").alias("amount"))


# ---- skill catalogue -----------------------------------------------------------------

# External commands a skill may need.
KNOWN_TOOLS = (
    "aws az gcloud kubectl helm terraform eksctl nmap tshark tcpdump zeek suricata masscan dig whois "
    "docker podman trivy grype syft cosign snyk volatility3 vol.py yara clamscan binwalk radare2 r2 "
    "strings exiftool sleuthkit autopsy chainsaw hayabusa msfconsole hydra hashcat john sqlmap "
    "impacket-smbserver bloodhound-python crackmapexec netexec responder subfinder amass httpx nuclei "
    "ffuf splunk elastic-agent filebeat sigma sigmac git python3 pip jq curl openssl ssh osquery"
).split()


def keyword_search(skills: DataFrame, terms: Sequence[str], fields: Sequence[str], source: str | None = None, subdomain: str | None = None) -> DataFrame:
    """Skills that contain every term in some field, ignoring case."""
    out = skills
    if source is not None:
        out = out.filter(F.col("source") == source)
    if subdomain is not None:
        out = out.filter(F.col("subdomain") == subdomain)
    for t in terms:
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.contains(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(t.lower()))
        out = out.filter(hit)
    return out


def qualified_lookup(skills: DataFrame, name: str) -> DataFrame:
    """``source:name`` exactly, or the first by catalogue order of that name."""
    if ":" in name:
        src, _, bare = name.partition(":")
        return skills.filter((F.col("source") == src) & (F.col("name") == bare)).limit(1)
    return skills.filter(F.col("name") == name).orderBy(F.desc("engine_backed"), "source").limit(1)


def catalog_order(skills: DataFrame) -> DataFrame:
    return skills.orderBy(F.desc("engine_backed"), "name", "source")


def catalog_counts(skills: DataFrame) -> DataFrame:
    """Skills per subdomain, most first."""
    return skills.groupBy(F.coalesce("subdomain", F.lit("—")).alias("subdomain")).agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "subdomain"
    )


def catalog_source_counts(skills: DataFrame) -> DataFrame:
    """Skills per source, by name."""
    return skills.groupBy("source").agg(F.count("*").alias("n")).orderBy("source")


def tool_mentions(texts: DataFrame, tools: Sequence[str] = KNOWN_TOOLS, fence: str = "```") -> DataFrame:
    """Known commands that start a pipeline segment inside fenced blocks; one row per (id, tool).

    A text splits at fence lines: every second piece is inside a fence.
    """
    pieces = F.split("text", rf"(?m)^[ \t]*{fence}[^\n]*$")
    inside = texts.filter(F.contains(F.col("text"), F.lit(fence))).select(
        "id", F.posexplode(pieces).alias("no", "piece")
    ).filter(F.col("no") % 2 == 1)
    words = inside.select("id", F.explode(F.split("piece", r"\n|\||;|&&")).alias("segment")).select(
        "id", F.regexp_replace(F.regexp_extract("segment", r"^\s*(\S+)", 1), r"^\$+", "").alias("tool")
    )
    return words.filter(F.col("tool").isin(*tools)).distinct()
