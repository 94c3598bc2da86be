"""Selection, de-duplication, counting and comparison of findings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scoring as S
from .keyed import first_by, join_keys

IDENTITY = ["repo", "invariant_id", "file", "line"]


# ---- filters ---------------------------------------------------------------

def filter_min_severity(findings: DataFrame, minimum: str) -> DataFrame:
    """Gate scale: info counts as low."""
    return findings.filter(S.gate_rank(F.col("severity")) >= S.GATE_RANK[minimum.lower()])


def filter_rule(findings: DataFrame, needles: Sequence[str]) -> DataFrame:
    return findings.filter(
        reduce(lambda a, b: a | b, [F.contains(F.col("invariant_id"), F.lit(n)) for n in needles])
    )


def drop_fixture_paths(findings: DataFrame) -> DataFrame:
    return findings.filter(~F.col("file").rlike("/(corpus|fixtures)/"))


def gate(findings: DataFrame, fail_on: str, leads: bool) -> DataFrame:
    """One verdict per repository: does a finding block the build?"""
    severe = S.gate_rank(F.col("severity")) >= S.GATE_RANK[fail_on.lower()]
    counted = severe if leads else severe & (F.col("evidence") == "proven")
    return findings.groupBy("repo").agg(F.bool_or(counted).alias("blocked"))


def min_exploitability(rated: DataFrame, minimum: str) -> DataFrame:
    return rated.filter(
        S.exploitability_rank(F.col("exploitability")) >= S.EXPLOITABILITY.index(minimum)
    )


def suppress(findings: DataFrame, lines: DataFrame, marker: str) -> DataFrame:
    """Drop findings an inline marker allows on its own line or the line below.

    Markers are rare; only marker lines are shuffled against the findings.
    """
    quoted = "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in marker)
    scope = F.regexp_extract("text", quoted + r"\s*([A-Za-z0-9_]*)", 1)
    marks = (
        lines.filter(F.contains(F.col("text"), F.lit(marker)))
        .select(
            "repo", F.col("path").alias("file"), scope.alias("scope"),
            F.explode(F.array(F.col("line"), F.col("line") + 1)).alias("line"),
        )
        .groupBy("repo", "file", "line")
        .agg(F.collect_set("scope").alias("scopes"))
    )
    joined = findings.join(marks, ["repo", "file", "line"], "left")
    allowed = F.array_contains("scopes", "") | F.array_contains("scopes", F.col("invariant_id"))
    return joined.filter(F.col("scopes").isNull() | ~allowed).select(*findings.columns)


def restore_snippets(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Put the original trimmed line back as the snippet."""
    original = lines.select(
        "repo", F.col("path").alias("file"), "line", F.trim("text").alias("_original")
    )
    return findings.join(original, ["repo", "file", "line"], "left").withColumn(
        "snippet", F.coalesce("_original", "snippet")
    ).select(*findings.columns)


def normalize_scan_row(raw: DataFrame, max_snippet: int | None = None) -> DataFrame:
    """Coerce raw report rows to the stored shape; snippets stay whole or are cut to ``max_snippet``."""
    sev = F.lower(F.coalesce("severity", F.lit("low")))
    sev = F.when(sev.isin("critical", "high", "medium", "low", "info"), sev).otherwise("low")
    loc = r"^(.*):(\d+)$"
    has_file = F.coalesce(F.col("file"), F.lit("")) != ""
    file = F.when(has_file, F.col("file")).when(
        F.col("location").rlike(loc), F.regexp_extract("location", loc, 1)
    ).otherwise(F.nullif(F.col("location"), F.lit("")))
    at = F.when(F.col("line") > 0, F.col("line")).when(
        ~has_file & F.col("location").rlike(loc),
        F.regexp_extract("location", loc, 2).try_cast("bigint"),
    )
    rule = F.nullif(F.col("invariant_id"), F.lit(""))
    title = F.coalesce(
        F.nullif(F.col("title"), F.lit("")), F.replace(rule, F.lit("_"), F.lit(" ")),
        F.lit("security finding"),
    )
    line = F.nullif(at, F.lit(0))
    return raw.select(
        "scan_id", sev.alias("severity"), title.alias("title"), rule.alias("invariant_id"),
        F.coalesce(F.nullif(F.col("message"), F.lit("")), F.lit("Security issue detected")).alias("description"),
        file.alias("file"), line.alias("line"),
        F.when(F.col("evidence") == "proven", "proven").otherwise("lead").alias("evidence"),
        F.when(F.col("exploitability").isin(*S.EXPLOITABILITY), F.col("exploitability")).alias("exploitability"),
        F.coalesce(
            F.nullif(F.col("fix"), F.lit("")), F.nullif(F.col("recommendation"), F.lit("")),
            F.lit("Review this finding and apply the relevant invariant guidance."),
        ).alias("recommendation"),
        (F.col("snippet") if max_snippet is None else F.substring("snippet", 1, max_snippet)).alias("snippet"),
        S.fingerprint(sev, F.coalesce(rule, title), file, line).alias("fingerprint"),
    )


# ---- de-duplication and order ------------------------------------------------

def dedup_findings(findings: DataFrame) -> DataFrame:
    """The first by emission order per (repo, rule, file, line)."""
    return first_by(findings, IDENTITY, [F.col("ord")])


def order_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(S.severity_rank(F.col("severity")).desc(), F.col("line"), F.col("ord"))


def rank_exposure(rated: DataFrame, k: int) -> DataFrame:
    """The k worst by exploitability, then severity."""
    return rated.orderBy(
        S.exploitability_rank(F.col("exploitability")).desc(),
        S.severity_rank(F.col("severity")).desc(), F.col("ord"),
    ).limit(k)


# ---- set operations -----------------------------------------------------------

def union_findings(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def identity(findings: DataFrame) -> DataFrame:
    return findings.select(*IDENTITY).distinct()


def new_and_fixed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Identities on one side only."""
    a, b = identity(before), identity(after)
    return b.exceptAll(a).withColumn("change", F.lit("new")).unionByName(
        a.exceptAll(b).withColumn("change", F.lit("fixed"))
    )


def common_findings(a: DataFrame, b: DataFrame) -> DataFrame:
    return identity(a).intersect(identity(b))


def golden_diff(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows added, removed or moved between two runs, with multiplicity.

    A rule whose count in a file is unchanged but whose lines differ has moved.
    """
    key = ["repo", "file", "invariant_id", "severity", "line"]
    side = lambda df, name: df.groupBy(*key).agg(F.count("*").alias(name))
    both = side(actual, "n_actual").join(side(expected, "n_expected"), key, "full_outer").na.fill(
        0, ["n_actual", "n_expected"]
    )
    diff = both.filter(F.col("n_actual") != F.col("n_expected"))
    net = diff.groupBy("repo", "file", "invariant_id", "severity").agg(
        F.sum("n_actual").alias("a"), F.sum("n_expected").alias("e")
    ).withColumn("moved", (F.col("a") == F.col("e")) & (F.col("a") > 0))
    return join_keys(diff, net, ["repo", "file", "invariant_id", "severity"]).select(
        *key,
        F.when(F.col("moved"), "moved")
        .when(F.col("n_actual") > F.col("n_expected"), "added")
        .otherwise("removed").alias("change"),
        (F.col("n_actual") - F.col("n_expected")).alias("delta"),
    )


# ---- counts ------------------------------------------------------------------

LEVELS = ("Critical", "High", "Medium", "Low", "Info")


def severity_stats(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    sev = F.col("severity")
    return findings.groupBy(*keys).agg(
        *[F.count_if(sev == l).alias(l.lower()) for l in LEVELS],
        F.count_if(sev.isin(*LEVELS)).alias("total"),
    )


def risk_score_weighted(stats: DataFrame) -> DataFrame:
    """Weighted share between 0 and 1; 0 when there is nothing."""
    weights = {"critical": 100, "high": 75, "medium": 50, "low": 25, "info": 10}
    points = reduce(lambda a, b: a + b, [F.col(c) * w for c, w in weights.items()])
    return stats.withColumn(
        "risk", F.coalesce(F.try_divide(points.cast("double"), F.col("total") * 100), F.lit(0.0))
    )


def risk_score_capped(stats: DataFrame) -> DataFrame:
    points = F.col("critical") * 25 + F.col("high") * 15 + F.col("medium") * 8 + F.col("low") * 3
    return stats.withColumn("risk_score", F.least(points, F.lit(100))).withColumn(
        "passed", (F.col("critical") == 0) & (F.col("high") == 0)
    )


def scan_summary(findings: DataFrame) -> DataFrame:
    """Totals per repository; anything below medium counts as low."""
    rank, proven = S.gate_rank(F.col("severity")), F.col("evidence") == "proven"
    return findings.groupBy("repo").agg(
        F.count("*").alias("violations"),
        F.count_if(proven).alias("proven"),
        F.count_if(~proven).alias("leads"),
        *[F.count_if(rank == S.GATE_RANK[l]).alias(l) for l in ("critical", "high", "medium", "low")],
    )


def rule_counts(findings: DataFrame, exclude_info: bool = True) -> DataFrame:
    scoped = findings.filter(F.col("severity") != "Info") if exclude_info else findings
    return scoped.groupBy("repo", "invariant_id").agg(F.count("*").alias("n"))


def rule_sketches(findings: DataFrame, day: Column, bits: int = 14) -> DataFrame:
    """(invariant_id, day, files, repos): mergeable sketches of the distinct files and repositories of a rule and day.

    Stored once a day, they answer for any span of days without its findings. ``bits`` sets the size (2 ** bits small
    registers at most) and the error: about 0.8 / sqrt(2 ** bits).
    """
    return findings.groupBy("invariant_id", day.alias("day")).agg(
        F.hll_sketch_agg("file", bits).alias("files"), F.hll_sketch_agg("repo", bits).alias("repos")
    )


def sketched_cardinality(sketches: DataFrame) -> DataFrame:
    """Distinct files and repositories per rule over all days of ``sketches``; a merge of sketches, nothing is counted again."""
    estimate = lambda c: F.hll_sketch_estimate(F.hll_union_agg(c)).alias(f"approx_{c}")
    return sketches.groupBy("invariant_id").agg(estimate("files"), estimate("repos"))


def approx_rule_cardinality(findings: DataFrame) -> DataFrame:
    """Distinct files and repositories per rule, exact and by sketch.

    Both are taken from the distinct values of a rule, which give the same sketch as all rows: beside distinct counts in one
    aggregate, every value would carry a sketch of its own. The sketch is the one to use on unbounded data.
    """
    values = lambda c: findings.select("invariant_id", c).distinct().groupBy("invariant_id").agg(
        F.count(c).alias(f"{c}s"), F.approx_count_distinct(c, 0.01).alias(f"approx_{c}s")
    )
    return join_keys(values("file"), values("repo"), ["invariant_id"]).select("invariant_id", "files", "repos", "approx_files", "approx_repos")


def quality(cases: DataFrame, keys: Sequence[str], empty: float) -> DataFrame:
    """Precision, recall and F1 from (expected, fired) cases."""
    e, f = F.col("expected"), F.col("fired")
    counts = cases.groupBy(*keys).agg(
        F.count_if(e & f).alias("tp"), F.count_if(~e & f).alias("fp"), F.count_if(e & ~f).alias("fn")
    )
    ratio = lambda n, d: F.coalesce(F.try_divide(n.cast("double"), d), F.lit(empty))
    p = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return counts.select(
        *keys, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1.alias("f1"),
        ((p >= 0.9) & (r >= 0.9) & (f1 >= 0.9)).alias("passes"),
    )


def detector_quality(cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    return quality(cases, keys, 1.0)


def fuzz_quality(cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    return quality(cases, keys, 0.0)


def class_recall(texts: DataFrame, fired: DataFrame, classes: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Per class: matching texts, texts where a rule of the class fired, where any fired."""
    rules = fired.groupBy("id").agg(F.collect_set("invariant_id").alias("hits"))
    body = F.lower("text")
    labelled = texts.select(
        "id",
        F.array_compact(
            F.array(*[F.when(body.rlike(rx), F.lit(name)) for name, (rx, _) in classes.items()])
        ).alias("labels"),
    ).filter(F.size("labels") > 0)
    wanted = F.create_map(*[
        x for name, (_, ids) in classes.items()
        for x in (F.lit(name), F.array(*[F.lit(i) for i in ids]))
    ])
    rows = labelled.join(rules, "id", "left").select(
        F.explode("labels").alias("class"), F.coalesce("hits", F.array().cast("array<string>")).alias("hits")
    )
    return rows.groupBy("class").agg(
        F.count("*").alias("n"),
        F.count_if(F.arrays_overlap("hits", wanted[F.col("class")])).alias("class_fired"),
        F.count_if(F.size("hits") > 0).alias("any_fired"),
    )


def symbolic_stats(checks: DataFrame) -> DataFrame:
    """Outcome of symbolic checks: passed, counterexample (proven with a model), unresolved."""
    code = F.col("exitcode")
    return checks.groupBy("repo").agg(
        F.count_if(code == 0).alias("passed"),
        F.count_if(code == 1).alias("counterexamples"),
        F.count_if((code == 1) & F.col("valid_model")).alias("proven"),
        F.count_if(~code.isin(0, 1)).alias("unresolved"),
    )


# ---- runs, agents and the ledger ------------------------------------------------

# Strength of kinds, tiers and severities in a merged report.
KIND_RANK = {"FINDING": 1, "LEAD": 0}
TIER_RANK = {"VERIFIED-PROVEN": 3, "VERIFIED-STATIC": 2, "REASONED": 1}
REPORT_SEVERITY = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}


def merge_runs(rows: DataFrame, total_runs: int | None = None) -> DataFrame:
    """One winner per key: kind, tier, confidence, later pass; and in how many runs it was seen.

    Rows flagged ``engine`` were produced once for the whole scan and count for
    every run.
    """
    conf = F.coalesce("confidence", F.lit(-1.0))
    strength = F.struct(
        F.coalesce(S.lookup(KIND_RANK, F.col("kind")), F.lit(0)).alias("kind_rank"),
        F.coalesce(S.lookup(TIER_RANK, F.col("tier")), F.lit(0)).alias("tier_rank"),
        conf.alias("conf"), F.col("pass").alias("pass"), F.col("ord").alias("ord"),
        F.col("kind").alias("kind"), F.col("tier").alias("tier"), F.col("confidence").alias("confidence"),
        F.col("run").alias("run"),
    )
    seen = F.countDistinct(F.when(~F.col("engine"), F.col("run")))
    merged = rows.groupBy("key").agg(
        F.max(strength).alias("w"), seen.alias("seen"), F.bool_or("engine").alias("engine")
    )
    all_runs = F.lit(total_runs) if total_runs else F.greatest(F.col("seen"), F.lit(1))
    return merged.select(
        "key", "w.kind", "w.tier", "w.confidence", "w.pass", "w.run",
        F.when(F.col("engine"), all_runs).otherwise(F.col("seen")).cast("long").alias("seen_in"),
    )


def tag_known(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """NEW, or KNOWN with the scan count this scan makes."""
    old = ledger.select("key", F.col("scans").alias("_scans"))
    return rows.join(old, "key", "left").withColumn(
        "memory",
        F.when(F.col("_scans").isNull(), "NEW").otherwise(
            F.concat(F.lit("KNOWN ("), (F.col("_scans") + 1).cast("string"), F.lit(" scans)"))
        ),
    ).drop("_scans")


def order_report(rows: DataFrame) -> DataFrame:
    return rows.orderBy(
        "kind",
        F.coalesce(S.lookup(REPORT_SEVERITY, F.lower("severity")), F.lit(0)).desc(),
        F.coalesce(S.lookup(TIER_RANK, F.col("tier")), F.lit(0)).desc(),
        F.coalesce("confidence", F.lit(-1.0)).desc(), "key",
    )


def canonical_label(rows: DataFrame, known: DataFrame) -> DataFrame:
    """One label per (contract, function): a known one, else most agents, else shortest."""
    votes = rows.groupBy("contract", "function", "label").agg(F.countDistinct("agent").alias("agents"))
    seen = known.select("contract", "function", "label").distinct().withColumn("in_ledger", F.lit(1))
    scored = votes.join(seen, ["contract", "function", "label"], "left")
    return scored.groupBy("contract", "function").agg(
        F.min(
            F.struct(
                (-F.coalesce("in_ledger", F.lit(0))).alias("k"), (-F.col("agents")).alias("a"),
                F.length("label").alias("n"), F.col("label").alias("label"),
            )
        )["label"].alias("label"),
        F.count("*").alias("labels"),
    )


def promote_leads(rows: DataFrame, agents: int = 2, confidence: int = 75) -> DataFrame:
    """A lead that enough agents raised becomes a finding of fixed confidence."""
    per_key = rows.groupBy("key").agg(
        F.countDistinct("agent").alias("agents"),
        F.max(F.when(F.col("kind") == "FINDING", 1).otherwise(0)).alias("is_finding"),
        F.max("confidence").alias("confidence"),
    )
    promoted = (F.col("is_finding") == 0) & (F.col("agents") >= agents)
    return per_key.select(
        "key", "agents",
        F.when((F.col("is_finding") == 1) | promoted, "FINDING").otherwise("LEAD").alias("kind"),
        F.when(promoted, F.lit(float(confidence))).otherwise(F.col("confidence")).alias("confidence"),
        promoted.alias("promoted"),
    )


def compose_chain(a: DataFrame, b: DataFrame, link: str) -> DataFrame:
    """Pairs where A's output is B's input, at the lower confidence.

    Both sides first shrink to their best row per (link, key), and a link value
    shared by many keys is a true many-to-many fact of the data; the join is an
    equi-join AQE may split.
    """
    left = a.groupBy(link, "key").agg(F.max("confidence").alias("conf_a")).withColumnRenamed("key", "key_a")
    right = b.groupBy(link, "key").agg(F.max("confidence").alias("conf_b")).withColumnRenamed("key", "key_b")
    return left.join(right, link).select(
        link, "key_a", "key_b", F.least("conf_a", "conf_b").alias("confidence")
    )


def ledger_merge(old: DataFrame, rows: DataFrame) -> DataFrame:
    """Fold a scan's rows into the ledger; running it twice changes nothing more."""
    latest = rows.groupBy("key").agg(
        F.max(F.struct("ord", "sha", "title", "kind")).alias("n")
    )
    o = old.select("key", *[F.col(c).alias(f"o_{c}") for c in ("status", "scans", "sha", "title", "kind")])
    m = o.join(latest, "key", "full_outer")
    was, now = F.col("o_status").isNotNull(), F.col("n").isNotNull()
    newer = lambda c: F.when(now, F.col(f"n.{c}")).otherwise(F.col(f"o_{c}"))
    return m.select(
        "key",
        F.when(was & now, "KNOWN").when(was, F.col("o_status")).otherwise("NEW").alias("status"),
        F.when(was & now, F.col("o_scans") + 1).when(was, F.col("o_scans")).otherwise(1).cast("long").alias("scans"),
        newer("sha").alias("sha"), newer("title").alias("title"), newer("kind").alias("kind"),
    )


def completeness(raw: DataFrame, report: DataFrame) -> DataFrame:
    """(contract, function) pairs somebody raised and the report lost."""
    key = ["contract", "function"]
    return raw.select(*key).distinct().join(report.select(*key).distinct(), key, "left_anti")


def distinct_fixes(rows: DataFrame) -> DataFrame:
    """Every distinct fix per (contract, function), never merged across functions.

    One row per fix keeps a function with very many fixes out of a single cell.
    """
    return rows.filter(F.col("fix").isNotNull()).groupBy("contract", "function", "fix").agg(
        F.countDistinct("agent").alias("agents")
    )


def bucket_check(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Confidence buckets and tiers must each add up to the number of findings."""
    c = F.col("confidence")
    counts = rows.groupBy(*keys).agg(
        F.count("*").alias("findings"),
        F.count_if(c.between(90, 100)).alias("a"),
        F.count_if((c >= 75) & (c < 90)).alias("b"),
        F.count_if(c < 75).alias("c"),
        *[F.count_if(F.col("tier") == t).alias(n) for t, n in (
            ("VERIFIED-PROVEN", "proven"), ("VERIFIED-STATIC", "static"), ("REASONED", "reasoned"))],
    )
    return counts.withColumn(
        "sums",
        (F.col("a") + F.col("b") + F.col("c") == F.col("findings"))
        & (F.col("proven") + F.col("static") + F.col("reasoned") == F.col("findings")),
    )


def trend(runs: DataFrame) -> DataFrame:
    """New, persisting and fixed findings between consecutive scans of a repository.

    A finding is new in a scan when the previous scan did not have it, fixed
    when the next scan lacks it. Presence is compared by an equi-join on
    (repo, scan number, fingerprint); only the short list of scans per
    repository is ordered.
    """
    from pyspark.sql import Window

    present = runs.select("repo", "scan", "fingerprint").distinct()
    order = Window.partitionBy("repo").orderBy("scan")
    scans = present.select("repo", "scan").distinct().withColumn("no", F.row_number().over(order))
    numbered = present.join(scans, ["repo", "scan"]).select("repo", "no", "fingerprint")
    shifted = numbered.select("repo", (F.col("no") + 1).alias("no"), "fingerprint", F.lit(1).alias("before"))
    both = numbered.withColumn("now", F.lit(1)).join(shifted, ["repo", "no", "fingerprint"], "full_outer")
    counts = both.groupBy("repo", "no").agg(
        F.count_if(F.col("before").isNull()).alias("new"),
        F.count_if(F.col("now").isNotNull() & F.col("before").isNotNull()).alias("persisting"),
        F.count_if(F.col("now").isNull()).alias("fixed"),
    )
    return counts.join(scans, ["repo", "no"]).select("repo", "scan", "new", "persisting", "fixed")
