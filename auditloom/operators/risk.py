"""Classification, rating, chains, acceptances, checklist and pathways."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import cut_lineage
from ..dims import reference as REF
from ..functions import scoring as S
from ..functions import text as TX
from . import corpus


# ---- dimensions -------------------------------------------------------------

def taxonomy_table(spark: SparkSession, rows: dict | None = None) -> DataFrame:
    data = [
        (rule, [f"CWE-{c}" for c in cwe], list(attack))
        for rule, (cwe, attack) in (rows or REF.TAXONOMY).items()
    ]
    return spark.createDataFrame(data, "invariant_id string, cwe array<string>, attack array<string>")


def exposure_table(spark: SparkSession, rows: dict | None = None) -> DataFrame:
    data = [(rule, *profile) for rule, profile in (rows or REF.EXPOSURE).items()]
    return spark.createDataFrame(
        data, "invariant_id string, vector string, prereq string, interaction string"
    )


def chain_steps(spark: SparkSession, chains=REF.CHAINS) -> DataFrame:
    data = [
        (chain, no, len(steps), rule)
        for chain, steps in chains for no, rules in enumerate(steps) for rule in rules
    ]
    return spark.createDataFrame(
        data, "chain_id string, step_no int, n_steps int, invariant_id string"
    )


# ---- lookups --------------------------------------------------------------------
# The dimension side is left to Spark's size-checked broadcast; every lookup is
# an equi-join, so an oversized dimension degrades to a shuffled join.

def with_taxonomy(findings: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Attach weakness classes; an unmapped rule stays NULL."""
    return findings.join(taxonomy, "invariant_id", "left")


def with_exposure(findings: DataFrame, exposure: DataFrame) -> DataFrame:
    return findings.join(exposure, "invariant_id", "left")


def rate(findings: DataFrame, exposure: DataFrame) -> DataFrame:
    """Exploitability label, score and reasons from profile and evidence."""
    parts = [F.col("vector"), F.col("prereq"), F.col("interaction"), F.col("evidence") == "proven"]
    return with_exposure(findings, exposure).withColumns({
        "exploitability": S.exploitability(*parts),
        "score": S.exploitability_score(*parts),
        "reasons": F.when(F.col("vector").isNotNull(), S.exploit_reasons(*parts)),
    })


def taxonomy_tags(*registries: Column) -> Column:
    """All registry ids of a row in one array."""
    return F.concat(*[F.coalesce(r, F.array().cast("array<string>")) for r in registries])


def taxonomy_matrix(taxonomy: DataFrame) -> DataFrame:
    """Rules per tag and analyzer, with totals."""
    tags = taxonomy.select(
        "invariant_id", F.coalesce(S.chain_of(F.col("invariant_id")), F.lit("agnostic")).alias("chain"),
        F.explode(taxonomy_tags(F.col("cwe"), F.col("attack"))).alias("tag"),
    )
    return tags.rollup("tag", "chain").agg(F.countDistinct("invariant_id").alias("rules")).filter(
        F.col("tag").isNotNull()
    )


def rules_for_weakness(taxonomy: DataFrame, weakness: str) -> DataFrame:
    tags = taxonomy_tags(F.col("cwe"), F.col("attack"))
    return taxonomy.filter(F.exists(tags, lambda t: F.upper(t) == weakness.upper()))


def exploits_for_rule(registry: DataFrame, rules: DataFrame) -> DataFrame:
    """Past exploits each rule would have caught."""
    caught = registry.withColumn("invariant_id", F.explode("invariant_ids"))
    return rules.join(caught, "invariant_id")


def total_loss(registry: DataFrame, by: Sequence[str]) -> DataFrame:
    return registry.groupBy(*by).agg(F.sum("loss_usd").alias("loss_usd"), F.count("*").alias("exploits"))


def rule_coverage(library: DataFrame, rules: DataFrame) -> DataFrame:
    """Library rule to its detector, or why it is advisory only."""
    known = rules.select(F.col("invariant_id").alias("detector"), F.lit(True).alias("exists"))
    return library.join(known, "detector", "left").select(
        "library_id", "detector", "reason",
        F.when(F.col("detector").isNull(), "advisory")
        .when(F.col("exists"), "implemented").otherwise("missing").alias("status"),
    )


def advice_for(findings: DataFrame, types: DataFrame, advice: DataFrame) -> DataFrame:
    """Rule to vulnerability type to recommendations; none gives an empty list."""
    return (
        findings.join(types, F.lower("invariant_id") == types["detector"], "left")
        .join(advice, "vuln_type", "left")
        .withColumn("recommendations", F.coalesce("recommendations", F.array().cast("array<string>")))
        .drop("detector")
    )


# ---- acceptances -------------------------------------------------------------------

MIN_REASON = 15


def validate_acceptances(acceptances: DataFrame) -> DataFrame:
    """Rows that make the whole list invalid, with the problem."""
    until = F.col("until")
    problem = (
        F.when(F.length(F.trim("reason")) < MIN_REASON, "reason too short")
        .when(~F.coalesce(until.rlike(r"^\d{4}-(0?[1-9]|1[0-2])-(0?[1-9]|[12]\d|3[01])$"), F.lit(False)), "bad date")
        .when(F.trim("owner") == "", "owner missing")
    )
    return acceptances.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def require_valid_acceptances(acceptances: DataFrame) -> DataFrame:
    """Raise when any row is invalid: a typo must not silently un-accept."""
    bad = validate_acceptances(acceptances).limit(1).take(1)
    if bad:
        raise ValueError(f"acceptance of {bad[0]['id']}: {bad[0]['problem']}")
    return acceptances


def accept(findings: DataFrame, acceptances: DataFrame, today: str) -> DataFrame:
    """Mark findings ``accepted`` by the first acceptance in list order, else ``open``.

    A rule may have any number of acceptances. Those with a path meet findings by equality on the rule and the rarest
    gram of the path, those with only a text on a gram of the text, and only such pairs are verified; those with
    neither on the rule alone, one each. Findings alike in rule, file and texts are looked up once, and a finding
    keeps the least position of what covers it.
    """
    # Of several entries with the same conditions only the first can ever win.
    options = cut_lineage(
        acceptances.filter(F.to_date("until") >= F.lit(today).cast("date"))
        .groupBy(F.col("id").alias("invariant_id"), F.col("path").alias("_path"), F.col("match").alias("_text"))
        .agg(F.min(F.struct("pos", "owner", "until")).alias("_first"))
        .withColumn("_prefix", F.regexp_replace("_path", r"^(\./)+", "")), "acceptances",
    )
    told = F.to_json(F.struct("invariant_id", "file", "message", "snippet"))
    keyed = findings.withColumn("_key", F.struct(F.xxhash64(told).alias("a"), F.xxhash64(F.lit(1), told).alias("b")))
    items = keyed.select("_key", "invariant_id", F.regexp_replace("file", r"^(\./)+", "").alias("_bare"), "message", "snippet")
    items = cut_lineage(items.join(options.select("invariant_id").distinct(), "invariant_id", "left_semi").distinct(), "items")
    on_path = F.col("_path").isNull() | F.startswith("_bare", "_prefix") | F.contains("_bare", "_path")
    on_text = F.col("_text").isNull() | F.contains("message", "_text") | F.contains("snippet", "_text")
    by_path = _meet(items, F.col("_bare"), options.filter("_path is not null"), "_prefix")
    by_text = _meet(items, F.concat_ws("\0", "message", "snippet"), options.filter("_path is null and _text is not null"), "_text")
    plain = items.select("_key", "invariant_id").join(options.filter("_path is null and _text is null"), "invariant_id")
    hits = [rows.select("_key", "_first") for rows in (plain, by_path.filter(on_path & on_text), by_text.filter(on_text))]
    best = hits[0].unionByName(hits[1]).unionByName(hits[2]).groupBy("_key").agg(F.min("_first").alias("_hit"))
    return keyed.join(best, "_key", "left").select(
        *findings.columns,
        F.when(F.col("_hit").isNull(), "open").otherwise("accepted").alias("state"),
        F.col("_hit.owner").alias("accepted_by"), F.col("_hit.until").alias("accepted_until"),
    )


def _meet(items: DataFrame, text: Column, options: DataFrame, needle: str) -> DataFrame:
    """Items with the options of their rule whose ``needle`` may lie in ``text``; all that do are among them."""
    from .rules import line_grams, needle_index

    lines = items.withColumn("text", text)
    index = cut_lineage(needle_index(options.select(F.col(needle).alias("needle")).distinct(), lines), "needles")
    wanted = options.join(index.withColumnRenamed("needle", needle), needle)
    return line_grams(lines, index.select("gram").distinct()).drop("text").join(wanted, ["invariant_id", "gram"])


def expired_acceptances(acceptances: DataFrame, today: str) -> DataFrame:
    return acceptances.filter(F.to_date("until") < F.lit(today).cast("date"))


# ---- chains ---------------------------------------------------------------------

def rule_presence(findings: DataFrame, exposure: DataFrame) -> DataFrame:
    """Count and worst exploitability per (repo, rule)."""
    rated = rate(findings, exposure)
    return rated.groupBy("repo", "invariant_id").agg(
        F.count("*").alias("n"),
        F.max(S.exploitability_rank(F.col("exploitability"))).alias("worst"),
    )


def attack_chains(findings: DataFrame, steps: DataFrame, exposure: DataFrame) -> DataFrame:
    """Chains every step of which some finding satisfies."""
    hits = rule_presence(findings, exposure).join(steps, "invariant_id")
    labels = F.array(*[F.lit(x) for x in S.EXPLOITABILITY])
    return (
        hits.groupBy("repo", "chain_id")
        .agg(
            F.countDistinct("step_no").alias("met"), F.max("n_steps").alias("n_steps"),
            F.max("worst").alias("worst"), F.sum("n").alias("findings"),
            F.array_sort(F.collect_set(F.struct("step_no", "invariant_id", "n"))).alias("satisfied_by"),
        )
        .filter(F.col("met") == F.col("n_steps"))
        .select("repo", "chain_id", "n_steps", "findings", F.get(labels, F.col("worst")).alias("exploitability"), "satisfied_by")
    )


# ---- checklist -------------------------------------------------------------------

def checklist(
    repos: DataFrame, counts: DataFrame, accepted: DataFrame, signals: DataFrame,
    chains: DataFrame, likely: DataFrame,
    items: Sequence[REF.Item] = REF.CHECKLIST, probe_loaded: bool = False, symbolic_loaded: bool = False,
) -> DataFrame:
    """Status and detail of every item for every repository.

    Rule counts shrink to one map per repository holding only the rules the
    checklist names, so the map's size is bounded by the list itself; items are
    then expanded on the row without another join.
    """
    named = sorted({i for it in items if it.kind in ("detectors", "probe", "tool") for i in it.ids})

    def as_map(df: DataFrame, name: str) -> DataFrame:
        return (
            df.filter(F.col("invariant_id").isin(*named))
            .groupBy("repo")
            .agg(F.map_from_entries(F.collect_list(F.struct("invariant_id", "n"))).alias(name))
        )

    sig = signals.groupBy("repo").agg(
        F.map_from_entries(
            F.collect_list(F.struct("signal", F.struct("present", "wired", "evidence")))
        ).alias("signals")
    )
    chain_list = chains.groupBy("repo").agg(F.array_sort(F.collect_set("chain_id")).alias("chains"))
    rows = (
        repos.join(as_map(counts, "counts"), "repo", "left")
        .join(as_map(accepted, "accepted"), "repo", "left")
        .join(sig, "repo", "left")
        .join(chain_list, "repo", "left")
        .join(likely.select("repo", "likely"), "repo", "left")
    )

    def tally(name: str, ids: Sequence[str]) -> Column:
        m = F.col(name)
        return F.filter(
            F.transform(
                F.array(*[F.lit(i) for i in ids]),
                lambda i: F.when(m[i].isNotNull(), F.concat(i, F.lit(" ×"), m[i].cast("string"))),
            ),
            lambda t: t.isNotNull(),
        )

    def verdict(it: REF.Item) -> Column:
        def out(status, detail) -> Column:
            return F.struct(F.lit(status).alias("status"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"))

        applies = F.lit(True) if it.scope == "any" else F.col(it.scope)
        na = out("N/A", "out of scope here")
        if it.kind == "detectors":
            hits, acc = tally("counts", it.ids), tally("accepted", it.ids)
            return (
                F.when(~applies, na)
                .when(F.size(hits) > 0, out("FAIL", F.array_join(hits, ", ")))
                .when(F.size(acc) > 0, out("ACCEPTED", F.concat(F.lit("risk taken for "), F.array_join(acc, ", "))))
                .otherwise(out("PASS", f"clean for all {len(it.ids)} rules"))
            )
        if it.kind == "probe":
            if not probe_loaded:
                return out("NEEDS-TOOL", "no probe results given")
            hits = tally("counts", it.ids)
            return F.when(F.size(hits) > 0, out("FAIL", F.array_join(hits, ", "))).otherwise(
                out("PASS", "nothing seen by the probe")
            )
        if it.kind == "tool":
            if not symbolic_loaded:
                return F.when(~applies, na).otherwise(out("NEEDS-TOOL", "no symbolic results given"))
            n = lambda k: F.coalesce(F.col("counts")[it.ids[k]], F.lit(0)) if k < len(it.ids) else F.lit(0)
            return (
                F.when(~applies, na)
                .when(n(0) > 0, out("FAIL", F.concat(n(0).cast("string"), F.lit(" refuted"))))
                .when(n(1) > 0, out("PARTIAL", F.concat(n(1).cast("string"), F.lit(" left open"))))
                .otherwise(out("PASS", "all symbolic results hold"))
            )
        if it.kind == "signal":
            s = F.col("signals")[it.ids[0]]
            shown = F.array_join(s["evidence"], ", ")
            return (
                F.when(s["present"] & s["wired"], out("PASS", F.concat(F.lit(f"{it.ids[0]} wired into CI: "), shown)))
                .when(s["present"], out("PARTIAL", F.concat(F.lit(f"{it.ids[0]} not wired into CI: "), shown)))
                .otherwise(out("MISSING", f"{it.ids[0]} absent"))
            )
        if it.kind == "chains":
            return F.when(F.col("chains").isNotNull(), out("FAIL", F.array_join("chains", ", "))).otherwise(
                out("PASS", "no chain is complete")
            )
        if it.kind == "exposure":
            n = F.coalesce("likely", F.lit(0))
            return F.when(n > 0, out("FAIL", F.concat(n.cast("string"), F.lit(" rated LIKELY")))).otherwise(
                out("PASS", "none rated LIKELY")
            )
        return out("ASSESS", it.note)

    expanded = F.array(*[
        F.struct(
            F.lit(it.section).alias("section"), F.lit(no).alias("item_no"), F.lit(it.name).alias("item"),
            verdict(it).alias("v"),
        )
        for no, it in enumerate(items)
    ])
    return rows.select("repo", F.inline(expanded)).select(
        "repo", "section", "item_no", "item", F.col("v.status").alias("status"), F.col("v.detail").alias("detail")
    )


def status_rank(status: Column) -> Column:
    return S.lookup({s: i for i, s in enumerate(REF.STATUS_ORDER)}, status)


def section_worst(items: DataFrame) -> DataFrame:
    return items.groupBy("repo", "section").agg(F.max_by("status", status_rank(F.col("status"))).alias("worst"))


def ready(items: DataFrame) -> DataFrame:
    """Per repository: ready when nothing fails, is missing or partial; with a tally."""
    return items.groupBy("repo").agg(
        (~F.bool_or(F.col("status").isin("FAIL", "MISSING", "PARTIAL"))).alias("ready"),
        *[F.count_if(F.col("status") == s).alias("n_" + s.lower().replace("/", "").replace("-", "_")) for s in REF.STATUS_ORDER],
    )


# ---- pathways ---------------------------------------------------------------------

def pathway_assessment(
    findings: DataFrame, controls: DataFrame, skills: DataFrame, repos: DataFrame | None = None
) -> DataFrame:
    """Every pathway for every repository: native findings, hosted skills, manual controls.

    ``controls(pathway, kind, ref)`` has kinds native, hosted and assess. ``repos(repo)`` adds
    repositories that have no findings. A repository without hits on a pathway has zeros.
    """
    counts = findings.groupBy("repo", F.col("invariant_id").alias("ref")).agg(F.count("*").alias("n"))
    native = controls.filter(F.col("kind") == "native").join(counts, "ref").groupBy("repo", "pathway").agg(
        F.sum("n").alias("native_findings"), F.countDistinct("ref").alias("rules_hit")
    )
    per_sub = skills.groupBy(F.col("subdomain").alias("ref")).agg(F.count("*").alias("skills"))
    static = (
        controls.join(per_sub.withColumn("kind", F.lit("hosted")), ["ref", "kind"], "left")
        .groupBy("pathway")
        .agg(
            F.count_if(F.col("kind") == "native").alias("native_rules"),
            F.count_if(F.col("kind") == "hosted").alias("hosted_subdomains"),
            F.count_if(F.col("skills").isNotNull()).alias("hosted_installed"),
            F.count_if(F.col("kind") == "assess").alias("manual_controls"),
        )
    )
    # The control list is short; each repository row carries it and spreads out on its own.
    listed = static.agg(F.collect_list(F.struct(*static.columns)).alias("p")).scalar()
    known = findings.select("repo") if repos is None else findings.select("repo").unionByName(repos.select("repo"))
    every = known.distinct().select("repo", F.inline(listed))
    named = native.select(F.col("repo").alias("_repo"), F.col("pathway").alias("_pathway"), "native_findings", "rules_hit")
    rows = every.join(named, F.col("repo").eqNullSafe(F.col("_repo")) & (F.col("pathway") == F.col("_pathway")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return rows.select("repo", "pathway", zero("native_findings"), zero("rules_hit"), *[c for c in static.columns if c != "pathway"])


# ---- repository signals and threat model -------------------------------------------

def _any_of(text: Column, needles: Sequence[str]) -> Column:
    if not needles:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n.lower())) for n in needles])


def repo_signals(files: DataFrame, signals: Sequence[REF.Signal] = REF.SIGNALS, shown_paths: int = 3) -> DataFrame:
    """Per repository and signal: present, wired in CI, the first ``shown_paths`` paths and ``n_paths``, how many there are.

    CI and manifest words are folded to one flag row per repository with
    map-side combining; shown paths are limited per group before
    they are shuffled.
    """
    low, body = F.lower("path"), F.lower("source")
    in_ci, in_manifest = F.col("path").rlike(REF.CI_FILES), F.col("path").rlike(REF.MANIFEST_FILES)
    flag = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    folded = files.groupBy("repo").agg(
        flag(in_ci & _any_of(body, REF.SUITE_RUNNERS)).alias("suite"),
        flag(in_manifest & _any_of(body, REF.CLI_MANIFEST) | F.col("path").rlike(REF.CLI_TESTS)).alias("cli"),
        *[flag(in_ci & _any_of(body, s.ci)).alias(f"ci_{i}") for i, s in enumerate(signals)],
        *[flag(in_manifest & _any_of(body, s.manifest)).alias(f"mw_{i}") for i, s in enumerate(signals) if s.manifest],
        *[flag(in_manifest & _any_of(body, s.manifest_is_evidence[0])).alias(f"me_{i}") for i, s in enumerate(signals) if s.manifest_is_evidence[0]],
        *[flag((low.rlike(s.text_path) if s.text_path else F.lit(True)) & _any_of(body, s.text)).alias(f"tx_{i}") for i, s in enumerate(signals) if s.text],
        flag(low.rlike(next(s.path for s in signals if s.name == "migrations"))).alias("has_migrations"),
    )
    shown = F.array_compact(
        F.array(
            *[F.when(low.rlike(s.path), F.lit(i)) for i, s in enumerate(signals)],
            F.when(low.rlike(REF.CLI_TESTS), F.lit(-1)),
        )
    )
    hits = files.select("repo", "path", F.explode(shown).alias("i"))
    top = hits.withColumn(
        "rn", F.row_number().over(Window.partitionBy("repo", "i").orderBy("path"))
    ).filter(F.col("rn") <= shown_paths)
    paths = top.groupBy("repo").agg(
        F.map_from_entries(F.collect_list(F.struct(F.struct("i", "rn"), "path"))).alias("paths")
    )
    counts = hits.groupBy("repo", "i").agg(F.count(F.lit(1)).alias("n")).groupBy("repo").agg(
        F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("counts")
    )
    rows = folded.join(paths, "repo", "left").join(counts, "repo", "left")

    def evidence(i: int) -> Column:
        p = lambda n: F.col("paths")[F.struct(F.lit(i).alias("i"), F.lit(n).alias("rn"))]
        return F.array_compact(F.array(*[p(n) for n in range(1, shown_paths + 1)]))

    none = F.array().cast("array<string>")
    out = []
    for i, s in enumerate(signals):
        ev = F.coalesce(evidence(i), none)
        if s.cli:
            ev = F.when((F.size(ev) == 0) & F.col("cli"), F.coalesce(evidence(-1), none)).otherwise(ev)
        if s.text:
            ev = F.when((F.size(ev) == 0) & F.col(f"tx_{i}"), F.array(F.lit(s.text_note))).otherwise(ev)
        if s.manifest_is_evidence[0]:
            ok = F.col(f"me_{i}")
            if s.name == "migration-rollback":
                ok = ok & F.col("has_migrations")
            ev = F.when((F.size(ev) == 0) & ok, F.array(F.lit(s.manifest_is_evidence[1]))).otherwise(ev)
        if s.ci_is_evidence:
            ev = F.when((F.size(ev) == 0) & F.col(f"ci_{i}"), F.array(F.lit(s.ci_is_evidence))).otherwise(ev)
        wired = F.col(f"ci_{i}")
        if s.manifest:
            wired = wired | F.col(f"mw_{i}")
        if s.suite:
            wired = wired | ((F.size(ev) > 0) & F.col("suite"))
        out.append(
            F.struct(
                F.lit(s.name).alias("signal"), (F.size(ev) > 0).alias("present"),
                wired.alias("wired"), ev.alias("evidence"),
                F.coalesce(F.col("counts")[F.lit(i)], F.lit(0).cast("long")).alias("n_paths"),
            )
        )
    return rows.select("repo", F.inline(F.array(*out)))


def entry_points(files: DataFrame, routes: Sequence[str] = REF.THREAT_ROUTE) -> DataFrame:
    any_route = "|".join(f"(?:{r})" for r in routes)
    lines = corpus.explode_lines(files.filter(F.col("source").rlike(any_route)))
    # The leftmost match decides, whichever shape it has.
    captured = F.coalesce(*[
        F.nullif(F.regexp_extract("text", any_route, g + 1), F.lit("")) for g in range(len(routes))
    ])
    return lines.select("repo", "path", "line", captured.alias("route")).filter(F.col("route").isNotNull())


def threat_tokens(files: DataFrame, tokens: dict[str, str] = REF.THREAT_TOKENS) -> DataFrame:
    """Distinct stores, outbound calls and secret sources, each at first sight."""
    lines = corpus.explode_lines(
        files.filter(reduce(lambda a, b: a | b, [TX.search(F.col("source"), p) for p in tokens.values()]))
    )
    found = lines.select(
        "repo", "path", "line",
        F.explode(
            F.filter(
                F.array(*[
                    F.struct(F.lit(k).alias("kind"), F.regexp_extract("text", p, 0).alias("token"))
                    for k, p in tokens.items()
                ]),
                lambda t: t["token"] != "",
            )
        ).alias("t"),
    )
    return found.groupBy("repo", "t.kind", F.lower("t.token").alias("key")).agg(
        F.min(F.struct("path", "line", "t.token")).alias("first")
    ).select("repo", "kind", F.col("first.token").alias("token"), F.col("first.path").alias("path"), F.col("first.line").alias("line"))


def threat_model(files: DataFrame, flags: dict[str, str] = REF.THREAT_FLAGS, tokens: dict[str, str] = REF.THREAT_TOKENS, routes: Sequence[str] = REF.THREAT_ROUTE) -> DataFrame:
    """STRIDE rows per repository, from routes, stores and five presence flags."""
    present = files.groupBy("repo").agg(*[F.bool_or(TX.search(F.col("source"), p)).alias(k) for k, p in flags.items()])
    eps = entry_points(files, routes).groupBy("repo").agg(F.count("*").alias("n_routes"))
    toks = threat_tokens(files, tokens).groupBy("repo").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("data_store", "outbound", "secret_source")]
    )
    base = present.join(eps, "repo", "left").join(toks, "repo", "left").na.fill(
        0, ["n_routes", "n_data_store", "n_outbound", "n_secret_source"]
    )
    exposed = (F.col("n_routes") > 0) | (F.col("n_data_store") > 0)
    subject = F.when(F.col("n_routes") == 0, "the service").otherwise(
        F.concat(F.col("n_routes").cast("string"), F.lit(" entry point(s)"))
    )

    def row(cond, category, subj, covered) -> Column:
        return F.when(
            cond, F.struct(F.lit(category).alias("category"), subj.alias("subject"), covered.alias("covered"))
        )

    inventory = F.concat(
        F.col("n_secret_source").cast("string"), F.lit(" secret source(s), "),
        F.col("n_data_store").cast("string"), F.lit(" data store(s)"),
    )
    outbound = F.concat(F.col("n_outbound").cast("string"), F.lit(" outbound call site(s)"))
    unknown = F.lit(None).cast("boolean")
    return base.select(
        "repo",
        F.inline(
            F.array_compact(
                F.array(
                    row(exposed, "Spoofing", subject, F.col("has_auth")),
                    row(exposed, "Tampering", subject, F.col("has_validation")),
                    row(exposed, "Repudiation", subject, F.col("has_logging")),
                    row(exposed, "Information disclosure", inventory, unknown),
                    row(exposed, "Denial of service", subject, F.col("has_rate_limit")),
                    row(exposed, "Elevation of privilege", subject, F.col("has_authz")),
                    row(F.col("n_outbound") > 0, "Trust boundary", outbound, unknown),
                )
            )
        ),
    )
