"""Rating, acceptances, chains, checklist, pathways, signals, threat model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..dims import reference as REF
from ..functions import scoring as S
from ..operators import corpus as C, findings as FD, risk as RK
from . import base as B
from .base import q, query, ql, with_ctes
from .q_findings import RANK, _TAX, fsql

EXPO = "expo AS (SELECT * FROM (VALUES " + ", ".join(
    f"({q(r)}, {q(v)}, {q(p)}, {q(i)})" for r, (v, p, i) in REF.EXPOSURE.items()
) + ") t(invariant_id, vector, prereq, interaction))"
SCORE = """rated AS (SELECT f.*, e.vector, e.prereq, e.interaction,
  CASE vector WHEN 'network' THEN 3 WHEN 'adjacent' THEN 2 WHEN 'local' THEN 1 END - CASE prereq WHEN 'none' THEN 0 WHEN 'privileged' THEN 2 ELSE 1 END
  - CASE interaction WHEN 'required' THEN 1 ELSE 0 END + CASE evidence WHEN 'proven' THEN 1 ELSE 0 END AS score
  FROM findings f LEFT JOIN expo e USING (invariant_id)),
labelled AS (SELECT *, CASE WHEN score >= 3 THEN 3 WHEN score = 2 THEN 2 WHEN score = 1 THEN 1 WHEN score IS NOT NULL THEN 0 END AS xr FROM rated)"""
LABEL = "CASE xr WHEN 3 THEN 'LIKELY' WHEN 2 THEN 'POSSIBLE' WHEN 1 THEN 'UNLIKELY' WHEN 0 THEN 'THEORETICAL' END"


@query("j1_with_taxonomy", fsql("SELECT ord, invariant_id, cwe[1] AS primary_cwe, len(attack) AS n_attack FROM findings LEFT JOIN tax USING (invariant_id)", _TAX))
def j1(spark, sf):
    t = RK.with_taxonomy(B.findings(spark, sf), RK.taxonomy_table(spark))
    return t.select("ord", "invariant_id", F.get("cwe", F.lit(0)).alias("primary_cwe"), F.when(F.col("attack").isNotNull(), F.size("attack")).cast("long").alias("n_attack"))


@query("j2_with_exposure", fsql("SELECT ord, vector, prereq, interaction FROM findings LEFT JOIN expo USING (invariant_id)", EXPO))
def j2(spark, sf):
    return RK.with_exposure(B.findings(spark, sf), RK.exposure_table(spark)).select("ord", "vector", "prereq", "interaction")


@query("f13_exploitability", fsql(f"SELECT ord, CAST(score AS INT) AS score, {LABEL} AS exploitability, CASE WHEN vector IS NOT NULL THEN 2 + (interaction = 'required')::INT + (evidence = 'proven')::INT END AS n_reasons FROM labelled", EXPO, SCORE))
def f13(spark, sf):
    r = RK.rate(B.findings(spark, sf), RK.exposure_table(spark))
    return r.select("ord", "score", "exploitability", F.when(F.col("reasons").isNotNull(), F.size("reasons")).alias("n_reasons"))


@query("f15_taxonomy_tags", fsql("SELECT ord, array_to_string(list_concat(coalesce(cwe, []), coalesce(attack, [])), ',') AS tags FROM findings LEFT JOIN tax USING (invariant_id)", _TAX))
def f15(spark, sf):
    t = RK.with_taxonomy(B.findings(spark, sf), RK.taxonomy_table(spark))
    return t.select("ord", F.array_join(RK.taxonomy_tags(F.col("cwe"), F.col("attack")), ",").alias("tags"))


@query("p7_min_exploitability", fsql("SELECT ord FROM labelled WHERE xr >= 2", EXPO, SCORE))
def p7(spark, sf):
    return FD.min_exploitability(RK.rate(B.findings(spark, sf), RK.exposure_table(spark)), "POSSIBLE").select("ord")


@query("w3_rank_exposure", fsql(f"SELECT ord, {LABEL} AS exploitability, severity FROM labelled ORDER BY xr DESC NULLS LAST, {RANK} DESC, ord LIMIT 100", EXPO, SCORE))
def w3(spark, sf):
    return FD.rank_exposure(RK.rate(B.findings(spark, sf), RK.exposure_table(spark)), 100).select("ord", "exploitability", "severity")


# The rules a scan saw decide which rows of the taxonomy are counted.
@query("a8_taxonomy_matrix", fsql("""
, t AS (SELECT DISTINCT invariant_id, CASE string_split(invariant_id, '_')[1] WHEN 'gen' THEN 'general' WHEN 'sca' THEN 'supply-chain' WHEN 'rt' THEN 'runtime' ELSE 'agnostic' END AS chain,
   unnest(list_concat(cwe, attack)) AS tag FROM findings JOIN tax USING (invariant_id))
SELECT tag, chain, count(DISTINCT invariant_id) AS rules FROM t GROUP BY GROUPING SETS ((tag, chain), (tag))""", _TAX))
def a8(spark, sf):
    seen = B.findings(spark, sf).select("invariant_id").distinct()
    return RK.taxonomy_matrix(RK.taxonomy_table(spark).join(seen, "invariant_id", "left_semi"))


@query("a9_rules_for_weakness", fsql("SELECT f.ord, f.invariant_id FROM findings f JOIN tax USING (invariant_id) WHERE len(list_filter(list_concat(cwe, attack), lambda t: upper(t) = 'T1190')) > 0", _TAX))
def a9(spark, sf):
    rules = RK.rules_for_weakness(RK.taxonomy_table(spark), "t1190")
    return B.findings(spark, sf).join(rules.select("invariant_id"), "invariant_id", "left_semi").select("ord", "invariant_id")


# ---- acceptances ---------------------------------------------------------------------

# Acceptances come from customers: one per customer, over the rules of the findings.
ACC = f"""acc AS (SELECT c_custkey AS pos, list_extract({ql(B.RULES)}, CAST(c_custkey % 15 AS INT) + 1) AS id, CASE WHEN c_custkey % 3 > 0 THEN './f' || (c_custkey % 40) END AS path,
  CASE WHEN c_custkey % 4 = 0 THEN '"k": ' || (c_custkey % 10) END AS txt, 'accepted for this release' AS reason, c_name AS owner, CASE WHEN c_custkey % 5 = 0 THEN '2024-01-14' ELSE '2024-01-15' END AS until FROM customer)"""


def acceptances(spark, sf):
    c, k = B.table(spark, sf, "customer"), F.col("c_custkey")
    return c.select(
        k.alias("pos"), F.get(F.array(*[F.lit(r) for r in B.RULES]), (k % 15).cast("int")).alias("id"),
        F.when(k % 3 > 0, F.concat(F.lit("./f"), (k % 40).cast("string"))).alias("path"),
        F.when(k % 4 == 0, F.concat(F.lit('"k": '), (k % 10).cast("string"))).alias("match"),
        F.lit("accepted for this release").alias("reason"), F.col("c_name").alias("owner"),
        F.when(k % 5 == 0, "2024-01-14").otherwise("2024-01-15").alias("until"))


_COVERS = "(a.path IS NULL OR starts_with(f.file, ltrim(a.path, './')) OR contains(f.file, a.path)) AND (a.txt IS NULL OR contains(f.message, a.txt) OR contains(f.snippet, a.txt))"


@query("j4_accept", fsql(f"""
, h AS (SELECT f.ord, min(a.pos) AS pos FROM findings f JOIN acc a ON a.id = f.invariant_id AND {_COVERS} WHERE CAST(a.until AS DATE) >= DATE '2024-01-15' GROUP BY f.ord)
SELECT f.ord, CASE WHEN h.pos IS NULL THEN 'open' ELSE 'accepted' END AS state, a.owner AS accepted_by, a.until AS accepted_until
FROM findings f LEFT JOIN h USING (ord) LEFT JOIN acc a ON a.pos = h.pos""", ACC))
def j4(spark, sf):
    return RK.accept(B.findings(spark, sf), acceptances(spark, sf), "2024-01-15").select("ord", "state", "accepted_by", "accepted_until")


@query("j4_expired_acceptances", with_ctes(ACC, body="SELECT pos, id, until FROM acc WHERE CAST(until AS DATE) < DATE '2024-01-15'"))
def j4x(spark, sf):
    return RK.expired_acceptances(acceptances(spark, sf), "2024-01-15").select("pos", "id", "until")


@query("j4b_validate_acceptances", with_ctes(ACC, body="""
, b AS (SELECT pos, CASE WHEN pos % 7 = 0 THEN ' short ' ELSE reason END AS reason, CASE WHEN pos % 11 = 0 THEN '2024-13-01' WHEN pos % 13 = 0 THEN 'soon' ELSE until END AS until, CASE WHEN pos % 17 = 0 THEN ' ' ELSE owner END AS owner FROM acc)
SELECT pos, CASE WHEN length(trim(reason)) < 15 THEN 'reason too short' WHEN NOT regexp_matches(until, '^\\d{4}-(0?[1-9]|1[0-2])-(0?[1-9]|[12]\\d|3[01])$') THEN 'bad date' WHEN trim(owner) = '' THEN 'owner missing' END AS problem
FROM b WHERE problem IS NOT NULL"""))
def j4b(spark, sf):
    k = F.col("pos")
    a = acceptances(spark, sf).withColumns({
        "reason": F.when(k % 7 == 0, " short ").otherwise(F.col("reason")),
        "until": F.when(k % 11 == 0, "2024-13-01").when(k % 13 == 0, "soon").otherwise(F.col("until")),
        "owner": F.when(k % 17 == 0, " ").otherwise(F.col("owner"))})
    return RK.validate_acceptances(a).select("pos", "problem")


# ---- chains and checklist -----------------------------------------------------------

STEPS = "steps AS (SELECT * FROM (VALUES " + ", ".join(
    f"({q(c)}, {no}, {len(st)}, {q(r)})" for c, st in REF.CHAINS for no, rs in enumerate(st) for r in rs
) + ") t(chain_id, step_no, n_steps, invariant_id))"
# Repositories split by day so that some lack a step.
DAILY = "daily AS (SELECT * REPLACE (repo || strftime(ts, '-%d-%H') AS repo) FROM findings)"


def daily(spark, sf):
    return B.findings(spark, sf).withColumn("repo", F.concat("repo", F.date_format("ts", "-dd-HH")))


CHAINS = """pres AS (SELECT repo, invariant_id, count(*) AS n, max(xr) AS worst FROM labelled GROUP BY ALL),
chains AS (SELECT repo, chain_id, max(n_steps) AS n_steps, CAST(sum(n) AS BIGINT) AS findings, max(worst) AS xr FROM pres JOIN steps USING (invariant_id) GROUP BY ALL HAVING count(DISTINCT step_no) = max(n_steps))"""


@query("j5_attack_chains", fsql(f"SELECT repo, chain_id, n_steps, findings, {LABEL} AS exploitability FROM chains", DAILY, EXPO, SCORE.replace("FROM findings f", "FROM daily f"), STEPS, CHAINS))
def j5(spark, sf):
    return RK.attack_chains(daily(spark, sf), RK.chain_steps(spark), RK.exposure_table(spark)).drop("satisfied_by")


_SIGN = "signals_by_repo AS (SELECT repo, 'unit-tests' AS s, count(*) FILTER (WHERE line % 2 = 0) > 0 AS present, count(*) FILTER (WHERE line % 3 = 0) > 0 AS wired FROM daily GROUP BY repo)"


def _item_sql(no: int, it: REF.Item) -> str:
    ids = ql(it.ids) if it.ids else "CAST([] AS VARCHAR[])"
    app = "true" if it.scope == "any" else {"web": "s.web", "deps": "s.deps"}[it.scope]
    hits = lambda t: f"(SELECT count(*) FROM {t} c WHERE c.repo = s.repo AND list_contains({ids}, c.invariant_id))"
    if it.kind == "detectors":
        st = f"CASE WHEN NOT {app} THEN 'N/A' WHEN {hits('cnt')} > 0 THEN 'FAIL' WHEN {hits('acn')} > 0 THEN 'ACCEPTED' ELSE 'PASS' END"
    elif it.kind == "probe":
        st = f"CASE WHEN {hits('cnt')} > 0 THEN 'FAIL' ELSE 'PASS' END"
    elif it.kind == "signal":
        st = f"coalesce((SELECT CASE WHEN g.present AND g.wired THEN 'PASS' WHEN g.present THEN 'PARTIAL' ELSE 'MISSING' END FROM signals_by_repo g WHERE g.repo = s.repo AND g.s = {q(it.ids[0])}), 'MISSING')"
    elif it.kind == "chains":
        st = "CASE WHEN EXISTS (SELECT 1 FROM chains c WHERE c.repo = s.repo) THEN 'FAIL' ELSE 'PASS' END"
    elif it.kind == "exposure":
        st = "CASE WHEN EXISTS (SELECT 1 FROM labelled l WHERE l.repo = s.repo AND l.xr = 3) THEN 'FAIL' ELSE 'PASS' END"
    else:
        st = "'ASSESS'"
    return f"SELECT s.repo, {it.section} AS section, {no} AS item_no, {q(it.name)} AS item, {st} AS status FROM scopes s"


CHECK = ["scopes AS (SELECT repo, count(*) FILTER (WHERE ord % 2 = 0) > 1 AS web, count(*) FILTER (WHERE ord % 5 = 0) > 0 AS deps FROM daily GROUP BY repo)",
         "cnt AS (SELECT repo, invariant_id, count(*) AS n FROM daily WHERE severity <> 'Info' AND ord % 3 > 0 GROUP BY ALL)",
         "acn AS (SELECT repo, invariant_id, count(*) AS n FROM daily WHERE ord % 3 = 0 GROUP BY ALL)", _SIGN]
ITEMS = "items AS MATERIALIZED (" + "\nUNION ALL ".join(_item_sql(no, it) for no, it in enumerate(REF.CHECKLIST)) + ")"
ALL_CHECK = (DAILY, EXPO, SCORE.replace("FROM findings f", "FROM daily f"), STEPS, CHAINS, *CHECK, ITEMS)


def _items(spark, sf):
    d = daily(spark, sf)
    repos = d.groupBy("repo").agg(
        (F.count_if(F.col("ord") % 2 == 0) > 1).alias("web"), (F.count_if(F.col("ord") % 5 == 0) > 0).alias("deps"))
    signals = d.groupBy("repo").agg(
        (F.count_if(F.col("line") % 2 == 0) > 0).alias("present"), (F.count_if(F.col("line") % 3 == 0) > 0).alias("wired"),
    ).select("repo", F.lit("unit-tests").alias("signal"), "present", "wired", F.array(F.lit("tests/a.py")).alias("evidence"))
    expo = RK.exposure_table(spark)
    chains = RK.attack_chains(d, RK.chain_steps(spark), expo)
    likely = RK.rate(d, expo).groupBy("repo").agg(F.count_if(F.col("exploitability") == "LIKELY").alias("likely"))
    return RK.checklist(
        repos, FD.rule_counts(d.filter(F.col("ord") % 3 > 0)), FD.rule_counts(d.filter(F.col("ord") % 3 == 0), False),
        signals, chains, likely, probe_loaded=True)


@query("a6_checklist", fsql("SELECT repo, section, item_no, item, status FROM items", *ALL_CHECK))
def a6(spark, sf):
    return _items(spark, sf).drop("detail")


_SR = "list_position(" + ql(REF.STATUS_ORDER) + ", status)"


@query("a7_section_worst", fsql(f"SELECT repo, section, arg_max(status, {_SR}) AS worst FROM items GROUP BY ALL", *ALL_CHECK))
def a7(spark, sf):
    return RK.section_worst(_items(spark, sf))


@query("a7_ready", fsql("SELECT repo, NOT bool_or(status IN ('FAIL', 'MISSING', 'PARTIAL')) AS ready, " + ", ".join(
    f"count(*) FILTER (WHERE status = {q(s)}) AS n_{s.lower().replace('/', '').replace('-', '_')}" for s in REF.STATUS_ORDER) + " FROM items GROUP BY repo", *ALL_CHECK))
def a7b(spark, sf):
    return RK.ready(_items(spark, sf))


# ---- pathways, exploits, coverage, advice -----------------------------------------------

# A few pathways with native, hosted and manual controls.
CONTROLS = (
    ("api-security", "native", "gen_web_ssrf"), ("api-security", "native", "gen_sql_injection"), ("api-security", "native", "gen_hardcoded_secret"),
    ("api-security", "hosted", "en"), ("api-security", "assess", "each caller has a quota"),
    ("container-security", "native", "gen_docker_root_user"), ("container-security", "native", "gen_container_privileged"),
    ("container-security", "hosted", "fr"), ("container-security", "assess", "Images are scanned before admission"),
    ("data-security", "native", "gen_tls_verification_disabled"), ("data-security", "hosted", "xx"), ("data-security", "assess", "Data is classified"),
    ("data-security", "assess", "Field-level encryption covers regulated fields"),
)
_CTL = "ctl AS (SELECT * FROM (VALUES " + ", ".join(f"({q(a)}, {q(b)}, {q(c)})" for a, b, c in CONTROLS) + ") t(pathway, kind, ref))"


@query("j9_pathway_assessment", fsql("""
, n AS (SELECT repo, pathway, CAST(count(*) AS BIGINT) AS native_findings, count(DISTINCT ref) AS rules_hit FROM findings JOIN ctl ON ref = invariant_id AND kind = 'native' GROUP BY ALL),
s AS (SELECT pathway, count(*) FILTER (WHERE kind = 'native') AS native_rules, count(*) FILTER (WHERE kind = 'hosted') AS hosted_subdomains,
  count(*) FILTER (WHERE kind = 'hosted' AND ref IN (SELECT lang FROM documents)) AS hosted_installed, count(*) FILTER (WHERE kind = 'assess') AS manual_controls FROM ctl GROUP BY pathway)
SELECT repo, pathway, coalesce(native_findings, 0) AS native_findings, coalesce(rules_hit, 0) AS rules_hit, native_rules, hosted_subdomains, hosted_installed, manual_controls
FROM (SELECT DISTINCT repo FROM findings) CROSS JOIN s LEFT JOIN n USING (repo, pathway)""", _CTL))
def j9(spark, sf):
    ctl = spark.createDataFrame(CONTROLS, "pathway string, kind string, ref string")
    skills = B.table(spark, sf, "documents").select(F.col("lang").alias("subdomain"))
    return RK.pathway_assessment(B.findings(spark, sf), ctl, skills)


REG = f"""reg AS (SELECT 'x' || o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'evm' WHEN 'F' THEN 'solana' ELSE 'move' END AS chain, CAST(o_orderdate AS DATE) AS date,
  CAST(floor(o_totalprice) AS BIGINT) AS loss_usd, [list_extract({ql(B.RULES)}, CAST(o_custkey % 15 AS INT) + 1), list_extract({ql(B.RULES)}, CAST(o_orderkey % 7 AS INT) + 1)] AS invariant_ids FROM orders)"""


def registry(spark, sf):
    o, rules = B.table(spark, sf, "orders"), F.array(*[F.lit(r) for r in B.RULES])
    return o.select(
        F.concat(F.lit("x"), F.col("o_orderkey").cast("string")).alias("id"),
        F.when(F.col("o_orderstatus") == "P", "evm").when(F.col("o_orderstatus") == "F", "solana").otherwise("move").alias("chain"),
        F.col("o_orderdate").cast("date").alias("date"), F.floor("o_totalprice").cast("long").alias("loss_usd"),
        F.array(F.get(rules, (F.col("o_custkey") % 15).cast("int")), F.get(rules, (F.col("o_orderkey") % 7).cast("int"))).alias("invariant_ids"))


@query("j10_exploits_for_rule", with_ctes(REG, B.FINDINGS, body="SELECT id, invariant_id, loss_usd FROM (SELECT id, loss_usd, unnest(invariant_ids) AS invariant_id FROM reg) WHERE invariant_id IN (SELECT invariant_id FROM findings)"))
def j10(spark, sf):
    rules = B.findings(spark, sf).select("invariant_id").distinct()
    return RK.exploits_for_rule(registry(spark, sf), rules).select("id", "invariant_id", "loss_usd")


@query("a13_total_loss", with_ctes(REG, body="SELECT chain, CAST(year(date) AS INT) AS year, CAST(sum(loss_usd) AS BIGINT) AS loss_usd, count(*) AS exploits FROM reg GROUP BY ALL"))
def a13(spark, sf):
    return RK.total_loss(registry(spark, sf).withColumn("year", F.year("date")), ["chain", "year"])


@query("j14_rule_coverage", """
SELECT 'lib' || p_partkey AS library_id, CASE WHEN p_size % 4 > 0 THEN p_type END AS detector, CASE WHEN p_size % 4 = 0 THEN 'ordering property' END AS reason,
  CASE WHEN p_size % 4 = 0 THEN 'advisory' WHEN p_type IN ('ECONOMY', 'SMALL', 'PROMO') THEN 'implemented' ELSE 'missing' END AS status FROM part""")
def j14(spark, sf):
    p = B.table(spark, sf, "part")
    lib = p.select(F.concat(F.lit("lib"), F.col("p_partkey").cast("string")).alias("library_id"),
                   F.when(F.col("p_size") % 4 > 0, F.col("p_type")).alias("detector"), F.when(F.col("p_size") % 4 == 0, "ordering property").alias("reason"))
    rules = p.select(F.col("p_type").alias("invariant_id")).distinct().filter(F.col("invariant_id").isin("ECONOMY", "SMALL", "PROMO"))
    return RK.rule_coverage(lib, rules)


@query("j15_advice_for", fsql("""SELECT ord, CASE WHEN invariant_id LIKE '%injection%' THEN 'injection' WHEN invariant_id LIKE 'gen_iac%' THEN 'exposure' END AS vuln_type,
  CASE WHEN invariant_id LIKE '%injection%' THEN 'parameterise;validate' ELSE '' END AS advice FROM findings"""))
def j15(spark, sf):
    f = B.findings(spark, sf)
    seen = f.select("invariant_id").distinct()
    types = seen.select(
        F.col("invariant_id").alias("detector"),
        F.when(F.contains("invariant_id", F.lit("injection")), "injection").when(F.col("invariant_id").startswith("gen_iac"), "exposure").alias("vuln_type")).filter("vuln_type is not null")
    advice = spark.createDataFrame([("injection", ["parameterise", "validate"])], "vuln_type string, recommendations array<string>")
    return RK.advice_for(f, types, advice).select("ord", "vuln_type", F.array_join("recommendations", ";").alias("advice"))


# ---- signals and threat model -------------------------------------------------------------

# Signals over the prose files: any word can be a path or CI marker of a signal.
SIGS = (
    REF.Signal("migrations", r"/d[0-9]*5\.", ("und ",)),
    REF.Signal("py", r"\.py$", ("the ",), suite=True), REF.Signal("terraform", r"\.tf$", (), ci_is_evidence="in CI"),
    REF.Signal("manifest", r"nothing-here", ("zzz",), manifest=("la ",), manifest_is_evidence=(("que",), "named in a manifest")),
    REF.Signal("prose", r"no-such-path", (), text=("ention",), text_path=r"\.md$", text_note="found in text"),
)
_SIGFILES = """sfiles AS (SELECT repo, CASE WHEN path LIKE '%.yml' THEN '.github/workflows/' || replace(path, '/', '-') WHEN path LIKE '%.toml' THEN replace(path, '.toml', '/Cargo.toml') ELSE path END AS path,
  CASE WHEN path LIKE '%.yml' AND length(source) % 2 = 0 THEN source || ' pytest' ELSE source END AS source FROM files)"""


def _signal_files(spark, sf):
    f = B.files(spark, sf)
    yml = F.col("path").endswith(".yml")
    return f.select(
        "repo", F.when(yml, F.concat(F.lit(".github/workflows/"), F.replace("path", F.lit("/"), F.lit("-"))))
        .when(F.col("path").endswith(".toml"), F.replace("path", F.lit(".toml"), F.lit("/Cargo.toml"))).otherwise(F.col("path")).alias("path"),
        F.when(yml & (F.length("source") % 2 == 0), F.concat("source", F.lit(" pytest"))).otherwise(F.col("source")).alias("source"))


def _sig_sql(s: REF.Signal) -> str:
    has = lambda ns: "(" + (" OR ".join(f"contains(lower(source), {q(n.lower())})" for n in ns) or "false") + ")"
    ci, mf = f"regexp_matches(path, {q(REF.CI_FILES)})", f"regexp_matches(path, {q(REF.MANIFEST_FILES)})"
    ev = f"list_slice(list_sort(list(path) FILTER (WHERE regexp_matches(lower(path), {q(s.path)}))), 1, 3)"
    empty = f"len(coalesce({ev}, [])) = 0"
    alt = f"coalesce({ev}, [])"
    at = f"regexp_matches(lower(path), {q(s.text_path)})" if s.text_path else "true"
    named = f"bool_or({mf} AND {has(s.manifest_is_evidence[0])})"
    if s.name == "migration-rollback":
        named += f" AND bool_or(regexp_matches(lower(path), {q(next(x.path for x in REF.SIGNALS if x.name == 'migrations'))}))"
    for cond, note in (
        (f"bool_or({ci} AND {has(s.ci)})", s.ci_is_evidence), (named, s.manifest_is_evidence[1]),
        (f"bool_or({at} AND {has(s.text)})" if s.text else "false", s.text_note),
    ):
        if note:
            alt = f"CASE WHEN {empty} AND {cond} THEN [{q(note)}] ELSE {alt} END"
    if s.cli:
        tests = f"coalesce(list_slice(list_sort(list(path) FILTER (WHERE regexp_matches(lower(path), {q(REF.CLI_TESTS)}))), 1, 3), [])"
        cli = f"bool_or(({mf} AND {has(REF.CLI_MANIFEST)}) OR regexp_matches(path, {q(REF.CLI_TESTS)}))"
        alt = f"CASE WHEN {empty} AND {cli} AND len({tests}) > 0 THEN {tests} ELSE {alt} END"
    wired = f"bool_or({ci} AND {has(s.ci)})"
    if s.manifest:
        wired += f" OR bool_or({mf} AND {has(s.manifest)})"
    if s.suite:
        wired += f" OR (len({alt}) > 0 AND bool_or({ci} AND {has(REF.SUITE_RUNNERS)}))"
    return f"SELECT repo, {q(s.name)} AS signal, len({alt}) > 0 AS present, {wired} AS wired, array_to_string({alt}, ';') AS evidence, count(*) FILTER (WHERE regexp_matches(lower(path), {q(s.path)})) AS n_paths FROM sfiles GROUP BY repo"


@query("r21_repo_signals", with_ctes(B.FILES, _SIGFILES, body="\nUNION ALL\n".join(_sig_sql(s) for s in SIGS)))
def r21(spark, sf):
    s = RK.repo_signals(_signal_files(spark, sf), SIGS)
    return s.withColumn("evidence", F.array_join("evidence", ";"))


@query("r21_repo_signals_full", with_ctes(B.FILES, _SIGFILES, body="\nUNION ALL\n".join(_sig_sql(s) for s in REF.SIGNALS)))
def r21f(spark, sf):
    return RK.repo_signals(_signal_files(spark, sf)).withColumn("evidence", F.array_join("evidence", ";"))


_ROUTE_RE = "|".join(f"(?:{r})" for r in REF.THREAT_ROUTE)
_ROUTE = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, {q(_ROUTE_RE)}, {g + 1}), '')" for g in range(5)) + ")"
_TOK = {"data_store": r"(?i) the | der ", "outbound": r"(?i)\brequests\.(get|post)|fetch\(| que ", "secret_source": r"(?i)\btoken\b|\bos\.system"}


@query("r22_entry_points", with_ctes(B.CODE_FILES, B.lines_cte("code_files"), body=f"SELECT repo, path, line, {_ROUTE} AS route FROM lines WHERE {_ROUTE} IS NOT NULL"))
def r22a(spark, sf):
    return RK.entry_points(B.code_files(spark, sf))


_TOKSQL = ", tk AS (" + " UNION ALL ".join(
    f"SELECT repo, {q(k)} AS kind, path, line, regexp_extract(text, {q(p)}, 0) AS token FROM lines WHERE regexp_matches(text, {q(p)})" for k, p in _TOK.items()
) + "), ft AS (SELECT repo, kind, token, path, line FROM tk QUALIFY row_number() OVER (PARTITION BY repo, kind, lower(token) ORDER BY path, line, token) = 1)"


@query("r22_threat_tokens", with_ctes(B.CODE_FILES, B.lines_cte("code_files"), body=_TOKSQL + " SELECT repo, kind, token, path, line FROM ft"))
def r22b(spark, sf):
    return RK.threat_tokens(B.code_files(spark, sf), _TOK)


@query("r22_threat_model", with_ctes(B.CODE_FILES, B.lines_cte("code_files"), body=_TOKSQL + f""",
ep AS (SELECT repo, count(*) AS n FROM lines WHERE {_ROUTE} IS NOT NULL GROUP BY repo),
fl AS (SELECT repo, {", ".join(f"bool_or(regexp_matches(source, {q(p)})) AS {k}" for k, p in REF.THREAT_FLAGS.items())} FROM code_files GROUP BY repo),
tc AS (SELECT repo, count(*) FILTER (WHERE kind = 'data_store') AS nd, count(*) FILTER (WHERE kind = 'outbound') AS no, count(*) FILTER (WHERE kind = 'secret_source') AS ns FROM ft GROUP BY repo),
b AS (SELECT fl.*, coalesce(n, 0) AS n, coalesce(nd, 0) AS nd, coalesce(no, 0) AS no, coalesce(ns, 0) AS ns, CASE WHEN coalesce(n, 0) = 0 THEN 'the service' ELSE n || ' entry point(s)' END AS s FROM fl LEFT JOIN ep USING (repo) LEFT JOIN tc USING (repo))
SELECT repo, 'Spoofing' AS category, s AS subject, has_auth AS covered FROM b WHERE n > 0 OR nd > 0
UNION ALL SELECT repo, 'Tampering', s, has_validation FROM b WHERE n > 0 OR nd > 0
UNION ALL SELECT repo, 'Repudiation', s, has_logging FROM b WHERE n > 0 OR nd > 0
UNION ALL SELECT repo, 'Information disclosure', ns || ' secret source(s), ' || nd || ' data store(s)', NULL FROM b WHERE n > 0 OR nd > 0
UNION ALL SELECT repo, 'Denial of service', s, has_rate_limit FROM b WHERE n > 0 OR nd > 0
UNION ALL SELECT repo, 'Elevation of privilege', s, has_authz FROM b WHERE n > 0 OR nd > 0
UNION ALL SELECT repo, 'Trust boundary', no || ' outbound call site(s)', NULL FROM b WHERE no > 0"""))
def r22(spark, sf):
    return RK.threat_model(B.code_files(spark, sf), tokens=_TOK)
