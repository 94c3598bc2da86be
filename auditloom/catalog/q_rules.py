"""Rule-scan queries: every rule shape over prose files and over code files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..dims import rule_packs as P
from ..operators import corpus as C, findings as FD, flow, rules as R, secrets
from . import base as B
from .base import q, query, with_ctes
from .rule_sql import pack_sql

COLS = ["repo", "file", "line", "invariant_id", "severity", "snippet"]

PACKS = {
    "r1_pack_code": P.CODE_PACK,
    "r1_pack_websec_lines": P.WEBSEC_LINE_PACK,
    "r2_pack_webconfig": P.WEBCONFIG_PACK,
    "r2_pack_iac": P.IAC_PACK,
    "r3_pack_ci": P.CI_FILE_PACK,
    "r3_pack_containers": P.CONTAINER_PACK,
    "r3_pack_websec_files": P.WEBSEC_FILE_PACK,
    "r5_pack_websec_functions": P.WEBSEC_FUNCTION_PACK,
}
for _name, _pack in PACKS.items():
    query(_name, pack_sql(_pack))(
        lambda spark, sf, pack=_pack: R.scan_files(B.code_files(spark, sf), pack).select(*COLS)
    )

# Rules over the prose itself, so every whole text is read and hit.
ALL_KINDS = ("Python", "JavaScript", "Go", "Shell", "ContainerManifest", "Terraform", "Config", "Other")
TEXT_PACK = (
    R.Rule("doc_credential", ALL_KINDS, "High", r'token = "[0-9a-f]{40}"', "credential"),
    R.Rule("doc_email", ALL_KINDS, "Low", r"[a-z0-9._]+@[a-z0-9.]+\.[a-z]+", "e-mail address"),
    R.Rule("doc_ipv4", ALL_KINDS, "Low", r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b", "address", unless=r"token = "),
    R.Rule("doc_licence", ALL_KINDS, "Info", r"(?i)licen[cs]e", "licence", near=(2, 2), near_lacks=r"(?i)copyright"),
    R.Rule("doc_script", ("Other",), "Medium", r"<script", "script", file_has=r"<article", near=(0, 1), near_has=r"</p>"),
)


def _text_sql() -> str:
    return pack_sql(TEXT_PACK).replace(B.CODE_FILES, B.FILES.replace("files AS", "code_files AS", 1))


@query("r1_line_rules", _text_sql())
def r1(spark, sf):
    return R.scan_files(B.files(spark, sf), TEXT_PACK).select(*COLS)


@query("r4_segment_functions", with_ctes(*B.CODE_LINES, body=f"""
, d AS (SELECT repo, path, line FROM cl WHERE regexp_matches(text, {q(R.FUNCTION_LINE)})
  UNION SELECT repo, path, 1 FROM cl),
s AS (SELECT *, row_number() OVER w - 1 AS func_no, lead(line) OVER w AS nxt FROM d WINDOW w AS (PARTITION BY repo, path ORDER BY line)),
n AS (SELECT repo, path, max(line) AS n FROM cl GROUP BY ALL)
SELECT s.repo, s.path, func_no, line AS func_start, CAST(coalesce(nxt, n + 1) - line AS BIGINT) AS body_lines
FROM s JOIN n ON s.repo = n.repo AND s.path = n.path""").replace("\n\n, d AS", ", d AS"))
def r4(spark, sf):
    return R.segment_functions(B.code_files(spark, sf)).select(
        "repo", "path", "func_no", "func_start", F.size("body").cast("long").alias("body_lines")
    )


@query("r6_indented_block_rules", with_ctes(*B.CODE_LINES, body=f"""
, w AS (SELECT repo, path, line, text, regexp_matches(text, {q(P.RUN_BLOCK_OPENER)}) AS opens,
    length(text) - length(ltrim(text)) AS ind, trim(text) <> '' AS solid FROM cl WHERE kind = 'GithubWorkflow'),
o AS (SELECT *, max(CASE WHEN opens THEN line END) OVER (PARTITION BY repo, path ORDER BY line) AS op FROM w),
b AS (SELECT o.*, (SELECT ind FROM w x WHERE x.repo = o.repo AND x.path = o.path AND x.line = o.op) AS op_ind FROM o),
c AS (SELECT *, max(CASE WHEN NOT opens AND solid AND ind <= op_ind THEN 1 ELSE 0 END)
    OVER (PARTITION BY repo, path, op ORDER BY line) AS closed FROM b WHERE op IS NOT NULL)
SELECT repo, path AS file, line, invariant_id, 'High' AS severity, trim(text) AS snippet FROM (
  SELECT *, 'gen_ci_script_injection' AS invariant_id FROM c WHERE closed = 0 AND regexp_matches(text, {q(P.CI_RUN_PACK[0].pattern)})
  UNION ALL SELECT *, 'gen_ci_secret_exposed' FROM c WHERE closed = 0 AND regexp_matches(text, {q(P.CI_RUN_PACK[1].pattern)}))"""))
def r6(spark, sf):
    return R.restrict_to_indented_block(B.code_files(spark, sf), P.RUN_BLOCK_OPENER, P.CI_RUN_PACK).select(*COLS)


def _repo_absence_sql(files: str, present: str, absent: str, rule: str, severity: str) -> str:
    body = f"""
, a AS (SELECT repo, CASE WHEN kind = 'Config' THEN raw ELSE text END AS t, path, line FROM cl
    WHERE kind IN ('Python', 'Shell', 'JavaScript', 'Go', 'Config')),
x AS (SELECT DISTINCT repo FROM a WHERE regexp_matches(t, {q(absent)}))
SELECT repo, path AS file, line, {q(rule)} AS invariant_id, {q(severity)} AS severity, trim(t) AS snippet
FROM a WHERE regexp_matches(t, {q(present)}) AND repo NOT IN (SELECT repo FROM x)
QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path, line) = 1"""
    return with_ctes(files, B.lines_cte("code_files"), B.code_cte(), body=body)


# Repositories split finer, so that some of them lack the excusing pattern.
_SMALL_REPOS = B.CODE_FILES + ", small AS (SELECT repo || '-' || (length(source) % 37) AS repo, path, source FROM code_files)"


def _small(spark, sf):
    return B.code_files(spark, sf).withColumn(
        "repo", F.concat("repo", F.lit("-"), (F.length("source") % 37).cast("string"))
    )


@query("r7_repo_absence_rules", "\n".join([
    _repo_absence_sql(_SMALL_REPOS, P.REPO_RULES[0][0], P.REPO_RULES[0][1], P.REPO_RULES[0][2], "Medium")
]).replace("FROM code_files)))", "FROM small)))").replace(B.split_sql("source") + " AS arr FROM code_files", B.split_sql("source") + " AS arr FROM small"))
def r7(spark, sf):
    return R.repo_absence(_small(spark, sf), P.REPO_RULES[:1]).select(*COLS)


@query("r7_repo_absence_prose", _repo_absence_sql(_SMALL_REPOS, r" the ", r" der ", "prose_absence", "Low").replace(
    B.split_sql("source") + " AS arr FROM code_files", B.split_sql("source") + " AS arr FROM small"))
def r7b(spark, sf):
    return R.repo_absence(_small(spark, sf), [(r" the ", r" der ", "prose_absence", "Low", "x")]).select(*COLS)


@query("r8_grouped_first_use", with_ctes(*B.CODE_LINES, body=f"""
, u AS (SELECT repo, path, line, regexp_extract(text, {q(R.USES_LINE)}, 2) AS owner, regexp_extract(text, {q(R.USES_LINE)}, 3) AS name,
    regexp_extract(text, {q(R.USES_LINE)}, 5) AS ref FROM cl WHERE kind = 'GithubWorkflow' AND regexp_matches(text, {q(R.USES_LINE)}))
SELECT repo, path, owner || '/' || name AS action, min(line) AS line, arg_min(ref, line) AS ref, count(*) AS uses
FROM u WHERE owner NOT IN ('actions', 'github') AND NOT regexp_matches(ref, '^[0-9a-f]{{40}}$') GROUP BY ALL"""))
def r8(spark, sf):
    return R.unpinned_actions(B.code_files(spark, sf))


# The ordered fold has no SQL twin; tests compare it with a plain-Python reading.
@query("r9_taint_flow")
def r9(spark, sf):
    return flow.value_flow(B.code_files(spark, sf)).select(*COLS)


@query("r10_model_output_flow")
def r10(spark, sf):
    return flow.model_output_flow(B.code_files(spark, sf)).select(*COLS)


_S_KNOWN = secrets.KNOWN_PATTERN
_ENTROPY = """(SELECT -sum(n / length(v) * log2(n / length(v))) FROM (SELECT count(*) AS n FROM (SELECT unnest(string_split(v, '')) AS ch) GROUP BY ch))"""
SECRET_ROWS = f"""
s AS (SELECT repo, path, line, text, unnest(regexp_extract_all(text, {q(secrets.ASSIGNMENT)}, 1)) AS v FROM lines),
g AS (SELECT row_number() OVER () AS id, * FROM s WHERE NOT (length(trim(trim(v), '"''')) < 8 OR regexp_matches(lower(trim(trim(v), '"''')), {q(secrets.TX.PLACEHOLDER_PATTERN)}))
   AND NOT regexp_matches(v, {q(_S_KNOWN)})),
e AS (SELECT id, -sum(n / l * log2(n / l)) AS h FROM (SELECT id, l, count(*) AS n FROM (SELECT id, CAST(length(v) AS DOUBLE) AS l, unnest(string_split(v, '')) AS ch FROM g) GROUP BY id, l, ch) GROUP BY id),
secret AS (
  SELECT repo, path, line, text, v, 'gen_hardcoded_secret' AS invariant_id FROM g JOIN e USING (id) WHERE h >= 3.0
  UNION ALL SELECT repo, path, line, text, unnest(regexp_extract_all(text, {q(_S_KNOWN)}, 1)), 'gen_hardcoded_secret' FROM lines
  UNION ALL SELECT repo, path, line, text, unnest(regexp_extract_all(text, {q('(' + secrets.PRIVATE_KEY_HEADER + ')')}, 1)), 'gen_private_key_committed' FROM lines)"""


@query("r11_secret_scan", with_ctes(B.FILES, B.LINES, SECRET_ROWS, body="SELECT repo, path AS file, line, invariant_id, v AS value FROM secret"))
def r11(spark, sf):
    return secrets.secret_scan(B.files(spark, sf), skip_docs=False).select("repo", "file", "line", "invariant_id", "value")


@query("r12_redact", with_ctes(B.FILES, B.LINES, SECRET_ROWS, body=f"""
SELECT repo, path AS file, line, invariant_id, regexp_replace(regexp_replace(regexp_replace(text,
  '"([^"''\\s]{{4}})[^"''\\s]{{4,}}"', '"\\1****"', 'g'), '''([^"''\\s]{{4}})[^"''\\s]{{4,}}''', '''\\1****''', 'g'), {q(_S_KNOWN)}, '****', 'g') AS snippet
FROM secret"""))
def r12(spark, sf):
    found = secrets.secret_scan(B.files(spark, sf), skip_docs=False)
    return secrets.redact(found).select("repo", "file", "line", "invariant_id", "snippet")


@query("r13_suppress", pack_sql(TEXT_PACK, "*").replace(B.CODE_FILES, B.FILES.replace("files AS", "code_files AS", 1)).replace(
    "SELECT * FROM (", f""", mk AS (SELECT repo, path, unnest([line, line + 1]) AS line, regexp_extract(text, 'doc_id|the ([A-Za-z0-9_]*)', 1) AS scope FROM lines WHERE contains(text, 'the '))
SELECT repo, file, line, invariant_id FROM (SELECT * FROM (""", 1) + """) f
WHERE NOT EXISTS (SELECT 1 FROM mk WHERE mk.repo = f.repo AND mk.path = f.file AND mk.line = f.line AND (mk.scope = '' OR mk.scope = f.invariant_id))""")
def r13(spark, sf):
    files = B.files(spark, sf)
    found = R.scan_files(files, TEXT_PACK)
    return FD.suppress(found, C.explode_lines(files), "the ").select("repo", "file", "line", "invariant_id")


@query("r14_restore_snippets", pack_sql(TEXT_PACK, "*").replace(B.CODE_FILES, B.FILES.replace("files AS", "code_files AS", 1)).replace(
    "SELECT * FROM (", "SELECT f.repo, f.file, f.line, f.invariant_id, trim(l.text) AS snippet FROM (", 1) +
    " f JOIN lines l ON l.repo = f.repo AND l.path = f.file AND l.line = f.line")
def r14(spark, sf):
    files = B.files(spark, sf)
    found = R.scan_files(files, TEXT_PACK).withColumn("snippet", F.lit("emptied"))
    return FD.restore_snippets(found, C.explode_lines(files)).select("repo", "file", "line", "invariant_id", "snippet")


NEEDLES = (
    ("reentrancy", "tion", ["evm"], 9.8), ("overflow", "the ", ["evm", "move"], 8.5), ("access", "und ", ["evm"], 6.0),
    ("oracle", "queque", ["solana"], 9.1), ("timestamp", "token", ["evm"], 3.0),
)


@query("r15_pattern_db_scan", with_ctes(B.FILES, B.LINES, body=f"""
SELECT repo, path, line, id AS pattern_id, needle, CASE WHEN score >= 9 THEN 'Critical' WHEN score >= 7 THEN 'High' WHEN score >= 5 THEN 'Medium' ELSE 'Low' END AS severity
FROM lines JOIN (VALUES {", ".join(f"({q(i)}, {q(n)}, {s})" for i, n, c, s in NEEDLES if "evm" in c)}) p(id, needle, score) ON contains(text, needle)"""))
def r15(spark, sf):
    db = spark.createDataFrame(NEEDLES, "pattern_id string, needle string, chains array<string>, score double")
    return R.pattern_db_scan(B.files(spark, sf), db, "evm")


_CALL, _RESET = r" the ", r" was "


@query("r16_call_without_prior_update", with_ctes(B.FILES, B.LINES, body=f"""
, m AS (SELECT *, regexp_matches(text, {q(_CALL)}) AND NOT contains(text, 'token') AS c,
  max(CASE WHEN regexp_matches(text, {q(_RESET)}) THEN 1 ELSE 0 END) OVER (PARTITION BY repo, path ORDER BY line ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS r FROM lines)
SELECT repo, path, line FROM m WHERE c AND coalesce(r, 0) = 0"""))
def r16(spark, sf):
    return R.call_without_prior_update(B.files(spark, sf), _CALL, _RESET, "token")


@query("r18_context_lines", pack_sql(TEXT_PACK, "*").replace(B.CODE_FILES, B.FILES.replace("files AS", "code_files AS", 1)).replace(
    "SELECT * FROM (", "SELECT f.repo, f.file, f.line, f.invariant_id, string_agg(l.text, chr(10) ORDER BY l.line) AS context FROM (SELECT DISTINCT repo, file, line, invariant_id FROM (", 1) +
    ") f JOIN lines l ON l.repo = f.repo AND l.path = f.file AND l.line BETWEEN f.line - 2 AND f.line + 2 GROUP BY ALL")
def r18(spark, sf):
    files = B.files(spark, sf)
    return R.context_lines(R.scan_files(files, TEXT_PACK), C.explode_lines(files), 2)


def _ingress_sql(dialect: str, kinds: str) -> str:
    cidr, low, high, marker = R.INGRESS[dialect]
    near = lambda p: (
        f"(SELECT TRY_CAST(regexp_extract(c2.text, {q(p)}, 1) AS BIGINT) FROM cl c2 WHERE c2.repo = h.repo AND c2.path = h.path AND c2.line <= h.line"
        f" AND c2.line >= greatest(h.line - 8, coalesce((SELECT max(c3.line) FROM cl c3 WHERE c3.repo = h.repo AND c3.path = h.path AND c3.line <= h.line AND regexp_matches(c3.text, {q(R.BLOCK_OPENER)})), 0))"
        f" AND regexp_extract(c2.text, {q(p)}, 1) <> '' ORDER BY c2.line DESC LIMIT 1)"
    )
    mark = f"AND path IN (SELECT path FROM code_files WHERE regexp_matches(source, {q(marker)}))" if marker else ""
    ports = ", ".join(str(p) for p in R.SENSITIVE_PORTS)
    return f"""(SELECT repo, path AS file, line, 'gen_iac_open_ingress' AS invariant_id, 'High' AS severity, trim(text) AS snippet FROM (
  SELECT h.*, {near(low)} AS lo0, {near(high)} AS hi0 FROM cl h WHERE kind IN ({kinds}) {mark} AND regexp_matches(text, {q(cidr)})),
  LATERAL (SELECT CASE WHEN lo0 < 0 THEN 4294967295 ELSE lo0 END AS lo, CASE WHEN hi0 < 0 THEN 65535 ELSE hi0 END AS hi)
  WHERE CASE WHEN lo IS NULL THEN true WHEN hi IS NULL THEN lo = 0 OR lo IN ({ports})
    ELSE (lo = 0 AND (hi = 0 OR hi >= 65535)) OR lo = 4294967295 OR len(list_filter([{ports}], lambda p: p >= lo AND p <= hi)) > 0 END)"""


@query("r2_open_ingress", with_ctes(*B.CODE_LINES, body=_ingress_sql("Terraform", "'Terraform'") + " UNION ALL " + _ingress_sql("CloudFormation", "'ContainerManifest', 'Config'")))
def r2_ports(spark, sf):
    files = B.code_files(spark, sf)
    return R.open_ingress(files, "Terraform").unionByName(R.open_ingress(files, "CloudFormation")).select(*COLS)


@query("p13_sensitive_port_range", f"""
SELECT l_orderkey, l_linenumber, CASE WHEN lo IS NULL THEN true WHEN hi IS NULL THEN lo = 0 OR lo IN ({", ".join(map(str, R.SENSITIVE_PORTS))})
  ELSE (lo = 0 AND (hi = 0 OR hi >= 65535)) OR len(list_filter([{", ".join(map(str, R.SENSITIVE_PORTS))}], lambda p: p >= lo AND p <= hi)) > 0 END AS sensitive
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 11 <> 0 THEN l_partkey * 7 END AS lo, CASE WHEN l_suppkey % 7 <> 0 THEN l_partkey * 7 + CAST(l_quantity AS BIGINT) END AS hi FROM lineitem)""")
def p13(spark, sf):
    l = B.table(spark, sf, "lineitem")
    lo = F.when(F.col("l_partkey") % 11 != 0, F.col("l_partkey") * 7)
    hi = F.when(F.col("l_suppkey") % 7 != 0, F.col("l_partkey") * 7 + F.col("l_quantity").cast("long"))
    return l.select("l_orderkey", "l_linenumber", R.sensitive_port_range(lo, hi).alias("sensitive"))


@query("r5_docker_base_and_user", with_ctes(*B.CODE_LINES, body=f"""
, st AS (SELECT repo, path, line, text, lower(regexp_extract(text, {q(R.FROM_LINE)}, 2)) AS image, lower(regexp_extract(text, {q(R.FROM_LINE)}, 4)) AS stage
   FROM cl WHERE kind = 'Dockerfile' AND regexp_matches(text, {q(R.FROM_LINE)})),
us AS (SELECT DISTINCT repo, path FROM cl WHERE kind = 'Dockerfile' AND regexp_matches(text, {q(R.USER_LINE)}) AND regexp_extract(text, {q(R.USER_LINE)}, 1) NOT IN ('root', '0')),
la AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY line DESC) = 1)
SELECT repo, path AS file, line, 'gen_docker_unpinned_base' AS invariant_id, 'Low' AS severity, trim(text) AS snippet FROM st s
WHERE image <> 'scratch' AND (NOT contains(image, ':') OR image LIKE '%:latest') AND NOT contains(image, '@')
  AND NOT EXISTS (SELECT 1 FROM st p WHERE p.repo = s.repo AND p.path = s.path AND p.line <= s.line AND p.stage <> '' AND p.stage = s.image)
UNION ALL
SELECT c.repo, c.path, coalesce(la.line, 1), 'gen_docker_root_user', 'Medium', trim(coalesce(la.text, c.text)) FROM cl c
LEFT JOIN la ON la.repo = c.repo AND la.path = c.path
WHERE c.kind = 'Dockerfile' AND c.line = 1 AND NOT EXISTS (SELECT 1 FROM us WHERE us.repo = c.repo AND us.path = c.path)
  AND NOT coalesce(la.image = 'scratch' OR (contains(la.image, 'distroless') AND contains(la.image, 'nonroot')), false)"""))
def r5_docker(spark, sf):
    return R.docker_base_and_user(B.code_files(spark, sf)).select(*COLS)


_VAR = f"regexp_extract(text, {q(R.PATH_CHECK)}, 3)"


@query("j20_check_then_use", with_ctes(*B.CODE_LINES, body=f"""
, ft AS (SELECT repo, path, string_agg(text, chr(10) ORDER BY line) AS body FROM cl WHERE kind IN ('Python', 'JavaScript', 'Go') GROUP BY ALL),
ck AS (SELECT repo, path, line, text, {_VAR} AS v FROM cl WHERE kind IN ('Python', 'JavaScript', 'Go') AND {_VAR} <> '')
SELECT ck.repo, ck.path AS file, ck.line, 'gen_toctou_file' AS invariant_id, 'Low' AS severity, trim(ck.text) AS snippet
FROM ck JOIN ft ON ft.repo = ck.repo AND ft.path = ck.path
WHERE regexp_matches(body, {q(R.SERVER_CONTEXT)})
  AND NOT regexp_matches(body, replace({q(R.LOCAL_DERIVATION)}, 'VAR', replace(v, '.', '\\.')))
  AND EXISTS (SELECT 1 FROM cl u WHERE u.repo = ck.repo AND u.path = ck.path AND u.line BETWEEN ck.line + 1 AND ck.line + 8
    AND regexp_matches(u.text, {q(R.PATH_USE)}) AND contains(u.text, ck.v))"""))
def j20(spark, sf):
    return R.check_then_use(B.code_files(spark, sf)).select(*COLS)
