"""Query registry and the views the queries share.

A query is a Spark callable with, where SQL can say it, the equivalent SQL for
another engine. Views are plain projections of the given tables, so both sides
see the same rows and work grows with the tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import corpus as C


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(fn, sql)
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def ql(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def with_ctes(*ctes: str, body: str) -> str:
    # A body may go on with more CTEs after a leading comma.
    return "WITH " + ",\n".join(ctes) + "\n" + body.lstrip()


# ---- files -------------------------------------------------------------------------

EXTENSIONS = (".py", ".js", ".go", ".sh", ".yml", ".tf", ".json", ".env", ".md", ".sol", ".txt", ".toml")
HOST_RE = "://([^/:?#]+)"


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files of twelve extensions, pages as HTML files of their host."""
    d = table(spark, sf, "documents")
    ext = F.get(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % len(EXTENSIONS)).cast("int"))
    docs = d.select(
        F.col("source").alias("repo"),
        F.concat("lang", F.lit("/d"), F.col("doc_id").cast("string"), ext).alias("path"),
        F.col("text").alias("source"),
    )
    p = table(spark, sf, "pages")
    pages = p.select(
        F.regexp_extract("url", HOST_RE, 1).alias("repo"),
        F.concat(F.lit("page/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.col("html").alias("source"),
    )
    return docs.unionByName(pages)


FILES = f"""files AS (
  SELECT source AS repo, lang || '/d' || doc_id || list_extract({ql(EXTENSIONS)}, CAST(doc_id % {len(EXTENSIONS)} AS INT) + 1) AS path, text AS source
  FROM documents
  UNION ALL
  SELECT regexp_extract(url, {q(HOST_RE)}, 1), 'page/' || page_id || '.html', html FROM pages)"""


def split_sql(col: str) -> str:
    return f"string_split(regexp_replace(replace({col}, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10))"


def lines_cte(src: str = "files", name: str = "lines") -> str:
    return f"""{name} AS (
  SELECT repo, path, CAST(line AS BIGINT) AS line, text FROM (
    SELECT repo, path, unnest(arr) AS text, generate_subscripts(arr, 1) AS line
    FROM (SELECT repo, path, {split_sql('source')} AS arr FROM {src})))"""


LINES = lines_cte()

# Source templates: each document's text follows one of these openings, so the
# pack queries meet real code shapes and still read every whole text.
TEMPLATES: tuple[tuple[str, str], ...] = (
    (".py", 'import os, yaml\ndef load(request):\n    q = request.args["id"]\n    sql = "select * from t where id = " + q\n    cur.execute(sql)  # builds SQL\n    data = yaml.load(q)\n    os.system("ls " + q)\n    return str(e)\n'),
    (".py", 'import hashlib, random\ndef token(user):\n    a = 1\n    # random.random() in a comment\n    t = random.random()\n    h = hashlib.md5(user)\n    cur.execute("select 1", (a,))\n    requests.get(url, verify=False)\n    logging.info("password", password)\n'),
    (".js", 'function order(req, res) {\n  const id = req.query.id;\n  db.query(`select ${id}`);\n  el.innerHTML = id; // sink\n  eval("2+2");\n  child_process.exec("ls " + id);\n  const u = Model.findById(req.params.id);\n  res.redirect(id);\n}\n'),
    (".js", 'app.post("/login", (req, res) => {\n  cors({ origin: "*", credentials: true });\n  res.cookie("s", v, { httpOnly: false });\n  fetch(req.query.url);\n  User.create(req.body);\n  const limit = req.query.limit;\n  rows.slice(limit);\n  const r = /(a+)+$/;\n});\n'),
    (".go", 'package main\nimport "math/rand"\nfunc run(w http.ResponseWriter, r *http.Request) {\n\tid := r.FormValue("id")\n\tdb.Query("select " + id)\n\texec.Command("sh", "-c", "ls " + id)\n\tcfg := tls.Config{InsecureSkipVerify: true}\n\thttp.Error(w, err.Error(), 500)\n}\n'),
    (".sh", '#!/bin/sh\n# curl http://x | sh in a comment\ncurl -s http://x | sudo bash\neval "$1"\nchmod 777 /srv\nT=$(mktemp -d)\necho "curl http://x | sh"\n'),
    ("/.github/workflows/ci.yml", 'on:\n  pull_request_target:\njobs:\n  b:\n    steps:\n      - uses: actions/checkout@v4\n        with:\n          ref: ${{ github.event.pull_request.head.sha }}\n      - uses: other/tool@v1\n      - uses: other/tool@v1\n      - run: |\n          echo "${{ github.event.pull_request.title }}"\n          echo ${{ secrets.KEY }}\n      - name: x\n      - run: npm publish\n'),
    ("/Dockerfile", 'FROM node:latest AS build\nRUN curl -s http://x | sh\nFROM build\nADD http://x/y /y\nCMD ["app"]\n'),
    (".yml", 'kind: Pod\nspec:\n  hostNetwork: true\n  containers:\n    - name: a\n      securityContext:\n        privileged: true\n        runAsUser: 0\n'),
    (".tf", 'resource "aws_security_group_rule" "a" {\n  from_port = 20\n  to_port = 30\n  cidr_blocks = ["0.0.0.0/0"]\n}\nresource "aws_s3_bucket" "b" {\n  acl = "public-read"\n}\nresource "aws_db_instance" "c" {\n  publicly_accessible = true\n  storage_encrypted = false\n}\n'),
    (".json", '{"AWSTemplateFormatVersion": "2010-09-09",\n "Effect": "Allow",\n "Action": "*",\n "Resource": "*",\n "FromPort": 443,\n "ToPort": 443,\n "CidrIp": "0.0.0.0/0",\n "PubliclyAccessible": true}\n'),
    (".env", 'FLASK_DEBUG=1\nSESSION_COOKIE_SECURE=False\nAPI_TOKEN="k8Dv2nQp9sLx4Zt7Wm1Ry"\nPASSWORD="changeme-please"\n'),
    (".py", 'from flask import request\ndef show():\n    p = request.args["p"]\n    if os.path.exists(p):\n        return open(p).read()\n    f = request.files["f"]\n    f.save("/srv")\n    answer = client.messages.create(x)\n    os.system(answer)\n'),
    (".js", 'function pay(a, b) {\n  // audit:allow gen_non_atomic_multi_write\n  await Account.update(a.balance);\n  await Account.update(b.balance);\n  const ok = DOMPurify.sanitize(req.query.q);\n  el.innerHTML = ok;\n  const n = parseInt(req.query.n);\n  db.query("select " + n);\n}\n'),
    (".js", 'const up = multer({ dest: "/tmp/up" });\nconst api = new ApolloServer({ typeDefs });\nconst wss = new WebSocketServer({ port: 1 });\nfunction upload(req, res) {\n  res.send(err);\n}\n'),
    (".py", 'from lxml import etree\nimport websockets\ndef parse(body):\n    tree = etree.fromstring(body)\n    websockets.serve(handle, "x", 1)\n    return tree\n'),
)
N_TEMPLATES = len(TEMPLATES)


def code_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every document behind a source template chosen by its id."""
    d = table(spark, sf, "documents")
    no = (F.col("doc_id") % N_TEMPLATES).cast("int")
    pick = lambda i: F.get(F.array(*[F.lit(t[i]) for t in TEMPLATES]), no)
    return d.select(
        F.col("source").alias("repo"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), pick(0)).alias("path"),
        F.concat(pick(1), F.col("text")).alias("source"),
    )


def _tsql(i: int) -> str:
    return "list_extract([" + ", ".join(
        "replace(replace(" + q(t[i].replace("\n", "¶").replace("\t", "→")) + ", '¶', chr(10)), '→', chr(9))" for t in TEMPLATES
    ) + f"], CAST(doc_id % {N_TEMPLATES} AS INT) + 1)"


CODE_FILES = f"""code_files AS (
  SELECT source AS repo, 'd' || doc_id || {_tsql(0)} AS path, {_tsql(1)} || text AS source FROM documents)"""


def kind_sql(path: str = "path") -> str:
    name = f"regexp_extract(lower({path}), '([^/]*)$', 1)"
    ext = f"regexp_extract(lower({path}), '([^./]*)$', 1)"
    folders = "|".join(d.replace(".", r"\.") for d in C.SKIP_FOLDERS)
    ends = "|".join(e.replace(".", r"\.") for e in C.SKIP_ENDINGS)
    whens = "\n".join(
        f"WHEN list_contains({ql(v)}, {ext}) THEN {q(k)}" for k, v in C.KIND_BY_EXTENSION.items()
    )
    return f"""CASE WHEN list_contains({ql(C.SKIP_EXTENSIONS)}, {ext}) OR regexp_matches({name}, {q('(' + ends + ')$')})
      OR regexp_matches(lower({path}), {q('/(' + folders + ')/')}) THEN 'Skip'
    WHEN contains(lower({path}), '.github/workflows/') AND {ext} IN ('yml', 'yaml') THEN 'GithubWorkflow'
    WHEN {name} IN ('dockerfile', 'containerfile') OR starts_with({name}, 'dockerfile.') OR {ext} = 'dockerfile' THEN 'Dockerfile'
    {whens}
    WHEN starts_with({name}, '.env') THEN 'Config' ELSE 'Other' END"""


HASH_RE = r"""("(?:[^"\\]|\\.)*(?:"|\\?$)|'(?:[^'\\]|\\.)*(?:'|\\?$))|#.*$"""
SLASH_RE = (
    r"""("(?:[^"\\]|\\.)*(?:"|\\?$)|'(?:[^'\\]|\\.)*(?:'|\\?$)|`(?:[^`\\]|\\.)*(?:`|\\?$))"""
    r"""|//.*$|/\*.*?(?:\*/|$)"""
)


def code_cte() -> str:
    """Numbered comment-free lines with the file's kind."""
    return f"""cl AS MATERIALIZED (
  SELECT repo, path, kind, line, raw, CASE WHEN kind IN ('JavaScript', 'Go')
    THEN regexp_replace(raw, {q(SLASH_RE)}, '\\1', 'g') ELSE regexp_replace(raw, {q(HASH_RE)}, '\\1', 'g') END AS text
  FROM (SELECT repo, path, {kind_sql()} AS kind, line, text AS raw FROM lines))"""


CODE_LINES = (CODE_FILES, lines_cte("code_files"), code_cte())


# ---- findings ------------------------------------------------------------------------

RULES = (
    "gen_sql_injection", "gen_iac_public_database", "gen_hardcoded_secret", "gen_xss_sink",
    "rt_missing_csp", "rt_insecure_cookie", "gen_web_ssrf", "gen_iac_wildcard_iam",
    "sca_vulnerable_dependency", "gen_command_injection", "gen_docker_root_user", "rt_open_port",
    "gen_tls_verification_disabled", "unmapped_rule", "gen_ci_pwn_request",
)
EVENT_TYPES = ("signup", "purchase", "error", "view", "click")
LEVELS = ("Info", "Low", "Medium", "High", "Critical")


def findings(spark: SparkSession, sf: str) -> DataFrame:
    """Events as findings of fifteen rules over twenty repositories."""
    e = table(spark, sf, "events")
    type_no = F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("event_type")) - 1
    return e.select(
        F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("repo"),
        F.col("event_id").alias("ord"),
        F.get(F.array(*[F.lit(r) for r in RULES]), (type_no * 3 + F.col("user_id") % 3).cast("int")).alias("invariant_id"),
        F.get(F.array(*[F.lit(s) for s in LEVELS]), (F.col("user_id") % 5).cast("int")).alias("severity"),
        F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file"),
        (F.floor("value").cast("long") + 1).alias("line"), F.lit(0).cast("long").alias("col"),
        F.col("props").alias("message"), F.col("props").alias("snippet"),
        F.when(F.col("event_id") % 10 == 0, "proven").otherwise("lead").alias("evidence"),
        F.col("ts"),
    )


FINDINGS = f"""findings AS (
  SELECT 'u' || (user_id % 20) AS repo, event_id AS ord,
    list_extract({ql(RULES)}, CAST((list_position({ql(EVENT_TYPES)}, event_type) - 1) * 3 + user_id % 3 AS INT) + 1) AS invariant_id,
    list_extract({ql(LEVELS)}, CAST(user_id % 5 AS INT) + 1) AS severity,
    'f' || user_id AS file, CAST(floor(value) AS BIGINT) + 1 AS line, CAST(0 AS BIGINT) AS col,
    props AS message, props AS snippet, CASE WHEN event_id % 10 = 0 THEN 'proven' ELSE 'lead' END AS evidence, ts
  FROM events)"""


# ---- runs ---------------------------------------------------------------------------

TIERS = ("VERIFIED-PROVEN", "VERIFIED-STATIC", "REASONED")


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as agent rows of several runs."""
    l = table(spark, sf, "lineitem")
    return l.select(
        F.concat(F.lit("run"), F.col("l_linenumber").cast("string")).alias("run"),
        F.col("l_partkey").cast("string").alias("key"),
        F.when(F.col("l_returnflag") == "R", "LEAD").otherwise("FINDING").alias("kind"),
        F.when(F.col("l_linestatus") == "F", F.lit("VERIFIED-STATIC")).otherwise("REASONED").alias("tier"),
        F.when(F.col("l_quantity") > 2, F.col("l_quantity") * 2).alias("confidence"),
        F.col("l_linenumber").cast("long").alias("pass"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("ord"),
        F.col("l_suppkey").alias("agent"), (F.col("l_partkey") % 97 == 0).alias("engine"),
        F.concat(F.lit("c"), (F.col("l_partkey") % 50).cast("string")).alias("contract"),
        F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("function"),
        F.concat(F.lit("label-"), F.col("l_shipdate").cast("date").cast("string").substr(1, 4)).alias("label"),
        F.when(F.col("l_tax") > 0.02, F.concat(F.lit("fix"), F.round(F.col("l_tax") * 100).cast("int").cast("string"))).alias("fix"),
    )


RUNS = """runs AS (
  SELECT 'run' || l_linenumber AS run, CAST(l_partkey AS VARCHAR) AS key,
    CASE WHEN l_returnflag = 'R' THEN 'LEAD' ELSE 'FINDING' END AS kind,
    CASE WHEN l_linestatus = 'F' THEN 'VERIFIED-STATIC' ELSE 'REASONED' END AS tier,
    CASE WHEN l_quantity > 2 THEN l_quantity * 2 END AS confidence, CAST(l_linenumber AS BIGINT) AS pass,
    CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS ord, l_suppkey AS agent, l_partkey % 97 = 0 AS engine,
    'c' || (l_partkey % 50) AS contract, 'f' || l_partkey AS "function",
    'label-' || strftime(l_shipdate, '%Y') AS label,
    CASE WHEN l_tax > 0.02 THEN 'fix' || CAST(round(l_tax * 100) AS INT) END AS fix
  FROM lineitem)"""
