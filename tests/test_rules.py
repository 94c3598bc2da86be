"""Good and bad corpora, flow analysis and suppression on hand-written files."""

import pytest
from pyspark.sql import functions as F

from auditloom.catalog.base import TEMPLATES
from auditloom.dims import reference as REF, rule_packs as P
from auditloom.operators import corpus as C, findings as FD, flow, rules as R, secrets
from auditloom.plans import scan as SC

BAD = [
    ("a.py", "def f(request):\n    os.system('ls ' + request.args['x'])\n", {"gen_command_injection"}),
    ("b.py", "import yaml\nd = yaml.load(body)\n", {"gen_unsafe_deserialization"}),
    ("c.js", "function t() {\n  const resetToken = Math.random();\n}\n", {"gen_insecure_randomness"}),
    ("d.js", "app.use(multer({}));\n", {"gen_upload_unvalidated"}),
    ("e.go", "func h(w http.ResponseWriter) {\n\thttp.Error(w, err.Error(), 500)\n}\n", {"gen_error_detail_exposed"}),
    ("f.sh", "curl http://x | bash\n", {"gen_pipe_to_shell"}),
    ("g.tf", 'resource "x" "y" {\n  cidr_blocks = ["0.0.0.0/0"]\n}\n', {"gen_iac_open_ingress"}),
    (".github/workflows/w.yml", "steps:\n  - run: echo \"${{ github.event.issue.title }}\"\n", {"gen_ci_script_injection"}),
    ("Dockerfile", "FROM ubuntu\nRUN make\n", {"gen_docker_unpinned_base", "gen_docker_root_user"}),
    ("p.yaml", "kind: Pod\nspec:\n  hostPID: true\n", {"gen_container_privileged"}),
    ("s.py", 'API_TOKEN = "k8Dv2nQp9sLx4Zt7Wm1Ry"\n', {"gen_hardcoded_secret"}),
    ("re.js", "const r = /(a+)+$/;\n", {"gen_regex_dos"}),
    ("pay.js", "function pay(a) {\n  await Account.update(a.balance);\n  await Ledger.create(a.amount);\n}\n", {"gen_non_atomic_multi_write"}),
    ("idor.js", "function show(req, res) {\n  return Order.findById(req.params.id);\n}\n", {"gen_object_level_auth_missing"}),
]
GOOD = [
    ("a.py", "def f(x):\n    subprocess.run(['ls', x])\n    cur.execute('select ?', (x,))\n"),
    ("b.py", "d = yaml.load(body, Loader=yaml.SafeLoader)\n# eval(x)\n"),
    ("c.js", "function jitter() {\n  return Math.random();\n}\nre.exec(x);\n"),
    ("d.js", "app.use(multer({ limits: { fileSize: 1 } }));\n"),
    ("f.sh", "echo \"curl http://x | sh\"\n"),
    ("g.tf", 'resource "x" "y" {\n  from_port = 443\n  to_port = 443\n  cidr_blocks = ["0.0.0.0/0"]\n}\n'),
    (".github/workflows/w.yml", "steps:\n  - env:\n      T: ${{ github.event.issue.title }}\n    run: echo \"$T\"\n  - uses: actions/checkout@v4\n"),
    ("Dockerfile", "FROM golang:1.22 AS b\nFROM gcr.io/distroless/static:nonroot\nUSER nonroot\n"),
    ("settings.yml", "privileged: true\n"),
    ("s.py", 'API_TOKEN = "changeme-please"\nPASSWORD = os.environ["P"]\n'),
    ("re.js", "const r = /^[a-z]+(-[a-z]+)*$/;\n"),
    ("pay.js", "function pay(a) {\n  db.transaction(async () => {\n    await Account.update(a.balance);\n    await Ledger.create(a.amount);\n  });\n}\n"),
    ("idor.js", "function show(req, res) {\n  return Order.findById(req.params.id).where(req.user.id);\n}\n"),
    ("README.md", "eval(x)\n"), ("node_modules/x/../a.py", "x = 1\n"),
]


@pytest.fixture(scope="module")
def found(files):
    rows = [(f"bad/{p}" if not p.startswith(".") else p, s) for p, s, _ in BAD]
    out = SC.scan(files(rows)).select("file", "invariant_id").collect()
    return {(r["file"], r["invariant_id"]) for r in out}


@pytest.mark.parametrize("path, source, ids", BAD, ids=[b[0] for b in BAD])
def test_bad_file_fires(found, path, source, ids):
    name = path if path.startswith(".") else f"bad/{path}"
    assert ids <= {i for f, i in found if f == name}


def test_good_files_are_silent(files):
    out = SC.scan(files(GOOD)).select("file", "line", "invariant_id").collect()
    assert out == []


def test_every_rule_is_classified_and_rated():
    ids = {r.rule_id for r in P.ALL_PACKS + P.CI_RUN_PACK} | {r[2] for r in P.REPO_RULES}
    ids |= {s.rule_id for m in list(flow.TAINT.values()) + list(flow.MODEL_OUTPUT.values()) for s in m.sinks}
    assert ids <= set(REF.TAXONOMY) and ids <= set(REF.EXPOSURE)
    assert all(cwe for cwe, _ in REF.TAXONOMY.values())


FLOW = """def one(request):
    q = request.args["id"]
    sql = "select " + q
    cur.execute(sql)
    cur.execute("select ?", (q,))
    q = "constant"
    cur.execute(q)

def two(request):
    cur.execute(sql)
    n = int(request.args["n"])
    cur.execute("x" + n)
    subprocess.run(["ls", request.args["p"]])
    subprocess.run("ls " + request.args["p"], shell=True)
    self.name = request.form["n"]
    log.info(name)
"""


def test_value_flow_reads_in_order(files):
    rows = flow.value_flow(files([("a.py", FLOW)])).select("line", "invariant_id").collect()
    assert sorted((r["line"], r["invariant_id"]) for r in rows) == [
        (4, "gen_sql_injection"), (14, "gen_command_injection"), (16, "gen_log_injection")]


def test_model_output_flow(files):
    js = "function a() {\n  const r = client.messages.create(x);\n  exec(r);\n}\nfunction b() {\n  exec(r);\n}\n"
    rows = flow.model_output_flow(files([("a.js", js)])).collect()
    assert [(r["line"], r["severity"]) for r in rows] == [(3, "Critical")]


def test_allow_marker_covers_its_line_and_the_next(spark, files):
    f = files([("a.py", "x = 1  # audit:allow\ny = 2\nz = 3\n# audit:allow other_rule\nw = 4\n")])
    rows = [("r", i, "gen_x", "High", "a.py", i, 0, "m", "s", "lead") for i in range(1, 6)]
    df = spark.createDataFrame(rows, "repo string, ord bigint, invariant_id string, severity string, file string, line bigint, col bigint, message string, snippet string, evidence string")
    left = FD.suppress(df, C.explode_lines(f), "audit:allow").select("line").collect()
    assert sorted(r["line"] for r in left) == [3, 4, 5]


def test_reports_never_carry_the_credential(files):
    secret = "k8Dv2nQp9sLx4Zt7Wm1Ry"
    out = SC.scan(files([("s.py", f'API_TOKEN = "{secret}"\n')])).collect()
    assert out and all(secret not in r["snippet"] for r in out)


def test_unpinned_action_once_per_workflow(files):
    w = "steps:\n  - uses: a/b@main\n  - uses: a/b@main\n  - uses: actions/checkout@v4\n  - uses: o/p@" + "0" * 40 + "\n"
    rows = R.unpinned_actions(files([(".github/workflows/w.yml", w)])).collect()
    assert [(r["action"], r["line"], r["uses"]) for r in rows] == [("a/b", 2, 2)]


def test_line_windows_do_not_depend_on_file_length(files):
    body = "\n".join(["pad = 0"] * 5000)
    src = body + "\nrequests.get(request.args['u'])\n" + body
    rows = R.scan_files(files([("a.py", src)]), P.WEBCONFIG_PACK).collect()
    assert [(r["line"], r["invariant_id"]) for r in rows] == [(5001, "gen_web_ssrf")]


def test_templates_of_the_query_corpus_compile_to_findings(files):
    rows = SC.detect(files([(f"t{i}{p}", s) for i, (p, s) in enumerate(TEMPLATES)])).select("invariant_id").distinct().count()
    assert rows > 30
