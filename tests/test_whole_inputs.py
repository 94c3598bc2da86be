"""No input is too long, too wide or too null to count."""

from pyspark.sql import functions as F

from auditloom.functions import versions as V
from auditloom.operators import corpus, findings, keyed, observe, rules as R


def test_versions_of_any_length(spark):
    long = ".".join(["1"] * 13)
    rows = [(long, long + ".1", -1), (long, long + ".0", 0), ("1.2", "1.2.0.0", 0), ("1.0.0.0.0.0.0.0.0.0.0.0.0.1", "1", 1), ("0", "0.0", 0), ("0.0.1", "0", 1)]
    df = spark.createDataFrame(rows, "a string, b string, want int")
    assert df.filter(~V.compare_versions(F.col("a"), F.col("b")).eqNullSafe(F.col("want"))).count() == 0
    req = spark.createDataFrame([(long, f">={long}", True), (long, f"<{long}", False), ("1", "^1.0.0", True), ("0.0.3", "^0.0.3", True), ("0", "~0", True)], "v string, r string, want boolean")
    assert req.filter(~V.req_matches(F.col("v"), F.col("r")).eqNullSafe(F.col("want"))).count() == 0


def test_cookie_with_many_attributes(spark):
    value = "session=x" + "; a=b" * 1001 + "; Secure; HttpOnly"
    df = spark.createDataFrame([("h", "u", "https://h/", [("Set-Cookie", value)])], "host string, url string, final_url string, headers array<struct<name:string,value:string>>")
    assert observe.cookie_rules(df).count() == 0


def test_long_debt_notes_stay_whole(files):
    note = "n" * 200
    df = files([("a.py", f"# TODO: {note}\n")])
    assert note in corpus.tech_debt(df).first()["note"]
    assert len(corpus.tech_debt(df, max_chars=50).first()["note"]) == 50


def test_guard_at_the_end_of_a_long_function(files):
    src = "def f():\n    danger()\n" + "    pass\n" * 90 + "    guard()\n"
    rule = R.Rule("x", ("Python",), "High", r"danger\(", "m", func_lacks=r"guard\(")
    assert R.scan_files(files([("a.py", src)]), [rule]).count() == 0
    assert R.scan_files(files([("a.py", src)]), [rule], function_cap=R.FUNCTION_SPAN).count() == 1
    assert R.packs_of([rule] * 450, 200) and [len(p) for p in R.packs_of([rule] * 450, 200)] == [200, 200, 50]


def test_null_keys_and_times_are_kept(spark):
    rows = [(None, 1, 10), (None, 2, None), ("a", None, 5), ("a", 3, 7)]
    df = spark.createDataFrame(rows, "k string, t int, v long")
    prev = keyed.carry_forward(df, ["k"], ["t"], F.floor(F.col("t") / 2), F.col("v")).collect()
    assert sorted((str(r["k"]), r["t"] or 0, r["prev"]) for r in prev) == [("None", 1, None), ("None", 2, 10), ("a", 0, None), ("a", 3, 5)]
    total = keyed.running_total(df, ["k"], ["t"], F.floor(F.col("t") / 10), F.coalesce("v", F.lit(0)), "s").collect()
    assert sorted((str(r["k"]), r["t"] or 0, r["s"]) for r in total) == [("None", 1, 10), ("None", 2, 10), ("a", 0, 5), ("a", 3, 12)]


def test_every_pathway_is_assessed(spark):
    from auditloom.operators import risk

    found = spark.createDataFrame([("r", "a"), ("r", "a"), (None, "b")], "repo string, invariant_id string")
    controls = spark.createDataFrame([("p", "native", "a"), ("q", "native", "z"), ("q", "assess", "m")], "pathway string, kind string, ref string")
    skills = spark.createDataFrame([], "subdomain string")
    repos = spark.createDataFrame([("quiet",)], "repo string")
    got = sorted((str(r["repo"]), r["pathway"], r["native_findings"], r["manual_controls"]) for r in risk.pathway_assessment(found, controls, skills, repos).collect())
    assert got == [("None", "p", 0, 0), ("None", "q", 0, 1), ("quiet", "p", 0, 0), ("quiet", "q", 0, 1), ("r", "p", 2, 0), ("r", "q", 0, 1)]


def test_findings_of_two_repositories_stay_apart(spark):
    one = spark.createDataFrame([("r1", "x", "a.py", 1), ("r2", "x", "a.py", 1)], "repo string, invariant_id string, file string, line int")
    two = one.filter("repo = 'r2'")
    assert [tuple(r) for r in findings.new_and_fixed(one, two).collect()] == [("r1", "x", "a.py", 1, "fixed")]
    assert findings.common_findings(one, two).count() == 1
