"""Set-based operators against brute force on small random or hand-written tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from auditloom.catalog import q_sca
from auditloom.operators import findings as FD, graph as G, invariants as INV, keyed as K, observe as O, ops, risk as RK, sca
from auditloom.sources import lockfiles as L, readers as RD


def test_carry_forward_equals_a_plain_walk(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 5)}", t, rnd.choice([None, rnd.randint(0, 9)])) for t in range(400)]
    df = spark.createDataFrame(rows, "k string, t int, v int")
    got = {(r["k"], r["t"]): r["prev"] for r in K.carry_forward(df, ["k"], ["t"], F.floor(F.col("t") / 16), F.col("v"), "prev").collect()}
    last = {}
    for k, t, v in rows:
        assert got[(k, t)] == last.get(k)
        if v is not None:
            last[k] = v


def test_running_total_equals_a_plain_walk(spark):
    rnd = random.Random(2)
    rows = [(f"k{rnd.randint(0, 3)}", t, rnd.randint(-3, 5)) for t in range(300)]
    df = spark.createDataFrame(rows, "k string, t int, v int")
    got = {(r["k"], r["t"]): r["s"] for r in K.running_total(df, ["k"], ["t"], F.floor(F.col("t") / 7), F.col("v"), "s").collect()}
    total = {}
    for k, t, v in rows:
        total[k] = total.get(k, 0) + v
        assert got[(k, t)] == total[k]


@pytest.mark.parametrize("block", [2, 3, 5, 1000])
def test_block_edges_do_not_change_neighbour_windows(spark, block):
    rnd = random.Random(block)
    kinds = [rnd.choice("abc") for _ in range(60)]
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate(kinds)], "g int, seq int, kind string")
    spread, owned, w = K.neighbours(df, ["g"], "seq", 2, 3, block)
    out = spread.withColumn("near", F.max((F.col("kind") == "b").cast("int")).over(w.rowsBetween(-2, 3))).filter(owned)
    got = {r["seq"]: r["near"] for r in out.collect()}
    assert got == {i: int("b" in kinds[max(0, i - 2): i + 4]) for i in range(60)}


def test_first_by_takes_the_lowest_order(spark):
    rows = [("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z")]
    out = K.first_by(spark.createDataFrame(rows, "k string, o int, v string"), ["k"], [F.col("o")]).collect()
    assert sorted(map(tuple, out)) == [("a", 1, "y"), ("b", 2, "z")]


def test_allocate_credits_pays_oldest_first(spark):
    d = spark.createDataFrame([(1, 1, "s1", 2), (1, 2, "s2", 3), (2, 1, "t1", 1)], "user_id int, ord int, scan_id string, amount int")
    c = spark.createDataFrame([(1, 1, "c1", 3), (1, 2, "c2", 1)], "user_id int, ord int, credit_id string, amount int")
    out = sorted((r["scan_id"], r["credit_id"], r["amount"]) for r in ops.allocate_credits(d, c).collect())
    assert out == [("s1", "c1", 2.0), ("s2", "c1", 1.0), ("s2", "c2", 1.0)]


def test_credits_of_a_busy_user_take_time_in_proportion(spark):
    n = 60_000
    ends = spark.range(n).select(F.lit(1).alias("user_id"), F.col("id").alias("ord"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("name"), F.lit(1).alias("amount"))
    d, c = ends.withColumnRenamed("name", "scan_id"), ends.filter("ord < 20").withColumnRenamed("name", "credit_id")
    out = ops.allocate_credits(d, c)
    assert {tuple(r) for r in out.collect()} == {(1, f"x{i}", f"x{i}", 1) for i in range(20)}
    # A frame without an end is gone through anew for every row.
    assert "unboundedfollowing" not in out._jdf.queryExecution().analyzed().toString().lower()


TRACES = {
    "late write": ([("begin", "A"), ("begin", "B"), ("begin", "A"), ("end", False), ("end", False), ("write", "A"), ("end", False)], True),
    "early write": ([("begin", "A"), ("write", "A"), ("begin", "B"), ("begin", "A"), ("end", False), ("end", False), ("end", False)], False),
    "guarded": ([("begin", "A"), ("begin", "B"), ("begin", "A"), ("end", True), ("end", False), ("write", "A"), ("end", False)], False),
    "no re-entry": ([("begin", "A"), ("begin", "B"), ("end", False), ("write", "A"), ("end", False)], False),
    "write inside re-entry": ([("begin", "A"), ("begin", "A"), ("write", "A"), ("end", False), ("end", False)], False),
    "siblings": ([("begin", "A"), ("end", False), ("begin", "A"), ("write", "A"), ("end", False)], False),
}


def brute_reentrancy(events):
    stack, confirmed = [], []
    for i, (kind, x) in enumerate(events):
        if kind == "begin":
            stack.append((x, x in [a for a, _ in stack]))
        elif kind == "end" and stack:
            a, again = stack.pop()
            if again and not x:
                confirmed.append((a, i))
    return {a for a, i in confirmed if any(j >= i and k == "write" and w == a for j, (k, w) in enumerate(events))}


def trace_rows(name, events):
    return [(name, i, k, x if k != "end" else None, x if k == "end" else False) for i, (k, x) in enumerate(events)]


def test_reentrant_traces(spark):
    rnd = random.Random(5)
    cases = {n: e for n, (e, _) in TRACES.items()}
    for n in range(40):
        ev, depth = [], 0
        for _ in range(rnd.randint(4, 24)):
            c = rnd.random()
            if c < 0.45:
                ev.append(("begin", rnd.choice("ABC"))); depth += 1
            elif c < 0.75 and depth:
                ev.append(("end", rnd.random() < 0.3)); depth -= 1
            else:
                ev.append(("write", rnd.choice("ABC")))
        cases[f"random{n}"] = ev + [("end", False)] * depth
    df = spark.createDataFrame([r for n, e in cases.items() for r in trace_rows(n, e)], "trace_id string, seq bigint, kind string, address string, reverted boolean")
    got = {(r["trace_id"], r["address"]) for r in INV.reentrant_traces(df, block=5).collect()}
    assert got == {(n, a) for n, e in cases.items() for a in brute_reentrancy(e)}
    assert {n for n, (_, hit) in TRACES.items() if hit} == {n for n, _ in got if n in TRACES}


def test_bind_names_every_missing_variable(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="a: x, y; b: z"):
        INV.bind_invariants(df, {"a": ["id", "x", "y"], "b": ["z"]})


def random_graph(seed, n=14, m=26):
    rnd = random.Random(seed)
    return sorted({(rnd.randint(0, n - 1), rnd.randint(0, n - 1)) for _ in range(m)})


def closure(edges, start, avoid=None):
    seen, todo = set(), [start] if start != avoid else []
    while todo:
        x = todo.pop()
        if x in seen:
            continue
        seen.add(x)
        todo += [b for a, b in edges if a == x and b != avoid]
    return seen


def test_graph_operators_equal_brute_force(spark):
    graphs = {g: random_graph(g) for g in range(4)}
    rows = [(g, a, b) for g, e in graphs.items() for a, b in e]
    edges = spark.createDataFrame(rows, "graph int, src int, dst int")
    entries = spark.createDataFrame([(g, 0) for g in graphs], "graph int, entry int")
    got = {(r["graph"], r["node"], r["dom"]) for r in G.dominators(edges, entries).collect()}
    want = set()
    for g, e in graphs.items():
        live = closure(e, 0)
        want |= {(g, n, d) for n in live for d in live if n == d or n not in closure(e, 0, avoid=d)}
    assert got == want
    one = edges.filter("graph = 1")
    reach = {r["node"] for r in G.reachable_set(one, spark.createDataFrame([(0,)], "root int")).collect()}
    assert reach == closure(graphs[1], 0)
    pairs = {(r["root"], r["node"]) for r in G.reachable(one, spark.createDataFrame([(0,), (3,)], "root int")).collect()}
    assert pairs == {(s, n) for s in (0, 3) for n in closure(graphs[1], s)}


def test_scope_membership(spark):
    scope = spark.createDataFrame([(e,) for e in ("10.0.0.0/8", "192.168.1.7", "2001:db8::/33", "fe80::1", "Example.com", "1.2.3.4/99", "# note", "0.0.0.0/0 # all?", "x/8")], "entry string")
    parsed = O.parse_scope(scope.filter("entry not like '0.0.0.0%'"))
    hosts = {"10.9.8.7": True, "11.0.0.1": False, "192.168.1.7": True, "192.168.1.8": False, "2001:db8:7fff::1": True, "2001:db8:8000::1": False,
             "fe80::1": True, "fe80::2": False, "api.example.com": True, "notexample.com": False, "localhost": True, "127.9.9.9": True, "::1": True, "1.2.3.4": False}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r["host"]: r["in_scope"] for r in O.in_scope(df, parsed).collect()} == hosts
    everything = O.parse_scope(scope.filter("entry like '0.0.0.0%'"))
    assert O.in_scope(df.filter("host = '11.0.0.1'"), everything).collect()[0]["in_scope"]
    none = O.parse_scope(scope.filter("entry = 'x/8'"))
    assert {r["host"] for r in O.in_scope(df, none).filter("in_scope").collect()} == {"localhost", "127.9.9.9", "::1"}


def test_acceptances(spark):
    f = spark.createDataFrame(
        [(1, "a", "./src/x.py", "m one", "s"), (2, "a", "lib/y.py", "m two", "s"), (3, "b", "src/x.py", "m", "s")],
        "ord int, invariant_id string, file string, message string, snippet string")
    acc = spark.createDataFrame(
        [(1, "a", "src/", None, "a long enough reason", "ann", "2024-05-01"), (2, "a", None, "two", "a long enough reason", "bob", "2024-04-30"),
         (3, "a", None, None, "a long enough reason", "cy", "2024-05-02"), (4, "b", None, None, "a long enough reason", "dee", "2024-04-29")],
        "pos int, id string, path string, match string, reason string, owner string, until string")
    out = {r["ord"]: (r["state"], r["accepted_by"]) for r in RK.accept(f, acc, "2024-05-01").collect()}
    assert out == {1: ("accepted", "ann"), 2: ("accepted", "cy"), 3: ("open", None)}
    assert RK.expired_acceptances(acc, "2024-05-01").count() == 2
    with pytest.raises(ValueError, match="reason too short"):
        RK.require_valid_acceptances(acc.withColumn("reason", F.lit("short")))


def test_ledger_merge_is_idempotent(spark):
    cols = "key string, status string, scans bigint, sha string, title string, kind string"
    old = spark.createDataFrame([("k1", "NEW", 1, "s0", "t", "LEAD"), ("k2", "KNOWN", 4, "s0", "t", "FINDING")], cols)
    rows = spark.createDataFrame([("k1", 1, "s1", "t1", "LEAD"), ("k1", 2, "s1", "t2", "FINDING"), ("k3", 3, "s1", "t", "LEAD")], "key string, ord int, sha string, title string, kind string")
    once = {r["key"]: tuple(r)[1:] for r in FD.ledger_merge(old, rows).collect()}
    assert once == {"k1": ("KNOWN", 2, "s1", "t2", "FINDING"), "k2": ("KNOWN", 4, "s0", "t", "FINDING"), "k3": ("NEW", 1, "s1", "t", "LEAD")}
    again = {r["key"]: tuple(r)[1:] for r in FD.ledger_merge(old, rows.union(rows)).collect()}
    assert again == once


LOCKS = [
    ("Cargo.lock", '[[package]]\nname = "serde"\nversion = "1.0.1"\nsource = "registry+x"\nchecksum = "c"\n\n[[package]]\nname = "rand"\nversion = "0.8.0"\nsource = "registry+x"\n', [("crates.io", "serde", "1.0.1"), ("crates.io", "rand", "0.8.0")]),
    ("a/package-lock.json", '{"packages": {"": {"version": "1"}, "node_modules/x": {"version": "1.2", "resolved": "u"}, "node_modules/x/node_modules/@s/y": {"version": "2.0", "integrity": "i", "resolved": "u", "hasInstallScript": true}}}', [("npm", "x", "1.2"), ("npm", "@s/y", "2.0")]),
    ("b/package-lock.json", '{"dependencies": {"p": {"version": "1", "dependencies": {"q": {"version": "2", "dependencies": {"r": {"version": "3"}}}}}}}', [("npm", "p", "1"), ("npm", "q", "2"), ("npm", "r", "3")]),
    ("yarn.lock", '# yarn\n\n"@a/b@^1.0":\n  version "1.4.0"\n  integrity x\n\nlodash@4.x, lodash@^4:\n  version "4.17.21"\n', [("npm", "@a/b", "1.4.0"), ("npm", "lodash", "4.17.21")]),
    ("requirements-dev.txt", "Flask_Login[x]==1.2 # c\nnumpy>=1\nDjango==4.0\n", [("PyPI", "flask-login", "1.2"), ("PyPI", "django", "4.0")]),
    ("poetry.lock", '[[package]]\nname = "My.Pkg"\nversion = "2"\n', [("PyPI", "my-pkg", "2")]),
    ("Pipfile.lock", '{"default": {"requests": {"version": "==2.0"}}, "develop": {"x": {"version": "==1"}, "y": {}}}', [("PyPI", "requests", "2.0"), ("PyPI", "x", "1")]),
    ("go.sum", "a.b/c v1.2.3 h1:x=\na.b/c v1.2.3/go.mod h1:y=\n", [("Go", "a.b/c", "1.2.3")]),
    ("node_modules/z/Cargo.lock", '[[package]]\nname = "no"\nversion = "1"\n', []),
]


def test_lockfiles(files):
    out = L.read_lockfiles(files([(p, s) for p, s, _ in LOCKS])).collect()
    got = {(r["source_file"], r["ecosystem"], r["name"], r["version"]) for r in out}
    assert got == {(p, *x) for p, _, xs in LOCKS for x in xs}


def test_lockfile_checks(files):
    f = files([(p, s) for p, s, _ in LOCKS])
    missing = {r["path"]: (r["missing"], r["total"]) for r in sca.missing_integrity(f).collect()}
    assert missing == {"Cargo.lock": (1, 2), "a/package-lock.json": (1, 2), "yarn.lock": (1, 2)}
    assert [r["package"] for r in sca.install_scripts(f).collect()] == ["@s/y"]


def test_typosquats(spark):
    names = ["lodahs", "reqeust", "expres", "lodash", "mysql2", "axio", "chalk5", "reacct"]
    df = spark.createDataFrame([("r", "npm", n, "1", "l") for n in names], "repo string, ecosystem string, name string, version string, source_file string")
    assert {r["name"]: r["target"] for r in sca.typosquats(df).collect()} == {"lodahs": "lodash", "reqeust": "request", "expres": "express", "reacct": "react"}


def test_advisory_join_is_an_equi_join(spark):
    df = sca.vulnerable_packages(q_sca.packages(spark, "/root/testdata/sf0.001"), q_sca.advisories(spark, "/root/testdata/sf0.001"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_rustsec_lists(spark):
    text = '```toml\n[advisory]\nid = "R-1"\npackage = "x"\ncvss = "CVSS:3.1/AV:N/C:H/I:H/A:H"\n[versions]\npatched = [\n "^0.3.1",\n ">= 1.0",\n]\nunaffected = ["< 0.1"]\n```\n# Title\n'
    adv = RD.normalize_rustsec(spark.createDataFrame([(text,)], "text string"))
    r = adv.collect()[0]
    assert (r["id"], r["summary"], r["score"], r["patched"], r["unaffected"], r["ranges"]) == ("R-1", "Title", 9.8, ["^0.3.1", ">= 1.0"], ["< 0.1"], [])
    pk = spark.createDataFrame([("r", "crates.io", "x", v, "l") for v in ("0.0.9", "0.2.0", "0.3.5", "1.2.0")], "repo string, ecosystem string, name string, version string, source_file string")
    assert [x["version"] for x in sca.vulnerable_packages(pk, adv).collect()] == ["0.2.0"]


def test_cardinality_keeps_one_sketch_a_rule(spark):
    rows = [(f"r{i % 3}" if i % 3 else None, f"f{i % 50}" if i % 7 else None, f"p{i % 4}") for i in range(600)] + [("none", None, None)]
    got = FD.approx_rule_cardinality(spark.createDataFrame(rows, "invariant_id string, file string, repo string"))
    want = {k: tuple(len({r[c] for r in rows if r[0] == k and r[c]}) for c in (1, 2)) for k in {r[0] for r in rows}}
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == want
    assert all(abs(r[3] - r[1]) <= 1 and abs(r[4] - r[2]) <= 1 for r in got.collect())
    # Rows multiplied for several distinct counts would hold a sketch for every value.
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_invariants_of_one_target_are_many_tasks_work(spark):
    cfg = spark.range(300).select(F.col("id").alias("name"), F.lit("evm").alias("chain"), F.lit("t").alias("target")).unionByName(spark.createDataFrame([(None, "evm", "t"), (1, "evm", None), (2, "sol", "t")], "name long, chain string, target string"))
    con = spark.createDataFrame([(i, "evm", "t") for i in range(20)] + [(7, "evm", None), (8, "sol", "t")], "contract long, chain string, target string")
    got = INV.invariants_for(cfg, con, "evm").withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 301 * 20 == len({(r["name"], r["contract"]) for r in got})
    assert len({r["task"] for r in got}) > 16


def test_requirement_tests_are_many_tasks_work(spark, tmp_path):
    from auditloom.catalog import q_sca

    spark.range(2000).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = q_sca.f7(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 2000 * len(q_sca.REQS) == len({(r["p_partkey"], r["req_no"]) for r in got})
    assert len({r["task"] for r in got}) > 16


def test_advisory_hits_are_not_sorted(spark):
    packages = spark.createDataFrame([("r", "l", "npm", "A", "1.2")], "repo string, source_file string, ecosystem string, name string, version string")
    rng = "array<struct<intro:string,end:string,inclusive:boolean>>"
    adv = spark.createDataFrame(
        [("X", "npm", "a", [("1", "2", False)], [], [], [], 9.5, None), ("X", "npm", "a", [("1", "2", False)], [], [], [], 3.0, "unmaintained"), ("Y", "npm", "a", [("1", "2", False)], [], [], [], 9.5, None)],
        f"id string, ecosystem string, name string, ranges {rng}, versions array<string>, patched array<string>, unaffected array<string>, score double, informational string")
    got = sca.vulnerable_packages(packages, adv)
    assert sorted((r["advisory"], r["invariant_id"], r["severity"]) for r in got.collect()) == [("X", "sca_unmaintained_dependency", "Low"), ("Y", "sca_vulnerable_dependency", "Critical")]
    assert "SortAggregate" not in got._jdf.queryExecution().sparkPlan().toString()


def test_commit_domains_of_many_areas_send_a_row_a_commit(spark):
    from auditloom.operators import history as H

    # 70 areas need two words of bits; one area has no name, as a table may.
    named = [f"area{i:02d}" for i in range(70)]
    areas = spark.createDataFrame(
        [("r", f"p{i % 5}", a) for i, a in enumerate(named)] + [("r", "p1", None), ("s", "p1", "area03"), ("r", "p0", "area00")],
        "repo string, path string, area string",
    )
    touched = spark.createDataFrame(
        [("r", "k1", "p0"), ("r", "k1", "p0"), ("r", "k1", "p1"), ("s", "k1", "p1"), ("r", "k2", "p9"), ("r", None, "p4")],
        "repo string, sha string, path string",
    )
    expect = {("r", "k1", a) for i, a in enumerate(named) if i % 5 < 2} | {("r", "k1", None), ("s", "k1", "area03")}
    expect |= {("r", None, a) for i, a in enumerate(named) if i % 5 == 4}
    found = H.commit_domains(touched, areas)
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expect
    # Commits are grouped before their areas are listed, so no row an area is sent.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or" in plan and not re.search(r"Aggregate \[repo#\d+, sha#\d+, area", plan)
