"""Components, dominators, gram and block joins, leases and throttles against plain versions."""

import ipaddress
import random
import time
from collections import Counter, defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from auditloom.operators import graph as G, observe as O, rules as R
from auditloom.streaming import stateful, streams as ST


def _reach(edges, start, avoid=None):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
    seen, todo = set(), [start]
    while todo:
        x = todo.pop()
        if x not in seen and x != avoid:
            seen.add(x)
            todo += near[x]
    return seen


def _edges(seed, n=14, m=24):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


def test_components_and_closures(spark):
    edges = _edges(1, 40, 55) + [(100, 101), (101, 102), (102, 100), (102, 103), (200, 200)]
    df = spark.createDataFrame(edges + [(None, 3), (3, None)], "src long, dst long")
    nodes = {x for e in edges for x in e}
    reach = {x: _reach(edges, x) for x in nodes}
    comps = {r["node"]: r["comp"] for r in G.strong_components(df).collect()}
    assert comps.keys() == nodes
    for x in nodes:
        assert {y for y in nodes if comps[y] == comps[x]} == {y for y in reach[x] if x in reach[y]}
    calls = spark.createDataFrame(edges, "src long, dst long")
    muts = [(x, f"v{x % 5}") for x in nodes if x % 3 == 0] + [(999, "lone")]
    functions = spark.createDataFrame([(x,) for x in [*nodes, 999, 998]], "function long")
    got = {tuple(r) for r in G.transitive_mutations(calls, spark.createDataFrame(muts, "function long, variable string"), functions).collect()}
    assert got == {(x, v) for x in nodes for y, v in muts if y in reach[x]} | {(999, "lone")}
    asked = spark.createDataFrame([(x,) for x in nodes], "variable long")
    got = [tuple(r) for r in G.transitive_dependents(calls, asked).collect()]
    assert len(got) == len(set(got)) and set(got) == {(x, y) for x in nodes for y in reach[x] if x != y}
    assert G.strong_components(df.limit(0)).count() == 0


def test_dominators_and_loops(spark):
    graphs = {g: _edges(g + 20) for g in range(8)} | {8: [(0, 0)], 9: [(3, 4), (4, 3)], 10: [(0, 1), (1, 2), (3, 2), (4, 3), (3, 4)]}
    edges = spark.createDataFrame([(g, *e) for g, es in graphs.items() for e in es], "graph int, src int, dst int")
    entries = spark.createDataFrame([(g, 0) for g in graphs], "graph int, entry int")
    dom = {(g, n): {d for d in _reach(es, 0) if n == d or n not in _reach(es, 0, avoid=d)} for g, es in graphs.items() for n in _reach(es, 0)}
    got = defaultdict(list)
    for r in G.dominators(edges, entries).collect():
        got[r["graph"], r["node"]].append(r["dom"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in dom.items()}
    loops = {tuple(r) for r in G.loops(edges, entries).select("graph", "src", "dst").collect()}
    assert loops == {(g, a, b) for g, es in graphs.items() for a, b in es if (g, a) in dom and b in dom[g, a]}


def test_dominators_of_a_long_chain_need_few_rounds(spark, monkeypatch):
    n, rounds = 3000, []
    counted = G.cut_counted
    monkeypatch.setattr(G, "cut_counted", lambda *a: rounds.append(1) or counted(*a))
    chain = spark.range(n).select(F.lit(1).alias("graph"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    # Every tenth node can also be reached past the one before it.
    skips = spark.range(0, n - 2, 10).select(F.lit(1).alias("graph"), F.col("id").alias("src"), (F.col("id") + 2).alias("dst"))
    entry = spark.createDataFrame([(1, 0)], "graph int, entry long")
    got = {r["node"]: r["idom"] for r in G.immediate_dominators(chain.unionByName(skips), entry).collect()}
    assert got == {i: i - 2 if i % 10 == 2 and i - 2 < n - 2 else i - 1 for i in range(1, n + 1)}
    assert len(rounds) < 100


def test_dominators_send_no_node_table_through_the_driver(spark, monkeypatch):
    plans, counted = [], G.cut_counted
    monkeypatch.setattr(G, "cut_counted", lambda df, *a: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or counted(df, *a))
    monkeypatch.setattr(G, "cut_lineage", lambda df, *a: G.cut_counted(df, *a)[0])
    rows = [(1, i, j) for i in range(30) for j in (2 * i, 2 * i + 1, i // 3) if 0 < j < 30 and i]
    edges, entry = spark.createDataFrame(rows, "graph int, src long, dst long"), spark.createDataFrame([(1, 1)], "graph int, entry long")
    found = G.loops(edges, entry)
    plans.append(found._jdf.queryExecution().sparkPlan().toString())
    back = {(a, b) for _, a, b in rows if b in {a >> s for s in range(6)}}
    assert {(r["src"], r["dst"]) for r in found.collect()} >= {x for x in back if x[1] == 1}
    # What may still be broadcast holds a row a graph: its entry.
    assert sum(p.count("SortMergeJoin") for p in plans) > 20
    assert sum(p.count("BroadcastHashJoin") for p in plans) <= 5


def test_pattern_scan_meets_by_grams(spark, files):
    needles = ["call.value(", "tx.origin", "a", "ab", "", None, "日本語の", "x" * 300, "selfdestruct", "tx.o"]
    db = spark.createDataFrame([(f"p{i}", t, ["evm"], float(i)) for i, t in enumerate(needles)] + [("q", "tx.origin", ["sol"], 9.0), ("p9b", "tx.origin", ["evm"], 9.5)], "pattern_id string, needle string, chains array<string>, score double")
    texts = ["if tx.origin == a", "", "xx" * 200, "これは日本語のです", "selfdestruct(call.value(1))", "tx.o", "a" * 5000]
    src = files([("one.sol", "\n".join(texts)), ("two.sol", "tx.origin tx.origin")])
    scan = R.pattern_db_scan(src, db, "evm")
    plan = scan._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "NestedLoop" not in scan._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["path"], r["line"], r["pattern_id"]) for r in scan.collect())
    lines = [("one.sol", i, t) for i, t in enumerate(texts, 1)] + [("two.sol", 1, "tx.origin tx.origin")]
    named = [(f"p{i}", t) for i, t in enumerate(needles)] + [("p9b", "tx.origin")]
    assert got == sorted((p, i, k) for p, i, text in lines for k, t in named if t is not None and t in text)
    assert R.pattern_db_scan(src, db.limit(0), "evm").count() == 0


def test_scope_blocks(spark):
    rng = random.Random(3)
    nets = [f"{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.0/{rng.randrange(4, 33)}" for _ in range(200)] + ["2001:db8::/29", "2001:db8:1::/65", "fe80::5"]
    hosts = [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(400)] + ["2001:db9::1", "2001:dbf::", "2001:dc0::", "2001:db8:1::ffff", "2001:db8:1:0:8000::", "fe80::5", "fe80::6"]
    scope = O.parse_scope(spark.createDataFrame([(n,) for n in nets], "entry string"))
    got = {r["host"]: r["in_scope"] for r in O.in_scope(spark.createDataFrame([(h,) for h in hosts], "host string"), scope).collect()}
    parsed = [ipaddress.ip_network(n, strict=False) for n in nets]
    want = {h: any(ipaddress.ip_address(h) in n for n in parsed if n.version == ipaddress.ip_address(h).version) or h.startswith("127.") or h == "0.0.0.0" for h in hosts}
    assert got == want
    every = O.parse_scope(spark.createDataFrame([("0.0.0.0/0",), ("10.0.0.0/8",)], "entry string"))
    assert O.in_scope(spark.createDataFrame([(h,) for h in hosts], "host string"), every).filter("in_scope").count() == 400


T0 = datetime(2024, 1, 1)


def _slices(spark, path, slices, schema):
    """One file a slice, in the order of time."""
    for rows in slices:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_leases_end_in_silence_and_after_a_restart(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    schema = "scan_id long, status string, attempts long, claimed_at timestamp, seen_at timestamp"
    first = [(1, "processing", 1, at(0), at(0)), (2, "processing", 3, at(0), at(0)), (3, "processing", 0, at(1), at(1)), (4, "processing", None, at(2), at(2)), (5, "processing", 0, None, at(2)), (6, "queued", 0, None, at(2))]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    ST.stream_expire_leases(_slices(spark, src, [first, [(3, "complete", 0, at(1), at(5))]], schema), out)
    assert spark.read.parquet(out).filter("next_status in ('failed', 'queued') and scan_id <> 6").count() == 0
    # A new query over the same place: only time passes, by an event of another scan.
    got = ST.stream_expire_leases(_slices(spark, src, [[(7, "queued", 0, at(40), at(40))]], schema), out)
    last = {r["scan_id"]: r["s"] for r in got.groupBy("scan_id").agg(F.max_by("next_status", "at").alias("s")).collect()}
    assert last == {1: "queued", 2: "failed", 3: "complete", 4: "queued", 5: "processing", 6: "queued", 7: "queued"}


def test_leases_are_handled_many_at_once(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    schema, rng = "scan_id long, status string, attempts long, claimed_at timestamp, seen_at timestamp", random.Random(3)
    big = 1 << 60
    one = lambda i, lo: (big + i if i else None, rng.choice(["processing", "processing", "queued"]), rng.choice([0, 2, 3, None]), rng.choice([None, at(lo), at(lo + 5)]))
    slices = [rng.sample([(*one(i % 700, lo), at(lo + i * 0.06)) for i in range(900)], 900) for lo in (0, 70, 900, 1700)]
    want = Counter()
    running, high = {}, None

    def expire():
        for k, (ends, attempts) in list(running.items()):
            if ends < high - timedelta(minutes=1):
                want[(k, "queued" if attempts < 3 else "failed", ends)] += 1
                del running[k]

    for rows in [*slices, []]:
        for k, status, attempts, claimed, seen in sorted(rows, key=lambda r: r[4]):
            want[(k, status, seen)] += 1
            running.pop(k, None)
            if status == "processing" and claimed:
                running[k] = (claimed + timedelta(minutes=10), attempts or 0)
        if high:
            expire()
        high = max([high or T0, *[r[4] for r in rows]])
    stream = _slices(spark, str(tmp_path / "in"), slices, schema)
    with stateful.keyed_store(spark):
        out = ST.run_to_table(stateful.lease_changes(stream, shares=3), "t", str(tmp_path / "out"))
    assert Counter(map(tuple, out.collect())) == want


def _sent(times, quiet):
    out = []
    for t in sorted(times):
        if not out or t >= out[-1] + quiet:
            out.append(t)
    return out


def test_throttles_count_from_the_last_sending(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(3), T0 + timedelta(seconds=rng.randrange(4000))) for _ in range(600)]
    rows.append(("a", 1, None))
    want = set()
    for k in {r[:2] for r in rows}:
        want |= {(*k, t) for t in _sent([r[2] for r in rows if r[:2] == k and r[2]], timedelta(seconds=90))}
    schema = "id string, n long, ts timestamp"
    table = spark.createDataFrame(rows, schema)
    got = [tuple(r) for r in ST.throttle_from_last_sent(table, ["id", "n"], 90).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    cut = T0 + timedelta(seconds=2000)
    parts = [[r for r in rows if r[2] is None or r[2] < cut], [r for r in rows if r[2] and r[2] >= cut]]
    stream = _slices(spark, str(tmp_path / "in"), parts, schema)
    with stateful.keyed_store(spark):
        got = ST.run_to_table(stateful.throttle_stream(stream, ["id", "n"], 90), "t", str(tmp_path / "out"))
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame(sorted(want, key=str), schema).collect()))
    assert ST.throttle_from_last_sent(table.limit(0), ["id", "n"], 90).count() == 0


def test_many_acceptances_of_one_rule(spark):
    from auditloom.operators import risk as RK

    rng = random.Random(6)
    names = ["src/a", "./src/a", "lib", "", "./", "b.py", "rc/a", None, "zzz/none", "é/ü"]
    texts = [None, None, "tok", "", "no such text", "ü"]
    acc = [(i, rng.choice("RS"), rng.choice(names), rng.choice(texts), "accepted for now", f"o{i}", rng.choice(["2024-01-01", "2024-03-01"])) for i in range(3, 60)]
    acc += [(1000 + i, "T", f"pkg{i}/x", None, "accepted for now", f"t{i}", "2024-03-01") for i in range(3000)]
    rows = [(i, rng.choice("RSQ"), rng.choice(["src/a/b.py", "./src/a", "lib/x", None, "x./src/a", "é/ü.py", "q"]), rng.choice(["has tok", "", None, "ü"]), rng.choice(["tok", None, "s"])) for i in range(300)]
    rows += [(1000 + i, "T", f"./pkg{i * 7}/x/y", "m", "s") for i in range(500)]
    got = RK.accept(
        spark.createDataFrame(rows, "ord long, invariant_id string, file string, message string, snippet string"),
        spark.createDataFrame(acc, "pos long, id string, path string, `match` string, reason string, owner string, until string"), "2024-02-01",
    )
    bare = lambda p: p[2 * ((len(p) - len(__import__("re").sub(r"^(\./)+", "", p))) // 2):]

    def covers(a, f):
        path = a[2] is None or f[2] is not None and (bare(f[2]).startswith(bare(a[2])) or a[2] in bare(f[2]))
        return a[1] == f[1] and a[6] >= "2024-02-01" and path and (a[3] is None or any(t is not None and a[3] in t for t in f[3:5]))

    rules = defaultdict(list)
    for a in sorted(acc, key=lambda a: a[0]):
        rules[a[1]].append(a)
    want = {f[0]: next((a[5] for a in rules[f[1]] if covers(a, f)), None) for f in rows}
    assert {r["ord"]: r["accepted_by"] for r in got.collect()} == want
    assert got.count() == len(rows)
