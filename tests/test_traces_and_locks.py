"""Bracket matching over blocks and lockfiles that cannot be read."""

import json
import random
from collections import defaultdict

from pyspark.sql import functions as F

from auditloom.operators import invariants as INV
from auditloom.sources import lockfiles as L


def _trace(seed):
    rng, rows, open_ = random.Random(seed), [], 0
    for seq in range(rng.randrange(2, 120)):
        kind = rng.choice(["begin", "begin", "end", "end", "write"])
        open_ += (kind == "begin") - (kind == "end")
        rows.append((seed, seq, kind, rng.choice("abc") if kind != "end" else None, rng.random() < 0.3))
    return rows


def _frames(rows):
    stack, out = [], []
    for t, seq, kind, address, reverted in rows:
        if kind == "begin":
            stack.append((seq, address))
        elif kind == "end" and stack:
            b, a = stack.pop()
            out.append((t, a, b, seq, reverted))
    return out


def _reentrant(rows):
    frames, out = _frames(rows), {}
    for t, a, b, e, reverted in frames:
        if not reverted and any(x[1] == a and x[2] < b and x[3] > b for x in frames):
            out[a] = min(e, out.get(a, e))
    last = defaultdict(lambda: -1)
    for _, seq, kind, a, _ in rows:
        if kind == "write":
            last[a] = seq
    return {(rows[0][0], a, e, last[a]) for a, e in out.items() if last[a] >= e}


def test_frames_and_reentries_over_blocks(spark):
    traces = [_trace(s) for s in range(60)]
    # Deep calls that cross many blocks.
    traces.append([(99, i, "begin", "abc"[i % 3], False) for i in range(200)] + [(99, 200 + i, "end", None, i % 2 == 0) for i in range(205)] + [(99, 405, "write", "a", False)])
    df = spark.createDataFrame([r for t in traces for r in t], "trace_id long, seq long, kind string, address string, reverted boolean")
    for block in (7, 64, 100_000):
        got = [tuple(r) for r in INV.call_frames(df, block).collect()]
        assert sorted(got) == sorted(f for t in traces for f in _frames(t))
        got = {tuple(r) for r in INV.reentrant_traces(df, block).collect()}
        assert got == set().union(*map(_reentrant, traces))
    assert INV.reentrant_traces(df.limit(0)).count() == 0


def test_broken_lockfiles_are_told_and_stop_nothing(spark, files):
    deep = {"dependencies": {"x": {"version": "1.0", "dependencies": {"y": {"version": "2.0", "dependencies": {"z": {"version": 3}}}}}}}
    df = files([
        ("a/package-lock.json", json.dumps(deep)), ("b/package-lock.json", "{broken"), ("c/package-lock.json", "[1, 2]"),
        ("d/package-lock.json", json.dumps({"packages": {"": {}, "node_modules/@s/q": {"version": "4.0"}, "node_modules/r": {}}})),
        ("e/Pipfile.lock", "nothing"), ("f/Pipfile.lock", json.dumps({"default": {"One": {"version": "==1.5"}}, "develop": {"two": {}}})),
        ("g/npm-shrinkwrap.json", json.dumps({"dependencies": ["no", "tree"]})), ("h/Cargo.lock", ""), ("node_modules/package-lock.json", "{broken"),
        ("i/package-lock.json", "[" * 100_000), ("j/readme.md", "{broken"), ("k/go.sum", "m v1.2.0 h1:abc\nm v1.2.0/go.mod h1:def\n"),
    ])
    got = {(r["source_file"], r["name"], r["version"]) for r in L.read_lockfiles(df).collect()}
    assert got == {
        ("a/package-lock.json", "x", "1.0"), ("a/package-lock.json", "y", "2.0"), ("d/package-lock.json", "@s/q", "4.0"),
        ("f/Pipfile.lock", "one", "1.5"), ("k/go.sum", "m", "1.2.0"),
    }
    told = {r["path"]: r["reason"] for r in L.rejected_lockfiles(df).collect()}
    assert told.keys() == {"b/package-lock.json", "c/package-lock.json", "e/Pipfile.lock", "i/package-lock.json"}
    assert told["b/package-lock.json"] == told["e/Pipfile.lock"] == "not JSON" and told["c/package-lock.json"] == "no lockfile"
    assert L.parse_lockfiles(df)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 1
    assert L.read_lockfiles(df.filter(F.lit(False))).count() == 0


def test_signals_tell_how_many_paths_they_have(spark, files):
    from auditloom.operators import risk as RK

    df = files([(f"e2e/t{i:02}.js", "") for i in range(12)] + [("src/main.py", "x")])
    rows = {r["signal"]: r for r in RK.repo_signals(df, shown_paths=5).collect()}
    assert rows["e2e-tests"]["n_paths"] == 12 and rows["e2e-tests"]["evidence"] == [f"e2e/t{i:02}.js" for i in range(5)]
    assert rows["codeowners"]["n_paths"] == 0 and not rows["codeowners"]["present"]
    assert len({r["signal"]: r for r in RK.repo_signals(df).collect()}["e2e-tests"]["evidence"]) == 3


def test_a_lockfile_is_parsed_as_json_once(files):
    plan = L.parse_lockfiles(files([("a/package-lock.json", "{}")]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json(") + plan.count("parseJson") == 1


def test_dependency_check_reads_lockfile_entries_once(spark, files, monkeypatch):
    from auditloom.operators import sca
    from auditloom.plans import deps as DP

    calls, entries = [], L.npm_entries
    for module in (DP, L):
        monkeypatch.setattr(module, "npm_entries", lambda df: calls.append(1) or entries(df))
    lock = '{"packages": {"": {}, "node_modules/a": {"version": "1", "resolved": "https://x/a", "hasInstallScript": true}, "node_modules/b": {"version": "2", "resolved": "https://x/b", "integrity": "s"}}}'
    none = spark.createDataFrame([], "id string, ecosystem string, name string, ranges array<struct<intro:string,end:string,inclusive:boolean>>, versions array<string>, patched array<string>, unaffected array<string>, score double, informational string")
    got = {(r["invariant_id"], r["file"], r["message"]) for r in DP.dependency_findings(files([("a/package-lock.json", lock)]), none).collect()}
    assert got == {("sca_lockfile_missing_integrity", "a/package-lock.json", "1 of 2 entries without a hash"), ("sca_install_script_dependency", "a/package-lock.json", "a")}
    assert len(calls) == 1


def test_dependency_check_parses_npm_lockfiles_once(spark, files, monkeypatch):
    from auditloom.plans import deps as DP

    calls, parse = [], F.from_json
    monkeypatch.setattr(L.F, "from_json", lambda c, schema, *a: calls.append(schema) or parse(c, schema, *a))
    lock = '{"packages": {"": {}, "node_modules/a": {"version": "1", "resolved": "https://x/a", "hasInstallScript": true}}}'
    odd = "{'packages': {'node_modules/b': {'version': '1', 'hasInstallScript': true}}}"
    none = spark.createDataFrame([], "id string, ecosystem string, name string, ranges array<struct<intro:string,end:string,inclusive:boolean>>, versions array<string>, patched array<string>, unaffected array<string>, score double, informational string")
    found = DP.dependency_findings(files([("a/package-lock.json", lock), ("vendor/package-lock.json", lock), ("b/package-lock.json", odd)]), none)
    assert calls.count(L.NPM_LOCK) == 1
    # Entries of other people's folders and of loose JSON count as before, packages of these do not.
    got = {(r["file"], r["message"]) for r in found.filter("invariant_id = 'sca_install_script_dependency'").collect()}
    assert got == {("a/package-lock.json", "a"), ("vendor/package-lock.json", "a"), ("b/package-lock.json", "b")}
    assert L.parse_lockfiles(files([("vendor/package-lock.json", lock)])).count() == 0


def test_look_alike_names_are_those_one_edit_or_swap_away(spark):
    from auditloom.operators import sca

    words = ["lodash", "re-act", "aabbcc"]
    names = {"lodash", "lodahs", "oldash", "lodas", "lodashh", "ldash", "lodaxh", "xlodash", "lxodahs", "re_act", "re_atc", "REACT", "react", "aabcbc", "abacbc", "aabbc1", "aabbcc1", "zzzzzz"}
    df = spark.createDataFrame([("r", "npm", n, "1", "f") for n in sorted(names)], "repo string, ecosystem string, name string, version string, source_file string")

    def near(a, b):
        less = lambda x: {x[:i] + x[i + 1 :] for i in range(len(x))}
        swaps = {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
        one = len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1
        return a != b and (one or b in less(a) or a in less(b) or b in swaps)

    want = set()
    for n in names - set(words):
        a = n.lower().replace("_", "-")
        for w in words:
            if len(a) >= 5 and near(a, w) and not (a.startswith(w) and a[len(w) :].isdigit()):
                want.add((n, w))
                break
    assert {(r["name"], r["target"]) for r in sca.typosquats(df, {"npm": words}).collect()} == want and len(want) > 8
