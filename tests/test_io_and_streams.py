"""Readers, writers, streams and extension points."""

import json

import pytest
from pyspark.sql import functions as F

from auditloom import schemas
from auditloom.functions import registry as REG
from auditloom.operators import risk as RK
from auditloom.sources import readers as RD, writers as WR
from auditloom.streaming import streams as ST


def test_read_corpus_drops_binaries_and_skipped_folders(spark, tmp_path):
    for rel, data in (("one/src/a.py", b"x = 1\n"), ("one/node_modules/b.js", b"no"), ("two/c.bin", b"\xff\xfe\x00"), ("two/d.txt", "é".encode())):
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    rows = RD.read_corpus(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows)) == [("one", "src/a.py", "x = 1\n"), ("two", "d.txt", "é")]


def test_reports_by_kind(spark, tmp_path):
    f = {"invariant_id": "a", "severity": "High", "file": "x", "line": 1}
    for i, ran in enumerate((True, False)):
        (tmp_path / f"{i}.json").write_text(json.dumps({"repo": f"r{i}", "ran": ran, "findings": [f, f]}))
    rows = RD.read_findings_json(spark, str(tmp_path / "0.json"), "symbolic").collect()
    assert [(r["repo"], r["ord"]) for r in rows] == [("r0", 0), ("r0", 1)]
    with pytest.raises(Exception, match="did not run: r1"):
        RD.read_findings_json(spark, str(tmp_path), "symbolic").collect()
    (tmp_path / "2.json").write_text(json.dumps({"repo": "r2", "findings": [f]}))
    assert RD.read_findings_json(spark, str(tmp_path / "2.json")).count() == 1


def test_corpus_root_with_odd_characters(spark, tmp_path):
    p = tmp_path / "a+b (c).d" / "one" / "x.py"
    p.parent.mkdir(parents=True)
    p.write_bytes(b"1")
    assert [tuple(r) for r in RD.read_corpus(spark, str(tmp_path / "a+b (c).d") + "/").collect()] == [("one", "x.py", "1")]


def test_scan_without_findings_clears_its_old_ones(spark, tmp_path):
    target = str(tmp_path / "t")
    mk = lambda rows: spark.createDataFrame(rows, "scan_id string, fingerprint string, severity string")
    WR.upsert_findings(mk([("a", "1", "High"), ("b", "1", "Low"), ("b", "1", "High")]), target)
    WR.upsert_findings(mk([("c", "1", "High")]), target, scans=["a", "c", "new"])
    assert sorted(map(tuple, spark.read.parquet(target).select("scan_id", "fingerprint", "severity").collect())) == [("b", "1", "High"), ("c", "1", "High")]


def test_stateful_streams_go_on_where_they_stopped(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k string, t int, v int"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda: ST.stream_monotonic(spark.readStream.schema(schema).parquet(source), ["k"], ["t"], "v", out, F.floor(F.col("t") / 10))
    put([("a", 1, 5), (None, 1, 9)])
    run()
    put([("a", 2, 3), (None, 2, 8), ("b", 1, 1)])
    run()
    run()
    put([("b", 2, 0), ("a", 3, 4)])
    run()
    got = sorted((str(r["k"]), r["t"], r["prev"]) for r in spark.read.parquet(out).collect())
    assert got == [("None", 2, 9), ("a", 2, 5), ("b", 2, 1)]
    assert len([p for p in (tmp_path / "out-state").iterdir()]) == 2


def test_incremental_scans_number_on(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "t")
    put = lambda rows: spark.createDataFrame(rows, "fingerprint string").coalesce(1).write.mode("append").parquet(source)
    run = lambda: ST.incremental_scan(spark.readStream.schema("fingerprint string").parquet(source), lambda b: b, target)
    put([("x",)])
    run()
    put([("x",), ("y",)])
    run()
    assert sorted(map(tuple, spark.read.parquet(target).select("scan_id", "fingerprint").collect())) == [(0, "x"), (1, "x"), (1, "y")]


def test_every_alert_reaches_sinks_without_a_filter(spark):
    alerts = spark.createDataFrame([(1, "high"), (2, None), (3, "High")], "ord int, severity string")
    sinks = spark.createDataFrame([("all", "file", None), ("none", "file", []), ("some", "slack", ["High", "High"])], "sink string, type string, severities array<string>")
    got = sorted((r["ord"], r["sink"]) for r in ST.route_alerts(alerts, sinks).collect())
    assert got == [(1, "all"), (1, "none"), (2, "all"), (2, "none"), (3, "all"), (3, "none"), (3, "some")]


def test_commit_log(spark, tmp_path):
    sep = "<<SEP>>"
    log = "".join(
        f"COMMIT_START{sep}{sha}{sep}{sha[:3]}{sep}2024-01-0{i}T10:00:00Z{sep}ann{sep}{parents}{sep}fix: {sha}\n\n{stat}\n"
        for i, (sha, parents, stat) in enumerate((("abc1", "p", "3\t1\tsrc/a.sol\n-\t-\tlogo.png"), ("def2", "p q", "1\t0\ttest/a.t.sol")), 1))
    (tmp_path / "log.txt").write_text(log)
    commits, files = RD.read_commits(spark, str(tmp_path / "log.txt"), "src/")
    assert sorted((r["sha"], r["is_merge"], str(r["date"])) for r in commits.collect()) == [("abc1", False, "2024-01-01"), ("def2", True, "2024-01-02")]
    got = {r["path"]: (r["added"], r["deleted"], r["is_source"], r["is_test"]) for r in files.collect()}
    assert got == {"src/a.sol": (3, 1, True, False), "logo.png": (0, 0, False, False), "test/a.t.sol": (1, 0, False, True)}


@pytest.fixture(scope="module")
def findings(spark):
    rows = [("r", i, rule, sev, f"f{i}", i, 0, 'say "hi", now', "s", "lead") for i, (rule, sev) in enumerate(
        (("gen_xss_sink", "Medium"), ("gen_sql_injection", "High"), ("gen_xss_sink", "High"), ("none_such", "Info")), 1)]
    return spark.createDataFrame(rows, schemas.FINDING)


def test_csv_quotes_every_field(spark, findings, tmp_path):
    WR.write_csv(findings, RK.taxonomy_table(spark), str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*.csv"))
    assert '"Medium","gen_xss_sink","CWE-79","","","f1","1","say ""hi"", now"' in text


def test_sarif_indexes_resolve(spark, findings):
    rules, results, taxa = WR.sarif_tables(findings, RK.taxonomy_table(spark))
    catalogue = {r["rule_index"]: r["invariant_id"] for r in rules.collect()}
    assert catalogue == {0: "gen_xss_sink", 1: "gen_sql_injection", 2: "none_such"}
    assert all(catalogue[r["rule_index"]] == r["invariant_id"] for r in results.collect())
    assert [(r["cwe"], r["taxon_index"]) for r in taxa.orderBy("taxon_index").collect()] == [("CWE-79", 0), ("CWE-89", 1)]


def test_upsert_replaces_only_the_scans_given(spark, tmp_path):
    target = str(tmp_path / "t")
    row = lambda s, f, v: (s, f, v)
    mk = lambda rows: spark.createDataFrame(rows, "scan_id string, fingerprint string, severity string")
    WR.upsert_findings(mk([row("a", "1", "High"), row("a", "2", "Low"), row("b", "1", "High")]), target)
    WR.upsert_findings(mk([row("a", "3", "High"), row("a", "3", "High")]), target)
    rows = spark.read.parquet(target).select("scan_id", "fingerprint").collect()
    assert sorted(map(tuple, rows)) == [("a", "3"), ("b", "1")]


def stream_of(spark, path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
        import time

        time.sleep(1.1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_monotonic_state_crosses_batches_and_restarts(spark, tmp_path):
    schema = "k string, t int, v int"
    batches = [[("a", 1, 5), ("b", 1, 9)], [("a", 2, 4), ("b", 2, None)], [("a", 3, 6), ("b", 3, 8)]]
    s = stream_of(spark, tmp_path / "in", batches, schema)
    ST.stream_monotonic(s, ["k"], ["t"], "v", str(tmp_path / "out"), F.col("t"))
    rows = spark.read.parquet(str(tmp_path / "out")).select("k", "t", "v", "prev").collect()
    assert sorted(map(tuple, rows)) == [("a", 2, 4, 5), ("b", 3, 8, 9)]


def test_unknown_sink_stops_delivery(spark, tmp_path):
    s = stream_of(spark, tmp_path / "in", [[("x", "High")]], "id string, severity string")
    sinks = spark.createDataFrame([("s", "carrier-pigeon", None)], "sink string, type string, severities array<string>")
    with pytest.raises(ValueError, match="carrier-pigeon"):
        ST.deliver(s, sinks, lambda rows, no: None)


def test_throttle_from_last_sent(spark):
    rows = [("a", f"2024-01-01 00:0{m}:00") for m in (0, 2, 4, 5, 9)]
    df = spark.createDataFrame(rows, "id string, t string").select("id", F.to_timestamp("t").alias("ts"))
    got = [str(r["ts"])[14:16] for r in ST.throttle_from_last_sent(df, ["id"], 300).orderBy("ts").collect()]
    assert got == ["00", "05"]


def test_pluggable_detector(spark, files):
    def check(source, path):
        if "boom" in source:
            yield "boom", "High", 1, f"in {path}"

    out = REG.run_detector(files([("a", "boom"), ("b", "calm")]), REG.detector(check)).collect()
    assert [(r["file"], r["invariant_id"]) for r in out] == [("a", "boom")]


def test_user_rules_come_from_a_file(spark, files, tmp_path):
    from auditloom.operators.rules import scan_files

    rule = {"rule_id": "mine", "kinds": ["Python"], "severity": "Low", "pattern": "forbidden", "message": "m", "near_before": 1, "near_after": 0, "near_lacks": "excused"}
    (tmp_path / "r.json").write_text(json.dumps(rule))
    rules = RD.read_rules(spark, str(tmp_path / "r.json"))
    out = scan_files(files([("a.py", "forbidden\nexcused\nforbidden\n"), ("b.js", "forbidden")]), rules).collect()
    assert [(r["file"], r["line"]) for r in out] == [("a.py", 1)]


def test_a_batch_of_one_file_is_scanned_by_many_tasks(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(200).selectExpr("cast(id as string) fingerprint").coalesce(1).write.parquet(source)
    scan = lambda b: b.withColumn("task", F.spark_partition_id())
    ST.incremental_scan(spark.readStream.schema("fingerprint string").parquet(source), scan, target)
    rows = spark.read.parquet(target)
    assert rows.select("task").distinct().count() > 8
    assert sorted(int(r["fingerprint"]) for r in rows.collect()) == list(range(200))
