"""Folder trees, streamed documents and upserts of any scan id."""

import json
import os

from pyspark.sql import functions as F

from auditloom.operators import findings as FD
from auditloom.sources import readers as RD, tree, writers as WR
from auditloom.streaming import streams as ST


def test_skipped_folders_are_never_listed_or_opened(spark, tmp_path, monkeypatch):
    for path, text in {
        "r1/a.py": "1", "r1/src/deep/b.py": "é", "r1/node_modules/x/c.js": "no", "r1/src/.git/d": "no", "r2/src/out/e": "no",
        ".git/f": "no", "r2/g.txt": "", "lone.txt": "no",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "r2/bin.dat").write_bytes(b"\xff\xfe\x00")
    reader, listed = tree.TreeReader({"path": str(tmp_path)}), []
    own = tree.TreeReader._list
    monkeypatch.setattr(tree.TreeReader, "_list", lambda self, files, folder: listed.append(folder) or own(self, files, folder))
    rows = [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert not any(s in f.split("/") for f in listed for s in ("node_modules", ".git", "out"))
    want = [("r1", "a.py", "1"), ("r1", "src/deep/b.py", "é"), ("r2", "g.txt", "")]
    assert sorted(rows) == want
    assert sorted(map(tuple, RD.read_corpus(spark, f"file://{tmp_path}").collect())) == want
    empty = tmp_path / "r2" / "none"
    empty.mkdir()
    assert RD.read_corpus(spark, str(empty)).count() == 0


def test_trees_are_written_whole_and_stay_below_their_root(spark, files, tmp_path):
    root = tmp_path / "tree"
    df = files([("a/b.py", "x\n"), ("../../../etc/p", "q"), ("c d/é:%.txt", "\U0001f600"), ("e", None)])
    for _ in range(2):
        tree.write_tree(df, str(root))
    assert sorted(map(tuple, tree.read_tree(spark, str(root)).collect())) == [("etc", "p", "q"), ("r", "a/b.py", "x\n"), ("r", "c d/é:%.txt", "\U0001f600"), ("r", "e", "")]
    assert not [f for _, _, fs in os.walk(tmp_path) for f in fs if f.endswith(".part")]


def test_documents_are_streamed_one_per_repository(spark, tmp_path):
    rows = [(r, f"n{i}", f"{i}", f"pkg:npm/n{i}@{i}") for r, n in (("a/b", 3000), ("é %", 1), (None, 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "repo string, name string, version string, purl string")
    tree.write_sbom_documents(df, str(tmp_path / "s"))
    docs = {p.name: json.loads(p.read_text()) for p in (tmp_path / "s").iterdir()}
    assert {n: len(d["components"]) for n, d in docs.items()} == {"a%2Fb.cdx.json": 3000, "%C3%A9%20%25.cdx.json": 1, "_.cdx.json": 2}
    first = docs["%C3%A9%20%25.cdx.json"]
    assert first["components"] == [{"type": "library", "bom-ref": "pkg:npm/n0@0", "name": "n0", "version": "0", "purl": "pkg:npm/n0@0"}] and first["specVersion"] == "1.5"


def test_upserts_of_odd_scan_ids(spark, tmp_path):
    target = str(tmp_path / "t")
    mk = lambda rows: spark.createDataFrame(rows, "scan_id string, fingerprint string")
    odd = ["a:b", "50%", "x/y", "k=v", "plain", " "]
    WR.upsert_findings(mk([(s, "1") for s in odd]), target)
    WR.upsert_findings(mk([("plain", "2"), ("a:b", "3")]), target, scans=["a:b", "50%", "x/y", "missing", None])
    got = sorted(map(tuple, spark.read.schema("fingerprint string, scan_id string").parquet(target).select("scan_id", "fingerprint").collect()))
    assert got == [(" ", "1"), ("a:b", "3"), ("k=v", "1"), ("plain", "2")]


def test_a_batch_is_scanned_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "t")
    spark.createDataFrame([("x",), ("y",)], "fingerprint string").coalesce(1).write.parquet(source)
    runs = spark.sparkContext.accumulator(0)

    def scan(batch):
        def count(batches):
            for b in batches:
                runs.add(b.num_rows)
                yield b

        return batch.mapInArrow(count, "fingerprint string")

    ST.incremental_scan(spark.readStream.schema("fingerprint string").parquet(source), scan, target)
    assert runs.value == 2 and spark.read.parquet(target).count() == 2


def test_daily_sketches_merge(spark):
    rows = spark.range(60_000).select(
        (F.col("id") % 3).cast("string").alias("invariant_id"), (F.col("id") % 7).alias("d"),
        F.concat(F.lit("f"), (F.col("id") % 20_011).cast("string")).alias("file"), F.concat(F.lit("r"), (F.col("id") % 50).cast("string")).alias("repo"),
    )
    got = FD.sketched_cardinality(FD.rule_sketches(rows, F.col("d"))).collect()
    exact = {r["invariant_id"]: r["n"] for r in rows.groupBy("invariant_id").agg(F.countDistinct("file").alias("n")).collect()}
    assert all(abs(r["approx_files"] / exact[r["invariant_id"]] - 1) < 0.03 and r["approx_repos"] == 50 for r in got) and len(got) == 3
