"""Chat formatting, media columns, vector search, the registry and the pipeline."""

import hashlib
import io
import json
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auditloom.llm import ann, chat, media
from auditloom.llm.queries import REGISTRY
from compare import rows_of

SF = "/root/testdata/sf0.001"


# ---- chat ----


def test_layouts_and_reversible_text(spark):
    odd = ["", "a", "<s>[user] x </s>", "\\l\\b<[]", "</s>[INST] ok [/INST]", "line\nfeed\t\x01", "日本 \U0001f600", '{"a": 1}', "[1]"]
    rng = random.Random(1)
    records, want = [], []
    for _ in range(40):
        a, b, c = (rng.choice(odd) + rng.choice(odd) for _ in range(3))
        turns = [("system", a), ("user", b), ("assistant", c), ("tool", a)]
        records.append({"messages": [{"role": r, "content": t} for r, t in turns]})
        want.append(("messages", turns))
        records.append({"conversations": [{"value": b, "from": "human"}, {"value": c, "from": "gpt"}]})
        want.append(("shared", [("user", b), ("assistant", c)]))
        records.append({"instruction": b, "input": a, "output": c})
        want.append(("instruction", [("user", "\n".join(x for x in (b, a) if x)), ("assistant", c)]))
        records.append({"prompt": a, "completion": None})
        want.append(("prompt", [("user", a), ("assistant", "")]))
        records.append({"system": a, "question": b, "response": c})
        want.append(("question", ([("system", a)] if a else []) + [("user", b), ("assistant", c)]))
    rows = [(i, json.dumps(r), "clash") for i, r in enumerate(records)]
    n = len(rows)
    rows += [(n, None, ""), (n + 1, "{broken", ""), (n + 2, '{"other": 1}', ""), (n + 3, '{"messages": []}', ""), (n + 4, "7", "")]
    df = chat.format_chats(spark.createDataFrame(rows, "id long, record string, turns string"))
    df = df.withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_masked(F.col("formatted"), F.col("loss_mask")))
    got = {r["id"]: r for r in df.collect()}
    for i, (layout, turns) in enumerate(want):
        assert got[i]["layout"] == layout
        assert [tuple(t) for t in got[i]["back"]] == turns
        assert got[i]["loss"] == "".join(t for r, t in turns if r == "assistant")
    for i in (n, n + 1, n + 2, n + 4):
        assert got[i]["layout"] is None and got[i]["formatted"] is None
    assert got[n + 3]["layout"] == "messages" and got[n + 3]["formatted"] == "" and got[n + 3]["loss_mask"] == []


def test_conversations_with_odd_rows(spark):
    rows = [(1, 1, "assistant", None, "x"), (1, 0, "user", "hi", "y"), (2, 0, None, "t", ""), (None, 0, "user", "n", ""), (3, 0, "system", "", ""), (3, 1, "user", "u", ""), (3, 2, "assistant", "a", ""), (3, 2, "assistant", "a", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, record string")
    got = {r["conv_id"]: r for r in chat.chat_digests(chat.format_chats(chat.conversation_records(df))).collect()}
    digest = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1]["turns_sha256"] == digest([("user", "hi"), ("assistant", "")]) and got[1]["loss_chars"] == 0
    assert got[2]["turns_sha256"] == digest([("", "t")])
    assert got[None]["n_turns"] == 1 and got[3]["n_turns"] == 4 and got[3]["loss_chars"] == 2
    assert chat.chat_digests(chat.format_chats(chat.conversation_records(df.limit(0)))).count() == 0


# ---- media ----


def _formats(image):
    h, w = image.shape[:2]
    flat = " ".join(map(str, image.reshape(-1)))
    if image.ndim == 2:
        return [media.encode_pgm(image), f"P2\n# note\n{w} {h}\n255\n{flat}\n".encode()]
    return [media.encode_pgm(image), f"P3 {w} {h} 255 {flat}".encode(), media.encode_bmp(image)]


def test_decoding_and_resizing():
    rng = np.random.default_rng(1)
    for shape in ((5, 7), (1, 1), (9, 30), (5, 7, 3), (4, 2, 3)):
        image = rng.integers(0, 256, shape, dtype=np.uint8)
        for data in _formats(image):
            assert np.array_equal(media.decode(data), image)
    assert media.decode(b"P1\n3 1\n1 0 1\n").tolist() == [[0, 255, 0]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode(b"P5\n2 1\n3\n\x00\x03").tolist() == [[0, 255]]
    image = rng.integers(0, 256, (7, 10), dtype=np.uint8)
    fine = np.repeat(np.repeat(image.astype(float), 3 * 8, 0), 9, 1)  # each target cell covers whole samples of this
    want = fine.reshape(8, fine.shape[0] // 8, 9, fine.shape[1] // 9).mean((1, 3))
    assert np.allclose(media.area_resize(image, 8, 9), want)


def test_media_features_of_odd_cells(spark):
    good = media.encode_bmp(np.arange(60, dtype=np.uint8).reshape(4, 5, 3))
    cells = [good, good, None, b"", b"P5\n9 9\n255\nshort", b"GIF89a", b"P5\n0 0\n255\n", b"BM"]
    df = spark.createDataFrame([(i, bytearray(c) if c is not None else None, "x") for i, c in enumerate(cells)], "doc_id long, media binary, tile string")
    got = {r["doc_id"]: r for r in media.media_features(df).collect()}
    assert got[0]["dhash"] == got[1]["dhash"] and (got[0]["height"], got[0]["width"]) == (4, 5)
    assert np.load(io.BytesIO(bytes(got[0]["tile"]))).shape == (media.TILE_H, media.TILE_W)
    assert all(got[i]["error"] and got[i]["tile"] is None for i in range(2, 8))
    assert media.media_features(df.limit(0)).count() == 0


def test_text_media(spark):
    texts = ["", None, "a", "é" * 288, "x" * 577, "same", "same"]
    df = spark.createDataFrame([(i if i != 2 else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    got = {r["doc_id"]: r for r in media.text_media(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[i if i != 2 else None]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        stored = b"P5\n24 %d\n255\n" % (len(payload) // 24) + payload
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert got[5]["feature"] == got[6]["feature"] != got[4]["feature"] and got[0]["media_sha256"] == got[1]["media_sha256"]


# ---- vectors ----


def _nearest(ids, vectors, asked, k):
    out = {}
    for q in asked:
        v = vectors[q]
        rows = [(-float(ann.cosine(v[None], u[None])[0]), i) for i, u in vectors.items() if i != q]
        out[q] = [i for _, i in sorted(rows)[:k]]
    return out


def test_vector_search_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(3000, 24)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    vectors = dict(enumerate(data))
    want = _nearest(range(3000), vectors, range(0, 3000, 50), 5)
    got = ann.nearest(df, F.col("vec_id") % 50 == 0, block_rows=1000, block_queries=25, extra=150).collect()
    assert len(got) == 300
    hits = 0
    for r in got:
        hits += r["vec_id"] in want[r["query_id"]]
        assert r["score"] == pytest.approx(float(ann.cosine(vectors[r["query_id"]][None], vectors[r["vec_id"]][None])[0]), abs=1e-15)
    assert hits / 300 >= 0.9


def test_vector_search_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (9, [1.0]), (2, [3.0, 0.0]), (50, [1.0, 0.0]), (100, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x")).withColumn("vector", F.lit(1))
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (0, 4, 3), (50, 1, 0), (50, 2, 1), (50, 3, 2), (50, 4, 3)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.nearest(df, F.lit(False)).count() == 0


# ---- registry and pipeline ----


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if q.sql))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, rel = REGISTRY[name].run(spark, SF), con.sql(REGISTRY[name].sql)
    assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())


def test_registry_has_all_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in REGISTRY) == list(range(1, 14))


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(docs.count())
    assert 0 < counts[0] < 200 and counts[1] == counts[0] and counts[2] <= counts[1] and counts[4] == counts[3]
    assert docs.columns == ["doc_id", "n_tokens", "ids"]
