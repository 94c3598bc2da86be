"""URL verdicts, tokenizer alignment and the Merkle manifest against plain versions."""

import functools
import hashlib
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from auditloom.llm import align, manifest, url_rules

SF = "/root/testdata/sf0.001"

# ---- URL verdicts ----

PAGES = [
    (1, "https://a.org/x", '<html><link rel="canonical" href="http://EXAMPLE.com/en/1">', "block", None),
    (2, "http://www.example.com/en/1", '<meta http-equiv=refresh content="0; url=/de/../en/2">', "allow", "www.example.com/en/"),
    (3, None, "<link rel=canonical href='http://x.net/es/1'>", "allow", None),
    (4, "nohost", "x", "allow", None),
    (5, "https://b.org/y", "<!-- <link rel='canonical' href='http://q.net/es/2'> -->", "allow", None),
    (6, "https://c.org/z?a=1#f", "<LINK href='//q.net/es/2' rel='x canonical'>", "block", None),
    (7, "https://c.org/z?a=1", "", "block", None),
    (8, "https://a.org/x", None, "block", None),
    (9, "http://NET/es/", "", "block", "net/es/"),
    (10, "http://knet/es/", "", "allow", None),
    (11, "http://example.com", "", "allow", None),
    (12, "http://e.org/a/b", "<meta content='5;URL=c/./d?x=1' http-equiv='Refresh'>", "block", None),
    (13, "http://e.org/a/c/d?x=1", "<link rel=canonical href=http://z.net/fr/>", "block", None),
    # The component of page 1 has a blocked url, yet this one is explicitly allowed.
    (14, "http://ok.com/", "<link rel=canonical href='https://a.org/x'>", "allow", "com/"),
    (15, "", None, "allow", None),
    (15, "", None, "allow", None),
    (16, "https://d.org/" + "long/" * 3000, "<p>" * 100_000 + "<link rel=canonical href='?'>", "allow", None),
]


def _pages(spark):
    return spark.createDataFrame([r[:3] + (7,) for r in PAGES], "page_id long, url string, html string, rule int")


def test_verdicts_follow_rules_and_aliases(spark):
    got = url_rules.judge(_pages(spark), url_rules.rules_table(spark))
    assert got.columns == ["page_id", "url", "html", "host", "path", "rule", "verdict"]
    want = sorted((r[0], r[3], r[4] or "") for r in PAGES)
    assert sorted((r["page_id"], r["verdict"], r["rule"] or "") for r in got.collect()) == want
    rows = {r["page_id"]: (r["host"], r["path"]) for r in got.collect()}
    assert rows[3] == rows[4] == rows[15] == ("", "") and rows[9] == ("net", "/es/") and rows[6] == ("c.org", "/z")


def test_verdicts_of_odd_tables(spark):
    rules = url_rules.rules_table(spark)
    assert url_rules.judge(_pages(spark).limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_rules.judge(_pages(spark), rules.limit(0)).collect()} == {"allow"}
    odd = url_rules.rules_table(spark, [(None, "/", "block"), ("a.org", None, "block"), ("a.org", "/x", "block"), ("a.org", "/x", "allow")])
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(_pages(spark), odd).collect()}
    assert set(got.values()) == {"allow"}


def test_aliases_over_a_crawl_log_match_a_plain_search(spark):
    rng = random.Random(5)
    urls = [f"http://h{i}.org/" for i in range(60)] + [f"http://h{i}.net/es/" for i in range(6)] + [f"http://h{i}.com/" for i in range(20)]
    links = [(rng.choice(urls), rng.choice(urls)) for _ in range(60)]
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    bad = [u for u in urls if ".net/es/" in u]
    seen, todo = set(bad), list(bad)
    while todo:
        todo += [v for v in near[todo.pop()] if v not in seen and not seen.add(v)]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    log = url_rules.link_edges(spark.createDataFrame(links, "from_url string, to_url string"))
    got = {r["url"]: r["verdict"] for r in url_rules.judge(pages, url_rules.rules_table(spark), log).collect()}
    assert got == {u: "block" if u in seen and ".com" not in u else "allow" for u in urls}


# ---- tokenizer alignment ----

TEXTS = [
    "", None, "x", "a▁b", " ", "  \n\n x  y", "<|endoftext|> <s> </s> <0x41>", "日本語" * 50, "é" * 40, "ab" * 3000, "😀 😀 x " * 30,
    "don't we'll " * 200, "a\x00b", "word " * 2000, "1234567890" * 40,
]


def _spans(raw):
    out, at = [], 0
    for r in raw:
        out.append((at, at + len(r)))
        at += len(r)
    return out


def _alignments(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(align.BYTE_BPE)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=align.PIECES)
    letters, names = align._byte_letters(), {i: t for t, i in a_side.get_vocab().items()}
    found, counts = [], Counter()
    for i, text in rows:
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        raw_a = [bytes(letters[c] for c in names[x]) for x in a]
        raw_b = [bytes([int(b_side.id_to_piece(x)[3:5], 16)]) if b_side.is_byte(x) else b_side.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            found.append((str(i), 0, 0, 0, [], ""))
            continue
        at_a, at_b, links, first = _spans(raw_a), _spans(raw_b), [], 0
        for x, (lo, hi) in zip(a, at_a):
            while at_b[first][1] <= lo:
                first += 1
            k = first
            while k < len(b) and at_b[k][0] < hi:
                links.append((x, b[k]))
                k += 1
        groups, p, q = [], 0, 0
        for end in sorted({e for _, e in at_a} & {e for _, e in at_b}):
            p2, q2 = p, q
            while p2 < len(a) and at_a[p2][1] <= end:
                p2 += 1
            while q2 < len(b) and at_b[q2][1] <= end:
                q2 += 1
            groups.append(",".join(map(str, a[p:p2])) + "|" + ",".join(map(str, b[q:q2])))
            p, q = p2, q2
        counts.update(links)
        found.append((str(i), len(a), len(b), len(groups), links, ";".join(groups)))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return sorted((*f[:4], len(f[4]), sum(counts[x] == best[x[1]] for x in f[4]), sum(counts[x] for x in f[4]), f[5]) for f in found)


def test_alignment_matches_a_plain_version(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10**6 + i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (10**6, "again"), (5, "same"), (5, "same")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, groups string")
    want = _alignments(rows)
    # Whole texts at once, and nearly all of them as fragments of 64 bytes that cut groups, composed three at a time.
    for how in ({}, {"piece": 500, "size": 64, "fan": 3, "block": 5000}):
        got = align.align(docs, **how)
        assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want
    digests = {(str(r[0]), r["groups"]) for r in align.align(docs, written=False).collect()}
    assert digests == {(w[0], hashlib.sha256(w[7].encode()).hexdigest() if w[1] else "") for w in want}
    assert align.align(docs.limit(0)).count() == 0


def test_texts_that_are_no_utf8(spark):
    docs = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text UNION ALL SELECT 2L, 'fine' UNION ALL SELECT 3L, cast(concat(X'FF', cast(repeat('a b ', 500) AS binary)) AS string)")
    got = {r["doc_id"]: r["n_links"] for r in align.align(docs, piece=100).collect()}
    assert got[1] == got[3] == 0 < got[2]


def test_composing_fragments_is_associative():
    rng = random.Random(7)
    a, b = align.byte_level(align.BYTE_BPE), align.piece_level(align.PIECES)
    for text in (" don't naïve 日本語 <b> tokenisation  of\nodd wörds" * 9, " " + "".join(rng.choice("abé日 .\n") for _ in range(900))):
        coded = align.encode_both([text], a, b)[0]
        (ia, ea), (ib, eb) = (align._flat([c], s.size) for c, s in zip(coded, (a, b)))
        whole = vars(align.finished(align.fragment(ia, ea, ib, eb)))
        for size in (1, 2, 5, 17, 100):
            parts = []
            for lo in range(0, int(ea[-1]), size):
                ka, kb = (ea > lo) & (ea <= lo + size), (eb > lo) & (eb <= lo + size)
                parts.append(align.fragment(ia[ka], ea[ka], ib[kb], eb[kb]))
            ways = [functools.reduce(align.compose, parts), functools.reduce(lambda y, x: align.compose(x, y), reversed(parts))]
            while len(parts) > 1:
                k = rng.randrange(len(parts) - 1)
                parts[k : k + 2] = [align.compose(parts[k], parts[k + 1])]
            for w in (*ways, parts[0]):
                got = vars(align.finished(w))
                assert all(list(got[k]) == list(whole[k]) if hasattr(got[k], "__len__") else got[k] == whole[k] for k in whole)


# ---- Merkle manifest ----


def _hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _hash(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def _levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([_hash(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def _path(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 3 * 3 : i // 3 * 3 + 3]
        out.append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        i //= 3
    return out


def _manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
    trees = {s: _levels([_leaf(r) for r in by[s]]) for s in order}
    top = _levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            path = _path(trees[s], i) + _path(top, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            h = _leaf((*r[:4], r[4].replace("\n", ""))) if hit else _leaf(r)
            for before, after in path:
                h = _hash(before, h, after)
            out.append((str(r[0]), _leaf(r), trees[s][-1][0], top[-1][0], _hash(*[x + y for x, y in path]), h, h == top[-1][0]))
    return sorted(out)


def test_manifest_matches_a_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    rows += [(None, None, None, None, None), (1, None, "", 0, ""), (2, "", "a", None, "x\ny"), (2, "", "a", None, "x\ny"), (2, "", "a", None, "z\n"), (-7, "é", "a", 1, "\n" * 50_000)]
    rows += [(i, "\U0001f600" if i % 2 else "￿", "l", i, f"t\n{i}") for i in range(100)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string")
    want = _manifest(rows)
    for digits in (manifest.DIGITS, 1, 2):  # one block a source, and blocks of blocks
        got = manifest.document_manifest(docs, digits)
        assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want
    for few in (docs.limit(0), docs.limit(1)):
        got = sorted((str(r[0]), *r[1:]) for r in manifest.document_manifest(few).collect())
        assert got == _manifest([tuple(r)[:5] for r in few.collect()])


def test_proofs_lead_to_the_root_and_no_row_is_nested_whole(spark):
    docs = spark.range(500).select(F.col("id"), F.lit("s").alias("source"))
    got = manifest.manifest(docs, F.sha2(F.col("id").cast("string"), 256), "source", "id", {"id": F.col("id")}, digits=2)
    bad = got.filter(manifest.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count()
    assert got.count() == 500 and bad == 0 and got.filter(F.size("proof") != 6).count() == 0
