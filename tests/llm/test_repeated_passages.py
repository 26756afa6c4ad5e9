import hashlib

import numpy as np
import pyarrow as pa
import pytest

from daftar.llm import repeated_passages as rp


def brute(rows):
    """Every string of every text, by dictionary."""
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in rows]
    least = {}
    for doc, t in texts:
        if doc is not None:
            for i in range(len(t) - rp.WIDTH + 1):
                s = t[i : i + rp.WIDTH]
                least[s] = min(least.get(s, doc), doc)
    out = []
    for doc, t in texts:
        gone = bytearray(len(t))
        if doc is not None:
            for i in range(len(t) - rp.WIDTH + 1):
                if least[t[i : i + rp.WIDTH]] < doc:
                    gone[i : i + rp.WIDTH] = b"\1" * rp.WIDTH
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((doc, len(t), sum(gone), sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(t))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()), key=str)


@pytest.fixture()
def small(monkeypatch):
    """Many runs and parts, so that passages meet across them."""
    for name, value in (("RUN", 20_000), ("PART", 30_000)):
        monkeypatch.setattr(rp, name, value)


@pytest.mark.parametrize("hot", [2000, 3])
def test_against_all_strings(spark, sf, small, hot):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = found(rp.remove_repeats(docs, hot=hot))
    assert got == brute(docs.collect())
    assert any(r[2] for r in got)


def test_edges(spark, small):
    """Lengths about the width, passages that repeat inside a text, periodic texts, one id on several texts."""
    a = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(400))
    texts = [
        (1, a[:50]), (2, a[:50]), (3, a[:49]), (4, a[1:51]), (5, a), (6, a[:100] + "#" + a[100:200] + "é" * 30 + a[40:90]), (7, a[200:260] * 3),
        (8, "x" * 300), (9, "x" * 50), (10, "x" * 49), (11, "ab" * 60), (12, "y" + "ab" * 60), (13, a[300:380]), (13, "zz" + a[300:380]), (None, a), (14, a[:50] + "\0" * 60), (15, "\0" * 70),
        (16, a), (16, a), (0, a[120:175]),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert found(rp.remove_repeats(docs)) == brute(docs.collect())


def test_kept_texts(spark):
    docs = spark.createDataFrame([(1, "a" * 10 + "q" * 60), (2, "b" * 10 + "q" * 60 + "c")], "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept"]) for r in rp.remove_repeats(docs, texts=True).collect()}
    assert got == {1: b"a" * 10 + b"q" * 60, 2: b"b" * 10 + b"c"}


def test_odd_rows(odd_docs, no_docs):
    short = odd_docs.selectExpr("doc_id", "left(text, 20000) as text", "shard", "_n")
    assert found(rp.remove_repeats(short)) == brute(short.collect())
    assert found(rp.remove_repeats(no_docs)) == []
    assert rp.remove_repeats(odd_docs).count() == odd_docs.count()


@pytest.mark.parametrize("shards", [1, 2, 4, 7])
def test_merged_intervals(shards):
    """Places that share their next bytes, whatever the shards."""
    rng = np.random.default_rng(5)
    raw = rng.integers(97, 99, 4000).astype(np.uint8)
    raw[2000:2300] = raw[300:600]
    raw[3000:3090] = raw[310:400]
    offs = np.array([0, 500, 560, 1200, 2050, 2051, 2500, 4000])
    spot, block = rp.merged_intervals(raw, offs, shards)
    want = {}
    for a, b in zip(offs[:-1], offs[1:]):
        for i in range(a, b - rp.WIDTH + 1):
            want.setdefault(raw[i : i + rp.WIDTH].tobytes(), set()).add(i)
    got = {}
    for s, b in zip(spot.tolist(), block.tolist()):
        got.setdefault(b, set()).add(s)
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_parts_have_equal_shares():
    """Anchors are the smallest hashes of their strings; parts of the hash range must not notice."""
    raw = np.random.default_rng(1).integers(97, 123, 200_000).astype(np.uint8)
    h = rp.anchors(raw, np.arange(0, len(raw) + 1, 4000))[0]
    share = np.bincount(rp.split_hash(h, 4)[0].astype(np.int64), minlength=16)
    assert share.max() < 1.5 * share.mean()


def test_frequent_anchors_of_few_documents():
    """An anchor that a few documents repeat with ever other surroundings goes string by string, too."""
    rng = np.random.default_rng(3)
    line = min((bytes([c]) * 40 for c in range(33, 97)), key=lambda x: rp.gram_hashes(np.frombuffer(x, np.uint8))[0])
    texts = [b"".join(rng.integers(97, 123, 60).astype(np.uint8).tobytes() + line for _ in range(50)) for _ in range(4)]
    listed = [rp._list_anchors(0)(pa.table({"run": [i], "doc_id": [i], "text": pa.array([t], pa.binary())})) for i, t in enumerate(texts)]
    shared = rp._shared_of(rp._find_shared(100)(pa.concat_tables(listed)))[0]
    times = {}
    for t in texts:
        for k in rp.split_hash(rp.anchors(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0], 0)[1].tolist():
            times[k] = times.get(k, 0) + 1
    assert max(times.values()) >= 110
    assert all(hot == (times[k] >= 100) for k, hot in zip(*shared) if abs(times[k] - 100) > 20)
    assert any(shared[1])
