"""Hot keys take the same results through other paths."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from daftar.operators import dedup, health, retrieval, skew

RND = random.Random(11)
ROWS = [(i, "hot" if RND.random() < 0.4 else f"k{RND.randrange(40)}", RND.randrange(25), RND.randrange(1000)) for i in range(600)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "chunk_id int, content_hash string, document_id int, at int").cache()


def test_dedup_global(rows):
    lowest = {}
    for i, h, _, _ in ROWS:
        lowest.setdefault(h, i)
    got = {r.chunk_id: (r.is_duplicate, r.duplicate_of) for r in dedup.dedup_global(rows).collect()}
    assert got == {i: (lowest[h] != i, lowest[h] if lowest[h] != i else None) for i, h, _, _ in ROWS}


def test_duplicates_in_document(spark, rows):
    chunks = rows.select("document_id", F.col("chunk_id").alias("chunk_index"), "content_hash")
    stored = {(3, "hot"), (4, "k1")}
    existing = spark.createDataFrame(list(stored), "document_id int, content_hash string")
    got = {(r.document_id, r.chunk_index): r.is_duplicate for r in dedup.mark_duplicates_in_document(chunks, existing).collect()}
    seen, want = set(stored), {}
    for i, h, d, _ in ROWS:
        want[d, i] = (d, h) in seen
        seen.add((d, h))
    assert got == want


@pytest.mark.parametrize("width", [1, 17, 5000])
def test_running_index(rows, width):
    order = [F.col("at"), F.col("chunk_id")]
    out = skew.running_index(rows, ["content_hash"], F.col("at"), order, "n", width)
    want, seen = {}, {}
    for i, h, _, _ in sorted(ROWS, key=lambda r: (r[3], r[0])):
        want[i] = seen.get(h, 0)
        seen[h] = want[i] + 1
    assert {r.chunk_id: r.n for r in out.collect()} == want


@pytest.mark.parametrize("width", [1, 17, 5000])
def test_previous_value(rows, width):
    out = skew.previous_value(rows, ["content_hash"], F.col("at"), [F.col("at"), F.col("chunk_id")], "document_id", "p", width)
    last, want = {}, {}
    for i, h, d, at in sorted(ROWS, key=lambda r: (r[3], r[0])):
        want[i] = last.get(h)
        last[h] = d
    assert {r.chunk_id: r.p for r in out.collect()} == want


def test_keep_first_limits_before_the_shuffle(rows):
    out = skew.keep_first(rows, ["content_hash"], [F.col("at"), F.col("chunk_id")], 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    want = {}
    for i, h, d, at in sorted(ROWS, key=lambda r: (r[3], r[0])):
        want.setdefault(h, [])
        if len(want[h]) < 2:
            want[h].append(i)
    assert {r.chunk_id for r in out.collect()} == {i for v in want.values() for i in v}


def test_backfill_classification(spark):
    pages = spark.createDataFrame(
        [(1, 1, "x", "x", False), (1, 2, "g", "s", True), (1, 3, "h", "t", True), (2, 1, "x", "x", False)],
        "document_id int, page_number int, grade string, subject string, is_valid boolean",
    )
    got = sorted((r.document_id, r.page_number, r.grade, r.subject) for r in health.backfill_classification(pages).collect())
    assert got == [(1, 1, "g", "s"), (1, 2, "g", "s"), (1, 3, "g", "s")]


def vectors(spark, n, dim, seed, name):
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, dim)).astype("float32")
    scope = ["big" if i % 3 else "small" for i in range(n)]
    df = spark.createDataFrame([(i, m[i].tolist(), scope[i]) for i in range(n)], f"{name} int, embedding array<float>, scope string")
    return df, m.astype(float), scope


@pytest.mark.parametrize("block,scope", [(7, None), (1000, None), (7, "scope"), (1000, "scope")])
def test_cosine_topk_equals_brute_force(spark, block, scope):
    q, mq, sq = vectors(spark, 40, 8, 1, "query_id")
    c, mc, sc = vectors(spark, 90, 8, 2, "chunk_id")
    got = {}
    for r in retrieval.cosine_topk(q, c, 4, scope, block).collect():
        got[r.query_id, r["rank"]] = r.chunk_id
    sim = np.round(mq @ mc.T / np.linalg.norm(mq, axis=1)[:, None] / np.linalg.norm(mc, axis=1)[None, :], 9)
    want = {}
    for i in range(40):
        ids = [j for j in range(90) if scope is None or sq[i] == sc[j]]
        for rank, j in enumerate(sorted(ids, key=lambda j: (-sim[i, j], j))[:4], 1):
            want[i, rank] = j
    assert got == want


def test_unequal_length_scores_zero(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    c = spark.createDataFrame([(1, [1.0]), (2, [1.0, 0.0]), (3, None)], "chunk_id int, embedding array<float>")
    got = [(r.chunk_id, r.score) for r in retrieval.cosine_topk(q, c, 5).orderBy("rank").collect()]
    assert got == [(2, 1.0), (1, 0.0)]


def test_ann_recall_of_many_scattered_vectors(spark, monkeypatch):
    # Nothing lies near anything else, so small cells and few probes find too little.
    monkeypatch.setattr(retrieval, "CELL_ROWS", 8)
    rng = np.random.default_rng(11)
    c = spark.createDataFrame([(i, rng.standard_normal(64).tolist()) for i in range(6000)], "chunk_id long, embedding array<double>")
    q = c.filter("chunk_id % 10 = 0").withColumnRenamed("chunk_id", "query_id")
    got = retrieval.ann_recall(retrieval.ann_pairs(q, c, 5, 64), retrieval.cosine_topk(q, c, 5)).first()
    assert got.neighbours == 3000 and got.recall >= 0.9


def test_best_of_a_block_holds_few_scores():
    import tracemalloc

    rng = np.random.default_rng(3)
    a, b = np.empty(4096, object), np.empty(4096, object)
    a[:], b[:] = list(rng.integers(-2, 3, (4096, 8)).astype(float)), list(rng.integers(-2, 3, (4096, 8)).astype(float))
    a[7], b[5], b[9] = np.zeros(0), np.ones(3), np.zeros(0)
    tracemalloc.start()
    row, col, score = retrieval._best_of(a, b, 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 << 20  # all scores of the block at once are 128 MB
    assert np.array_equal(np.bincount(row), np.full(4096, 5))
    for i in (0, 7, 8, 4095):
        one = np.array([a[i] @ v / n if len(v) == len(a[i]) and (n := np.linalg.norm(a[i]) * np.linalg.norm(v)) else 0.0 for v in b])
        want = np.argsort(-np.round(one, 9), kind="stable")[:5]
        assert col[row == i].tolist() == want.tolist() and np.allclose(score[row == i], one[want])


def test_ann_recall(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 32))
    near = base + 0.1 * rng.standard_normal((300, 32))
    c = spark.createDataFrame([(i, base[i].tolist()) for i in range(300)], "chunk_id int, embedding array<float>")
    q = spark.createDataFrame([(i, near[i].tolist()) for i in range(300)], "query_id int, embedding array<float>")
    exact = {(r.query_id, r.chunk_id) for r in retrieval.cosine_topk(q, c, 1).collect()}
    found = {(r.query_id, r.chunk_id) for r in retrieval.ann_pairs(q, c, 1, 32).collect()}
    assert len(exact & found) / len(exact) > 0.95
