"""The near-duplicate stage goes by SimHash links, confirmed, and is completed to all links; workers stay small."""

import os

import numpy as np
import pytest

import corpus_pipeline
from daftar import session
from daftar.llm import common, jaccard_dedup, packing, simhash_dedup
from daftar.llm.common import tokenizer_file
from tests.llm.test_operators import brute_jaccard


def texts():
    rng = np.random.default_rng(5)
    base = [[f"w{x}" for x in rng.integers(0, 500, 300)] for _ in range(6)]
    out = [" ".join(b) for b in base]
    for b in base:
        out.append(" ".join([*b[:150], "changed", *b[151:]]))  # a few bits apart
        out.append(" ".join([*b[:20], "some", "more", *b[24:150], "words", *b[153:280], "differ", *b[282:]]))  # about ten bits
    return [*out, out[0], out[0].upper(), "", None, "short text"]


def test_simhash_links_are_candidates(spark, monkeypatch):
    """Every pair within the radius is joined by what the stage asks to be confirmed, and the stage does ask."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    listed = jaccard_dedup.classes(rows, jaccard_dedup.levels(rows)).collect()
    prints = {r["sig"]: r["fp"] for r in listed if r["fp"] is not None}
    own = {r["doc_id"]: jaccard_dedup.signed(simhash_dedup.fingerprint(texts()[r["doc_id"]])) for r in listed if r["size"]}
    assert prints and all(prints[r["sig"]] == own[r["doc_id"]] for r in listed if r["size"])
    # one more set with a fingerprint that another has
    prints[1] = next(iter(prints.values()))
    sets = spark.createDataFrame(list(prints.items()), "sig long, fp long")
    got = jaccard_dedup.fingerprint_pairs(sets).collect()
    assert all(r["a"] < r["b"] for r in got)
    root = {s: s for s in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in got:
        root[find(r["a"])] = find(r["b"])
    near = [(a, b) for a in prints for b in prints if a < b and ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() <= simhash_dedup.RADIUS]
    assert near and all(find(a) == find(b) for a, b in near)

    asked = []
    plain = jaccard_dedup.near_links
    monkeypatch.setattr(jaccard_dedup, "near_links", lambda fps, *a: asked.append(fps.count()) or plain(fps, *a))
    kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, rows, "").collect())
    assert asked == [len(set(own.values()))]
    assert kept == sorted(set(brute_jaccard(texts())))


def test_workers_forget(monkeypatch):
    """One thread per task, and another operator's tasks drop the remembered words."""
    pytest.importorskip("tokenizers")
    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "true")
    packing._word_tokenizer.cache_clear()
    made = packing._word_tokenizer(tokenizer_file(packing.TOKENIZER))
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    assert list(made.many(["to be or"])) == list(packing._word_tokenizer(tokenizer_file(packing.TOKENIZER)).many(["to be or"]))
    common.lean_worker()
    assert packing._word_tokenizer.cache_info().currsize == 0


def test_large_group_is_not_compared_with_itself(spark, monkeypatch):
    """Near copies of one text: a few pairs per copy are confirmed, not all of them, and none is lost."""
    rng = np.random.default_rng(7)
    base = [f"w{x}" for x in rng.integers(0, 900, 150)]
    copies = []
    for i in range(70):
        own = list(base)
        for at in rng.choice(150, 2, replace=False):
            own[at] = f"x{i}"
        copies.append(" ".join(own))
    asked = []
    plain = jaccard_dedup.confirmed
    monkeypatch.setattr(jaccard_dedup, "confirmed", lambda docs, pairs, *a: asked.append(pairs.count()) or plain(docs, pairs, *a))
    kept = jaccard_dedup.keep_representatives(spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(brute_jaccard(copies)))
    assert sum(asked) < 10 * len(copies)


def test_joined_asks_few_pairs_of_a_group(spark, monkeypatch):
    """All pairs of two groups are offered, the first ones lead nowhere; a pair for any two parts joins what can be joined."""
    group = lambda x: x % 2
    asked = []

    def confirmed(docs, pairs, *_):
        asked.append(pairs.count())
        return pairs.filter("a % 2 = b % 2")

    monkeypatch.setattr(jaccard_dedup, "confirmed", confirmed)
    n = 40
    pairs = spark.createDataFrame([(a, b) for b in range(n) for a in range(b)], "a long, b long")
    _, roots = jaccard_dedup.joined(None, None, jaccard_dedup.one_each(pairs), pairs)
    assert {r["node"]: r["root"] for r in roots.collect()} == {x: group(x) for x in range(2, n)}
    assert sum(asked) < pairs.count()
    _, roots = jaccard_dedup.joined(None, None, jaccard_dedup.one_each(pairs.filter("a % 2 = b % 2")), pairs.filter("a % 2 = b % 2"))
    assert {r["node"]: r["root"] for r in roots.collect()} == {x: group(x) for x in range(2, n)}
    assert asked[-1] == n - 2  # a pair each, and nothing more


def test_components_in_few_jobs(spark):
    """Chains, a star and a loop: few links need a round without a shuffle only; with one link per task the rounds agree."""
    chain = [(i, i + 1) for i in range(300)]
    rows = [*chain, *[(1000, 1000 + i) for i in range(1, 50)], (2002, 2001), (2001, 2000), (2000, 2002), (7, 7), (-5, -9)]
    want = {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 50)} | {2001: 2000, 2002: 2000, -5: -9}
    links = spark.createDataFrame(rows, "a long, b long").repartition(5)
    for most, limit in ((simhash_dedup.LINKS, 2), (1, 12)):
        with session.tracked() as paths:
            found = simhash_dedup.components(links, most=most).collect()
        assert len(found) == len(want) and {r["node"]: r["root"] for r in found} == want
        assert len(paths) <= limit
    assert simhash_dedup.components(links.filter("a > 5000")).count() == 0


def test_between_gives_a_pair_per_set(spark):
    """Groups 1 to 3 meet at every shingle; each set meets one set of the smallest group, not all sets of the others."""
    zero = [0] * jaccard_dedup.WORDS
    rows = [(t, g * 100 + i, 10, t, g, *zero) for t in range(5) for g in (1, 2, 3) for i in range(20)]
    words = ", ".join(f"w{i} long" for i in range(jaccard_dedup.WORDS))
    member = spark.createDataFrame(rows, f"token long, sig long, size long, pos long, root long, {words}")
    assert sorted(map(tuple, jaccard_dedup.between(member).collect())) == [(100, g * 100 + i) for g in (2, 3) for i in range(20)]


@pytest.mark.parametrize("offered", ["none", "wrong"])
def test_no_link_hangs_on_fingerprints(spark, monkeypatch, offered):
    """SimHash offers no pair, or only pairs that fail: prefix filtering alone finds every link."""
    def pairs(sets, *_):
        all_ = sets.select("sig").crossJoin(sets.select(sets["sig"].alias("b"))).toDF("a", "b").filter("a < b")
        return all_.filter("false") if offered == "none" else all_.filter("a % 7 = b % 7")

    monkeypatch.setattr(jaccard_dedup, "fingerprint_pairs", pairs)
    rows = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, rows, "").collect())
    assert kept == sorted(set(brute_jaccard(texts())))
