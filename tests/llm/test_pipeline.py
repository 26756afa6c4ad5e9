"""The pipeline's stages, each on what its predecessor kept, against plain Python."""

from collections import Counter, defaultdict

import corpus_pipeline
from daftar.llm import jaccard_dedup, line_dedup, mixing
from tests.llm.test_operators import brute_jaccard, brute_targets, check_packing, words


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, tables = docs, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, sf)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert sorted(out.columns) == sorted(docs.columns), name
        out.write.parquet(str(tmp_path / name))
        tables[name] = (kept, kept := spark.read.parquet(str(tmp_path / name)))

    before, after = tables["quality"]
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    ids = {r["doc_id"] for r in after.collect()}
    assert after.exceptAll(before).count() == 0
    assert sum(r["doc_id"] in ids for r in labels.values() if r["quality"] == 1) > 0.95 * sum(r["quality"] == 1 for r in labels.values())

    before, after = tables["lines"]
    pages, counts = Counter(), defaultdict(Counter)
    rows = before.collect()
    for r in rows:
        pages[r["source"]] += 1
        counts[r["source"]].update({x.strip(line_dedup.SPACE) for x in r["text"].split("\n")} - {""})
    want = {}
    for r in rows:
        bad = {x for x, n in counts[r["source"]].items() if n >= line_dedup.MIN_PAGES and n > line_dedup.RATIO * pages[r["source"]]}
        want[r["doc_id"]] = "\n".join(x for x in r["text"].split("\n") if x.strip(line_dedup.SPACE) not in bad)
    assert {r["doc_id"]: r["text"] for r in after.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())

    before, after = tables["near_duplicates"]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    groups = brute_jaccard([t for _, t in rows], jaccard_dedup.PERCENT)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({rows[g][0] for g in groups})

    before, after = tables["mixing"]
    sizes, taken, biggest = Counter(), Counter(), Counter()
    for r in before.collect():
        sizes[r["source"]] += len(words(r["text"]))
        biggest[r["source"]] = max(biggest[r["source"]], len(words(r["text"])))
    for r in after.collect():
        taken[r["source"]] += len(words(r["text"]))
    goal = brute_targets(sizes, mixing.WEIGHTS, mixing.CAP)
    assert all(0 <= goal[s] - taken[s] + 1e-6 <= 4 * biggest[s] + 1 for s in goal)
    assert set(after.distinct().collect()) <= set(before.collect())

    before, after = tables["packing"]
    assert check_packing(before, after.collect()) > 0.9
    assert {tuple(r[c] for c in ("doc_id", "start", "ids_crc32")) for r in corpus_pipeline.run(spark, sf).collect()} == {
        tuple(r[c] for c in ("doc_id", "start", "ids_crc32")) for r in after.collect()
    }


def test_odd_rows(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        kept = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, sf)
            assert sorted(kept.columns) == sorted(odd_docs.columns), name
            kept = corpus_pipeline.session.durable(kept, "test")
        out = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
        assert (out.count() == 0) == (docs is no_docs)
