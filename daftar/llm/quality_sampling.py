"""Quality by importance resampling: hashed n-gram models of target and raw text.

Two bag-of-n-grams models share one hashed feature space: the *target* model is
counted on labelled good documents, the *raw* model on every document.  The log
of their ratio, summed over a document's n-grams, is its importance weight.
Adding Gumbel noise to the weights and keeping the k largest draws k documents
without replacement in proportion to their weights.

The target model is fitted on every second labelled good document; the others, and
the labelled poor ones, say how many documents deserve to be drawn.

Features of a document (all hashed into ``BUCKETS`` cells):

* words, lower-cased in ASCII;
* pairs of neighbouring words, where a repeated word is one symbol of its own,
  so that stuttering text has a frequent pair in common;
* pairs of the last bytes of neighbouring words (punctuation habits).

Nulls and edge cases: a null or blank text has no features and weight 0; a null
``doc_id`` is an id like any other; repeated rows are separate draws with the
same noise, so both stay or both go; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.llm.common import batches, durable, fresh, kth_key, word_starts

BITS = 18
BUCKETS = 1 << BITS
#: Labelled rows used at most to fit the target model and the number to keep.
MAX_LABELLED = 40_000
#: Prior observations per cell; cells with little evidence keep a ratio near 1.
PRIOR = 5.0
#: Share of labelled good documents that the number of draws must cover.
COVER = 0.995

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MUL = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5))
_SAME = np.uint64(0x5851F42D4C957F2D)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    done = 1
    while done < n:  # doubling: the second half is the first times base^done
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(pow(base, done, 1 << 64))
        done += take
    return out


_BASE = 0x100000001B3
_TABLE: dict[str, np.ndarray] = {"up": _powers(1 << 16, _BASE), "down": _powers(1 << 16, pow(_BASE, -1, 1 << 64))}


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLE["up"]) < n:
        size = 1 << (n - 1).bit_length()
        _TABLE.update(up=_powers(size, _BASE), down=_powers(size, pow(_BASE, -1, 1 << 64)))
    return _TABLE["up"], _TABLE["down"]


def _cell(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    return ((x * _MUL[0]) >> np.uint64(64 - BITS)).astype(np.int64)


def features(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all n-grams of a run of texts, and the row each belongs to."""
    starts, first, space = word_starts(raw, offs)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    up, down = _table(len(raw))
    value = _LOWER[raw].astype(np.uint64) + np.uint64(1)
    value[space] = 0
    value *= up[: len(raw)]
    words = np.add.reduceat(value, starts) * down[starts]
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    # last byte of each word: the byte before the next white space or row end
    ends = np.append(starts[1:], len(raw)) - 1
    gap = space[ends]
    if gap.any():  # step back over white space of any length
        kept = np.flatnonzero(~space)
        ends = kept[np.searchsorted(kept, ends, "right") - 1]
    last = raw[ends].astype(np.uint64)
    pair = row[1:] == row[:-1]
    same = words[1:] == words[:-1]
    two = np.where(same, _SAME, words[:-1] * _MUL[1] + words[1:] * _STEP)[pair]
    tail = ((last[:-1] << np.uint64(8)) | last[1:])[pair] * _MUL[2] + _SAME
    cells = np.concatenate([_cell(words), _cell(two), _cell(tail)])
    return cells, np.concatenate([row, row[1:][pair], row[1:][pair]])


@dataclass(frozen=True)
class Model:
    """Log ratio of target to raw text, per cell."""

    log_ratio: np.ndarray

    def weights(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        cells, row = features(raw, offs)
        return np.bincount(row, weights=self.log_ratio[cells], minlength=len(offs) - 1).astype(float)


def labelled_sample(labels: DataFrame, limit: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """At most ``limit`` labelled ids (good, poor), chosen by hash of the id.

    Good is quality 1 and toxic 0 or null, poor is quality 0; what is toxic only
    is neither.  Rows without id or quality are left out; an id labelled twice
    counts as good only if all its labels say so.
    """
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) != 0
    good = F.when(F.col("quality") == 0, 0).when(toxic, -1).otherwise(1)
    rows = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg(F.min(good).alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()
    )
    ids = lambda v: np.array(sorted(r["doc_id"] for r in rows if r["good"] == v), dtype=np.int64)
    return ids(1), ids(0)


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model:
    """Count both models in one pass over all documents.

    Each task adds up its own cells; what is shuffled is a row per cell and
    task, what comes to the driver a row per cell (``BUCKETS`` at most).
    """
    good = labelled_sample(labels, limit)[0][::2]  # the others say how many to draw

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw_n, target_n = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in rows:
            hit = np.isin(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), good)
            hit &= ~batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for a, b, raw, offs in batches(batch, 1):
                cells, row = features(raw, offs)
                raw_n += np.bincount(cells, minlength=BUCKETS)
                target_n += np.bincount(cells[hit[a:b][row]], minlength=BUCKETS)
        at = np.flatnonzero(raw_n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw_n[at]), pa.array(target_n[at])], ["cell", "raw", "target"])

    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "cell long, raw long, target long")
    found = parts.groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[found["cell"]], target[found["cell"]] = found["raw"], found["target"]
    if not target.sum():
        return Model(np.zeros(BUCKETS))
    expected = raw * (target.sum() / raw.sum())
    return Model(np.log((target + PRIOR) / (expected + PRIOR)))


def weigh(docs: DataFrame, model: Model, seed: int = 7) -> DataFrame:
    """(doc_id, log_weight, key) of every document: the weight, and the weight plus Gumbel noise.

    The noise is a function of id, text and seed; reruns and repeated rows agree.
    """
    ratio = model.log_ratio

    def score(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(ratio)
        for batch in rows:
            out = [own.weights(raw, offs) for _, _, raw, offs in batches(batch, 1)]
            weight = np.concatenate(out) if out else np.zeros(0)
            dice = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) >> np.uint64(11)
            noise = -np.log(-np.log((dice + 0.5) / float(1 << 53)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight), pa.array(weight + noise)], ["doc_id", "log_weight", "key"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.lit(seed), "doc_id", "text").alias("dice"))
    return slim.mapInArrow(score, "doc_id long, log_weight double, key double")


def draws(weighed: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, cover: float = COVER) -> int:
    """How many documents to draw: all those that weigh as much as labelled good ones do.

    The bar lies between the labelled classes, where it tells them apart best,
    but no higher than what ``cover`` of the good ones reach.
    """
    good, poor = labelled_sample(labels, limit)
    good = good[1::2] if len(good) > 1 else good  # what the model has not seen
    kinds = weighed.sparkSession.createDataFrame(
        [(int(x), 1) for x in good] + [(int(x), 0) for x in poor], "doc_id long, good int"
    )
    rows = weighed.join(kinds, "doc_id").groupBy("doc_id").agg(F.min("log_weight").alias("w"), F.min("good").alias("good")).toPandas()
    if not rows["good"].any():
        return weighed.count()
    w, g = rows["w"].to_numpy(), rows["good"].to_numpy() == 1
    bar = np.quantile(w[g], 1 - cover)
    if (~g).any():
        order = np.argsort(w, kind="stable")
        passed = np.cumsum(~g[order]) / (~g).sum() - np.cumsum(g[order]) / g.sum()
        best = int(np.argmax(passed))
        between = (w[order[best]] + w[order[min(best + 1, len(w) - 1)]]) / 2
        bar = min(bar, between)
    return weighed.filter(F.col("log_weight") >= F.lit(float(bar))).count()


def cutoff(weighed: DataFrame, k: int) -> float:
    """The k-th largest noisy weight; documents at or above it are drawn."""
    found = kth_key(weighed, "key", k)
    return float("inf") if k < 1 else float("-inf") if found is None else found


def sample_quality(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 7) -> DataFrame:
    """(doc_id, log_weight, key) of the drawn documents; ``k`` as given, or from the labels."""
    weighed = durable(weigh(docs, fit(docs, labels), seed), "weights")
    least = cutoff(weighed, draws(weighed, labels) if k is None else k)
    return weighed.filter(F.col("key") >= F.lit(least))


def keep_quality(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 7) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns.

    The noisy weight is computed again in the filtering pass, so the texts are
    not shuffled.
    """
    model = fit(docs, labels)
    weighed = durable(weigh(docs, model, seed), "weights")
    least = cutoff(weighed, draws(weighed, labels) if k is None else k)
    ratio = model.log_ratio
    spot = docs.columns.index("text")

    def keep(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(ratio)
        for batch in rows:
            out = [own.weights(raw, offs) for _, _, raw, offs in batches(batch, spot)]
            weight = np.concatenate(out) if out else np.zeros(0)
            dice = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) >> np.uint64(11)
            key = weight - np.log(-np.log((dice + 0.5) / float(1 << 53)))
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(key >= least))

    dice = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), "text")
    return docs.select(*[docs[c] for c in docs.columns], dice.alias(fresh(docs, "dice"))).mapInArrow(keep, docs.schema)
