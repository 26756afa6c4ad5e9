"""Mixing sources to target weights by hash-threshold histograms.

Every source has a target number of words.  A document is taken whole as many
times as its source's target holds the source, and once more if its hash lies
below the source's threshold.  Thresholds come from histograms: words are added
up by source and by the leading bits of the hash, the bucket in which the budget
ends is found, and only that bucket is divided by the next bits.  The filter then
compares hashes; nothing is sorted, and thresholds of smaller budgets are nested
in those of larger ones.

Nulls and edge cases: a null source is a source of its own and comes last; a null
text has no words; the hash is of id and text, nulls included, so only rows that
agree in both stay or go together; sources without words have target 0; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daftar.llm.common import durable, fresh, numbered, parts_for, word_count

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
#: Bits of the hash in each histogram, and histograms; together more than rows can fill.
BITS, ROUNDS = 10, 5
SEED = 11


def _hash(docs: DataFrame, seed: int) -> Column:
    """BITS * ROUNDS bits of id and text; rows without an id, or with one id, differ by their text."""
    text = docs["text"].cast("string")
    whole = F.xxhash64(F.lit(seed), docs["doc_id"].cast("long"), F.xxhash64(text.isNull(), text))
    return F.shiftrightunsigned(whole, 64 - BITS * ROUNDS)


def document_sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, hash) of every row; the hash has BITS * ROUNDS bits."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), _hash(docs, seed).alias("hash"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, cap: float = CAP) -> DataFrame:
    """(source, source_size, target): ``share`` of all words dealt by weight, capped at ``cap`` times each source.

    Weights are dealt to the sources in code point order, null last, repeating.
    What a cap cuts off is dealt again by weight among the others.
    """
    per = durable(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    n = per.count()
    order = [F.col("source").asc_nulls_last()]
    place = F.pmod(F.col("place"), F.lit(len(weights))) + 1
    weighed = durable(
        numbered(per, order, "place", parts_for(per.sparkSession, n)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place.cast("int"))), "weighed"
    )
    # The level is what a unit of weight gets; sources whose cap is below it are full.
    level, full = None, -1
    most = F.lit(cap) * F.col("source_size")
    while True:
        above = F.lit(False) if level is None else most <= F.lit(level) * F.col("weight")
        row = weighed.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(above, most)).alias("capped"), F.count_if(above).alias("full"), F.sum(F.when(~above, F.col("weight"))).alias("weight")
        ).first()
        if row["full"] == full or not row["weight"]:
            break
        full = row["full"]
        level = (share * (row["all"] or 0) - (row["capped"] or 0)) / row["weight"]
    target = most.cast("double") if level is None else F.least(most, F.lit(float(level)) * F.col("weight")).cast("double")
    return weighed.select("source", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with ``whole`` (times every document is taken) and ``below`` (hashes taken once more).

    Round r looks at the rows of the boundary bucket found in round r - 1 only.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = wanted.withColumn("whole", whole).withColumn("_left", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("_at", F.lit(0).cast("long"))
    state = durable(state, "budgets")
    rows = sizes.filter("size > 0").select("source", "size", "hash")
    for r in range(ROUNDS):
        shift = BITS * (ROUNDS - 1 - r)
        cell = F.shiftright("hash", shift)
        open_ = state.select(F.col("source").alias("_source"), "_at")
        if r:
            inside = rows.join(open_, F.col("source").eqNullSafe(F.col("_source")) & (F.shiftright("hash", shift + BITS) == F.col("_at"))).select("source", "size", "hash")
        else:
            inside = rows
        by = Window.partitionBy("source").orderBy("cell")
        cells = inside.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(by))
        left = state.select(F.col("source").alias("_source"), "_left")
        # Cells that fit go in whole; the first that doesn't is the boundary.
        cells = cells.join(left, F.col("source").eqNullSafe(F.col("_source")))
        found = cells.groupBy("source").agg(
            F.coalesce(F.sum(F.when(F.col("upto") <= F.col("_left"), F.col("words"))), F.lit(0)).alias("_used"),
            F.min(F.when(F.col("upto") > F.col("_left"), F.col("cell"))).alias("_cell"),
        ).withColumnRenamed("source", "_source")
        last = F.shiftleft(F.col("_at") + 1, BITS)  # no boundary: everything inside fits
        state = state.join(found, F.col("source").eqNullSafe(F.col("_source")), "left").select(
            "source", "source_size", "target", "whole",
            (F.col("_left") - F.coalesce(F.col("_used"), F.lit(0))).alias("_left"), F.coalesce(F.col("_cell"), last).alias("_at"),
        )
        state = durable(state, "budgets")
    served = F.col("whole") * F.col("source_size") >= F.col("target")
    return state.select("source", "source_size", "target", "whole", F.when(served, 0).otherwise(F.col("_at")).alias("below"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, times, taken) of every document."""
    sizes = durable(document_sizes(docs, seed), "sizes")
    limits = thresholds(sizes, targets(sizes, weights, share, cap)).withColumnRenamed("source", "_source")
    times = F.col("whole") + (F.col("hash") < F.col("below")).cast("long")
    return (
        sizes.join(limits, F.col("source").eqNullSafe(F.col("_source")), "left")
        .select("doc_id", "source", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"))
    )


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, each as many times as it is taken.

    Only the limits per source are joined; texts stay where they are read unless
    there are too many sources to broadcast.
    """
    sizes = durable(document_sizes(docs, seed), "sizes")
    limit, copy = fresh(docs, "_limit"), fresh(docs, "_copy")
    limits = thresholds(sizes, targets(sizes, weights, share, cap)).select(F.struct("source", "whole", "below").alias(limit))
    joined = docs.join(limits, docs["source"].cast("string").eqNullSafe(F.col(limit)["source"]), "left")
    times = F.col(limit)["whole"] + (_hash(docs, seed) < F.col(limit)["below"]).cast("long")
    copies = F.sequence(F.lit(1), times.cast("int"))
    return joined.withColumn(copy, F.explode(F.when(times > 0, copies))).select(*[docs[c] for c in docs.columns])
