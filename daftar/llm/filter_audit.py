"""What each filter of a chain removes, over all orders of the chain.

The subsets of the filters form a lattice: an order of the filters is a path from the
empty set to the full one, and applying filter ``f`` after the set ``S`` is the edge from
``S`` to ``S + f``.  What an edge removes depends on ``S`` and ``f`` alone, so all orders are
read from ``n * 2^(n-1)`` edges instead of ``n! * n`` runs:

1. Every row is reduced to the bit mask of the filters it fails; rows are counted by part
   and mask, and nothing else is carried on (at most ``2^n`` rows for a part).
2. Path counts forward (orders that reach ``S``) and backward (orders that leave ``S + f``)
   come from the lattice's recurrence; their product is the number of orders that use an edge.
3. An edge's removals weighted with that number, summed over the edges of one filter, are its
   Shapley total.  The steps of each order are looked up in the same edges.

Nulls and edge cases: a null part is the empty string; null text is empty; a null verdict of a
filter counts as passing; a row without an id is nobody's copy and nobody is its copy; rows
alike in id and text are not copies of one another (no id is smaller); an id without labels
loses nothing; labels repeated for an id count if any row says 1; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.llm.common import SPACE

#: Fixed values of the five rules.
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, SYMBOLS = 100, 80, 10, "[#$%&*|]"


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """For each subset of ``n`` filters: the orders that lead to it from the empty set, and from it to the full one."""
    full = (1 << n) - 1
    forward, backward = [0] * (full + 1), [0] * (full + 1)
    forward[0] = backward[full] = 1
    for state in range(full + 1):
        for f in range(n):
            if not state >> f & 1:
                forward[state | 1 << f] += forward[state]
    for state in range(full, -1, -1):
        for f in range(n):
            if not state >> f & 1:
                backward[state] += backward[state | 1 << f]
    return forward, backward


def rule_failures(text: Column) -> dict[str, Column]:
    """The rules that see one text: short, repetitive, shouting, full of symbols."""
    words = F.split(text, f"[{SPACE}]+")  # an empty string stands where white space begins or ends the text
    first, last = (F.get(words, F.lit(0)) == "").cast("int"), (F.element_at(words, -1) == "").cast("int")
    n = F.greatest(F.size(words) - first - last, F.lit(0))
    distinct = F.size(F.array_distinct(words)) - F.greatest(first, last)
    upper = F.regexp_count(text, F.lit("[A-Z]"))
    return {
        "A": n < MIN_WORDS,
        "B": distinct * 100 < n * MIN_DISTINCT_PERCENT,
        "C": upper * 100 > F.char_length(text) * MAX_UPPER_PERCENT,
        "D": text.rlike(SYMBOLS),
    }


def failure_masks(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters A to E they fail, with the labelled ones among them.

    Texts are read once and leave the scan as a digest and a mask.  Equal texts are met by
    digest: the smallest id of each is one aggregate per task and digest, and whether a row is
    that one is a join on digest *and* id, so that a text with many copies is no hot key.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    fails = rule_failures(F.col("text"))
    bits = [F.when(fails[x], 1 << i).otherwise(0) for i, x in enumerate("ABCD")]
    rows = text.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))
    rows = rows.groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    first = rows.filter("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic")
    )
    copy = F.when(F.col("id").isNotNull() & F.col("first").isNull(), 1 << 4).otherwise(0)
    seen = rows.join(first, ["digest", "id"], "left").join(known, "id", "left")
    n = F.col("n")
    return seen.groupBy("part", (F.col("mask") + copy).alias("mask")).agg(
        F.sum("n").alias("n"), F.sum(n * F.coalesce("good", F.lit(0))).alias("good"), F.sum(n * F.coalesce("toxic", F.lit(0))).alias("toxic")
    )


def lattice_edges(masks: DataFrame, names: Sequence[str]) -> DataFrame:
    """(part, state, filter, counts of the edge, ways): what filter ``filter`` does after the filters of ``state``."""
    forward, backward = path_counts(len(names))
    edges = [
        F.struct(F.lit(state).alias("state"), F.lit(f).alias("filter"), F.lit(1 << f).alias("bit"), F.lit(forward[state] * backward[state | 1 << f]).cast("long").alias("ways"))
        for state in range(1 << len(names)) for f in range(len(names)) if not state >> f & 1
    ]
    each = masks.withColumn("e", F.explode(F.array(*edges))).select("part", "mask", "n", "good", "toxic", "e.*")
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    alive = F.col("mask").bitwiseAND(F.col("state")) == 0
    out = alive & fails

    def total(value: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(value)).otherwise(0))

    return each.groupBy("part", "state", "filter", "ways").agg(
        total("n", alive & ~fails).alias("kept"),
        total("n", out).alias("removed"),
        total("n", fails & ~alive).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("good", out).alias("good_lost"),
        total("toxic", out).alias("toxic_lost"),
    )


def audit_orders(masks: DataFrame, names: Sequence[str]) -> DataFrame:
    """A row for each part, order of the filters and step, read from the lattice's edges."""
    edges = lattice_edges(masks, names)
    totals = edges.groupBy("part", "filter").agg(F.sum(F.col("ways") * F.col("removed")).alias("shapley"))
    steps = []
    for order in permutations(range(len(names))):
        for k, f in enumerate(order):
            steps.append(("".join(names[i] for i in order), k + 1, sum(1 << i for i in order[:k]), f))
    at = masks.sparkSession.createDataFrame(steps, "filter_order string, step int, state int, filter int")
    return edges.join(totals, ["part", "filter"]).join(at, ["state", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The audit of the five rules A to E over ``docs``, by ``part``."""
    return audit_orders(failure_masks(docs, labels, part), "ABCDE")
