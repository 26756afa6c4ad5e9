"""Many needles sought in many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Needles of one automaton.
NEEDLES = 50_000


def contained_in(needles: DataFrame, needle: str, texts: DataFrame, text: str, per_automaton: int = NEEDLES) -> DataFrame:
    """(_sought, _within): the distinct pairs in which the text contains the needle.

    Needles are dealt into parts of about ``per_automaton``; each part becomes one
    Aho-Corasick automaton, and a text is read once per part, whatever the needles
    have in common and however many match.  A slot is a part and a block of the
    texts: its needles come first in the partition, its texts stream past them, so
    a task holds one automaton and one batch.  Null and empty strings match nothing.
    """
    spark = needles.sparkSession
    asked = needles.select(F.col(needle).cast("string").alias("string")).filter("string <> ''").distinct()
    read = texts.select(F.col(text).cast("string").alias("string")).filter("string <> ''").distinct()
    parts = max(1, -(-asked.count() // per_automaton))
    blocks = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // parts))

    def slots(df: DataFrame, kind: int, fixed: int, others: int, slot) -> DataFrame:
        own = df.withColumn("own", F.pmod(F.xxhash64("string"), F.lit(fixed)))
        each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        return each.select(slot(F.col("own"), F.col("other")).cast("long").alias("slot"), F.lit(kind).alias("kind"), "string")

    rows = slots(asked, 0, parts, blocks, lambda part, block: part * blocks + block).unionByName(
        slots(read, 1, blocks, parts, lambda block, part: part * blocks + block)
    )

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        slot, automaton, ready = None, None, False
        for frame in frames:
            found: list[tuple[str, str]] = []
            for at, kind, string in zip(frame["slot"].tolist(), frame["kind"].tolist(), frame["string"].tolist()):
                if kind == 0:
                    if at != slot:
                        slot, automaton, ready = at, ahocorasick.Automaton(), False
                    automaton.add_word(string, string)
                elif at == slot:
                    if not ready:
                        automaton.make_automaton()
                        ready = True
                    found.extend((hit, string) for hit in {value for _, value in automaton.iter(string)})
            yield pd.DataFrame(found, columns=["_sought", "_within"])

    return rows.repartition(parts * blocks, "slot").sortWithinPartitions("slot", "kind").mapInPandas(match, "_sought string, _within string")
