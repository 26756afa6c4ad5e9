"""Quality rules at host level: failure rates per host, shrunk by an empirical beta prior.

Each document gets its base statistics and the base verdict.  Failures are added
up per host.  Hosts with few documents say little about themselves, so every
host's failure rate is shrunk towards the corpus: the rates of all hosts give a
beta distribution by moments, and a host's rate becomes the posterior mean.  A
host whose shrunk rate is above ``host_rate`` is bad, and its documents go, too.

Everything is DataFrame functions; the text stays in the scan stage and only
statistics are shuffled.

Nulls and edge cases: a null text has no words and fails; a null host is a host
of its own; repeated rows count each; an empty table gives an empty result; with
one host, or hosts that all agree, the prior is as strong as ``MOST_PRIOR``
documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.llm.common import SPACE, durable, words_in

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Posterior mean failure rate above which a host is bad.
HOST_RATE = 0.8
#: Bounds of the prior's weight, in documents.
LEAST_PRIOR, MOST_PRIOR = 1.0, 1000.0


def document_stats(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every row.

    A 5-word window is known by a 64-bit hash of its words.  Windows found twice
    are sorted by hash only in texts that have any; their places then say which
    words they cover, in time n log n for texts of any length.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(host).cast("string").alias("host"),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.transform(words_in(text), lambda w: F.xxhash64(w)).alias("_words"),
    )
    # Words are hashed once; a window mixes its five hashes by place.
    w = F.col("_words")
    n = F.size(w)
    # null stays null in arrays_zip beyond an array's end, so windows that are too short drop out
    windows = F.transform(
        F.slice(
            F.arrays_zip(w.alias("a"), F.slice(w, 2, n).alias("b"), F.slice(w, 3, n).alias("c"), F.slice(w, 4, n).alias("d"), F.slice(w, 5, n).alias("e")),
            1, F.greatest(n - WINDOW + 1, F.lit(0)),
        ),
        lambda x: F.xxhash64(x),
    )
    cut = base.select(
        "doc_id", "host", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        n.cast("long").alias("n_words"),
        F.when(n >= WINDOW, windows).alias("_windows"),
    )
    marked = cut.withColumn("_twice", F.coalesce(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.lit(False)))
    return marked.withColumn("n_repeat_words", F.when(F.col("_twice"), _covered(F.col("_windows"))).otherwise(F.lit(0)).cast("long")).drop("_windows", "_twice")


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more."""
    n = F.size(windows)
    # (hash, place) in order; a window is repeated if the entry before or after has its hash
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        return F.transform(
            F.filter(
                F.arrays_zip(s.alias("x"), F.concat(F.array(F.lit(None).cast(_ENTRY)), F.slice(s, 1, n - 1)).alias("y"), F.concat(F.slice(s, 2, n), F.array(F.lit(None).cast(_ENTRY))).alias("z")),
                lambda v: v["x"]["h"].eqNullSafe(v["y"]["h"]) | v["x"]["h"].eqNullSafe(v["z"]["h"]),
            ),
            lambda v: v["x"]["i"],
        )

    # Each place covers up to the next one, WINDOW words at most.
    def words(p: Column) -> Column:
        return F.aggregate(
            F.arrays_zip(p.alias("p"), F.slice(p, 2, n).alias("q")),
            F.lit(0),
            lambda total, v: total + F.coalesce(F.least(v["q"] - v["p"], F.lit(WINDOW)), F.lit(WINDOW)),
        )

    return _let(placed, lambda s: _let(F.sort_array(repeated(s)), words))


_ENTRY = "struct<h:bigint,i:int>"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once: a one-element array binds it to a lambda's variable."""
    return F.transform(F.array(value), body)[0]


def base_rules(stats: DataFrame, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT) -> DataFrame:
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return stats.withColumn("base_failed", failed)


def host_verdicts(judged: DataFrame, host_rate: float = HOST_RATE) -> DataFrame:
    """(host, documents, failed, rate, host_bad) of every host in (host, base_failed)."""
    hosts = durable(judged.groupBy("host").agg(F.count("*").alias("documents"), F.count_if("base_failed").alias("failed")), "hosts")
    rate = F.col("failed") / F.col("documents")
    row = hosts.agg(
        F.sum("documents").alias("n"), F.sum("failed").alias("f"), F.count("*").alias("k"),
        F.sum(F.col("documents") * rate * rate).alias("square"), F.sum(F.col("documents") * F.col("documents")).alias("size2"),
    ).first()
    alpha, beta = beta_prior(row["n"], row["f"], row["k"], row["square"], row["size2"])
    shrunk = (F.col("failed") + F.lit(alpha)) / (F.col("documents") + F.lit(alpha + beta))
    return hosts.withColumn("rate", shrunk).withColumn("host_bad", F.col("rate") > F.lit(host_rate))


def beta_prior(n: int | None, failed: int | None, hosts: int, square: float | None, size2: int | None) -> tuple[float, float]:
    """Beta parameters by weighted moments of the hosts' rates.

    The spread of rates beyond what chance gives hosts of these sizes is the
    spread of the prior; the less there is of it, the stronger the prior.
    """
    if not n:
        return 0.5, 0.5
    mean = failed / n
    mean = min(max(mean, 0.5 / (n + 1)), 1 - 0.5 / (n + 1))
    chance = mean * (1 - mean)
    seen = max(square - n * mean * mean, 0.0)  # weighted sum of squared deviations
    room = n - size2 / n  # its expectation per unit of the prior's variance
    spread = (seen - (hosts - 1) * chance) / room if room > 0 and hosts > 1 else 0.0
    weight = chance / spread - 1 if spread > 0 else MOST_PRIOR
    weight = min(max(weight, LEAST_PRIOR), MOST_PRIOR)
    return mean * weight, (1 - mean) * weight


def judge(docs: DataFrame, host: str = "source", host_rate: float = HOST_RATE) -> DataFrame:
    """Statistics and verdicts of every document: base_failed, host_rate, host_bad, kept."""
    judged = durable(base_rules(document_stats(docs, host)), "judged")
    verdicts = host_verdicts(judged, host_rate).select(F.col("host").alias("_host"), F.col("rate").alias("host_rate"), "host_bad")
    return (
        judged.join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left")
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_bad")).drop("_host")
    )
