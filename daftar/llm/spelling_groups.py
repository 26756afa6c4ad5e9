"""Spelling variants of words, found with permuterm rotations.

A word of n letters marked with an end sign has n + 1 rotations.  Rotating a word so that the
letter at place i comes last leaves ``rest after i + sign + rest before i`` as its beginning: the
word with that letter blanked.  In the sorted list of rotations, all words that have any other
letter there carry on behind the same beginning, and the word without the letter is that beginning
itself.  So replacements, insertions and deletions are prefix ranges that skip the edited letter.

1. Words are counted over all texts (aggregated per task first).
2. Every rotation is listed under its beginning without the last letter, and as it is for the
   range that it closes; the list is sorted by range partitions.
3. One scan of each range: a word's near words there are all others.  A range has at most one word
   per letter of the alphabet, plus the bare one, so none is hot.  Nothing is paired: a member takes
   the range's size and its most frequent other member.  A deletion inside a run of equal letters
   lies in several ranges; it is counted in the run's first.
4. A word's form is its most frequent near word, if that is ``RATIO`` times as frequent.  Counts grow
   along forms, so chains end; doubling follows them to the last in few rounds.

Nulls and edge cases: null texts hold no word; a null id is the empty string in the hash; a word that
loses its only letter is no word; ties of forms go to the smallest in code-point order; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daftar.llm.common import durable, parts_for

#: Letters of a word, fewest letters, fewest occurrences, and how much more frequent a form is.
LETTERS, MIN_LETTERS, MIN_COUNT, RATIO = r"A-Za-zÀ-ÿ", 6, 5, 5
#: One occurrence in so many is read with a letter missing.
SLIP = 199
#: Sign of a word's end; no letter.
END = "$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def without(word: Column, place: Column) -> Column:
    """The word without the letter at ``place`` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.lit(1 << 30)))


def word_counts(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, slip: int = SLIP) -> DataFrame:
    """(word, n) of the words that are long and frequent enough.

    A run that is too short stays so with a letter missing; only long ones leave the scan.
    """
    text = F.translate(F.col("text").cast("string"), _UPPER, _LOWER)
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{min_letters},}}"), F.lit(0))).alias("run"),
    )
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    read = F.when(h % slip == 0, without(F.col("run"), (h % F.char_length("run")).cast("int"))).otherwise(F.col("run"))
    words = runs.select(read.alias("word")).filter(F.char_length("word") >= min_letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def rotations(words: DataFrame) -> DataFrame:
    """(range, word, n, counted, bare): each word under the beginnings that skip one letter, and under its own rotations.

    ``counted`` is 1 where the skipped letter is the first of its run, 0 behind it.
    """
    length = F.char_length("word")
    tail = lambda i: F.substring("word", i + 1, F.lit(1 << 30))
    head = lambda i: F.substring("word", F.lit(1), i)
    skipped = F.transform(
        F.sequence(F.lit(0), length - 1),
        lambda i: F.struct(
            F.concat(tail(i + 1), F.lit(END), head(i)).alias("range"),
            F.when((i > 0) & (F.substring("word", i, F.lit(1)) == F.substring("word", i + 1, F.lit(1))), 0).otherwise(1).alias("counted"),
            F.lit(0).alias("bare"),
        ),
    )
    whole = F.transform(
        F.sequence(F.lit(0), length),
        lambda i: F.struct(F.concat(tail(i), F.lit(END), head(i)).alias("range"), F.lit(0).alias("counted"), F.lit(1).alias("bare")),
    )
    return words.withColumn("r", F.explode(F.concat(skipped, whole))).select("r.range", "word", "n", "r.counted", "r.bare")


def near_words(words: DataFrame, parts: int) -> DataFrame:
    """(word, n_near, form_n, best): how many words are one edit away, and the most frequent of them."""
    ranges = rotations(words).repartitionByRange(parts, "range")
    group = Window.partitionBy("range")
    order = group.orderBy(F.col("n").desc(), "word")
    other = F.coalesce(
        F.when(F.row_number().over(order) == 1, F.lead(F.struct("n", "word")).over(order)), F.first(F.struct("n", "word")).over(order)
    )
    scan = ranges.select(
        "word", "bare", "counted", other.alias("best"), F.count("*").over(group).alias("size"),
        F.sum("bare").over(group).alias("bares"), F.sum("counted").over(group).alias("edits"),
    ).filter("size > 1")
    near = F.when(F.col("bare") == 1, F.col("edits")).otherwise(F.col("size") - F.col("bares") - 1 + F.col("bares") * F.col("counted"))
    first = F.min(F.struct((-F.col("best.n")).alias("minus"), F.col("best.word").alias("word")))
    return scan.groupBy("word").agg(F.sum(near).alias("n_near"), first.alias("b")).select("word", "n_near", (-F.col("b.minus")).alias("best_n"), F.col("b.word").alias("best"))


def chain_ends(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): follows forms to the last, twice as far in each round."""
    now = durable(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = durable(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = joined.select("word", "root")
        if joined.filter("moved").isEmpty():
            return now


def group_spellings(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, ratio: int = RATIO, slip: int = SLIP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = durable(word_counts(docs, min_letters, min_count, slip), "words")
    near = near_words(words, parts_for(docs.sparkSession, 20 * words.count()))
    taken = F.col("best_n") >= F.col("n") * ratio
    found = durable(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(taken, F.col("best")).alias("form"), F.when(taken, F.col("best_n")).cast("long").alias("form_n"),
        ),
        "near",
    )
    roots = chain_ends(found.filter("form is not null").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
