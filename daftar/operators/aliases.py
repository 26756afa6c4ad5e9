"""The spelling dictionary for grades and subjects, and the joins against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daftar.functions import names
from daftar.functions.names import normalise_token

_ALIAS = "kind string, canonical string, variant string, ord int"

# Spellings the default dictionary is generated from.
_ORDINALS = {
    1: ["1", "1ere", "1er", "1eme", "premiere", "premier", "first", "الأولى", "أول"],
    2: ["2", "2eme", "deuxieme", "second", "الثانية", "ثانية"],
    3: ["3", "3eme", "troisieme", "third", "الثالثة", "ثالثة"],
    4: ["4", "4eme", "quatrieme", "الرابعة"],
    5: ["5", "5eme", "cinquieme", "الخامسة"],
    6: ["6", "6eme", "sixieme", "السادسة"],
}
_CYCLES = [
    ("Bac", 2, ["bac", "baccalaureat", "bacalaureat", "annee bac", "بكالوريا", "باك"]),
    ("collège", 3, ["college", "col", "ac", "annee college", "إعدادي", "اعدادي"]),
    ("primaire", 6, ["primaire", "prim", "ap", "annee primaire", "ابتدائي"]),
]
_TRONC = ["tcs", "tc", "tronc commun", "tronc commun scientifique", "common core", "الجذع المشترك", "جذع مشترك"]
_SUBJECTS = {
    names.MATHS: ["math", "maths", "mathematique", "mathematiques", "mathematics", "الرياضيات", "رياضيات"],
    names.LIFE: ["svt", "biof", "bio", "biologie", "sciences vie", "sciences terre", "علوم الحياة والأرض"],
    names.PHYSICS: ["pc", "physique", "physics", "chimie", "physique chimie", "الفيزياء", "الكيمياء"],
    names.FRENCH: ["fr", "francais", "french", "langue francaise", "الفرنسية", "اللغة الفرنسية"],
    names.ARABIC: ["arabe", "arabic", "arab", "langue arabe", "العربية", "اللغة العربية"],
    names.ENGLISH: ["anglais", "english", "ang", "langue anglaise", "الإنجليزية"],
    names.ISLAMIC: ["islam", "islamique", "education islamique", "التربية الإسلامية", "الاسلامية"],
    names.SOCIAL: ["histoire", "geographie", "histoire geographie", "hist geo", "الاجتماعيات"],
    names.PHILOSOPHY: ["philo", "philosophie", "philosophy", "الفلسفة", "فلسفة"],
    names.SCIENCE: ["activite scientifique", "sciences", "النشاط العلمي"],
    names.ENGINEERING: ["si", "informatique", "info", "sciences de l ingenieur"],
    names.ECONOMICS: ["eco", "economie", "economie generale", "الاقتصاد"],
    names.ACCOUNTING: ["compta", "comptabilite", "المحاسبة"],
    names.BUSINESS: ["eoae", "organisation administrative"],
}


def default_aliases(spark: SparkSession) -> DataFrame:
    """Dictionary generated from the spellings above: every ordinal with every
    cycle word, in both orders, joined or spaced."""
    rows: list[tuple[str, str, str]] = []
    for cycle, levels, words in _CYCLES:
        for level in range(1, levels + 1):
            canonical = f"{level}{'ère' if level == 1 else 'ème'} année {cycle}"
            for o in _ORDINALS[level]:
                for w in words:
                    rows += [("grade", canonical, f"{o} {w}"), ("grade", canonical, f"{o}{w}")]
                    if o.isdigit():
                        rows += [("grade", canonical, f"{w} {o}"), ("grade", canonical, f"{w}{o}")]
    rows += [("grade", "Tronc Commun", v) for v in _TRONC]
    rows += [("subject", c, v) for c, vs in _SUBJECTS.items() for v in vs]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], _ALIAS)


def load_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Dictionary from a JSON file ``{"grades": {canonical: [variants]}, "subjects": {...}}``."""
    kind = "struct<grades:map<string,array<string>>,subjects:map<string,array<string>>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("d"))

    def part(field: str, name: str) -> DataFrame:
        entries = doc.select(F.posexplode(F.map_entries(F.col("d")[field])).alias("i", "e"))
        return entries.select(
            F.lit(name).alias("kind"),
            F.col("e.key").alias("canonical"),
            F.posexplode("e.value").alias("j", "variant"),
            "i",
        ).select("kind", "canonical", "variant", (F.col("i") * 100_000 + F.col("j")).cast("int").alias("ord"))

    return part("grades", "grade").unionByName(part("subjects", "subject"))


def alias_index(aliases: DataFrame) -> DataFrame:
    """One canonical value per normalised spelling; a later entry overrides an
    earlier one but keeps the earlier place in the order."""
    return (
        aliases.withColumn("token", normalise_token(F.col("variant")))
        .groupBy("kind", "token")
        .agg(F.max_by("canonical", "ord").alias("canonical"), F.min("ord").alias("ord"))
    )


def _of_kind(index: DataFrame, kind: str) -> DataFrame:
    return index.filter(F.col("kind") == kind).select(
        F.col("token").alias("_token"), F.col("canonical").alias("_canonical"), F.col("ord").alias("_ord")
    )


def alias_join(df: DataFrame, index: DataFrame, column: str, kind: str, output: str) -> DataFrame:
    """Canonical value of ``column`` by exact match of its normalised token."""
    table = _of_kind(index, kind).select("_token", F.col("_canonical").alias(output))
    return df.join(table, normalise_token(F.col(column)) == F.col("_token"), "left").drop("_token")


def alias_ngram_join(df: DataFrame, index: DataFrame, key: str, parts: str, kind: str, output: str) -> DataFrame:
    """First phrase of three, two or one ``parts`` that the dictionary knows.

    ``key`` identifies a row; longer phrases win, then the leftmost.
    """
    return _ngram_join(df, index, key, parts, {kind: output})


def _ngram_join(df: DataFrame, index: DataFrame, key: str, parts: str, outputs: dict[str, str]) -> DataFrame:
    """``alias_ngram_join`` for several kinds (with their output columns) in one pass over the phrases.

    Phrases outweigh the files they come from by far, so the plan must not take them
    for a small table: they stay on the left of an outer join, which only its right
    side, the dictionary, can be broadcast for.
    """
    def grams(n: int):
        starts = F.when(F.size("_norm") >= n, F.sequence(F.lit(1), F.size("_norm") - (n - 1)))
        phrase = lambda i: F.struct(
            F.lit(3 - n).alias("n"), i.alias("i"),
            F.array_join(F.filter(F.slice("_norm", i, F.lit(n)), lambda p: p != ""), " ").alias("phrase"),
        )
        return F.coalesce(F.transform(starts, phrase), F.array().cast("array<struct<n:int,i:int,phrase:string>>"))

    # A phrase's token is its parts' tokens, joined; few large files are dealt out before the work begins.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(key, parts).repartition(tasks, key).select(key, F.transform(parts, normalise_token).alias("_norm"))
    words = rows.select(key, F.explode(F.concat(grams(3), grams(2), grams(1))).alias("g")).select(key, "g.n", "g.i", F.col("g.phrase").alias("_phrase"))
    table = index.filter(F.col("kind").isin(*outputs)).select(F.col("kind").alias("_kind"), F.col("token").alias("_token"), F.col("canonical").alias("_canonical"))
    hits = words.join(table, F.col("_phrase") == F.col("_token"), "left")
    best = hits.groupBy(key).agg(*[
        F.min_by("_canonical", F.when(F.col("_kind") == kind, F.struct("n", "i"))).alias(output) for kind, output in outputs.items()
    ])
    return df.join(best, key, "left")


def alias_fuzzy_join(df: DataFrame, index: DataFrame, column: str, kind: str, output: str, max_dist: int = 2) -> DataFrame:
    """Nearest spelling within ``max_dist`` edits for tokens of three or more characters.

    Distinct tokens are matched once.  A spelling cut into ``max_dist + 1`` segments
    keeps one of them whole under ``max_dist`` edits, shifted by as many places at
    most; words and spellings meet on such a segment, and the bounded Levenshtein
    test runs on what has met.
    """
    tokens = df.select(F.col(column).alias("_word")).filter(F.length("_word") >= 3).distinct()
    cut = F.explode(F.sequence(F.lit(0), F.lit(max_dist))).alias("_seg")

    def edge(seg: Column) -> Column:
        return F.floor(seg * F.col("_len") / F.lit(max_dist + 1)).cast("int")

    def segment(text: str, at: Column) -> Column:
        return F.col(text).substr(at + 1, F.col("_size")).alias("_piece")

    start, size = edge(F.col("_seg")), edge(F.col("_seg") + 1) - edge(F.col("_seg"))
    spellings = _of_kind(index, kind).withColumn("_len", F.length("_token")).select("*", cut).withColumn("_size", size)
    table = spellings.select("_token", "_canonical", "_ord", "_len", "_seg", segment("_token", start))
    n = F.length("_word")
    places = tokens.select("_word", F.explode(F.sequence(F.greatest(n - max_dist, F.lit(1)), n + max_dist)).alias("_len")).select("*", cut).withColumn("_size", size)
    places = places.select("*", F.explode(F.sequence(start - max_dist, start + max_dist)).alias("_at")).filter((F.col("_at") >= 0) & (F.col("_at") + F.col("_size") <= n))
    keys = places.select("_word", "_len", "_seg", segment("_word", F.col("_at"))).distinct()
    met = keys.join(table, ["_len", "_seg", "_piece"]).select("_word", "_token", "_canonical", "_ord").distinct()
    distance = F.levenshtein("_word", "_token", max_dist)
    near = met.filter(distance >= 0)
    best = near.groupBy("_word").agg(F.min_by("_canonical", F.struct(distance, "_ord")).alias(output))
    return df.join(best, F.col(column) == F.col("_word"), "left").drop("_word")


def filename_hints(files: DataFrame, index: DataFrame, key: str = "file_id", name: str = "filename") -> DataFrame:
    """grade_hint, topic_hint and subject_hint of each file name."""
    df = files.withColumn("_parts", names.name_parts(F.col(name)))
    df = df.withColumn("_g1", names.first_token(F.col("_parts"), names.GRADE_TOKENS))
    df = df.withColumn("_s1", names.first_token(F.col("_parts"), names.SUBJECT_TOKENS))
    # The phrase pass runs only for names without a subject token.
    open_names = df.filter(F.col("_s1").isNull()).select(key, "_parts")
    phrases = _ngram_join(open_names, index, key, "_parts", {"grade": "_g2", "subject": "_s2"}).drop("_parts")
    df = df.join(phrases, key, "left")
    return df.select(
        *files.columns,
        F.coalesce(names.grade_hint(F.col(name)), "_g1", "_g2").alias("grade_hint"),
        names.topic_hint(F.col(name)).alias("topic_hint"),
        F.coalesce("_s1", "_s2").alias("subject_hint"),
    )


def canonical_grade(df: DataFrame, index: DataFrame, hint: str = "grade_hint", output: str = "grade_name") -> DataFrame:
    """Grade name of a hint: dictionary, else token table, else the hint itself."""
    df = alias_join(df, index, hint, "grade", "_alias")
    token = F.try_element_at(names.literal_map(names.GRADE_TOKENS), F.col(hint))
    return df.withColumn(output, F.coalesce("_alias", token, hint)).drop("_alias")
