"""File names, aliases and name resolution."""

import pytest
from pyspark.sql import functions as F

from daftar.functions import names
from daftar.operators import aliases, resolve

CASES = [
    ("تمارين-معالجة-المياه-لأولى-إعدادي-نموذج1.pdf", "ar", "exercise", "الأولى إعدادي", "1ac", "معالجة المياه", "نموذج1", "medium"),
    ("درس-الهواء-الثانية-إعدادي.pdf", "ar", "lesson", "الثانية إعدادي", "2ac", "الهواء", None, "medium"),
    ("controle-electricite-1ere-college.pdf", "fr", "exam", "الأولى إعدادي", "1ac", "electricite", None, "medium"),
    ("exercices_traitement_des_eaux_1ac.pdf", "fr", "exercise", "الأولى إعدادي", "1ac", "traitement des eaux", None, "medium"),
    ("ملخص-التغذية-الثالثة-إعدادي.pdf", "ar", "summary", "الثالثة إعدادي", "3ac", "التغذية", None, "medium"),
    ("6ème année primaire_UnknownGrade_6ème année primaire_UnknownGrade_UnknownSubject_Document (90).pdf", "fr", "unknown", "6ème année primaire", "6ap", None, None, "low"),
]


def test_golden_filenames(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, f string")
    df = df.withColumn("n", names.normalise_filename(F.col("f"))).withColumn("g", names.detect_grade_slug(F.col("n")))
    n, none = F.col("n"), F.lit(None).cast("string")
    df = df.withColumn("t", names.cleanup_topic(n, F.col("g"))).withColumn("k", names.detect_document_type(n))
    rows = df.orderBy("i").select(
        names.detect_language(n), "k", names.detect_grade_label(n), "g", "t", names.detect_variant(n),
        names.metadata_confidence(F.col("g"), F.col("t"), F.col("k"), none), names.metadata_warnings(F.col("g"), F.col("t"), none),
    ).collect()
    for case, row in zip(CASES, rows):
        assert tuple(row)[:7] == case[1:]
    assert len(rows[0][7]) == 1 and len(rows[5][7]) == 2


def test_token_and_slug(spark):
    df = spark.createDataFrame([("Mathématiques  (Éco)",), ("الرِّياضيات",)], "c string")
    got = [tuple(r) for r in df.select(names.normalise_token(F.col("c")), names.slugify_label(F.col("c"))).collect()]
    assert got[0] == ("mathematiques eco", "mathematiques-eco")
    assert got[1][1] == "الرياضيات"
    more = spark.createDataFrame([("Ｆｉche ﬁnale n²",), ("Άλφα й",), ("المائي",), ("e\u0301te\u0301",)], "c string")
    slugs = [r[0] for r in more.select(names.slugify_label(F.col("c"))).collect()]
    assert slugs == ["fiche-finale-n2", "αλφα-и", "الماي-ي", "ete"]


def test_compat_form(spark):
    df = spark.createDataFrame([("ﬁche_1.pdf",), ("anne\u0301e_1.pdf",)], "c string")
    assert [r[0] for r in df.select(names.normalise_filename(F.col("c"))).collect()] == ["fiche-1", "année-1"]


@pytest.fixture(scope="module")
def index(spark):
    return aliases.alias_index(aliases.default_aliases(spark)).cache()


def test_filename_hints(spark, index):
    files = [(1, "1bac-biof-svt.pdf"), (2, "tcs-physique.pdf"), (3, "x-langue anglaise.pdf"), (4, "unit-troisieme college-hist geo.pdf"), (5, "x.pdf")]
    df = spark.createDataFrame(files, "file_id int, filename string")
    out = aliases.canonical_grade(aliases.filename_hints(df, index), index)
    rows = {r.file_id: (r.grade_hint, r.topic_hint, r.subject_hint, r.grade_name) for r in out.collect()}
    assert rows[1] == ("1bac", "1bac", names.LIFE, "1ère année Bac")
    assert rows[2] == ("tcs", "tcs", names.PHYSICS, "Tronc Commun")
    assert rows[3] == (None, "x", names.ENGLISH, None)
    # "hist" is a subject token, so the phrase pass for the grade does not run.
    assert rows[4] == (None, "unit", names.SOCIAL, None)
    assert rows[5] == (None, "x", None, None)


def test_phrases_are_never_broadcast(spark, tmp_path):
    # The files look smaller to the planner than the dictionary; their phrases are not.
    files = spark.createDataFrame([(1, ["l\u00e9", "", "grand bleu", "x"]), (2, ["x"]), (3, []), (4, ["x", "Le", "grand"])], "file_id int, parts array<string>")
    files.coalesce(1).write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    entries = spark.range(5000).select(
        F.lit("subject").alias("kind"), F.concat(F.lit("s"), "id").alias("canonical"),
        F.when(F.col("id") == 7, "le grand bleu").when(F.col("id") == 8, "x").when(F.col("id") == 9, "le grand").otherwise(F.concat(F.lit("v"), "id")).alias("variant"),
        F.col("id").cast("int").alias("ord"),
    )
    out = aliases.alias_ngram_join(files, aliases.alias_index(entries), "file_id", "parts", "subject", "s")
    assert {r.file_id: r.s for r in out.collect()} == {1: "s7", 2: "s8", 3: None, 4: "s9"}
    assert "BuildLeft" not in out._jdf.queryExecution().executedPlan().toString()


def test_hint_phrases_are_never_broadcast(spark, index):
    out = aliases.filename_hints(spark.createDataFrame([(1, "unit-langue anglaise.pdf")], "file_id int, filename string"), index)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # One pass over the phrases serves both kinds.
    assert "BuildLeft" not in plan and plan.count("Generate explode(concat(") == 1


def test_fuzzy(spark, index):
    df = spark.createDataFrame([("mahts",), ("philosofie",), ("zz",), ("qqqqqqq",)], "w string")
    got = {r.w: r.s for r in aliases.alias_fuzzy_join(df, index, "w", "subject", "s").collect()}
    assert got == {"mahts": names.MATHS, "philosofie": names.PHILOSOPHY, "zz": None, "qqqqqqq": None}


def test_load_aliases(spark, tmp_path):
    path = tmp_path / "aliases.json"
    path.write_text('{"grades": {"G": ["g1", "G 1"]}, "subjects": {"S": ["s-1"]}}', encoding="utf-8")
    rows = aliases.alias_index(aliases.load_aliases(spark, str(path))).collect()
    assert {(r.kind, r.token, r.canonical) for r in rows} == {("grade", "g1", "G"), ("grade", "g 1", "G"), ("subject", "s 1", "S")}


def test_ambiguous_name_resolves_to_nothing(spark):
    grades = spark.createDataFrame([(1, "A", 10), (2, "a", 10), (3, "B", 11)], "grade_id int, name string, cycle_id int")
    cycles = spark.createDataFrame([(10, 100), (11, 101)], "cycle_id int, curriculum_id int")
    asks = spark.createDataFrame([("A",), ("b",), (None,)], "grade_name string")
    got = {r.grade_name: (r.grade_id, r.curriculum_id) for r in resolve.resolve_ancestors(asks, grades, cycles).collect()}
    assert got == {"A": (None, None), "b": (3, 101), None: (None, None)}


def test_containment_matches_brute_force(spark):
    needles = ["a", "ab", "abc", "bcd", "zz", "", "%", "x y"]
    texts = ["abcd", "xaby", "b", "zz", "10% x y", ""]
    n = spark.createDataFrame([(v,) for v in needles], "n string")
    t = spark.createDataFrame([(v,) for v in texts], "t string")
    got = {(r.n, r.t) for r in resolve.containment_join(n, "n", t, "t").collect()}
    assert got == {(a, b) for a in needles for b in texts if a and a in b}


def test_slug_of_plain_and_rare_letters(spark):
    """ASCII takes the short way; rare letters are sought as ranges."""
    from daftar.functions import names

    assert names._ranges("cxab") == r"\x{61}-\x{63}\x{78}-\x{78}"
    rows = [(0, "--The OLD  plate/Reader 7!"), (1, "Élève ½ ﬁn, œuvre"), (2, "السنة أولى"), (3, ""), (4, None), (5, "a–B")]
    got = spark.createDataFrame(rows, "i int, t string").select("i", names.slugify_label(F.col("t")).alias("s"))
    assert {r["i"]: r["s"] for r in got.collect()} == {0: "the-old-plate-reader-7", 1: "eleve-1-2-fin-œuvre", 2: "السنه-اولي", 3: "", 4: None, 5: "a-b"}
