"""Coverage of the curriculum tables: scores, gaps, planner steps, tree, option lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.operators.resolve import with_every
from daftar.operators.skew import keep_first
from daftar.session import durable


def coverage_score(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents, covered parents, and the covered share in percent."""
    hit = children.select(key).distinct().withColumn("_c", F.lit(1))
    out = parents.select(key).distinct().join(hit, key, "left").agg(
        F.count("*").alias("parents"), F.count("_c").alias("covered")
    )
    share = F.when(F.col("parents") > 0, F.round(100 * F.col("covered") / F.col("parents"), 0)).otherwise(F.lit(0.0))
    return out.withColumn("score", F.least(share, F.lit(100.0)).cast("int"))


def topic_score(grades: DataFrame, subjects: DataFrame, topics: DataFrame) -> DataFrame:
    """Topics present against a rough expectation from grades times subjects."""
    def count(df: DataFrame) -> Column:
        return df.agg(F.count("*")).scalar()

    out = grades.agg(F.count("*").alias("grades")).withColumn("subjects", count(subjects)).withColumn("topics", count(topics))
    possible = F.least(F.col("grades") * F.col("subjects") * 0.4, (F.col("topics") + 15).cast("double"))
    score = F.when((F.col("grades") > 0) & (F.col("subjects") > 0), F.least(F.round(100 * F.col("topics") / possible, 0), F.lit(100.0)))
    return out.select("topics", F.coalesce(score, F.lit(0.0)).cast("int").alias("score"))


def generic_score(table: DataFrame) -> DataFrame:
    n = F.col("rows")
    expected = F.when(n == 0, 10).otherwise(2 * n + 5)
    return table.agg(F.count("*").alias("rows")).withColumn("score", F.round(100 * n / expected, 0).cast("int"))


def gap_report(grades: DataFrame, subjects: DataFrame, topics: DataFrame, exercises: DataFrame, tracks: DataFrame, exams: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """One row per analysis: its name and score."""
    rows = [
        topic_score(grades, subjects, topics).select(F.lit("topics").alias("analysis"), "score"),
        coverage_score(topics, exercises, "topic_id").select(F.lit("exercises").alias("analysis"), "score"),
        coverage_score(tracks, exams, "track_id").select(F.lit("bac_exams").alias("analysis"), "score"),
        *[generic_score(t).select(F.lit(name).alias("analysis"), "score") for name, t in others.items()],
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def top_missing(gaps: DataFrame, n: int, *order: Column, by: str = "analysis") -> DataFrame:
    """The first ``n`` missing items of each analysis."""
    return keep_first(gaps, [by], order, n)


def is_bac(name: Column) -> Column:
    return F.contains(F.lower(name), F.lit("bac")) | F.contains(name, F.lit("البكالوريا"))


def is_bac_for_planner(name: Column) -> Column:
    return F.contains(F.lower(name), F.lit("bac")) | F.contains(name, F.lit("التأهيلي")) | F.contains(name, F.lit("Théologie"))


def subject_difference(mapped: DataFrame, topics: DataFrame) -> DataFrame:
    """Mapped (grade, subject) rows without a topic; repeated mappings stay repeated."""
    return mapped.join(topics.select("grade_id", "subject_id").distinct(), ["grade_id", "subject_id"], "left_anti")


def _first_names(missing: DataFrame, n: int, key: str, label: str, output: str) -> DataFrame:
    """The first ``n`` labels per grade; the list is bounded by ``n``."""
    first = keep_first(missing, ["grade_id"], [F.col(key)], n)
    pair = F.struct(F.col(key), F.col(label).alias("l"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["l"]), " | ")
    return first.groupBy("grade_id").agg(joined.alias(output))


def planner_steps(grades: DataFrame, mapped: DataFrame, subjects: DataFrame, topics: DataFrame, outlines: DataFrame, exercises: DataFrame, tracks: DataFrame) -> DataFrame:
    """Per grade the ordered steps with status, metrics and the first missing items.

    grades(grade_id, name), mapped(grade_id, subject_id), subjects(subject_id,
    name), topics(topic_id, title, grade_id, subject_id), outlines/exercises(topic_id).
    """
    named = subjects.select("subject_id", F.col("name").alias("subject_name"))
    links = mapped.groupBy("grade_id").agg(F.count("*").alias("n_subjects"))

    def per_topic(rows: DataFrame, n: str) -> DataFrame:
        return rows.groupBy("topic_id").agg(F.count("*").alias(n))

    # One row per topic with its numbers of children, written once for the three uses below.
    known = durable(
        topics.join(named, "subject_id").join(per_topic(outlines, "_o"), "topic_id", "left").join(per_topic(exercises, "_e"), "topic_id", "left")
        .select("grade_id", "topic_id", "subject_name", "_o", "_e", F.concat_ws(": ", "subject_name", "title").alias("label")),
        "topics",
    )
    counts = known.groupBy("grade_id").agg(
        F.count("*").alias("n_topics"), F.countDistinct("subject_name").alias("n_topic_subjects"), F.sum("_o").alias("n_outlines"), F.sum("_e").alias("n_exercises"),
        F.count_if(F.col("_o").isNull()).alias("m3"), F.count_if(F.col("_e").isNull()).alias("m4"),
    )
    gap = durable(subject_difference(mapped, topics).join(named, "subject_id"), "gaps")
    parts = (
        links, counts, gap.groupBy("grade_id").agg(F.count("*").alias("m2")), _first_names(gap, 5, "subject_id", "subject_name", "f2"),
        _first_names(known.filter("_o IS NULL"), 5, "topic_id", "label", "f3"), _first_names(known.filter("_e IS NULL"), 5, "topic_id", "label", "f4"),
    )
    df = grades.select("grade_id", "name")
    for part in parts:
        df = df.join(part, "grade_id", "left")
    df = df.fillna(0, ["n_subjects", "n_topics", "n_topic_subjects", "m2", "m3", "m4", "n_outlines", "n_exercises"])
    df = df.withColumn("n_tracks", tracks.agg(F.count("*")).scalar())

    has_subjects, has_topics = F.col("n_subjects") > 0, F.col("n_topics") > 0

    def status(locked: Column, missing: Column) -> Column:
        return F.when(locked, "locked").when(missing, "actionable").otherwise("completed")

    def text(*parts) -> Column:
        return F.concat(*[p if isinstance(p, str) is False else F.lit(p) for p in parts])

    def s(c: str) -> Column:
        return F.col(c).cast("string")

    def covered(n: str, m: str, word: str) -> Column:
        done = (F.col("n_topics") - F.col(m)).cast("string")
        return F.when(has_topics, text(s(n), f" {word} across ", done, "/", s("n_topics"), " Topics")).otherwise(f"0 {word}")

    def step(i: int, title: Column, st: Column, metrics: Column, missing: Column) -> Column:
        return F.struct(
            F.lit(i).alias("step"), title.alias("title"), st.alias("status"), metrics.alias("metrics"), missing.alias("first_missing")
        )

    none = F.lit(None).cast("string")
    steps = F.array_compact(F.array(
        step(1, text("Map Subjects to ", F.col("name")), status(F.lit(False), ~has_subjects), text(s("n_subjects"), " Subjects Linked"), none),
        step(2, F.lit("Build Syllabus Topics"), status(~has_subjects, ~has_topics | (F.col("m2") > 0)),
             F.when(has_topics, text(s("n_topics"), " Topics across ", s("n_topic_subjects"), " Subjects")).otherwise("0 Topics"),
             F.when(has_topics, F.col("f2"))),
        step(3, F.lit("Generate Lesson Outlines"), status(~has_topics, F.col("m3") > 0), covered("n_outlines", "m3", "Outlines"), F.col("f3")),
        step(4, F.lit("Populate Exercises"), status(~has_topics, F.col("m4") > 0), covered("n_exercises", "m4", "Exercises"), F.col("f4")),
        F.when(is_bac_for_planner(F.col("name")), step(
            5, F.lit("Configure Baccalaureate Tracks"), status(F.lit(False), F.col("n_tracks") == 0), text(s("n_tracks"), " Tracks Configured"), none)),
    ))
    return df.select("grade_id", F.explode(steps).alias("s")).select("grade_id", "s.*")


def curriculum_nodes(curricula: DataFrame, cycles: DataFrame, grades: DataFrame, mapped: DataFrame, subjects: DataFrame, sections: DataFrame, tracks: DataFrame, track_subjects: DataFrame) -> DataFrame:
    """The curriculum tree as rows: path, parent_path, type, name, n_children.

    Bac grades branch into sections, tracks and their subjects, other grades into
    their mapped subjects.  Rows instead of nested arrays keep every node small.
    """
    def s(c: str) -> Column:
        return F.col(c).cast("string")

    empty = F.lit(None).cast("string")
    top = curricula.select(s("curriculum_id").alias("path"), empty.alias("parent_path"), F.lit("curriculum").alias("type"), "name", empty.alias("grade"), empty.alias("subject"))
    cyc_path = F.concat_ws("/", s("curriculum_id"), s("cycle_id"))
    cyc = cycles.join(curricula.select("curriculum_id"), "curriculum_id", "left_semi")
    second = cyc.select(cyc_path.alias("path"), s("curriculum_id").alias("parent_path"), F.lit("cycle").alias("type"), "name", empty.alias("grade"), empty.alias("subject"))
    grd = grades.join(cyc.select("cycle_id", cyc_path.alias("_parent")), "cycle_id").withColumn("_path", F.concat_ws("/", "_parent", s("grade_id")))
    third = grd.select(F.col("_path").alias("path"), F.col("_parent").alias("parent_path"), F.lit("grade").alias("type"), "name", s("grade_id").alias("grade"), empty.alias("subject"))

    plain = grd.filter(~is_bac(F.col("name"))).select("grade_id", "_path")
    sub = subjects.select("subject_id", F.col("name").alias("_sname"))
    leaf = (
        plain.join(mapped.select("grade_id", "subject_id"), "grade_id")
        .join(sub, "subject_id", "left")
        .select(
            F.concat_ws("/", "_path", s("subject_id")).alias("path"), F.col("_path").alias("parent_path"), F.lit("subject").alias("type"),
            F.coalesce("_sname", F.lit("Unknown")).alias("name"), s("grade_id").alias("grade"), s("subject_id").alias("subject"),
        )
    )
    # Every Bac grade shows every section.
    sec = with_every(grd.filter(is_bac(F.col("name"))).select("grade_id", "_path"), sections.select("section_id", F.col("name").alias("section_name")), "section_id")
    sec = sec.withColumn("_sec", F.concat_ws("/", "_path", s("section_id")))
    fourth = sec.select(F.col("_sec").alias("path"), F.col("_path").alias("parent_path"), F.lit("section").alias("type"), F.col("section_name").alias("name"), s("grade_id").alias("grade"), empty.alias("subject"))
    trk = sec.join(tracks.select("track_id", "section_id", F.col("name").alias("_tname")), "section_id").withColumn("_trk", F.concat_ws("/", "_sec", s("track_id")))
    fifth = trk.select(F.col("_trk").alias("path"), F.col("_sec").alias("parent_path"), F.lit("track").alias("type"), F.col("_tname").alias("name"), s("grade_id").alias("grade"), empty.alias("subject"))
    last = (
        trk.join(track_subjects.select("track_id", "subject_id").distinct(), "track_id")
        .join(sub, "subject_id")
        .select(
            F.concat_ws("/", "_trk", s("subject_id")).alias("path"), F.col("_trk").alias("parent_path"), F.lit("subject").alias("type"),
            F.col("_sname").alias("name"), s("grade_id").alias("grade"), s("subject_id").alias("subject"),
        )
    )
    nodes = top
    for part in (second, third, leaf, fourth, fifth, last):
        nodes = nodes.unionByName(part)
    n = nodes.groupBy(F.col("parent_path").alias("_p")).agg(F.count("*").alias("n_children"))
    return nodes.join(n, F.col("path") == F.col("_p"), "left").drop("_p").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def node_tasks(nodes: DataFrame, topics: DataFrame) -> DataFrame:
    """Work left per node, from its number of children (of topics for a subject)."""
    per = topics.groupBy(F.col("grade_id").cast("string").alias("grade"), F.col("subject_id").cast("string").alias("subject")).agg(F.count("*").alias("n_topics"))
    df = nodes.join(per, ["grade", "subject"], "left").withColumn("n_topics", F.coalesce("n_topics", F.lit(0)))
    done = F.when(F.col("n_children") > 0, "completed").otherwise("actionable")
    t = F.col("type")

    def task(when: Column, title: str, status: Column) -> Column:
        return F.when(when, F.struct(F.lit(title).alias("title"), status.alias("status")))

    has_topics = F.col("n_topics") > 0
    tasks = F.array_compact(F.array(
        task(t == "curriculum", "Define Cycles", done),
        task(t == "cycle", "Define Grades", done),
        task(t == "grade", "Map Subjects", done),
        task((t == "grade") & is_bac(F.col("name")), "Verify Sections & Tracks", done),
        task(t == "section", "Define Tracks", done),
        task(t == "track", "Map Track Subjects", done),
        task(t == "subject", "Build Syllabus Topics", F.when(has_topics, "completed").otherwise("actionable")),
        task((t == "subject") & has_topics, "Lesson Outlines & Exercises", F.lit("actionable")),
    ))
    return df.select("path", "type", F.explode(tasks).alias("k")).select("path", "type", "k.*")


def ordered_names(dim: DataFrame, key: str, name: str = "name", limit: int | None = None) -> DataFrame:
    """Option list sorted by name; a list box passes the length it shows."""
    rows = dim.filter(F.col(name) != "").orderBy(name, key)
    return (rows if limit is None else rows.limit(limit)).select(key, name)


def recent(df: DataFrame, at: str, key: str, n: int) -> DataFrame:
    """The ``n`` newest rows."""
    return df.orderBy(F.col(at).desc(), F.col(key)).limit(n)
