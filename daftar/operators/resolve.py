"""Turning names and hints into ids of the curriculum tables, and joined listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.functions.data import append_log
from daftar.functions.names import slugify_label
from daftar.operators.patterns import contained_in


def unique_names(dim: DataFrame, name: str, payload: list[str]) -> DataFrame:
    """Dimension rows by lower-case name; a name used twice resolves to nothing."""
    return (
        dim.filter(F.col(name).isNotNull())
        .groupBy(F.lower(name).alias("_name"))
        .agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in payload])
        .filter("_n = 1")
        .drop("_n")
    )


def resolve_ancestors(df: DataFrame, grades: DataFrame, cycles: DataFrame, grade: str = "grade_name") -> DataFrame:
    """grade_id, cycle_id and curriculum_id of a grade name."""
    known = unique_names(grades, "name", ["grade_id", "cycle_id"])
    above = cycles.select("cycle_id", "curriculum_id")
    return (
        df.join(known, F.lower(F.col(grade)) == F.col("_name"), "left").drop("_name").join(above, "cycle_id", "left")
    )


def containment_join(needles: DataFrame, needle: str, texts: DataFrame, text: str, condition: Column | None = None) -> DataFrame:
    """Pairs where ``text`` contains the non-empty ``needle``.

    All distinct needles are sought at once (``patterns.contained_in``); the rows of
    both sides then meet on whole strings.
    """
    pairs = contained_in(needles, needle, texts, text)
    fits = F.col("_within") == F.col(text)
    asked = needles.join(pairs, F.col(needle) == F.col("_sought")).drop("_sought")
    return asked.join(texts, fits if condition is None else fits & condition).drop("_within")


def topic_needle(hint: Column) -> Column:
    return F.lower(F.regexp_replace(hint, r"[_\-]+", " "))


def resolve_topic(df: DataFrame, topics: DataFrame, hint: str = "topic_hint") -> DataFrame:
    """First topic whose title contains the hint, within the grade when it is known.

    Adds topic_id and topic_subject_id; distinct (hint, grade) pairs are searched once.
    """
    ask = df.select(topic_needle(F.col(hint)).alias("_needle"), F.col("grade_id").alias("_grade")).distinct()
    titles = topics.select(
        F.lower("title").alias("_title"),
        F.col("topic_id").alias("_topic"),
        F.col("subject_id").alias("_subject"),
        F.col("grade_id").alias("_topic_grade"),
    )
    grade_fits = F.col("_grade").isNull() | (F.col("_grade") == F.col("_topic_grade"))
    found = containment_join(ask, "_needle", titles, "_title", grade_fits)
    best = found.groupBy("_needle", "_grade").agg(F.min(F.struct("_topic", "_subject")).alias("_hit"))
    same = (topic_needle(F.col(hint)) == F.col("_needle")) & F.col("grade_id").eqNullSafe(F.col("_grade"))
    return df.join(best, same, "left").select(
        *df.columns,
        F.col("_hit._topic").alias("topic_id"),
        F.col("_hit._subject").alias("topic_subject_id"),
    )


def general_topics(topics: DataFrame) -> DataFrame:
    """The lowest topic of each (grade, subject)."""
    return topics.groupBy("grade_id", "subject_id").agg(F.min("topic_id").alias("_general"))


def resolve_fallback(df: DataFrame, subjects: DataFrame, topics: DataFrame, subject: str = "subject_hint") -> DataFrame:
    """Where no topic was found: subject by name, then any topic of that grade and subject."""
    known = unique_names(subjects, "name", ["subject_id"]).withColumnRenamed("subject_id", "_by_name")
    df = df.join(known, F.lower(F.col(subject)) == F.col("_name"), "left").drop("_name")
    by_name = F.when(F.col("topic_id").isNull(), F.col("_by_name"))
    df = df.withColumn("subject_id", F.coalesce("topic_subject_id", by_name)).drop("_by_name")
    general = general_topics(topics).withColumnsRenamed({"grade_id": "_g", "subject_id": "_s"})
    df = df.join(general, (F.col("grade_id") == F.col("_g")) & (F.col("subject_id") == F.col("_s")), "left")
    return df.withColumn("topic_id", F.coalesce("topic_id", "_general")).drop("_g", "_s", "_general", "topic_subject_id")


def resolve_metadata_refs(df: DataFrame, grades: DataFrame, subjects: DataFrame, topics: DataFrame) -> DataFrame:
    """Ids given win; missing ones are looked up by name, the topic within grade and subject.

    Expects grade_id, subject_id, topic_id, grade_name, subject_name, topic_title.
    """
    g = unique_names(grades, "name", ["grade_id"]).withColumnsRenamed({"_name": "_gn", "grade_id": "_gid"})
    s = unique_names(subjects, "name", ["subject_id"]).withColumnsRenamed({"_name": "_sn", "subject_id": "_sid"})
    t = (
        topics.groupBy(F.col("grade_id").alias("_tg"), F.col("subject_id").alias("_ts"), F.lower("title").alias("_tt"))
        .agg(F.count("*").alias("_n"), F.first("topic_id").alias("_tid"))
        .filter("_n = 1")
        .drop("_n")
    )
    df = df.join(g, F.lower("grade_name") == F.col("_gn"), "left").join(s, F.lower("subject_name") == F.col("_sn"), "left")
    df = df.withColumn("grade_id", F.coalesce("grade_id", "_gid")).withColumn("subject_id", F.coalesce("subject_id", "_sid"))
    on = (F.col("grade_id") == F.col("_tg")) & (F.col("subject_id") == F.col("_ts")) & (F.lower("topic_title") == F.col("_tt"))
    df = df.join(t, on, "left").withColumn("topic_id", F.coalesce("topic_id", "_tid"))
    return df.drop("_gn", "_gid", "_sn", "_sid", "_tg", "_ts", "_tt", "_tid")


def slug_match_join(df: DataFrame, grades: DataFrame, topics: DataFrame, subjects: DataFrame) -> DataFrame:
    """Grade and subject for file metadata (grade_slug, grade_label, topic_title, confidence).

    A grade fits when the slugs are equal or its slug contains the grade code; a
    topic when one slug contains the other, within the grade if both name one.
    The lowest id wins.  A subject found lifts medium confidence to high.
    """
    asked = df.select("grade_slug", "grade_label").filter(F.col("grade_label").isNotNull()).distinct()
    asked = asked.withColumn("_code", slugify_label(F.col("grade_slug"))).withColumn("_label", slugify_label(F.col("grade_label")))
    named = grades.select("grade_id", F.col("name").alias("_gname"), slugify_label(F.col("name")).alias("_gslug"))
    equal = asked.join(named, F.col("_label") == F.col("_gslug"))
    inside = containment_join(asked, "_code", named, "_gslug")
    grade_hit = (
        equal.unionByName(inside)
        .groupBy(F.col("grade_slug").alias("_k1"), F.col("grade_label").alias("_k2"))
        .agg(F.min(F.struct("grade_id", "_gname")).alias("_g"))
    )
    on = F.col("grade_slug").eqNullSafe(F.col("_k1")) & (F.col("grade_label") == F.col("_k2"))
    out = df.join(grade_hit, on, "left").drop("_k1", "_k2")
    out = out.withColumn("grade_id", F.col("_g.grade_id")).withColumn("resolved_grade", F.coalesce("_g._gname", "grade_label")).drop("_g")

    topic = out.select(slugify_label(F.col("topic_title")).alias("_ask"), F.col("grade_id").alias("_in")).distinct()
    titles = topics.select(
        F.col("topic_id").alias("_t"), F.col("subject_id").alias("_s"),
        F.col("grade_id").alias("_tg"), slugify_label(F.col("title")).alias("_slug"),
    )
    fits = F.col("_in").isNull() | F.col("_tg").isNull() | (F.col("_in") == F.col("_tg"))
    pairs = containment_join(topic, "_ask", titles, "_slug", fits).unionByName(
        containment_join(titles, "_slug", topic, "_ask", fits)
    )
    topic_hit = pairs.groupBy(F.col("_ask"), F.col("_in")).agg(F.min(F.struct("_t", "_s")).alias("_hit"))
    on = (slugify_label(F.col("topic_title")) == F.col("_ask")) & F.col("grade_id").eqNullSafe(F.col("_in"))
    out = out.join(topic_hit, on, "left").drop("_ask", "_in")
    names = subjects.select(F.col("subject_id").alias("_sid"), F.col("name").alias("subject_label"))
    out = out.join(names, F.col("_hit._s") == F.col("_sid"), "left").withColumn("topic_id", F.col("_hit._t"))
    lifted = F.when(F.col("subject_label").isNotNull() & (F.col("confidence") == "medium"), "high")
    return out.withColumn("confidence", F.coalesce(lifted, "confidence")).drop("_hit", "_sid")


def chunk_listing(chunks: DataFrame, docs: DataFrame, grades: DataFrame, subjects: DataFrame, topics: DataFrame) -> DataFrame:
    """Chunks with the four rows they point to as nested structs."""
    def nested(dim: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
        return dim.select(key, F.struct(*fields).alias(name))

    return (
        chunks.join(nested(docs, "document_id", ["document_id", "filename"], "document"), "document_id", "left")
        .join(nested(grades, "grade_id", ["name"], "grade"), "grade_id", "left")
        .join(nested(subjects, "subject_id", ["name"], "subject"), "subject_id", "left")
        .join(nested(topics, "topic_id", ["title"], "topic"), "topic_id", "left")
    )


def job_listing(jobs: DataFrame, docs: DataFrame) -> DataFrame:
    doc = docs.select("document_id", F.struct("document_id", "filename").alias("document"))
    return jobs.join(doc, "document_id", "left")


def job_retry(jobs: DataFrame, docs: DataFrame, now: Column) -> DataFrame:
    """Jobs of existing documents, put back to pending with one more retry counted."""
    kept = jobs.join(docs.select("document_id"), "document_id", "left_semi")
    out = kept.withColumns({
        "status": F.lit("pending"),
        "retry_count": (F.coalesce("retry_count", F.lit(0)) + 1).cast("int"),
        "error_message": F.lit(None).cast("string"),
        "completed_at": F.lit(None).cast("timestamp"),
    })
    if "logs" in jobs.columns:
        out = out.withColumn("logs", append_log(F.col("logs"), F.lit("Retry requested."), "info", now))
    return out


def document_with_jobs(docs: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row per document and job (documents without a job keep one row).

    ``shown_status`` is the status of the document's first job.  The jobs stay
    rows, so a document with very many of them is no oversized array.
    """
    first = jobs.groupBy("document_id").agg(
        F.min_by("status", F.struct("created_at", "job_id")).alias("shown_status"),
        F.count("*").alias("n_jobs"),
    )
    known = docs.join(first, "document_id", "left")
    # Inner join plus the documents without jobs: unlike an outer join, its job
    # side can be split when one document has very many.
    own = jobs.select("document_id", "job_id", F.col("status").alias("job_status"))
    rows = own.join(known, "document_id").unionByName(known.filter(F.col("n_jobs").isNull()), allowMissingColumns=True)
    return rows.select(*known.columns, "job_id", "job_status").withColumn("shown_status", F.coalesce("shown_status", F.lit("metadata_required"))).withColumn(
        "n_jobs", F.coalesce("n_jobs", F.lit(0))
    )


def already_ingested(files: DataFrame, chunks: DataFrame, present: bool = True) -> DataFrame:
    """Files whose name some chunk carries in ``metadata.filename`` (or the others)."""
    seen = chunks.select(F.try_element_at("metadata", F.lit("filename")).alias("filename")).distinct()
    return files.join(seen, "filename", "left_semi" if present else "left_anti")


def missing_children(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents no child points to."""
    return parents.join(children.select(key).distinct(), key, "left_anti")


#: Keys in a bucket, on average, where rows of one table visit all keys of another.
BUCKET_KEYS = 1000


def buckets_for(keys: DataFrame) -> int:
    return max(1, -(-keys.count() // BUCKET_KEYS))


def bucket_of(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("_bucket")


def with_every(a: DataFrame, b: DataFrame, b_key: str) -> DataFrame:
    """Every row of ``a`` with every row of ``b``, where that is the result asked for.

    Rows of ``a`` visit the buckets of ``b``; neither side is collected.
    """
    n = buckets_for(b)
    visits = a.withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return visits.join(b.withColumn("_bucket", bucket_of(b_key, n)), "_bucket").drop("_bucket")


def missing_combinations(a: DataFrame, a_key: str, b: DataFrame, b_key: str, existing: DataFrame, limit: int | None = None) -> DataFrame:
    """(a, b) pairs absent from ``existing``.

    The keys of ``b`` are dealt to buckets of about ``BUCKET_KEYS``.  Each ``a`` row
    visits every bucket and takes the difference to the keys it already has there,
    so only missing pairs are produced and no list grows with the tables.
    """
    n = buckets_for(b)
    universe = b.select(b_key).filter(F.col(b_key).isNotNull()).groupBy(bucket_of(b_key, n)).agg(F.collect_set(b_key).alias("_all"))
    have = existing.groupBy(a_key, bucket_of(b_key, n)).agg(F.collect_set(b_key).alias("_have"))
    visits = a.select(a_key).distinct().withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rows = visits.join(universe, "_bucket").join(have, [a_key, "_bucket"], "left")
    gap = F.when(F.col("_have").isNull(), F.col("_all")).otherwise(F.array_except("_all", "_have"))
    out = rows.select(a_key, F.explode(gap).alias(b_key))
    return out if limit is None else out.orderBy(a_key, b_key).limit(limit)


def bridge_join(parents: DataFrame, parent_key: str, links: DataFrame, children: DataFrame, child_key: str, name: str = "name") -> DataFrame:
    """Many-to-many through a link table; a link to nothing is named ``Unknown``."""
    child = children.select(child_key, F.col(name).alias("child_name"))
    return (
        parents.join(links.select(parent_key, child_key), parent_key)
        .join(child, child_key, "left")
        .withColumn("child_name", F.coalesce("child_name", F.lit("Unknown")))
    )


def hierarchy_flatten(grades: DataFrame, cycles: DataFrame, curricula: DataFrame) -> DataFrame:
    c = cycles.select("cycle_id", F.col("name").alias("cycle_name"), "curriculum_id")
    u = curricula.select("curriculum_id", F.col("name").alias("curriculum_name"))
    return (
        grades.select("grade_id", "name", "cycle_id")
        .join(c, "cycle_id", "left")
        .join(u, "curriculum_id", "left")
        .select(
            "grade_id",
            "name",
            F.coalesce("cycle_name", F.lit("Unknown Cycle")).alias("cycle_name"),
            F.coalesce("curriculum_name", F.lit("Unknown Curriculum")).alias("curriculum_name"),
        )
    )


def chunk_detail(chunks: DataFrame, versions: DataFrame, embeddings: DataFrame) -> DataFrame:
    """A chunk's versions and embeddings as rows: kind, place (version or time), payload.

    Sort by ``place`` descending for the reviewer's view.
    """
    v = versions.select(
        "chunk_id", F.lit("version").alias("kind"), F.col("version_index").cast("long").alias("place"), F.col("content").alias("payload")
    )
    e = embeddings.select(
        "chunk_id", F.lit("embedding").alias("kind"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("place"), F.col("model").alias("payload")
    )
    parts = v.unionByName(e)
    alone = chunks.join(parts.select("chunk_id").distinct(), "chunk_id", "left_anti")
    rows = parts.join(chunks, "chunk_id").unionByName(alone, allowMissingColumns=True)
    return rows.select(*chunks.columns, "kind", "place", "payload")
