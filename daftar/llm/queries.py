"""The operators of this subpackage as queries over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.llm import (
    chat_examples, filter_audit, host_rules, line_dedup, mixing, packing, quality_sampling, repeated_passages, secrets, sharding, simhash_dedup, spelling_groups, voronoi_knn,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_chat_examples(spark: SparkSession, sf: str) -> DataFrame:
    turns = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_examples.read_back(chat_examples.prefix_examples(turns.unionByName(extra)))


@query
def op2_pack_documents(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf, "documents"))


@query
def op3_simhash_groups(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(_table(spark, sf, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op4_host_rules(spark: SparkSession, sf: str) -> DataFrame:
    return host_rules.judge(_table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_bad"
    )


@query
def op5_sample_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality_sampling.sample_quality(_table(spark, sf, "documents"), _table(spark, sf, "labels")).select("doc_id", "log_weight", "key")


@query
def op6_knn_join(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _table(spark, sf, "embeddings")
    return voronoi_knn.knn_join(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


@query
def op7_shard_documents(spark: SparkSession, sf: str) -> DataFrame:
    placed = sharding.shard(_table(spark, sf, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op8_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken", "times")


@query
def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs).select("doc_id", "text", "n_lines", "n_dropped")


@query
def op10_secret_spans(spark: SparkSession, sf: str) -> DataFrame:
    spans = secrets.find_secrets(_table(spark, sf, "documents"))
    of = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long")
    names = F.array(*[F.lit(k) for k in (*secrets.KINDS, secrets.ADDED)])
    each = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda s: F.concat_ws(":", F.get(names, s["kinds"]), s["starts"].cast("string"), s["ends"].cast("string")))
    base = F.filter(each, lambda x: ~F.startswith(x, F.lit(secrets.ADDED + ":")))
    return spans.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(each, ",").alias("spans"), of(3).alias("n_added"),
    )


@query
def op11_spelling_groups(spark: SparkSession, sf: str) -> DataFrame:
    return spelling_groups.group_spellings(_table(spark, sf, "documents"))


@query
def op12_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.audit_filters(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


@query
def op13_repeated_passages(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_passages.remove_repeats(_table(spark, sf, "documents"))


# --- check SQL ---------------------------------------------------------------------

_WS = r"[\x20\x09-\x0D]"
_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda x: x <> '')"
_SPACE = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"


def _escaped(x: str) -> str:
    """The text with doubled backslashes and broken control strings (RE2 has no look-ahead)."""
    out = rf"replace({x}, '\', '\\')"
    for c in chat_examples.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


SQL["op1_chat_examples"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), p AS (
  SELECT *, sum(length('<|start|>' || {_escaped('role')} || '<|message|>' || {_escaped('text')} || '<|end|>')) OVER w AS upto,
    role = 'assistant' AS target, lead(1) OVER w IS NULL AS closing
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (target), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (target), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (target OR closing) AS BIGINT) AS formatted_chars,
  count(*) FILTER (target OR closing) AS examples
FROM p GROUP BY conv_id"""

SQL["op4_host_rules"] = rf"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS words, row_number() OVER () AS rid FROM documents
), win AS (
  SELECT rid, p, words[p:p + 4] AS five FROM (SELECT rid, words, unnest(generate_series(1, len(words) - 4)) AS p FROM w WHERE len(words) >= 5)
), twice AS (
  SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, five) AS n FROM win) WHERE n > 1
), cover AS (
  SELECT rid, count(DISTINCT p + k) AS n FROM twice, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY rid
), s AS (
  SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(translate(text, {_SPACE}, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: length(translate(x, {_SPACE}, '')) > 0) AS l FROM w) LEFT JOIN cover USING (rid)
), b AS (
  SELECT *, n_words < {host_rules.MIN_WORDS} OR 100 * n_repeat_words > {host_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s
), h AS (
  SELECT source, count(*)::DOUBLE AS d, count(*) FILTER (base_failed)::DOUBLE AS f FROM b GROUP BY source
), m AS (
  SELECT sum(d) AS n, count(*) AS k, least(greatest(sum(f) / sum(d), 0.5 / (sum(d) + 1)), 1 - 0.5 / (sum(d) + 1)) AS mean,
    sum(f * f / d) AS square, sum(d * d) AS size2 FROM h
), v AS (
  SELECT mean, mean * (1 - mean) AS chance,
    CASE WHEN n - size2 / n > 0 AND k > 1 THEN (greatest(square - n * mean * mean, 0) - (k - 1) * mean * (1 - mean)) / (n - size2 / n) ELSE 0 END AS spread FROM m
), a AS (
  SELECT mean, least(greatest(CASE WHEN spread > 0 THEN chance / spread - 1 ELSE {host_rules.MOST_PRIOR} END, {host_rules.LEAST_PRIOR}), {host_rules.MOST_PRIOR}) AS weight FROM v
), j AS (
  SELECT source, (f + mean * weight) / (d + weight) > {host_rules.HOST_RATE} AS host_bad FROM h, a
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_bad AS kept, host_bad
FROM b JOIN j ON b.source IS NOT DISTINCT FROM j.source"""

SQL["op6_knn_join"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), r AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM r) WHERE rank <= 20"""

SQL["op9_line_dedup"] = f"""
WITH d AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS lines, row_number() OVER () AS rid FROM documents
), l AS (
  SELECT source, line, count(*) AS n FROM (SELECT source, unnest(list_distinct(list_transform(lines, lambda x: trim(x, {_SPACE})))) AS line FROM d) WHERE line <> '' GROUP BY ALL
), t AS (
  SELECT source, count(*) AS pages FROM d GROUP BY source
), bad AS (
  SELECT l.source, list(line) AS bad FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source
  WHERE n >= {line_dedup.MIN_PAGES} AND n > {line_dedup.RATIO} * pages GROUP BY l.source
), k AS (
  SELECT d.*, list_filter(lines, lambda x: trim(x, {_SPACE}) = '' OR NOT list_contains(coalesce(bad, []), trim(x, {_SPACE}))) AS kept
  FROM d LEFT JOIN bad ON d.source IS NOT DISTINCT FROM bad.source
)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text,
  CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped
FROM k"""


# CRC-32, four bits at a time: the step of each value of the low four bits, by the polynomial's rule.
def _crc_step(x: int) -> int:
    for _ in range(4):
        x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
    return x


_CRC_STEPS = "[" + ", ".join(f"{_crc_step(i)}::BIGINT" for i in range(16)) + "]"

SQL["op11_spelling_groups"] = rf"""
WITH RECURSIVE r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS id, run
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{spelling_groups._UPPER}', '{spelling_groups._LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]{{{spelling_groups.MIN_LETTERS},}}')) AS run FROM documents)
), d AS (
  SELECT run, count(*) AS times, hex(encode(id || run)) AS x FROM r GROUP BY id, run
), c AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x) + 1), lambda i: strpos('0123456789ABCDEF', x[i + 1 - 2 * ((i + 1) % 2)]) - 1)),
    lambda a, b: xor(a >> 4, ({_CRC_STEPS})[xor(a & 15, b) + 1])), 4294967295::BIGINT) AS h FROM d
), m AS (
  SELECT times, CASE WHEN h % {spelling_groups.SLIP} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM c
), w AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM m WHERE length(word) >= {spelling_groups.MIN_LETTERS} GROUP BY word HAVING sum(times) >= {spelling_groups.MIN_COUNT}
), k AS (
  SELECT word, n, i, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)
), p AS (
  SELECT x.word, y.word AS other, y.n FROM k x JOIN k y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT k.word, w.word, w.n FROM k JOIN w ON k.a || k.b = w.word
  UNION SELECT w.word, k.word, k.n FROM k JOIN w ON k.a || k.b = w.word
), b AS (
  SELECT word, count(*) AS n_near, max(n) AS best_n, arg_min(other, (-n, other)) AS best FROM p GROUP BY word
), f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {spelling_groups.RATIO} * w.n THEN best END AS form,
    CASE WHEN best_n >= {spelling_groups.RATIO} * w.n THEN best_n END AS form_n FROM w LEFT JOIN b USING (word)
), t AS (
  SELECT word, word AS root FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON t.root = f.word WHERE f.form IS NOT NULL
), e AS (
  SELECT t.word, t.root FROM t JOIN f ON t.root = f.word WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM f JOIN e USING (word)"""

SQL["op12_filter_audit"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_WORDS} AS words FROM documents
), m AS (
  SELECT doc_id, part, [len(words) < {filter_audit.MIN_WORDS}, 100 * len(list_distinct(words)) < {filter_audit.MIN_DISTINCT_PERCENT} * len(words),
    100 * len(regexp_extract_all(text, '[A-Z]')) > {filter_audit.MAX_UPPER_PERCENT} * length(text), regexp_matches(text, '{filter_audit.SYMBOLS}'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails FROM d
), l AS (
  SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), g AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL
), o AS (
  SELECT '' AS o, 0 AS k UNION ALL SELECT o || f, k + 1 FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(o, f)
), s AS (
  SELECT o AS filter_order, step, strpos('ABCDE', o[step]) AS f, list_transform(range(1, step), lambda j: strpos('ABCDE', o[j])) AS before
  FROM (SELECT o, unnest(range(1, 6)) AS step FROM o WHERE k = 5)
), x AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails[f] AS failing, len(list_filter(before, lambda j: fails[j])) = 0 AS alive,
    fails[f] AND len(list_filter(fails, lambda j: j)) = 1 AS sole FROM g, s
), a AS (
  SELECT part, filter_order, step, f, sum(CASE WHEN alive AND NOT failing THEN n ELSE 0 END) AS kept, sum(CASE WHEN alive AND failing THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN failing AND NOT alive THEN n ELSE 0 END) AS redundant, sum(CASE WHEN sole THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN alive AND failing THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN alive AND failing THEN toxic ELSE 0 END) AS toxic_lost
  FROM x GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM a"""
