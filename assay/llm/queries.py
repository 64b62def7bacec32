"""The pN_ queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.catalog import table
from . import canonical, defects, encode, forest, mixing, pii, quota, splits, stable

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.main_labels(table(spark, d, "run_inference_bird"), table(spark, d, "dev_tied_append"))


def p1_labels(spark: SparkSession, d: str) -> DataFrame:
    return defects.labels(table(spark, d, "run_inference_bird"), table(spark, d, "dev_tied_append"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.bound_pairs(table(spark, d, "dev_tied_append"))


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.grouped_splits(table(spark, d, "dev_tied_append"), table(spark, d, "split_targets"))


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    return stable.stable_sample(table(spark, d, "dev_tied_append"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    near = forest.near_pairs(table(spark, d, "dev_tied_append"), "record_id", ["question", "evidence", "sql_text"])
    return near.withColumnsRenamed({"id_a": "record_id_a", "id_b": "record_id_b"})


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return forest.near_groups(table(spark, d, "dev_tied_append"), "record_id", ["question", "evidence", "sql_text"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return quota.unmet_in_sample(table(spark, d, "dev_tied_append"), table(spark, d, "sample_targets"))


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    return quota.quota_sample(table(spark, d, "dev_tied_append"), table(spark, d, "sample_targets"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return quota.quota_report(table(spark, d, "dev_tied_append"), table(spark, d, "sample_targets")).drop("drawn")


def p5_drawn(spark: SparkSession, d: str) -> DataFrame:
    return quota.quota_report(table(spark, d, "dev_tied_append"), table(spark, d, "sample_targets")).select("target_no", "db_id", "difficulty", "drawn")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.copies_found(table(spark, d, "run_inference_bird"), "candidate_id", ["pred_sql", "gold_sql"])


def p6_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return canonical.collapsed(table(spark, d, "run_inference_bird"), "candidate_id", ["pred_sql", "gold_sql"])


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encoded(table(spark, d, "documents"), "doc_id", "text")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_shards(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[2]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(table(spark, d, "documents"), table(spark, d, "name_lexicon"))


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "documents"), table(spark, d, "name_lexicon"))


def queries() -> dict[str, Query]:
    names = [p1_found, p1_labels, p2_found, p2_splits, p3_sample, p4_found, p4_groups, p5_found, p5_sample, p5_report, p5_drawn, p6_found, p6_collapsed, p7_ids, p8_mix, p8_report, p8_shards, p9_found, p9_redacted]
    return {f.__name__: f for f in names}


_LEVEL = "CASE WHEN coalesce(lower(trim(difficulty)), '') = '' THEN 'unknown' ELSE lower(trim(difficulty)) END"


def oracle_sql() -> dict[str, str]:
    unmet = f"""
WITH units AS (SELECT DISTINCT question_id, db_id, {_LEVEL} AS difficulty FROM dev_tied_append WHERE question_id IS NOT NULL),
seen AS (SELECT db_id, difficulty, count(*) AS available FROM units GROUP BY ALL),
t AS (SELECT s.*, coalesce(seen.available, 0) AS available,
  greatest(s.min_rows, (s.share_per_10000::BIGINT * s.sample_size + 9999) // 10000) AS need
  FROM sample_targets s LEFT JOIN seen ON s.db_id = seen.db_id AND s.difficulty = seen.difficulty)
"""
    return {
        "p2_found": """
WITH RECURSIVE k AS (SELECT DISTINCT db_id, question_id, regexp_replace(lower(trim(db_id, '  ')), '[-_  ]+', '_', 'g') AS name FROM dev_tied_append WHERE db_id IS NOT NULL),
edges AS (SELECT DISTINCT a.name AS x, b.name AS y FROM k a JOIN k b ON a.question_id = b.question_id),
reach AS (SELECT DISTINCT name AS x, name AS y FROM k UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
v AS (SELECT DISTINCT db_id, name FROM k)
SELECT a.db_id AS db_id_a, b.db_id AS db_id_b FROM v a JOIN reach r ON a.name = r.x JOIN v b ON r.y = b.name WHERE a.db_id < b.db_id
""",
        "p3_sample": f"""
WITH u AS (SELECT DISTINCT question_id, {_LEVEL} AS stratum FROM dev_tied_append WHERE question_id IS NOT NULL),
r AS (SELECT *, CASE stratum WHEN 'simple' THEN 0.1 WHEN 'moderate' THEN 0.15 WHEN 'challenging' THEN 0.25 WHEN 'unknown' THEN 0.2 ELSE 0.1 END AS rate FROM u)
SELECT question_id, stratum FROM r WHERE ('0x' || substr(md5('sample-1:' || question_id), 1, 13))::BIGINT / 4503599627370496.0 < rate
QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY rate DESC, stratum) = 1
""",
        "p4_found": r"""
WITH s AS (SELECT record_id, list_distinct(regexp_extract_all(lower(concat_ws(' ', question, evidence, sql_text)), '[\pL\pN_]+')) AS w FROM dev_tied_append),
t AS (SELECT record_id, unnest(w) AS word FROM s), f AS (SELECT word, count(*) AS n FROM t GROUP BY 1),
r AS (SELECT t.record_id, t.word, row_number() OVER (PARTITION BY t.record_id ORDER BY f.n, t.word) AS pos FROM t JOIN f USING (word)),
p AS (SELECT r.record_id, r.word FROM r JOIN s USING (record_id) WHERE r.pos <= len(s.w) - ceil(0.75 * len(s.w)) + 1),
c AS (SELECT DISTINCT x.record_id AS a, y.record_id AS b FROM p x JOIN p y ON x.word = y.word AND x.record_id < y.record_id),
v AS (SELECT a, b, len(list_intersect(m.w, n.w)) AS k, len(m.w) AS ka, len(n.w) AS kb FROM c JOIN s m ON a = m.record_id JOIN s n ON b = n.record_id)
SELECT a AS record_id_a, b AS record_id_b FROM v WHERE k >= 0.75 * (ka + kb - k)
""",
        "p5_found": unmet + "SELECT DISTINCT db_id, difficulty FROM t WHERE need > available",
        "p5_report": unmet + "SELECT target_no, db_id, difficulty, available, need::BIGINT AS need, greatest(0, need - available)::BIGINT AS deficit FROM t",
    }
