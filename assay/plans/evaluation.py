"""Queries of the evaluation operators over generated candidates, rewards and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sqltext import KEYWORDS
from ..operators import candidates as ops
from ..sources.catalog import table
from .catalogue import query

C = F.col


def _once(spark: SparkSession, d: str, columns: list[str] | None = None) -> DataFrame:
    df = table(spark, d, "run_inference_bird")
    return ops.first_delivery(df.select("candidate_id", "idx", "sample_id", *columns) if columns else df, ["idx", "sample_id"], "candidate_id")


_ONCE = "c AS (SELECT * FROM run_inference_bird QUALIFY row_number() OVER (PARTITION BY idx, sample_id ORDER BY candidate_id) = 1)"
_LEVEL_SQL = "CASE WHEN coalesce(trim(difficulty), '') = '' THEN 'unknown' ELSE lower(trim(difficulty)) END"


def _graded(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.coalesce(F.trim("difficulty"), F.lit("")) == "", F.lit("unknown")).otherwise(F.lower(F.trim("difficulty")))
    asked = table(spark, d, "dev_tied_append").groupBy("question_id").agg(F.min_by(level, "record_id").alias("difficulty"))
    rows = _once(spark, d, ["correct", "db_id"])
    return rows.join(asked, rows.idx == asked.question_id, "left")


@query(f"""
WITH {_ONCE}, q AS (SELECT question_id, arg_min({_LEVEL_SQL}, record_id) AS difficulty FROM dev_tied_append GROUP BY 1),
g AS (SELECT coalesce(q.difficulty, 'unknown') AS grp, c.correct FROM c LEFT JOIN q ON c.idx = q.question_id),
s AS (SELECT grp, sum(coalesce(correct, 0))::BIGINT AS correct, count(*) AS count FROM g GROUP BY 1),
f AS (SELECT * FROM (VALUES ('simple', 0), ('moderate', 1), ('challenging', 2)) v(grp, fixed))
SELECT grp, row_number() OVER (ORDER BY fixed NULLS LAST, coalesce(count, 0) DESC, grp) AS place, coalesce(correct, 0) AS correct, coalesce(count, 0) AS count,
 100.0 * coalesce(correct, 0) / greatest(1, coalesce(count, 0)) AS accuracy FROM s FULL JOIN f USING (grp)
""")
def ex_by_difficulty(spark: SparkSession, d: str) -> DataFrame:
    return ops.accuracy_by(_graded(spark, d), C("difficulty"), C("correct"), ops.LEVELS)


@query(f"""
WITH {_ONCE}, s AS (SELECT CASE WHEN coalesce(trim(db_id), '') = '' THEN 'unknown' ELSE db_id END AS grp, sum(coalesce(correct, 0))::BIGINT AS correct, count(*) AS count FROM c GROUP BY 1)
SELECT grp, row_number() OVER (ORDER BY count DESC, grp) AS place, correct, count, 100.0 * correct / greatest(1, count) AS accuracy FROM s
""")
def ex_by_database(spark: SparkSession, d: str) -> DataFrame:
    return ops.accuracy_by(_once(spark, d, ["correct", "db_id"]), C("db_id"), C("correct"))


@query("""
SELECT count(*) AS n, count(*) FILTER (length(trim(coalesce(pred_sql, ''))) > 0) AS pred_extracted, count(*) FILTER (length(trim(coalesce(pred_sql, ''))) = 0) AS pred_missing,
 count(*) FILTER (coalesce(pred_executed, false)) AS pred_executed, count(*) FILTER (NOT coalesce(pred_executed, false)) AS pred_failed,
 count(*) FILTER (coalesce(gold_executed, false)) AS gold_executed, count(*) FILTER (NOT coalesce(gold_executed, false)) AS gold_failed,
 count(*) FILTER (coalesce(pred_executed, false) AND coalesce(gold_executed, false)) AS both_executed,
 count(*) FILTER (coalesce(pred_executed, false) AND coalesce(gold_executed, false) AND coalesce(correct, 0) = 0) AS executed_but_wrong FROM run_inference_bird
""")
def execution_stats(spark: SparkSession, d: str) -> DataFrame:
    return ops.execution_stats(table(spark, d, "run_inference_bird"))


@query("""
SELECT 'stop_reason' AS what, stop_reason AS value, count(*) AS n FROM run_inference_bird GROUP BY 2
UNION ALL SELECT 'status', status, count(*) FROM run_inference_bird GROUP BY 2 UNION ALL SELECT 'correct', correct::VARCHAR, count(*) FROM run_inference_bird GROUP BY 2
""")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return ops.value_counts(table(spark, d, "run_inference_bird"), ["stop_reason", "status", "correct"])


_PASS = """CASE WHEN c <= 0 OR k <= 0 THEN 0.0 WHEN n - c < k THEN 1.0 ELSE 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1.0 - k::DOUBLE / i)) END"""
_PASS2 = """CASE WHEN c <= 0 OR least(2, n) <= 0 THEN 0.0 WHEN n - c < least(2, n) THEN 1.0 ELSE 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1.0 - least(2, n)::DOUBLE / i)) END"""


@query(f"""
WITH {_ONCE}, e AS (SELECT idx, count(*) AS n, count(*) FILTER (correct > 0) AS c, min(sample_id) FILTER (correct > 0) AS first_correct FROM c GROUP BY idx)
SELECT idx, n, c, first_correct, {_PASS2} AS pass_2 FROM e
""")
def pass_at_k(spark: SparkSession, d: str) -> DataFrame:
    return ops.pass_by_prompt(_once(spark, d, ["correct"])).withColumn("pass_2", ops.pass_at_k(C("n"), C("c"), F.least(F.lit(2), "n")))


@query(f"""
WITH {_ONCE}, p AS (SELECT DISTINCT question_id AS idx FROM dev_tied_append),
e AS (SELECT idx, count(*) AS n, count(*) FILTER (correct > 0) AS c, min(place) FILTER (correct > 0) AS first
 FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY sample_id) AS place FROM c) GROUP BY idx),
m AS (SELECT coalesce(n, 0) AS n, coalesce(c, 0) AS c, first, kk, least(kk, coalesce(n, 0)) AS k FROM p LEFT JOIN e USING (idx), range(1, 5) t(kk))
SELECT kk AS k, avg({_PASS}) AS estimated, avg(coalesce((first <= k)::INT::DOUBLE, 0)) AS prefix FROM m GROUP BY kk
""")
def pass_summary(spark: SparkSession, d: str) -> DataFrame:
    prompts = table(spark, d, "dev_tied_append").select(C("question_id").alias("idx"))
    return ops.pass_summary(prompts, _once(spark, d, ["correct"]), 4)


@query(f"""
WITH {_ONCE}, e AS (SELECT idx, count(*) FILTER (correct > 0) AS num_correct FROM c GROUP BY idx), h AS (SELECT num_correct, count(*) AS prompts FROM e GROUP BY 1)
SELECT r AS num_correct, coalesce(prompts, 0) AS prompts FROM range(0, 9) t(r) LEFT JOIN h ON r = num_correct UNION ALL SELECT num_correct::BIGINT, prompts FROM h WHERE num_correct > 8
""")
def correct_histogram(spark: SparkSession, d: str) -> DataFrame:
    return ops.correct_histogram(_once(spark, d, ["correct"]), 8)


@query(f"""
WITH {_ONCE} SELECT idx, count(*) AS n, sum(coalesce(correct, 0))::BIGINT AS num_correct, count(*) - sum(coalesce(correct, 0))::BIGINT AS num_wrong
FROM c GROUP BY idx HAVING sum(coalesce(correct, 0)) > 0 AND sum(coalesce(correct, 0)) < count(*)
""")
def heterogeneous_prompts(spark: SparkSession, d: str) -> DataFrame:
    return ops.heterogeneous_prompts(_once(spark, d, ["correct"]))


_VOTES = f"""{_ONCE}, u AS (SELECT *, coalesce(pred_executed, false) AND coalesce(length(trim(pred_sql)) > 0, false) AS use, coalesce(pred_executed, false) AND NOT coalesce(length(trim(pred_sql)) > 0, false) AS hollow FROM c),
g AS (SELECT idx, pred_sql AS sig, count(*) AS size, min(sample_id) AS first, min(length(coalesce(pred_sql, ''))) AS short FROM u WHERE use GROUP BY 1, 2),
b AS (SELECT idx, first AS winner, size AS votes FROM g QUALIFY row_number() OVER (PARTITION BY idx ORDER BY size DESC, first, short) = 1),
a AS (SELECT idx, count(*) FILTER (hollow) AS ignored, count(*) FILTER (use) AS voting FROM u GROUP BY 1),
v AS (SELECT a.idx, b.winner, coalesce(b.votes, 0) AS votes, voting, ignored FROM a LEFT JOIN b ON a.idx = b.idx)"""


def _votes(spark: SparkSession, d: str) -> DataFrame:
    return ops.majority_vote(_once(spark, d, ["pred_sql", "pred_executed"]), "pred_sql", C("pred_executed"), F.length(F.trim("pred_sql")) > 0)


@query(f"WITH {_VOTES} SELECT * FROM v")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    """A vote by statement, of candidates that ran; those without a statement count as ignored."""
    return _votes(spark, d)


@query(f"""
WITH {_VOTES}, w AS (SELECT v.*, c.correct FROM v LEFT JOIN c ON v.idx = c.idx AND v.winner = c.sample_id)
SELECT count(*) AS prompts, count(winner) AS with_vote, count(*) - count(winner) AS without_vote, sum(ignored)::BIGINT AS ignored, sum(votes)::BIGINT AS winning_votes, sum(voting)::BIGINT AS voting,
 count(*) FILTER (correct > 0) AS correct, 100.0::DOUBLE * count(*) FILTER (correct > 0) / greatest(1, count(*)) AS accuracy FROM w
""")
def vote_summary(spark: SparkSession, d: str) -> DataFrame:
    return ops.vote_summary(_votes(spark, d), _once(spark, d, ["correct"]))


@query(f"""
WITH {_ONCE}, e AS (SELECT idx, count(*) AS n, count(*) FILTER (correct > 0) AS c, count(*) FILTER (pred_executed) AS x FROM c GROUP BY idx)
SELECT count(*) AS prompts, count(*) FILTER (c = n) AS all_correct, count(*) FILTER (c = 0) AS none_correct, count(*) FILTER (c > 0 AND c < n) AS heterogeneous, avg((c > 0 AND c < n)::INT::DOUBLE) AS heterogeneous_rate,
 avg((c > 0)::INT::DOUBLE) AS any_correct_rate, sum(c)::DOUBLE / sum(n) AS candidate_accuracy, {" || ',' || ".join(f"count(*) FILTER (c = {i})" for i in range(9))} AS correct_histogram,
 {" || ',' || ".join(f"count(*) FILTER (x = {i})" for i in range(9))} AS executed_histogram, count(*) FILTER (n > 8) AS over_samples FROM e
""")
def heterogeneity_probe(spark: SparkSession, d: str) -> DataFrame:
    probe = ops.heterogeneity_probe(_once(spark, d, ["correct", "pred_executed"]), 8)
    return probe.withColumns({c: F.array_join(C(c).cast("array<string>"), ",") for c in ("correct_histogram", "executed_histogram")})


@query(f"""
WITH {_ONCE}, p AS (SELECT DISTINCT question_id AS idx FROM dev_tied_append), e AS (SELECT idx, count(*) AS n, count(*) FILTER (correct > 0) AS c, count(*) FILTER (pred_executed) AS x, sum(coalesce(tool_call_count, 0)) AS t, count(*) FILTER (stop_reason = 'finished') AS f FROM c GROUP BY idx),
m AS (SELECT coalesce(n, 0) AS n, coalesce(c, 0) AS c, coalesce(x, 0) AS x, coalesce(t, 0) AS t, coalesce(f, 0) AS f FROM p LEFT JOIN e USING (idx))
SELECT count(*) AS prompts, count(*) FILTER (n > 0) AS with_candidates, sum(n)::BIGINT AS candidates, sum(c)::BIGINT AS correct, 100.0::DOUBLE * sum(c) / greatest(1, sum(n)) AS candidate_accuracy, count(*) FILTER (c > 0) AS any_correct,
 sum(x)::BIGINT AS executed, sum(f)::BIGINT AS finished, sum(t)::DOUBLE / greatest(1, sum(n)) AS mean_tool_calls, {" || ',' || ".join(f"count(*) FILTER (n = {i})" for i in range(9))} AS candidate_histogram, count(*) FILTER (n > 8) AS over_samples FROM m
""")
def pass_report(spark: SparkSession, d: str) -> DataFrame:
    prompts = table(spark, d, "dev_tied_append").select(C("question_id").alias("idx"))
    report = ops.pass_report(prompts, _once(spark, d, ["correct", "pred_executed", "tool_call_count", "stop_reason"]), 8)
    return report.withColumn("candidate_histogram", F.array_join(C("candidate_histogram").cast("array<string>"), ","))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    rows = _once(spark, d, ["prediction_text", "pred_sql", "gold_sql", "pred_executed", "correct"])
    shown = rows.select("candidate_id", C("prediction_text").alias("completion"), "pred_sql", "gold_sql", C("pred_executed").alias("ran"), (C("correct") > 0).alias("equal"), C("pred_executed").alias("any_value"))
    return ops.rewards(shown, 100, 20)


@query()
def seven_rewards(spark: SparkSession, d: str) -> DataFrame:
    """All seven rewards of every candidate."""
    return _scored(spark, d).select("candidate_id", *ops.REWARDS, F.round(ops.weighted_reward(), 9).alias("reward"))


@query(r"""
WITH c AS (SELECT * FROM run_inference_bird QUALIFY row_number() OVER (PARTITION BY idx, sample_id ORDER BY candidate_id) = 1),
k AS (SELECT list(kw) AS ks FROM (SELECT unnest(string_split('""" + " ".join(KEYWORDS) + r"""', ' ')) AS kw)),
n AS (SELECT candidate_id, list_sort(list_distinct(list_filter(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(pred_sql, '')), '''[^'']*''', '''''', 'g'), '"[^"]*"', '""', 'g'), '`', '', 'g'), '(?:from|join)\s+([a-z_][a-z0-9_-]*)', 1), lambda v: NOT list_contains(ks, v)))) AS p,
 list_sort(list_distinct(list_filter(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(gold_sql, '')), '''[^'']*''', '''''', 'g'), '"[^"]*"', '""', 'g'), '`', '', 'g'), '(?:from|join)\s+([a-z_][a-z0-9_-]*)', 1), lambda v: NOT list_contains(ks, v)))) AS g FROM c, k),
w AS (SELECT candidate_id, CASE WHEN x = '' THEN 0 ELSE len(regexp_split_to_array(x, '[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+')) END AS n FROM (SELECT candidate_id, regexp_replace(coalesce(prediction_text, ''), '^[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+|[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+$', '', 'g') AS x FROM c))
SELECT c.candidate_id, regexp_matches(coalesce(prediction_text, ''), '(?is)<scratch_pad>\s*.+?\s*</scratch_pad>\s*<final_answer>\s*<sql_code>\s*.+?\s*</sql_code>\s*</final_answer>')::INT::DOUBLE AS format_reward,
 coalesce(pred_executed, false)::INT::DOUBLE AS execution_reward, (coalesce(pred_executed, false) AND coalesce(correct > 0, false))::INT::DOUBLE AS result_reward,
 CASE WHEN len(g) = 0 THEN 0.0::DOUBLE ELSE (p = g)::INT::DOUBLE END AS table_linking, coalesce(pred_executed, false)::INT::DOUBLE AS nonnull_reward,
 CASE WHEN w.n <= 80 THEN 0.0::DOUBLE WHEN w.n <= 100 THEN (80 - w.n) / 20.0::DOUBLE ELSE -1.0::DOUBLE END AS length_penalty FROM c JOIN n USING (candidate_id) JOIN w USING (candidate_id)
""")
def native_rewards(spark: SparkSession, d: str) -> DataFrame:
    """The six rewards that SQL can express."""
    return _scored(spark, d).select("candidate_id", *[r for r in ops.REWARDS if r != "column_linking"])


@query("""
WITH u AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sample FROM events),
g AS (SELECT user_id, event_type AS sig, count(*) AS size, min(sample) AS first FROM u WHERE value > 0 GROUP BY 1, 2)
SELECT user_id, first AS winner, size AS votes FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY size DESC, first) = 1
""")
def vote_by_result(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, d, "events").withColumn("sample", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("value > 0")
    return ops.majority_vote(e, "event_type", F.lit(True), None, "user_id", "sample", "event_type").select("user_id", "winner", "votes")


_R = "r AS (SELECT * FROM reward_rows QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY format_reward, execution_reward, result_reward) = 1)"
_WEIGHTED = " + ".join(f"coalesce(CASE WHEN {r}::VARCHAR = 'nan' THEN NULL ELSE {r} END, 0) * {w}" for r, w in zip(ops.REWARDS, ops.WEIGHTS))


@query(f"SELECT candidate_id, round({_WEIGHTED}, 9) AS reward FROM (SELECT DISTINCT * FROM reward_rows)")
def weighted_reward(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reward_rows").distinct().select("candidate_id", F.round(ops.weighted_reward(), 9).alias("reward"))


def _rewarded(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "reward_rows").groupBy("candidate_id").agg(F.max("result_reward").alias("result"), F.max("execution_reward").alias("ran"))
    return table(spark, d, "run_inference_bird").select("candidate_id", "idx").join(rows, "candidate_id")


_REWARDED = "w AS (SELECT c.candidate_id, idx, max(result_reward) AS result, max(execution_reward) AS ran FROM run_inference_bird c JOIN reward_rows r ON c.candidate_id = r.candidate_id GROUP BY 1, 2)"


@query(f"WITH {_REWARDED} SELECT candidate_id, round((result - avg(result) OVER g) / (coalesce(stddev_samp(result) OVER g, 0) + 1e-4), 6) AS advantage FROM w WINDOW g AS (PARTITION BY idx)")
def group_advantages(spark: SparkSession, d: str) -> DataFrame:
    return ops.advantages(_rewarded(spark, d), "idx", "result").select("candidate_id", F.round("advantage", 6).alias("advantage"))


@query(f"WITH {_REWARDED}, s AS (SELECT stddev_samp(result) AS s FROM w) SELECT candidate_id, round((result - avg(result) OVER (PARTITION BY idx)) / (s + 1e-4), 6) AS advantage FROM w, s")
def batch_advantages(spark: SparkSession, d: str) -> DataFrame:
    return ops.advantages(_rewarded(spark, d), "idx", "result", "batch").select("candidate_id", F.round("advantage", 6).alias("advantage"))


@query(f"""
WITH {_REWARDED}, t AS (SELECT candidate_id, 2 * (result - avg(result) OVER g) / (coalesce(stddev_samp(result) OVER g, 0) + 1e-4) + 0.5 * (ran - avg(ran) OVER g) / (coalesce(stddev_samp(ran) OVER g, 0) + 1e-4) AS t
 FROM w WINDOW g AS (PARTITION BY idx)), b AS (SELECT avg(t) AS m, stddev_samp(t) AS s FROM t)
SELECT candidate_id, round((t - m) / (s + 1e-4), 5) + 0.0 AS advantage FROM t, b
""")
def summed_z_advantages(spark: SparkSession, d: str) -> DataFrame:
    return ops.summed_z(_rewarded(spark, d), "idx", ["result", "ran"], [2.0, 0.5]).select("candidate_id", (F.round("advantage", 5) + 0.0).alias("advantage"))


@query(f"""
WITH {_REWARDED}, e AS (SELECT idx, min(result) AS lo, max(result) AS hi, stddev_pop(result) AS sd FROM w GROUP BY idx)
SELECT count(*) AS groups, count(*) FILTER (lo >= 1 - 1e-6) AS all_correct, count(*) FILTER (hi <= 1e-6) AS all_wrong, count(*) FILTER (sd >= 1e-6) AS heterogeneous FROM e
""")
def reward_buckets(spark: SparkSession, d: str) -> DataFrame:
    return ops.reward_buckets(_rewarded(spark, d), "idx", "result")


@query("""
WITH r AS (SELECT idx, unnest(['result_reward', 'nonnull_reward', 'column_linking']) AS reward,
 unnest([result_reward, CASE WHEN nonnull_reward::VARCHAR = 'nan' THEN NULL ELSE nonnull_reward END, column_linking]) AS v FROM reward_rows JOIN run_inference_bird USING (candidate_id)),
f AS (SELECT reward, idx, coalesce(max(v) - min(v), 0) < 1e-6 AS flat FROM r GROUP BY 1, 2)
SELECT a.reward, round(mean, 9) AS mean, round(deviation, 9) AS deviation, round(zero_spread, 9) AS zero_spread FROM (SELECT reward, avg(v) AS mean, stddev_samp(v) AS deviation FROM r GROUP BY 1) a
JOIN (SELECT reward, avg(flat::INT) AS zero_spread FROM f GROUP BY 1) b ON a.reward = b.reward
""")
def reward_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "reward_rows").join(table(spark, d, "run_inference_bird").select("candidate_id", "idx"), "candidate_id")
    m = ops.reward_metrics(rows, "idx", ["result_reward", "nonnull_reward", "column_linking"])
    return m.select("reward", *[F.round(c, 9).alias(c) for c in ("mean", "deviation", "zero_spread")])


@query("""
WITH e AS (SELECT user_id, coalesce(stddev_pop(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 0) >= 1e-6 AS het FROM events GROUP BY 1)
SELECT user_id, row_number() OVER (ORDER BY het DESC, user_id) AS slot, NOT het AS is_padded FROM e QUALIFY slot <= 40
""")
def oversample_filter(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.when(C("value") > 50, 1.0).otherwise(0.0).alias("reward"))
    return ops.oversample_filter(e, "user_id", "reward", 40)


@query("""
WITH e AS (SELECT user_id, coalesce(stddev_pop(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 0) >= 1e-6 AS het FROM events GROUP BY 1),
g AS (SELECT count(*) AS attempted, count(*) FILTER (het) AS heterogeneous FROM e)
SELECT attempted, heterogeneous, least(heterogeneous, 40) AS kept, least(40 - least(heterogeneous, 40), attempted - heterogeneous) AS padded,
 coalesce(heterogeneous::DOUBLE / nullif(attempted, 0), 0) AS het_rate, least(heterogeneous, 40) / 40.0::DOUBLE AS fill_rate FROM g
""")
def filter_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.when(C("value") > 50, 1.0).otherwise(0.0).alias("reward"))
    return ops.filter_metrics(e, "user_id", "reward", 40)


@query(f"""
WITH {_ONCE}, bad AS (SELECT idx FROM c GROUP BY idx HAVING count(*) FILTER (correct > 0) = 0), r AS (SELECT * FROM c WHERE idx IN (SELECT idx FROM bad)),
s AS (SELECT idx, coalesce(pred_sql, '') AS v, count(*) AS n, count(*) FILTER (pred_executed) AS ok, min(sample_id) AS first FROM r GROUP BY 1, 2),
q AS (SELECT idx, sum(n)::BIGINT AS n, count(*) AS distinct_sql, sum(ok)::BIGINT AS executed, string_agg(n || ' ' || v, '|' ORDER BY n DESC, first, v) FILTER (k <= 3) AS top_queries FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY n DESC, first, v) AS k FROM s) GROUP BY 1),
x AS (SELECT idx, 'e' AS w, split_part(coalesce(pred_error, ''), chr(10), 1) AS v FROM r UNION ALL SELECT idx, 't', CASE WHEN len(coalesce(tool_order, [])) = 0 THEN '<none>' ELSE array_to_string(tool_order, ' -> ') END FROM r UNION ALL SELECT idx, 's', coalesce(stop_reason, 'unknown') FROM r),
y AS (SELECT idx, w, v, count(*) AS n FROM x WHERE NOT (w = 'e' AND v = '') GROUP BY ALL),
z AS (SELECT idx, string_agg(n || ' ' || v, '|' ORDER BY n DESC, v) FILTER (w = 'e') AS errors, string_agg(n || ' ' || v, '|' ORDER BY n DESC, v) FILTER (w = 't') AS tools, string_agg(n || ' ' || v, '|' ORDER BY n DESC, v) FILTER (w = 's') AS stops FROM y GROUP BY 1)
SELECT q.idx, n, distinct_sql, executed, top_queries, coalesce(errors, '') AS errors, tools, stops FROM q JOIN z USING (idx)
""")
def all_wrong(spark: SparkSession, d: str) -> DataFrame:
    rows = ops.all_wrong(_once(spark, d, ["pred_sql", "pred_executed", "correct", "pred_error", "tool_order", "stop_reason"]))
    shown = {c: F.array_join(F.transform(c, lambda v: F.concat(v["n"].cast("string"), F.lit(" "), v["value"])), "|") for c in ("top_queries", "errors", "tools", "stops")}
    return rows.withColumns(shown)


@query("SELECT record_id, row_number() OVER (ORDER BY record_id) - 1 AS ordinal, ((row_number() OVER (ORDER BY record_id) - 1) % 4)::INT AS shard FROM dev_tied_append")
def round_robin_shards(spark: SparkSession, d: str) -> DataFrame:
    return ops.round_robin(table(spark, d, "dev_tied_append").select("record_id"), "record_id", 4)


@query("SELECT record_id, r::INT AS rollout FROM dev_tied_append, range(0, 4) t(r)")
def replicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return ops.replicate(table(spark, d, "dev_tied_append").select("record_id"), 4)


@query(f"""
WITH {_ONCE}, q AS (SELECT question_id, arg_min(question, record_id) AS question FROM dev_tied_append GROUP BY 1)
SELECT c.candidate_id, coalesce(q.question, '') AS question, coalesce(c.pred_sql, '') AS pred_sql FROM c LEFT JOIN q ON c.idx = q.question_id
""")
def predictions_with_questions(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "dev_tied_append").groupBy("question_id").agg(F.min_by("question", "record_id").alias("question"))
    rows = _once(spark, d, ["pred_sql"])
    met = rows.join(asked, rows.idx == asked.question_id, "left")
    return met.select("candidate_id", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("pred_sql", F.lit("")).alias("pred_sql"))


@query("SELECT greatest(sum(completion_token_count), 1)::BIGINT AS tokens, count(*) FILTER (completion_token_count >= 200 AND stop_reason <> 'finished') AS cut_off FROM run_inference_bird")
def token_normaliser(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "run_inference_bird").agg(
        F.greatest(F.sum("completion_token_count"), F.lit(1)).alias("tokens"), F.count_if((C("completion_token_count") >= 200) & (C("stop_reason") != "finished")).alias("cut_off")
    )


@query(f"""
WITH {_ONCE}, q AS (SELECT question_id, arg_min({_LEVEL_SQL}, record_id) AS difficulty FROM dev_tied_append GROUP BY 1)
SELECT candidate_id, idx, coalesce(db_id, '') AS db_id, coalesce(q.difficulty, 'unknown') AS difficulty, coalesce(correct, 0) AS correct, coalesce(status, '') AS status, coalesce(stop_reason, '') AS stop_reason,
 prompt_tokens, completion_token_count AS completion_tokens, tool_rounds, tool_call_count, CASE WHEN len(coalesce(tool_order, [])) = 0 THEN '<none>' ELSE array_to_string(tool_order, ' -> ') END AS tool_order,
 coalesce(length(trim(pred_sql)) > 0, false) AS pred_sql_extracted, coalesce(pred_executed, false) AS pred_executed, coalesce(length(trim(gold_sql)) > 0, false) AS gold_sql_extracted, coalesce(gold_executed, false) AS gold_executed,
 coalesce(pred_error, '') AS pred_error, coalesce(gold_error, '') AS gold_error, coalesce(pred_sql, '') AS pred_sql, coalesce(gold_sql, '') AS gold_sql FROM c LEFT JOIN q ON c.idx = q.question_id
""")
def candidate_report(spark: SparkSession, d: str) -> DataFrame:
    """One row a candidate with what a report shows of it: generation, execution and the question's difficulty."""
    from ..functions import sqltext as tx

    level = F.when(F.coalesce(F.trim("difficulty"), F.lit("")) == "", F.lit("unknown")).otherwise(F.lower(F.trim("difficulty")))
    asked = table(spark, d, "dev_tied_append").groupBy("question_id").agg(F.min_by(level, "record_id").alias("difficulty"))
    rows = _once(spark, d)
    met = rows.join(asked, rows.idx == asked.question_id, "left")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return met.select(
        "candidate_id", "idx", text("db_id"), F.coalesce("difficulty", F.lit("unknown")).alias("difficulty"), F.coalesce("correct", F.lit(0)).alias("correct"), text("status"), text("stop_reason"),
        "prompt_tokens", C("completion_token_count").alias("completion_tokens"), "tool_rounds", "tool_call_count", tx.tool_order("tool_order").alias("tool_order"),
        tx.has_content("pred_sql").alias("pred_sql_extracted"), F.coalesce("pred_executed", F.lit(False)).alias("pred_executed"), tx.has_content("gold_sql").alias("gold_sql_extracted"), F.coalesce("gold_executed", F.lit(False)).alias("gold_executed"),
        text("pred_error"), text("gold_error"), text("pred_sql"), text("gold_sql"),
    )
