"""Queries of the SQL-text and completion-text functions over the generated candidates and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sqltext as tx
from ..sources.catalog import table
from .catalogue import query
from .lineage import cut

C = F.col


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "run_inference_bird")


_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '^[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}`]+|[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}`]+$', '', 'g'), '(?i)^\s*SQL\s*:\s*', ''),
 '(?i)</?(?:scratch_pad|final_answer|sql_code)>', '', 'g'), '(?is)(?:\nExplanation:|\nThe query|\nThis query).*$', ''), '^[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+|[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000};]+$', '', 'g')"""
_HAS = r"regexp_matches({x}, '(?i)\b(?:SELECT|WITH)\b')"


@query(
    r"""
WITH t AS (SELECT candidate_id, regexp_replace(coalesce(prediction_text, ''), '^[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+|[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+$', '', 'g') AS x FROM run_inference_bird),
f AS (SELECT *, regexp_extract(x, '(?is)<final_answer>\s*(.*?)\s*</final_answer>', 1) AS fin, regexp_extract(x, '(?is)```\s*(.*?)```', 1) AS fen FROM t),
p AS (SELECT candidate_id, CASE WHEN regexp_matches(x, '(?is)<sql_code>.*?</sql_code>') THEN regexp_extract(x, '(?is)<sql_code>\s*(.*?)\s*</sql_code>', 1)
 WHEN """
    + _HAS.format(x="fin")
    + r""" THEN regexp_extract(fin, '(?is)\b((?:SELECT|WITH)\b.*)$', 1) WHEN regexp_matches(x, '(?is)```sql\s*.*?```') THEN regexp_extract(x, '(?is)```sql\s*(.*?)```', 1)
 WHEN """
    + _HAS.format(x="fen")
    + " THEN fen WHEN "
    + _HAS.format(x="x")
    + r""" THEN regexp_extract(x, '(?is)\b((?:SELECT|WITH)\b.*)$', 1) ELSE x END AS y FROM f),
c AS (SELECT candidate_id, """
    + _CLEAN.replace("{x}", "y")
    + """ AS z FROM p)
SELECT candidate_id, CASE WHEN z = '' THEN '' ELSE z || ';' END AS sql FROM c
"""
)
def sql_extract(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("candidate_id", tx.extracted("prediction_text").alias("sql"))


@query(r"""
SELECT candidate_id, regexp_matches(coalesce(pred_sql, ''), '(?i)\b(?:SELECT|WITH)\b') AND NOT regexp_matches(coalesce(pred_sql, ''), '(?i)\b(?:DROP|ALTER|TRUNCATE|ATTACH|DETACH|PRAGMA|VACUUM|REINDEX|CREATE|INSERT|UPDATE|DELETE)\b') AS strict,
 regexp_matches(coalesce(pred_sql, ''), '(?i)^\s*(?:select|with)\b') AND NOT regexp_matches(coalesce(pred_sql, ''), '(?i) (?:pragma|attach|detach|insert|update|delete|drop|create|alter) ') AS tool FROM run_inference_bird
""")
def sql_guard(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("candidate_id", tx.is_read_only("pred_sql").alias("strict"), tx.starts_read_only("pred_sql").alias("tool"))


@query(
    r"""
WITH p AS (SELECT candidate_id, regexp_replace(regexp_replace(regexp_replace(lower(coalesce(pred_sql, '')), '''[^'']*''', '''''', 'g'), '"[^"]*"', '""', 'g'), '`', '', 'g') AS x FROM run_inference_bird),
k AS (SELECT unnest(string_split('"""
    + " ".join(tx.KEYWORDS)
    + r"""', ' ')) AS kw), e AS (SELECT DISTINCT candidate_id, unnest(regexp_extract_all(x, '(?:from|join)\s+([a-z_][a-z0-9_-]*)', 1)) AS t FROM p)
SELECT candidate_id, t AS table_name FROM e WHERE t NOT IN (SELECT kw FROM k)
"""
)
def sql_tables(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("candidate_id", F.explode(tx.table_names("pred_sql")).alias("table_name"))


@query()
def sql_columns(spark: SparkSession, d: str) -> DataFrame:
    """Distinct statements are read once: the Python function sees each text of the table a single time."""
    texts = _candidates(spark, d).select("pred_sql").distinct()
    return texts.select("pred_sql", tx.column_names("pred_sql").alias("names")).select(F.explode("names").alias("column_name")).groupBy("column_name").agg(F.count("*").alias("statements"))


@query(r"""
SELECT candidate_id, len(regexp_extract_all(lower(coalesce(pred_sql, '')), '\bjoin\b'))::INT AS joins, regexp_matches(coalesce(pred_sql, ''), '(?i)\bselect\s+distinct\b') AS distinct_,
 nullif(regexp_extract(lower(coalesce(pred_sql, '')), '\blimit\s+(\d+)\b', 1), '') AS limit_, array_to_string(list_sort(regexp_extract_all(lower(coalesce(pred_sql, '')), '\b(count|sum|avg|min|max)\s*\(', 1)), ',') AS aggs,
 array_to_string(list_sort(regexp_extract_all(lower(coalesce(pred_sql, '')), '\b(union|intersect|except)\b', 1)), ',') AS sets,
 regexp_matches(coalesce(pred_sql, ''), '(?i)\bis\s+null\b|\bis\s+not\s+null\b|\bcoalesce\s*\(|\bifnull\s*\(') AS nulls,
 array_to_string(list_sort(list_transform(regexp_extract_all(coalesce(pred_sql, ''), '(''(?:''''|[^''])*''|\b\d+(?:\.\d+)?\b)', 1), lambda v: lower(trim(v)))), ',') AS literals FROM run_inference_bird
""")
def sql_signature(spark: SparkSession, d: str) -> DataFrame:
    s = "pred_sql"
    return _candidates(spark, d).select(
        "candidate_id", tx.join_count(s).alias("joins"), tx.is_distinct(s).alias("distinct_"), tx.limit_of(s).alias("limit_"), F.array_join(tx.aggregates(s), ",").alias("aggs"),
        F.array_join(tx.set_operations(s), ",").alias("sets"), tx.handles_null(s).alias("nulls"), F.array_join(tx.literals(s), ",").alias("literals"),
    )


@query(r"""
WITH g AS (SELECT candidate_id, regexp_extract(lower(gold_sql), '(?s)order\s+by\s+(.*?)(?:\blimit\b|\bunion\b|\bexcept\b|\bintersect\b|$)', 1) AS o FROM run_inference_bird WHERE gold_sql IS NOT NULL),
i AS (SELECT candidate_id, unnest(string_split(o, ',')) AS v FROM g)
SELECT candidate_id, list_last(string_split(replace(regexp_replace(regexp_replace(v, '\basc\b|\bdesc\b', '', 'g'), '^[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+|[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+$', '', 'g'), '`', ''), '.')) AS item FROM i
WHERE list_last(string_split(replace(regexp_replace(regexp_replace(v, '\basc\b|\bdesc\b', '', 'g'), '^[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+|[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+$', '', 'g'), '`', ''), '.')) <> ''
""")
def sql_order_items(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).where("gold_sql is not null").select("candidate_id", F.explode(tx.clause_items("gold_sql", "order by")).alias("item"))


def _patterned(spark: SparkSession, d: str) -> DataFrame:
    """Wrong candidates, each delivery once, with their patterns; every different statement is read a single time."""
    from ..operators.candidates import first_delivery

    columns = ["candidate_id", "idx", "sample_id", "pred_sql", "gold_sql", "pred_executed", "gold_executed", "correct"]
    rows = first_delivery(_candidates(spark, d).select(*columns), ["idx", "sample_id"], "candidate_id").where("coalesce(correct, 0) = 0")
    rows = rows.withColumns({"p": F.coalesce("pred_sql", F.lit("")), "g": F.coalesce("gold_sql", F.lit(""))})
    texts = rows.select(C("p").alias("t")).union(rows.select("g")).distinct()
    read = cut(texts.select("t", tx.statement_features("t").alias("f")), "statements")
    met = rows.join(read.withColumnsRenamed({"t": "p", "f": "pf"}), "p").join(read.withColumnsRenamed({"t": "g", "f": "gf"}), "g")
    return met.withColumn("patterns", tx.error_patterns(C("pf"), C("gf"), tx.has_content("pred_sql"), C("pred_executed"), C("gold_executed"), C("correct") > 0)).drop("pf", "gf", "p", "g")


@query()
def error_patterns(spark: SparkSession, d: str) -> DataFrame:
    return _patterned(spark, d).select("candidate_id", F.array_join("patterns", ",").alias("patterns"))


@query()
def pattern_summary(spark: SparkSession, d: str) -> DataFrame:
    """(pattern, wrong, prompts, wrong_pct, prompts_pct, examples) over the wrong candidates of heterogeneous prompts, most frequent first; examples are
    the three least candidate_ids."""
    from ..operators.candidates import first_delivery, heterogeneous_prompts

    once = first_delivery(_candidates(spark, d).select("candidate_id", "idx", "sample_id", "correct"), ["idx", "sample_id"], "candidate_id")
    wrong = _patterned(spark, d).join(heterogeneous_prompts(once).select("idx"), "idx", "left_semi").select("candidate_id", "idx", "patterns")
    wrong = cut(wrong, "wrong")
    total = wrong.agg(F.greatest(F.lit(1), F.count("*")).alias("w"), F.greatest(F.lit(1), F.countDistinct("idx")).alias("p"))
    long = wrong.select("candidate_id", "idx", F.explode("patterns").alias("pattern"))
    each = long.groupBy("pattern", "idx").agg(F.count("*").alias("n")).groupBy("pattern").agg(F.sum("n").alias("wrong"), F.count("*").alias("prompts"))
    first = long.withColumn("r", F.row_number().over(Window.partitionBy("pattern").orderBy("candidate_id"))).where("r <= 3")
    examples = first.groupBy("pattern").agg(F.array_join(F.array_sort(F.collect_list("candidate_id")).cast("array<string>"), ",").alias("examples"))
    shown = each.join(examples, "pattern").crossJoin(F.broadcast(total))
    return shown.select("pattern", "wrong", "prompts", (100.0 * C("wrong") / C("w")).alias("wrong_pct"), (100.0 * C("prompts") / C("p")).alias("prompts_pct"), "examples").orderBy(F.desc("wrong"), F.desc("prompts"), F.desc("pattern")).limit(20)


@query()
def failure_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the prompts of which every candidate is wrong, from execution, stop reasons, first errors and diversity."""
    from ..operators.candidates import first_delivery
    from ..operators.failures import failure_labels as labels

    once = first_delivery(_candidates(spark, d), ["idx", "sample_id"], "candidate_id")
    return labels(once).select("idx", F.array_join("labels", ",").alias("labels"))


@query(r"""
SELECT candidate_id, regexp_matches(coalesce(prediction_text, ''), '(?is)<scratch_pad>\s*.+?\s*</scratch_pad>\s*<final_answer>\s*<sql_code>\s*.+?\s*</sql_code>\s*</final_answer>') AS ok FROM run_inference_bird
""")
def format_check(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("candidate_id", tx.follows_format("prediction_text").alias("ok"))


@query(r"""
WITH w AS (SELECT candidate_id, CASE WHEN x = '' THEN 0 ELSE len(regexp_split_to_array(x, '[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+')) END AS n FROM (SELECT candidate_id, regexp_replace(coalesce(pred_sql, ''), '^[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+|[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+$', '', 'g') AS x FROM run_inference_bird))
SELECT candidate_id, CASE WHEN n <= 20 THEN 0.0 WHEN n <= 40 THEN (20 - n) / 20.0::DOUBLE ELSE -1.0 END AS penalty FROM w
""")
def length_penalty(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("candidate_id", tx.length_penalty(tx.word_count("pred_sql"), 40, 20).alias("penalty"))


@query(r"""
WITH t AS (SELECT candidate_id, list_distinct(regexp_extract_all(lower(coalesce(pred_sql, '')), '[a-z_]\w*')) AS a, list_distinct(regexp_extract_all(lower(coalesce(gold_sql, '')), '[a-z_]\w*')) AS b FROM run_inference_bird)
SELECT candidate_id, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END AS similarity FROM t
""")
def jaccard_words(spark: SparkSession, d: str) -> DataFrame:
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(C(c), F.lit(""))), F.lit(r"[a-z_]\w*"), F.lit(0)))
    return _candidates(spark, d).select("candidate_id", tx.jaccard(words("pred_sql"), words("gold_sql")).alias("similarity"))


@query(r"""
SELECT doc_id, CASE WHEN length(x) <= 160 THEN x ELSE substr(x, 1, 157) || '...' END AS preview FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+', ' ', 'g')) AS x FROM documents)
""")
def text_preview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.preview("text").alias("preview"))


@query("SELECT candidate_id, CASE WHEN len(coalesce(tool_order, [])) = 0 THEN '<none>' ELSE array_to_string(tool_order, ' -> ') END AS tools FROM run_inference_bird")
def tool_order(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("candidate_id", tx.tool_order("tool_order").alias("tools"))


@query(r"""
WITH c AS (SELECT candidate_id, unnest(regexp_extract_all(coalesce(prediction_text, ''), '(?s)call:([A-Za-z_]\w*)\s*\{.*?\}', 1)) AS name, generate_subscripts(regexp_extract_all(coalesce(prediction_text, ''), '(?s)call:([A-Za-z_]\w*)\s*\{.*?\}', 1), 1) AS i FROM run_inference_bird)
SELECT candidate_id, 'call_' || (i - 1) AS call_id, name FROM c
""")
def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    calls = F.explode(tx.tool_calls("prediction_text")).alias("x")
    return _candidates(spark, d).select("candidate_id", calls).select("candidate_id", C("x.id").alias("call_id"), "x.name")


@query()
def tool_arguments(spark: SparkSession, d: str) -> DataFrame:
    """(candidate_id, name, key, value) of every argument of every tool call, parsed with quotes, brackets and commas inside SQL respected."""
    from ..functions.arguments import parsed

    calls = _candidates(spark, d).select("candidate_id", F.explode(tx.tool_calls("prediction_text")).alias("x"))
    return calls.select("candidate_id", "x.name", F.explode(parsed("x.arguments"))).select("candidate_id", "name", "key", "value")


@query("SELECT candidate_id, coalesce(pred_sql, '') || chr(9) || '----- bird -----' || chr(9) || coalesce(db_id, '') AS packed FROM run_inference_bird")
def packed_predictions(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("candidate_id", tx.packed("pred_sql", "db_id").alias("packed"))


@query("SELECT candidate_id, coalesce(pred_sql, '') AS sql, coalesce(db_id, '') AS db_id FROM run_inference_bird")
def unpacked_predictions(spark: SparkSession, d: str) -> DataFrame:
    both = _candidates(spark, d).select("candidate_id", tx.unpacked(tx.packed("pred_sql", "db_id")).alias("u"))
    return both.select("candidate_id", "u.sql", "u.db_id")


@query(r"""
WITH r AS (SELECT candidate_id, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(pred_sql, '\"', ''''), '\%', chr(1)), '\_', chr(2)), '\''', chr(3)), '\', ''), '"([A-Za-z][A-Za-z0-9_ \-]*)"', '`\1`', 'g'), '\[([A-Za-z][A-Za-z0-9_ \-]*)\]', '`\1`', 'g') AS x FROM run_inference_bird)
SELECT candidate_id, regexp_replace(regexp_replace(rtrim(replace(replace(replace(x, chr(1), '\%'), chr(2), '\_'), chr(3), '\''')), '[?!]+\s*$', ''), '''''([^'']+)''''', '''\1''', 'g') AS sql FROM r
""")
def sanitised_sql(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("candidate_id", tx.sanitised("pred_sql").alias("sql"))


@query(r"""
WITH m AS (SELECT record_id, '# ' || trim(coalesce(question, '')) AS u FROM dev_tied_append)
SELECT record_id, 'SYSTEM: Answer with one query.' || chr(10) || chr(10) || 'USER: ' || u || chr(10) || chr(10) || 'ASSISTANT:' AS prompt FROM m
""")
def messages_to_prompt(spark: SparkSession, d: str) -> DataFrame:
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    messages = F.array(message("system", F.lit("Answer with one query.")), message("user", F.concat(F.lit("# "), F.trim(F.coalesce(C("question"), F.lit(""))))), message("assistant", C("sql_text")))
    return table(spark, d, "dev_tied_append").select("record_id", tx.render_prompt(tx.without_role(messages)).alias("prompt"))


@query(r"""
SELECT CASE WHEN n <= 100 THEN 'kept' ELSE 'skipped' END AS part, count(*) AS n_docs, sum(n)::BIGINT AS words FROM
 (SELECT CASE WHEN x = '' THEN 0 ELSE len(regexp_split_to_array(x, '[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+')) END AS n FROM (SELECT regexp_replace(coalesce(text, ''), '^[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+|[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+$', '', 'g') AS x FROM documents)) GROUP BY 1
""")
def length_filter(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").select(tx.word_count("text").alias("n"))
    return n.groupBy(F.when(C("n") <= 100, "kept").otherwise("skipped").alias("part")).agg(F.count("*").alias("n_docs"), F.sum("n").alias("words"))


@query(r"""
SELECT map_key, coalesce(split_part(map_key, '|', 1), '') AS db_id, coalesce(split_part(map_key, '|', 2), '') AS table_name, coalesce(split_part(map_key, '|', 3), '') AS column_name,
 trim(regexp_replace(coalesce(meaning, ''), '^[\s#''"]+|[\s''"]+$', '', 'g')) AS comment FROM column_meanings
""")
def column_comments(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.records import column_comments as read

    return read(table(spark, d, "column_meanings"))
