"""Queries of profiling, search, comparison, the query service and the dataset pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, dataset, profile, search
from ..sources.catalog import table
from .catalogue import query
from .service import QueryService

C = F.col

_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _unpivot(columns: list[str], name: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c}::VARCHAR AS value FROM {name}" for c in columns)


@query(f"""
WITH u AS ({_unpivot(["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], "part")}), d AS (SELECT *, TRY_CAST(value AS DOUBLE) AS x FROM u)
SELECT column_name, count(*) AS row_count, count(value) AS non_null, count(*) - count(value) AS null_count, count(DISTINCT value) AS distinct_count, CASE WHEN column_name IN ('p_partkey', 'p_size', 'p_retailprice') THEN 'NUMERIC' ELSE 'TEXT' END AS kind,
 min(x) AS num_min, max(x) AS num_max, round(avg(x), 6) AS num_mean, median(x) AS num_median, min(length(value))::INT AS len_min, max(length(value))::INT AS len_max, round(avg(length(value)), 6) AS len_mean FROM d GROUP BY 1
""")
def profile_columns(spark: SparkSession, d: str) -> DataFrame:
    p = profile.column_profile(table(spark, d, "part"), ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"])
    return p.select(
        "column_name", "row_count", "non_null", "null_count", "distinct_count", "kind", "num_min", "num_max", F.round("num_mean", 6).alias("num_mean"), "num_median", "len_min", "len_max", F.round("len_mean", 6).alias("len_mean")
    )


@query(f"""
WITH u AS ({_unpivot(["c_nationkey", "c_mktsegment"], "customer")}), n AS (SELECT column_name, value, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS place FROM n QUALIFY place <= 5
""")
def top_values(spark: SparkSession, d: str) -> DataFrame:
    return profile.top_values(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


@query(rf"""
WITH u AS ({_unpivot(["db_id", "title", "registered_at"], "db_catalog")}), s AS (SELECT column_name, value FROM u WHERE value IS NOT NULL)
SELECT column_name, avg(regexp_matches(value, '\p{{Lu}}')::INT) AS has_upper, avg(regexp_matches(value, '\p{{Ll}}')::INT) AS has_lower, avg(regexp_matches(value, '\d')::INT) AS has_digit, avg(regexp_matches(value, '\s')::INT) AS has_space,
 avg(regexp_matches(value, '^\d+$')::INT) AS all_digits, avg(regexp_matches(trim(value), '^(\d{{4}}-\d{{2}}-\d{{2}}|\d{{4}}/\d{{2}}/\d{{2}}|\d{{2}}/\d{{2}}/\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}} \d{{2}}:\d{{2}}:\d{{2}})$')::INT) AS looks_date_like FROM s GROUP BY 1
""")
def character_classes(spark: SparkSession, d: str) -> DataFrame:
    return profile.character_classes(table(spark, d, "db_catalog"), ["db_id", "title", "registered_at"]).drop("has_punct", "looks_json_like")


@query(f"""
WITH u AS ({_unpivot(["db_id", "topic_area"], "db_catalog")}), l AS (SELECT column_name, k AS length, substr(value, 1, k) AS prefix FROM u, (VALUES (2), (3), (4)) v(k) WHERE length(value) >= k),
n AS (SELECT column_name, length, prefix, count(*) AS n FROM l GROUP BY ALL) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY column_name, length ORDER BY n DESC, prefix) <= 5
""")
def value_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return profile.prefixes(table(spark, d, "db_catalog"), ["db_id", "topic_area"])


def _asked():
    return F.concat_ws(" ", "question", "evidence")


_BM25 = r"""
docs AS (SELECT record_id AS doc, db_id, regexp_extract_all(lower(concat_ws(' ', question, evidence)), '[\p{L}\p{M}\p{N}_]+') AS w FROM dev_tied_append),
size AS (SELECT count(*) AS n, avg(len(w)) AS mean_dl FROM docs), ix AS (SELECT doc, len(w) AS dl, unnest(w) AS word FROM docs), tf AS (SELECT doc, dl, word, count(*) AS tf FROM ix GROUP BY ALL),
raw AS (SELECT word, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, size GROUP BY word, n), m AS (SELECT avg(raw) AS mean_idf FROM raw),
idf AS (SELECT word, CASE WHEN raw < 0 THEN 0.25 * mean_idf ELSE raw END AS idf FROM raw, m),
q AS (SELECT doc AS query, db_id AS qdb, unnest(w) AS word FROM docs WHERE doc % 100 = 0), qf AS (SELECT query, qdb, word, count(*) AS qf FROM q GROUP BY ALL),
sc AS (SELECT query, any_value(qdb) AS qdb, doc, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean_dl))) AS score FROM tf JOIN qf USING (word) JOIN idf USING (word), size GROUP BY query, doc)
"""


@query(f"WITH {_BM25} SELECT query, doc, round(score, 4) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 4) DESC, doc) AS place FROM sc QUALIFY place <= 5")
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    """The five records most like each record whose record_id is divisible by 100, by question and evidence, of all records."""
    docs = table(spark, d, "dev_tied_append").select("record_id", _asked().alias("text"))
    asked = docs.where("record_id % 100 = 0")
    if search.repeats(docs, "record_id"):
        return search.ranked(search.bm25(docs, "record_id", C("text"), asked, "record_id", C("text")), docs, "record_id", asked, "record_id", 5)
    return search.best(docs, "record_id", C("text"), asked, "record_id", C("text"), 5, fill=False)


@query(f"""
WITH {_BM25}, qs AS (SELECT doc AS query, db_id AS qdb FROM docs WHERE doc % 100 = 0),
x AS (SELECT qs.query, docs.doc, coalesce(round(sc.score, 4), 0) AS score FROM qs JOIN docs ON docs.db_id IS DISTINCT FROM qs.qdb LEFT JOIN sc ON sc.query = qs.query AND sc.doc = docs.doc)
SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS place FROM x QUALIFY place <= 3
""")
def bm25_fewshot(spark: SparkSession, d: str) -> DataFrame:
    """The same, of other databases only."""
    docs = table(spark, d, "dev_tied_append").select("record_id", _asked().alias("text"), "db_id")
    return search.few_shots(docs, "record_id", C("text"), docs.where("record_id % 100 = 0"), "record_id", C("text"), 3, "db_id")


@query(r"""
WITH v AS (SELECT DISTINCT substr(trim(title), 1, 200) AS value FROM db_catalog WHERE length(trim(title)) >= 1),
s AS (SELECT value, 2.0 * (contains(lower(value), 'harbor')::INT + contains(lower(value), 'audit')::INT) + 3.0 * (regexp_matches(value, '(?i)\bharbor\b')::INT + regexp_matches(value, '(?i)\baudit\b')::INT)
 + 1.5 * (starts_with(lower(value), 'harbor')::INT + starts_with(lower(value), 'audit')::INT) AS score FROM v)
SELECT value, score FROM s WHERE score > 0 ORDER BY score DESC, length(value), value LIMIT 10
""")
def regex_rank(spark: SparkSession, d: str) -> DataFrame:
    return search.substring_ranked(search.column_values(table(spark, d, "db_catalog"), "title"), ["harbor", "audit"], 10)


@query()
def value_search(spark: SparkSession, d: str) -> DataFrame:
    return search.value_search(table(spark, d, "db_catalog"), "title", "harbor audit", 5)


@query("""
WITH a AS (SELECT l_orderkey AS k, l_quantity AS q, l_discount AS x FROM lineitem), b AS (SELECT l_orderkey, l_quantity, CASE WHEN l_linenumber = 1 THEN l_discount + 1e-9 ELSE l_discount END FROM lineitem),
m AS (SELECT * FROM a EXCEPT SELECT * FROM b), n AS (SELECT * FROM b EXCEPT SELECT * FROM a)
SELECT (SELECT count(*) FROM m) = 0 AND (SELECT count(*) FROM n) = 0 AS equal, (SELECT count(*) FROM m) AS only_a, (SELECT count(*) FROM n) AS only_b
""")
def ex_match_doubles(spark: SparkSession, d: str) -> DataFrame:
    """Doubles compare unrounded, whole ones with whole numbers of another type."""
    li = table(spark, d, "lineitem")
    a = li.select("l_orderkey", "l_quantity", "l_discount")
    b = li.select(C("l_orderkey").cast("decimal(20,0)"), "l_quantity", F.when(C("l_linenumber") == 1, C("l_discount").cast("double") + 1e-9).otherwise(C("l_discount").cast("double")))
    return compare.differences(a, b)


@query("""
SELECT pair, equal FROM (VALUES ('whole and real', true), ('number and text', false), ('neighbours beyond 2 ** 53', false), ('tiny and zero', false), ('true and one', true), ('null and null', true), ('null and zero', false), ('text and its capitals', false)) v(pair, equal)
""")
def ex_match_types(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of single cells of different types, each compared as a result of one row."""
    pairs = {
        "whole and real": ("1", "1.0D"), "number and text": ("1", "'1.0'"), "neighbours beyond 2 ** 53": ("9007199254740993", "9007199254740992"), "tiny and zero": ("1e-7D", "0"), "true and one": ("true", "1"),
        "null and null": ("NULL", "CAST(NULL AS INT)"), "null and zero": ("NULL", "0"), "text and its capitals": ("'a'", "'A'"),
    }
    done = [compare.differences(spark.sql(f"SELECT {a} AS x"), spark.sql(f"SELECT {b} AS y")).select(F.lit(k).alias("pair"), "equal") for k, (a, b) in pairs.items()]
    out = done[0]
    for r in done[1:]:
        out = out.unionByName(r)
    return out


def _totals(spark: SparkSession, d: str, shift: float) -> DataFrame:
    o = table(spark, d, "orders").where(f"o_totalprice > {shift}")
    return o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
WITH a AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 0 GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 1500 GROUP BY 1),
x AS (SELECT * FROM a EXCEPT SELECT * FROM b), y AS (SELECT * FROM b EXCEPT SELECT * FROM a)
SELECT (SELECT count(*) FROM x) = 0 AND (SELECT count(*) FROM y) = 0 AS equal, (SELECT count(*) FROM x) AS only_a, (SELECT count(*) FROM y) AS only_b
""")
def ex_match_pairs(spark: SparkSession, d: str) -> DataFrame:
    return compare.differences(_totals(spark, d, 0), _totals(spark, d, 1500))


@query("""
WITH a AS (SELECT lower(trim(db_id)) AS k, count(*) AS n FROM dev_tied_append GROUP BY 1), b AS (SELECT lower(trim(db_id)) AS k, count(*) AS n FROM run_inference_bird GROUP BY 1),
f AS (SELECT coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k)
SELECT sum(greatest(0, na - nb)) = 0 AND sum(greatest(0, nb - na)) = 0 AS equal, sum(greatest(0, na - nb))::BIGINT AS only_a, sum(greatest(0, nb - na))::BIGINT AS only_b FROM f
""")
def normalised_match(spark: SparkSession, d: str) -> DataFrame:
    return compare.differences(table(spark, d, "dev_tied_append").select("db_id"), table(spark, d, "run_inference_bird").select("db_id"), multiset=True, normalise=True)


@query("SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
def guarded_query(spark: SparkSession, d: str) -> DataFrame:
    """A model's statement with bracketed and quoted names and a trailing mark, as the service repairs and runs it."""
    return QueryService(spark, d, ["nation"]).frame('SELECT [n_name], "n_regionkey" FROM nation WHERE n_regionkey = 2 ?')


@query("""
SELECT (SELECT min(i) FROM (VALUES (0, (SELECT count(*) FROM nation)), (1, (SELECT count(n_name) FROM nation)), (2, (SELECT max(n_nationkey) FROM nation))) v(i, x) WHERE x = (SELECT count(*) FROM nation)) AS winner,
 2 AS votes, '0,0,1,-1' AS membership, (SELECT count(*) FROM nation) AS n
""")
def consensus(spark: SparkSession, d: str) -> DataFrame:
    s = QueryService(spark, d, ["nation"])
    r = s.consensus(["SELECT count(*) AS n FROM nation", "SELECT count(n_name) AS n FROM nation", "SELECT max(n_nationkey) AS m FROM nation", "DROP TABLE nation"])
    return spark.createDataFrame([(r["winner"], r["votes"], ",".join(map(str, r["membership"])), r["result"]["rows"][0][0])], "winner int, votes int, membership string, n long")


#: Statements in the dialect, and what a database without it needs to be asked for the same number.
DIALECT = {
    "SELECT SUM(n_regionkey > 2) FROM nation": "SELECT count(*) FILTER (n_regionkey > 2) FROM nation",
    "SELECT SUM(n_nationkey) / COUNT(*) FROM nation": "SELECT sum(n_nationkey) // count(*) FROM nation",
    "SELECT CAST(SUM(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS REAL) * 100 / COUNT(c_custkey) FROM customer": "SELECT count(*) FILTER (c_acctbal > 0) * 100.0::DOUBLE / count(*) FROM customer",
    "SELECT 1 / 0": "SELECT NULL::DOUBLE",
    "SELECT LENGTH(SUBSTR(n_name, 0, 3)) FROM nation ORDER BY n_nationkey LIMIT 2, 1": "SELECT 2",
    "SELECT COUNT(*) FROM nation WHERE n_name LIKE 'a%' OR n_name > 5": "SELECT count(*) FROM nation WHERE n_name ILIKE 'a%' OR n_name > '5'",
    "SELECT COUNT(*) FROM orders WHERE strftime('%Y', o_orderdate) = '1995' AND strftime('%m', o_orderdate) IN ('01', '02')": "SELECT count(*) FROM orders WHERE year(o_orderdate) = 1995 AND month(o_orderdate) IN (1, 2)",
    "SELECT MAX(strftime('%Y', o_orderdate) - 1900) FROM orders": "SELECT max(year(o_orderdate)) - 1900 FROM orders",
    "SELECT IIF(COUNT(*) / 2 > 10, COUNT(*) / 2, -1) FROM nation": "SELECT CASE WHEN count(*) // 2 > 10 THEN count(*) // 2 ELSE -1 END FROM nation",
    "SELECT CAST('12abc' AS INTEGER) + CAST('abc' AS REAL)": "SELECT 12",
    "SELECT ROUND(julianday(MAX(o_orderdate)) - julianday(MIN(o_orderdate)), 3) FROM orders": "SELECT round(julian(max(o_orderdate)) - julian(min(o_orderdate)), 3) FROM orders",
    "SELECT s_suppkey, MAX(s_acctbal) FROM supplier": "SELECT arg_max(s_suppkey, s_acctbal) FROM supplier",
}


@query(" UNION ALL ".join(f"SELECT {i} AS no, CAST(({sql}) AS DOUBLE) AS value" for i, sql in enumerate(DIALECT.values())))
def dialect(spark: SparkSession, d: str) -> DataFrame:
    """The first cell of statements in the dialect, run by the service."""
    s = QueryService(spark, d, ["nation", "customer", "orders", "supplier"])
    rows = [(i, s.query(sql)["rows"][0][0]) for i, sql in enumerate(DIALECT)]
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in rows], "no int, value double")


@query("""
SELECT record_id, coalesce(nullif(db_id, ''), 'unknown') AS db_id, coalesce(nullif(sql_text, ''), '') AS gold_sql, coalesce(nullif(evidence, ''), '') AS evidence, coalesce(nullif(question, ''), '') AS question FROM dev_tied_append
""")
def normalised_records(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "dev_tied_append").withColumnRenamed("sql_text", "SQL")
    n = dataset.normalised(r)
    return n.select("record_id", F.coalesce(F.nullif("db_id", F.lit("")), F.lit("unknown")).alias("db_id"), "gold_sql", "evidence", "question")


@query("SELECT record_id, (db_id IS NULL OR db_id = '') AS no_db, (sql_text IS NULL OR sql_text = '') AS no_sql FROM dev_tied_append WHERE coalesce(db_id, '') = '' OR coalesce(sql_text, '') = ''")
def incomplete_records(spark: SparkSession, d: str) -> DataFrame:
    r = dataset.normalised(table(spark, d, "dev_tied_append").withColumnRenamed("sql_text", "SQL"))
    return dataset.incomplete(r, ["db_id", "gold_sql"]).select("record_id", (C("db_id") == "").alias("no_db"), (C("gold_sql") == "").alias("no_sql"))


@query(r"""
SELECT record_id, chr(10) || '<question>' || chr(10) || coalesce(question, '') || chr(10) || '</question>' || chr(10) || chr(10) || '<hint>' || chr(10) || coalesce(evidence, '') || chr(10) || '</hint>' || chr(10) || chr(10)
 || '<db_id>' || coalesce(db_id, '') || '</db_id>' || chr(10) || chr(10) || '---' || chr(10) || 'Question: ' || coalesce(question, '') || chr(10) || 'Evidence: ' || coalesce(evidence, '') || chr(10) AS prompt FROM dev_tied_append
""")
def training_prompts(spark: SparkSession, d: str) -> DataFrame:
    r = dataset.normalised(table(spark, d, "dev_tied_append").withColumnRenamed("sql_text", "SQL"))
    return r.select("record_id", dataset.user_prompt(C("question"), C("evidence"), C("db_id")).alias("prompt"))


@query("SELECT record_id FROM dev_tied_append ORDER BY md5('7:' || record_id), record_id LIMIT 50")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return dataset.sample_rows(table(spark, d, "dev_tied_append").select("record_id"), "record_id", 50, 7)
