"""Literal vectors of the text functions."""

import pytest
from pyspark.sql import functions as F

from assay.functions import arguments, compat
from assay.functions import sqltext as tx


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'int'}" for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, sql",
    [
        ("```sql\nSELECT * FROM movies\n```", "SELECT * FROM movies;"),
        ("<final_answer><sql_code>SELECT name FROM t WHERE id = 1</sql_code></final_answer>", "SELECT name FROM t WHERE id = 1;"),
        ("<final_answer>so: SELECT 1</final_answer>", "SELECT 1;"),
        ("```\nwith a as (select 1) select * from a\n```", "with a as (select 1) select * from a;"),
        ("I think SELECT a FROM b;;\nExplanation: because", "SELECT a FROM b;"),
        ("SQL: nothing here", "nothing here;"),
        ("", ""), (None, ""), ("  \n", ""),
    ],
)
def test_extract(spark, text, sql):
    assert one(spark, tx.extracted("t"), t=text) == sql


def test_guards(spark):
    assert not one(spark, tx.is_read_only("t"), t="DROP TABLE movies;")
    assert one(spark, tx.is_read_only("t"), t="select dropped from t")
    assert not one(spark, tx.is_read_only("t"), t=None)
    assert not one(spark, tx.starts_read_only("t"), t="explain select 1")


def test_names(spark):
    sql = "SELECT T1.a, b FROM `One` AS T1 JOIN two ON T1.id = two.id WHERE c = 'from x' GROUP BY d"
    assert one(spark, tx.table_names("t"), t=sql) == ["one", "two"]
    assert one(spark, tx.clause_items("t", "order by"), t="select a from t order by t.a desc, `b` limit 3") == ["a", "b"]
    assert one(spark, tx.clause_items("t", "group by"), t="select a from t") == []
    assert one(spark, F.array_join(tx.prompt_tables("t"), ","), t="CREATE TABLE `abc` (\n id INT,\n name TEXT)\nTable: def\nx.y\ncreate  table \"q r\"") == "abc,def,q,x"
    assert one(spark, F.array_join(tx.prompt_columns("t"), ","), t='\n id INT,\n `name` TEXT\nx.y {"name": "z"}\n  select text') == "id,name,y,z"


@pytest.mark.parametrize(
    "sql, columns",
    [
        ("SELECT T1.a, b FROM one AS T1 JOIN two ON T1.id = two.id WHERE c = 'x y'", ["a", "b", "c", "id"]), (None, []), ("", []),
        ("SELECT count(a), max(T.b) FROM t AS T GROUP BY c HAVING count(*) > 3 ORDER BY d DESC LIMIT 5", ["a", "b", "c", "d"]), ("SELECT a AS total FROM t ORDER BY total", ["a", "total"]),
        ("SELECT CAST(a AS REAL) / b FROM t WHERE c IN (SELECT d FROM u WHERE u.e = t.f)", ["a", "b", "c", "d", "e", "f"]), ("SELECT a FROM t UNION SELECT b FROM u", ["a", "b"]),
        ("SELECT `a b` FROM `t-x` AS y WHERE y.c = \"d e\"", ["a", "b", "c"]), ("SELECT CASE WHEN a > 1 THEN b ELSE 0 END FROM t, u", ["a", "b"]), ("WITH x AS (SELECT a FROM t) SELECT a FROM x", ["a"]),
    ],
)
def test_columns(sql, columns):
    assert tx.columns_of(sql) == columns


def test_schema_items(spark):
    assert tx.Names("SELECT T1.a, b FROM one AS T1 JOIN two ON T1.id = two.id").items == ["a", "b", "id", "one", "one.a", "one.id", "two", "two.id"]
    assert one(spark, F.array_join(tx.schema_items("t"), ","), t="SELECT x.a FROM t AS x") == "a,t,t.a" and one(spark, F.size(tx.schema_items("t")), t=None) == 0


@pytest.mark.parametrize("words, value", [(50, 0.0), (80, 0.0), (90, -0.5), (100, -1.0), (200, -1.0)])
def test_length_penalty(spark, words, value):
    assert one(spark, tx.length_penalty(F.col("n"), 100, 20), n=words) == value


@pytest.mark.parametrize("length, value", [(3, 0.0), (8, -0.6), (20, -1.0)])
def test_length_penalty_ramp(spark, length, value):
    assert abs(one(spark, tx.length_penalty(F.col("n"), 10, 5), n=length) - value) < 1e-12


def test_sets_and_grams(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, tx.jaccard(empty, empty), n=1) == 1.0
    assert one(spark, tx.jaccard(empty, F.array(F.lit("a"))), n=1) == 0.0
    assert one(spark, tx.n_grams(F.array(*map(F.lit, "abc")), 2), n=1) == ["a b", "b c"]
    assert one(spark, tx.n_grams(F.array(F.lit("a")), 2), n=1) == []


def test_sanitise_and_comments(spark):
    assert one(spark, tx.sanitised("t"), t='SELECT "T-CHO", [U-PRO] FROM t WHERE a = \'\'x\'\' ?') == "SELECT `T-CHO`, `U-PRO` FROM t WHERE a = 'x' "
    assert one(spark, tx.checked("t"), t="-- hi\n/* x */ select 1").sql == "select 1"
    assert one(spark, tx.checked("t"), t="-- only").error == "empty_after_comment_strip"
    assert one(spark, tx.checked("t"), t="delete from t").error == "select_only_violation"
    assert one(spark, tx.checked("t"), t="select 1; drop table x").error == "forbidden_token_detected"


def test_error_patterns(spark):
    df = spark.createDataFrame([("SELECT a FROM t", "SELECT COUNT(a) FROM t JOIN u ON t.id = u.id LIMIT 1"), ("SELECT a FROM t", "SELECT a FROM t")], "p string, g string")
    patterns = tx.error_patterns(tx.statement_features("p"), tx.statement_features("g"), F.lit(True), F.lit(True), F.lit(True), F.lit(False))
    rows = [r["x"] for r in df.select(patterns.alias("x")).collect()]
    assert rows[0] == ["aggregation_mismatch", "filter_literal_mismatch", "join_path_mismatch", "limit_mismatch", "missing_required_columns", "missing_required_tables"]
    assert rows[1] == ["other_result_set_mismatch"]


def test_tool_calls(spark):
    text = "plan call:sqlite_query{sql:SELECT '}' || x, f:{a:{b:1}}} then call:peek {t:x} call:none call:open{a:'b} call:x{y}"
    got = tx.calls_in(text)
    assert [(c["id"], c["name"], c["arguments"]) for c in got] == [("call_0", "sqlite_query", "sql:SELECT '}' || x, f:{a:{b:1}}"), ("call_1", "peek", "t:x"), ("call_2", "open", "a:'b"), ("call_3", "x", "y")]
    assert tx.calls_in(None) == [] and tx.calls_in("call:x{never closed") == []
    assert [r["name"] for r in one(spark, tx.tool_calls("t"), t=text)] == ["sqlite_query", "peek", "open", "x"] and not one(spark, tx.tool_calls("t"), t="no calls")


def test_arguments():
    got = arguments.split_arguments("db_id:shop,sql:SELECT a, b FROM t WHERE c IN (1, 2),limit:5")
    assert got == {"db_id": "shop", "sql": "SELECT a, b FROM t WHERE c IN (1, 2)", "limit": "5"}
    assert arguments.split_arguments('columns:["a","b"],where:x=\'1,2\'') == {"columns": '["a","b"]', "where": "x='1,2'"}
    assert arguments.split_arguments(None) == {} and arguments.split_arguments("no pairs") == {}
    assert [arguments.scalar(v) for v in ("true", "null", '<|"|>hi<|"|>', "'q'", "[1, 2]", "5", "2.5", "x")] == [True, None, "hi", "q", [1, 2], 5, 2.5, "x"]


def test_tool_responses(spark):
    assert one(spark, tx.tool_response(F.lit("peek"), "t"), t='{"a": 1}') == '<|tool_response>response:peek{value:{"a": 1}}<tool_response|>'
    shown = one(spark, tx.tool_response(F.lit("sqlite_query"), "t"), t='{"columns": ["a"], "rows": []}')
    assert shown.startswith('<|tool_response>response:sqlite_query{value:{"columns": ["a"], "rows": [], "column_coverage_reminder": "Before') and shown.endswith('."}}<tool_response|>')
    assert "reminder" not in one(spark, tx.tool_response(F.lit("sqlite_query"), "t"), t='{"columns": [], "error": "x"}') and "{value:null}" in one(spark, tx.tool_response(F.lit("sqlite_query"), "t"), t=None)
    assert one(spark, tx.before_first_call("t"), t=" thinking \n call:peek{t:x} call:x{}") == "thinking" and one(spark, tx.before_first_call("t"), t=None) == ""


def test_messages(spark):
    message = lambda r, c: F.struct(F.lit(r).alias("role"), F.lit(c).alias("content"))
    m = F.array(message("system", "s"), message("user", "u"), message("assistant", "a"))
    assert one(spark, tx.render_prompt(tx.without_role(m)), n=1) == "SYSTEM: s\n\nUSER: u\n\nASSISTANT:"
    assert one(spark, tx.completion_text(m), n=1) == "s\nu\na"
    assert one(spark, tx.first_of_role(m, "user"), n=1) == "u"
    assert one(spark, tx.first_of_role(m, "tool"), n=1) is None
    assert one(spark, tx.question_text("t"), t="x\nQuestion: how many?\nEvidence: y") == "how many?"
    assert one(spark, tx.question_text("t"), t="Question: two\nlines, one question") == "two\nlines, one question"
    assert one(spark, tx.question_text("t"), t="<question>\ntagged </question>\nQuestion: x") == "tagged" and one(spark, tx.question_text("t"), t="no question: here") is None


def test_rewrite():
    assert compat.rewrite("SELECT a FROM t LIMIT 9, 2") == "SELECT a FROM t LIMIT 2 OFFSET 9"
    assert compat.rewrite("SELECT  iif(a == 1,'LIMIT 1, 2', \"b c\")\nFROM [t] WHERE a LIKE 'x%';") == "SELECT if(a = 1, 'LIMIT 1, 2', `b c`) FROM `t` WHERE a ILIKE 'x%'"
    assert compat.rewrite('SELECT "lit" FROM t', {"a"}) == "SELECT 'lit' FROM t"


def test_where_fragment(spark):
    df = spark.range(5)
    assert compat.where_fragment(df, "id > 2").count() == 2
    assert compat.where_fragment(df, " ").count() == 5
    for bad in ("1=1) OR (1=1", "id > 1; drop table x", "id > 1 -- x"):
        with pytest.raises(ValueError):
            compat.where_fragment(df, bad)


#: Own statements in the dialect; {n} is replaced by each of 0 to 4.
STATEMENTS = """
SELECT a, sum(b) FROM t GROUP BY a ORDER BY a
SELECT a FROM t ORDER BY b, a LIMIT 1, 2
SELECT a FROM t ORDER BY b, a LIMIT {n}, 2
SELECT iif(b > {n}, 'hi', 'lo') AS x, a FROM t ORDER BY a, b
SELECT a FROM t WHERE c LIKE 'X%' ORDER BY b
SELECT a FROM t WHERE c NOT LIKE '%A%' ORDER BY b
SELECT "a" FROM t WHERE c IS NOT NULL ORDER BY b
SELECT [a], `b` FROM [t] WHERE c == 'xa' -- a remark
SELECT /* a remark */ 'LIMIT 1, 2', "no such column" FROM t LIMIT 1
SELECT count(DISTINCT a), max(b), min(c) FROM t
SELECT a FROM t WHERE b = (SELECT max(b) FROM t)
SELECT ifnull(c, '-') AS c, b FROM t ORDER BY b
SELECT strftime('%Y', d) AS y, count(*) FROM t GROUP BY 1 ORDER BY 1
WITH x AS (SELECT a FROM t WHERE b > {n}) SELECT count(*) FROM x
SELECT a FROM t EXCEPT SELECT a FROM t WHERE b > 3 ORDER BY a
SELECT a FROM t UNION SELECT b FROM t ORDER BY 1
SELECT 5/2
SELECT -7/2
SELECT 1/0
SELECT 5/2.0
SELECT {n}/3, {n}/2, 7/{n}, 7.5/{n}
SELECT a/b FROM t ORDER BY a, b
SELECT a*10/b/2 FROM t ORDER BY a, b
SELECT SUM(a)/COUNT(*)/{n} FROM t
SELECT (a/2)/{n}, a/(b/2) FROM t ORDER BY a, b
SELECT SUM(a)/COUNT(*) FROM t
SELECT CAST(a AS REAL)/b FROM t ORDER BY a, b
SELECT CAST(c AS REAL), CAST(c AS INTEGER) FROM t ORDER BY a, b
SELECT CAST(r AS INTEGER), CAST(a AS TEXT) FROM t ORDER BY a, b
SELECT CAST('{n}.5abc' AS REAL), CAST(' -{n}x' AS INTEGER), CAST('.{n}e1' AS FLOAT), CAST('e{n}' AS NUMERIC)
SELECT SUM(a > {n}), SUM(c = 'xa' OR b IN (3, {n})), AVG(b > {n}) FROM t
SELECT SUM(b IS NULL), SUM(c LIKE 'x%'), SUM(NOT a = {n}), SUM(b BETWEEN 1 AND {n}) FROM t
SELECT SUM(DISTINCT a), SUM(a) FROM t WHERE a > {n}
SELECT SUBSTR(c, {n}, 3), SUBSTR(c, {n}), SUBSTR(c, -1), substr(c, 1, {n}) FROM t ORDER BY a, b
SELECT SUBSTR(c, b - 2, 2) FROM t ORDER BY a, b
SELECT GROUP_CONCAT(b) FROM (SELECT b FROM t WHERE a = 1 ORDER BY b)
SELECT GROUP_CONCAT(c, '; ') FROM t WHERE a = 1 AND b = {n}
SELECT date(d), datetime(d) FROM t ORDER BY a, b
SELECT strftime('%J', d) FROM t WHERE a = 1 ORDER BY b
SELECT strftime('%Y-%m', d), strftime('%w', d), strftime('%j', d), strftime('%s', d) FROM t ORDER BY a, b
SELECT strftime('%H:%M:%S', d), strftime('%d/%m/%Y', d) FROM t ORDER BY a, b
SELECT strftime('%Y', d) - 199{n} FROM t ORDER BY a, b
SELECT strftime('%Y', '2020-05-01') - strftime('%Y', '199{n}-01-01')
SELECT SUBSTR(d, 1, 4) - 2000, SUBSTR(d, 6, 2) + {n} FROM t ORDER BY a, b
SELECT julianday(d) - julianday('2020-01-0{n}') FROM t ORDER BY a, b
SELECT CAST((julianday(MAX(d)) - julianday(MIN(d))) / 365 AS INTEGER), ROUND(julianday(MAX(d)) - julianday(MIN(d)), {n}) FROM t
SELECT c FROM t WHERE c > {n} ORDER BY a, b
SELECT c FROM t WHERE c = {n}
SELECT c FROM t WHERE {n} < c ORDER BY a, b
SELECT MAX(a, b), MIN(a, b, {n}) FROM t ORDER BY a, b
SELECT TOTAL(r), TOTAL(a), TOTAL(b) FROM t WHERE a > {n}
SELECT ROUND(2.5), ROUND(-2.5), ROUND(r, {n}), ABS(r) FROM t ORDER BY a, b
SELECT CASE WHEN a > {n} THEN 10 ELSE 5 END / 2 FROM t ORDER BY a, b
SELECT 100 * SUM(CASE WHEN a = {n} THEN 1 ELSE 0 END) / COUNT(a) FROM t
SELECT CAST(SUM(CASE WHEN a = {n} THEN 1 ELSE 0 END) AS REAL) * 100 / COUNT(a) FROM t
SELECT SUM(IIF(a = {n}, 1, 0)) * 1.0 / COUNT(*) FROM t
SELECT COUNT(*) / (SELECT COUNT(*) FROM t WHERE a = {n}) FROM t
SELECT a, COUNT(*) FROM t GROUP BY a HAVING COUNT(*) / 2 > {n} ORDER BY a
SELECT iif(a/2 = {n}, 'x', 'y') FROM t ORDER BY a, b
SELECT r / a, r / {n} FROM t ORDER BY a, b
SELECT AVG(a), AVG(r) FROM t
SELECT a FROM t WHERE a BETWEEN {n}/2 AND 7/2 ORDER BY a
SELECT -a/2, a - b/2, a/-2, a % 3 FROM t ORDER BY a, b
SELECT (a + b) / (b - {n}) FROM t ORDER BY a, b
SELECT t.a / t.b FROM t ORDER BY t.a, t.b
SELECT LENGTH(c), UPPER(c), INSTR(c, 'b'), c || '-' || a FROM t ORDER BY a, b
SELECT DISTINCT a/2 FROM t ORDER BY 1
SELECT COUNT(DISTINCT a/2), COUNT(DISTINCT CASE WHEN b > {n} THEN a END) FROM t
SELECT a, b, RANK() OVER (ORDER BY a) FROM t ORDER BY a, b
SELECT x.a, y.b FROM t AS x JOIN t AS y ON x.a = y.b WHERE x.b > {n} ORDER BY 1, 2, x.b
SELECT x.a, y.b FROM t AS x LEFT JOIN t AS y ON x.a = y.b + {n} ORDER BY x.a, x.b
SELECT a FROM t WHERE EXISTS (SELECT 1 FROM t AS u WHERE u.b = t.a) AND a NOT IN (SELECT b FROM t WHERE b > {n}) ORDER BY a, b
SELECT a, MAX(b) FROM t
SELECT c, MIN(b) FROM t WHERE a > 1
SELECT a, d, COUNT(*) FROM t WHERE b = {n} GROUP BY a ORDER BY a
"""


def corpus():
    for line in STATEMENTS.strip().splitlines():
        yield from (line.replace("{n}", str(n)) for n in range(5)) if "{n}" in line else [line]


def test_dialect_against_sqlite(spark, tmp_path):
    """Over 200 statements: the service gives on Spark what SQLite gives for the text as it is."""
    import sqlite3

    from assay.plans.service import QueryService

    data = [(1, 2, "xa", "2020-01-05", 2.5), (1, 3, "Xb", "2020-07-01", -1.25), (2, 4, "yc", "2021-02-03", 1e8), (3, 1, None, None, None), (4, 0, "12abc", "1999-12-31 23:59:58", 7.0)]
    lite = sqlite3.connect(":memory:")
    lite.execute("CREATE TABLE t (a INTEGER, b INTEGER, c TEXT, d TEXT, r REAL)")
    lite.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", data)
    spark.createDataFrame(data, "a int, b int, c string, d string, r double").coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    service = QueryService(spark, str(tmp_path))
    plain = lambda v: round(float(v), 6) if isinstance(v, (bool, int, float)) else v
    wrong, seen = [], 0
    for sql in corpus():
        seen += 1
        got = service.query(sql)
        want = [[plain(v) for v in r] for r in lite.execute(sql).fetchall()]
        if "error" in got or [[plain(v) for v in r] for r in got["rows"]] != want:
            wrong.append((sql, got.get("rows", got), want))
    assert seen >= 200 and not wrong, f"{len(wrong)} of {seen}: {wrong[:5]}"


def test_casts_against_sqlite(spark):
    import sqlite3

    lite = sqlite3.connect(":memory:")
    for text in ("12abc", "abc", " 3.5 ", "-2", "1e3x", "", None):
        df = spark.createDataFrame([(text,)], "t string")
        got = df.select(compat.number(F.col("t")).alias("r"), compat.integer(F.col("t")).alias("i")).first()
        assert tuple(got) == lite.execute("SELECT CAST(? AS REAL), CAST(? AS INTEGER)", (text, text)).fetchone(), text
    pairs = [(5, 2), (-7, 2), (7, -2), (1, 0)]
    df = spark.createDataFrame(pairs, "a int, b int").select(compat.divide(F.col("a"), F.col("b"), True).alias("x"))
    assert [r["x"] for r in df.collect()] == [lite.execute("SELECT ? / ?", p).fetchone()[0] for p in pairs]
