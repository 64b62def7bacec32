"""The relational surface: predicates, joins, aggregations, windows, ordering, set operations and scalar functions over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import compat
from ..sources.catalog import register, table
from .catalogue import query

C = F.col


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity / l_extendedprice AS ratio FROM lineitem")
def project_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (C("l_extendedprice") * (1 - C("l_discount"))).alias("net"), (C("l_quantity") / C("l_extendedprice")).alias("ratio")
    )


@query("""
SELECT l_orderkey, l_linenumber FROM lineitem
WHERE (l_quantity BETWEEN 10 AND 20 OR l_discount >= 0.08) AND l_returnflag IN ('A', 'R') AND l_linestatus NOT IN ('X')
 AND l_shipdate >= TIMESTAMP '1995-01-01' AND l_tax <> 0.02
""")
def filter_predicates(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "lineitem")
        .where((C("l_quantity").between(10, 20) | (C("l_discount") >= 0.08)) & C("l_returnflag").isin("A", "R") & ~C("l_linestatus").isin("X"))
        .where((C("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")) & (C("l_tax") != 0.02))
        .select("l_orderkey", "l_linenumber")
    )


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%a%' AND p_type NOT ILIKE 'promo%' AND p_brand BETWEEN 'Brand#1' AND 'Brand#4'")
def filter_like_between_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(C("p_name").ilike("%a%") & ~C("p_type").ilike("promo%") & C("p_brand").between("Brand#1", "Brand#4")).select("p_partkey", "p_name")


@query("SELECT count(*) AS n, count(*) FILTER (evidence IS NULL) AS n_null, count(*) FILTER (evidence IS NOT NULL) AS n_set FROM dev_tied_append")
def filter_null_tests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dev_tied_append").agg(
        F.count("*").alias("n"), F.count_if(C("evidence").isNull()).alias("n_null"), F.count_if(C("evidence").isNotNull()).alias("n_set")
    )


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_project(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("""
SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class,
 CASE WHEN p_retailprice > 1000 THEN 1 ELSE 0 END AS costly FROM part
""")
def case_iif_expr(spark: SparkSession, d: str) -> DataFrame:
    size = F.when(C("p_size") < 10, "small").when(C("p_size") < 30, "medium").otherwise("large")
    return table(spark, d, "part").select("p_partkey", size.alias("size_class"), F.expr("if(p_retailprice > 1000, 1, 0)").alias("costly"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'F'")
def filter_fragment(spark: SparkSession, d: str) -> DataFrame:
    """A WHERE fragment given as text (checked to be one expression) is an ordinary predicate and reaches the scan."""
    return compat.where_fragment(table(spark, d, "orders"), "o_totalprice > 150000 AND o_orderstatus = 'F'").select("o_orderkey")


@query("""
SELECT r_name, n_name, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey
JOIN lineitem ON o_orderkey = l_orderkey WHERE r_name <> 'ASIA' GROUP BY r_name, n_name
""")
def join_multiway(spark: SparkSession, d: str) -> DataFrame:
    r, n, c, o, li = (table(spark, d, t) for t in ("region", "nation", "customer", "orders", "lineitem"))
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .join(r.where("r_name <> 'ASIA'"), n.n_regionkey == r.r_regionkey)
        .groupBy("r_name", "n_name")
        .agg(F.count("*").alias("n_lines"), F.round(F.sum(C("l_extendedprice") * (1 - C("l_discount"))), 2).alias("revenue"))
    )


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000")
def join_inner(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).where("c_acctbal > 5000").select("o_orderkey", "c_name")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join_left_outer(spark: SparkSession, d: str) -> DataFrame:
    """Orders are counted by customer before the join: the join moves one row a customer, not one an order."""
    c = table(spark, d, "customer").select("c_custkey")
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return c.join(n, c.c_custkey == n.o_custkey, "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"))


@query("SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate AND l_extendedprice < o_totalprice")
def join_multi_cond(spark: SparkSession, d: str) -> DataFrame:
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return li.join(o, (li.l_orderkey == o.o_orderkey) & (li.l_shipdate > o.o_orderdate) & (li.l_extendedprice < o.o_totalprice)).agg(F.count("*").alias("n"))


@query("SELECT a.s_suppkey AS supp_a, b.s_suppkey AS supp_b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def join_self(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "supplier").alias("a"), table(spark, d, "supplier").alias("b")
    return a.join(b, (C("a.s_nationkey") == C("b.s_nationkey")) & (C("a.s_suppkey") < C("b.s_suppkey"))).select(C("a.s_suppkey").alias("supp_a"), C("b.s_suppkey").alias("supp_b"))


@query("""
SELECT c_custkey, c_name, t.n, t.top FROM customer JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey) t ON c_custkey = t.o_custkey WHERE t.n > 3
""")
def join_derived(spark: SparkSession, d: str) -> DataFrame:
    """A join to a derived table, which is aggregated before the join."""
    t = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top")).where("n > 3")
    c = table(spark, d, "customer")
    return c.join(t, c.c_custkey == t.o_custkey).select("c_custkey", "c_name", "n", "top")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_in(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 300000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("SELECT count(*) AS n FROM dev_tied_append WHERE db_id NOT IN (SELECT db_id FROM db_catalog WHERE is_public)")
def anti_not_in(spark: SparkSession, d: str) -> DataFrame:
    """NOT IN keeps SQL's rule for nulls: Catalyst plans a null-aware anti join, which a plain left_anti is not."""
    register(spark, d, ["dev_tied_append", "db_catalog"])
    return spark.sql("SELECT count(*) AS n FROM dev_tied_append WHERE db_id NOT IN (SELECT db_id FROM db_catalog WHERE is_public)")


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def exists_corr(spark: SparkSession, d: str) -> DataFrame:
    register(spark, d, ["customer", "orders"])
    return spark.sql("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")


@query("""
SELECT o_orderkey, o_totalprice - (SELECT avg(o_totalprice) FROM orders) AS over_mean FROM orders
WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders)
""")
def scalar_subquery(spark: SparkSession, d: str) -> DataFrame:
    register(spark, d, ["orders"])
    return spark.sql(
        "SELECT o_orderkey, o_totalprice - (SELECT avg(o_totalprice) FROM orders) AS over_mean FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders)"
    )


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS sum_qty, round(avg(l_discount), 8) AS avg_disc, min(l_tax) AS min_tax, max(l_extendedprice) AS max_price
FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def agg_basic(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "lineitem")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.count("*").alias("n"), F.sum("l_quantity").alias("sum_qty"), F.round(F.avg("l_discount"), 8).alias("avg_disc"),
            F.min("l_tax").alias("min_tax"), F.max("l_extendedprice").alias("max_price"),
        )
    )


@query("""
SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS filled FROM orders GROUP BY o_orderpriority
""")
def agg_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Two distinct counts over one key column become one distinct set with a flag, so rows aren't expanded for each of them."""
    pairs = table(spark, d, "orders").groupBy("o_orderpriority", "o_custkey").agg(F.max((C("o_orderstatus") == "F").cast("int")).alias("f"))
    return pairs.groupBy("o_orderpriority").agg(F.count("o_custkey").alias("customers"), F.count_if((C("f") == 1) & C("o_custkey").isNotNull()).alias("filled"))


@query("""
SELECT l_shipdate::DATE AS day, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS returned, sum((l_discount > 0.05)::INT)::BIGINT AS discounted,
 count(CASE WHEN l_tax > 0.04 THEN 1 END) AS taxed FROM lineitem GROUP BY 1
""")
def agg_conditional(spark: SparkSession, d: str) -> DataFrame:
    """SUM over a truth value is an integer sum; unlike a count of true rows it is null where nothing was added up."""
    return (
        table(spark, d, "lineitem")
        .groupBy(C("l_shipdate").cast("date").alias("day"))
        .agg(F.sum(F.when(C("l_returnflag") == "R", C("l_quantity")).otherwise(0.0)).alias("returned"), compat.sum_bool(C("l_discount") > 0.05).alias("discounted"), F.count(F.when(C("l_tax") > 0.04, 1)).alias("taxed"))
    )


@query("SELECT o_custkey, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL HAVING count(*) > 5 AND sum(o_totalprice) > 500000")
def agg_having(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    return g.where("n > 5 AND t > 500000").select("o_custkey", "o_orderstatus", "n", F.round("t", 2).alias("total"))


@query("SELECT max(n) AS most, round(avg(n), 6) AS mean FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)")
def agg_of_agg(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


@query("""
SELECT round(CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) * 100 / nullif(count(*), 0), 6) AS pct,
 sum(o_totalprice) / nullif(sum(CASE WHEN o_orderstatus = 'none' THEN 1 ELSE 0 END), 0) AS by_zero FROM orders
""")
def agg_ratio(spark: SparkSession, d: str) -> DataFrame:
    none = F.sum(F.when(C("o_orderstatus") == "none", 1).otherwise(0))
    filled = F.sum(F.when(C("o_orderstatus") == "F", 1).otherwise(0)).cast("double")
    return table(spark, d, "orders").agg(F.round(F.try_divide(filled * 100, F.count("*")), 6).alias("pct"), F.try_divide(F.sum("o_totalprice"), none.cast("double")).alias("by_zero"))


@query("SELECT c_custkey, rank() OVER (ORDER BY c_acctbal DESC) AS rnk FROM customer QUALIFY rnk <= 50")
def rank_global(spark: SparkSession, d: str) -> DataFrame:
    """The rank of rows from the top: only rows at or above the 50th value can have it, and they are found by a top-k before the one-task window."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    edge = c.orderBy(F.desc("c_acctbal")).limit(50).agg(F.min("c_acctbal").alias("edge"))
    top = c.join(F.broadcast(edge), C("c_acctbal") >= C("edge"))
    return top.withColumn("rnk", F.rank().over(Window.orderBy(F.desc("c_acctbal")))).where("rnk <= 50").select("c_custkey", "rnk")


@query("""
SELECT p_brand, n, rank() OVER (ORDER BY n DESC) AS rnk FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)
""")
def rank_over_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")).withColumn("rnk", F.rank().over(Window.orderBy(F.desc("n"))))


@query("SELECT p_brand, p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS rnk FROM part QUALIFY rnk <= 5")
def rank_topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    rnk = F.rank().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice")))
    return table(spark, d, "part").withColumn("rnk", rnk).where("rnk <= 5").select("p_brand", "p_partkey", "rnk")


@query("SELECT p_brand, p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS place FROM part QUALIFY place <= 2")
def dense_rank_argmax(spark: SparkSession, d: str) -> DataFrame:
    """The parts of the two greatest sizes of each brand, ties kept."""
    place = F.dense_rank().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size")))
    return table(spark, d, "part").select("p_brand", "p_partkey", place.alias("place")).where("place <= 2")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk_order_limit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 5 OFFSET 9")
def limit_offset(spark: SparkSession, d: str) -> DataFrame:
    register(spark, d, ["orders"])
    return spark.sql(compat.rewrite("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 9, 5"))


@query("SELECT p_partkey FROM part WHERE p_size = (SELECT max(p_size) FROM part)")
def argmax_with_ties(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.join(F.broadcast(p.agg(F.max("p_size").alias("top"))), C("p_size") == C("top")).select("p_partkey")


@query("SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "customer").select(C("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()
    n = table(spark, d, "nation")
    return n.join(keys, n.n_nationkey == keys.k, "left_semi").select("n_name")


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 3 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    many = o.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 3").select("o_custkey")
    return many.subtract(o.where("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(C("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").where("s_acctbal > 0").select("s_nationkey"))


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT l_orderkey FROM lineitem WHERE l_quantity > 49")
def set_union_all(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderstatus = 'P'").select(C("o_orderkey").alias("k")).unionAll(table(spark, d, "lineitem").where("l_quantity > 49").select("l_orderkey"))


@query("SELECT strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%m') AS m, count(*) AS n FROM orders GROUP BY ALL")
def date_parts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy(compat.strftime("%Y", C("o_orderdate")).alias("y"), compat.strftime("%m", C("o_orderdate")).alias("m")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, round(julian(l_shipdate) - julian(o_orderdate), 6) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def julian_diff(spark: SparkSession, d: str) -> DataFrame:
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    days = compat.julianday(C("l_shipdate")) - compat.julianday(C("o_orderdate"))
    return li.join(o, li.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", F.round(days, 6).alias("days"))


@query("""
SELECT p_partkey, substr(p_name, 1, 3) AS head, substr(p_name, -2) AS tail, instr(p_name, ' ') AS blank, length(p_type) AS n, p_brand || '/' || p_type AS both_,
 TRY_CAST(substr(p_brand, instr(p_brand, '#') + 1) AS BIGINT) AS brand_no FROM part
""")
def text_substr_instr(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        "p_partkey", compat.substr(C("p_name"), 1, 3).alias("head"), compat.substr(C("p_name"), -2).alias("tail"), F.instr("p_name", " ").alias("blank"), F.length("p_type").alias("n"),
        F.concat("p_brand", F.lit("/"), "p_type").alias("both_"), F.expr("try_cast(substr(p_brand, instr(p_brand, '#') + 1) as bigint)").alias("brand_no"),
    )


@query("""
SELECT s_suppkey, abs(s_acctbal) AS size, round(s_acctbal) AS whole, CAST(trunc(s_acctbal) AS BIGINT) AS back FROM supplier
""")
def math_round_abs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(
        "s_suppkey", F.abs("s_acctbal").alias("size"), F.round("s_acctbal").alias("whole"), C("s_acctbal").cast("bigint").alias("back")
    )


@query("""
SELECT record_id, 60 * CAST(split_part(t, ':', 1) AS DOUBLE) + CAST(split_part(t, ':', 2) AS DOUBLE) AS seconds
FROM (SELECT record_id, (record_id % 60)::VARCHAR || ':' || lpad((record_id * 7 % 60)::VARCHAR, 2, '0') || '.5' AS t FROM dev_tied_append)
""")
def time_parse(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat((C("record_id") % 60).cast("string"), F.lit(":"), F.lpad((C("record_id") * 7 % 60).cast("string"), 2, "0"), F.lit(".5"))
    return table(spark, d, "dev_tied_append").select("record_id", compat.minutes_seconds(t).alias("seconds"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("""
SELECT coalesce(nullif(trim(db_id), ''), 'unknown') AS grp, CASE WHEN grouping(difficulty) = 1 THEN 'all' ELSE coalesce(nullif(lower(trim(difficulty)), ''), 'unknown') END AS lvl, count(*) AS n
FROM dev_tied_append GROUP BY GROUPING SETS ((db_id, difficulty), (db_id))
""")
def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Both levels of detail from one pass and one shuffle."""
    register(spark, d, ["dev_tied_append"])
    return spark.sql("""
SELECT coalesce(nullif(trim(db_id), ''), 'unknown') AS grp, CASE WHEN grouping(difficulty) = 1 THEN 'all' ELSE coalesce(nullif(lower(trim(difficulty)), ''), 'unknown') END AS lvl, count(*) AS n
FROM dev_tied_append GROUP BY GROUPING SETS ((db_id, difficulty), (db_id))""")
