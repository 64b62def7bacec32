"""Every query of the engine's own operators, with its SQL for the side-by-side check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL where SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""
SELECT c_mktsegment, count(*) AS n_orders, sum(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END) AS n_high,
 round(CAST(sum(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END) AS DOUBLE) * 100 / count(*), 6) AS pct_high
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY c_mktsegment
""")
def flagship_ratio_by_segment(spark: SparkSession, d: str) -> DataFrame:
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    high = F.count_if(F.col("o_totalprice") > 200000)
    return (
        orders.where("o_orderstatus <> 'P'")
        .join(customer, orders.o_custkey == customer.c_custkey)
        .groupBy("c_mktsegment")
        .agg(F.count("*").alias("n_orders"), high.alias("n_high"), F.round(high.cast("double") * 100 / F.count("*"), 6).alias("pct_high"))
    )


# the queries register themselves when their modules are read
from . import evaluation, library, relational, texts  # noqa: E402, F401
