"""Tables of a folder of parquet files, as frames and as temporary views."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; columns that a query doesn't use are never read."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the parquet tables in folder, in order; any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = (os.path.basename(str(f.getPath())) for f in fs.listStatus(path))
    return sorted(n[: -len(".parquet")] for n in names if n.endswith(".parquet"))


def register(spark: SparkSession, folder: str, names: list[str] | None = None) -> list[str]:
    """Registers the tables as temporary views; the names registered."""
    names = table_names(spark, folder) if names is None else names
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)
    return names


def columns(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """The column catalog: (table_name, ordinal, column_name, column_type, nullable), from the footers alone."""
    rows = [
        (name, i, field.name, field.dataType.simpleString(), field.nullable)
        for name in (table_names(spark, folder) if names is None else names)
        for i, field in enumerate(table(spark, folder, name).schema.fields)
    ]
    return spark.createDataFrame(rows, "table_name string, ordinal int, column_name string, column_type string, nullable boolean")


#: Declared foreign keys of the star schema: (table, column, referenced table, referenced column).
STAR_KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
]


def foreign_keys(spark: SparkSession, keys: list[tuple[str, str, str, str]] = STAR_KEYS) -> DataFrame:
    """Foreign keys as a metadata frame; Spark's catalog has none of its own."""
    return spark.createDataFrame(keys, "table1 string, column1 string, table2 string, column2 string")


def roots(given: list[str], kept: str | None = None, first: bool = True) -> list[str]:
    """Folders to look for databases in, each once: the given ones and those of a list with ':' between them, before or after them."""
    old = [r for r in (kept or "").split(":") if r.strip()]
    return list(dict.fromkeys(r.rstrip("/") or "/" for r in (given + old if first else old + given) if r.strip()))


def resolve(spark: SparkSession, db_id: str, roots: list[str]) -> str:
    """The first folder of the roots that is there, else '': <root>/<db_id>/<db_id>, <root>/<db_id>, the same below databases, dev_databases and
    train_databases, or a root that is the database's own folder."""
    jvm = spark.sparkContext._jvm
    for root in dict.fromkeys(roots):
        below = [f"{root}/{part}{db_id}" for part in ("", "databases/", "dev_databases/", "train_databases/")]
        own = [root] if root.rstrip("/").endswith(f"/{db_id}") else []
        for candidate in [c for b in below for c in (f"{b}/{db_id}", b)] + own:
            path = jvm.org.apache.hadoop.fs.Path(candidate)
            if db_id and path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
                return candidate
    return ""


def empty_like(df: DataFrame) -> DataFrame:
    """No rows of df's schema."""
    return df.where(F.lit(False))
