"""Session defaults. A session the cluster has already configured is left as it is."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .shipping import ship

#: Only defaults: every one of them can be overridden by spark-submit or spark-defaults.conf.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; conf keys use '__' for '.'."""
    builder = SparkSession.builder.appName("assay")
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark
