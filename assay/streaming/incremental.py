"""Evaluation of candidates as they arrive, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_accuracy(stream: DataFrame, time: str, group: str, correct: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, grp, n, right, accuracy) of each event-time window and group; rows later than late are dropped and the state behind the watermark is freed.

    Works on a batch frame too, where nothing is late. Null groups are 'unknown', null outcomes count as wrong, rows without time belong to no window.
    """
    ok = F.coalesce(F.col(correct).cast("int"), F.lit(0))
    timed = stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    counted = timed.groupBy(F.window("_at", size).alias("w"), F.coalesce(F.col(group), F.lit("unknown")).alias("grp")).agg(F.count("*").alias("n"), F.sum(ok).alias("right"))
    return counted.select(F.col("w.start").alias("start"), "grp", "n", "right", (100.0 * F.col("right") / F.col("n")).alias("accuracy"))
