"""Running totals over hash order, and joins on hot keys, without one task that gets them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_unit(salt: str, *keys: str) -> Column:
    """A salted key hash as a number in [0, 1) with 52 bits; the same in any order, partitioning and run."""
    text = F.concat_ws(":", F.lit(salt), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def running_total(df: DataFrame, group: list[str], unit: str, tie: str, size: str, slots: int = 1024) -> DataFrame:
    """df with before: the sum of size over the group's rows that precede in order of (unit, tie).

    Rows are dealt into slots of the unit interval; the slots' sums, at most slots for each group, give every
    slot its start, and only rows of one slot of one group are sorted together.
    """
    dealt = df.withColumn("slot", F.floor(F.col(unit) * slots).cast("int"))
    sums = dealt.groupBy(*group, "slot").agg(F.sum(size).alias("slot_size"))
    start = sums.withColumn("slot_start", F.sum("slot_size").over(Window.partitionBy(*group).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)))
    start = start.select(*group, "slot", F.coalesce("slot_start", F.lit(0)).alias("slot_start"))
    keys = [F.col(f"x.{g}").eqNullSafe(F.col(f"y.{g}")) for g in group]
    met = dealt.alias("x").join(start.alias("y"), [*keys, F.col("x.slot") == F.col("y.slot")]).select("x.*", "y.slot_start")
    inner = Window.partitionBy(*group, "slot").orderBy(unit, tie).rowsBetween(Window.unboundedPreceding, -1)
    return met.withColumn("before", F.col("slot_start") + F.coalesce(F.sum(size).over(inner), F.lit(0))).drop("slot", "slot_start")


def join_counted(rows: DataFrame, groups: DataFrame, keys: list[str], most: int = 10_000) -> DataFrame:
    """rows joined with groups, which has one row for each of its keys and n, about how many of rows have that key.

    Keys that hold over one in most of the counted rows, so fewer than most keys, are joined by broadcast: no task gets all rows of a
    hot key. The others meet by a shuffle, or as the planner finds best. Null keys meet nothing.
    """
    total = groups.agg(F.sum("n")).first()[0] or 0
    limit = max(100_000, total // most)
    hot = groups.where(F.col("n") > limit)
    if hot.isEmpty():
        return rows.join(groups, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.where(F.col("n") <= limit), keys))
