"""A sample that matches target proportions of categories.

A question counts in every category in which it has a record. The draw has three steps: each question of a category is accepted on its
own with a probability of quota to observed, raised by OVERSAMPLE; the accepted ones are then cut, or filled up, to the exact quota in order
of the same hash; what a category can't give is its deficit.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .ranks import hash_unit

#: Acceptance probabilities are this much above target-to-observed, so that a category seldom comes short.
OVERSAMPLE = 1.1
#: Most different categories the targets may have; their plan is broadcast and their quotas are found on the driver.
MOST_TARGETS = 100_000

_CATEGORY = ["db_id", "difficulty"]


def _units(records: DataFrame) -> DataFrame:
    """(question_id, db_id, difficulty), each once."""
    level = F.lower(F.trim(F.col("difficulty")))
    return records.where("question_id is not null").select(
        "question_id", "db_id", F.when(F.coalesce(level, F.lit("")) == "", F.lit("unknown")).otherwise(level).alias("difficulty")
    ).distinct()


def _met(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """left joined with a table of one row a category, which null db_ids meet too. The table has at most MOST_TARGETS rows, which is checked where targets are read."""
    right = right.withColumnsRenamed({c: f"_{c}" for c in _CATEGORY})
    on = F.col("db_id").eqNullSafe(F.col("_db_id")) & F.col("difficulty").eqNullSafe(F.col("_difficulty"))
    return left.join(F.broadcast(right), on, how).drop("_db_id", "_difficulty")


def needs(units: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each target with available and need: max(min_rows, share_per_10000 * sample_size / 10000 rounded up). Null shares and minima count as 0."""
    if targets.select(*_CATEGORY).distinct().limit(MOST_TARGETS + 1).count() > MOST_TARGETS:
        raise ValueError(f"over {MOST_TARGETS} categories in the targets")
    seen = _met(units, targets.select(*_CATEGORY).distinct()).groupBy(*_CATEGORY).agg(F.count("*").cast("long").alias("seen"))
    share = F.expr("coalesce((cast(share_per_10000 as bigint) * sample_size + 9999) div 10000, 0)")
    t = _met(targets.select("target_no", *_CATEGORY, "share_per_10000", "min_rows", "sample_size"), seen, "left")
    t = t.withColumn("available", F.coalesce("seen", F.lit(0)).cast("long")).drop("seen")
    return t.withColumn("need", F.greatest(F.coalesce(F.col("min_rows").cast("long"), F.lit(0)), share))


def draw(units: DataFrame, plan: DataFrame, seed: str, slots: int = 4096) -> DataFrame:
    """(question_id, db_id, difficulty): of each category of plan (db_id, difficulty, available, quota) exactly quota units, or all there are.

    Each unit is accepted on its own, if its salted hash is below quota / available * OVERSAMPLE. The counts are then made exact by the
    same hash: the slot of the hash in which a category's count passes its quota is found from counts by slot, and only that slot's rows
    are ranked. A category that came short takes its next units in hash order, as if it had been accepted with a higher
    probability.
    """
    plan = plan.where("quota > 0")
    drawn = _met(units.withColumn("u", hash_unit(seed, "question_id", "difficulty", "db_id")), plan)
    drawn = drawn.withColumn("accepted", F.col("u") < F.least(F.lit(1.0), F.col("quota") / F.col("available") * OVERSAMPLE)).withColumn("slot", F.floor(F.col("u") * slots).cast("int"))
    drawn = cut(drawn.select("question_id", *_CATEGORY, "u", "slot", "quota", "accepted"), "drawn")
    counts = cut(drawn.groupBy(*_CATEGORY, "quota", "slot").agg(F.count_if("accepted").alias("n"), F.count("*").alias("all")), "counts")  # slots rows a category
    short = counts.groupBy(*_CATEGORY, "quota").agg((F.sum("n") < F.col("quota")).alias("short"))
    by_slot = _met(counts.drop("quota"), short).withColumn("n", F.when(F.col("short"), F.col("all")).otherwise(F.col("n")))
    upto = by_slot.withColumn("upto", F.sum("n").over(Window.partitionBy(*_CATEGORY).orderBy("slot")))
    edge = upto.groupBy(*_CATEGORY, "short").agg(F.min(F.when(F.col("upto") >= F.col("quota"), F.struct("slot", (F.col("upto") - F.col("n")).alias("below")))).alias("e"))
    edge = edge.select(*_CATEGORY, "short", F.coalesce("e.slot", F.lit(slots)).alias("edge"), F.coalesce("e.below", F.lit(0)).alias("below"))
    met = _met(drawn, cut(edge, "edge")).where("accepted or short")
    columns = ["question_id", *_CATEGORY]
    at = met.where("slot = edge").withColumn("turn", F.row_number().over(Window.partitionBy(*_CATEGORY).orderBy("u", "question_id")))
    return met.where("slot < edge").select(*columns).unionByName(at.where("turn <= quota - below").select(*columns))


def unmet_in_sample(records: DataFrame, targets: DataFrame, seed: str = "quota-1") -> DataFrame:
    """(db_id, difficulty) of the targets that can't be met: those whose need the draw didn't reach.

    A question is drawn for each category in which it has a record; null question_ids don't count. Null db_ids match null
    targets. A category of several targets is drawn for the largest need. No targets, no rows; no records, every target that needs any.
    """
    units = _units(records)
    wanted = cut(needs(units, targets), "needs")
    plan = wanted.groupBy(*_CATEGORY).agg(F.max("available").alias("available"), F.max(F.least("available", "need")).alias("quota"))
    taken = draw(units, plan, seed).groupBy(*_CATEGORY).agg(F.count("*").alias("taken"))
    return _met(wanted, taken, "left").where("need > coalesce(taken, 0)").select(*_CATEGORY).distinct()


def apportion(size: int, shares: list[int], least: list[int], most: list[int]) -> list[int]:
    """Whole quotas that add up to size, or to the sum of most if that is less: each at least its least as far as most allows, beyond that in
    proportion to shares, and whole by largest remainders, ties by place. If the minima alone exceed size they are cut in proportion."""
    size = min(size, sum(most))
    floor = [min(a, b) for a, b in zip(least, most)]
    if sum(floor) >= size:
        exact = [Fraction(size * f, max(1, sum(floor))) for f in floor]
    else:
        # the level at which quotas max(floor, min(most, level * share)) add up to size: one of finitely many pieces of a growing line
        free = [i for i in range(len(shares)) if most[i] > floor[i]]
        exact = [Fraction(f) for f in floor]
        if sum(shares[i] for i in free) == 0:  # nothing says where the rest should go
            shares = [1] * len(shares)
        at = lambda level: [max(Fraction(floor[i]), min(Fraction(most[i]), level * shares[i])) for i in range(len(shares))]
        edges = sorted({Fraction(x, shares[i]) for i in free if shares[i] for x in (floor[i], most[i])})
        low = max((e for e in edges if sum(at(e)) <= size), default=Fraction(0))
        if sum(at(low)) == size:
            exact = at(low)
        elif any(e > low for e in edges):
            high = min(e for e in edges if e > low)
            a, b = sum(at(low)), sum(at(high))
            exact = at(low + (high - low) * (size - a) / (b - a))
        else:  # categories without a share take what those with one can't
            exact = at(low)
            rest = [i for i in range(len(shares)) if exact[i] < most[i]]
            room = sum(most[i] - exact[i] for i in rest)
            for i in rest:
                exact[i] += (size - a) * (most[i] - exact[i]) / room if (a := sum(at(low))) < size else 0
    whole = [math.floor(x) for x in exact]
    order = sorted(range(len(exact)), key=lambda i: (whole[i] - exact[i], i))
    for i in order[: size - sum(whole)]:
        whole[i] += 1
    return whole


def _plan(units: DataFrame, targets: DataFrame, seed: str) -> tuple[DataFrame, DataFrame]:
    """(single, plan): each question in one category only, by its hash and most likely in one that has few to spare, and for each target
    category what is there then and its quota, the quotas adding up to sample_size."""
    spark = units.sparkSession
    wanted = needs(units, targets).groupBy(*_CATEGORY).agg(
        F.max("available").alias("available"), F.max("need").alias("need"), F.max(F.coalesce("min_rows", F.lit(0))).alias("least"), F.sum(F.coalesce("share_per_10000", F.lit(0))).alias("share"), F.max("sample_size").alias("size")
    )
    wanted = cut(wanted, "wanted")
    # a race of hashes in which a category runs the faster the less of it is to spare; one that needs all it has wins
    part = F.least(F.lit(1.0), F.col("need") / F.col("available"))
    pace = F.greatest(F.lit(1e-9), part / (1.000001 - part))
    entry = F.struct((-F.log(hash_unit(seed + "-one", "question_id", "difficulty", "db_id") + 1e-18) / pace).alias("time"), F.coalesce("db_id", F.lit("")).alias("d"), "difficulty", F.col("db_id").alias("own"))
    single = _met(units, wanted.select(*_CATEGORY, "available", "need")).groupBy("question_id").agg(F.min(entry).alias("x"))
    single = cut(single.select("question_id", F.col("x.own").alias("db_id"), F.col("x.difficulty").alias("difficulty")), "single")
    left = single.groupBy(*_CATEGORY).agg(F.count("*").alias("there"))
    rows = _met(wanted, left, "left").orderBy(*_CATEGORY).collect()  # at most MOST_TARGETS
    there = [r["there"] or 0 for r in rows]
    quota = apportion(max((r["size"] or 0 for r in rows), default=0), [r["share"] for r in rows], [r["least"] for r in rows], there) if rows else []
    plan = spark.createDataFrame(
        [(r["db_id"], r["difficulty"], n, q, r["available"], r["need"], r["share"]) for r, n, q in zip(rows, there, quota)],
        "db_id string, difficulty string, available long, quota long, questions long, need long, share long",
    )
    return single, plan


def quota_sample(records: DataFrame, targets: DataFrame, seed: str = "quota-1") -> DataFrame:
    """(question_id, db_id, difficulty): exactly sample_size different questions, or all that the target categories hold if they are fewer.

    Each category gets its minimum and beyond that its share, the shares scaled so that all quotas add up to sample_size; what a category
    can't give goes to the others in proportion. A question of several categories is drawn in one of them only, most likely in the one that has least to spare. Categories outside
    of the targets are not drawn from. Null db_ids match null targets, null question_ids are never drawn, empty tables give no rows.
    """
    single, plan = _plan(_units(records), targets, seed)
    return draw(single, plan.select(*_CATEGORY, "available", "quota"), seed)


def quota_report(records: DataFrame, targets: DataFrame, seed: str = "quota-1") -> DataFrame:
    """(target_no, db_id, difficulty, available, need, deficit, drawn): drawn is what quota_sample takes of the category, deficit what it lacks of its need."""
    units = _units(records)
    wanted = needs(units, targets)
    _, plan = _plan(units, targets, seed)
    met = _met(wanted, plan.select(*_CATEGORY, F.col("quota").alias("drawn")), "left")
    return met.select("target_no", *_CATEGORY, "available", "need", F.greatest(F.lit(0).cast("long"), F.col("need") - F.col("available")).alias("deficit"), F.coalesce("drawn", F.lit(0)).cast("long").alias("drawn"))
