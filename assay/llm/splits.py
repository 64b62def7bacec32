"""Splits that keep records of one database or question together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .components import components
from .ranks import hash_unit, join_counted, running_total

#: A component holding over this part of the smallest target share is placed before all others.
LARGE = 0.1


def same_name(column: str) -> Column:
    """db_id apart from letter case, surrounding blanks and '-', '_' or blank between words."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.col(column), r"^[\s ]+|[\s ]+$", "")), r"[-_\s ]+", "_")


def _keyed(records: DataFrame) -> DataFrame:
    return records.select("record_id", "question_id", "db_id", same_name("db_id").alias("name"))


def bound_names(records: DataFrame) -> DataFrame:
    """(name, component, n) for every name of records (record_id, question_id, db_id) with its records, null names left out. Written."""
    counted = cut(_keyed(records).where("name is not null").groupBy("question_id", "name").agg(F.count("*").alias("n")), "counted")
    # a question's names are bound to its least one: a star for each question, however many records it has
    hub = counted.where("question_id is not null").groupBy("question_id").agg(F.min("name").alias("hub"), F.max("name").alias("top")).where("hub <> top")
    links = counted.join(hub.select("question_id", "hub"), "question_id").where("name <> hub").select("hub", "name").distinct()
    linked = components(links, "hub", "name")
    names = counted.groupBy("name").agg(F.sum("n").alias("n"))
    return cut(names.join(linked.withColumnRenamed("node", "name"), "name", "left").select("name", F.coalesce("component", "name").alias("component"), "n"), "names")


def bound_pairs(records: DataFrame) -> DataFrame:
    """(db_id_a, db_id_b): pairs of stored db_id values whose records must share a split, the smaller by bytes first.

    Null db_ids bind nothing; null question_ids neither. Repeated records change nothing.
    """
    stored = records.where("db_id is not null").select("db_id").distinct().withColumn("name", same_name("db_id"))
    placed = cut(stored.join(bound_names(records), "name").select("db_id", "component"), "placed")
    a, b = placed.select(F.col("db_id").alias("db_id_a"), "component"), placed.select(F.col("db_id").alias("db_id_b"), "component")
    return a.join(b, "component").where("db_id_a < db_id_b").select("db_id_a", "db_id_b")


def grouped_splits(records: DataFrame, targets: DataFrame, seed: str = "split-1") -> DataFrame:
    """(record_id, component, split_name): all records bound by db_id or question_id in one split.

    targets: (split_name, target_share), a few rows. A record without db_id belongs to its question's component, one
    without both is a component of its own. Components are dealt in the order of their salted hash. Those of over LARGE of the smallest
    share, at most 1 / LARGE / that share of them, go first, each to the split with most room; all others fill the room left, one split after
    the other. Empty tables give no rows; null record_ids keep their row; without targets split_name is null.
    """
    shares = [(r["split_name"], float(r["target_share"])) for r in targets.where("split_name is not null and target_share > 0").orderBy("split_name").collect()]
    keyed = _keyed(records)
    names = bound_names(records)
    # records meet their component by name, else by question; keys that hold many records are met by broadcast, null keys not at all
    named = join_counted(keyed.where("name is not null"), names, ["name"]).select("record_id", F.concat(F.lit("d:"), "component").alias("component"))
    nameless = keyed.where("name is null")
    asked = nameless.where("question_id is not null")
    counts = asked.groupBy("question_id").agg(F.count("*").alias("n"))
    first = keyed.where("question_id is not null and name is not null").groupBy("question_id").agg(F.min("name").alias("name"))
    by_question = counts.join(first, "question_id", "left").join(names.select("name", "component"), "name", "left")
    by_question = cut(by_question.select("question_id", "n", F.coalesce(F.concat(F.lit("d:"), "component"), F.concat(F.lit("q:"), F.col("question_id").cast("string"))).alias("component")), "by-question")
    asked = join_counted(asked.select("record_id", "question_id"), by_question, ["question_id"]).select("record_id", "component")
    alone = nameless.where("question_id is null").select("record_id", F.concat(F.lit("r:"), F.coalesce(F.col("record_id").cast("string"), F.lit(""))).alias("component"))
    home = cut(named.unionByName(asked).unionByName(alone), "home")
    sizes = cut(home.groupBy("component").agg(F.count("*").alias("n")).withColumn("u", hash_unit(seed, "component")), "component-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    if not shares or not total:
        return home.select("record_id", "component", F.lit(None).cast("string").alias("split_name"))
    whole = sum(s for _, s in shares)
    least = max(1, int(LARGE * min(s for _, s in shares) / whole * total))
    large = sizes.where(F.col("n") > least).orderBy("u", "component").collect()  # at most whole / (LARGE * smallest share) rows
    room = {name: share / whole * total for name, share in shares}
    fixed = []
    for row in large:
        name = max(room, key=lambda s: (room[s], s))
        room[name] -= row["n"]
        fixed.append((row["component"], name, row["n"]))
    rest = running_total(sizes.where(F.col("n") <= least).withColumn("one", F.lit(1)), ["one"], "u", "component", "n")
    middle = F.col("before") + F.col("n") / 2
    open_total = sum(max(0.0, r) for r in room.values())
    rest_total = total - sum(r["n"] for r in large)
    choice, edge = F.lit(max(room, key=lambda s: room[s])), 0.0
    bounds = []
    for name, _ in shares:
        edge += max(0.0, room[name]) / open_total * rest_total if open_total else 0.0
        bounds.append((name, edge))
    for name, bound in reversed(bounds):
        choice = F.when(middle < F.lit(bound), F.lit(name)).otherwise(choice)
    placed = rest.select("component", choice.alias("split_name"), "n")
    if fixed:
        placed = placed.unionByName(records.sparkSession.createDataFrame(fixed, "component string, split_name string, n long"))
    return join_counted(home, cut(placed, "placed"), ["component"]).select("record_id", "component", "split_name")
