"""A sample that stays the same as data grows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import hash_unit

#: Sampling rates by stratum, and that of all others. stored_rates keeps them from ever being lowered.
RATES = {"simple": 0.1, "moderate": 0.15, "challenging": 0.25, "unknown": 0.2}
OTHERS = 0.1


def stored_rates(records: DataFrame, folder: str, rates: dict[str, float], salt: str = "sample-1") -> dict[str, float]:
    """The rates of the sample kept in folder, raised to rates. Raises ValueError, and changes nothing, if one would be lowered.

    The folder holds a small table of (salt, stratum, rate), one row a stratum; each call that raises a rate adds rows, so the earlier
    ones stay on record. A stratum that rates doesn't name keeps its rate.
    """
    spark = records.sparkSession
    try:
        kept = {r["stratum"]: r["rate"] for r in spark.read.parquet(folder).where(F.col("salt") == salt).groupBy("stratum").agg(F.max("rate").alias("rate")).collect()}
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        kept = {}
    lower = {s: (kept[s], r) for s, r in rates.items() if r < kept.get(s, 0.0)}
    if lower:
        raise ValueError(f"rates may only be raised: {lower}")
    new = [(salt, s, float(r)) for s, r in rates.items() if r > kept.get(s, -1.0)]
    if new:
        spark.createDataFrame(new, "salt string, stratum string, rate double").coalesce(1).write.mode("append").parquet(folder)
    return kept | rates


def stable_sample(records: DataFrame, rates: dict[str, float] = RATES, salt: str = "sample-1", default_rate: float = OTHERS) -> DataFrame:
    """(question_id, stratum): one row for each question drawn, the same for any order and partitioning of the rows.

    A record's stratum is its difficulty (lower case, without surrounding blanks, empty and null as 'unknown'). A question is drawn
    if the salted hash of its question_id is below the greatest rate of the strata in which it has a record; that stratum is shown, of
    equal rates the first by name. A record that comes later, whatever its loaded_at, record_id or difficulty, can add a stratum but takes
    none away, and a raised rate lets more in: members stay in both cases. Null question_ids are never drawn; an empty table gives no rows.
    """
    level = F.lower(F.trim(F.col("difficulty")))
    stratum = F.when(F.coalesce(level, F.lit("")) == "", F.lit("unknown")).otherwise(level)
    rate = F.lit(default_rate)
    for name, value in rates.items():
        rate = F.when(F.col("stratum") == name, F.lit(float(value))).otherwise(rate)
    units = records.where("question_id is not null").select("question_id", stratum.alias("stratum")).withColumn("rate", rate)
    # rates are few, so the greatest and its first stratum come from one map-side combined aggregation
    best = units.groupBy("question_id").agg(F.min(F.struct((-F.col("rate")).alias("r"), F.col("stratum").alias("s"))).alias("best"))
    return best.where(hash_unit(salt, "question_id") < -F.col("best.r")).select("question_id", F.col("best.s").alias("stratum"))
