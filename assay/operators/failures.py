"""Why prompts fail: labels of prompts of which no candidate is right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col
#: From how few or many different queries on diversity counts as low or high, and how many same results are a strong consensus.
LOW, HIGH, CONSENSUS = 2, 8, 8


def failure_labels(df: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """(idx, labels): labels in order for every prompt without a right candidate.

    df holds candidates; shapes, where results were looked at, (idx, pred_columns, pred_rows, gold_columns, gold_rows, consensus) of the most frequent query.
    Two aggregations by prompt; the most frequent error line is found from counts by prompt and line.
    """
    ran, stop = F.coalesce("pred_executed", F.lit(False)), C("stop_reason")
    each = df.groupBy("idx").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("correct", F.lit(0))).alias("right"), F.count_if(ran).alias("ran"), F.min(F.coalesce("gold_executed", F.lit(False))).alias("gold"),
        F.count_distinct(F.coalesce("pred_sql", F.lit(""))).alias("texts"), *[F.count_if(stop == s).alias(s) for s in ("max_tool_rounds", "max_new_tokens", "generation_error")],
    ).where("right = 0")
    line = F.lower(F.element_at(F.split(F.coalesce("pred_error", F.lit("")), "\n"), 1))
    errors = df.where(~ran).groupBy("idx", line.alias("line")).agg(F.count("*").alias("n"))
    top = errors.withColumn("r", F.row_number().over(Window.partitionBy("idx").orderBy(F.desc("n"), "line"))).where("r = 1").select("idx", "line")
    met = each.join(top, "idx", "left")
    met = met.join(shapes, "idx", "left") if shapes is not None else met.select("*", *[F.lit(None).cast("long").alias(c) for c in ("pred_columns", "pred_rows", "gold_columns", "gold_rows", "consensus")])

    def tests() -> dict[str, Column]:
        known = C("pred_columns").isNotNull() & C("gold_columns").isNotNull()
        rows = C("pred_rows").isNotNull() & C("gold_rows").isNotNull()
        return {
            "gold_sql_execution_failed": ~C("gold"),
            "all_pred_sql_execution_failed": C("ran") == 0,
            "some_pred_sql_execution_failed": (C("ran") > 0) & (C("ran") < C("n")),
            "all_pred_sql_executed_but_wrong": C("ran") == C("n"),
            "hit_max_tool_rounds": C("max_tool_rounds") > 0,
            "hit_max_new_tokens": C("max_new_tokens") > 0,
            "generation_error": C("generation_error") > 0,
            "schema_column_error": C("line").contains("no such column"),
            "sql_syntax_or_transcript_extraction_error": C("line").contains("syntax error") & ~C("line").contains("no such column"),
            "unsafe_sql_error": C("line").contains("unsafe") & ~C("line").rlike("no such column|syntax error"),
            "low_diversity_repeated_wrong_sql": C("texts") <= LOW,
            "high_diversity_no_correct_sql": C("texts") >= HIGH,
            "output_column_count_mismatch": known & (C("pred_columns") != C("gold_columns")),
            "row_count_mismatch": rows & (C("pred_rows") != C("gold_rows")),
            "pred_empty_gold_nonempty": rows & (C("pred_rows") == 0) & (C("gold_rows") > 0),
            "pred_nonempty_gold_empty": rows & (C("pred_rows") > 0) & (C("gold_rows") == 0),
            "same_shape_but_wrong_values": known & rows & (C("pred_columns") == C("gold_columns")) & (C("pred_rows") == C("gold_rows")),
            "strong_consensus_wrong_result": C("consensus") >= CONSENSUS,
        }

    return met.select("idx", F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in tests().items()]), lambda v: v.isNotNull()).alias("labels"))


def by_priority(labelled: DataFrame, most: int = 50) -> DataFrame:
    """The failures to look at first, most of them: those of a failed reference statement, then of a strong wrong consensus, then by more executed
    candidates and fewer different statements. labelled holds idx, labels, executed and texts."""
    has = lambda label: F.array_contains("labels", label)
    return labelled.orderBy(F.desc(has("gold_sql_execution_failed")), F.desc(has("strong_consensus_wrong_result")), F.desc("executed"), "texts", "idx").limit(most)
