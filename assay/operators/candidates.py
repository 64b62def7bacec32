"""Evaluation of generated answers: accuracy by group, pass@k, votes, heterogeneity, rewards and advantages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col
#: Difficulty levels that a summary always shows, in this order.
LEVELS = ("simple", "moderate", "challenging")
#: Weights of the seven rewards, in the order of REWARDS.
WEIGHTS = (0.2, 0.5, 2.0, 0.5, 0.5, 0.1, 0.1)
REWARDS = ("format_reward", "execution_reward", "result_reward", "table_linking", "column_linking", "nonnull_reward", "length_penalty")


def first_delivery(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each combination of keys, the least by order; rows delivered again are dropped."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def accuracy_by(df: DataFrame, key: Column, correct: Column, fixed: tuple[str, ...] = (), unknown: str = "unknown") -> DataFrame:
    """(grp, place, correct, count, accuracy): in order of place the fixed groups, with zeros where they have no rows, then the others by falling count and name.

    Null and blank keys are the group unknown. accuracy is in percent, 0 for an empty group. The result has a row a group, so ordering it is cheap.
    """
    name = F.when(F.coalesce(F.trim(key), F.lit("")) == "", F.lit(unknown)).otherwise(key)
    seen = df.groupBy(name.alias("grp")).agg(F.sum(F.coalesce(correct.cast("int"), F.lit(0))).alias("correct"), F.count("*").alias("count"))
    shown = df.sparkSession.createDataFrame([(g, i) for i, g in enumerate(fixed)], "grp string, fixed int")
    both = seen.join(F.broadcast(shown), "grp", "full_outer").select("grp", "fixed", F.coalesce("correct", F.lit(0)).alias("correct"), F.coalesce("count", F.lit(0)).alias("count"))
    place = F.row_number().over(Window.orderBy(F.col("fixed").asc_nulls_last(), F.desc("count"), "grp"))
    return both.select("grp", place.alias("place"), "correct", "count", (100.0 * C("correct") / F.greatest(F.lit(1), C("count"))).alias("accuracy"))


def execution_stats(df: DataFrame) -> DataFrame:
    """Nine conditional counts over evaluated candidates in one pass."""
    pred, gold = F.coalesce("pred_executed", F.lit(False)), F.coalesce("gold_executed", F.lit(False))
    has = F.length(F.trim(F.coalesce("pred_sql", F.lit("")))) > 0
    return df.agg(
        F.count("*").alias("n"), F.count_if(has).alias("pred_extracted"), F.count_if(~has).alias("pred_missing"), F.count_if(pred).alias("pred_executed"), F.count_if(~pred).alias("pred_failed"),
        F.count_if(gold).alias("gold_executed"), F.count_if(~gold).alias("gold_failed"), F.count_if(pred & gold).alias("both_executed"), F.count_if(pred & gold & (F.coalesce("correct", F.lit(0)) == 0)).alias("executed_but_wrong"),
    )


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(what, value, n) of each column's values, from one pass: the columns are unpivoted after a partial count by their combination."""
    counted = df.groupBy(*[C(c).cast("string").alias(c) for c in columns]).agg(F.count("*").alias("n"))
    long = counted.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("what"), C(c).alias("value")) for c in columns])).alias("x"))
    return long.groupBy("x.what", "x.value").agg(F.sum("n").alias("n"))


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """The unbiased pass@k, 1 - prod(1 - k / i) over i from n - c + 1 to n; 0 where k or c is 0, 1 where fewer than k are wrong."""
    factor = F.aggregate(F.sequence((n - c + 1).cast("int"), n.cast("int")), F.lit(1.0), lambda acc, i: acc * (1.0 - k / i))
    return F.when((k <= 0) | (c <= 0), F.lit(0.0)).when(n - c < k, F.lit(1.0)).otherwise(1.0 - factor)


def pass_by_prompt(df: DataFrame, idx: str = "idx", sample: str = "sample_id", correct: str = "correct") -> DataFrame:
    """(idx, n, c, first_correct): candidates, correct ones and the least correct sample of every prompt."""
    ok = F.coalesce(C(correct), F.lit(0)) > 0
    return df.groupBy(idx).agg(F.count("*").alias("n"), F.count_if(ok).alias("c"), F.min(F.when(ok, C(sample))).alias("first_correct"))


def pass_summary(prompts: DataFrame, candidates: DataFrame, most: int, idx: str = "idx", sample: str = "sample_id", correct: str = "correct") -> DataFrame:
    """(k, estimated, prefix) for k from 1 to most: means over all prompts, of which those without candidates count as 0.

    estimated is the unbiased pass@k, prefix whether one of the first k samples is correct; k is at most a prompt's candidates.
    """
    ok = F.coalesce(C(correct), F.lit(0)) > 0
    placed = candidates.withColumn("place", F.row_number().over(Window.partitionBy(idx).orderBy(sample)))
    each = placed.groupBy(idx).agg(F.count("*").alias("n"), F.count_if(ok).alias("c"), F.min(F.when(ok, C("place"))).alias("first"))
    met = prompts.select(idx).distinct().join(each, idx, "left")
    k = met.select("n", "c", "first", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k"))
    at = F.least("k", F.coalesce("n", F.lit(0)))
    n, c = F.coalesce("n", F.lit(0)), F.coalesce("c", F.lit(0))
    return k.groupBy("k").agg(F.avg(pass_at_k(n, c, at)).alias("estimated"), F.avg(F.coalesce((C("first") <= at).cast("double"), F.lit(0.0))).alias("prefix"))


def correct_histogram(df: DataFrame, most: int, idx: str = "idx", correct: str = "correct") -> DataFrame:
    """(num_correct, prompts) for 0 to most, zero-filled, and for every greater number that occurs."""
    each = df.groupBy(idx).agg(F.count_if(F.coalesce(C(correct), F.lit(0)) > 0).cast("int").alias("num_correct")).groupBy("num_correct").agg(F.count("*").alias("prompts"))
    every = df.sparkSession.range(most + 1).select(C("id").cast("int").alias("num_correct"))
    return every.join(each, "num_correct", "full_outer").select("num_correct", F.coalesce("prompts", F.lit(0)).cast("long").alias("prompts"))


def pass_report(prompts: DataFrame, candidates: DataFrame, samples: int, idx: str = "idx", correct: str = "correct") -> DataFrame:
    """One row over all prompts and their candidates: how many there are of each, correct and executed ones, finished generations, tool calls a candidate, and
    how many prompts have 0 to samples candidates; prompts with more are counted in over_samples."""
    each = candidates.groupBy(idx).agg(
        F.count("*").alias("n"), F.count_if(F.coalesce(C(correct), F.lit(0)) > 0).alias("c"), F.count_if(F.coalesce("pred_executed", F.lit(False))).alias("x"),
        F.sum(F.coalesce("tool_call_count", F.lit(0))).alias("t"), F.count_if(C("stop_reason") == "finished").alias("f"),
    )
    met = prompts.select(idx).distinct().join(each, idx, "left").na.fill(0, ["n", "c", "x", "t", "f"])
    n = F.greatest(F.lit(1), F.sum("n"))
    return met.agg(
        F.count("*").alias("prompts"), F.count_if(C("n") > 0).alias("with_candidates"), F.sum("n").alias("candidates"), F.sum("c").alias("correct"), (100.0 * F.sum("c") / n).alias("candidate_accuracy"),
        F.count_if(C("c") > 0).alias("any_correct"), F.sum("x").alias("executed"), F.sum("f").alias("finished"), (F.sum("t") / n).alias("mean_tool_calls"),
        F.array(*[F.count_if(C("n") == i) for i in range(samples + 1)]).alias("candidate_histogram"), F.count_if(C("n") > samples).alias("over_samples"),
    )


def heterogeneity_probe(df: DataFrame, samples: int, idx: str = "idx", correct: str = "correct", ran: str = "pred_executed") -> DataFrame:
    """One row over all prompts: how many there are, how many have all, none or some candidates correct, the rates of those, and the histograms
    of correct and of executed candidates as arrays from 0 to samples; prompts with more candidates than that are counted in over_samples besides."""
    each = df.groupBy(idx).agg(F.count("*").alias("n"), F.count_if(F.coalesce(C(correct), F.lit(0)) > 0).alias("c"), F.count_if(F.coalesce(C(ran), F.lit(False))).alias("x"))
    histogram = lambda v: F.array(*[F.count_if(C(v) == i) for i in range(samples + 1)])
    some = (C("c") > 0) & (C("c") < C("n"))
    rate = lambda test: F.coalesce(F.avg(test.cast("double")), F.lit(0.0))
    return each.agg(
        F.count("*").alias("prompts"), F.count_if(C("c") == C("n")).alias("all_correct"), F.count_if(C("c") == 0).alias("none_correct"), F.count_if(some).alias("heterogeneous"),
        rate(some).alias("heterogeneous_rate"), rate(C("c") > 0).alias("any_correct_rate"), F.coalesce(F.try_divide(F.sum("c").cast("double"), F.sum("n")), F.lit(0.0)).alias("candidate_accuracy"),
        histogram("c").alias("correct_histogram"), histogram("x").alias("executed_histogram"), F.count_if(C("n") > samples).alias("over_samples"),
    )


def heterogeneous_prompts(df: DataFrame, idx: str = "idx", correct: str = "correct") -> DataFrame:
    """(idx, n, num_correct, num_wrong) of the prompts with both right and wrong candidates."""
    each = df.groupBy(idx).agg(F.count("*").alias("n"), F.sum(F.coalesce(C(correct), F.lit(0))).alias("num_correct"))
    return each.where("num_correct > 0 and num_correct < n").withColumn("num_wrong", C("n") - C("num_correct"))


def majority_vote(
    df: DataFrame, signature: str, ran: Column, rows: Column | None = None, idx: str = "idx", sample: str = "sample_id", sql: str = "pred_sql"
) -> DataFrame:
    """(idx, winner, votes, voting, ignored): the earliest sample of the largest group of same results; ties go to the earliest group, then the shortest query.

    Candidates that did not run don't vote; those that ran but gave no rows (rows is false) don't either, and are counted as ignored. voting is
    the number of candidates that vote. A prompt without any vote has a null winner and 0 votes.
    """
    ran = F.coalesce(ran, F.lit(False))
    gave = F.lit(True) if rows is None else F.coalesce(rows, F.lit(False))
    flagged = df.withColumns({"_use": ran & gave, "_empty": ran & ~gave})
    groups = flagged.groupBy(idx, F.when(C("_use"), C(signature)).alias("sig"), "_use", "_empty").agg(
        F.count("*").alias("size"), F.min(sample).alias("first"), F.min(F.length(F.coalesce(C(sql), F.lit("")))).alias("short")
    )
    best = F.max_by("first", F.when(C("_use"), F.struct("size", -C("first"), -C("short"))))
    number = lambda test: F.coalesce(F.sum(F.when(C(test), C("size"))), F.lit(0))
    return groups.groupBy(idx).agg(best.alias("winner"), F.coalesce(F.max(F.when(C("_use"), C("size"))), F.lit(0)).alias("votes"), number("_use").alias("voting"), number("_empty").alias("ignored"))


def vote_summary(votes: DataFrame, graded: DataFrame, idx: str = "idx", sample: str = "sample_id", correct: str = "correct") -> DataFrame:
    """One row over the votes of majority_vote: prompts with and without a vote, ignored empty results, votes of winners, voting candidates, and how
    many winners are correct, with the accuracy in percent over all prompts. graded has correct for each (idx, sample)."""
    won = votes.join(graded.select(C(idx), C(sample).alias("winner"), C(correct).alias("_right")), [idx, "winner"], "left")
    right = F.count_if(F.coalesce(C("_right"), F.lit(0)) > 0)
    return won.agg(
        F.count("*").alias("prompts"), F.count("winner").alias("with_vote"), (F.count("*") - F.count("winner")).alias("without_vote"), F.coalesce(F.sum("ignored"), F.lit(0)).alias("ignored"),
        F.coalesce(F.sum("votes"), F.lit(0)).alias("winning_votes"), F.coalesce(F.sum("voting"), F.lit(0)).alias("voting"), right.alias("correct"),
        (100.0 * right / F.greatest(F.lit(1), F.count("*"))).alias("accuracy"),
    )


def rewards(df: DataFrame, most: int, buffer: int, length: Column | None = None) -> DataFrame:
    """df (completion, pred_sql, gold_sql, ran, equal, any_value) with the seven rewards as columns, in the order of REWARDS.

    ran says that the statement ran, equal that its result set is the reference's, any_value that a cell of it is neither null nor blank; null is
    false. The table reward is 1 for the same set of tables as the reference, the column reward the similarity of the sets of columns; both are 0 if
    the reference has none. length is the completion's length, by default its words; it is penalised beyond most - buffer.
    Statements are parsed once for each different text.
    """
    from ..functions import sqltext as tx

    texts = df.select(C("pred_sql").alias("_t")).union(df.select("gold_sql")).where("_t is not null").distinct()
    parsed = texts.select("_t", tx.table_names("_t").alias("_tables"), tx.column_names("_t").alias("_columns"))
    met = df
    for side in ("pred", "gold"):
        met = met.join(parsed.withColumnsRenamed({"_t": f"{side}_sql", "_tables": f"_{side}_tables", "_columns": f"_{side}_columns"}), f"{side}_sql", "left")
    none = F.array().cast("array<string>")
    pt, gt, pc, gc = (F.coalesce(f"_{side}_{what}", none) for what in ("tables", "columns") for side in ("pred", "gold"))
    flag = lambda name: F.coalesce(C(name), F.lit(False)).cast("double")
    shown = met.withColumns(
        {
            "format_reward": tx.follows_format("completion").cast("double"), "execution_reward": flag("ran"), "result_reward": flag("equal") * flag("ran"),
            "table_linking": F.when(F.size(gt) == 0, F.lit(0.0)).otherwise((F.array_sort(pt) == F.array_sort(gt)).cast("double")),
            "column_linking": F.when(F.size(gc) == 0, F.lit(0.0)).otherwise(tx.jaccard(pc, gc)),
            "nonnull_reward": flag("any_value") * flag("ran"),
            "length_penalty": tx.length_penalty(tx.word_count("completion") if length is None else length, most, buffer),
        }
    )
    return shown.select(*df.columns, *REWARDS)


def weighted_reward(rewards: tuple[str, ...] = REWARDS, weights: tuple[float, ...] = WEIGHTS) -> Column:
    """The weighted sum of the rewards; null and NaN rewards add nothing."""
    if len(rewards) != len(weights):
        raise ValueError(f"{len(weights)} weights for {len(rewards)} rewards")
    total = F.lit(0.0)
    for r, w in zip(rewards, weights):
        total = total + F.coalesce(F.nanvl(C(r), F.lit(None).cast("double")), F.lit(0.0)) * w
    return total


def advantages(df: DataFrame, group: str, reward: str, scale: str = "group") -> DataFrame:
    """df with advantage: the reward less its group's mean, over the sample deviation of the group or of the batch plus 1e-4, or as it is (none).

    The deviation of a single row is 0. Only the batch's deviation is a value over all rows; it is one row, and broadcast.
    """
    if scale not in ("group", "batch", "none"):
        raise ValueError(scale)
    w = Window.partitionBy(group)
    centred = C(reward) - F.avg(reward).over(w)
    if scale == "none":
        return df.withColumn("advantage", centred)
    if scale == "group":
        return df.withColumn("advantage", centred / (F.coalesce(F.stddev_samp(reward).over(w), F.lit(0.0)) + 1e-4))
    spread = df.agg(F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("_s"))
    return df.crossJoin(F.broadcast(spread)).withColumn("advantage", centred / (C("_s") + 1e-4)).drop("_s")


def summed_z(df: DataFrame, group: str, rewards: list[str], weights: list[float]) -> DataFrame:
    """df with advantage: each reward's z-score in its group, weighted and added up, then the z-score of that over the batch."""
    w = Window.partitionBy(group)
    total = F.lit(0.0)
    for r, weight in zip(rewards, weights):
        total = total + weight * (C(r) - F.avg(r).over(w)) / (F.coalesce(F.stddev_samp(r).over(w), F.lit(0.0)) + 1e-4)
    summed = df.withColumn("_t", total)
    batch = summed.agg(F.avg("_t").alias("_m"), F.coalesce(F.stddev_samp("_t"), F.lit(0.0)).alias("_s"))
    return summed.crossJoin(F.broadcast(batch)).withColumn("advantage", (C("_t") - C("_m")) / (C("_s") + 1e-4)).drop("_t", "_m", "_s")


def reward_buckets(df: DataFrame, group: str, reward: str) -> DataFrame:
    """How many groups are all correct, all wrong or heterogeneous (population deviation of 1e-6 or more)."""
    each = df.groupBy(group).agg(F.min(reward).alias("lo"), F.max(reward).alias("hi"), F.stddev_pop(reward).alias("sd"))
    return each.agg(F.count("*").alias("groups"), F.count_if(C("lo") >= 1 - 1e-6).alias("all_correct"), F.count_if(C("hi") <= 1e-6).alias("all_wrong"), F.count_if(C("sd") >= 1e-6).alias("heterogeneous"))


def reward_metrics(df: DataFrame, group: str, rewards: list[str]) -> DataFrame:
    """(reward, mean, deviation, zero_spread): NaN and null don't count; zero_spread is the share of groups in which the reward never varies."""
    clean = df.select(group, *[F.nanvl(C(r), F.lit(None).cast("double")).alias(r) for r in rewards])
    long = clean.select(group, F.explode(F.array(*[F.struct(F.lit(r).alias("reward"), C(r).alias("v")) for r in rewards])).alias("x")).select(group, "x.reward", "x.v")
    each = long.groupBy("reward", group).agg(
        F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(C("v") * C("v")).alias("q"), (F.coalesce(F.max("v") - F.min("v"), F.lit(0.0)) < 1e-6).alias("flat")
    )
    n, s, q = F.sum("n"), F.sum("s"), F.sum("q")
    spread = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1))))
    return each.groupBy("reward").agg((s / n).alias("mean"), spread.alias("deviation"), F.avg(C("flat").cast("double")).alias("zero_spread"))


def oversample_filter(df: DataFrame, group: str, reward: str, target: int) -> DataFrame:
    """(group, slot, is_padded): target groups to train on: first the heterogeneous ones in order, then others in order as padding.

    Groups are ranked by their own aggregate rows; the top ones come from a top-k, so no task sorts all groups.
    """
    each = df.groupBy(group).agg((F.coalesce(F.stddev_pop(reward), F.lit(0.0)) >= 1e-6).alias("het"))
    first = each.orderBy(F.desc("het"), group).limit(target)
    return first.select(group, F.row_number().over(Window.orderBy(F.desc("het"), group)).alias("slot"), (~C("het")).alias("is_padded"))


def filter_metrics(df: DataFrame, group: str, reward: str, target: int) -> DataFrame:
    """Attempted, heterogeneous, kept and padded groups with their rates, 0 where nothing was attempted."""
    each = df.groupBy(group).agg((F.coalesce(F.stddev_pop(reward), F.lit(0.0)) >= 1e-6).alias("het"))
    got = each.agg(F.count("*").alias("attempted"), F.count_if("het").alias("heterogeneous"))
    kept = F.least("heterogeneous", F.lit(target))
    rate = F.coalesce(F.try_divide(C("heterogeneous").cast("double"), C("attempted")), F.lit(0.0))
    return got.select("attempted", "heterogeneous", kept.alias("kept"), F.least(F.lit(target) - kept, C("attempted") - C("heterogeneous")).alias("padded"), rate.alias("het_rate"), (kept / float(max(1, target))).alias("fill_rate"))


def iterative_oversample(rounds: list[DataFrame], group: str, reward: str, target: int) -> DataFrame:
    """(group, round, slot, is_padded): target groups from up to len(rounds) draws of candidates, one draw after the other.

    Each round adds its heterogeneous groups, in order, to those of the rounds before, until target are there; later rounds aren't read then.
    What is still missing after the last round is filled with its other groups as padding. A group that was kept isn't kept again.
    """
    kept: DataFrame | None = None
    have, each = 0, None
    for number, drawn in enumerate(rounds):
        each = drawn.groupBy(group).agg((F.coalesce(F.stddev_pop(reward), F.lit(0.0)) >= 1e-6).alias("het")).withColumn("round", F.lit(number))
        if kept is not None:
            each = each.join(kept.select(group), group, "left_anti")
        new = each.where("het").orderBy(group).limit(target - have)  # a top-k: at most target rows
        kept = new if kept is None else kept.unionByName(new)
        have = kept.count()
        if have >= target:
            break
    if kept is None:
        raise ValueError("no rounds")
    padding = each.where("not het").orderBy(group).limit(target - have)
    both = kept.unionByName(padding)
    return both.select(group, "round", F.row_number().over(Window.orderBy(F.desc("het"), "round", group)).alias("slot"), (~C("het")).alias("is_padded"))


def all_wrong(df: DataFrame, top: int = 3) -> DataFrame:
    """(idx, n, distinct_sql, executed, top_queries, errors, tools, stops): prompts without a correct candidate.

    top_queries has the top most frequent queries as (sql, n), the earliest first among equals. errors, tools and stops count the first lines of
    error messages, the orders of tools and the reasons for stopping, each as (value, n), by falling count. Only counts per prompt and value are gathered.
    """
    from ..functions import sqltext as tx

    bad = df.groupBy("idx").agg(F.count_if(F.coalesce("correct", F.lit(0)) > 0).alias("c")).where("c = 0").select("idx")
    rows = df.join(bad, "idx", "left_semi").select(
        "idx", "sample_id", F.coalesce("pred_executed", F.lit(False)).alias("ok"),
        F.explode(F.array(*[F.struct(F.lit(k).alias("what"), v.alias("value")) for k, v in (
            ("sql", F.coalesce("pred_sql", F.lit(""))), ("error", F.element_at(F.split(F.coalesce("pred_error", F.lit("")), "\n"), 1)), ("tool", tx.tool_order("tool_order")), ("stop", F.coalesce("stop_reason", F.lit("unknown"))),
        )])).alias("x"),
    )
    counted = rows.groupBy("idx", "x.what", "x.value").agg(F.count("*").alias("n"), F.count_if("ok").alias("ok"), F.min("sample_id").alias("first"))
    ordered = lambda what, *by: F.transform(F.array_sort(F.collect_list(F.when((C("what") == what) & (C("value") != "" if what == "error" else F.lit(True)), F.struct(*by, "value", "n")))), lambda v: F.struct(v["value"].alias("value"), v["n"].alias("n")))
    fall = (-C("n")).alias("o")
    return counted.groupBy("idx").agg(
        F.sum(F.when(C("what") == "sql", C("n"))).alias("n"), F.count_if(C("what") == "sql").alias("distinct_sql"), F.sum(F.when(C("what") == "sql", C("ok"))).alias("executed"),
        F.slice(ordered("sql", fall, C("first").alias("p")), 1, top).alias("top_queries"), ordered("error", fall).alias("errors"), ordered("tool", fall).alias("tools"), ordered("stop", fall).alias("stops"),
    )


def round_robin(df: DataFrame, order: str, shards: int) -> DataFrame:
    """df with ordinal (from 0) and shard = ordinal % shards. Ordinals of a whole table come from ranges, not from one sorted task."""
    return ordinals(df, order).withColumn("shard", (C("ordinal") % shards).cast("int"))


def ordinals(df: DataFrame, order: str) -> DataFrame:
    """df with ordinal: each row's place by order, which must be unique. A range partitioning, counts by partition, and a place within each."""
    ranged = df.repartitionByRange(C(order)).withColumn("_p", F.spark_partition_id())
    inner = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(order)))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_c"), F.min(order).alias("_o"))
    starts = sizes.withColumn("_s", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inner.join(F.broadcast(starts.select("_p", "_s")), "_p").withColumn("ordinal", C("_s") + C("_n") - 1).drop("_p", "_n", "_s")


def replicate(df: DataFrame, times: int) -> DataFrame:
    """Every row times times, numbered by rollout from 0."""
    return df.withColumn("rollout", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def queue_order(pool: DataFrame, key: str, turn: int, seed: int = 42) -> DataFrame:
    """(key, ordinal): the pool's order in its turn-th pass, by a hash of the key that is salted with seed + 1000 * turn + 17: fixed values."""
    salted = pool.select(key).withColumn("_u", F.md5(F.concat_ws(":", F.lit(str(seed + 1000 * turn + 17)), C(key).cast("string"))))
    placed = ordinals(salted.withColumn("_o", F.struct("_u", key)), "_o")
    return placed.select(key, "ordinal")


def tail_draws(pool: int, ranks: int, k: int, draws: int) -> list[tuple[int, list[list[int]]]]:
    """For each draw the pass it is made in and each rank's ordinals, read from the tail of the queue towards its head.

    A draw takes ranks * k rows. Where fewer are left the queue is shuffled anew for the next pass, whose rows are drawn from its tail; a
    pool smaller than one draw is gone round as often as needed.
    """
    out, turn, left = [], 0, pool
    for _ in range(draws):
        if pool <= 0:
            out.append((turn, [[] for _ in range(ranks)]))
            continue
        if left < ranks * k and left < pool:
            turn, left = turn + 1, pool
        taken = [(left - 1 - i) % pool for i in range(ranks * k)]
        left = max(0, left - ranks * k)
        out.append((turn, [taken[r * k : (r + 1) * k] for r in range(ranks)]))
    return out


def tail_draw(pool: int, passes: int, ranks: int, rank: int, k: int, cursor: int = 0) -> list[int]:
    """Ordinals that rank draws from the tail of a queue of pool rows: with passes draws behind it, its slice of the next ranks * k."""
    start = pool - cursor - passes * ranks * k - rank * k
    return [i for i in range(start - 1, start - 1 - k, -1) if i >= 0]
