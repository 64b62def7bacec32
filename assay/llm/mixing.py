"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Blocks are dealt to sources by highest quotients, and each source's blocks to shards in turn, which gives an integer quota for every source
and shard before any block is chosen: a source's quotas differ by one block at most between shards, and so do the shards' sums.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .encode import token_counts
from .ranks import hash_unit, running_total


def source_name(column: str) -> Column:
    """A source apart from letter case, spacing and punctuation: words joined by '_'; null if nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.col(column)), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    return F.when(plain == "", F.lit(None)).otherwise(plain)


def sainte_lague(weights: dict[str, float], most: dict[str, int], blocks: int) -> dict[str, int]:
    """blocks dealt one by one to the highest quotient weight / (2 * got + 1), ties by name; a source with most blocks gets no more.

    The first quotas are set to the floor of each exact share less one, which the rule surely reaches while no cap binds.
    """
    whole = sum((Fraction(w) for w in weights.values()), Fraction(0))
    got = {s: 0 for s in weights}
    if not whole:
        return got
    if all(most[s] >= blocks * Fraction(w) / whole + len(weights) for s, w in weights.items()):
        got = {s: max(0, int(blocks * Fraction(w) / whole) - len(weights)) for s, w in weights.items()}
    heap = [(-Fraction(w) / (2 * got[s] + 1), s) for s, w in weights.items() if w > 0 and most[s] > got[s]]
    heapq.heapify(heap)
    left = blocks - sum(got.values())
    while left > 0 and heap:
        _, s = heapq.heappop(heap)
        got[s] += 1
        left -= 1
        if got[s] < most[s]:
            heapq.heappush(heap, (-Fraction(weights[s]) / (2 * got[s] + 1), s))
    return got


def shard_quotas(quota: dict[str, int], shards: int) -> dict[tuple[str, int], int]:
    """The blocks of each source and shard: all blocks, laid out source by source, are dealt to the shards in turn."""
    out, at = {}, 0
    for s in sorted(quota):
        for shard in range(shards):
            first = (shard - at) % shards
            out[s, shard] = (quota[s] - first + shards - 1) // shards if quota[s] > first else 0
        at += quota[s]
    return out


def _map(values: dict, empty) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))]) if values else F.create_map(F.lit(""), F.lit(empty))


def mixed(
    documents: DataFrame, targets: DataFrame, seed: str = "mix-1", blocks: int = 4000, shards: int = 8, total_tokens: int | None = None, vocabulary_path: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mix, report, by_shard). mix: (doc_id, source_name, n_tokens, shard, copies) of every document used, one row for each shard it is
    in; its copies over all shards are at most its source's max_repeats. report: for each target its weight, tokens there and used, actual
    share, most copies of a document and missing tokens. by_shard: (source_name, shard, quota_blocks, quota_tokens, used_tokens).

    Each source's documents are laid out in order of their salted hash and cut into blocks of as many tokens, total / blocks (fewer and
    larger blocks where that is less than four documents); a document belongs to the block in which its middle lies. The blocks are apportioned to
    sources by Sainte-Lague, at most max_repeats times a source's blocks, and to shards as shard_quotas says. Then blocks
    are chosen: a source's blocks stand in a seeded order, which is gone through again for each further copy; its j-th
    block goes to the shard whose quota the j-th is. The last round ends at the document that reaches the quota's tokens to half a document.

    total_tokens is by default the most that lets every source with documents reach its weight. A source without
    documents gets nothing and its missing tokens are reported; the others keep their weights among each other.
    Documents without source, or of a source without target, are not used; texts without tokens neither. Null weights count as 0.
    """
    spark = documents.sparkSession
    goals = targets.where("source_name is not null").groupBy(source_name("source_name").alias("source")).agg(
        F.first("source_name").alias("source_name"), F.max(F.coalesce("target_weight", F.lit(0.0))).alias("weight"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats")
    )
    goals = {r["source"]: r for r in goals.collect()}  # a small fixed table
    named = documents.select("doc_id", "text", source_name("source").alias("source"))
    counted = token_counts(named.where(F.col("source").isin(list(goals))), "doc_id", "text", ["source"], vocabulary_path)
    sized = cut(counted.where("n_tokens > 0"), "sized")
    held = {r["source"]: (int(r["n"]), r["docs"]) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).collect()}  # one row a target at most
    there = {s: n for s, (n, _) in held.items()}
    live = {s: float(g["weight"]) for s, g in goals.items() if there.get(s) and g["weight"] > 0 and g["max_repeats"] > 0}
    reach = min((there[s] * int(goals[s]["max_repeats"]) / w for s, w in live.items()), default=0)
    total = float(total_tokens if total_tokens is not None else reach * sum(live.values()))
    mean = sum(there[s] for s in live) / max(1, sum(held[s][1] for s in live))
    blocks = max(1, min(blocks, int(total / (4 * max(1.0, mean)))))
    unit = max(1.0, total / blocks)
    count = {s: max(1, round(there[s] / unit)) for s in live}
    quota = sainte_lague(live, {s: count[s] * int(goals[s]["max_repeats"]) for s in live}, blocks)
    per_shard = shard_quotas(quota, shards)
    start, at = {}, 0
    for s in sorted(quota):
        start[s], at = at, at + quota[s]
    laid = sized.where(F.col("source").isin(list(live)) if live else F.lit(False)).withColumn("u", hash_unit(seed, "doc_id"))
    laid = running_total(laid, ["source"], "u", "doc_id", "n_tokens")
    source = F.col("source")
    n_blocks, wanted, tokens, begin = (_map(d, e)[source] for d, e in ((count, 1), (quota, 1), (there, 1), (start, 0)))
    middle = (F.col("before") + F.col("n_tokens") / 2) / tokens
    laid = laid.withColumn("block", F.least(F.floor(middle * n_blocks), n_blocks - 1).cast("long"))
    # a seeded order of all blocks, those without a document too: at most blocks rows and the targets' number, whatever the documents are
    every = spark.createDataFrame([(s, count[s]) for s in live], "source string, n long").select("source", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"))
    order = every.withColumn("turn", F.row_number().over(Window.partitionBy("source").orderBy(hash_unit(seed + "-block", "source", "block"), "block")) - 1)
    chosen = laid.drop("before").join(F.broadcast(order), ["source", "block"]).withColumn("v", F.col("turn") / F.col("n"))
    share = wanted * (tokens / n_blocks)
    rounds = F.floor(wanted / n_blocks).cast("long")
    chosen = running_total(chosen, ["source"], "v", "doc_id", "n_tokens")
    last = F.col("before") + F.col("n_tokens") / 2 <= share - rounds * tokens
    chosen = chosen.withColumn("repeats", rounds + last.cast("long")).where("repeats > 0")
    # the copy made in round r is the block's instance r * n + turn, dealt as the quotas were
    copies = chosen.select("doc_id", source.alias("source_name"), "n_tokens", F.explode(F.transform(F.sequence(F.lit(0), F.col("repeats") - 1), lambda r: F.pmod(begin + r * F.col("n") + F.col("turn"), F.lit(shards)).cast("int"))).alias("shard"))
    mix = cut(copies.groupBy("doc_id", "source_name", "n_tokens", "shard").agg(F.count("*").alias("copies")), "mix")
    per_doc = mix.groupBy("source_name", "doc_id", "n_tokens").agg(F.sum("copies").alias("repeats"))
    used = per_doc.groupBy("source_name").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("used"), F.max("repeats").alias("most_used"))
    frame = spark.createDataFrame(
        [(s, float(g["weight"]), int(g["max_repeats"]), there.get(s, 0), int(round(float(g["weight"]) * (reach if total_tokens is None else total)))) for s, g in goals.items()],
        "source_name string, target_weight double, max_repeats int, there_tokens long, wanted_tokens long",
    )
    whole = mix.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("whole"))
    report = frame.join(used, "source_name", "left").crossJoin(F.broadcast(whole))  # one row
    report = report.select(
        "source_name", "target_weight", "max_repeats", "there_tokens", F.coalesce("used", F.lit(0)).alias("used_tokens"), F.coalesce("most_used", F.lit(0)).alias("most_used"),
        F.coalesce(F.col("used") / F.col("whole"), F.lit(0.0)).alias("actual_share"), F.greatest(F.lit(0), F.col("wanted_tokens") - F.coalesce("used", F.lit(0))).alias("missing_tokens"),
    )
    quotas = spark.createDataFrame([(s, i, n, n * there[s] / count[s]) for (s, i), n in per_shard.items()], "source_name string, shard int, quota_blocks long, quota_tokens double")
    got = mix.groupBy("source_name", "shard").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"))
    by_shard = quotas.join(got, ["source_name", "shard"], "left").select("source_name", "shard", "quota_blocks", "quota_tokens", F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"))
    return mix, report, by_shard
