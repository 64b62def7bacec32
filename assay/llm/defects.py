"""Defective answers: labelling functions for every defect, combined by a label model fitted with expectation-maximization.

Every labelling function votes for (+), against (-) or not at all (0) on one defect. For each defect the model has a share
of defective rows and, for each function, how often it votes each way on defective and on sound rows; both are fitted by EM
on the counts of vote patterns over all rows. Patterns are at most 3 ** functions, so these counts are the only thing the
driver sees. A row gets every label whose posterior exceeds the label's cutoff.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .answers import features

#: Posteriors above which a label is given: near the middle of what choose_cutoffs finds on the labelled answers of tests/llm/test_llm.py; judged there on others.
CUTOFFS = {"empty": 0.5, "other_language": 0.5, "copied_question": 0.5, "truncated": 0.5, "refusal": 0.5}
#: Of several labels the one of greatest posterior is the main one; posteriors that differ by less than 0.1 count as equal, then the first here is.
ORDER = ("empty", "copied_question", "other_language", "truncated", "refusal")

#: Rows' worth of weight that an assumed accuracy has against what EM finds for a function, on defective and on sound rows each.
PRIOR = 1000.0

_FLAGS = ["empty", "full", "statement", "foreign_script", "declines", "tail_open", "sql_word"]
_NUMBERS = ["closed", "ends", "names", "words", "english", "foreign"]
_SCHEMA = pa.schema(
    [("candidate_id", pa.int64()), ("idx", pa.int64()), *((f, pa.bool_()) for f in _FLAGS), *((n, pa.int32()) for n in _NUMBERS), ("stop_reason", pa.string()), ("tokens", pa.int32()), ("said", pa.list_(pa.string()))]
)
_TYPES = "candidate_id long, idx long, " + ", ".join(f"{f} boolean" for f in _FLAGS) + ", " + ", ".join(f"{n} int" for n in _NUMBERS) + ", stop_reason string, tokens int, said array<string>"
_WORD = re.compile(r"\w+")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, idx, text, pred, gold, stop, tokens = (c.to_pylist() for c in batch.columns)
        rows = [features(*x) for x in zip(text, pred, gold)]
        # only an answer without a statement can be a copy of its question
        said = [None if r["full"] or r["empty"] else sorted(set(_WORD.findall(t.lower()))) for r, t in zip(rows, text)]
        columns = [ids, idx, *([r[f] for r in rows] for f in _FLAGS + _NUMBERS), stop, tokens, said]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SCHEMA.types)], schema=_SCHEMA)


def _vote(yes: Column | None, no: Column | None) -> Column:
    out = F.lit("0")
    if no is not None:
        out = F.when(no, F.lit("-")).otherwise(out)
    return out if yes is None else F.when(yes, F.lit("+")).otherwise(out)


def labelling_functions() -> dict[str, list[tuple[Column, float]]]:
    """For each defect its functions' votes and the first guess of how often each is right when it votes."""
    c = F.col
    silent = ~c("full") & ~c("empty")  # an answer that says something, but gives no statement
    copy = silent & (c("given") >= 0.75)
    mute = silent & (~c("statement") | copy)
    english = (c("english") > c("foreign")) | ((c("foreign") == 0) & ~c("foreign_script"))
    foreign = c("foreign_script") | ((c("words") >= 4) & (c("foreign") > c("english")))
    few = c("english") < 0.08 * c("words")
    no_sql, has_sql = ~c("sql_word"), c("sql_word")
    raw = c("statement") & (c("closed") == 0)  # nothing but the statement's own end tells whether it is finished
    talk = (mute | (c("closed") > 0)) & ~copy & ~foreign & ~c("empty")  # where the text's end is English prose
    return {
        "empty": [
            (_vote(c("empty"), ~c("empty")), 0.999),
            (_vote(no_sql & (c("words") == 0), has_sql | (c("words") > 0)), 0.9),
            (_vote(c("tokens") <= 12, c("tokens") > 60), 0.6),
        ],
        "copied_question": [
            (_vote(copy, ~silent | (c("given") < 0.6)), 0.999),
            (_vote(silent & (c("own") >= 0.5), ~silent | (c("own") < 0.2)), 0.9),
            (_vote(no_sql, has_sql), 0.7),
        ],
        "other_language": [
            # what letters or function words say, and how little English there is
            (_vote(foreign, english & (c("words") >= 4)), 0.999),
            (_vote((c("words") >= 4) & few, c("english") > 0.2 * c("words")), 0.9),
        ],
        "truncated": [
            (_vote((c("closed") < 0) & ~copy & ~c("empty"), c("closed") > 0), 0.999),
            (_vote(raw & ~copy & (c("ends") < 0), raw & c("full") & (c("ends") > 0)), 0.999),
            (_vote(talk & c("tail_open"), talk & ~c("tail_open") & (c("closed") >= 0)), 0.999),
            (_vote(raw & (c("names") < 0), None), 0.8),
            (_vote(c("stop_reason") == "max_new_tokens", c("stop_reason") == "finished"), 0.6),
            (_vote(None, c("empty") | copy), 0.999),
        ],
        "refusal": [
            (_vote(mute & c("declines") & ~copy, c("full") | c("empty")), 0.95),
            (_vote(mute & ~copy & english & ~c("tail_open") & (c("closed") >= 0), ~mute | copy | c("tail_open") | (c("closed") < 0)), 0.995),
            (_vote(mute & (c("given") < 0.5), ~mute | copy), 0.95),
            (_vote(no_sql, has_sql), 0.7),
            (_vote(None, foreign), 0.995),
        ],
    }


def fit(patterns: dict[str, int], right: list[float], rounds: int = 200, prior: float = PRIOR) -> dict[str, float]:
    """Posterior of the defect for each pattern of votes, by EM from the functions' assumed accuracies.

    A function has a rate of being right on defective and one on sound rows, of the rows it votes on: votes count as independent given
    the class, and not voting says nothing. In each round the rates are drawn to the assumed accuracy as if prior rows had shown it, so that a
    function that seldom votes isn't turned round by its own few votes; where there are many rows, what they say prevails.
    """
    unvoted = {k: 0.0 for k in patterns if not k.strip("0")}  # nothing speaks for a defect there, and they tell nothing about its share
    keys = sorted(k for k in patterns if k not in unvoted)
    if not keys:
        return unvoted
    n = np.array([patterns[k] for k in keys], float)
    votes = np.array([["-0+".index(v) - 1 for v in k] for k in keys])
    plus, minus = (votes > 0).astype(float), (votes < 0).astype(float)
    guess = np.array(right)
    on_defective, on_sound, share = guess.copy(), guess.copy(), 0.03
    post = np.zeros(len(keys))
    for _ in range(rounds):
        odds = np.log(share / (1 - share)) + plus @ np.log(on_defective / (1 - on_sound)) + minus @ np.log((1 - on_defective) / on_sound)
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        moved = float(np.abs(new - post).max())
        post = new
        share = float(np.clip((n * post).sum() / n.sum(), 1e-5, 0.5))
        for weight, good, bad, rate in ((n * post, plus, minus, on_defective), (n * (1 - post), minus, plus, on_sound)):
            cast = weight @ (good + bad)
            held = prior + 1
            rate[:] = np.clip((weight @ good + guess * held) / (cast + held), 0.5, 0.9999)
        if moved < 1e-9:
            break
    return unvoted | dict(zip(keys, post.tolist()))


def choose_cutoffs(posteriors: list[tuple[int, str, float]], truth: dict[int, str | None], steps: int = 20) -> dict[str, float]:
    """For each defect the cutoff of most F1 on labelled answers, the middle of all that reach it; posteriors are (candidate_id, defect, posterior)."""
    out = {}
    for d in ORDER:
        known = {k: p for k, e, p in posteriors if e == d}
        scores = []
        for step in range(1, steps):
            given = {k for k, p in known.items() if p > step / steps}
            right = sum(truth.get(k) == d for k in given)
            scores.append(2 * right / max(1, len(given) + sum(v == d for v in truth.values())))
        best = [i for i, x in enumerate(scores, 1) if x >= max(scores) - 1e-12]
        out[d] = best[len(best) // 2] / steps
    return out


def answer_features(answers: DataFrame, questions: DataFrame, hot_rows: int = 10_000) -> DataFrame:
    """What the functions vote on, one row for each answer; given: the greatest part of a question's words that the answer has, own: the part of the answer's
    words that are that question's. Both are null where the answer has a statement, or no text, or no question is known."""
    source = answers.select(
        F.col("candidate_id").cast("long"), F.col("idx").cast("long"), "prediction_text", "pred_sql", "gold_sql", "stop_reason", F.col("completion_token_count").cast("int")
    )
    read = cut(source.mapInArrow(_read, _TYPES), "read")
    silent = read.where("said is not null").select("candidate_id", "idx", "said")
    # one question may have a third of all answers: answers of such, at most a thousand, are dealt over salts, for each of which the few wordings are repeated
    counts = cut(silent.where("idx is not null").groupBy("idx").agg(F.count("*").alias("n")), "counts")
    many = max(hot_rows, silent.count() // 1000)
    salts = F.ceil(F.col("n") / many).cast("int")
    hot = counts.where(F.col("n") > many).select("idx", salts.alias("salts"))
    dealt = silent.join(F.broadcast(hot), "idx", "left").withColumn("salt", F.pmod(F.xxhash64("candidate_id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    named = questions.where("question_id is not null and question is not null").select(F.col("question_id").cast("long").alias("idx"), "question").join(counts, "idx").distinct()
    asked = named.select("idx", "n", F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("asked")).where(F.size("asked") > 0)
    asked = asked.select("idx", "asked", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > many, salts).otherwise(1) - 1)).alias("salt"))
    common = F.size(F.array_intersect("said", "asked"))
    met = dealt.join(asked, ["idx", "salt"]).select("candidate_id", (common / F.size("asked")).alias("given"), (common / F.greatest(F.lit(1), F.size("said"))).alias("own"))
    best = met.groupBy("candidate_id").agg(F.max("given").alias("given"), F.max_by("own", "given").alias("own"))
    # only answers that may be copies meet the questions' words; the many others are not shuffled for them
    spoken = read.where("said is null").drop("said").select("*", F.lit(None).cast("double").alias("given"), F.lit(None).cast("double").alias("own"))
    return spoken.unionByName(read.where("said is not null").drop("said").join(best, "candidate_id", "left"))


def posteriors(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """(candidate_id, defect, posterior) of every answer and defect whose posterior exceeds 0.05."""
    spark = answers.sparkSession
    functions = labelling_functions()
    base = answer_features(answers, questions)
    voted = cut(base.select("candidate_id", *[F.concat(*[F.coalesce(v, F.lit("0")) for v, _ in fs]).alias(d) for d, fs in functions.items()]), "votes")
    out: DataFrame | None = None
    counts: dict[str, dict[str, int]] = {d: {} for d in functions}
    long = voted.select(F.explode(F.array(*[F.struct(F.lit(d).alias("defect"), F.col(d).alias("votes")) for d in functions])).alias("x"))
    for row in long.groupBy("x.defect", "x.votes").count().collect():  # at most 3 ** functions rows a defect
        counts[row["defect"]][row["votes"]] = row["count"]
    table = [(d, k, p) for d, fs in functions.items() for k, p in fit(counts[d], [a for _, a in fs]).items() if p > 0.05]
    likely = spark.createDataFrame(table, "defect string, votes string, posterior double")
    out = voted.select("candidate_id", F.explode(F.array(*[F.struct(F.lit(d).alias("defect"), F.col(d).alias("votes")) for d in functions])).alias("x"))
    return out.select("candidate_id", "x.defect", "x.votes").join(F.broadcast(likely), ["defect", "votes"]).select("candidate_id", "defect", "posterior")


def labels(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """(candidate_id, defect, posterior): every label above its cutoff; an answer may have several.

    Null and blank answers are empty ones; a null idx or an idx without question can't be a copy. Extra columns aren't read.
    """
    cutoff = F.create_map(*[x for d, v in CUTOFFS.items() for x in (F.lit(d), F.lit(v))])
    return posteriors(answers, questions).where(F.col("posterior") > cutoff[F.col("defect")]).distinct()


def main_labels(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """(candidate_id, defect): each defective answer with its main label."""
    place = F.create_map(*[x for i, d in enumerate(ORDER) for x in (F.lit(d), F.lit(i))])
    rank = Window.partitionBy("candidate_id").orderBy(F.desc(F.floor(F.col("posterior") * 10)), place[F.col("defect")])
    return labels(answers, questions).withColumn("rank", F.row_number().over(rank)).where("rank = 1").select("candidate_id", "defect")
