"""The training-data operators on small fixtures: brute force, round trips, labelled cases, dirty rows."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from assay.llm import answers, canonical, components, defects, encode, forest, mixing, pii, queries, quota, splits, stable

CLASH = "id long, form string, u double, slot int, before long, n long, component string, label string, words string, key long"


def clashing(df):
    """df with null columns named as the operators name their own."""
    return df.select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in CLASH.split(", ") if c.split()[0] not in df.columns])


# --- 1: defective answers -------------------------------------------------------------------------------------------

QUESTION = "How many ferries are there for which the home port equals Varholm and the tonnage exceeds 4000?"
GOLD = "SELECT COUNT(boat_id) FROM boats WHERE home_port = 'Varholm' AND tonnage > 4000"
ANSWERS = [
    ("", "empty"), (None, "empty"), (" ​\n", "empty"), ("```sql\n```", "empty"), ("<final_answer>\n<sql_code> ; </sql_code></final_answer>", "empty"), ("...", "empty"),
    ("SELECT COUNT(boat_id) FROM boats WHERE home_port = 'Var", "truncated"), ("SELECT COUNT(boat_id) FROM boats WHERE home_port = 'Varholm' AND", "truncated"), ("```sql\nSELECT COUNT(boat_id) FROM boats", "truncated"),
    ("<scratch_pad>The key is clear.</scratch_pad>\n<final_answer>\n<sql_code>\nSELECT COUNT(boat_id) FROM bo", "truncated"), ("The tables share a key. Dates are stored as text in ISO order, so comparison wo", "truncated"),
    ("The query is:\n\nSELECT T2.boat_id FROM boats AS T1", "truncated"), ("SELECT a FROM boats ORDER BY", "truncated"),
    ("I'm sorry, but I can't help with this request.", "refusal"), ("Request declined.", "refusal"), ("<final_answer>I would rather not answer this.</final_answer>", "refusal"), ("That is not a task I take on.", "refusal"),
    (QUESTION, "copied_question"), (f"Question: {QUESTION}\nHint: home port refers to home_port", "copied_question"), (QUESTION.lower().replace("?", "."), "copied_question"), (f"{QUESTION} {QUESTION}", "copied_question"),
    ("Die Frage verlangt die Zeilen aus boats, die alle Bedingungen erfüllen. Ich verknüpfe die Tabellen.", "other_language"), ("Сначала отбор, потом подсчёт, и в конце остаётся только нужный столбец.", "other_language"),
    (f"Primero se filtra, después se cuenta y al final queda solo la columna pedida.\n```sql\n{GOLD}\n```", "other_language"), ("先过滤，再计数，最后只保留所要求的列。", "other_language"),
    (GOLD, None), (f"```sql\n{GOLD};\n```", None), (f"I can't use a row limit here since ties count:\n\n{GOLD}", None), (f"You asked: {QUESTION}\nAnswer:\n```sql\n{GOLD}\n```", None),
    (f"The stored value is '未分類', which the filter must match as written.\n```sql\n{GOLD}\n```\n", None), (f"<scratch_pad>First I map the hint.</scratch_pad>\n<final_answer>\n<sql_code>\n{GOLD}\n</sql_code>\n</final_answer>", None),
    ("SELECT boat_id FROM boats LIMIT 3", None), (f"Query:\n\n{GOLD.lower()} order by tonnage desc", None), (f"```sql\n{GOLD}\n```\nNo rows are dropped beyond the stated conditions.", None),
]


#: Answers of other wording than ANSWERS, on which the cutoffs chosen there are judged.
HELD_OUT = [
    ("\u200b\u200b", "empty"), ("<scratch_pad></scratch_pad>", "empty"), ("---\n***", "empty"), ("```\n\n```\n", "empty"), ("?!", "empty"),
    ("SELECT tonnage FROM boats WHERE home_port", "truncated"), ("```sql\nSELECT tonnage FROM boats WHERE home_port = 'Varholm' OR", "truncated"), ("WITH x AS (SELECT boat_id FROM boats WHERE tonnage >", "truncated"), ("Only ferries count here, so the filter on tonnage has to come befo", "truncated"),
    ("<final_answer><sql_code>SELECT COUNT(boat_id) FROM boats WHERE home_port = 'Varholm'", "truncated"), ("SELECT boat_id, COUNT(*) FROM boats GROUP BY", "truncated"), ("SELECT MAX(tonnage", "truncated"),
    ("I am unable to provide that.", "refusal"), ("My guidelines do not permit this.", "refusal"), ("Sorry, no.", "refusal"), ("This is nothing I will write a query for.", "refusal"), ("Please ask a colleague for that one.", "refusal"), ("<final_answer>I must decline to answer.</final_answer>", "refusal"),
    ("So: " + QUESTION, "copied_question"), (QUESTION.upper(), "copied_question"), (f"> {QUESTION}\n", "copied_question"), (QUESTION.replace("How many", "Count how many"), "copied_question"),
    ("On compte les bateaux dont le port est Varholm et on ne garde que les plus lourds.", "other_language"), ("Si contano le barche con il porto di Varholm e poi non resta che la somma.", "other_language"), ("Najpierw filtruję statki, które są w porcie, a potem liczę je dla każdego wiersza.", "other_language"),
    ("Önce limanı Varholm olan gemiler seçilir ve sonra sayılır, bu kadar.", "other_language"), (f"우선 배를 거른 다음 남은 것을 셉니다.\n{GOLD}", "other_language"), (f"Erst werden die Schiffe gefiltert und dann wird gezählt.\n```sql\n{GOLD}\n```", "other_language"),
    (GOLD.lower(), None), (f"Only boats of one port are counted, and both conditions must hold.\n{GOLD};", None), (f"<final_answer><sql_code>{GOLD}</sql_code></final_answer>", None), (f"The port is called 'Порт' in the table.\n```sql\n{GOLD}\n```", None),
    (f"I would not use a join for this, since one table has it all.\n```sql\n{GOLD}\n```", None), ("SELECT " + ", ".join(f"column_{i}" for i in range(1200)) + " FROM boats", None), (f'The note reads "{"w" * 400}".\n{GOLD}', None), ("SELECT COUNT(*) FROM boats ORDER BY tonnage ASC", None),
]


@pytest.fixture(scope="module")
def answered(spark):
    rows = []
    for copy in range(8):  # the label model is fitted on counts
        for i, (text, _) in enumerate(ANSWERS + HELD_OUT):
            sql = None if text is None or not answers.statement_of(text) else text
            rows.append((copy * 100 + i, 7, text, sql, GOLD, "max_new_tokens" if (i + copy) % 5 == 0 else "finished", None if copy == 3 else len(text or "") // 4))
        for i in range(300):
            rows.append((10_000 + copy * 1000 + i, 7, GOLD, GOLD, GOLD, "finished", 30))
    df = spark.createDataFrame(rows, "candidate_id long, idx int, prediction_text string, pred_sql string, gold_sql string, stop_reason string, completion_token_count int")
    return clashing(df), spark.createDataFrame([(7, QUESTION), (7, QUESTION), (8, None), (None, "x")], "question_id long, question string")


def test_defects(answered):
    got = {r["candidate_id"]: r["defect"] for r in defects.main_labels(*answered).collect()}
    wrong = [(ANSWERS[i][0], ANSWERS[i][1], got.get(c * 100 + i)) for c in range(8) for i in range(len(ANSWERS)) if got.get(c * 100 + i) != ANSWERS[i][1]]
    assert not wrong and not [k for k in got if k >= 10_000]


def test_cutoffs_are_validated(answered):
    post = defects.posteriors(*answered).where("candidate_id < 10000").collect()
    for value in (0.2, 0.5, 0.6):
        main: dict[int, tuple] = {}
        for r in post:
            if r["posterior"] > value:
                key = (-int(r["posterior"] * 10), defects.ORDER.index(r["defect"]))
                main[r["candidate_id"]] = min(main.get(r["candidate_id"], (key, r["defect"])), (key, r["defect"]))
        assert all((main.get(c * 100 + i, (0, None))[1]) == ANSWERS[i][1] for c in range(8) for i in range(len(ANSWERS)))


def test_cutoffs_are_chosen_on_one_set_and_judged_on_another(answered):
    """The cutoffs are what ANSWERS give; of HELD_OUT, which they never saw, at least nine in ten labels are right."""
    post = [(r["candidate_id"], r["defect"], r["posterior"]) for r in defects.posteriors(*answered).where("candidate_id < 10000").collect()]
    n, both = len(ANSWERS), ANSWERS + HELD_OUT
    truth = {c * 100 + i: both[i][1] for c in range(8) for i in range(n)}
    chosen = defects.choose_cutoffs([x for x in post if x[0] in truth], truth)
    assert all(abs(chosen[d] - v) <= 0.35 for d, v in defects.CUTOFFS.items()), chosen
    main: dict[int, tuple] = {}
    for k, d, p in post:
        if p > defects.CUTOFFS[d]:
            key = (-int(p * 10), defects.ORDER.index(d))
            main[k] = min(main.get(k, (key, d)), (key, d))
    cases = [(both[i], main.get(c * 100 + i, (0, None))[1]) for c in range(8) for i in range(n, len(both))]
    right = sum(x[1] == got for x, got in cases)
    print(f"held out: {right} of {len(cases)} right", sorted({(x[0][:40], x[1], got) for x, got in cases if x[1] != got}, key=str))
    assert right >= 0.9 * len(cases)


def test_hot_questions_are_salted(answered):
    """The same features whether a question's answers are dealt over salts or not."""
    plain, salted = (defects.answer_features(*answered, hot_rows=n).select("candidate_id", "given", "own").collect() for n in (10_000, 20))
    assert sorted(map(str, plain)) == sorted(map(str, salted)) and any(r["given"] for r in plain)


def test_defects_of_nothing(answered, spark):
    df, questions = answered
    assert defects.main_labels(df.limit(0), questions.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None, None, None)], df.schema[:7])
    assert {r["defect"] for r in defects.main_labels(nulls, questions).collect()} <= {"empty"}
    assert defects.fit({}, []) == {}


# --- 2: splits --------------------------------------------------------------------------------------------------------


def union_find(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("shape", ["random", "path", "star", "pairs", "none"])
def test_components(spark, shape):
    rng = random.Random(3)
    pairs = {
        "random": [(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(120)], "path": [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(40)], "star": [("hub", f"s{i:03d}") for i in range(60)],
        "pairs": [(f"a{i}", f"b{i}") for i in range(30)], "none": [],
    }[shape]
    df = spark.createDataFrame([*pairs, *pairs[:5], (None, "x"), ("x", None), ("y", "y")], "a string, b string")
    got = {r["node"]: r["component"] for r in components.components(df, "a", "b").collect()}
    assert got == union_find([p for p in pairs if p[0] != p[1]])


def test_splits(spark):
    rng = random.Random(5)
    rows = [(i, 1000 + i, "big") for i in range(300)]
    rows += [(300 + i, rng.randrange(2000), rng.choice(["Alpha_One", "alpha one ", "ALPHA-ONE", "beta", "gamma", None, None, "d%d" % rng.randrange(300)])) for i in range(2000)]
    rows += [(5000, None, None), (None, 1000, "big"), (300, rows[300][1], rows[300][2])]
    df = clashing(spark.createDataFrame(rows, "record_id long, question_id long, db_id string"))
    name = lambda v: re.sub(r"[-_\s]+", "_", v.strip().lower())
    links = [(("q", q), ("d", name(d))) for _, q, d in rows if q is not None and d is not None]
    comp = union_find([*links, *((("d", name(d)), ("d", name(d))) for _, _, d in rows if d is not None)])
    stored = sorted({d for _, _, d in rows if d is not None})
    want = {(a, b) for a, b in itertools.combinations(stored, 2) if comp[("d", name(a))] == comp[("d", name(b))]}
    assert {tuple(r) for r in splits.bound_pairs(df).collect()} == want
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, target_share double")
    got = splits.grouped_splits(df, targets).collect()
    assert len(got) == len(rows) and all(r["split_name"] for r in got)
    home = {}
    for r in got:
        assert home.setdefault(r["component"], r["split_name"]) == r["split_name"]
    again = {(r["record_id"], r["split_name"]) for r in splits.grouped_splits(df.repartition(5), targets).collect()}
    assert again == {(r["record_id"], r["split_name"]) for r in got}
    assert splits.grouped_splits(df.limit(0), targets).count() == 0 and splits.bound_pairs(df.limit(0)).count() == 0


def test_split_shares(spark):
    df = spark.range(5000).select(F.col("id").alias("record_id"), F.col("id").alias("question_id"), F.concat(F.lit("d"), (F.col("id") % 400).cast("string")).alias("db_id"))
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, target_share double")
    got = {r["split_name"]: r["count"] / 5000 for r in splits.grouped_splits(df, targets).groupBy("split_name").count().collect()}
    assert all(abs(got[s] - t) < 0.01 for s, t in (("train", 0.8), ("validation", 0.1), ("test", 0.1)))


# --- 3: a stable sample -------------------------------------------------------------------------------------------------


def test_stable_sample(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(1500), rng.choice(["simple", " SIMPLE", "moderate", "", None]), f"2024-01-{1 + i * 28 // 3000:02d} 00:00:00") for i in range(3000)]
    rows += [(9001, None, "simple", None), (9002, 5, None, None)]
    df = clashing(spark.createDataFrame(rows, "record_id long, question_id long, difficulty string, loaded string").withColumn("loaded_at", F.to_timestamp("loaded")))
    whole = {tuple(r) for r in stable.stable_sample(df).collect()}
    assert whole == {tuple(r) for r in stable.stable_sample(df.orderBy(F.rand(3)).repartition(9)).collect()}
    early = {r["question_id"] for r in stable.stable_sample(df.where("loaded_at < '2024-01-15'")).collect()}
    assert early and early <= {q for q, _ in whole} and len({q for q, _ in whole}) == len(whole)
    raised = {r["question_id"] for r in stable.stable_sample(df, {k: min(1.0, v * 2) for k, v in stable.RATES.items()}).collect()}
    assert {q for q, _ in whole} <= raised
    assert stable.stable_sample(df.limit(0)).count() == 0


def test_stable_sample_keeps_members_of_any_stratum(spark):
    """First records without loaded_at, later ones with lower record_ids or other strata: no member is dropped."""
    rng = random.Random(4)
    levels = ["simple", "moderate", "challenging", "unknown", "rare", None]
    first = [(1000 + q, q, rng.choice(levels)) for q in range(1000)]
    later = [(q, q, rng.choice(levels)) for q in range(0, 1000, 2)]
    schema = "record_id long, question_id long, difficulty string"
    before, after = ({r["question_id"] for r in stable.stable_sample(spark.createDataFrame(x, schema)).collect()} for x in (first, first + later))
    assert before and before <= after and len(after) > len(before)


def test_rates_are_only_raised(spark, tmp_path):
    df, folder = spark.range(1), str(tmp_path / "rates")
    assert stable.stored_rates(df, folder, {"simple": 0.1, "hard": 0.2}) == {"simple": 0.1, "hard": 0.2}
    assert stable.stored_rates(df, folder, {"simple": 0.3}) == {"simple": 0.3, "hard": 0.2}
    with pytest.raises(ValueError):
        stable.stored_rates(df, folder, {"simple": 0.4, "hard": 0.1})
    assert stable.stored_rates(df, folder, {}) == {"simple": 0.3, "hard": 0.2} and stable.stored_rates(df, folder, {"hard": 0.1}, salt="other") == {"hard": 0.1}


# --- 4: near-duplicates --------------------------------------------------------------------------------------------------


def near_data(seed=2, bases=60):
    rng = random.Random(seed)
    frame = [f"frame{i}" for i in range(25)]
    rows, key = [], 0
    for _ in range(bases):
        words = frame + [f"w{rng.randrange(10**6)}" for _ in range(20)]
        for _ in range(rng.choice([1, 1, 2, 5])):
            edited = words[:]
            for _ in range(rng.randrange(9)):
                edited[rng.randrange(len(edited))] = f"w{rng.randrange(10**6)}"
            cut = rng.randrange(5, 40)
            rows.append((key, " ".join(edited[:cut]).upper(), None if rng.random() < 0.1 else " ".join(edited[cut:]), rng.choice(["", None, "select"])))
            key += 1
    return rows + [(key, None, None, None), (key + 1, "", " ", "?!"), (key + 2, "only", None, None), (key + 3, "ONLY.", None, None), (None, "only", None, None)]


def near_truth(rows):
    sets = {k: set(re.findall(r"\w+", " ".join(x or "" for x in rest).lower())) for k, *rest in rows if k is not None}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])}


def test_near_pairs(spark):
    rows = near_data()
    df = clashing(spark.createDataFrame(rows, "record_id long, question string, evidence string, sql_text string"))
    got = {tuple(r) for r in forest.near_pairs(df, "record_id", ["question", "evidence", "sql_text"]).collect()}
    truth = near_truth(rows)
    assert truth and got == truth
    groups = {r["record_id"]: r["group_id"] for r in forest.near_groups(df, "record_id", ["question", "evidence", "sql_text"]).collect()}
    want = union_find([(a, b) for a, b in truth])
    assert all(groups[k] == v for k, v in want.items())


def all_pairs(spark, rows, similarity=0.75):
    return {tuple(r) for r in forest.near_pairs(spark.createDataFrame(rows, "record_id long, question string"), "record_id", ["question"], similarity).collect()}


@pytest.mark.parametrize("hot", [4096, 100])
def test_near_pairs_of_one_dense_region(spark, monkeypatch, hot):
    """600 records of 60 common and 10 own words: all 179,700 pairs are exactly at 0.75, in small regions and where every region is large."""
    monkeypatch.setattr(forest, "HOT", hot)
    common = " ".join(f"c{i}" for i in range(60))
    got = all_pairs(spark, [(i, common + "".join(f" o{i}x{k}" for k in range(10))) for i in range(600)])
    assert len(got) >= 0.9999 * 600 * 599 / 2


def test_near_pairs_of_regions_that_are_alike(spark, monkeypatch):
    """Deeper orders don't part records with all but one word in common: they are compared block by block, no link lost."""
    monkeypatch.setattr(forest, "HOT", 20)
    base = [f"b{i}" for i in range(300)]
    assert len(all_pairs(spark, [(i, " ".join([*base, f"v{i}"])) for i in range(90)])) == 90 * 89 // 2


@pytest.mark.parametrize("hot", [4096, 60])
def test_near_pairs_in_a_pattern(spark, monkeypatch, hot):
    """Families within a pattern of question whose records share half of their words: large regions are followed deeper, where each family stays together."""
    monkeypatch.setattr(forest, "HOT", hot)
    rng = random.Random(12)
    frame, rows = [f"f{i}" for i in range(25)], []
    for family in range(150):
        own = [f"w{family}x{k}" for k in range(15)]
        for _ in range(4):
            edited = own[:]
            for k in rng.sample(range(15), 2):
                edited[k] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(frame + edited)))
    truth = near_truth(rows)
    assert len(truth) > 500 and all_pairs(spark, rows) == truth


def test_near_pairs_in_a_family_of_many_edits(spark):
    """Deeper prefixes of a large region split pairs that are just similar enough: 1,000 edits of one record against brute force."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(40)]
    rows = []
    for i in range(1000):
        edited = base[:]
        for k in rng.sample(range(40), 3):
            edited[k] = f"v{i}x{k}"
        rows.append((i, " ".join(edited)))
    got = {tuple(r) for r in forest.near_pairs(spark.createDataFrame(rows, "record_id long, question string"), "record_id", ["question"]).collect()}
    assert got == near_truth(rows)


@pytest.mark.parametrize("similarity", [0.75, 0.5])
def test_near_pairs_of_small_sets_in_hot_regions(spark, monkeypatch, similarity):
    monkeypatch.setattr(forest, "HOT", 3)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.sample("abcdefgh", rng.choice([1, 2, 3, 4, 6])))) for i in range(60)]
    sets = {k: set(x.split()) for k, x in rows}
    truth = {(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}
    assert all_pairs(spark, rows, similarity) == truth


def test_bitmaps_never_rule_out_a_similar_pair(spark):
    """Long, short and very unequal sets; sizes beyond the 16 bits kept for them."""
    rng = random.Random(13)
    for n in (3, 40, 400, 70_000):
        words = [f"w{i}" for i in range(n)]
        other = words[: n - n // 8] + [f"v{i}" for i in range(n // 8)]
        rows = [(0, " ".join(words)), (1, " ".join(rng.sample(other, len(other)))), (2, " ".join(words[: -(-3 * n // 4)])), (3, "none of these")]
        assert all_pairs(spark, rows) == near_truth(rows) and len(near_truth(rows)) >= 2


def test_near_pairs_of_long_and_hot_texts(spark):
    long = " ".join(f"x{i}" for i in range(20_000))
    rows = [(0, long), (1, long + " more"), *[(10 + i, "the same text again") for i in range(40)]]
    got = {tuple(r) for r in forest.near_pairs(spark.createDataFrame(rows, "record_id long, question string"), "record_id", ["question"]).collect()}
    assert (0, 1) in got and len(got) == 1 + 40 * 39 // 2
    assert forest.near_pairs(spark.createDataFrame([], "record_id long, question string"), "record_id", ["question"]).count() == 0


# --- 5: target proportions ------------------------------------------------------------------------------------------------


LEVEL = lambda v: (v or "").strip().lower() or "unknown"
TARGETS = "target_no int, db_id string, difficulty string, share_per_10000 int, min_rows int, sample_size int"


def test_quota_sample(spark):
    rng = random.Random(8)
    rows = [(i, rng.randrange(4000), rng.choice("aaaabc"), rng.choice(["simple", " Simple ", "hard", None, ""])) for i in range(6000)] + [(9999, None, "a", "simple"), (10_000, 77, None, "hard")]
    df = clashing(spark.createDataFrame(rows, "record_id long, question_id long, db_id string, difficulty string"))
    targets = spark.createDataFrame(
        [(1, "a", "simple", 5000, 3, 333), (2, "a", "hard", 1000, 90, 333), (3, "b", "unknown", 1000, 0, 333), (4, "c", "hard", 3000, 9000, 333), (5, "z", "hard", 0, 2, 333), (6, None, "hard", 0, 1, 333)], TARGETS
    )
    have = {}
    for _, q, d, v in rows:
        if q is not None:
            have.setdefault((d, LEVEL(v)), set()).add(q)
    need = {(r["db_id"], r["difficulty"]): max(r["min_rows"], -(-r["share_per_10000"] * r["sample_size"] // 10000)) for r in targets.collect()}
    unmet = {k for k, n in need.items() if n > len(have.get(k, ()))}
    assert {tuple(r) for r in quota.unmet_in_sample(df, targets).collect()} == unmet == {("c", "hard"), ("z", "hard")}
    got = [tuple(r) for r in quota.quota_sample(df, targets).collect()]
    assert len(got) == 333 == len({q for q, _, _ in got}) and all(q in have[d, v] for q, d, v in got)
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in quota.quota_sample(df.repartition(11), targets).collect())
    report = {(r["db_id"], r["difficulty"]): r for r in quota.quota_report(df, targets).collect()}
    assert all(r["drawn"] == sum((d, v) == k for _, d, v in got) and r["deficit"] == max(0, need[k] - len(have.get(k, ()))) for k, r in report.items())
    assert quota.quota_sample(df.limit(0), targets).count() == 0 and quota.unmet_in_sample(df.limit(0), targets).count() == 6
    assert quota.quota_sample(df, targets.limit(0)).count() == 0 and quota.unmet_in_sample(df, targets.limit(0)).count() == 0


def test_quota_shares(spark):
    """Minima are kept, the rest follows the shares, and no question is drawn twice though many have several categories."""
    rows = [(i, i % 5000, "abcd"[(i // 5000 + i) % 4], "simple") for i in range(10_000)] + [(20_000 + i, 6000 + i, "e", "simple") for i in range(30)]
    df = spark.createDataFrame(rows, "record_id long, question_id long, db_id string, difficulty string")
    targets = spark.createDataFrame([(1, "a", "simple", 4000, 0, 1000), (2, "b", "simple", 3000, 0, 1000), (3, "c", "simple", 2000, 0, 1000), (4, "d", "simple", 900, 0, 1000), (5, "e", "simple", 100, 25, 1000)], TARGETS)
    got = quota.quota_sample(df, targets).collect()
    count = {d: sum(r["db_id"] == d for r in got) for d in "abcde"}
    assert len({r["question_id"] for r in got}) == 1000 and count["e"] == 25
    assert all(abs(count[d] - 975 * s / 9900) <= 1 for d, s in zip("abcd", (4000, 3000, 2000, 900)))


def test_apportion():
    assert quota.apportion(10, [5000, 3000, 2000], [0, 0, 6], [100, 100, 100]) == [3, 1, 6] and quota.apportion(10, [9000, 0], [0, 0], [3, 100]) == [3, 7] and quota.apportion(5, [], [], []) == []
    rng = random.Random(3)
    for _ in range(500):
        n, size = rng.randrange(1, 8), rng.randrange(120)
        share, least, most = ([rng.randrange(top) for _ in range(n)] for top in (50, 10, 40))
        got = quota.apportion(size, share, least, most)
        assert sum(got) == min(size, sum(most)) and all(0 <= q <= m for q, m in zip(got, most))
        if sum(map(min, least, most)) <= size:
            assert all(q >= min(a, b) for q, a, b in zip(got, least, most))


@pytest.mark.parametrize("slots", [4096, 3])
def test_draw_is_exact(spark, slots):
    """Whatever the slots; a category that the acceptance left short is filled up."""
    units = spark.range(900).select(F.col("id").alias("question_id"), F.lit("a").alias("db_id"), (F.col("id") % 3).cast("string").alias("difficulty"))
    plan = spark.createDataFrame([("a", "0", 300, 299), ("a", "1", 300, 1), ("a", "2", 300, 120)], "db_id string, difficulty string, available long, quota long")
    got = quota.draw(units, plan, "s", slots).groupBy("difficulty").count().collect()
    assert {r["difficulty"]: r["count"] for r in got} == {"0": 299, "1": 1, "2": 120}


def test_p5_found_judges_the_draw(spark, tmp_path, monkeypatch):
    """The query's rows come from what was drawn; a category of two targets is drawn once, for the larger."""
    df = spark.createDataFrame([(i, i, "ab"[i % 2], "hard") for i in range(400)] + [(900, 900, None, "hard")], "record_id long, question_id long, db_id string, difficulty string")
    targets = spark.createDataFrame([(1, "a", "hard", 0, 50, 9), (2, "a", "hard", 0, 120, 9), (3, "b", "hard", 0, 201, 9), (4, "b", "hard", 0, 7, 9), (5, None, "hard", 0, 2, 9), (6, "z", "easy", 0, 0, 9)], TARGETS)
    df.write.parquet(str(tmp_path / "dev_tied_append.parquet"))
    targets.write.parquet(str(tmp_path / "sample_targets.parquet"))
    found = lambda: {tuple(r) for r in queries.p5_found(spark, str(tmp_path)).collect()}
    assert found() == {("b", "hard"), (None, "hard")}
    plain = quota.draw
    monkeypatch.setattr(quota, "draw", lambda *a: plain(*a).where("db_id = 'b'"))
    assert found() == {("a", "hard"), ("b", "hard"), (None, "hard")}


# --- 6: formatting differences -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("SELECT a, b FROM t", "select  b ,a\nfrom `t` ;", True), ("SELECT DISTINCT a, f(b, c) FROM t", "select distinct f( b,c ), a from t", True), ("SELECT a FROM t WHERE x = 'A-1'", 'select a from t where (x = "a-1")', True),
        ("SELECT a FROM t WHERE x >= 5", "SELECT a FROM t WHERE x > = 5", False), ("SELECT a FROM t WHERE x != 5", "SELECT a FROM t WHERE x <> 5", False), ("SELECT a, b FROM t ORDER BY a, b", "SELECT b, a FROM t ORDER BY b, a", False),
        ("SELECT f(a, b) FROM t", "SELECT f(b, a) FROM t", False), ("WITH x AS (SELECT p, q FROM u) SELECT a, b FROM x", "WITH x AS (SELECT p, q FROM u) SELECT b, a FROM x", True),
        ("WITH x AS (SELECT p, q FROM u) SELECT a FROM x", "WITH x AS (SELECT q, p FROM u) SELECT a FROM x", False), ("SELECT a, (SELECT max(b), c FROM u) FROM t", "SELECT (SELECT max(b), c FROM u), a FROM t", True), ("SELECT a b FROM t", "SELECT a, c FROM t", False),
    ],
)
def test_forms(a, b, same):
    assert (canonical.form_of((a, "x")) == canonical.form_of((b, "x"))) is same
    assert canonical.form_of((a, None)) is None and canonical.form_of((a, " ;. ")) is None


@pytest.mark.parametrize("bucket_rows, most_keys", [(None, 200_000), (3, 20)])
def test_copies(spark, monkeypatch, bucket_rows, most_keys):
    monkeypatch.setattr(canonical, "MOST_KEYS", most_keys)
    rng = random.Random(4)
    style = [str.upper, str.lower, lambda s: s.replace(" ", "\n"), lambda s: s + ";", lambda s: s]
    base = [f"SELECT a{i}, b FROM t{i} WHERE x = {i}" for i in range(60)]
    rows = [(k, rng.choice(style)(rng.choice(base) if rng.random() < 0.6 else base[0]), "select 1") for k in range(600)] + [(700, None, "select 1"), (701, "?", "select 1"), (None, base[1], "select 1"), (5, None, None), (9, base[3], "select 1")]
    df = clashing(spark.createDataFrame(rows, "candidate_id long, pred_sql string, gold_sql string"))
    forms, count = {}, {}
    for k, p, g in rows:
        if k is not None and (f := canonical.form_of((p, g))):
            forms.setdefault(f, set()).add(k)
            count[f] = count.get(f, 0) + 1
    want = {(min(ks), k) for ks in forms.values() for k in ks if k != min(ks)}
    columns = ["pred_sql", "gold_sql"]
    assert {tuple(r) for r in canonical.copies_found(df, "candidate_id", columns, bucket_rows).collect()} == want
    assert sorted(tuple(r) for r in canonical.collapsed(df, "candidate_id", columns, bucket_rows).collect()) == sorted((min(ks), count[f]) for f, ks in forms.items())
    assert canonical.copies_found(df.limit(0), "candidate_id", columns).count() == 0 == canonical.collapsed(df.limit(0), "candidate_id", columns).count()


@pytest.mark.parametrize("burst", [256, 2])
def test_counting_trie(monkeypatch, burst):
    monkeypatch.setattr(canonical.CountingTrie, "BURST", burst)
    rng = random.Random(6)
    keys = [b"select a" + bytes(rng.randrange(3) for _ in range(rng.randrange(9))) for _ in range(3000)] + [b"select a" + bytes([7] * 16)] * 500 + [b"with", b"", b"sel", b"zebra"]
    trie, want = canonical.CountingTrie(), {}
    for i, k in enumerate(keys):
        terminal = trie.add(k, i, 1)
        want[k] = (min(want.get(k, (i, 0))[0], i), want.get(k, (0, 0))[1] + 1)
        assert tuple(terminal) == want[k]
    walked = [(k, (a, b)) for k, a, b in trie.walk()]
    assert dict(walked) == want and len(walked) == len(want)


def test_radix_buckets(spark):
    """Buckets follow the bytes: a long common beginning is one round, forms that end early and forms delivered often stay whole."""
    rng = random.Random(6)
    forms = [b"select count from the same table where " + bytes([97 + rng.randrange(3), 97 + rng.randrange(26), 97 + rng.randrange(26), 97 + rng.randrange(26), 97 + rng.randrange(26)]) for _ in range(2000)] + [b"select", b"selected", b"with x", b"s"] + [b"hot"] * 300
    df = spark.createDataFrame([(bytearray(f),) for f in forms], "form binary").repartition(7)
    got = [(bytes(r["bucket"]), bytes(r["form"])) for r in canonical.radix_buckets(df, 100).collect()]
    assert sorted(f for _, f in got) == sorted(forms) and all(f.startswith(b) for b, f in got)
    buckets, home = {}, {}
    for b, f in got:
        buckets.setdefault(b, []).append(f)
        assert home.setdefault(f, b) == b
    assert all(len(fs) <= 100 or len(set(fs)) == 1 for fs in buckets.values())


# --- 7: encoding ------------------------------------------------------------------------------------------------------------


def test_encoding(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, encode.vocabulary_bytes().splitlines())}
    own = tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", " ", "\n\n", "<|endoftext|>", "don't stop", "ñandú 你好 ​🙂", "a" * 3000, " " * 500 + "x", "SELECT * FROM t WHERE a='b';", "xyz" * 2000, "é", "\r\n\t x", "=" * 700]
    df = clashing(spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, None)], "doc_id long, text string"))
    got = [(r["doc_id"], r["ids"]) for r in encode.encoded(df, "doc_id", "text").collect()]
    assert sorted(got) == sorted([(i, own.encode_ordinary(t or "")) for i, t in enumerate(texts)] + [(0, [])])
    assert all(own.decode(ids) == (texts[i] or "") for i, ids in got)
    assert encode.encoded(df.limit(0), "doc_id", "text").count() == 0


def test_trie_reset(monkeypatch):
    words = [f"word{i} thing{i % 7}" for i in range(500)]
    whole = encode.TrieEncoder(encode.vocabulary_bytes())
    want = [whole.encode([w])[1].tolist() for w in words]
    monkeypatch.setattr(encode, "MOST_NODES", 50)
    small = encode.TrieEncoder(encode.vocabulary_bytes())
    assert [small.encode([w])[1].tolist() for w in words] == want


# --- 8: mixing ---------------------------------------------------------------------------------------------------------------


def test_sainte_lague():
    assert mixing.sainte_lague({"a": 53, "b": 24, "c": 23}, {"a": 99, "b": 99, "c": 99}, 7) == {"a": 3, "b": 2, "c": 2}
    assert mixing.sainte_lague({"a": 0.5, "b": 0.5}, {"a": 2, "b": 99}, 10) == {"a": 2, "b": 8}
    assert mixing.sainte_lague({}, {}, 5) == {} and mixing.sainte_lague({"a": 0.0}, {"a": 5}, 5) == {"a": 0}
    w = {"a": 0.31, "b": 0.07, "c": 0.62}
    plain = {s: 0 for s in w}
    for _ in range(500):
        s = max(sorted(w), key=lambda x: w[x] / (2 * plain[x] + 1))
        plain[s] += 1
    assert mixing.sainte_lague(w, {s: 10**6 for s in w}, 500) == plain


def test_mixing(spark):
    rng = random.Random(9)
    spelled = {"big": ["big", " Big", "BIG"], "small_one": ["small_one", "Small-One", "small one"], "mid": ["mid", "mid."]}
    rows = [(i, " ".join(["word"] * rng.randrange(1, 60)), rng.choice(spelled[rng.choices(["big", "small_one", "mid"], [20, 1, 4])[0]])) for i in range(3000)]
    rows += [(9001, None, "big"), (9002, "", "mid"), (9003, "text", None), (9004, "text", "other"), (9005, "text", "?")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    targets = spark.createDataFrame([("big", 0.5, 1), ("small_one", 0.2, 4), ("mid", 0.25, 2), ("absent", 0.05, 3)], "source_name string, target_weight double, max_repeats int")
    mix, report, by_shard = mixing.mixed(df, targets)
    got = {r["source_name"]: r for r in report.collect()}
    assert got["absent"]["used_tokens"] == 0 and got["absent"]["missing_tokens"] > 0
    for s, w in (("big", 0.5), ("small_one", 0.2), ("mid", 0.25)):
        assert abs(got[s]["actual_share"] - w / 0.95) < 0.01 and got[s]["most_used"] <= got[s]["max_repeats"]
    used = mix.collect()
    assert len({(r["doc_id"], r["shard"]) for r in used}) == len(used) and not {9001, 9002, 9003, 9004, 9005} & {r["doc_id"] for r in used}
    tokens, shard_tokens = {}, {}
    for r in used:
        tokens[r["source_name"]] = tokens.get(r["source_name"], 0) + r["n_tokens"] * r["copies"]
        shard_tokens[r["source_name"], r["shard"]] = shard_tokens.get((r["source_name"], r["shard"]), 0) + r["n_tokens"] * r["copies"]
    assert all(got[s]["used_tokens"] == n for s, n in tokens.items())
    shards = by_shard.collect()
    assert all(r["used_tokens"] == shard_tokens.get((r["source_name"], r["shard"]), 0) for r in shards) and len(shards) == 3 * 8
    # a shard's tokens of a source are its quota but for what documents across block edges make up
    assert all(abs(r["used_tokens"] - r["quota_tokens"]) <= 0.2 * r["quota_tokens"] + 60 for r in shards if r["source_name"] == "big")
    again = mixing.mixed(df.repartition(7), targets)[0].collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in used}
    assert all(x.count() == n for x, n in zip(mixing.mixed(df.limit(0), targets), (0, 4, 0))) and mixing.mixed(df, targets.limit(0))[0].count() == 0


def test_shard_quotas():
    rng = random.Random(2)
    for _ in range(200):
        quota, shards = {s: rng.randrange(40) for s in "abcde"}, rng.randrange(1, 9)
        got = mixing.shard_quotas(quota, shards)
        assert all(sum(got[s, k] for k in range(shards)) == n and max(got[s, k] for k in range(shards)) - min(got[s, k] for k in range(shards)) <= 1 for s, n in quota.items())
        sums = [sum(got[s, k] for s in quota) for k in range(shards)]
        assert max(sums) - min(sums) <= 1


# --- 9: personal information ----------------------------------------------------------------------------------------------------

GIVEN, FAMILY = {"marta", "oren", "lise", "mark", "may"}, {"velborg", "tarnquist", "hill", "green", "dovric"}
PII = [
    ("Send it to oren.velborg+x@mail.port-lab.example before noon.", [("email", "oren.velborg+x@mail.port-lab.example")]),
    ("mailto:marta-v1 AT mail DOT port DOT example opens", [("email", "marta-v1 AT mail DOT port DOT example")]), ("you can write (lise [at] port-lab.example.com) any time", [("email", "lise [at] port-lab.example.com")]),
    ("Pinned driver pkg@4.49.1 and T1@T2, the @retry decorator; looking at it", []), ("Call +49 30 23125 310 if it hangs", [("phone", "+49 30 23125 310")]), ("Phone (404) 555-0170 ext. 12", [("phone", "(404) 555-0170")]),
    ("text me on +12025550152", [("phone", "+12025550152")]), ("ring 030/23125763", [("phone", "030/23125763")]), ("0044-7700-900-587 - leave a message", [("phone", "0044-7700-900-587")]), ("+33 1 99 00 68 26", [("phone", "+33 1 99 00 68 26")]),
    ("Build 555-4967 was skipped. Row 94719372 of 1937 matched. id range 5655-565558, Version 1.81.5839, Offset 8216 8216 92", []), ("the value 41337133786 overflows", []), ("dated 2020-01-05 and 1999-12-31", []),
    ("SSN: 956-00-2726", [("id_number", "956-00-2726")]), ("Passport QQ 63 74 65 A appears", [("id_number", "QQ 63 74 65 A")]), ("my insurance number is 00 429 437 090", [("id_number", "00 429 437 090")]), ("| id card | 9 88 13 99 606 514 75 |", [("id_number", "9 88 13 99 606 514 75")]),
    ("her personal number, 12345678Z, stays", [("id_number", "12345678Z")]), ("The annotator lives at 145b Mabbamouth Court.", [("address", "145b Mabbamouth Court")]), ("Flat 3, 25 Sevstodray St. was it", [("address", "25 Sevstodray St.")]),
    ("wohnt jetzt Tulfewoldgasse 105", [("address", "Tulfewoldgasse 105")]), ("À livrer au 26 bis, chemin de Mirnamouth, Asknosund.", [("address", "26 bis, chemin de Mirnamouth")]), ("vive en Calle Ruvcombe nº 160", [("address", "Calle Ruvcombe nº 160")]),
    ("71 Avenue-type features were kept. Traffic on Obrley Road. About 5877 street segments", []), ("I had lunch with Oren Velborg and we agreed", [("name", "Oren Velborg")]), ("Annotated by Lise R. Tarnquist.", [("name", "Lise R. Tarnquist")]),
    ("owner: Velborg, Marta", [("name", "Velborg, Marta")]), ("According to M. van der Dovric, the join is wrong.", [("name", "M. van der Dovric")]), ("Frau MARTA TARNQUIST-DOVRIC bestätigt das.", [("name", "MARTA TARNQUIST-DOVRIC")]), ("@Oren Velborg please recheck", [("name", "Oren Velborg")]),
    ("Expected Zimwold Hill, got Mabstead Green. Oren is the code name. The Velborg index is rebuilt.", []), (None, []), ("", []), ("  \n", []),
]


@pytest.mark.parametrize("text, want", PII)
def test_pii(text, want):
    finder = pii.Finder(GIVEN, FAMILY)
    assert [(k, text[a:b]) for k, a, b in finder.find(text)] == want
    redacted = finder.redact(text)
    if text:
        for kind, piece in want:
            assert f"[{kind.upper()}]" in redacted and piece not in redacted
        assert len(redacted) == len(text) - sum(len(p) for _, p in want) + sum(len(k) + 2 for k, _ in want)
    else:
        assert redacted == text


#: Hand-written sentences unlike the tables': ordinary mail, notes and records, with what is personal in them.
OTHER_PII = [
    ("Dear team, Lise Tarnquist called twice on Friday; her new number is +44 20 7946 0958.", [("name", "Lise Tarnquist"), ("phone", "+44 20 7946 0958")]),
    ("Please forward the scans to m.velborg@clinic.example and copy lise_t@clinic.example.", [("email", "m.velborg@clinic.example"), ("email", "lise_t@clinic.example")]),
    ("The tenant moved from 14 Larkspur Lane to 9b Old Mill Road last spring.", [("address", "14 Larkspur Lane"), ("address", "9b Old Mill Road")]),
    ("Patient record: SSN 123-45-6789, admitted on 2021-03-04.", [("id_number", "123-45-6789")]), ("Her passport AB1234567 was copied.", [("id_number", "AB1234567")]),
    ("Rufen Sie bitte Herrn Velborg unter 030/5556789 an, er wohnt in der Lindenstraße 12.", [("phone", "030/5556789"), ("address", "Lindenstraße 12")]),
    ("Reach me at oren dot velborg at mail dot example", [("email", "oren dot velborg at mail dot example")]), ("NIF 12345678Z, Calle Mayor 5", [("id_number", "12345678Z"), ("address", "Calle Mayor 5")]),
    ("Il habite 7 rue des Lilas et répond au +33 1 44 55 66 77.", [("address", "7 rue des Lilas"), ("phone", "+33 1 44 55 66 77")]), ("Best regards,\nMarta Dovric", [("name", "Marta Dovric")]), ("-- \nOren Tarnquist\n12 Birch Court", [("name", "Oren Tarnquist"), ("address", "12 Birch Court")]),
    ("We met with Oren R. Velborg and he agreed.", [("name", "Oren R. Velborg")]), ("cc: Dovric, Lise", [("name", "Dovric, Lise")]), ("Reviewed by L. Tarnquist on Monday", [("name", "L. Tarnquist")]),
    ("Order 4471-2289 shipped 2022-01-09 in 3 boxes of 12.5 kg.", []), ("See section 4.2.1 and RFC 2616 for the 404 page.", []), ("Mark the green cells on Hill Street before May ends.", []), ("The value 123456789 overflowed at offset 0x7fff.", []),
    ("Commit 9f3ab21 touches 17 files; build 20210304.2 failed.", []), ("Version 10.4.12-beta of pkg@1.2.3 is pinned.", []), ("Temperatures of -12 to 45 degrees at 1013 hPa", []), ("Total: 1 234 567,89 EUR for 42 units", []),
    ("ISBN 978-3-16-148410-0 is on the shelf.", []), ("Grace periods and will clauses may apply.", []), ("The Court Road index was rebuilt in 12 ms.", []), ("https://example.org/users/1234567/profile?x=1", []),
]


def test_pii_of_other_sentences():
    """Precision and recall on sentences that the patterns and cues were not made on."""
    finder, wanted, got, both = pii.Finder(GIVEN, FAMILY), 0, 0, 0
    for text, want in OTHER_PII:
        found = [(k, text[a:b]) for k, a, b in finder.find(text)]
        wanted, got, both = wanted + len(want), got + len(found), both + len(set(found) & set(want))
        if found != want:
            print("differs:", text, found)
    print(f"precision {both}/{got}, recall {both}/{wanted}")
    assert both >= 0.9 * got and both >= 0.85 * wanted


def test_pii_has_no_windows(monkeypatch):
    """Long parts, many dots and hits at either end: nothing is cut where a stretch ends."""
    finder = pii.Finder(GIVEN, FAMILY)
    found = lambda text: [(k, text[a:b]) for k, a, b in finder.find(text)]
    for n in (10, 200, 2000):
        local, host = "a" * n, " dot ".join(["h" * 8] * (n // 10 + 1))
        for mail in (f"{local} (at) mail dot example", f"x at {host} dot example", f"{' dot '.join(['q'] * n)} [at] mail dot example"):
            assert found(f"write to {mail} today") == [("email", mail)], n
    name = "Oren " + "-".join(["Velborg"] * 40)
    assert found("x " * 100 + f"Annotated by {name}.") == [("name", name)]
    name = "Marta-" + "L" + "i" * 150 + " Velborg"
    assert found("y " * 100 + f"Annotated by {name}.") == [("name", name)]


def test_pii_checks():
    assert pii._luhn("4539578763621486") and not pii._luhn("4539578763621487")
    assert pii._valid("letter23", "12345678Z") and not pii._valid("letter23", "12345678A")
    assert pii._valid("digits15", "2 55 08 14 168 025 38")


def test_pii_frames(spark):
    long = "x " * 60_000 + "write to oren@port.example " + "y " * 60_000
    rows = [(1, "Annotated by Oren Velborg. Annotated by Oren Velborg."), (1, None), (2, long), (None, "ring 030/23125763")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    lexicon = spark.createDataFrame([(w.title(), "given") for w in GIVEN] + [(w.title(), "family") for w in FAMILY] + [(None, None)], "lexeme string, lexeme_kind string")
    assert sorted(map(str, (tuple(r) for r in pii.found(df, lexicon).collect()))) == sorted(map(str, [(1, "name", "Oren Velborg"), (2, "email", "oren@port.example"), (None, "phone", "030/23125763")]))
    out = {r["doc_id"]: r["text"] for r in pii.redacted(df.where("text is not null"), lexicon).collect()}
    assert out[1] == "Annotated by [NAME]. Annotated by [NAME]." and out[2] == long.replace("oren@port.example", "[EMAIL]")
    assert pii.found(df.limit(0), lexicon.limit(0)).count() == 0
