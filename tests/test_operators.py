"""Small fixtures of the engine's operators."""

import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assay.operators import candidates as ops
from assay.operators import compare, dataset, profile, search
from assay.operators.failures import failure_labels
from assay.plans.service import QueryService, match_column
from assay.sources import catalog, records


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("db")
    spark.createDataFrame([(1, "Alice", 30), (2, "Bob", 40), (3, "Carol", 25)], "id bigint, name string, age int").write.parquet(f"{path}/users.parquet")
    return str(path)


def test_service(spark, folder):
    s = QueryService(spark, folder)
    gold = "SELECT name FROM users WHERE age > 30"
    assert s.query(gold)["rows"] == [["Bob"]]
    assert s.query("SELECT nme FROM users")["error"] == "column_not_found"
    assert s.query("SELECT x FROM nowhere")["error"] == "table_not_found"
    assert s.query("SELEC name FROM users")["error"] == "invalid_sql"
    assert s.query("SELECT name FROM users WHERE")["error"] == "syntax_error"
    assert s.query("SELECT 1; SELECT 2")["error"] == "invalid_sql"
    assert s.query("SELECT name FROM users WHERE age > 90")["warning"] == "no rows"
    assert s.query("SELECT id FROM users", max_rows=3)["truncated"] and not s.query("SELECT id FROM users", max_rows=4)["truncated"]
    pairs = spark.createDataFrame([(1, "SELECT name FROM users WHERE age > 30", gold), (2, "SELECT name FROM users WHERE age > 20", gold), (3, "SELECT nope FROM users", gold)], "id int, pred_sql string, gold_sql string")
    more = [(4, gold, "SELECT nope FROM users"), (5, None, gold), (6, "SELECT 1.0 * age FROM users WHERE id = 1", "SELECT age FROM users WHERE id = 1"), (7, "SELECT '30' FROM users", "SELECT age FROM users WHERE id = 1"), (8, "SELECT id, age FROM users WHERE id > 9", "SELECT id FROM users WHERE id > 9"), (9, "SELECT id FROM users WHERE id > 9", gold)]
    got = {r["id"]: (r["ran"], r["gold_ran"], r["equal"], r["status"].split(":")[0]) for r in s.evaluate(pairs.union(spark.createDataFrame(more, pairs.schema))).collect()}
    assert got == {
        1: (True, True, True, "ok"), 2: (True, True, False, "ok"), 3: (False, True, False, "pred_error"), 4: (True, False, False, "gold_error"), 5: (False, True, False, "pred_error"), 6: (True, True, True, "ok"),
        7: (True, True, False, "ok"), 8: (True, True, True, "ok"), 9: (True, True, False, "ok"),
    }
    both = s.compared("SELECT nope FROM users", "DELETE FROM users")
    assert both["status"].startswith("pred_error: ") and "; gold_error: " in both["status"]
    assert s.query("SELECT name AS use, age AS merge FROM users WHERE id = 1")["rows"] == [["Alice", 30]]
    assert s.query("WITH x AS (SELECT 1) INSERT INTO users SELECT * FROM x")["error"] == "invalid_sql"


def test_service_keeps_few_results_and_no_timeouts(spark, folder, monkeypatch):
    from assay.plans import service

    monkeypatch.setattr(service, "MEMO", 2)
    s = QueryService(spark, folder)
    for n in range(4):
        s.query(f"SELECT {n} AS n FROM users")
    assert len(s._ran) == 2
    slow = "SELECT count(*) FROM users a, users b, range(3000000) x, range(20000) y WHERE x.id * y.id % 7 = 3"
    assert s.query(slow, timeout_s=0.5)["error"] == "timeout" and not any(k[0] == slow for k in s._ran)
    assert s.query("SELECT count(*) AS n FROM users")["rows"] == [[3]]
    assert s.peek("users", ["Name", "agee"]).count() == 2
    assert catalog.resolve(spark, "users", [folder]) == "" and catalog.table_names(spark, folder) == ["users"]


def test_match_column():
    columns = ["T-BIL", "CreaionDate", "HGB", "NSLP Provision Status"]
    assert [match_column(c, columns) for c in ("t_bil", "CreationDate", "HBG", "nslp_provision_status", "zzz", "")] == ["T-BIL", "CreaionDate", "HGB", "NSLP Provision Status", None, None]


def test_profile_of_long_texts(spark):
    """Texts that differ behind 10,000 characters are different values, with their own lengths."""
    df = spark.createDataFrame([("x" * 12_000 + end,) for end in ("a", "b", "b", "cc")], "note string")
    r = profile.column_profile(df).first()
    assert (r["distinct_count"], r["len_min"], r["len_max"], r["len_mean"], r["text_max"][-2:]) == (3, 12_001, 12_002, 12_001.25, "cc")
    assert [(x["value"][-1], x["n"]) for x in profile.top_values(df).orderBy("place").collect()] == [("b", 2), ("a", 1), ("c", 1)]
    assert "Distinct: 3" in profile.schema_text(df, "demo")


def test_profile(spark):
    long = "L" * 60
    data = [(1, "2024-01-02", long), (1, "2024-01-02", long), (1, "2024-01-02", long), (2, "2024-01-01", "s"), (2, "2024-01-01", "s"), (3, "2024-01-03", "medium")]
    df = spark.createDataFrame(data, "num int, day string, note string")
    p = {r["column_name"]: r for r in profile.column_profile(df).collect()}
    assert [p[c]["kind"] for c in ("num", "day", "note")] == ["NUMERIC", "DATE", "TEXT"]
    assert p["num"]["num_median"] == 1.5 and p["num"]["distinct_count"] == 3
    text = profile.schema_text(df, "demo")
    assert "Top values: [1, 2, 3]" in text and "Top values: [2024-01-02, 2024-01-01, 2024-01-03]" in text and "L" * 47 + "..." in text
    assert profile.column_profile(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None,), (None,)], "a string")
    r = profile.column_profile(nulls).first()
    assert (r["row_count"], r["non_null"], r["kind"]) == (2, 0, "TEXT")


def test_compare(spark):
    a = spark.createDataFrame([(1, "A"), (2, "B"), (2, "B")], "x int, y string")
    b = spark.createDataFrame([(2.0, "B"), (1.0, "A")], "p double, q string")
    assert compare.same_set(a, b) and not compare.differences(a, b, multiset=True).first()["equal"]
    assert compare.same_normalised(spark.createDataFrame([(" A ",)], "x string"), spark.createDataFrame([("a",)], "y string"))
    assert compare.same_set(a.limit(0), b.select("p").limit(0)) and not compare.same_set(a, b.select("p"))
    assert compare.same_set(spark.createDataFrame([(None, 1)], "a string, b int"), spark.createDataFrame([(None, 1)], "a string, b int"))
    cell = lambda x: spark.sql(f"SELECT {x} AS x")
    for x, y, same in (("1", "1.0D", True), ("1", "'1.0'", False), ("9007199254740993", "9007199254740992", False), ("1e-7D", "0", False), ("true", "1", True), ("2.50", "2.5D", True), ("'a'", "'A'", False), ("NULL", "''", False), ("double('nan')", "double('nan')", True), ("1e300D", "1e300D", True), ("X'41'", "'A'", False)):
        assert compare.same_set(cell(x), cell(y)) is same, (x, y)
    assert compare.same_normalised(cell("1.0000001D"), cell("1")) and compare.same_normalised(cell("X'41'"), cell("' a '"))
    sign = lambda df: compare.set_signature(df).first()["signature"]
    assert sign(a) == sign(b) == sign(a.orderBy("y").union(a)) and sign(a) != sign(a.where("x = 1")) and sign(a.limit(0)) == compare.EMPTY == sign(b.select("p").limit(0))
    shape = compare.shape(a)
    assert (shape["columns"], shape["row_count"], shape["distinct_count"], len(shape["sample"])) == (["x", "y"], 3, 2, 3) and compare.shape_signature({"error": "no"}) == "ERROR:no" and "B" in compare.shape_signature(shape)
    assert compare.any_value(a) and not compare.any_value(spark.createDataFrame([(" ", None)], "a string, b int"))


def test_votes_and_pass(spark):
    df = spark.createDataFrame(
        [(7, 0, "", True, False, 0), (7, 1, "x", True, True, 1), (7, 2, "x", True, True, 1), (7, 3, "z", False, False, 0), (8, 0, "y", False, False, 0), (9, 0, "bb", True, True, 0), (9, 1, "a", True, True, 1)],
        "idx int, sample_id int, pred_sql string, ok boolean, some boolean, correct int",
    )
    votes = ops.majority_vote(df, "pred_sql", F.col("ok"), F.col("some"))
    got = {r["idx"]: (r["winner"], r["votes"], r["voting"], r["ignored"]) for r in votes.collect()}
    assert got == {7: (1, 2, 2, 1), 8: (None, 0, 0, 0), 9: (0, 1, 2, 0)}
    assert tuple(ops.vote_summary(votes, df).first()) == (3, 2, 1, 1, 3, 4, 1, 100 / 3)
    assert ops.vote_summary(votes.limit(0), df).first()["accuracy"] == 0.0
    import math

    for n, c, k in [(16, 3, 4), (5, 5, 2), (5, 0, 2), (4, 3, 2), (1, 1, 1), (3, 1, 0)]:
        want = 0.0 if k <= 0 or c <= 0 else 1.0 if n - c < k else 1 - math.comb(n - c, k) / math.comb(n, k)
        got = spark.range(1).select(ops.pass_at_k(F.lit(n), F.lit(c), F.lit(k)).alias("x")).first()["x"]
        assert abs(got - want) < 1e-12


def test_histograms_keep_every_prompt(spark):
    df = spark.createDataFrame([(1, i, 1, True) for i in range(12)] + [(2, i, i % 2, i < 3) for i in range(4)] + [(3, 0, None, None)], "idx int, sample_id int, correct int, pred_executed boolean")
    got = {r["num_correct"]: r["prompts"] for r in ops.correct_histogram(df, 8).collect()}
    assert got == {**dict.fromkeys(range(9), 0), 0: 1, 2: 1, 12: 1}
    probe = ops.heterogeneity_probe(df, 4).first()
    assert (probe["prompts"], probe["all_correct"], probe["none_correct"], probe["heterogeneous"], probe["over_samples"]) == (3, 1, 1, 1, 1)
    assert probe["correct_histogram"] == [1, 0, 1, 0, 0] and probe["executed_histogram"] == [1, 0, 0, 1, 0] and ops.heterogeneity_probe(df.limit(0), 2).first()["candidate_accuracy"] == 0.0


def test_rewards(spark):
    gold = "SELECT name FROM users WHERE age > 30"
    tagged = "<scratch_pad>x</scratch_pad><final_answer><sql_code>{}</sql_code></final_answer>"
    rows = [(1, tagged.format(gold), gold, gold, True, True, True), (2, "SELECT", "SELECT age FROM people", gold, True, False, False), (3, None, None, gold, None, None, None), (4, "w " * 200, gold, None, False, True, True)]
    df = spark.createDataFrame(rows, "id int, completion string, pred_sql string, gold_sql string, ran boolean, equal boolean, any_value boolean")
    got = {r["id"]: tuple(r[c] for c in ops.REWARDS) for r in ops.rewards(df, 100, 20).collect()}
    assert got == {1: (1, 1, 1, 1, 1, 1, 0), 2: (0, 1, 0, 0, 0.5, 0, 0), 3: (0, 0, 0, 0, 0, 0, 0), 4: (0, 0, 0, 0, 0, 0, -1)}
    best = ops.rewards(df, 100, 20).where("id = 1").select(ops.weighted_reward()).first()[0]
    assert abs(best - 3.8) < 1e-9 and ops.rewards(df.limit(0), 100, 20).count() == 0


def test_what_if_rewards(spark):
    """Rewards of made-up answers, from a sound one to none at all: each step loses what it should."""
    gold = "SELECT name FROM users WHERE age > 30"
    tagged = "<scratch_pad>x</scratch_pad><final_answer><sql_code>{}</sql_code></final_answer>"
    cases = [("right", tagged.format(gold), gold, True, True, True), ("bare", gold, gold, True, True, True), ("wrong rows", tagged.format("SELECT name FROM users"), "SELECT name FROM users", True, False, True), ("empty", tagged.format(gold), gold, True, False, False), ("broken", "SELEC", "SELEC", False, False, False)]
    df = spark.createDataFrame([(c[0], c[1], c[2], gold, *c[3:]) for c in cases], "name string, completion string, pred_sql string, gold_sql string, ran boolean, equal boolean, any_value boolean")
    got = {r["name"]: round(r["w"], 3) for r in ops.rewards(df, 100, 20).select("name", ops.weighted_reward().alias("w")).collect()}
    assert got == {"right": 3.8, "bare": 3.6, "wrong rows": 1.55, "empty": 1.7, "broken": 0.0}


def test_all_wrong(spark):
    rows = [(1, 0, "a", 0, True, None, ["q", "p"], "finished"), (1, 1, "b", 0, False, "no such x\nmore", None, "max"), (1, 2, "b", None, False, "no such x", None, None), (1, 3, None, 0, False, "no such y", [], "max"), (2, 0, "a", 1, True, None, None, "finished")]
    df = spark.createDataFrame(rows, "idx int, sample_id int, pred_sql string, correct int, pred_executed boolean, pred_error string, tool_order array<string>, stop_reason string")
    (r,) = ops.all_wrong(df, 2).collect()
    pairs = lambda c: [(x["value"], x["n"]) for x in r[c]]
    assert (r["idx"], r["n"], r["distinct_sql"], r["executed"]) == (1, 4, 3, 1) and pairs("top_queries") == [("b", 2), ("a", 1)]
    assert pairs("errors") == [("no such x", 2), ("no such y", 1)] and pairs("tools") == [("<none>", 3), ("q -> p", 1)] and pairs("stops") == [("max", 2), ("finished", 1), ("unknown", 1)]


def test_iterative_oversample(spark):
    make = lambda rows: spark.createDataFrame(rows, "g string, r double")
    first, second, third = make([("a", 1.0), ("a", 0.0), ("b", 1.0), ("b", 1.0)]), make([("a", 0.0), ("a", 1.0), ("c", 0.0), ("c", 1.0)]), make([("d", 0.0), ("e", 0.0), ("e", 1.0)])
    show = lambda df: [(r["g"], r["round"], r["slot"], r["is_padded"]) for r in df.orderBy("slot").collect()]
    assert show(ops.iterative_oversample([first, second, third], "g", "r", 2)) == [("a", 0, 1, False), ("c", 1, 2, False)]
    assert show(ops.iterative_oversample([first, second, third], "g", "r", 4)) == [("a", 0, 1, False), ("c", 1, 2, False), ("e", 2, 3, False), ("d", 2, 4, True)]
    with pytest.raises(ValueError):
        ops.iterative_oversample([], "g", "r", 1)


def test_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 1.0), ("b", 1.0), ("c", 0.0)], "g string, r double")
    assert tuple(ops.reward_buckets(df, "g", "r").first()) == (3, 1, 1, 1)
    assert [(r["g"], r["slot"], r["is_padded"]) for r in ops.oversample_filter(df, "g", "r", 2).orderBy("slot").collect()] == [("a", 1, False), ("b", 2, True)]
    adv = {(r["g"], r["r"]): round(r["advantage"], 3) for r in ops.advantages(df, "g", "r").collect()}
    assert adv["c", 0.0] == 0.0 and adv["a", 1.0] == round(0.5 / (0.5**0.5 + 1e-4), 3)
    with pytest.raises(ValueError):
        ops.weighted_reward(("a",), (1.0, 2.0))
    assert ops.accuracy_by(df.limit(0), F.col("g"), F.col("r"), ops.LEVELS).count() == 3


def test_shards_and_queue(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "k int")
    got = ops.round_robin(df, "k", 2).groupBy("shard").agg(F.sort_array(F.collect_list("k")).alias("ks")).orderBy("shard").collect()
    assert [r["ks"] for r in got] == [[0, 2, 4], [1, 3]]
    assert [r["k"] for r in ops.replicate(df.limit(2), 3).orderBy("k", "rollout").collect()] == [0, 0, 0, 1, 1, 1]
    assert ops.tail_draw(8, 0, 1, 0, 3) == [7, 6, 5] and ops.tail_draw(8, 1, 1, 0, 3) == [4, 3, 2]
    assert ops.tail_draws(8, 1, 3, 3) == [(0, [[7, 6, 5]]), (0, [[4, 3, 2]]), (1, [[7, 6, 5]])] and ops.tail_draws(0, 2, 1, 1) == [(0, [[], []])]
    assert ops.tail_draws(20, 6, 2, 1)[0][1][1] == [17, 16] and ops.tail_draws(2, 1, 3, 1) == [(0, [[1, 0, 1]])]
    orders = [tuple(r["k"] for r in ops.queue_order(df, "k", turn).orderBy("ordinal").collect()) for turn in (0, 1, 0)]
    assert orders[0] == orders[2] and sorted(orders[0]) == sorted(orders[1]) == list(range(5))
    assert [ops.tail_draw(20, p, 6, 0, 2) for p in (0, 1)] == [[19, 18], [7, 6]] and ops.tail_draw(20, 0, 6, 1, 2) == [17, 16]


def test_failures(spark):
    rows = [(1, 0, "a", 0, False, True, "no such column: x\nmore", "finished"), (1, 1, "a", 0, False, True, "no such column: y", "max_new_tokens"), (2, 0, "b", 1, True, True, None, "finished")]
    df = spark.createDataFrame(rows, "idx int, sample_id int, pred_sql string, correct int, pred_executed boolean, gold_executed boolean, pred_error string, stop_reason string")
    got = failure_labels(df).collect()
    assert [(r["idx"], r["labels"]) for r in got] == [(1, ["all_pred_sql_execution_failed", "hit_max_new_tokens", "schema_column_error", "low_diversity_repeated_wrong_sql"])]


def test_failures_by_priority(spark):
    from assay.operators.failures import by_priority

    rows = [(1, ["x"], 3, 2), (2, ["gold_sql_execution_failed"], 0, 1), (3, ["strong_consensus_wrong_result"], 8, 1), (4, ["x"], 5, 4), (5, ["x"], 5, 1), (6, [], 0, 0)]
    df = spark.createDataFrame(rows, "idx int, labels array<string>, executed int, texts int")
    assert [r["idx"] for r in by_priority(df).collect()] == [2, 3, 5, 4, 1, 6] and by_priority(df, 2).count() == 2
    assert profile.first_values(spark.createDataFrame([(None,), ("a",), ("b",)], "v string").coalesce(1), "v", 1).collect()[0]["value"] == "a"


def test_dataset(spark):
    df = spark.createDataFrame([(1, "", "SELECT 1", None, None), (2, None, None, "x", "h")], "id int, gold_sql string, query string, database string, hint string")
    got = {r["id"]: (r["gold_sql"], r["db_id"], r["evidence"]) for r in dataset.normalised(df).collect()}
    assert got == {1: ("SELECT 1", "", ""), 2: ("", "x", "h")}
    with pytest.raises(ValueError, match="id 1, 2"):
        dataset.validate(dataset.normalised(df), ["db_id", "gold_sql"], "id")
    ids = lambda *x: F.array(*map(F.lit, x))
    row = spark.range(1).select(dataset.is_cut_off(ids(10, 11, 12), 3, [1, 0]).alias("a"), dataset.is_cut_off(ids(10, 11, 1), 3, [1, 0]).alias("b"), dataset.padded(ids(1), 3, 0).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == (True, False, [1, 0, 0])
    kept, skipped = dataset.by_length(spark.createDataFrame([(10,), (30,), (None,)], "n int"), F.col("n"), 20)
    assert (kept.count(), skipped.count()) == (2, 1)
    a = {r[0] for r in dataset.sample_rows(spark.range(100).repartition(7), "id", 10, 3).collect()}
    assert len(a) == 10 and a == {r[0] for r in dataset.sample_rows(spark.range(100).repartition(2), "id", 10, 3).collect()}
    messages = spark.createDataFrame([([("user", "<db_id>d1</db_id><hint>h1</hint>\nQuestion: q1?\nEvidence: e")], "S")], "messages array<struct<role:string,content:string>>, SQL string")
    r = dataset.normalised(messages).first()
    assert (r["db_id"], r["evidence"], r["question"], r["gold_sql"]) == ("d1", "h1", "q1?", "S")


def test_records(spark, tmp_path):
    path = str(tmp_path / "a.jsonl")
    open(path, "w").write('{"a": 1, "b": "é"}\n\n{"a": 2}\nnot json\n')
    assert [(r["line"], r["text"]) for r in records.malformed_lines(spark, path).collect()] == [(4, "not json")]
    good = str(tmp_path / "b.jsonl")
    open(good, "w").write('{"a": 1, "b": "é"}\n\n{"a": 2}\n')
    assert records.read_records(spark, good, "a int, b string").count() == 2
    one = str(tmp_path / "c.json")
    json.dump([{"a": 1}, {"a": 2}], open(one, "w"))
    df = records.read_records(spark, one)
    assert df.count() == 2
    out = str(tmp_path / "out")
    records.write_jsonl(df, out)
    with pytest.raises(Exception, match="exists"):
        records.write_jsonl(df, out)
    assert records.markdown(df.orderBy("a"), 1) == "| a |\n| --- |\n| 1 |\n| and 1 more |"
    summary = str(tmp_path / "summary.json")
    records.write_json(spark.createDataFrame([(1, "é", None)], "a int, b string, c int"), summary)
    assert open(summary, encoding="utf-8").read() == '[\n  {\n    "a": 1,\n    "b": "é",\n    "c": null\n  }\n]'
    with pytest.raises(FileExistsError):
        records.write_json(df, summary)
    with pytest.raises(ValueError):
        records.write_json(df, summary, overwrite=True, most=1)
    five = spark.range(5)
    assert [r[0] for r in records.selected(five, "id", 2, 1).collect()] == [1, 2] and records.selected(five, "id", -1, 3).count() == 2
    assert records.selected(five, "id", 3, seed=4).collect() == records.selected(five.repartition(3), "id", 3, seed=4).collect()
    with pytest.raises(ValueError, match="5 rows"):
        records.selected(five, "id", 6)
    assert records.default_paths("b", "dev", lambda p: True)["records"] == "b/dev/dev.json" and records.default_paths("b", "dev", lambda p: False)["databases"] == "b/dev_databases"
    with pytest.raises(ValueError, match="3"):
        records.merged_shards(df, spark.createDataFrame([(1,), (3,)], "a long"), "a")


def test_search(spark):
    docs = spark.createDataFrame([(1, "red boat"), (2, "blue boat boat"), (3, ""), (4, None)], "id int, t string")
    asked = spark.createDataFrame([(9, "red red boat")], "q int, s string")
    got = search.ranked(search.bm25(docs, "id", F.col("t"), asked, "q", F.col("s")), docs, "id", asked, "q", 4).orderBy("place").collect()
    assert [r["doc"] for r in got][0] == 1 and len(got) == 4 and {r["doc"] for r in got} == {1, 2, 3, 4}
    values = spark.createDataFrame([("-",), ("=",), ("a-b",), (None,), ("",)], "v string")
    assert [r["value"] for r in search.value_search(values, "v", "-", 5).orderBy("place").collect()] == ["-", "a-b"]
    assert search.value_search(values.limit(0), "v", "word", 5).count() == 0


def test_few_shots_fill_up(spark):
    """Records of other groups fill up with score 0, null groups included; a query takes none of its own group."""
    rows = [(1, "red boat", "a"), (2, "red boat", "b"), (3, "none alike", "a"), (4, "other text", None), (5, "last one", "b")]
    docs = spark.createDataFrame(rows, "id int, t string, g string")
    asked = spark.createDataFrame([(10, "red", "b"), (11, "zzz", None), (12, "boat", "c")], "id int, t string, g string")
    got = {}
    for r in search.few_shots(docs, "id", F.col("t"), asked, "id", F.col("t"), 3, "g").orderBy("place").collect():
        got.setdefault(r["query"], []).append((r["doc"], r["score"] > 0))
    assert got == {10: [(1, True), (3, False), (4, False)], 11: [(1, False), (2, False), (3, False)], 12: [(1, True), (2, True), (3, False)]}


def test_bm25_of_hot_words(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"the word{i % 7} the") for i in range(60)], "id int, t string")
    asked = spark.createDataFrame([(1, "the word3")], "q int, s string")
    score = lambda: sorted((r["doc"], round(r["score"], 9)) for r in search.bm25(docs, "id", F.col("t"), asked, "q", F.col("s")).collect())
    plain = score()
    monkeypatch.setattr(search, "HOT", 5)
    assert score() == plain and len(plain) == 60


def rows_shuffled(spark):
    """Rows written to shuffles so far, by stage."""
    doubles = spark._jvm.java.lang.reflect.Array.newInstance(spark._jvm.java.lang.Double.TYPE, 0)
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, doubles, None)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


@pytest.mark.parametrize("name", ["bm25_search", "bm25_fewshot"])
def test_searches_shuffle_no_pairs(spark, tmp_path, name):
    """Every document shares words with every query; what is shuffled is less than a row for each pair of them."""
    from assay.plans import catalogue

    rows = [(i, f"d{i % 7}", f"the {' '.join(f'w{(i * 7 + j * j) % 50}' for j in range(15))}", None) for i in range(1, 20_001)]
    spark.createDataFrame(rows, "record_id long, db_id string, question string, evidence string").write.parquet(str(tmp_path / "dev_tied_append.parquet"))
    before = rows_shuffled(spark)
    got = catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(got) == 200 * (5 if name == "bm25_search" else 3)
    written = [n for k, n in rows_shuffled(spark).items() if k not in before]
    assert 20_000 <= max(written) < 20_000 * 200 / 10


def bm25_by_hand(docs, asked, k, group, fill):
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    bags = {d: words(t) for d, t, _ in docs}
    n, mean = len(docs), sum(map(len, bags.values())) / len(docs)
    df = Counter(w for b in bags.values() for w in set(b))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    out = {}
    for q, t, own in asked:
        found = []
        for d, _, g in docs:
            tf = Counter(bags[d])
            score = sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(bags[d]) / mean)) for w in words(t) if w in tf)
            if (not group or g != own) and (fill or set(tf) & set(words(t))):
                found.append((-round(score, 4), d))
        out |= {(q, i + 1): (d, -s) for i, (s, d) in enumerate(sorted(found)[:k])}
    return out


@pytest.mark.parametrize("group", [None, "g"])
@pytest.mark.parametrize("fill", [True, False])
@pytest.mark.parametrize("common", [False, True])
def test_best_by_blocks(spark, monkeypatch, group, fill, common):
    """Ties, empty texts, words of every document or of none, negative weights, null groups; blocks of few pairs, few postings and few queries."""
    r = random.Random(5)
    text = lambda: " ".join(r.choices("the of Boat red é 7" if common else [f"w{i * i % 90}" for i in range(60)], k=r.choice([0, 1, 3, 8])))
    docs = [(f"d{i:03}", r.choice([text(), "same text", None, "The the boat"]), r.choice(["a", "b", None])) for i in range(150)]
    asked = [(i, r.choice([text(), "same boat boat", "unheard", "the", None]), r.choice(["a", "b", "c", None])) for i in range(40)]
    want = bm25_by_hand(docs, asked, 4, group, fill)
    frames = spark.createDataFrame(docs, "id string, t string, g string").repartition(3), spark.createDataFrame(asked, "q int, s string, g string")
    for sizes in ({}, {"PAIRS": 100, "POSTINGS": 20, "DENSE": 25, "FIRST": 2}):
        for k, v in sizes.items():
            monkeypatch.setattr(search.nearest, k, v)
        monkeypatch.setattr(search, "AT_ONCE", 15 if sizes else 4096)
        got = search.best(frames[0], "id", F.col("t"), frames[1], "q", F.col("s"), 4, group, fill).collect()
        assert {(x["query"], x["place"]): x["doc"] for x in got} == {at: doc for at, (doc, _) in want.items()}
        assert all(x["score"] == pytest.approx(want[x["query"], x["place"]][1]) for x in got)


def test_few_shots_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "red boat", "a"), (1, "red", "a"), (2, "boat", "b"), *((i, f"sea{i}", "b") for i in range(3, 9))], "id int, t string, g string")
    assert search.repeats(docs, "id") and search.repeats(docs.selectExpr("nullif(id, 2) AS id").where("id IS NULL"), "id") and not search.repeats(docs.where("id = 2"), "id")
    asked = spark.createDataFrame([(5, "red", "c")], "id int, t string, g string")
    got = search.few_shots(docs, "id", F.col("t"), asked, "id", F.col("t"), 2, "g").collect()
    assert [r["doc"] for r in got] == [1, 1]  # both rows of the id


def test_roots(spark, tmp_path):
    assert catalog.roots(["a/", "b"], "b:c::") == ["a", "b", "c"] and catalog.roots(["a"], "b:c", first=False) == ["b", "c", "a"]
    (tmp_path / "databases" / "shop").mkdir(parents=True)
    assert catalog.resolve(spark, "shop", ["/no", str(tmp_path)]).endswith("databases/shop") and catalog.resolve(spark, "other", [str(tmp_path)]) == "" == catalog.resolve(spark, "", [str(tmp_path)])
    assert catalog.resolve(spark, "shop", [str(tmp_path / "databases" / "shop")]).endswith("databases/shop")


def test_released_tables_are_deleted(spark):
    import os

    from assay.plans import lineage

    with lineage.released():
        kept = lineage.cut(spark.range(3))
        assert kept.count() == 3
        path = lineage._written[-1][1]
    assert not os.path.exists(path)


def test_foreign_keys(spark):
    assert catalog.foreign_keys(spark).count() == len(catalog.STAR_KEYS)
