import random

import pytest
from tests.helpers import plan_of
from pyspark.sql import functions as F

from parlance.operators import cleaning, conversations, keyed, scoring
from parlance.plans import questions


def keyed_rows(spark, step, n=3000):
    rng = random.Random(step)
    rows = [("hot", i * step) for i in range(n)] + [(None, i * 7) for i in range(50)]
    rows += [(f"k{i % 40}", rng.randrange(10**12)) for i in range(400)]
    rows = list(dict.fromkeys(rows))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, at long")


def test_numbering_of_sparse_and_dense_orders(spark):
    for step in (1, 10_000, 10**14):
        rows, df = keyed_rows(spark, step)
        got = {(r["k"], r["at"]): r["n"] for r in keyed.number_within(df, ["k"], "at", "n", hot_rows=64).collect()}
        seen = {}
        for k, at in sorted(rows, key=lambda r: (str(r[0]), r[1])):
            assert got[k, at] == seen.get(k, 0)
            seen[k] = got[k, at] + 1


def test_ranges_hold_so_many_rows_however_sparse(spark):
    rows, df = keyed_rows(spark, 10_000)
    ranges = keyed._ranges(df, ["k"], 64)
    assert ranges == -(-len(rows) // 64) and keyed._ranges(df, ["k"], 3000) == 0 == keyed._ranges(df.limit(0), ["k"], 1)
    sizes = keyed._in_ranges(df, ["k"], "at", ranges).groupBy("_range").count().collect()
    assert max(r["count"] for r in sizes) <= 4 * 64


def test_without_a_hot_key_there_is_one_exchange(spark):
    _, df = keyed_rows(spark, 10_000)
    df = df.withColumn("v", F.col("at") * 2)
    once = keyed.number_within(df, ["k"], "at", "n")
    twice = keyed.previous_within(keyed.previous_within(df, ["k"], "at", "v", "p"), ["k"], "at", "v", "q")
    for found in (once, twice):
        tree = plan_of(found).split("\n\n")[0]
        assert tree.count("Exchange") == 1 and tree.count("Scan") == 1


def test_a_hot_key_is_read_from_storage(spark):
    """At most two scans of the stored rows; the input is not read again."""
    _, df = keyed_rows(spark, 1)
    tree = plan_of(keyed.number_within(df, ["k"], "at", "n", hot_rows=64)).split("\n\n")[0]
    assert tree.count("Scan parquet") <= 2 and tree.count("Scan ExistingRDD") == 0
    assert tree.count("Exchange") <= 4


def test_previous_value_over_blocks(spark):
    rows, df = keyed_rows(spark, 10_000, 500)
    found = keyed.previous_within(df.withColumn("v", F.col("at") + 1), ["k"], "at", "v", "p", hot_rows=16)
    got = {(r["k"], r["at"]): r["p"] for r in found.collect()}
    last = {}
    for k, at in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        assert got[k, at] == last.get(k)
        last[k] = at + 1


def test_measuring_moves_a_row_per_task(spark):
    df = spark.range(1000).withColumn("t", F.lit("abc"))
    assert keyed.fits_broadcast(df) and not keyed.fits_broadcast(df, max_rows=999)
    assert not keyed.fits_broadcast(df, max_bytes=1000 * 19 - 1)


@pytest.mark.parametrize("held", [500_000, 0])
def test_cleaning_shuffles_no_text(spark, monkeypatch, held):
    monkeypatch.setattr(cleaning, "HELD_WORDS", held)
    texts = [f"hello zzq {i % 3}." for i in range(30)] + [None, "", "Hello-zzq zzq'hello hello’s HELLO é zzq"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    lexicon = spark.createDataFrame([("hello", 5.0), ("Hello’s", 3.0), ("zzq", 0.5)], "token string, zipf double")
    stripped = cleaning.strip_gibberish(df, "text", lexicon)
    ratio = cleaning.gibberish_ratio(df, "text", lexicon)
    tokens = cleaning.gibberish_tokens(df, "text", lexicon, ["id"])
    for found in (stripped, ratio, tokens):
        keys = [line for line in plan_of(found).splitlines() if "hashpartitioning(" in line]
        assert not any("text" in line for line in keys) and bool(keys) <= (held == 0)
    got = {r["id"]: r["stripped"] for r in stripped.collect()}
    assert [got[i] for i in (0, 1, 30, 31, 32)] == ["hello 0.", "hello 1.", None, "", "hello’s HELLO é"]
    shares = {r["id"]: r["gibberish_ratio"] for r in ratio.collect()}
    assert [shares[i] for i in (0, 30, 31, 32)] == [0.5, 0.0, 0.0, 0.6]
    assert {(r["pos"], r["token"]) for r in tokens.where("id = 32").collect()} == {
        (0, "Hello-zzq"), (1, "zzq'hello"), (4, "zzq")}


def test_word_frequencies(spark):
    df = spark.createDataFrame([("A b a.",), ("a c",), (None,)], "t string")
    got = {r["token"]: r["zipf"] for r in cleaning.word_frequencies(df, "t").collect()}
    assert got == {"a": 8.78, "b": 8.3, "c": 8.3}


def test_topic_examples(spark):
    convs = spark.createDataFrame(
        [("c1", "t", -1.0), ("c0", "t", -1.0), ("c2", "t", 0.5), ("c3", "u", None), ("c4", None, 0.0)],
        "conv_id string, topic string, customer_sentiment_overall double")
    found = conversations.topic_example(convs)
    assert {(r["topic"], r["conv_id"]) for r in found.collect()} == {("t", "c0"), ("u", None), (None, "c4")}


def test_drilldown_starts_no_job(spark, turns_of):
    turns = turns_of({"turn_index": 0, "agent_name": "Bo", "text_clean": "hi."})
    convs = spark.createDataFrame([("c1", "Bo")], "conv_id string, agent_name string").select(
        "conv_id", "agent_name", *[F.lit(None).cast("string").alias(c) for c in conversations.TRANSCRIPT_HEADER
                                   if c != "agent_name"])
    agents = spark.createDataFrame([("Bo", 1)], "agent_name string, conv_count long")
    spark.sparkContext.setJobGroup("drilldown", "no job while the plan is built")
    found = questions.agent_drilldown(agents, convs, turns, ["Bo"])
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("drilldown")
    assert found.count() == 1


def test_summary_has_no_unbounded_window(spark):
    rows = [(float(i) / 100, "pass", 1.0) for i in range(-3, 500)] + [(None, "fail", None)]
    df = spark.createDataFrame(rows, "latency_s double, status string, grounding_score double")
    row = scoring.eval_summary(df).first()
    assert row["n_questions"] == 504 and row["p95_latency_s"] == sorted(
        [-9.0] + [r[0] for r in rows[:-1]])[int(0.95 * 503)]
