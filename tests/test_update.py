"""The bucket store, and rollups that are brought up to date against those that are rebuilt."""

import pytest
from pyspark.sql import functions as F
from tests.helpers import rows_of

from parlance.operators import rollups
from parlance.plans import update
from parlance.sources.bucket_store import BucketStore


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k string, v long")


def test_touched_buckets_are_replaced_and_others_stay(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), {"t": "k"}, buckets=32)
    assert store.read("t") is None and store.version() == 0
    first = rows(spark, *((f"k{i}", i) for i in range(200)), (None, -1))
    assert store.publish(store.stage("t", first)) == 1
    assert rows_of(store.read("t")) == rows_of(first)
    before = set(store.read("t").inputFiles())
    new = rows(spark, ("k7", 70), ("new", 1))
    touched = store.buckets_of("t", new)
    merged = store.read("t", touched).join(new, "k", "left_anti").unionByName(new)
    assert store.publish(store.stage("t", merged, touched)) == 2 == store.version()
    after = set(store.read("t").inputFiles())
    assert len(before - after) <= 2 and len(after - before) <= 2
    assert rows_of(store.read("t")) == rows_of(first.where("k <> 'k7' OR k IS NULL").unionByName(new))
    assert rows_of(store.read_keys("t", new.select("k"))) == rows_of(new)
    assert len(store.read_keys("t", rows(spark, ("k9", 0))).inputFiles()) <= 1


def test_an_update_that_is_lost_before_it_is_published_leaves_nothing(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), {"t": "k", "u": "k"}, buckets=4)
    store.publish(store.stage("t", rows(spark, ("a", 1))), store.stage("u", rows(spark, ("a", 2))))
    store.stage("t", rows(spark, ("a", 100)))  # and never published
    assert rows_of(store.read("t")) == [("a", 1)] and store.version() == 1
    again = BucketStore(spark, str(tmp_path), {"t": "k", "u": "k"}, buckets=4)
    again.publish(again.stage("t", rows(spark, ("a", 3))))
    assert rows_of(again.read("t")) == [("a", 3)] and rows_of(again.read("u")) == [("a", 2)]
    again.publish(again.stage("t", rows(spark, ("a", 3)).limit(0)))
    assert again.read("t").count() == 0 and again.read("t").columns == ["k", "v"]


def conversation(turns_of, *rows):
    return turns_of(*[
        {"timestamp": "2025-08-01 10:00:00", "text_clean": "Hello.", "language": "en", "sentiment_label": "neu",
         "intent": "other", "empathy_signal": "na", "is_escalation": 0, "contains_pii": 0, **row}
        for row in rows
    ])


def agent_turn(conv, index, agent, signal):
    return {"conv_id": conv, "turn_index": index, "role": "agent", "agent_name": agent, "empathy_signal": signal}


@pytest.fixture
def versions(turns_of):
    old = [
        agent_turn("c1", 0, "Ann", "empathetic"), agent_turn("c1", 1, "Bob", "dismissive"),
        agent_turn("c2", 0, "Bob", "neutral"), agent_turn("c3", 0, "Cy", "empathetic"),
        {"conv_id": "c3", "turn_index": 1, "sentiment_score": -0.5},
    ]
    # c1 loses Ann, c3 loses Cy altogether, c4 is new.
    new = [
        agent_turn("c1", 0, "Bob", "empathetic"), agent_turn("c3", 0, "Bob", "neutral"),
        {"conv_id": "c3", "turn_index": 2, "sentiment_score": 0.5, "intent": "thanks"},
        agent_turn("c4", 0, "Dee", "na"),
    ]
    replaced = {(r["conv_id"], r["turn_index"]): r for r in old + new}
    return conversation(turns_of, *old), conversation(turns_of, *new), conversation(turns_of, *replaced.values())


def assert_rebuilt(store, turns, topics):
    conversations = rollups.conversation_rollup(turns, topics)
    assert rows_of(store.read("conversations")) == rows_of(conversations)
    assert rows_of(store.read("agents")) == rows_of(rollups.agent_rollup(conversations, turns))


def test_updated_rollups_equal_rebuilt_ones(spark, versions, topics, tmp_path):
    old, new, whole = versions
    store = update.rollup_store(spark, str(tmp_path), buckets=8)
    update.update_rollups(store, old, topics)
    assert_rebuilt(store, old, topics)
    update.update_rollups(store, new, topics)
    assert_rebuilt(store, whole, topics)
    assert {r["agent_name"] for r in store.read("agents").collect()} == {"Bob", "Dee"}
    update.update_rollups(store, new, topics)
    assert_rebuilt(store, whole, topics)
    assert store.version() == 3


def test_an_update_that_fails_changes_nothing_and_can_be_run_again(spark, versions, topics, tmp_path, monkeypatch):
    old, new, whole = versions
    store = update.rollup_store(spark, str(tmp_path), buckets=8)
    update.update_rollups(store, old, topics)
    for lost in ("conversations", "agents"):
        stage = BucketStore.stage

        def failing(self, table, *more, lost=lost, stage=stage):
            if table == lost:
                raise RuntimeError("lost")
            return stage(self, table, *more)

        with monkeypatch.context() as patched:
            patched.setattr(BucketStore, "stage", failing)
            with pytest.raises(RuntimeError, match="lost"):
                update.update_rollups(store, new, topics)
        assert_rebuilt(store, old, topics)
        assert rows_of(store.read("turns").select("conv_id", "turn_index")) == rows_of(old.select("conv_id", "turn_index"))
    update.update_rollups(store, new, topics)
    assert_rebuilt(store, whole, topics)


def test_an_update_reads_the_touched_buckets_of_turns_only(spark, turns_of, topics, tmp_path):
    many = conversation(turns_of, *[
        {"conv_id": f"c{i}", "turn_index": t, "sentiment_score": 0.1} for i in range(300) for t in range(2)])
    store = update.rollup_store(spark, str(tmp_path), buckets=64)
    update.update_rollups(store, many, topics)
    before = set(store.read("turns").inputFiles())
    update.update_rollups(store, conversation(turns_of, {"conv_id": "c5", "turn_index": 1, "sentiment_score": 0.7}), topics)
    after = set(store.read("turns").inputFiles())
    assert len(before - after) == 1 and len(after - before) == 1 and len(after) >= 50
    row = store.read_keys("conversations", spark.createDataFrame([("c5",)], "conv_id string")).first()
    assert row["turn_count"] == 2 and row["sentiment_trajectory"] == [0.1, 0.7]


def test_the_last_row_of_a_turn_counts_and_unlabelled_turns_are_refused(spark, turns_of, topics, tmp_path):
    turns = conversation(turns_of, {"turn_index": 0, "sentiment_score": 0.2}, {"turn_index": 0, "sentiment_score": 0.4})
    numbered = turns.withColumn("seq", (F.col("sentiment_score") * 10).cast("int"))
    store = update.rollup_store(spark, str(tmp_path), buckets=2)
    update.update_rollups(store, numbered, topics, "seq")
    assert store.read("conversations").first()["customer_sentiment_overall"] == 0.4
    with pytest.raises(Exception, match="(?i)label"):
        update.update_rollups(store, turns_of({"turn_index": 1, "text_clean": "Hi."}), topics)
