import pytest
from tests.helpers import plan_of, rows_of
from pyspark.sql import functions as F

from parlance.operators import conversations as conv
from parlance.operators import profile, topics as topic_ops
from parlance.plans import questions
from parlance.sources.storage import write_rollups

COLUMNS = (
    "conv_id string, customer_name string, agent_name string, start_ts timestamp,"
    " end_ts timestamp, turn_count long, topic string, customer_sentiment_overall double,"
    " sentiment_trajectory array<double>, resolution_flag int, escalation_flag int,"
    " agent_empathy_mean double, contains_pii_any int"
)


@pytest.fixture
def convs(spark):
    rows = [
        ("c1", "Ann", "A", "2025-10-31 23:59:59", "loans", -0.5, 1, 0, 1.0),
        ("c2", "Bob", "A", "2025-11-01 00:00:00", "loans", 0.5, 0, 1, 0.5),
        ("c3", "Cid", "B", "2025-11-30 23:59:59", "cards", -0.5, 0, 1, None),
        ("c4", "Dee", None, "2025-12-01 00:00:00", "cards", None, 0, 0, 0.0),
        ("c5", "Eve", "B", None, "other", 0.0, 1, 0, 0.25),
    ]
    df = spark.createDataFrame(
        [(i, c, a, s, s, 2, t, m, [], r, e, w, 0) for i, c, a, s, t, m, r, e, w in rows],
        COLUMNS.replace("timestamp", "string"),
    )
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ("start_ts", "end_ts")})


@pytest.fixture
def turns(turns_of):
    return turns_of(
        {"conv_id": "c1", "turn_index": 0, "language": "hi", "text_clean": "a",
         "sentiment_score": -0.5, "text_clean_en": "A"},
        {"conv_id": "c1", "turn_index": 1, "language": "en", "role": "agent", "text_clean": "b",
         "agent_name": "A", "empathy_signal": "neutral"},
        {"conv_id": "c2", "turn_index": 4, "language": "en", "intent": "urgency_request"},
        {"conv_id": "c3", "turn_index": 0, "language": None, "role": "agent", "agent_name": "B",
         "empathy_signal": "dismissive", "text_clean": "no"},
    )


def ids(df):
    return "".join(sorted(r["conv_id"][1] for r in df.collect()))


@pytest.mark.parametrize("conditions, kept", [
    ({}, "12345"),
    ({"month": "2025-11"}, "23"),
    ({"month": "2025-12"}, "4"),
    ({"date_from": "2025-11-01"}, "234"),
    ({"date_to": "2025-11-30"}, "123"),
    ({"date_from": "2025-11-30", "date_to": "2025-11-30"}, "3"),
    ({"topic": "loans"}, "12"),
    ({"sentiment_max": 0}, "135"),
    ({"sentiment_min": 0, "sentiment_max": 0.5}, "25"),
    ({"escalation": True}, "23"),
    ({"escalation": False, "resolution": True}, "15"),
    ({"agent": "B", "topic": "cards"}, "3"),
    ({"language": "en"}, "12"),
    ({"language": "hi"}, "1"),
    ({"month": "", "topic": "", "agent": "", "language": "", "date_from": "", "date_to": ""}, "12345"),
])
def test_filters(convs, turns, conditions, kept):
    assert ids(conv.filter_conversations(convs, turns, **conditions)) == kept


def test_bad_arguments(convs, turns, topics):
    bad = [
        lambda: conv.filter_conversations(convs, month="2025"),
        lambda: conv.filter_conversations(convs, turns, language="de"),
        lambda: conv.filter_conversations(convs, language="en"),
        lambda: conv.list_conversations(convs, limit=0),
        lambda: conv.list_conversations(convs, limit=101),
        lambda: conv.list_conversations(convs, order="up"),
        lambda: conv.aggregate_conversations(convs, "customer_name"),
        lambda: conv.aggregate_conversations(convs, "topic", ()),
        lambda: conv.aggregate_conversations(convs, "topic", ("sum",)),
        lambda: conv.aggregate_conversations(convs, "language"),
        lambda: conv.rank_agents(convs, 0),
        lambda: conv.rank_agents(convs, 1, "agent_name"),
    ]
    for call in bad:
        with pytest.raises(ValueError):
            call()


def test_list_orders_nulls_as_smallest(convs):
    up = conv.list_conversations(convs, "customer_sentiment_overall", "asc", 3)
    assert [r["conv_id"] for r in up.collect()] == ["c4", "c1", "c3"]
    down = conv.list_conversations(convs, "customer_name", "desc", 5)
    assert [r["conv_id"] for r in down.collect()] == ["c4", "c3", "c2", "c1", "c5"]
    assert len(up.columns) == 11
    assert "TakeOrderedAndProject" in plan_of(up)


def test_aggregate(convs, turns):
    by_topic = conv.aggregate_conversations(
        convs, "topic", ("avg_sentiment", "count", "escalation_rate"), order_by="count", limit=2)
    assert [tuple(r) for r in by_topic.collect()] == [
        ("cards", -0.5, 2, 0.5), ("loans", 0.0, 2, 0.5)]
    by_agent = conv.aggregate_conversations(convs, "agent_name", order_by="nothing", order="asc")
    assert [tuple(r) for r in by_agent.collect()] == [(None, 1), ("A", 2), ("B", 2)]
    by_month = conv.aggregate_conversations(convs, "month")
    assert rows_of(by_month) == [
        ("2025-10", 1), ("2025-11", 2), ("2025-12", 1), (None, 1)]
    by_language = conv.aggregate_conversations(convs, "language", turns=turns)
    assert rows_of(by_language) == [("en", 1), ("hi", 1), (None, 3)]


def test_month_filter_reaches_the_scan(convs, tmp_path):
    convs.write.parquet(str(tmp_path / "c"))
    stored = convs.sparkSession.read.parquet(str(tmp_path / "c"))
    plan = plan_of(questions.top_negative_topics_in_month(stored, "2025-11"))
    assert "GreaterThanOrEqual(start_ts" in plan and "LessThan(start_ts" in plan
    assert "sentiment_trajectory" not in plan


@pytest.mark.parametrize("conditions, kept", [
    ({"month": "2025-11"}, "23"), ({"date_from": "2025-11-30"}, "34"), ({"date_to": "2025-10-31"}, "1"),
])
def test_stored_months_are_pruned(convs, turns, tmp_path, conditions, kept):
    stored, _ = write_rollups(convs, turns, str(tmp_path))
    found = conv.filter_conversations(stored, **conditions)
    assert ids(found) == kept
    assert "PartitionFilters: [isnotnull(month" in plan_of(found)
    one = conv.conversation_trajectory(stored, turns, ["c1"]).first()
    assert one["topic"] == "loans"


def test_language_filter_is_a_semi_join(convs, turns):
    assert "LeftSemi" in plan_of(conv.filter_conversations(convs, turns, language="en"))


def test_trajectory_and_transcript(convs, turns):
    one = conv.conversation_trajectory(convs, turns, ["c1", "nope"]).collect()
    assert len(one) == 1
    assert one[0]["customer_arc"] == [-0.5] and one[0]["topic"] == "loans"
    assert [t["text_clean"] for t in one[0]["turns"]] == ["a", "b"]
    wanted = convs.where("conv_id IN ('c1', 'c2')").select("conv_id")
    assert ids(conv.conversation_transcript(convs, turns, wanted)) == "12"
    plain = conv.conversation_transcript(convs, turns, ["c1"]).first()
    assert plain["turns"][0]["text_clean_en"] is None
    full = conv.conversation_transcript(convs, turns, ["c1"], include_translation=True).first()
    assert full["turns"][0]["text_clean_en"] == "A"
    parts = conv.conversation_trajectory(convs, turns, ["c1"], block=1).orderBy("part").collect()
    assert [[t["turn_index"] for t in p["turns"]] for p in parts] == [[0], [1]]
    assert [p["topic"] for p in parts] == ["loans", "loans"]


def test_topics(spark, convs):
    known = topic_ops.Topics(
        spark.createDataFrame([("loans", "L", "d"), ("empty", "E", "d")],
                              "id string, label string, description string"), None, None)
    assert rows_of(conv.topic_counts(convs, known)) == [("empty", "E", "d", 0), ("loans", "L", "d", 2)]
    more = convs.unionByName(convs.limit(1).withColumns({
        "conv_id": F.lit("c0"), "topic": F.lit("silent"),
        "customer_sentiment_overall": F.lit(None).cast("double")}))
    assert rows_of(conv.topic_example(more)) == [
        ("cards", "c3"), ("loans", "c1"), ("other", "c5"), ("silent", None)]
    listed = conv.list_topics(convs, known, with_examples=True)
    assert {r["id"]: r["example_conv_id"] for r in listed.collect()} == {"loans": "c1", "empty": None}


def test_questions(convs, turns):
    assert rows_of(questions.resolved_vs_unresolved(convs)) == [(0, 3), (1, 2)]
    top = questions.top_negative_topics_in_month(convs, "2025-11").collect()
    assert [(r["group_key"], r["avg_sentiment"]) for r in top] == [("cards", -0.5), ("loans", 0.5)]
    assert questions.highest_escalation_topic(convs).first()["group_key"] == "cards"
    assert ids(questions.urgent_turns_by_language(turns, "en")) == "2"
    ranked = questions.severity_ranking_with_example(convs).collect()
    assert [(r["topic"], r["example_conv_id"]) for r in ranked] == [
        ("cards", "c3"), ("loans", "c1"), ("other", "c5")]
    worst = questions.high_volume_low_resolution(convs).collect()
    assert [(r["topic"], r["resolution_rate"]) for r in worst] == [("cards", 0.0)]
    angry = questions.escalated_not_resolved(convs, turns, "loans").collect()
    assert [r["conv_id"] for r in angry] == ["c2"] and angry[0]["quote"] is None


def test_agent_questions(spark, convs, turns):
    agents = spark.createDataFrame(
        [("A", 2, 0.5), ("B", 2, 0.0), ("C", 1, None)],
        "agent_name string, conv_count long, empathy_mean double")
    low = questions.low_empathy_agents_with_quote(agents, turns, min_conv_count=2, limit=1)
    assert [(r["agent_name"], r["quote"]) for r in low.collect()] == [("B", "no")]
    both = questions.compare_agents(agents, ["A", "C"])
    assert [r["agent_name"] for r in both.orderBy("agent_name").collect()] == ["A", "C"]
    drill = questions.agent_drilldown(agents, convs, turns, ["A"]).first()
    assert drill["conv_id"] == "c1" and len(drill["turns"]) == 2


def test_rank_agents(spark):
    agents = spark.createDataFrame(
        [("A", 2, 0.5), ("B", 2, 0.5), ("C", 1, None), ("D", 3, 0.9)],
        "agent_name string, conv_count long, empathy_mean double")

    def names(**options):
        return [r["agent_name"] for r in conv.rank_agents(agents, **options).collect()]

    assert names() == ["C", "A", "B", "D"]
    assert names(order="desc", min_conv_count=2, limit=2) == ["D", "A"]
    assert names(sort_by="conv_count", order="desc") == ["D", "A", "B", "C"]


def test_profile(convs, turns):
    assert rows_of(profile.table_counts(turns, convs)) == [
        ("conversations", 5), ("distinct_agents", 2), ("distinct_texts", 3), ("turns", 4)]
    assert rows_of(profile.label_distribution(turns)) == [
        ("language", "en", 2), ("language", "hi", 1), ("language", None, 1),
        ("sentiment_label", None, 4)]
    assert rows_of(profile.agent_empathy_distribution(turns)) == [("dismissive", 1), ("neutral", 1)]
    assert rows_of(profile.agents_by_conv_count(turns)) == [(1, 2)]
    first, last = profile.date_range(convs).first()
    assert (str(first)[:10], str(last)[:10]) == ("2025-10-31", "2025-12-01")
