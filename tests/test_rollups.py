import random

import pytest
from tests.helpers import plan_of, rows_of
from pyspark.sql import functions as F

from parlance.operators import documents, keyed, rollups
from parlance.plans import questions


def rolled(turns, topics, **options):
    return rollups.conversation_rollup(turns, topics, **options)


def test_conversation_edge_cases(turns_of, topics):
    turns = turns_of(
        # Opener is not turn 0; names '' and NULL are missing; times are not monotonic.
        {"turn_index": 0, "role": "system", "timestamp": "2025-08-03 00:00:00",
         "customer_name": "", "sentiment_score": 1.0},
        {"turn_index": 1, "text_clean": "Hi, I need help with my Exam.", "customer_name": "Ann",
         "timestamp": "2025-08-01 00:00:00", "sentiment_score": -0.5},
        {"turn_index": 2, "role": "agent", "agent_name": "Bo", "empathy_signal": "empathetic",
         "sentiment_score": 0.9, "is_escalation": 1},
        {"turn_index": 7, "role": "agent", "agent_name": "Bo", "empathy_signal": "na"},
        {"turn_index": 9, "intent": "thanks", "sentiment_score": 0.1, "contains_pii": 1},
        {"turn_index": 10, "role": "agent", "empathy_signal": "dismissive"},
        # Thanks comes too early; no customer scores.
        {"conv_id": "c2", "turn_index": 0, "intent": "thanks", "text_clean": "x"},
        {"conv_id": "c2", "turn_index": 1, "role": "agent"},
        {"conv_id": "c2", "turn_index": 2, "role": "agent"},
        # Only the agent speaks, with a closing intent that does not count.
        {"conv_id": "c3", "turn_index": 0, "role": "agent", "intent": "thanks"},
    )
    found = {r["conv_id"]: r.asDict() for r in rolled(turns, topics).collect()}
    one = found["c1"]
    assert (one["customer_name"], one["agent_name"]) == ("Ann", "Bo")
    assert str(one["start_ts"]).startswith("2025-08-01") and str(one["end_ts"]).startswith("2025-08-03")
    assert one["turn_count"] == 6 and one["topic"] == "learning_education"
    assert one["customer_sentiment_overall"] == pytest.approx(-0.2)
    assert one["sentiment_trajectory"] == [-0.5, 0.1]
    assert (one["resolution_flag"], one["escalation_flag"], one["contains_pii_any"]) == (1, 1, 1)
    assert one["agent_empathy_mean"] == 0.5
    two, three = found["c2"], found["c3"]
    assert two["resolution_flag"] == 0 and two["customer_sentiment_overall"] is None
    assert two["sentiment_trajectory"] == [] and two["topic"] == "unknown"
    assert three["resolution_flag"] == 0 and three["topic"] == "unknown"


def long_turns(turns_of, n=41, seed=3):
    """One hot conversation with most of the rows, and some short ones."""
    draw = random.Random(seed)
    rows = []
    for conv, size in (("hot", n), ("s1", 3), ("s2", 1)):
        rows += [
            {"conv_id": conv, "turn_index": i, "role": draw.choice(["customer", "customer", "agent"]),
             "sentiment_score": draw.choice([-0.5, 0.0, 0.5, None]), "text_clean": f"t{i}",
             "intent": draw.choice(["thanks", "other"]), "language": draw.choice(["en", "hi", None])}
            for i in range(size)
        ]
    draw.shuffle(rows)
    return rows, turns_of(*rows)


def customer_scores(rows, conv):
    mine = sorted((r for r in rows if r["conv_id"] == conv), key=lambda r: r["turn_index"])
    return [(r["turn_index"], r["sentiment_score"]) for r in mine
            if r["role"] == "customer" and r["sentiment_score"] is not None]


def test_long_conversations_are_whole(turns_of, topics):
    rows, turns = long_turns(turns_of)
    parts = rollups.sentiment_trajectory_parts(turns, block=4).collect()
    for conv in ("hot", "s1", "s2"):
        joined = sum((r["scores"] for r in sorted(parts, key=lambda r: r["part"])
                      if r["conv_id"] == conv), [])
        assert joined == [s for _, s in customer_scores(rows, conv)]
    far = turns.withColumn("turn_index", turns["turn_index"] * 70_000)
    for found in (rolled(turns, topics), rolled(far, topics)):
        whole = {r["conv_id"]: r["sentiment_trajectory"] for r in found.collect()}
        for conv in ("hot", "s1", "s2"):
            assert whole[conv] == [s for _, s in customer_scores(rows, conv)]
    docs = documents.conversation_document(turns, block=4).orderBy("part").collect()
    whole = "\n".join(r["document"] for r in docs if r["conv_id"] == "hot")
    expected = sorted((r for r in rows if r["conv_id"] == "hot"), key=lambda r: r["turn_index"])
    assert whole == "\n".join(f"[{r['role']}] {r['text_clean']}" for r in expected)


def inflections_python(scores):
    found, before, last = [], None, None
    for index, score in scores:
        if before is not None and score != before:
            change = score - before
            if last is not None and (change > 0) != (last > 0):
                found.append((index, score, change, last))
            last = change
        before = score
    return found


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_inflections_do_not_depend_on_blocks(turns_of, block):
    rows, turns = long_turns(turns_of, n=60)
    found = questions.sentiment_inflections(turns, hot_rows=block)
    expected = [(c, *hit) for c in ("hot", "s1", "s2")
                for hit in inflections_python(customer_scores(rows, c))]
    assert len(expected) > 5
    assert rows_of(found) == sorted(expected, key=str)


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_numbering_does_not_depend_on_blocks(spark, block):
    df = spark.createDataFrame(
        [("hot", 3 * i) for i in range(50)] + [("s", 5), ("s", 900)], "k string, o long")
    found = keyed.number_within(df, ["k"], "o", "n", hot_rows=block)
    assert rows_of(found.select("k", "o", "n")) == sorted(
        [("hot", 3 * i, i) for i in range(50)] + [("s", 5, 0), ("s", 900, 1)], key=str)


def test_invariants(turns_of, topics):
    rows, turns = long_turns(turns_of)
    found = rolled(turns, topics)
    assert found.agg(F.sum("turn_count")).first()[0] == len(rows)
    assert found.agg(F.sum(F.size("sentiment_trajectory"))).first()[0] == sum(
        len(customer_scores(rows, c)) for c in ("hot", "s1", "s2"))


def test_rollup_plan(turns_of, topics):
    plan = plan_of(rolled(turns_of({"turn_index": 0}), topics))
    assert plan.count("WindowGroupLimit") >= 2, "the last-two rule must be cut on the map side"
    for operator in ("EvalPython", "InPandas", "InArrow", "NestedLoop", "Cartesian"):
        assert operator not in plan


def conversations(spark, *rows):
    columns = ("conv_id string, agent_name string, topic string,"
               " customer_sentiment_overall double, resolution_flag int, escalation_flag int")
    return spark.createDataFrame(list(rows), columns)


def test_agent_rollup(spark, turns_of):
    convs = conversations(
        spark, ("c1", "A", "t2", -1.0, 1, 0), ("c2", "A", "t1", None, 0, 1),
        ("c3", "A", "t1", 0.0, None, 1), ("c4", "A", "t3", 0.5, 1, 0),
        ("c5", "A", "t4", 0.5, 1, 0), ("c6", None, "t1", 1.0, 1, 1), ("c7", "B", None, None, 0, 0),
    )
    turns = turns_of(
        {"turn_index": 0, "role": "agent", "agent_name": "A", "empathy_signal": "empathetic"},
        {"turn_index": 1, "role": "agent", "agent_name": "A", "empathy_signal": "na"},
        {"turn_index": 2, "role": "agent", "agent_name": "A", "empathy_signal": "dismissive"},
        {"turn_index": 3, "role": "agent", "agent_name": "A", "empathy_signal": "neutral"},
        {"turn_index": 4, "role": "customer", "agent_name": "A", "empathy_signal": "empathetic"},
    )
    found = {r["agent_name"]: r for r in rollups.agent_rollup(convs, turns).collect()}
    a, b = found["A"], found["B"]
    assert a["conv_count"] == 5 and a["avg_customer_sentiment"] == pytest.approx(0.0)
    assert a["empathy_mean"] == 0.5
    assert a["resolution_rate"] == pytest.approx(0.6) and a["escalation_rate"] == pytest.approx(0.4)
    assert [tuple(t) for t in a["top_topics"]] == [("t1", 2), ("t2", 1), ("t3", 1)]
    assert b["empathy_mean"] is None and b["avg_customer_sentiment"] is None
    assert [tuple(t) for t in b["top_topics"]] == [("unknown", 1)]


def test_majority_language(turns_of):
    def said(conv, *langs):
        return [{"conv_id": conv, "turn_index": i, "language": v} for i, v in enumerate(langs)]

    turns = turns_of(*said("a", "en", "en", "hi"), *said("b", "en", "hi"), *said("c", None, ""),
                     *said("d", "hi", None, ""), *said("e", "mixed", "en", "hi"))
    assert rows_of(documents.majority_language(turns)) == [
        ("a", "en"), ("b", "mixed"), ("c", "unknown"), ("d", "hi"), ("e", "mixed")]


def test_metadata_defaults(spark, turns_of):
    turns = turns_of(
        {"turn_index": 0, "is_escalation": 1}, {"conv_id": "c2", "turn_index": 0,
                                                "sentiment_score": 0.4})
    rollup = conversations(spark, ("c1", None, "", None, 0, 0))
    found = {r["conv_id"]: r for r in documents.document_metadata(turns, rollup).collect()}
    assert found["c1"]["topic"] == "unknown" and found["c1"]["customer_sentiment_overall"] == 0.0
    assert found["c1"]["escalation_flag"] == 0 and found["c1"]["agent_name"] == ""
    assert found["c2"]["customer_sentiment_overall"] == 0.4
    alone = {r["conv_id"]: r for r in documents.document_metadata(turns).collect()}
    assert alone["c1"]["escalation_flag"] == 1
