import random

import pytest
from tests.helpers import plan_of, rows_of
from pyspark.sql import functions as F

from parlance.operators import keyed, labelling
from parlance.schema import LABELS, RAW_LABELS

AT = "2025-12-03 00:00:00"
GOOD = ("hi.", "agent", "pos", 0.5, "query", "neutral", 0, 0, "en", "hi.")


def raw(spark, **change):
    values = dict(zip(RAW_LABELS.fieldNames(), GOOD)) | change
    return spark.createDataFrame([tuple(values.values())], RAW_LABELS)


def labels(spark, *rows):
    accepted = [
        labelling.validate_labels(raw(spark, **row), AT, row.pop("model", "m"))[0] for row in rows
    ]
    found = spark.createDataFrame([], LABELS)
    for part in accepted:
        found = found.unionByName(part)
    return found


@pytest.mark.parametrize("change, error", [
    ({}, None),
    ({"sentiment_label": "happy"}, "bad sentiment_label"),
    ({"sentiment_label": None}, "bad sentiment_label"),
    ({"sentiment_score": 1.01}, "sentiment_score out of range"),
    ({"sentiment_score": None}, "sentiment_score out of range"),
    ({"intent": "chat"}, "bad intent"),
    ({"empathy_signal": "kind"}, "bad empathy_signal"),
    ({"is_escalation": 2}, "bad is_escalation"),
    ({"contains_pii": None}, "bad contains_pii"),
    ({"language": "de"}, "bad language"),
    ({"text_en": "  "}, "text_en is empty"),
    ({"text_en": None}, "text_en is empty"),
])
def test_validate(spark, change, error):
    accepted, rejected = labelling.validate_labels(raw(spark, **change), AT)
    assert accepted.count() == (error is None)
    assert [r["error"] for r in rejected.collect()] == ([error] if error else [])


def test_customer_empathy_is_na(spark):
    accepted, _ = labelling.validate_labels(raw(spark, role="customer"), AT)
    assert accepted.first()["empathy_signal"] == "na"


def test_answers_must_match_what_was_asked(spark):
    asked = spark.createDataFrame(
        [("hi.", "agent"), ("lost.", "agent")], "text_clean string, role string")
    answers = raw(spark).unionByName(raw(spark, text_clean="extra."))
    accepted, rejected = labelling.validate_labels(answers, AT, pending=asked)
    assert [r["text_clean"] for r in accepted.collect()] == ["hi."]
    assert rows_of(rejected.select("text_clean", "error")) == [
        ("extra.", "not asked for"), ("lost.", "no label returned")]


def test_upsert_prefers_new_then_agent(spark):
    old = labels(spark, {"text_clean": "a", "intent": "other"}, {"text_clean": "b"})
    new = labels(
        spark, {"text_clean": "a", "role": "customer", "intent": "thanks"},
        {"text_clean": "a", "role": "agent", "intent": "apology"}, {"text_clean": "c"})
    stored = labelling.upsert_labels(old, new)
    assert rows_of(stored.select("text_clean", "intent")) == [
        ("a", "apology"), ("b", "query"), ("c", "query")]


@pytest.mark.parametrize("fits", [True, False])
def test_propagate_keeps_unmatched(spark, turns_of, monkeypatch, fits):
    if not fits:
        monkeypatch.setattr(keyed, "fits_broadcast", lambda df: False)
    turns = turns_of(
        *[{"turn_index": i, "text_clean": "a", "intent": "other"} for i in range(20)],
        {"turn_index": 20, "text_clean": "z", "intent": "other", "language": "hi"},
        {"turn_index": 21, "text_clean": None},
    )
    known = labels(spark, {"text_clean": "a", "intent": "thanks", "language": "mixed"})
    found = labelling.propagate_labels(turns, known)
    assert found.columns == turns.columns
    assert rows_of(found.groupBy("intent", "language").count()) == [
        ("other", "hi", 1), ("thanks", "mixed", 20), (None, None, 1)]


def test_labelling_resumes(spark, turns_of):
    turns = turns_of(
        {"turn_index": 0, "text_clean": "Please escalate, urgent!"},
        {"turn_index": 1, "text_clean": "I am sorry.", "role": "agent"},
        {"turn_index": 2, "text_clean": "I am sorry.", "role": "agent"},
    )
    none = spark.createDataFrame([], LABELS)
    pending = labelling.pending_texts(turns, none)
    assert pending.count() == 2
    assert labelling.pending_texts(turns, none, limit=1).count() == 1
    accepted, rejected = labelling.validate_labels(labelling.label_texts(pending), AT)
    assert rejected.count() == 0
    stored = labelling.upsert_labels(none, accepted)
    assert rows_of(stored.select("intent", "empathy_signal", "is_escalation")) == [
        ("apology", "empathetic", 0), ("escalation_request", "na", 1)]
    assert labelling.pending_texts(turns, stored).count() == 0


def test_hints_lose_no_match_of_a_rule(spark):
    """A text that a rule matches holds one of its hints; texts without are not searched by the rule."""
    words = ("Escalate manager SUPERVISOR urgent Urgently ASAP immediately jaldi expedite resolved|works now|issue fixed|"
             "thanks|thank you|Dhanyavaad|purchase|sorry|apologise|APOLOGIZE|regret|error|crash|Not Working|failed|"
             "charged twice|hasn't arrived|hasnt arrived|please share|Please confirm|please provide|refund is|"
             "refunded has been|reset will be|replacement is|checking|investigating|in progress|okay|OK|got it|noted|view|"
             "?|help|understand|cannot help|not our problem|as per policy|great|frustrated|\u0130|\u212a|x|ok\u0130")
    draw, words = random.Random(9), [w for part in words.split("|") for w in ([part] if part[0].islower() else [part, *part.split()])]
    texts = [*words, *(draw.choice(["", " ", "."]).join(draw.choices(words, k=draw.randrange(6))) for _ in range(3_000)), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text_clean string")
    rules = {**dict(labelling.INTENT_RULES), **{r: r for r in labelling.RULE_HINTS if r.startswith("(")}}
    assert rules.keys() == labelling.RULE_HINTS.keys()
    for rule, pattern in rules.items():
        held = " OR ".join(f'contains(lower(text_clean), "{hint}")' for hint in labelling.RULE_HINTS[rule])
        assert df.where(F.col("text_clean").rlike(pattern)).count() > 0
        assert df.where(F.col("text_clean").rlike(pattern)).where(f"NOT ({held})").count() == 0, rule
    pending = df.selectExpr("text_clean", "CASE i % 2 WHEN 0 THEN 'agent' ELSE 'customer' END AS role")
    assert "contains(" in plan_of(labelling.rule_labels(pending)).lower()


def test_supplied_labeller(spark, turns_of):
    sizes = spark.sparkContext.accumulator(0)

    def labeller(frame):
        assert len(frame) <= 2
        sizes.add(len(frame))
        return frame.assign(
            sentiment_label="neu", sentiment_score=0.0, intent="other", empathy_signal="na",
            is_escalation=0, contains_pii=0, language="en", text_en=frame["text_clean"])

    turns = turns_of(*[{"turn_index": i, "text_clean": f"t{i}."} for i in range(7)])
    pending = labelling.pending_texts(turns, spark.createDataFrame([], LABELS))
    found = labelling.label_texts(pending, labeller, partitions=2, batch_size=2)
    assert found.count() == 7 and sizes.value == 7


def test_gate(turns_of):
    turns = turns_of(
        {"turn_index": 0, "sentiment_label": "pos"}, {"turn_index": 1, "sentiment_label": None})
    assert labelling.unlabelled_gate(turns) == 1
    assert labelling.require_labelled(turns.where("turn_index = 0")).count() == 1
    with pytest.raises(Exception, match="no sentiment label"):
        labelling.require_labelled(turns).agg(F.count("conv_id")).collect()
