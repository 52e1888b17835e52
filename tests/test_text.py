import random
import re
import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
import pytest
from tests.helpers import plan_of, rows_of
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parlance import constants as C
from parlance.functions.openers import extract_slot
from parlance.functions.text import (
    doc_excerpt,
    redact_pii,
    tidy_spaces,
    truncate_last_terminator,
)
from parlance.operators import cleaning, keyed, topics as topic_ops


def column(spark, texts, fn):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[1] for r in sorted(df.select("i", fn(F.col("t"))).collect())]


@pytest.mark.parametrize("raw, cut", [
    ("Hello there. zzq blorf", "Hello there."),
    ("One? Two! three", "One? Two!"),
    ("no end here", ""),
    ("", ""),
    (None, ""),
    ("  wide space. x", "wide space."),
    ("line\nbreak.\ntail", "line\nbreak."),
    ("...", "..."),
])
def test_truncate(spark, raw, cut):
    assert column(spark, [raw], truncate_last_terminator) == [cut]


def test_tidy_spaces(spark):
    found = column(spark, ["  a \n\t b ,c  ! ", "x y ."], tidy_spaces)
    assert found == ["a b,c!", "x y."]


@pytest.mark.parametrize("raw, redacted", [
    ("mail me at a.b@c-d.org now", "mail me at [REDACTED_EMAIL] now"),
    ("card 4111 1111 1111 1111.", "card [REDACTED_CARD]."),
    ("call +91 98765 43210", "call +[REDACTED_PHONE]"),
    ("on 2025-11-01 08:00", "on [REDACTED_PHONE]:00"),
    ("room 12", "room 12"),
    ("é4111111111111111", "é4111111111111111"),
    ("", ""),
    (None, None),
])
def test_redact(spark, raw, redacted):
    assert column(spark, [raw], redact_pii) == [redacted]


def redact_python(text):
    for pattern, mark in ((C.EMAIL_PATTERN, C.EMAIL_MARK), (C.CARD_PATTERN, C.CARD_MARK),
                          (C.PHONE_PATTERN, C.PHONE_MARK)):
        text = re.sub(pattern, mark, text)
    return text


def test_redact_matches_python_patterns(spark):
    """Brute force over random mixes of the shapes; also idempotent."""
    @settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.text(alphabet="1234567890 -().+a@b.éü_\n", min_size=0, max_size=40),
                    min_size=300, max_size=400))
    def run(texts):
        found = column(spark, texts, redact_pii)
        assert found == [redact_python(t) for t in texts]
        assert column(spark, found, redact_pii) == found

    run()


def test_excerpt(spark):
    texts = ["a\nb\nc\nd\ne\nf\ng", "a\r\nb\n", "one", "", "a\nb\nc\nd\ne\nf\n", "\n\na"]
    assert column(spark, texts, doc_excerpt) == [
        "\n".join(t.splitlines()[:6]) for t in texts
    ]


@pytest.mark.parametrize("opener, slot, template, topic", [
    ("Hello, my Refund is not working as expected.", "Refund", "en_not_working", "billing_refunds"),
    ("Hi, I need help with my Exam.", "Exam", "en_need_help", "learning_education"),
    ("App crash ho rahi hai while using Wallet.", "Wallet", "hi_app_crash", "payments_wallet"),
    ("Coupon isn’t applying on checkout for the Hotel.", "Hotel", "en_coupon", "travel_transport"),
    ("Mujhe eSIM ke baare mein help chahiye.", "eSIM", "hi_mujhe_help", "telecom_number_management"),
    ("I was charged twice for my API.", "API", "en_charged_twice", "developer_platform"),
    ("UPI shows successful but I didn't get the service for Loan.", "Loan", "en_upi_service",
     "financial_products"),
    ("The Cab hasn't arrived yet. Can you check?", "Cab", "en_not_arrived", "travel_transport"),
    ("I can't log in. It says account locked.", None, "<no_slot>", "account_auth"),
    ("I can’t log in. It says account locked.", None, "<no_slot>", "account_auth"),
    ("Hi, I need help with my Gizmo.", "Gizmo", "en_need_help", "unknown"),
    ("Hi, I need help with my  SSO .", "SSO", "en_need_help", "account_auth"),
    ("Hello, my A\nB is not working as expected.", None, None, "unknown"),
    ("Something else.", None, None, "unknown"),
    (None, None, None, "unknown"),
])
def test_openers(spark, topics, opener, slot, template, topic):
    df = spark.createDataFrame([(opener,)], "opener string")
    got_slot, got_template = extract_slot(F.col("opener"))
    found = topic_ops.resolve_topic(df, "opener", topics).select(
        got_slot, got_template, "topic").first()
    assert tuple(found) == (slot, template, topic)


def test_taxonomy_coverage(spark, turns_of, topics):
    turns = turns_of(
        {"turn_index": 0, "text_clean": "Hi, I need help with my Gizmo."},
        {"turn_index": 0, "conv_id": "c2", "text_clean": "Hello?"},
        {"turn_index": 0, "conv_id": "c3", "text_clean": "Hi, I need help with my Loan."},
        {"turn_index": 1, "text_clean": "Not an opener."},
        {"turn_index": 0, "conv_id": "c4", "role": "agent", "text_clean": "Welcome."},
    )
    broken = topic_ops.Topics(
        topics.categories.where("id <> 'financial_products'"), topics.slots, topics.openers
    )
    assert rows_of(topic_ops.taxonomy_coverage(turns, broken)) == [
        ("slot", "Gizmo"), ("slot", "Loan"), ("unknown_category", "financial_products"),
        ("unmapped_slot", "Gizmo"), ("unmatched_opener", "Hello?"),
    ]


def test_category_slot_counts(topics):
    counts = {r["id"]: r["n_slots"] for r in topic_ops.category_slot_counts(topics).collect()}
    assert len(counts) == 15 and sum(counts.values()) == 51
    assert counts["broadband_connectivity"] == 1 and counts["account_auth"] == 1


KNOWN = {"the": 5.0, "flight": 4.0, "is": 6.0, "late": 3.0, "g": 2.0, "rare": 0.5}
TEXTS = [
    "The zzqx flight is late.", "The flight is late !", "(blorf) 4G, the qq", "zz", "", "1 2 3.",
    "  late-ish zz-yy isn't the\n\nflight zz.", "rare UPI upi", "é the zz é", "'tis the flight",
]


def strip_python(text):
    bad = lambda w: w.lower() not in C.DOMAIN_ALLOWLIST and KNOWN.get(w.lower(), 0) < 1
    out = re.sub(C.WORD_PATTERN, lambda m: "" if bad(m.group(0)) else m.group(0), text)
    out = re.sub(r"\s+", " ", out).strip()
    words = re.findall(C.WORD_PATTERN, text)
    share = sum(map(bad, words)) / len(words) if words else 0.0
    return re.sub(r"\s+([.,!?;:])", r"\1", out), share


@pytest.mark.parametrize("fits", [True, False])
def test_gibberish_against_python(spark, monkeypatch, fits):
    """Both join strategies give what a per-word callback gives; repeats stay."""
    if not fits:
        monkeypatch.setattr(cleaning, "fits_broadcast", lambda df: False)
        monkeypatch.setattr(keyed, "fits_broadcast", lambda df: False)
    lexicon = spark.createDataFrame(
        [*KNOWN.items(), ("flight", 0.1)], "token string, zipf double")
    docs = spark.createDataFrame(
        [(i, t) for i, t in enumerate(TEXTS + TEXTS[:3])], "id int, text string")
    stripped = cleaning.strip_gibberish(docs, "text", lexicon)
    assert rows_of(stripped.select("id", "stripped")) == sorted(
        ((i, strip_python(t)[0]) for i, t in enumerate(TEXTS + TEXTS[:3])), key=str)
    ratio = cleaning.gibberish_ratio(docs, "text", lexicon)
    got = {r["id"]: r["gibberish_ratio"] for r in ratio.collect()}
    assert got == {
        i: pytest.approx(strip_python(t)[1]) for i, t in enumerate(TEXTS + TEXTS[:3])}
    again = cleaning.strip_gibberish(stripped.select("id", "stripped"), "stripped", lexicon, into="s2")
    assert again.where("stripped <> s2").count() == 0
    tokens = cleaning.gibberish_tokens(docs.where("id = 0"), "text", lexicon, ["id"])
    assert rows_of(tokens) == [(0, 1, "zzqx")]


def test_gibberish_words_leave_python_in_bounded_batches(spark):
    """One text of many words is many batches; no list of a whole batch of texts is made."""
    held = SimpleNamespace(value=frozenset({"the"}))
    texts = ["the zzqx " * 50_000, None, "the", "qq the"]
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9, 10]), pa.array(texts)], ["id", "_text"])
    found = list(cleaning._unheld_tokens(held, ["id"])(iter([batch])))
    assert max(b.num_rows for b in found) <= 20_000 and sum(b.num_rows for b in found) == 50_001
    rows = [tuple(r.values()) for b in found for r in b.to_pylist()]
    assert rows == [*((7, 2 * i + 1, "zzqx") for i in range(50_000)), (10, 0, "qq")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    lexicon = spark.createDataFrame([("the", 6.0)], "token string, zipf double")
    plan = plan_of(cleaning.gibberish_tokens(df, "text", lexicon, ["id"], []))
    assert "MapInArrow" in plan and "Generate" not in plan


def test_gibberish_ratio_takes_no_words_out_of_python(spark):
    lexicon = spark.createDataFrame([("the", 6.0)], "token string, zipf double")
    df = spark.createDataFrame([(0, "the zz the q"), (1, None), (2, "1 2"), (3, "")], "id long, text string")
    ratio = cleaning.gibberish_ratio(df, "text", lexicon, [])
    assert rows_of(ratio.select("id", "gibberish_ratio")) == [(0, 0.5), (1, 0.0), (2, 0.0), (3, 0.0)]
    plan = plan_of(ratio)
    assert "places" not in plan and ".bad" in plan


def test_gibberish_is_counted_in_bounded_memory(spark):
    """No list of a text's words or of their places is made; words are counted one by one."""
    count = cleaning._words_counted(SimpleNamespace(value=frozenset({"the"}))).func
    batch = pa.array(["the zzqx " * 200_000, None, "the", ""])
    tracemalloc.start()
    found = count(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.to_pylist() == [{"bad": b, "words": w} for b, w in ((200_000, 400_000), (0, 0), (0, 1), (0, 0))]
    assert peak < 5e6


def test_texts_are_stripped_into_one_buffer(spark):
    """A batch of stripped texts is held once, not as a list of strings and as an array."""
    strip = cleaning._stripped(SimpleNamespace(value=frozenset({"the"}))).func
    batch = pa.array([None, "the zzqx, été.", "", *["the zzqx 12 " * 1_000] * 1_000, None]).slice(1)
    held = pa.total_allocated_bytes()
    tracemalloc.start()
    found = strip(batch)
    peak = tracemalloc.get_traced_memory()[1] + pa.total_allocated_bytes() - held
    tracemalloc.stop()
    found.validate(full=True)
    assert found.to_pylist() == ["the , éé.", "", *["the  12 " * 1_000] * 1_000, None]
    assert peak < 1.6 * 8_000_000
    assert strip(pa.array([], pa.string())).to_pylist() == []


def test_clean_turns(spark, turns_of):
    lexicon = spark.createDataFrame(list(KNOWN.items()), "token string, zipf double")
    turns = turns_of(
        {"turn_index": 0, "text_raw": "The  flight qqq is late. zz yy"},
        {"turn_index": 1, "text_raw": "no terminator"},
        {"turn_index": 2, "text_raw": None},
    )
    cleaned = cleaning.clean_turns(turns, lexicon)
    assert rows_of(cleaned.select("turn_index", "text_clean")) == [
        (0, "The flight is late."), (1, ""), (2, "")]
    assert rows_of(cleaning.cleaning_counts(cleaned)) == [(3, 2)]
    assert rows_of(cleaning.clean_turns(turns).select("text_clean"))[-1] == (
        "The flight qqq is late.",)


def test_large_taxonomies_are_salted(spark, topics):
    """Without a checked size the lookups are shuffled; hot openers resolve all the same."""
    large = topic_ops.Topics(topics.categories, topics.slots, topics.openers, small=False)
    openers = ["Hi, I need help with my Loan."] * 40 + [
        "I can’t log in. It says account locked.", "Hello?"]
    df = spark.createDataFrame(list(enumerate(openers)), "i int, opener string").repartition(4)
    found = topic_ops.resolve_topic(df, "opener", large).groupBy("topic").count()
    assert rows_of(found) == [("account_auth", 1), ("financial_products", 40), ("unknown", 1)]


def test_redaction_takes_every_unicode_blank(spark):
    rng = random.Random(4)
    alphabet = "0123456789" * 3 + "+-(). \t\x1c\x1d\x1e\x1f\x85  ab@"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["call +91 98765\x1c43210", "98765 43210 x", "\x1f9876543210\x1f"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r["i"]: r["r"] for r in df.select("i", redact_pii(F.col("t")).alias("r")).collect()}
    for i, t in enumerate(texts):
        want = re.sub(C.EMAIL_PATTERN, C.EMAIL_MARK, t)
        want = re.sub(C.CARD_PATTERN, C.CARD_MARK, want)
        assert got[i] == re.sub(C.PHONE_PATTERN, C.PHONE_MARK, want), repr(t)
