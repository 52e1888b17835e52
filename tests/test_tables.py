import pytest
from tests.helpers import rows_of
from pyspark.sql import functions as F

from parlance.operators import scoring, sessions
from parlance.plans.build import Asking, build_tables, label_pending
from parlance.schema import SESSIONS
from parlance.sources import storage
from parlance.sources.turns import latest_turns, read_turns_csv, upsert_turns
from parlance.streaming.ingest import ingest_turns

HEADER = "conv_id,turn_index,timestamp,role,text,customer_name,agent_name\n"


def test_read_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        HEADER + 'c1,0,2025-08-01T10:00:00,customer,"He said ""hi"",\nthen é left.",Ann,\n'
        'c1,1,,agent,,"",Bo\n', encoding="utf-8")
    found = sorted(read_turns_csv(spark, str(tmp_path / "a.csv")).collect())
    assert found[0]["text_raw"] == 'He said "hi",\nthen é left.'
    assert str(found[0]["timestamp"]) == "2025-08-01 10:00:00"
    assert (found[0]["customer_name"], found[0]["agent_name"]) == ("Ann", None)
    assert (found[1]["text_raw"], found[1]["customer_name"], found[1]["timestamp"]) == ("", None, None)


def test_read_csv_rejects_bad_index(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "c1,one,,customer,x.,,\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_turns_csv(spark, str(tmp_path / "a.csv")).collect()


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "text,conv_id,extra,turn_index,timestamp,role,customer_name,agent_name\nhi.,c1,z,3,,agent,,\n")
    found = read_turns_csv(spark, str(tmp_path / "a.csv")).first()
    assert (found["conv_id"], found["turn_index"], found["text_raw"]) == ("c1", 3, "hi.")


def test_upsert(turns_of):
    old = turns_of({"turn_index": 0, "text_raw": "a", "intent": "query"},
                   {"turn_index": 1, "text_raw": "b", "intent": "query"})
    new = turns_of({"turn_index": 1, "text_raw": "late", "intent": "thanks"},
                   {"turn_index": 1, "text_raw": "later"}, {"turn_index": 2, "text_raw": "c"})
    seq = new.withColumn("seq", F.when(F.col("text_raw") == "later", 9).otherwise(1))
    found = upsert_turns(old, seq, "seq").select("turn_index", "text_raw", "intent")
    assert rows_of(found) == [(0, "a", "query"), (1, "later", None), (2, "c", None)]


def test_materialize(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = spark.range(5), spark.range(7)
    assert storage.materialize(one, path).count() == 5
    assert storage.materialize(two, path).count() == 5
    assert storage.materialize(two, path, expected_rows=7).count() == 7
    assert storage.materialize(one, path, force=True).count() == 5
    parts = storage.materialize(two.withColumn("p", F.col("id") % 2), path + "2", partition_by=["p"])
    assert parts.where("p = 1").count() == 3


def history(spark, *rows):
    df = spark.createDataFrame(
        [(s, i, "2025-11-01 00:00:00", e, f"q{i}", a) for s, i, e, a in rows],
        "session_id string, turn_idx long, created_at string, expires_at string, question string,"
        " answer_json string")
    return df.select([F.col(f.name).cast(f.dataType) for f in SESSIONS])


NOW = "2025-11-02 00:00:00"


def test_sessions(spark):
    kept = history(
        spark, ("s", 0, "2025-11-01 23:59:59", "{}"), ("s", 4, NOW, '{"answer": "x"}'),
        ("t", 2, "2025-11-01 01:00:00", "{}"))
    new = spark.createDataFrame(
        [("s", 7, "call +91 98765 43210", "see a@b.org", ["card 4111111111111111"]),
         ("s", 3, "first", "ok", []), ("t", 1, "fresh", "ok", None)],
        "session_id string, seq long, question string, answer string, evidence array<string>")
    found = sessions.append_sessions(kept, new, NOW, ttl_hours=2)
    assert rows_of(found.select("session_id", "turn_idx", "question")) == [
        ("s", 4, "q4"), ("s", 5, "first"), ("s", 6, "call +[REDACTED_PHONE]"), ("t", 0, "fresh")]
    last = found.where("turn_idx = 6").first()
    assert last["answer_json"] == (
        '{"answer":"see [REDACTED_EMAIL]","evidence":["card [REDACTED_CARD]"]}')
    assert str(last["expires_at"]) == "2025-11-02 02:00:00"
    assert sessions.purge_expired(kept, NOW).count() == 1


def test_recent_turns(spark):
    later = "2025-11-03 00:00:00"
    good, broken, other = '{"answer": "x"}', '{"answer": "x', '{"reply": 1}'
    rows = [("s", i, later, a) for i, a in enumerate([good, good, broken, good, other])]
    kept = history(spark, *rows, ("s", 9, "2025-11-01 01:00:00", good))
    found = sessions.recent_turns(kept, NOW, n=4)
    assert rows_of(found.select("turn_idx")) == [(1,), (3,)]


def answers(spark, *rows):
    columns = (
        "id string, category string, language string, answer string, evidence_count int,"
        " tools_used array<string>, latency_s double, grounding_score double, error string,"
        " expected_tools array<string>, expected_keywords array<string>, min_evidence int")
    return spark.createDataFrame(list(rows), columns)


def test_scoring(spark):
    df = answers(
        spark,
        ("a", "agg", "en", "In NOVEMBER, one Topic.", 1, ["x", "q"], 1.0, 1.0, None, ["q"],
         ["november", "topic"], 1),
        ("b", "agg", "en", "november", 0, ["q"], 2.0, None, None, ["q"], ["november", "topic"], 1),
        ("c", "agg", "hi", "nothing", 0, [], 3.0, 0.5, None, ["q"], ["november", "a", "b"], 0),
        ("d", "sem", "hi", "x", 0, None, 4.0, None, None, ["q"], [], 0),
        ("e", "sem", "hi", "november", 5, ["q"], 10.006, None, "boom", ["q"], ["november"], 0),
    )
    scored = {r["id"]: r for r in scoring.score_answers(df).collect()}
    assert {k: r["status"] for k, r in scored.items()} == {
        "a": "pass", "b": "partial", "c": "fail", "d": "partial", "e": "fail"}
    assert scored["b"]["coverage"] == 0.5 and scored["b"]["coverage_missed"] == ["topic"]
    assert scored["d"]["coverage"] == 1.0 and scored["c"]["coverage"] == 0.0
    assert scored["e"]["coverage_missed"] == ["november"] and not scored["e"]["evidence_pass"]
    summary = scoring.eval_summary(scoring.score_answers(df)).first().asDict()
    assert summary == {
        "n_questions": 5, "pass_rate": 0.2, "partial_rate": 0.4, "fail_rate": 0.4,
        "mean_latency_s": 4.0, "median_latency_s": 3.0, "p95_latency_s": 4.0, "mean_grounding": 0.75}
    assert rows_of(scoring.pass_rate_by(scoring.score_answers(df), "category")) == [
        ("agg", 0.333), ("sem", 0.0)]
    empty = scoring.eval_summary(scoring.score_answers(df.limit(0))).first().asDict()
    assert empty["n_questions"] == 0 and empty["p95_latency_s"] == 0 and empty["mean_grounding"] is None


@pytest.mark.parametrize("n", [1, 2, 4, 21, 40])
def test_latency_quantiles(spark, n):
    import statistics

    values = [round(((i * 7) % 13) * 1.37, 2) for i in range(n)]
    df = answers(spark, *[
        (str(i), "c", "en", "", 0, [], v, None, None, [], [], 0) for i, v in enumerate(values)])
    row = scoring.eval_summary(scoring.score_answers(df)).first()
    assert row["median_latency_s"] == pytest.approx(statistics.median(values), abs=0.0051)
    assert row["p95_latency_s"] == sorted(values)[int(0.95 * (n - 1))]


def test_build_is_resumable(spark, topics, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [
        f"c{c},{t},2025-08-0{c + 1}T10:0{t}:00,{'agent' if t else 'customer'},"
        f"{'I am sorry.' if t else 'I was charged twice for my API.'} zzq,Ann,Bo\n"
        for c in range(3) for t in range(2)]
    (tmp_path / "in" / "a.csv").write_text(HEADER + "".join(lines))
    raw = read_turns_csv(spark, str(tmp_path / "in"))
    path = str(tmp_path / "out")
    found = build_tables(raw, topics, path, "2025-12-03 00:00:00", None)
    assert found.labels.count() == 2 and found.turns.count() == 6
    assert {r["topic"] for r in found.conversations.collect()} == {"developer_platform"}
    assert found.agents.first()["empathy_mean"] == 1.0
    assert found.vectors.count() == 3
    again = build_tables(raw.limit(0), topics, path, "2025-12-03 00:00:00", None)
    assert again.turns.count() == 6
    agents = spark.read.parquet(path + "/agents")
    assert agents.count() == 1 and spark.read.parquet(path + "/conversations").columns[-1] == "month"
    rebuilt = build_tables(raw.where("conv_id = 'c1'"), topics, path, "2025-12-03 00:00:00", None, force=True)
    assert rebuilt.conversations.count() == 1


def test_build_finishes_and_keeps_the_last_row(spark, topics, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(
        HEADER + "c1,0,2025-08-01T10:00:00,customer,My Gizmo is an old row.,,\n"
        "c1,0,2025-08-01T10:00:00,customer,I was charged twice for my API. zzq,,\n"
        "c1,1,2025-08-01T10:01:00,agent,ok no terminator,,Bo\nc2,0,,customer,,,\n")
    lexicon = spark.createDataFrame([(w, 5.0) for w in "i was charged twice for my api".split()], "token string, zipf double")
    raw = read_turns_csv(spark, str(tmp_path / "in"))
    found = build_tables(raw, topics, str(tmp_path / "out"), "2025-12-03 00:00:00", lexicon)
    turns = {(r["conv_id"], r["turn_index"]): r for r in found.turns.collect()}
    assert len(turns) == 3 and turns["c1", 0]["text_clean"] == "I was charged twice for my API."
    assert turns["c1", 1]["text_clean"] == "" and turns["c1", 1]["sentiment_label"] == "neu"
    assert {r["conv_id"]: r["turn_count"] for r in found.conversations.collect()} == {"c1": 2, "c2": 1}
    assert found.rejected.count() == 0 and found.vectors.count() == 2 and found.agents.count() == 1
    assert "slot" in {r["kind"] for r in found.coverage.collect()}


def test_wrong_answers_are_stored(spark, tmp_path):
    def labeller(frame):
        out = frame.assign(
            sentiment_label="neu", sentiment_score=0.0, intent="other", empathy_signal="na",
            is_escalation=0, contains_pii=0, language="en", text_en=frame["text_clean"])
        out.loc[out["text_clean"] == "a.", "text_clean"] = "nobody asked."
        out.loc[out["text_clean"] == "b.", "intent"] = "chat"
        return out[out["text_clean"] != "c."]

    cleaned = spark.createDataFrame([(t, "customer") for t in ("a.", "b.", "c.", "d.")], "text_clean string, role string")
    labels, _ = label_pending(cleaned, str(tmp_path), "2025-12-03 00:00:00", labeller)
    assert [r["text_clean"] for r in labels.collect()] == ["d."]
    rejected = spark.read.parquet(f"{tmp_path}/labels_rejected")
    assert rows_of(rejected.select("text_clean", "error")) == [
        ("a.", "no label returned"), ("b.", "bad intent"), ("c.", "no label returned"),
        ("nobody asked.", "not asked for")]


def test_unfinished_tables_are_rebuilt(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    assert storage.materialize(spark.range(7), path).count() == 7
    assert storage.materialize(spark.range(9), path).count() == 7


@pytest.mark.parametrize("first, last", [("One.", "Two."), ("Two.", "One.")])
def test_the_later_file_and_row_wins(spark, tmp_path, first, last):
    import os

    (tmp_path / "in").mkdir()
    for name, texts, when in (("b.csv", ["Zero.", first], 1_000_000), ("a.csv", ["Old.", last], 2_000_000)):
        path = tmp_path / "in" / name
        path.write_text(HEADER + "".join(f"c1,0,,customer,{t},,\n" for t in texts))
        os.utime(path, (when, when))
    found = ingest_turns(spark, *(str(tmp_path / n) for n in ("in", "turns", "marks")))
    assert [r["text_clean"] for r in found.collect()] == [last]
    raw = read_turns_csv(spark, str(tmp_path / "in"))
    assert [r["text_raw"] for r in latest_turns(raw, "row_order").collect()] == [last]


def test_ties_are_decided_by_content(turns_of):
    new = turns_of(*[{"turn_index": 0, "text_raw": t} for t in "abcdef"]).withColumn("seq", F.lit(1))
    found = {upsert_turns(new.limit(0).drop("seq"), df, "seq").first()["text_raw"]
             for df in (new, new.orderBy(F.desc("text_raw")), new.repartition(4))}
    assert len(found) == 1


def test_streams_are_cleaned_like_the_build(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(HEADER + "c1,0,,customer,hello zzq there. x,,\n")
    lexicon = spark.createDataFrame([("hello", 5.0), ("there", 5.0)], "token string, zipf double")
    found = ingest_turns(spark, *(str(tmp_path / n) for n in ("in", "turns", "marks")), lexicon)
    assert found.first()["text_clean"] == "hello there."


def test_labelling_goes_on(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def labeller(frame):
        seen.add(len(frame))
        return frame.assign(
            sentiment_label=["bad" if "rude" in t else "neu" for t in frame["text_clean"]],
            sentiment_score=0.0, intent="other", empathy_signal="na", is_escalation=0,
            contains_pii=0, language="en", text_en=frame["text_clean"])

    cleaned = spark.createDataFrame(
        [("a.", "customer"), ("b.", "customer"), ("b.", "customer"), ("rude.", "agent")],
        "text_clean string, role string")
    path, at = str(tmp_path), "2025-12-03 00:00:00"
    labels, grew = label_pending(cleaned, path, at, labeller, limit=1)
    assert grew and labels.count() == 1 and seen.value == 1
    labels, grew = label_pending(cleaned, path, at, labeller)
    assert grew and labels.count() == 2 and seen.value == 3
    good = cleaned.where("text_clean <> 'rude.'")
    labels, grew = label_pending(good, path, at, labeller)
    assert not grew and labels.count() == 2 and seen.value == 3
    assert label_pending(good, path, at, labeller, force=True)[0].count() == 2 and seen.value == 5


def neutral_labeller():
    """Made by a call, as the workers cannot import this file."""

    def neutral(frame):
        return frame.assign(
            sentiment_label="neu", sentiment_score=0.0, intent="other", empathy_signal="na",
            is_escalation=0, contains_pii=0, language="en", text_en=frame["text_clean"])

    return neutral


def texts(spark, n):
    return spark.range(n).selectExpr("concat('t', id, '.') AS text_clean", "'customer' AS role")


def test_a_batch_that_fails_loses_no_other(spark, tmp_path):
    answered, neutral = spark.sparkContext.accumulator(0), neutral_labeller()

    def moody(frame):
        """Each batch fails once, the one with t7 twice."""
        first = frame["text_clean"].iloc[0]
        seen = tmp_path / f"seen-{first}"
        tries = len(seen.read_text()) if seen.exists() else 0
        seen.write_text("x" * (tries + 1))
        if tries < (2 if (frame["text_clean"] == "t7.").any() else 1):
            raise RuntimeError("busy")
        answered.add(len(frame))
        return neutral(frame)

    asking = Asking(batch_size=3, workers=2, attempts=2, wait=0.0, chunk_rows=5, chunks_at_once=2)
    path, at = str(tmp_path / "out"), "2025-12-03 00:00:00"
    labels, _ = label_pending(texts(spark, 40), path, at, moody, asking=asking)
    lost = spark.read.parquet(f"{path}/labels_rejected")
    missing = lost.count()
    assert 1 <= missing <= 3 and labels.count() == 40 - missing
    assert {r["error"] for r in lost.collect()} == {"no label returned after RuntimeError: busy"}
    asked_again = Asking(batch_size=3, attempts=3, wait=0.0)
    labels, grew = label_pending(texts(spark, 40), path, at, moody, asking=asked_again)
    assert grew and labels.count() == labels.select("text_clean").distinct().count() == 40
    assert answered.value == 40


def test_lost_labelling_asks_the_missing_chunks_only(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    neutral = neutral_labeller()

    def labeller(frame):
        if len(list(log.iterdir())) >= 8 and not (tmp_path / "well").exists():
            # Not an Exception: the task is lost, as with its executor.
            raise SystemExit("gone")
        for text in frame["text_clean"]:
            with open(log / text, "a") as file:
                file.write("x")
        return neutral(frame)

    asking = Asking(batch_size=2, workers=1, attempts=1, chunk_rows=2, chunks_at_once=1)
    path, at = str(tmp_path / "out"), "2025-12-03 00:00:00"
    with pytest.raises(Exception):
        label_pending(texts(spark, 20), path, at, labeller, asking=asking)
    assert len(list(log.iterdir())) == 8 and storage.read_table(spark, f"{path}/labels") is None
    (tmp_path / "well").touch()
    labels, grew = label_pending(texts(spark, 20), path, at, labeller, asking=asking)
    assert grew and labels.count() == 20
    assert [len(f.read_text()) for f in log.iterdir()] == [1] * 20
    labels, grew = label_pending(texts(spark, 20), path, at, labeller, asking=asking)
    assert not grew and labels.count() == 20


def test_a_forced_run_replaces_all_labels(spark, tmp_path):
    path, at, neutral = str(tmp_path / "out"), "2025-12-03 00:00:00", neutral_labeller()
    for n in (3, 6):
        assert label_pending(texts(spark, n), path, at, neutral)[0].count() == n
    assert label_pending(texts(spark, 2), path, at, neutral, force=True)[0].count() == 2
    assert label_pending(texts(spark, 4), path, at)[0].count() == 4


def test_streaming_ingest(spark, tmp_path):
    source, target, marks = (str(tmp_path / n) for n in ("in", "turns", "marks"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(HEADER + "c1,0,,customer,One. zz,,\nc1,1,,agent,Two. zz,,\n")
    ingest_turns(spark, source, target, marks)
    (tmp_path / "in" / "b.csv").write_text(HEADER + "c1,1,,agent,Two again. zz,,\nc1,2,,agent,Three.,,\n")
    found = ingest_turns(spark, source, target, marks)
    assert rows_of(found.select("turn_index", "text_clean")) == [
        (0, "One."), (1, "Two again."), (2, "Three.")]
    assert ingest_turns(spark, source, target, marks).count() == 3
