"""Question and answer history per session, as table jobs."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import redact_pii
from parlance.operators.keyed import lookup_join, number_within
from parlance.schema import SESSIONS


def purge_expired(sessions: DataFrame, now: str) -> DataFrame:
    """Rows that have not expired at `now`."""
    return sessions.where(F.col("expires_at") >= F.lit(now).cast("timestamp"))


def append_sessions(
    sessions: DataFrame, new: DataFrame, now: str, ttl_hours: int = 24
) -> DataFrame:
    """Unexpired history plus new question/answer rows, numbered on per session.

    `new` has session_id, seq (a unique integer that orders the rows of a
    session), question, answer, and optionally evidence (ARRAY<STRING> of
    quotes). Personal data is redacted in each text before it goes into JSON.
    """
    kept = purge_expired(sessions, now)
    reached = kept.groupBy("session_id").agg(F.max("turn_idx").alias("_reached"))
    numbered = number_within(new, ["session_id"], "seq", into="_position")
    based = lookup_join(numbered, reached, ["session_id"])
    answer = [redact_pii(F.col("answer")).alias("answer")]
    if "evidence" in new.columns:
        answer.append(F.transform("evidence", redact_pii).alias("evidence"))
    created = F.lit(now).cast("timestamp")
    added = based.select(
        "session_id",
        (F.coalesce("_reached", F.lit(-1)) + 1 + F.col("_position")).cast("long").alias("turn_idx"),
        created.alias("created_at"),
        (created + F.make_dt_interval(hours=F.lit(ttl_hours))).alias("expires_at"),
        redact_pii(F.col("question")).alias("question"),
        F.to_json(F.struct(*answer)).alias("answer_json"),
    )
    return kept.select(*SESSIONS.fieldNames()).unionByName(added)


def recent_turns(sessions: DataFrame, now: str, n: int = 3) -> DataFrame:
    """The last n unexpired rows of each session, without those whose answer is not JSON.

    turn_idx gives their order, oldest first.
    """
    latest = Window.partitionBy("session_id").orderBy(F.desc("turn_idx"))
    return (
        purge_expired(sessions, now)
        .withColumn("_rank", F.row_number().over(latest)).where(F.col("_rank") <= n)
        .where(F.try_parse_json("answer_json").isNotNull())
        .where(F.get_json_object("answer_json", "$.answer").isNotNull())
        .select("session_id", "turn_idx", "question", "answer_json")
    )
