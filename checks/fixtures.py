"""The driver's tables seen as turns, labels, sessions and evaluation rows.

Each adapter is plain Spark over whole tables, so its size grows with them.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance import constants as C
from parlance.functions.text import truncate_last_terminator
from parlance.operators.cleaning import word_frequencies
from parlance.operators.documents import vector_documents
from parlance.operators.keyed import lookup_join, number_within
from parlance.operators.labelling import label_texts, validate_labels
from parlance.operators.rollups import agent_rollup, conversation_rollup
from parlance.operators.topics import Topics
from parlance.sources.scratch import shared_folder
from parlance.sources.taxonomy import taxonomy_tables

NOW = "2025-11-01 12:00:00"
LABELLED_AT = "2025-12-03 00:00:00"
OPENERS = (
    "Hello, my Refund is not working as expected.",
    "Mujhe Wallet ke baare mein help chahiye.",
    "I can't log in. It says account locked.",
    "The Flight hasn't arrived yet. Can you check?",
    "I was charged twice for my API.",
    "Hi, I need help with my Exam.",
    "Hi, I need help with my Gizmo.",
    "Something else.",
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and the executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def chat_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled turns from the conversations table, with templated openers and a noise tail."""
    chats = table(spark, sf, "conversations")
    first = chats.where("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("first_user"))
    rows = lookup_join(chats, first, ["conv_id"])
    intents = ", ".join(f"'{i}'" for i in C.INTENT_LABELS)
    signals = ", ".join(f"'{s}'" for s in C.EMPATHY_LABELS)
    openers = ", ".join(f'"{o}"' for o in OPENERS)
    labelled = rows.selectExpr(
        "conv_id AS c", "turn AS t", "first_user", "text",
        "CASE role WHEN 'user' THEN 'customer' WHEN 'assistant' THEN 'agent' ELSE role END AS role",
        "CAST((conv_id * 31 + turn * 17) % 21 - 10 AS INT) AS s10",
        f"element_at(array({intents}), CAST((conv_id * 7 + turn * 5) % 12 AS INT) + 1) AS intent",
        f"element_at(array({signals}), CAST((conv_id * 13 + turn * 3) % 4 AS INT) + 1) AS signal",
        "(conv_id * 11 + turn) % 10 AS lk",
    ).selectExpr(
        "'C' || lpad(CAST(c AS STRING), 7, '0') AS conv_id",
        "CAST(t AS INT) AS turn_index",
        "timestamp'2025-08-01 00:00:00' + make_dt_interval(0, 0,"
        " CAST(c * 8111 % 180000 + t * 37 % 11 AS INT), 0) AS timestamp",
        "role",
        f"CASE WHEN t = first_user THEN element_at(array({openers}), CAST(c % 8 AS INT) + 1)"
        " ELSE text END || ' zzqx blorf vvk' AS text_raw",
        "CASE WHEN c % 17 = 0 THEN '' ELSE 'Cust' || lpad(CAST(c % 50 AS STRING), 3, '0') END"
        " AS customer_name",
        "CASE WHEN c % 19 <> 0 THEN 'Agent' || lpad(CAST(c * 7 % 30 AS STRING), 3, '0') END"
        " AS agent_name",
        "CASE WHEN s10 > 2 THEN 'pos' WHEN s10 < -2 THEN 'neg' ELSE 'neu' END AS sentiment_label",
        "CAST(s10 / 10.0 AS DOUBLE) AS sentiment_score",
        "intent",
        "CASE WHEN role = 'customer' THEN 'na' ELSE signal END AS empathy_signal",
        "CAST(intent = 'escalation_request' AS INT) AS is_escalation",
        "CAST((c * 3 + t) % 23 = 0 AS INT) AS contains_pii",
        "CASE WHEN lk < 7 THEN 'en' WHEN lk < 9 THEN 'hi' ELSE 'mixed' END AS language",
        f"timestamp'{LABELLED_AT}' AS classified_at",
    )
    cleaned = labelled.withColumn("text_clean", truncate_last_terminator(F.col("text_raw")))
    return cleaned.withColumn("text_clean_en", F.col("text_clean"))


def event_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled turns from the events table: a user's day is a conversation."""
    events = table(spark, sf, "events").withColumn(
        "conv_id", F.concat(F.lit("E"), "user_id", F.lit("-"), F.date_format("ts", "yyyyMMdd"))
    )
    rows = number_within(events, ["conv_id"], "event_id", into="turn_index")
    labelled = rows.selectExpr(
        "conv_id",
        "CAST(turn_index AS INT) AS turn_index",
        "CAST(ts AS TIMESTAMP) AS timestamp",
        "CASE WHEN event_type IN ('signup', 'error') THEN 'agent' ELSE 'customer' END AS role",
        "event_type || ' ' || get_json_object(props, '$.k') || '. zzqx' AS text_raw",
        "CAST(NULL AS STRING) AS customer_name",
        "'Agent' || lpad(CAST(user_id % 30 AS STRING), 3, '0') AS agent_name",
        "CASE WHEN value < 10 THEN -5 WHEN value < 30 THEN 0 ELSE 5 END AS s10",
        "CASE event_type WHEN 'purchase' THEN 'thanks' WHEN 'error' THEN 'complaint'"
        " WHEN 'signup' THEN 'query' WHEN 'view' THEN 'acknowledgement' ELSE 'other' END AS intent",
        "element_at(array('empathetic', 'neutral', 'dismissive'), CAST(event_id % 3 AS INT) + 1)"
        " AS signal",
        "CAST(event_type = 'error' AND value > 50 AS INT) AS is_escalation",
        "CAST(event_id % 23 = 0 AS INT) AS contains_pii",
        "CASE WHEN event_id % 10 < 7 THEN 'en' WHEN event_id % 10 < 9 THEN 'hi' ELSE 'mixed' END"
        " AS language",
    )
    return labelled.select(
        "conv_id", "turn_index", "timestamp", "role", "text_raw",
        truncate_last_terminator(F.col("text_raw")).alias("text_clean"),
        "customer_name", "agent_name",
        F.expr("CASE WHEN s10 > 0 THEN 'pos' WHEN s10 < 0 THEN 'neg' ELSE 'neu' END")
        .alias("sentiment_label"),
        F.expr("CAST(s10 / 10.0 AS DOUBLE)").alias("sentiment_score"),
        "intent",
        F.expr("CASE WHEN role = 'customer' THEN 'na' ELSE signal END").alias("empathy_signal"),
        "is_escalation", "contains_pii", "language",
        truncate_last_terminator(F.col("text_raw")).alias("text_clean_en"),
        F.lit(LABELLED_AT).cast("timestamp").alias("classified_at"),
    )


def topics(spark: SparkSession) -> Topics:
    return taxonomy_tables(spark)


def customer_topics(spark: SparkSession, sf: str) -> Topics:
    """A taxonomy read from tables: nations as categories, customers as slots."""
    nation, customer = table(spark, sf, "nation"), table(spark, sf, "customer")
    nations = nation.selectExpr(
        "'n' || n_nationkey AS id", "n_name AS label", "CAST(n_regionkey AS STRING) AS description"
    )
    slots = customer.selectExpr("c_name AS slot", "'n' || c_nationkey AS category")
    return Topics(nations, slots, slots.selectExpr("slot AS opener", "category"))


def chat_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return conversation_rollup(chat_turns(spark, sf), topics(spark))


def event_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return conversation_rollup(event_turns(spark, sf), topics(spark))


def chat_agents(spark: SparkSession, sf: str) -> DataFrame:
    turns = chat_turns(spark, sf)
    return agent_rollup(conversation_rollup(turns, topics(spark)), turns)


def chat_documents(spark: SparkSession, sf: str) -> DataFrame:
    turns = chat_turns(spark, sf)
    return vector_documents(turns, conversation_rollup(turns, topics(spark)))


def lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the benchmark texts with their Zipf frequency."""
    return word_frequencies(table(spark, sf, "benchmark"), "text")


def event_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted rule labels for the texts of purchases and errors only."""
    seen = event_turns(spark, sf).where(
        "text_clean LIKE 'purchase %' OR text_clean LIKE 'error %'"
    ).select("text_clean", "role").distinct()
    accepted, _ = validate_labels(label_texts(seen), LABELLED_AT)
    return accepted


def unlabelled_event_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Event turns that only clicks and views have labels for."""
    turns = event_turns(spark, sf)
    old = "text_clean LIKE 'click %' OR text_clean LIKE 'view %'"
    from parlance.schema import LABEL_COLUMNS

    return turns.withColumns({c: F.expr(f"CASE WHEN {old} THEN {c} END") for c in LABEL_COLUMNS})


def document_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Labeller answers about documents, some of them invalid; one per (text, role)."""
    docs, marks = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = docs.join(marks, "doc_id", "left").selectExpr(
        "text AS text_clean",
        "CASE WHEN doc_id % 2 = 0 THEN 'agent' ELSE 'customer' END AS role",
        "doc_id", "quality", "toxic", "lang",
    )
    first = rows.groupBy("text_clean", "role").agg(
        F.min_by(F.struct("doc_id", "quality", "toxic", "lang"), "doc_id").alias("d")
    )
    return first.selectExpr(
        "text_clean", "role",
        "CASE d.quality WHEN 1 THEN 'pos' WHEN 0 THEN 'neg' ELSE CASE WHEN d.doc_id % 5 = 0"
        " THEN 'happy' ELSE 'neu' END END AS sentiment_label",
        "CAST(CASE WHEN d.doc_id % 7 = 0 THEN 1.5 ELSE d.doc_id % 3 - 1 END AS DOUBLE)"
        " AS sentiment_score",
        "CASE WHEN d.doc_id % 11 = 0 THEN 'chat' ELSE 'query' END AS intent",
        "CASE WHEN d.doc_id % 13 = 0 THEN 'rude' ELSE 'neutral' END AS empathy_signal",
        "CAST(coalesce(d.toxic, 0) AS INT) AS is_escalation",
        "CAST(CASE WHEN d.doc_id % 17 = 0 THEN 2 ELSE 0 END AS INT) AS contains_pii",
        "CASE d.lang WHEN 'de' THEN 'de' WHEN 'en' THEN 'en' ELSE 'mixed' END AS language",
        "CASE WHEN d.doc_id % 19 = 0 THEN ' ' ELSE text_clean END AS text_en",
    )


def session_history(spark: SparkSession, sf: str) -> DataFrame:
    """Stored history: documents with labels, one session per source."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    numbered = number_within(docs, ["source"], "doc_id", into="turn_idx")
    return numbered.selectExpr(
        "source AS session_id", "turn_idx",
        "timestamp'2025-11-01 00:00:00' + make_dt_interval(0, 0, CAST(doc_id % 720 AS INT), 0)"
        " AS created_at",
        "timestamp'2025-11-01 00:00:00' + make_dt_interval(0, CASE WHEN quality = 1 THEN 24"
        " ELSE 4 END, CAST(doc_id % 720 AS INT), 0) AS expires_at",
        "text AS question",
        "CASE WHEN toxic = 1 THEN '{\"answer\": \"cut' ELSE to_json(struct(lang AS answer)) END"
        " AS answer_json",
    )


def session_news(spark: SparkSession, sf: str) -> DataFrame:
    """New questions and answers: documents without labels."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti")
    return docs.selectExpr(
        "source AS session_id", "doc_id AS seq", "text AS question",
        "lang || ': ' || text AS answer", "array(text, lang) AS evidence",
    )


def eval_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers to score: one per document."""
    docs, marks = table(spark, sf, "documents"), table(spark, sf, "labels")
    return docs.join(marks, "doc_id", "left").selectExpr(
        "doc_id AS id", "text AS answer", "CAST(coalesce(quality, 0) AS INT) AS evidence_count",
        "CASE doc_id % 4 WHEN 0 THEN array('query_agents') WHEN 1 THEN array('list_topics',"
        " 'semantic_search') WHEN 2 THEN array('get_trajectory') ELSE CAST(array() AS ARRAY<STRING>)"
        " END AS tools_used",
        "CAST(n_chars / 37.0 AS DOUBLE) AS latency_s",
        "CAST((quality * 3 + toxic) / 4.0 AS DOUBLE) AS grounding_score",
        "CASE WHEN doc_id % 29 = 0 THEN 'timeout' END AS error",
    )


def eval_specs(spark: SparkSession, sf: str) -> DataFrame:
    """What each answer should hold: one spec per document."""
    return table(spark, sf, "documents").selectExpr(
        "doc_id AS id", "source AS category", "lang AS language",
        "CASE n_chars % 3 WHEN 0 THEN array('query_agents', 'semantic_search') WHEN 1 THEN"
        " array('get_trajectory') ELSE array('list_topics') END AS expected_tools",
        "CASE lang WHEN 'en' THEN array('The', 'OF', 'zebra') WHEN 'fr' THEN array('Des', 'xylo')"
        " WHEN 'es' THEN array('Que') ELSE CAST(array() AS ARRAY<STRING>) END AS expected_keywords",
        "CAST(doc_id % 2 AS INT) AS min_evidence",
    )


def labelled_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings table as vector documents; the label gives the metadata."""
    return table(spark, sf, "embeddings").selectExpr(
        "vec_id AS conv_id", "embedding", "'topic' || label AS topic",
        "'Agent' || label % 3 AS agent_name", "CASE WHEN label % 2 = 0 THEN 'en' ELSE 'hi' END"
        " AS language", "CAST(label % 2 AS INT) AS escalation_flag",
        "CAST(label / 10.0 - 0.5 AS DOUBLE) AS customer_sentiment_overall",
    )


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Query vectors: every vector whose id is divisible by 50."""
    return table(spark, sf, "embeddings").where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding")


def label_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Query vectors: the mean embedding of each label."""
    cells = table(spark, sf, "embeddings").select(
        F.col("label").alias("query_id"), F.posexplode("embedding").alias("pos", "x")
    )
    means = cells.groupBy("query_id", "pos").agg(F.avg("x").alias("x"))
    return means.groupBy("query_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"].cast("double")
        ).alias("embedding")
    )
