"""Conversations as text documents with metadata, ready for embedding."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance import constants as C
from parlance.functions.scores import present
from parlance.operators.keyed import block_of
from parlance.schema import TURN_BLOCK

METADATA_COLUMNS = (
    "agent_name", "customer_name", "turn_count", "start_ts", "end_ts", "topic",
    "customer_sentiment_overall", "escalation_flag", "language",
)


def conversation_document(turns: DataFrame, block: int = TURN_BLOCK) -> DataFrame:
    """`[role] text` lines in turn order, as (conv_id, part, document).

    A conversation is one part unless it has more turns than a block.
    """
    line = F.concat(F.lit("["), "role", F.lit("] "), F.coalesce("text_clean", F.lit("")))
    return (
        turns.groupBy("conv_id", block_of(F.col("turn_index"), block).alias("part"))
        .agg(F.collect_list(F.struct("turn_index", line.alias("line"))).alias("_lines"))
        .select(
            "conv_id", "part",
            F.array_join(
                F.transform(F.array_sort("_lines"), lambda x: x["line"]), "\n"
            ).alias("document"),
        )
    )


def majority_language(turns: DataFrame) -> DataFrame:
    """Most frequent language per conversation; `mixed` on a tie, `unknown` without any.

    The winners with the smallest and the largest name differ only on a tie.
    """
    counts = turns.groupBy("conv_id", present(F.col("language")).alias("language")).agg(
        F.count("language").alias("n")
    )
    entry = F.when(F.col("language").isNotNull(), F.struct("n", "language"))
    by_low_name = F.when(
        F.col("language").isNotNull(), F.struct((-F.col("n")).alias("n"), "language")
    )
    winners = counts.groupBy("conv_id").agg(
        F.max(entry)["language"].alias("_high"), F.min(by_low_name)["language"].alias("_low")
    )
    return winners.select(
        "conv_id",
        F.when(F.col("_high").isNull(), "unknown")
        .when(F.col("_high") == F.col("_low"), F.col("_high"))
        .otherwise("mixed").alias("language"),
    )


def document_metadata(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Metadata per conversation, from its rollup row if there is one, else from its turns."""
    turn = F.col("turn_index")
    first_name = {
        name: F.min_by(name, F.when(present(F.col(name)).isNotNull(), turn))
        for name in ("customer_name", "agent_name")
    }
    scores = F.when(F.col("role") == "customer", F.col("sentiment_score"))
    derived = turns.groupBy("conv_id").agg(
        F.coalesce(first_name["agent_name"], F.lit("")).alias("agent_name"),
        F.coalesce(first_name["customer_name"], F.lit("")).alias("customer_name"),
        F.count("*").alias("turn_count"),
        F.min("timestamp").alias("start_ts"),
        F.max("timestamp").alias("end_ts"),
        F.coalesce(F.avg(scores), F.lit(0.0)).alias("_sentiment"),
        F.max(F.when(F.coalesce("is_escalation", F.lit(0)) != 0, 1).otherwise(0))
        .alias("_escalation"),
    ).join(majority_language(turns), "conv_id")
    if conversations is None:
        rolled = derived.withColumns({
            "_topic": F.lit(None).cast("string"),
            "_rolled_sentiment": F.lit(None).cast("double"),
            "_rolled_escalation": F.lit(None).cast("int"),
        })
    else:
        rolled = derived.join(
            conversations.select(
                "conv_id",
                F.col("topic").alias("_topic"),
                F.col("customer_sentiment_overall").alias("_rolled_sentiment"),
                F.col("escalation_flag").alias("_rolled_escalation"),
            ),
            "conv_id", "left",
        )
    return rolled.select(
        "conv_id", "agent_name", "customer_name", "turn_count", "start_ts", "end_ts",
        F.coalesce(present(F.col("_topic")), F.lit(C.UNKNOWN_TOPIC)).alias("topic"),
        F.coalesce("_rolled_sentiment", "_sentiment").alias("customer_sentiment_overall"),
        F.coalesce("_rolled_escalation", "_escalation").alias("escalation_flag"),
        "language",
    )


def header_per_part(headers: DataFrame, turns: DataFrame, block: int = TURN_BLOCK) -> DataFrame:
    """Repeat conversation rows once per part of the conversation.

    Joined on (conv_id, part) with rows gathered by the same keys, the headers
    move to the gathered rows, which are not shuffled again.
    """
    parts = turns.select("conv_id", block_of(F.col("turn_index"), block).alias("part")).distinct()
    return headers.join(parts, "conv_id")


def vector_documents(
    turns: DataFrame, conversations: DataFrame | None = None, block: int = TURN_BLOCK
) -> DataFrame:
    """conv_id, part, document and a metadata struct: what gets embedded and stored."""
    metadata = document_metadata(turns, conversations).select(
        "conv_id", F.struct("conv_id", *METADATA_COLUMNS).alias("metadata")
    )
    return (
        conversation_document(turns, block)
        .join(header_per_part(metadata, turns, block), ["conv_id", "part"])
        .select("conv_id", "part", "document", "metadata")
    )
