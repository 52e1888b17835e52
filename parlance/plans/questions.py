"""Analyst questions, each as one composition of the operators."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.scores import empathy_score
from parlance.operators.conversations import (
    aggregate_conversations,
    conversation_trajectory,
    conversation_transcript,
    filter_conversations,
    rank_agents,
    topic_example,
)
from parlance.operators.keyed import HOT_ROWS, previous_within
from parlance.operators.search import semantic_search


def top_negative_topics_in_month(
    conversations: DataFrame, month: str, limit: int = 5, round_digits: int = 3
) -> DataFrame:
    """Topics with the lowest mean customer sentiment in a month."""
    return aggregate_conversations(
        filter_conversations(conversations, month=month), "topic",
        metrics=("avg_sentiment", "count"), order="asc", limit=limit, round_digits=round_digits,
    )


def highest_escalation_topic(conversations: DataFrame, round_digits: int = 3) -> DataFrame:
    """The topic with the highest escalation rate."""
    return aggregate_conversations(
        conversations, "topic", metrics=("escalation_rate", "count"), limit=1,
        round_digits=round_digits,
    )


def resolved_vs_unresolved(conversations: DataFrame) -> DataFrame:
    """Number of resolved and of unresolved conversations."""
    return conversations.groupBy("resolution_flag").agg(F.count("*").alias("count"))


def low_empathy_agents_with_quote(
    agents: DataFrame, turns: DataFrame, min_conv_count: int = 1, limit: int = 10
) -> DataFrame:
    """Agents with the lowest empathy, each with their least empathetic turn."""
    lowest = rank_agents(agents, min_conv_count, "empathy_mean", "asc", limit)
    scored = (
        turns.where("role = 'agent'")
        .withColumn("score", empathy_score(F.col("empathy_signal")))
        .where("score IS NOT NULL")
    )
    # At most `limit` agents, which rank_agents holds to 100: small enough to broadcast.
    names = F.broadcast(lowest.select("agent_name"))
    first = F.struct("score", "conv_id", "turn_index")
    quotes = scored.join(names, "agent_name").groupBy("agent_name").agg(
        F.min_by(F.struct("conv_id", "turn_index", "text_clean"), first).alias("quote")
    )
    return lowest.join(quotes, "agent_name", "left").select(
        "agent_name", "conv_count", "empathy_mean",
        F.col("quote.conv_id").alias("quote_conv_id"),
        F.col("quote.turn_index").alias("quote_turn_index"),
        F.col("quote.text_clean").alias("quote"),
    )


def compare_agents(agents: DataFrame, names: Sequence[str]) -> DataFrame:
    """The rows of some agents side by side."""
    return agents.where(F.col("agent_name").isin(*names))


def sentiment_arc(
    conversations: DataFrame, turns: DataFrame, conv_ids: Sequence[str] | DataFrame | None = None
) -> DataFrame:
    """How customer sentiment moved through each conversation."""
    return conversation_trajectory(conversations, turns, conv_ids).select(
        "conv_id", "part", "topic", "customer_sentiment_overall", "customer_arc"
    )


def sentiment_inflections(turns: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Customer turns at which sentiment changes direction.

    Columns: conv_id, turn_index, score, change from the customer's turn before,
    previous_change. Turns without a change are passed over.
    """
    scores = turns.where("role = 'customer' AND sentiment_score IS NOT NULL").select(
        "conv_id", "turn_index", F.col("sentiment_score").alias("score")
    )
    moves = (
        previous_within(scores, ["conv_id"], "turn_index", "score", "_before", hot_rows)
        .withColumn("change", F.col("score") - F.col("_before")).drop("_before")
        .where("change <> 0")
    )
    return previous_within(
        moves, ["conv_id"], "turn_index", "change", "previous_change", hot_rows
    ).where(F.signum("change") != F.signum("previous_change"))


def severity_ranking_with_example(conversations: DataFrame, round_digits: int = 3) -> DataFrame:
    """Topics by mean sentiment (worst first), escalation rate, size; one example each."""
    per_topic = conversations.groupBy("topic").agg(
        F.count("*").alias("count"),
        F.round(F.avg("customer_sentiment_overall"), round_digits).alias("avg_sentiment"),
        F.round(F.avg("escalation_flag"), round_digits).alias("escalation_rate"),
    )
    examples = topic_example(conversations).withColumnRenamed("conv_id", "example_conv_id")
    return per_topic.join(examples, "topic").orderBy(
        F.col("avg_sentiment").asc_nulls_last(), F.desc("escalation_rate"), F.desc("count"), "topic"
    )


def high_volume_low_resolution(conversations: DataFrame, round_digits: int = 3) -> DataFrame:
    """Topics at or above the mean size whose resolution rate is at or below the overall one."""
    per_topic = conversations.groupBy("topic").agg(
        F.count("*").alias("count"), F.sum("resolution_flag").alias("resolved")
    )
    # The window sees one row per topic.
    topics = Window.partitionBy(F.lit(0))
    overall_rate = F.sum("resolved").over(topics) / F.sum("count").over(topics)
    return (
        per_topic.withColumns({
            "mean_count": F.avg("count").over(topics),
            "overall_rate": overall_rate,
            "rate": F.col("resolved") / F.col("count"),
        })
        .where("count >= mean_count AND rate <= overall_rate")
        .select("topic", "count", F.round("rate", round_digits).alias("resolution_rate"))
    )


def app_crashes_in_language(
    vectors: DataFrame, embedder, conversations: DataFrame, turns: DataFrame,
    language: str = "hi", k: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """Conversations in a language about app crashes, and the transcript of the best one."""
    hits = _asked(vectors, embedder, "app crash ho rahi hai while using", k, language=language)
    best = hits.where("rank = 1").select("conv_id")
    return hits, conversation_transcript(conversations, turns, F.broadcast(best))


def billing_and_refund_problems(vectors: DataFrame, embedder, k: int = 5) -> DataFrame:
    """Conversations in any language about billing and refunds."""
    return _asked(vectors, embedder, "billing aur refund ki problems, charged twice", k)


def frustrated_after_escalation(
    vectors: DataFrame, embedder, conversations: DataFrame, k: int = 5
) -> DataFrame:
    """Escalated, unresolved conversations whose customers sound frustrated."""
    unresolved = filter_conversations(conversations, escalation=True, resolution=False)
    open_ = vectors.join(unresolved.select("conv_id"), "conv_id", "left_semi")
    return _asked(open_, embedder, "frustrated, escalate, still not resolved", k, escalation=True)


def _asked(vectors: DataFrame, embedder, text: str, k: int, **filters) -> DataFrame:
    asked = vectors.sparkSession.createDataFrame([("q", text)], "query_id string, query string")
    return semantic_search(vectors, asked, embedder, k, **filters).drop("query_id")


def urgent_turns_by_language(turns: DataFrame, language: str) -> DataFrame:
    """Customer turns that ask for urgency, in one language."""
    return turns.where(
        (F.col("role") == "customer") & (F.col("intent") == "urgency_request")
        & (F.col("language") == language)
    ).select("conv_id", "turn_index", "language", "sentiment_score", "text_clean")


def agent_drilldown(
    agents: DataFrame, conversations: DataFrame, turns: DataFrame, names: Sequence[str]
) -> DataFrame:
    """Agents with the transcript of their first conversation each."""
    chosen = compare_agents(agents, names)
    first = (
        conversations.where(F.col("agent_name").isin(*names))
        .groupBy("agent_name").agg(F.min("conv_id").alias("conv_id"))
    )
    # One row per name, so small enough to broadcast.
    ids = F.broadcast(first.select("conv_id"))
    transcript = conversation_transcript(conversations, turns, ids).select(
        "conv_id", "part", "agent_name", "start_ts", "topic", "turns"
    )
    return chosen.join(transcript, "agent_name", "left")


def escalated_not_resolved(
    conversations: DataFrame, turns: DataFrame, topic: str
) -> DataFrame:
    """Escalated, unresolved conversations of a topic, with the customer's worst turn."""
    check = filter_conversations(conversations, topic=topic, escalation=True, resolution=False)
    low = F.struct("sentiment_score", "turn_index")
    # Only the turns of these conversations are aggregated.
    quotes = (
        turns.where("role = 'customer' AND sentiment_score IS NOT NULL")
        .join(check.select("conv_id"), "conv_id", "left_semi")
        .groupBy("conv_id")
        .agg(F.min_by(F.struct("turn_index", "sentiment_score", "text_clean"), low).alias("quote"))
    )
    return check.join(quotes, "conv_id", "left").select(
        "conv_id", "agent_name", "customer_sentiment_overall",
        F.col("quote.turn_index").alias("quote_turn_index"),
        F.col("quote.sentiment_score").alias("quote_score"),
        F.col("quote.text_clean").alias("quote"),
    )


