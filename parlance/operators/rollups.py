"""Rollups from turns to conversations and from conversations to agents."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance import constants as C
from parlance.functions.scores import closes_conversation, empathy_score, present
from parlance.operators.keyed import block_of
from parlance.operators.topics import Topics, resolve_topic
from parlance.schema import TURN_BLOCK

CONVERSATION_COLUMNS = (
    "conv_id", "customer_name", "agent_name", "start_ts", "end_ts", "turn_count", "topic",
    "customer_sentiment_overall", "sentiment_trajectory", "resolution_flag",
    "escalation_flag", "agent_empathy_mean", "contains_pii_any",
)


def _customer_score():
    return F.when(F.col("role") == "customer", F.col("sentiment_score"))


def _resolution(turns: DataFrame) -> DataFrame:
    """conv_id, resolution_flag: does one of the last two turns close it?

    The rank limit is applied on the map side too, so a conversation sends two
    rows per input partition however long it is.
    """
    from_end = Window.partitionBy("conv_id").orderBy(F.desc("turn_index"))
    closes = closes_conversation(F.col("role"), F.col("intent"))
    return (
        turns.select("conv_id", "turn_index", closes.alias("closes"))
        .withColumn("_rank", F.row_number().over(from_end))
        .where("_rank <= 2")
        .groupBy("conv_id").agg(F.max("closes").alias("resolution_flag"))
    )


def conversation_rollup(turns: DataFrame, topics: Topics) -> DataFrame:
    """One row per conversation, from turns with a unique (conv_id, turn_index).

    Everything but the last-two rule is one aggregate with partial sums on the
    map side. The trajectory holds every customer score, whatever the length (see
    sentiment_trajectory_parts for rows of bounded size).
    """
    turn = F.col("turn_index")
    is_customer = F.col("role") == "customer"
    is_agent = F.col("role") == "agent"
    scored = is_customer & F.col("sentiment_score").isNotNull()
    first_name = {
        name: F.min_by(name, F.when(present(F.col(name)).isNotNull(), turn))
        for name in ("customer_name", "agent_name")
    }
    folded = turns.groupBy("conv_id").agg(
        first_name["customer_name"].alias("customer_name"),
        first_name["agent_name"].alias("agent_name"),
        F.min("timestamp").alias("start_ts"),
        F.max("timestamp").alias("end_ts"),
        F.count("*").alias("turn_count"),
        F.min_by("text_clean", F.when(is_customer, turn)).alias("_opener"),
        F.avg(_customer_score()).alias("customer_sentiment_overall"),
        F.collect_list(F.when(scored, F.struct("turn_index", "sentiment_score"))).alias("_scores"),
        F.max(F.when(F.col("is_escalation") == 1, 1).otherwise(0)).alias("escalation_flag"),
        F.avg(F.when(is_agent, empathy_score(F.col("empathy_signal"))))
        .alias("agent_empathy_mean"),
        F.max(F.when(F.col("contains_pii") == 1, 1).otherwise(0)).alias("contains_pii_any"),
    )
    in_order = F.transform(F.array_sort("_scores"), lambda s: s["sentiment_score"])
    return (
        resolve_topic(folded.join(_resolution(turns), "conv_id"), "_opener", topics)
        .withColumn("sentiment_trajectory", in_order)
        .select(*CONVERSATION_COLUMNS)
    )


def sentiment_trajectory_parts(turns: DataFrame, block: int = TURN_BLOCK) -> DataFrame:
    """Customer scores in turn order, as (conv_id, part, scores).

    A part covers one block of turn indexes, so conversations of any length are
    whole; concatenate the parts in order.
    """
    return (
        turns.where(_customer_score().isNotNull())
        .groupBy("conv_id", block_of(F.col("turn_index"), block).alias("part"))
        .agg(F.collect_list(F.struct("turn_index", "sentiment_score")).alias("_scores"))
        .select(
            "conv_id", "part",
            F.transform(F.array_sort("_scores"), lambda s: s["sentiment_score"]).alias("scores"),
        )
    )


def agent_rollup(conversations: DataFrame, turns: DataFrame, top: int = 3) -> DataFrame:
    """One row per agent named in a conversation, from conversations and all turns."""
    score = empathy_score(F.col("empathy_signal"))
    sums = (
        turns.where("role = 'agent' AND agent_name IS NOT NULL")
        .groupBy("agent_name").agg(F.sum(score).alias("total"), F.count(score).alias("n"))
    )
    return agent_rollup_from(conversations, sums, top)


def agent_rollup_from(conversations: DataFrame, empathy: DataFrame, top: int = 3) -> DataFrame:
    """One row per agent, from conversations and sums (agent_name, total, n) of empathy scores.

    Conversations are first summed per (agent, topic), which splits a busy agent
    and leaves a few rows per agent to rank. Empathy is the mean over all of the
    agent's turns, not over conversation means.
    """
    topic = F.coalesce(present(F.col("topic")), F.lit(C.UNKNOWN_TOPIC))
    per_topic = (
        conversations.where("agent_name IS NOT NULL")
        .groupBy("agent_name", topic.alias("topic"))
        .agg(
            F.count("*").alias("n"),
            F.min("conv_id").alias("first_conv"),
            F.sum("customer_sentiment_overall").alias("sentiment"),
            F.count("customer_sentiment_overall").alias("n_sentiment"),
            F.sum(F.coalesce("resolution_flag", F.lit(0))).alias("resolved"),
            F.sum(F.coalesce("escalation_flag", F.lit(0))).alias("escalated"),
        )
    )
    common_first = Window.partitionBy("agent_name").orderBy(F.desc("n"), "first_conv")
    topic_entry = F.struct("_rank", "topic", "n")
    per_agent = (
        per_topic.withColumn("_rank", F.row_number().over(common_first))
        .groupBy("agent_name")
        .agg(
            F.sum("n").alias("conv_count"),
            F.try_divide(F.sum("sentiment"), F.sum("n_sentiment")).alias("avg_customer_sentiment"),
            (F.sum("resolved") / F.sum("n")).alias("resolution_rate"),
            (F.sum("escalated") / F.sum("n")).alias("escalation_rate"),
            F.collect_list(F.when(F.col("_rank") <= top, topic_entry)).alias("_topics"),
        )
    )
    means = empathy.groupBy("agent_name").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("empathy_mean"))
    ranked = F.transform(
        F.array_sort("_topics"),
        lambda t: F.struct(t["topic"].alias("topic"), t["n"].alias("n")),
    )
    return per_agent.join(means, "agent_name", "left").select(
        "agent_name", "conv_count", "avg_customer_sentiment", "empathy_mean",
        "resolution_rate", "escalation_rate", ranked.alias("top_topics"),
    )
