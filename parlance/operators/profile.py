"""Counts and distributions that describe a data set."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_counts(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Rows of both tables, distinct agents and distinct cleaned texts, as (metric, n).

    Each metric is its own scan of one column.
    """
    counted = {
        "turns": turns.select("conv_id"),
        "conversations": conversations.select("conv_id"),
        "distinct_agents": turns.select("agent_name").where("agent_name IS NOT NULL").distinct(),
        "distinct_texts": turns.select("text_clean").where("text_clean IS NOT NULL").distinct(),
    }
    return reduce(DataFrame.unionByName, [
        rows.agg(F.count("*").alias("n")).select(F.lit(metric).alias("metric"), "n")
        for metric, rows in counted.items()
    ])


def label_distribution(turns: DataFrame) -> DataFrame:
    """Turns per language and per sentiment label, as (label, value, n); NULL is a value."""
    pairs = turns.groupBy("language", "sentiment_label").agg(F.count("*").alias("n"))
    entries = F.array(
        F.struct(F.lit("language").alias("label"), F.col("language").alias("value")),
        F.struct(F.lit("sentiment_label").alias("label"), F.col("sentiment_label").alias("value")),
    )
    return (
        pairs.select(F.explode(entries).alias("e"), "n")
        .groupBy("e.label", "e.value").agg(F.sum("n").alias("n"))
    )


def agent_empathy_distribution(turns: DataFrame) -> DataFrame:
    """Agent turns per empathy label."""
    return (
        turns.where("role = 'agent'").groupBy("empathy_signal").agg(F.count("*").alias("n"))
    )


def date_range(conversations: DataFrame) -> DataFrame:
    """First and last conversation start."""
    return conversations.agg(
        F.min("start_ts").alias("min_start_ts"), F.max("start_ts").alias("max_start_ts")
    )


def agents_by_conv_count(turns: DataFrame) -> DataFrame:
    """How many agents have how many conversations."""
    return (
        turns.where("agent_name IS NOT NULL")
        .select("agent_name", "conv_id").distinct()
        .groupBy("agent_name").agg(F.count("*").alias("conv_count"))
        .groupBy("conv_count").agg(F.count("*").alias("n_agents"))
    )
