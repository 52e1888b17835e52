"""Filtered, grouped and per-conversation queries over the rollup tables."""

import re
from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance import constants as C
from parlance.operators.documents import header_per_part
from parlance.operators.keyed import block_of, lookup_join
from parlance.operators.topics import Topics
from parlance.schema import TURN_BLOCK

LIST_COLUMNS = (
    "conv_id", "customer_name", "agent_name", "start_ts", "end_ts", "turn_count", "topic",
    "customer_sentiment_overall", "resolution_flag", "escalation_flag", "agent_empathy_mean",
)
TRAJECTORY_HEADER = (
    "topic", "customer_sentiment_overall", "resolution_flag", "escalation_flag",
)
TRAJECTORY_FIELDS = (
    "turn_index", "role", "sentiment_label", "sentiment_score", "intent", "empathy_signal",
    "text_clean",
)
TRANSCRIPT_HEADER = (
    "customer_name", "agent_name", "start_ts", "end_ts", "topic",
    "customer_sentiment_overall", "resolution_flag", "escalation_flag",
)
TRANSCRIPT_FIELDS = (
    "turn_index", "role", "timestamp", "text_clean", "text_clean_en", "language",
    "sentiment_label", "sentiment_score", "intent", "empathy_signal", "is_escalation",
    "contains_pii",
)


def check_choice(name: str, value, allowed: Sequence) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {list(allowed)}, not {value!r}")


def check_range(name: str, value: int, low: int, high: int | None = None) -> None:
    if value < low or (high is not None and value > high):
        raise ValueError(f"{name} must be from {low} to {high or 'any'}, not {value!r}")


def ordered(column: Column, order: str) -> Column:
    """NULL counts as the smallest value in both directions."""
    check_choice("order", order, ("asc", "desc"))
    return column.asc_nulls_first() if order == "asc" else column.desc_nulls_last()


def _month_bounds(month: str) -> tuple[date, date]:
    if not re.fullmatch(r"\d{4}-\d{2}", month):
        raise ValueError(f"month must look like 2025-11, not {month!r}")
    first = date(int(month[:4]), int(month[5:]), 1)
    return first, (first + timedelta(days=31)).replace(day=1)


def filter_conversations(
    conversations: DataFrame,
    turns: DataFrame | None = None,
    *,
    month: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    topic: str | None = None,
    sentiment_max: float | None = None,
    sentiment_min: float | None = None,
    escalation: bool | None = None,
    resolution: bool | None = None,
    agent: str | None = None,
    language: str | None = None,
) -> DataFrame:
    """Conversations that meet all given conditions; empty text counts as not given.

    Time conditions are plain ranges over start_ts, so they reach the scan; a
    table stored by month is read in the months concerned only. A `language`
    keeps conversations with any turn in it and needs `turns`.
    """
    start, sentiment = F.col("start_ts"), F.col("customer_sentiment_overall")
    wanted: list[Column] = []
    if month:
        first, after = _month_bounds(month)
        wanted += [start >= F.lit(first).cast("timestamp"), start < F.lit(after).cast("timestamp")]
    if date_from:
        wanted.append(start >= F.lit(date_from).cast("timestamp"))
    if date_to:
        after = date.fromisoformat(date_to) + timedelta(days=1)
        wanted.append(start < F.lit(after).cast("timestamp"))
    if "month" in conversations.columns:
        if month:
            wanted.append(F.col("month") == month)
        if date_from:
            wanted.append(F.col("month") >= date_from[:7])
        if date_to:
            wanted.append(F.col("month") <= date_to[:7])
    if topic:
        wanted.append(F.col("topic") == topic)
    if sentiment_max is not None:
        wanted.append(sentiment <= sentiment_max)
    if sentiment_min is not None:
        wanted.append(sentiment >= sentiment_min)
    if escalation is not None:
        wanted.append(F.col("escalation_flag") == int(escalation))
    if resolution is not None:
        wanted.append(F.col("resolution_flag") == int(resolution))
    if agent:
        wanted.append(F.col("agent_name") == agent)
    kept = conversations
    for condition in wanted:
        kept = kept.where(condition)
    if language:
        check_choice("language", language, C.LANGUAGE_LABELS)
        if turns is None:
            raise ValueError("a language filter needs the turns")
        spoken = turns.where(F.col("language") == language).select("conv_id").distinct()
        kept = kept.join(spoken, "conv_id", "left_semi")
    return kept


def list_conversations(
    conversations: DataFrame, order_by: str = "start_ts", order: str = "desc", limit: int = 10
) -> DataFrame:
    """First conversations by one of the allowed columns (else start_ts), ties by conv_id."""
    check_range("limit", limit, 1, C.MAX_LIMIT)
    column = order_by if order_by in C.LIST_ORDER_COLUMNS else "start_ts"
    return (
        conversations.select(*LIST_COLUMNS)
        .orderBy(ordered(F.col(column), order), "conv_id").limit(limit)
    )


def opening_language(turns: DataFrame) -> DataFrame:
    """Language of each conversation's first turn."""
    return turns.groupBy("conv_id").agg(F.min_by("language", "turn_index").alias("language"))


def aggregate_conversations(
    conversations: DataFrame,
    group_by: str,
    metrics: Sequence[str] = ("count",),
    order_by: str | None = None,
    order: str = "desc",
    limit: int = 10,
    round_digits: int = 3,
    turns: DataFrame | None = None,
) -> DataFrame:
    """Metrics per group, ordered by a requested metric (else the first), ties by key.

    Grouping by language uses the opening turn's and needs `turns`.
    """
    check_choice("group_by", group_by, C.GROUP_KEYS)
    check_range("limit", limit, 1, C.MAX_LIMIT)
    if not metrics:
        raise ValueError("metrics must not be empty")
    for metric in metrics:
        check_choice("metric", metric, C.METRICS)

    if group_by == "language":
        if turns is None:
            raise ValueError("grouping by language needs the turns")
        rows = conversations.join(opening_language(turns), "conv_id", "left")
        key = F.col("language")
    elif group_by == "month":
        rows, key = conversations, F.date_format("start_ts", "yyyy-MM")
    else:
        rows, key = conversations, F.col(group_by)

    def mean(column: str) -> Column:
        return F.round(F.avg(column), round_digits)

    columns = {
        "count": F.count("*"),
        "avg_sentiment": mean("customer_sentiment_overall"),
        "avg_empathy": mean("agent_empathy_mean"),
        "escalation_rate": mean("escalation_flag"),
        "resolution_rate": mean("resolution_flag"),
    }
    lead = order_by if order_by in metrics else metrics[0]
    return (
        rows.groupBy(key.alias("group_key"))
        .agg(*[columns[m].alias(m) for m in metrics])
        .orderBy(ordered(F.col(lead), order), F.col("group_key").asc_nulls_first())
        .limit(limit)
    )


def rank_agents(
    agents: DataFrame,
    min_conv_count: int = 1,
    sort_by: str = "empathy_mean",
    order: str = "asc",
    limit: int = 10,
) -> DataFrame:
    """Agents with enough conversations, by one of five columns, ties by name."""
    check_range("min_conv_count", min_conv_count, 1)
    check_choice("sort_by", sort_by, C.AGENT_SORT_COLUMNS)
    check_range("limit", limit, 1, C.MAX_LIMIT)
    return (
        agents.where(F.col("conv_count") >= min_conv_count)
        .orderBy(ordered(F.col(sort_by), order), "agent_name").limit(limit)
    )


def _chosen(df: DataFrame, conv_ids: Sequence[str] | DataFrame | None) -> DataFrame:
    """Rows of the given conversations. A table of ids is joined as its size allows."""
    if conv_ids is None:
        return df
    if isinstance(conv_ids, DataFrame):
        wanted = conv_ids.select("conv_id").distinct()
        return df.join(wanted, "conv_id", "left_semi")
    return df.where(F.col("conv_id").isin(*conv_ids))


def _with_turns(
    conversations: DataFrame, header: Sequence[str], turns: DataFrame,
    fields: Sequence, conv_ids: Sequence[str] | DataFrame | None, block: int,
) -> DataFrame:
    """Header columns and sorted turn structs, one row per (conv_id, part)."""
    chosen = _chosen(turns, conv_ids)
    heads = _chosen(conversations, conv_ids).select("conv_id", *header)
    nested = (
        chosen.groupBy("conv_id", block_of(F.col("turn_index"), block).alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("turns"))
    )
    return nested.join(header_per_part(heads, chosen, block), ["conv_id", "part"])


def conversation_trajectory(
    conversations: DataFrame,
    turns: DataFrame,
    conv_ids: Sequence[str] | DataFrame | None = None,
    block: int = TURN_BLOCK,
) -> DataFrame:
    """Header, customer arc and labelled turns, for given ids or for all.

    One row per conversation; one longer than a block takes further parts. An
    unknown id has no row.
    """
    found = _with_turns(conversations, TRAJECTORY_HEADER, turns, TRAJECTORY_FIELDS, conv_ids, block)
    scored = F.filter(
        "turns", lambda t: (t["role"] == "customer") & t["sentiment_score"].isNotNull()
    )
    return found.select(
        "conv_id", "part", *TRAJECTORY_HEADER,
        F.transform(scored, lambda t: t["sentiment_score"]).alias("customer_arc"), "turns",
    )


def conversation_transcript(
    conversations: DataFrame,
    turns: DataFrame,
    conv_ids: Sequence[str] | DataFrame | None = None,
    include_translation: bool = False,
    block: int = TURN_BLOCK,
) -> DataFrame:
    """Header and all turn fields, for given ids or for all; parts as in trajectories."""
    translation = F.col("text_clean_en") if include_translation else F.lit(None).cast("string")
    fields = [
        translation.alias(f) if f == "text_clean_en" else F.col(f) for f in TRANSCRIPT_FIELDS
    ]
    found = _with_turns(conversations, TRANSCRIPT_HEADER, turns, fields, conv_ids, block)
    return found.select("conv_id", "part", *TRANSCRIPT_HEADER, "turns")


def topic_counts(conversations: DataFrame, topics: Topics) -> DataFrame:
    """Every category of the taxonomy with its number of conversations, zero included."""
    counts = conversations.groupBy(F.col("topic").alias("id")).agg(F.count("*").alias("n"))
    return topics.categories.join(counts, "id", "left").select(
        "id", "label", "description", F.coalesce("n", F.lit(0)).alias("count_in_dataset")
    )


def topic_example(conversations: DataFrame) -> DataFrame:
    """The most negative conversation of each topic, ties by conv_id; NULL without scores.

    First the lowest score of each topic, then the least id at that score: both
    are hash aggregates, and no partition of conversations is sorted.
    """
    score = F.col("customer_sentiment_overall")
    lowest = conversations.groupBy(F.col("topic").alias("_topic")).agg(F.min(score).alias("_low"))
    at_lowest = conversations.select("topic", "conv_id", score.alias("_score")).join(
        lowest, F.col("topic").eqNullSafe(F.col("_topic")) & (F.col("_score") == F.col("_low")), "left_semi"
    )
    found = at_lowest.groupBy(F.col("topic").alias("_found")).agg(F.min("conv_id").alias("conv_id"))
    return lowest.join(found, F.col("_topic").eqNullSafe(F.col("_found")), "left").select(
        F.col("_topic").alias("topic"), "conv_id"
    )


def list_topics(
    conversations: DataFrame, topics: Topics, with_examples: bool = False
) -> DataFrame:
    """topic_counts, with an example conversation each if asked for."""
    counts = topic_counts(conversations, topics)
    if not with_examples:
        return counts
    examples = topic_example(conversations).select(
        F.col("topic").alias("id"), F.col("conv_id").alias("example_conv_id")
    )
    return counts.join(examples, "id", "left")
