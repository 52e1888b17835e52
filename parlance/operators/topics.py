"""Topics of conversation openers."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance import constants as C
from parlance.functions.openers import extract_slot, plain_apostrophes
from parlance.functions.scores import present
from parlance.operators.keyed import lookup_join


@dataclass(frozen=True)
class Topics:
    """The taxonomy as tables.

    categories: id, label, description. slots: slot, category.
    openers: opener, category. `small` says that the sizes were checked, so the
    tables may be broadcast; otherwise hot openers and slots are salted.
    """

    categories: DataFrame
    slots: DataFrame
    openers: DataFrame
    small: bool = False

    def look_up(self, df: DataFrame, table: DataFrame, on: str, how: str = "left") -> DataFrame:
        if self.small:
            return df.join(F.broadcast(table), on, how)
        return lookup_join(df, table, [on], how)


def match_no_slot(df: DataFrame, opener: str, topics: Topics, into: str = "opener_category") -> DataFrame:
    """Add the category of an opener without a slot; both apostrophe forms match."""
    # Should both forms be listed with different categories, the first by name counts.
    openers = topics.openers.groupBy(
        plain_apostrophes(F.col("opener")).alias("_plain")
    ).agg(F.min("category").alias(into))
    asked = df.withColumn("_plain", plain_apostrophes(F.col(opener)))
    return topics.look_up(asked, openers, "_plain").drop("_plain")


def resolve_topic(df: DataFrame, opener: str, topics: Topics, into: str = "topic") -> DataFrame:
    """Add the topic of an opener: by its whole text, else by its slot, else unknown."""
    slot, template = extract_slot(F.col(opener))
    slots = topics.slots.select(
        F.col("slot").alias("_slot"), F.col("category").alias("_by_slot")
    )
    matched = match_no_slot(df, opener, topics, into="_by_opener")
    known = F.when(template == C.NO_SLOT_TEMPLATE, F.col("_by_opener"))
    return (
        topics.look_up(matched.withColumn("_slot", slot), slots, "_slot")
        .withColumn(
            into,
            F.coalesce(present(known), present(F.col("_by_slot")), F.lit(C.UNKNOWN_TOPIC)),
        )
        .drop("_slot", "_by_slot", "_by_opener")
    )


def distinct_openers(turns: DataFrame) -> DataFrame:
    """Distinct cleaned texts with which customers open conversations."""
    return (
        turns.where((F.col("role") == "customer") & (F.col("turn_index") == 0))
        .select("text_clean").distinct()
    )


def taxonomy_coverage(turns: DataFrame, topics: Topics) -> DataFrame:
    """What the openers need and the taxonomy lacks, as distinct (kind, value).

    Kinds: slot (seen in an opener), unmatched_opener (no template),
    unmapped_slot (no category), unknown_category (mapped to, but not defined).
    """
    slot, template = extract_slot(F.col("text_clean"))
    openers = distinct_openers(turns).select(
        "text_clean", slot.alias("slot"), template.alias("template")
    )
    mapped = topics.look_up(openers, topics.slots, "slot")
    findings = F.array_compact(F.array(
        F.when(F.col("slot").isNotNull(), _finding("slot", "slot")),
        F.when(F.col("template").isNull(), _finding("unmatched_opener", "text_clean")),
        F.when(F.col("slot").isNotNull() & F.col("category").isNull(),
               _finding("unmapped_slot", "slot")),
    ))
    seen = mapped.select(F.explode(findings).alias("f")).select("f.*").distinct()
    used = topics.slots.select(F.col("category").alias("id")).distinct()
    undefined = used.join(topics.categories, "id", "left_anti").select(
        F.lit("unknown_category").alias("kind"), F.col("id").alias("value")
    )
    return seen.unionByName(undefined)


def _finding(kind: str, value: str):
    return F.struct(F.lit(kind).alias("kind"), F.col(value).alias("value"))


def category_slot_counts(topics: Topics) -> DataFrame:
    """Slots mapped to each category, zero included."""
    counts = topics.slots.groupBy(F.col("category").alias("id")).agg(
        F.count("slot").alias("n")
    )
    return topics.categories.join(counts, "id", "left").select(
        "id", "label", F.coalesce("n", F.lit(0)).alias("n_slots")
    )
