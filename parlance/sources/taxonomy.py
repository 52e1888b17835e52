"""The topic taxonomy as lookup tables."""

from collections.abc import Iterable, Mapping

from pyspark.sql import SparkSession

from parlance import constants as C
from parlance.operators.topics import Topics

# The tables come from the driver's memory; up to so many bytes in all they are
# small enough to broadcast.
BROADCAST_BYTES = 16 * 1024 * 1024


def taxonomy_tables(
    spark: SparkSession,
    categories: Iterable[tuple[str, str, str]] = C.CATEGORIES,
    slots: Mapping[str, str] = C.SLOT_TO_CATEGORY,
    openers: Mapping[str, str] = C.OPENER_TO_CATEGORY,
) -> Topics:
    """Categories, slot map and opener map as DataFrames."""
    categories = list(categories)
    rows = [*categories, *slots.items(), *openers.items()]
    size = sum(16 + len(str(value).encode()) for row in rows for value in row)
    return Topics(
        categories=spark.createDataFrame(
            categories, "id string, label string, description string"
        ),
        slots=spark.createDataFrame(list(slots.items()), "slot string, category string"),
        openers=spark.createDataFrame(
            list(openers.items()), "opener string, category string"
        ),
        small=size <= BROADCAST_BYTES,
    )
