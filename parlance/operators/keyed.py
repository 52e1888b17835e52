"""Joins, numbering and look-back that stay balanced when one key is hot.

A key (a text, a conversation, a session) may hold a large share of all rows.
Joins are plain ones, whose hot partitions adaptive execution splits. Numbering
and look-back are plain windows while no key is hot; else they are prefix scans
over ranges of (key, order).
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.schema import TURN_BLOCK
from parlance.sources.scratch import stored

# A table is broadcast only if it was measured to be within both bounds.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 128 * 1024 * 1024

# A key with more rows than this is hot: its rows are spread over several tasks.
HOT_ROWS = 1_000_000


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Measure a stored table: is it small enough to broadcast? One row per task is moved."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    lists = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    width = F.lit(8 * len(df.columns))
    for name in texts:
        width = width + F.coalesce(F.octet_length(name), F.lit(0))
    for name in lists:
        width = width + 8 * F.coalesce(F.size(name), F.lit(0))
    size = df.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")
    ).first()
    return size["n"] <= max_rows and size["bytes"] <= max_bytes


def lookup_join(
    facts: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left", measure: bool = False
) -> DataFrame:
    """Join facts to a lookup that has one row per key.

    With `measure`, a stored lookup that is small is broadcast, and the facts are
    not shuffled. Otherwise it is a plain join: nothing is copied for cold keys,
    and a hot key's partition is split by the skew join of adaptive execution.
    """
    if measure and fits_broadcast(lookup):
        lookup = F.broadcast(lookup)
    return facts.join(lookup, list(on), how)


def with_digest(df: DataFrame, text: str) -> DataFrame:
    """Add 128 bits that stand for a text, so that no join or grouping has texts as keys."""
    return df.withColumns({
        "_d1": F.xxhash64(F.col(text)), "_d2": F.xxhash64(F.lit(1), F.col(text))
    })


def block_of(index: Column, block: int = TURN_BLOCK) -> Column:
    """Number of the block that holds an integer index."""
    return F.floor(index / F.lit(block)).cast("long")


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on keys that may be null; the right table's keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, same, how).drop(*(f"_r_{k}" for k in keys))


def _ranges(df: DataFrame, keys: Sequence[str], hot_rows: int) -> int:
    """0 if no key has more rows than `hot_rows`; else how many ranges of so many rows there are."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    size = counts.agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    return -(-size["all"] // hot_rows) if (size["most"] or 0) > hot_rows else 0


def _in_ranges(df: DataFrame, keys: Sequence[str], order: str, ranges: int) -> DataFrame:
    """The rows dealt by ranges of (keys, order) and stored, with the number of their range.

    Stored, so that all that follows sees the same ranges and the input is not read again.
    """
    dealt = df.repartitionByRange(ranges, *keys, order)
    return stored(dealt.withColumn("_range", F.spark_partition_id()))


def number_within(
    df: DataFrame, keys: Sequence[str], order: str, into: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """0-based position of each row within its key, by a unique integer column.

    The rows per key are measured first. With a hot key, positions are counted inside
    ranges of (key, order), and a key that goes on in the next range hands its count over;
    only such keys, fewer than there are ranges, have a row to hand over.
    """
    keys = list(keys)
    ranges = _ranges(df, keys, hot_rows)
    if not ranges:
        place = Window.partitionBy(*keys).orderBy(order)
        return df.withColumn(into, F.row_number().over(place).cast("long") - 1)
    rows = _in_ranges(df, keys, order, ranges)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    handed = (
        rows.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(earlier)).where("_before > 0").drop("_n")
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order))
    return (
        _null_safe(rows.withColumn("_inside", inside), handed, [*keys, "_range"], "left")
        .withColumn(into, F.coalesce("_before", F.lit(0)) + F.col("_inside") - 1)
        .drop("_range", "_inside", "_before")
    )


def previous_within(
    df: DataFrame, keys: Sequence[str], order: str, value: str, into: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Value of the row before, within a key, by a unique integer column.

    `value` must not be NULL. As in number_within; a range hands on its last value.
    """
    keys = list(keys)
    ranges = _ranges(df, keys, hot_rows)
    if not ranges:
        return df.withColumn(into, F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))
    rows = _in_ranges(df, keys, order, ranges)
    handed = (
        rows.groupBy(*keys, "_range").agg(F.max_by(value, order).alias("_last"))
        .withColumn("_handed", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_range")))
        .where("_handed IS NOT NULL").drop("_last")
    )
    inside = F.lag(value).over(Window.partitionBy(*keys, "_range").orderBy(order))
    return (
        _null_safe(rows.withColumn("_inside", inside), handed, [*keys, "_range"], "left")
        .withColumn(into, F.coalesce("_inside", "_handed"))
        .drop("_range", "_inside", "_handed")
    )
