"""Packing by optimal length buckets.

One histogram of all lengths, with a bounded number of bins, goes to the driver.
A dynamic program over it chooses the bucket boundaries with the least padding:
every document is padded to the boundary of its bucket. Inside a bucket, batches
of documents fill a token budget.

Defined results: a null text has length 0; a document longer than the budget is
a batch of its own; no document is cut or dropped; rows that repeat are packed
each on its own; an empty table gives an empty result.
"""

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import stored
from parlance.llm.sizes import with_word_counts


@dataclass(frozen=True)
class Buckets:
    """Up to `buckets` lengths to pad to; `budget` padded tokens a batch.

    Batches form inside blocks of about `block_rows` documents of a bucket, so
    that no task holds a whole bucket; one batch of each block may be short.
    Lengths up to 2 ** exact_bits have a histogram bin each, longer ones share
    bins of 1 / 64 of their size.
    """

    buckets: int = 16
    budget: int = 16_384
    block_rows: int = 20_000
    exact_bits: int = 12
    seed: int = 5


def length_bin(length: Column, exact_bits: int) -> Column:
    """A bin number that grows with the length; there are at most a few thousand."""
    power = F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double"))).cast("int")
    shift = F.greatest(power - exact_bits + 1, F.lit(0))
    wide = F.floor(length / F.pow(F.lit(2.0), power - 6)).cast("long")
    return F.when(shift == 0, length).otherwise(
        F.lit(1 << exact_bits) + 64 * (power - exact_bits) + wide - 64
    )


def best_boundaries(tops: Sequence[int], counts: Sequence[int], buckets: int) -> list[int]:
    """Boundaries, out of the bins' largest lengths, that give the least padding.

    cost[k][i], the least padded total of the first i bins in k buckets, is the
    minimum over j of cost[k - 1][j] + tops[i] * (documents in bins j to i).
    """
    tops_, before = np.asarray(tops, float), np.concatenate(([0.0], np.cumsum(counts, dtype=float)))
    n = len(tops_)
    cost = np.concatenate(([0.0], tops_ * before[1:]))
    choice = [np.zeros(n + 1, int)]
    for _ in range(1, min(buckets, n)):
        nxt, chosen = np.zeros(n + 1), np.zeros(n + 1, int)
        for i in range(1, n + 1):
            options = cost[:i] - tops_[i - 1] * before[:i]
            chosen[i] = j = int(options.argmin())
            nxt[i] = options[j] + tops_[i - 1] * before[i]
        cost = nxt
        choice.append(chosen)
    found, i = [], n
    for chosen in reversed(choice):
        if i > 0:
            found.append(int(tops[i - 1]))
            i = int(chosen[i])
    return found[::-1]


def boundaries(lengths: DataFrame, how: Buckets) -> list[int]:
    """The bucket boundaries for a table with a column `length`."""
    bins = (
        lengths.groupBy(length_bin(F.col("length"), how.exact_bits).alias("bin"))
        .agg(F.max("length").alias("top"), F.count("*").alias("n")).orderBy("bin").collect()
    )
    return best_boundaries([r["top"] for r in bins], [r["n"] for r in bins], how.buckets)


def pack(
    docs: DataFrame, text: str = "text", id: str = "doc_id", length: str | None = None,
    how: Buckets = Buckets(),
) -> DataFrame:
    """Per document: id, length, bucket_len, block, batch, slot, padding.

    (bucket_len, block, batch) names a batch. `length` is a column of token
    counts; without one, words are counted.
    """
    rows = docs.select(
        F.col(id).alias("id"), F.xxhash64(F.lit(how.seed), F.col(id), F.col(text)).alias("hash"),
        (F.col(length).cast("long") if length else F.col(text)).alias("length"),
    )
    sized = stored(
        rows.withColumn("length", F.greatest(F.coalesce("length", F.lit(0)), F.lit(0)))
        if length else with_word_counts(rows, "length", "length")
    )
    tops = boundaries(sized, how)
    if not tops:
        tops = [0]
    ends = F.array(*(F.lit(t).cast("long") for t in tops))
    placed = sized.withColumn(
        "bucket_len", F.element_at(F.filter(ends, lambda top: top >= F.col("length")), 1)
    )
    found = {r["bucket_len"]: r["n"] for r in placed.groupBy("bucket_len").agg(F.count("*").alias("n")).collect()}
    blocks = F.array(*(F.lit(-(-found.get(t, 1) // how.block_rows)).cast("long") for t in tops))
    many = F.element_at(blocks, F.array_position(ends, F.col("bucket_len")).cast("int"))
    in_batch = F.greatest(F.floor(F.lit(how.budget) / F.greatest("bucket_len", F.lit(1))), F.lit(1))
    place = F.row_number().over(Window.partitionBy("bucket_len", "block").orderBy("hash", "id")) - 1
    return (
        placed.withColumn("block", F.pmod("hash", many))
        .withColumn("_place", place.cast("long"))
        .select(
            F.col("id").alias(id), "length", "bucket_len", "block",
            F.floor(F.col("_place") / in_batch).cast("long").alias("batch"),
            (F.col("_place") % in_batch).cast("long").alias("slot"),
            (F.col("bucket_len") - F.col("length")).alias("padding"),
        )
    )
