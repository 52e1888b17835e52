"""What the corpus operators share: words, hashes of words, stored intermediate tables."""

import functools
import os
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space that separates words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_PATTERN = r"[ \t\n\x0B\f\r]+"

# Texts are worked on in slices of about so many bytes, however many a batch holds.
SLICE_BYTES = 1 << 20

IS_SPACE = np.isin(np.arange(256), [ord(c) for c in SPACES])
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[ord("A") : ord("Z") + 1] = BYTE_VALUES[ord("a") : ord("z") + 1]


# The folders stored since the innermost call of `settled` began.
_on_the_way: ContextVar[list[str] | None] = ContextVar("on_the_way", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share.

    It lies in the folder that the cluster names in `spark.checkpoint.dir`, or in
    the warehouse where that is unset.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return os.path.join(top, "corpus", uuid.uuid4().hex)


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and tells the planner the table's
    true size, by which it chooses between a broadcast and a shuffled join.
    """
    path = shared_folder(df.sparkSession)
    made = _on_the_way.get()
    if made is not None:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that `make` returns, stored; what was stored on the way to it is deleted.

    For results that are small beside their intermediate tables. Nothing else may
    read those tables; the result no longer does, once it is written.
    """
    made: list[str] = []
    token = _on_the_way.set(made)
    try:
        df = make()
    finally:
        _on_the_way.reset(token)
    result = stored(df)
    for path in made:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return result


def packed(docs: DataFrame, **columns: str | Column) -> DataFrame:
    """The whole row as a struct `row`, beside the columns to work on under given names.

    Whatever the other columns of a table are called, they are out of the way.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return docs.select(row, *((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()))


def unpacked(df: DataFrame, columns: list[str], added: list[str]) -> DataFrame:
    """The columns of the packed rows, and those added; an added one replaces its namesake."""
    kept = [F.col(f"row.`{c}`").alias(c) for c in columns if c not in added]
    return df.select(*kept, *added)


def text_key(*columns: Column) -> list[Column]:
    """`key` and `check`, 128 bits that tell a text, or a text on its host, from others."""
    return [F.xxhash64(*columns).alias("key"), F.xxhash64(F.lit(1), *columns).alias("check")]


def words_column(text: Column) -> Column:
    """The words of a text as an array; empty for a null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, SPACE_PATTERN)
    )


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold about SLICE_BYTES of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    part = (np.cumsum(sizes, dtype=np.int64) - sizes) // SLICE_BYTES
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for start, end in zip(starts, [*starts[1:], len(sizes)], strict=True):
        yield batch.slice(start, end - start)


class Words(NamedTuple):
    """Words of some texts as spans of their UTF-8 bytes.

    Text i has the words from `first[i]` up to `first[i + 1]`, and the bytes from
    `bounds[i]` up to `bounds[i + 1]`.
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    bounds: np.ndarray


def words_of(texts: pa.Array) -> Words:
    """Maximal runs of bytes other than the six spaces, within each text; null has none."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, values = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    inside = np.concatenate(([False], ~IS_SPACE[data], [False]))
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    starts[cuts] = inside[1:-1][cuts]
    ends[cuts - 1] = inside[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(data, starts, ends, np.searchsorted(starts, bounds), bounds)


@functools.lru_cache(maxsize=8)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def power(base: int, size: int) -> np.ndarray:
    return _powers(base, max(1 << 16, 1 << (size - 1).bit_length()))[:size] if size else np.empty(0, np.uint64)


def hashes_of(words: Words, lower: bool = False) -> np.ndarray:
    """64-bit hash of every word; `lower` folds A-Z only.

    A polynomial over random values of the bytes, read off prefix sums, so equal
    words have equal hashes in every process.
    """
    values = (LOWER_VALUES if lower else BYTE_VALUES)[words.data]
    values *= power(BASE, len(values))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    found = sums[words.ends] - sums[words.starts]
    return mixed(found * power(BASE_INVERSE, len(values))[words.starts])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix, so that every bit of the result depends on all bits of x."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def by_slices(
    df: DataFrame,
    text: str,
    schema: str,
    work: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table],
) -> DataFrame:
    """Apply `work` to slices of a table's rows, of bounded bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield work(part)

    return df.mapInArrow(run, schema)
