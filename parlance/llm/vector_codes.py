"""Codes of vectors: each part of a vector is replaced by the number of its nearest codebook entry.

Vectors are integers, floor(scale * x), cut into equal parts; a part position has
its own codebook. Which entry is nearest is looked up by grid cell: a part's
coordinates are cut down to a coarse cell, and for each cell a task remembers the
entries that could be nearest to a point of the cell's box. An entry is out if
some other entry's largest distance to the box is below its own smallest one.
Only the entries remembered are then evaluated exactly, so the memo never decides
a result; cells that clash in the hash are evaluated against all entries.

A round of training sends one codebook to the tasks and gets back sums and counts
per entry, added up map-side first: parts * entries * (width + 1) numbers a task.

Defined results: a vector that is null or holds a null or a component that is not
finite is dropped, and so is one whose length is not the most common length (ties:
the longer). Rows that repeat an id all count, and seed the codebooks in the order
of their components. Null ids come last, null labels are one label. Fewer vectors
than entries make smaller codebooks; no vector at all gives an empty result. A
length that cannot be cut into equal parts, or components so large that squared
distances would not fit 64 bits, raise ValueError.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import BASE, mixed, power, stored


@dataclass(frozen=True)
class Codes:
    """`cell` is the side of a grid cell, a power of two, in integer units. A task remembers
    up to `max_cells` cells of each part; further ones are worked out when they occur."""

    scale: int = 4096
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    cell: int = 256
    max_cells: int = 1 << 16


# Rows that go through numpy at once.
BLOCK = 2048
TOO_LARGE = 1 << 62


def integer_vectors(vectors: DataFrame, vector: str = "embedding", id: str = "vec_id", label: str = "label",
                    how: Codes = Codes()) -> DataFrame:
    """(id, label, ints, length, peak) of the rows whose vector is whole; peak is the largest magnitude."""
    rows = vectors.select(
        F.col(f"`{id}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("vector")
    )
    scale = how.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["vector"]
            values = lists.flatten().cast(pa.float64())
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = values.to_numpy(zero_copy_only=False)
            fine = np.isfinite(flat)
            ends = np.concatenate(([0], np.cumsum(lengths)))
            bad = np.concatenate(([0], np.cumsum(~fine)))[ends]
            whole = lists.is_valid().to_numpy(zero_copy_only=False) & (np.diff(bad) == 0)
            scaled = np.floor(np.where(fine, flat, 0) * scale)
            # What doesn't fit is kept as too large, so that it is noticed.
            ints = np.clip(scaled, -TOO_LARGE, TOO_LARGE).astype(np.int64)
            chosen = np.repeat(whole, lengths)
            magnitude = np.abs(ints[chosen])
            kept = lengths[whole]
            offsets = np.concatenate(([0], np.cumsum(kept)))
            peaks = np.zeros(len(kept), np.int64)
            if len(magnitude):
                peaks[kept > 0] = np.maximum.reduceat(magnitude, offsets[:-1][kept > 0])
            mask = pa.array(whole)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"].filter(mask), batch["label"].filter(mask),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ints[chosen])),
                    pa.array(kept, pa.int32()), pa.array(peaks),
                ],
                ["id", "label", "ints", "length", "peak"],
            )

    kinds = [vectors.schema[c].dataType.simpleString() for c in (id, label)]
    return rows.mapInArrow(
        run, f"id {kinds[0]}, label {kinds[1]}, ints array<long>, length int, peak long"
    )


class NearestEntries:
    """The nearest entry of one part's codebook, by remembered grid cells."""

    def __init__(self, entries: np.ndarray, how: Codes):
        self.entries = entries
        self.shift = how.cell.bit_length() - 1
        self.side = (1 << self.shift) - 1
        self.limit = how.max_cells
        width = entries.shape[1]
        self.hashes = np.empty(0, np.uint64)
        self.cells = np.empty((0, width), np.int64)
        self.candidates = np.empty((0, len(entries)), bool)

    def _undominated(self, cells: np.ndarray) -> np.ndarray:
        """Which entries could be nearest to a point of each cell's box; distances are doubled."""
        middle = (cells << self.shift) * 2 + self.side
        away = np.abs(2 * self.entries[None] - middle[:, None])
        low, high = np.maximum(away - self.side, 0), away + self.side
        nearest, farthest = (low * low).sum(2), (high * high).sum(2)
        return nearest <= farthest.min(1)[:, None]

    def _of_cells(self, hashes: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Candidates of some cells, sorted by hash, each hash once."""
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        known = (self.hashes[at] == hashes) & (self.cells[at] == cells).all(1) if len(self.hashes) else np.zeros(len(at), bool)
        found = np.empty((len(hashes), len(self.entries)), bool)
        found[known] = self.candidates[at[known]]
        found[~known] = self._undominated(cells[~known])
        new = np.flatnonzero(~known & ~np.isin(hashes, self.hashes))[: self.limit - len(self.hashes)]
        if len(new):
            merged = np.concatenate((self.hashes, hashes[new]))
            order = np.argsort(merged, kind="stable")
            self.hashes = merged[order]
            self.cells = np.concatenate((self.cells, cells[new]))[order]
            self.candidates = np.concatenate((self.candidates, found[new]))[order]
        return found

    def find(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each point, the lower index on ties, and its squared distance."""
        cells = points >> self.shift
        hashes = mixed((cells.astype(np.uint64) * power(BASE, cells.shape[1] + 1)[1:]).sum(1, dtype=np.uint64))
        distinct, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        candidates = self._of_cells(distinct, cells[first])[place]
        candidates[(cells != cells[first[place]]).any(1)] = True
        row, entry = np.nonzero(candidates)
        difference = points[row] - self.entries[entry]
        distance = np.full(candidates.shape, np.iinfo(np.int64).max)
        distance[row, entry] = (difference * difference).sum(1)
        best = distance.argmin(1)
        return best, distance[np.arange(len(best)), best]


def _blocks(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of BLOCK rows at most, with their vectors as (row, part, component)."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            block = batch.slice(start, BLOCK)
            flat = block["ints"].flatten().to_numpy(zero_copy_only=False)
            yield block, flat.reshape(block.num_rows, parts, -1)


def _sums(ints: DataFrame, books: np.ndarray, how: Codes) -> DataFrame:
    """(part, entry, at, total): sums of the components at `at` of the parts next to an entry; at -1, their count."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = [NearestEntries(book, how) for book in books]
        totals = np.zeros((parts, entries, width + 1), np.int64)
        for _, vectors in _blocks(batches, parts):
            for part in range(parts):
                best, _ = nearest[part].find(vectors[:, part])
                np.add.at(totals[part, :, 1:], best, vectors[:, part])
                totals[part, :, 0] += np.bincount(best, minlength=entries)
        part, entry = np.nonzero(totals[:, :, 0])
        used = totals[part, entry]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(part, width + 1), pa.int32()), pa.array(np.repeat(entry, width + 1), pa.int32()),
                pa.array(np.tile(np.arange(-1, width), len(part)), pa.int32()), pa.array(used.ravel(), pa.int64()),
            ],
            ["part", "entry", "at", "total"],
        )

    partial = ints.select("ints").mapInArrow(run, "part int, entry int, at int, total long")
    return partial.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"))


def train(ints: DataFrame, length: int, how: Codes = Codes()) -> np.ndarray:
    """Codebooks (part, entry, component), from the vectors of the smallest ids.

    To the driver come `entries` vectors, and per round one number for each
    component of the codebooks and one for each entry.
    """
    width = length // how.parts
    seeds = ints.orderBy(F.col("id").asc_nulls_last(), "ints").limit(how.entries).select("ints").collect()
    books = np.array([r["ints"] for r in seeds], np.int64).reshape(len(seeds), how.parts, width).swapaxes(0, 1).copy()
    for _ in range(how.rounds if len(seeds) else 0):
        totals = np.zeros((how.parts, len(seeds), width + 1), np.int64)
        for part, entry, at, total in _sums(ints, books, how).collect():
            totals[part, entry, at + 1] = total
        counts = totals[:, :, :1]
        books = np.where(counts > 0, totals[:, :, 1:] // np.maximum(counts, 1), books)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(ints: DataFrame, books: np.ndarray, how: Codes = Codes()) -> DataFrame:
    """(id, label, code, error): entry numbers as hex digits, and the summed squared distance."""
    parts, entries, _ = books.shape
    digits = max(2, math.ceil(math.log(max(entries, 2), 16)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = [NearestEntries(book, how) for book in books]
        names = np.array([format(e, f"0{digits}x") for e in range(entries)], dtype=object)
        for block, vectors in _blocks(batches, parts):
            code = np.full(block.num_rows, "", dtype=object)
            error = np.zeros(block.num_rows, np.int64)
            for part in range(parts):
                best, distance = nearest[part].find(vectors[:, part])
                code += names[best]
                error += distance
            yield pa.RecordBatch.from_arrays(
                [block["id"], block["label"], pa.array(code, pa.string()), pa.array(error)],
                ["id", "label", "code", "error"],
            )

    kinds = [ints.schema[c].dataType.simpleString() for c in ("id", "label")]
    return ints.select("id", "label", "ints").mapInArrow(
        run, f"id {kinds[0]}, label {kinds[1]}, code string, error long"
    )


def vector_codes(
    vectors: DataFrame, vector: str = "embedding", id: str = "vec_id", label: str = "label", how: Codes = Codes()
) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error) of every whole vector, stored, and the codebooks.

    The integers are stored once, so a round reads them and nothing else.
    """
    ints = stored(integer_vectors(vectors, vector, id, label, how))
    lengths = ints.groupBy("length").agg(F.count("*").alias("n"), F.max("peak").alias("peak"))
    most = lengths.orderBy(F.desc("n"), F.desc("length")).first()
    length, peak = (most["length"], most["peak"]) if most else (0, 0)
    if length % how.parts:
        raise ValueError(f"vectors of {length} components can't be cut into {how.parts} equal parts")
    if peak > math.isqrt((1 << 63) // max(length, 1)) // 8:
        raise ValueError("components too large: squared distances would not fit 64 bits")
    even = ints.where(F.col("length") == length)
    books = train(even, length, how)
    coded = encode(even, books, how) if books.shape[1] else even.selectExpr("id", "label", "'' AS code", "0L AS error")
    return stored(coded).withColumnsRenamed({"id": id, "label": label}), books


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """Add `label_error`, the error summed over equal labels; null labels are one."""
    per_label = stored(
        coded.groupBy(F.col(label).alias("_of")).agg(F.sum("error").alias("label_error"))
    )
    return coded.join(per_label, F.col(label).eqNullSafe(F.col("_of"))).drop("_of")
