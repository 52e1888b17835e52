"""Substring dedup: words covered by a window that an earlier document also has.

A window is a run of `window` words. Windows are counted by a count-min sketch:
each partition of the documents makes its own sketch, the sketches merge cell by
cell, and a window's count is never underestimated. A second pass groups exactly
only the windows that are estimated to repeat, so none is lost.

The sketch counts each window under its anchor, the smallest hash of a short run
of words inside it. Equal windows have equal anchors, so the count of an anchor
is at least that of its windows, and there are some twenty times fewer of them.
Exact copies are found by digest first and take no part in the counting.

Defined results: a null text has no words; a null id counts as the largest; rows
that repeat an id are not earlier than each other; a text shorter than a window
loses nothing; an empty table gives an empty result.
"""

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import by_slices, hashes_of, mixed, slices, stored, words_of
from parlance.llm.runs import run_hashes


@dataclass(frozen=True)
class Repeats:
    """Sketch rows have 2 ** bits cells, `cells_per_anchor` of them for each anchor expected
    but no more than 2 ** max_bits, so that what is broadcast is bounded (64 MB a row).
    A sketch that is too full lets more windows through to the exact grouping."""

    window: int = 50
    anchor: int = 8
    rows: int = 2
    cells_per_anchor: int = 4
    min_bits: int = 18
    max_bits: int = 29


BLOCK_BITS = 16
WINDOW_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
ANCHOR_BASE = 0xE7037ED1A0B428DB


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` values in a row, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def windows_of(texts: pa.Array, how: Repeats):
    """Word hashes; and for each window: its text, its first word and its anchor."""
    words = words_of(texts)
    hashes = hashes_of(words)
    n = np.maximum(np.diff(words.first) - how.window + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    starts = words.first[:-1][text] + np.arange(len(text)) - first[text]
    if not len(starts):
        return words, hashes, text, starts, np.empty(0, np.uint64)
    grams = run_hashes(hashes, np.arange(len(hashes) - how.anchor + 1), how.anchor, ANCHOR_BASE)
    return words, hashes, text, starts, _sliding_min(grams, how.window - how.anchor + 1)[starts]


def _runs(text: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Where windows of one text with one anchor begin, in a row of windows."""
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (anchors[1:] != anchors[:-1])
    return np.flatnonzero(new)


def _cells(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mixed(anchors ^ np.uint64(0x9E3779B97F4A7C15 * (row + 1) % (1 << 64))) >> np.uint64(64 - bits)


def _sketch_bits(n_bytes: int, how: Repeats) -> int:
    """Bits that give each anchor its cells, if a word has six bytes."""
    anchors = n_bytes / 6 * 2 / (how.window - how.anchor + 2)
    wanted = int(np.ceil(np.log2(max(1.0, anchors * how.cells_per_anchor))))
    return min(max(wanted, how.min_bits), how.max_bits)


def repeated_cells(docs: DataFrame, how: Repeats, bits: int) -> DataFrame:
    """The merged sketch: (block, cells), a bit for each cell counted twice or more.

    A task emits the blocks of its sketch that are not empty, as two bits a cell.
    Blocks meet sorted, and are added up one after the other.
    """
    block_size = 1 << BLOCK_BITS

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        for batch in batches:
            for part in slices(batch, "text"):
                _, _, text, _, anchors = windows_of(part["text"], how)
                at = _runs(text, anchors)
                pairs = np.lexsort((anchors[at], text[at]))
                text, anchors = text[at][pairs], anchors[at][pairs]
                at = _runs(text, anchors)
                seen.append(anchors[at])
        anchors, times = np.unique(np.concatenate(seen) if seen else np.empty(0, np.uint64), return_counts=True)
        times = np.minimum(times, 2)
        for row in range(how.rows):
            cells = _cells(anchors, row, bits)
            order = np.argsort(cells, kind="stable")
            cells, counts = cells[order], times[order]
            blocks = (cells >> np.uint64(BLOCK_BITS)).astype(np.int64)
            ends = np.flatnonzero(np.diff(blocks, append=-1)) + 1
            start = 0
            for end in ends:
                block = np.bincount(
                    (cells[start:end] & np.uint64(block_size - 1)).astype(np.int64),
                    weights=counts[start:end], minlength=block_size,
                )
                packed = np.minimum(block, 2).astype(np.uint8).reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
                number = (row << (how.max_bits - BLOCK_BITS)) + int(blocks[start])
                yield pa.RecordBatch.from_pylist([{"block": number, "cells": zlib.compress(packed, 1)}])
                start = end

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = np.array([0, 2, 4, 6], np.uint8)
        block, total = None, np.zeros(block_size, np.uint8)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                [{"block": block, "cells": zlib.compress(np.packbits(total >= 2), 1)}]
            )

        for batch in batches:
            for number, cells in zip(batch["block"].to_pylist(), batch["cells"].to_pylist(), strict=True):
                if block is not None and number != block:
                    yield done()
                    total[:] = 0
                block = number
                packed = np.frombuffer(zlib.decompress(cells), np.uint8)
                total = np.minimum(total + ((packed[:, None] >> shifts) & 3).ravel(), 2).astype(np.uint8)
        if block is not None:
            yield done()

    schema = "block long, cells binary"
    return (
        docs.select("text").mapInArrow(partial, schema)
        .repartition("block").sortWithinPartitions("block").mapInArrow(merged, schema)
    )


@functools.lru_cache(maxsize=2)
def _bitmaps(sketch, rows: int, bits: int, max_bits: int) -> list[np.ndarray]:
    """The sketch's rows as bitmaps, made once in a worker."""
    per_row = max(1, 1 << (bits - BLOCK_BITS))
    maps = [np.zeros(per_row << (BLOCK_BITS - 3), np.uint8) for _ in range(rows)]
    for number, cells in sketch.value:
        row, block = number >> (max_bits - BLOCK_BITS), number & ((1 << (max_bits - BLOCK_BITS)) - 1)
        size = 1 << (BLOCK_BITS - 3)
        maps[row][block * size : (block + 1) * size] = np.frombuffer(zlib.decompress(cells), np.uint8)
    return maps


def candidate_windows(docs: DataFrame, how: Repeats, sketch, bits: int) -> DataFrame:
    """(w1, w2, id, key, at) of each window that is estimated to repeat."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, hashes, text, starts, anchors = windows_of(batch["text"], how)
        runs = _runs(text, anchors)
        good = np.ones(len(runs), bool)
        for row, bitmap in enumerate(_bitmaps(sketch, how.rows, bits, how.max_bits)):
            cells = _cells(anchors[runs], row, bits)
            bit = np.uint8(7) - (cells & np.uint64(7)).astype(np.uint8)
            good &= (bitmap[cells >> np.uint64(3)] >> bit) & 1 == 1
        chosen = np.repeat(good, np.diff(runs, append=len(text)))
        at = np.arange(len(text)) - np.searchsorted(text, text)
        text, starts, at = text[chosen], starts[chosen], at[chosen]
        both = [
            pa.array(run_hashes(hashes, starts, how.window, base).view(np.int64))
            for base in WINDOW_BASES
        ]
        rows = pa.array(text)
        return pa.RecordBatch.from_arrays(
            [*both, batch["id"].take(rows), batch["key"].take(rows), pa.array(at, pa.int32())],
            ["w1", "w2", "id", "key", "at"],
        )

    return by_slices(
        docs.select("id", "key", "text"), "text", "w1 long, w2 long, id long, key long, at int", work
    )


def _keyed(docs: DataFrame, text: str, id: str) -> DataFrame:
    """id (null as the largest), text, and a key that tells id and text."""
    largest = F.lit((1 << 63) - 1)
    return docs.select(
        F.coalesce(F.col(id).cast("long"), largest).alias("id"),
        F.xxhash64(F.col(id), F.col(text)).alias("key"), F.col(text).alias("text"),
    )


def repeated_places(
    docs: DataFrame, text: str = "text", id: str = "doc_id", how: Repeats = Repeats()
) -> tuple[DataFrame, DataFrame]:
    """Keys of documents that copy an earlier one; and (key, places): where in the other
    documents windows begin that an earlier document has.

    Digests, the sketch and the places are stored between the passes.
    """
    spark = docs.sparkSession
    rows = _keyed(docs, text, id)
    digests = stored(rows.where("text IS NOT NULL").select(
        "id", "key", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"),
        F.octet_length("text").cast("long").alias("n"),
    ))
    earliest = digests.groupBy("a", "b").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    copies = stored(
        digests.join(earliest.where("first < last").drop("last"), ["a", "b"])
        .where("id > first").select("key").distinct()
    )
    n_bytes = digests.agg(F.sum("n")).first()[0] or 0
    bits = _sketch_bits(n_bytes, how)
    originals = rows.where("text IS NOT NULL").join(copies, "key", "left_anti")
    cells = [tuple(r) for r in stored(repeated_cells(originals, how, bits)).collect()]
    sketch = spark.sparkContext.broadcast([(n, bytes(c)) for n, c in cells])
    found = candidate_windows(originals, how, sketch, bits)
    earliest_window = (
        found.groupBy("w1", "w2").agg(F.min("id").alias("first"), F.max("id").alias("last"))
        .where("first < last").drop("last")
    )
    places = (
        found.join(earliest_window, ["w1", "w2"]).where("id > first")
        .groupBy("key").agg(F.collect_set("at").alias("places"))
    )
    return copies, stored(places)


def remove_repeats(
    docs: DataFrame, text: str = "text", id: str = "doc_id", how: Repeats = Repeats()
) -> DataFrame:
    """Per document: id, n_words, n_removed and kept_text, its other words joined by one space."""
    copies, places = repeated_places(docs, text, id, how)
    marks = places.select("key", "places", F.lit(False).alias("copy")).unionByName(
        copies.select("key", F.lit(None).cast("array<int>").alias("places"), F.lit(True).alias("copy"))
    )
    rows = docs.select(
        F.col(id).alias("id"), F.col(text).alias("text"),
        F.xxhash64(F.col(id), F.col(text)).alias("key"),
    ).join(marks, "key", "left").select("id", "text", "places", "copy")
    kind = docs.schema[id].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, kept = [], [], []
        for text, places, copy in zip(
            batch["text"].cast(pa.large_binary()).to_pylist(), batch["places"], batch["copy"].to_pylist(),
            strict=True,
        ):
            # bytes.split() parts at the six ASCII spaces and nothing else.
            words = (text or b"").split()
            n = len(words)
            gone = np.zeros(n + 1, np.int64)
            if copy and n >= how.window:
                gone[0], gone[n] = 1, -1
            elif places.is_valid:
                starts = places.values.to_numpy(zero_copy_only=False)
                np.add.at(gone, starts, 1)
                np.add.at(gone, starts + how.window, -1)
            stay = np.cumsum(gone[:n]) == 0
            n_words.append(n)
            n_removed.append(n - int(stay.sum()))
            kept.append(b" ".join(words if stay.all() else [words[i] for i in np.flatnonzero(stay)]))
        return pa.RecordBatch.from_arrays(
            [batch["id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
             pa.array(kept, pa.binary()).cast(pa.string())],
            ["id", "n_words", "n_removed", "kept_text"],
        )

    schema = f"id {kind}, n_words long, n_removed long, kept_text string"
    return by_slices(rows, "text", schema, work).withColumnRenamed("id", id)
