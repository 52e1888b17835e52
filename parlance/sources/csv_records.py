"""Records of quoted CSV files, read by all cores however large one file is.

Lines are read in stretches of a file. Whether a stretch begins inside a quoted
field is told by the number of quotes before it: one small row per stretch is
summed up, and the stretches that begin inside one are broadcast to the lines.
Records that cross from one stretch into the next are put together by a shuffle of
these pieces alone; no other line is shuffled.
"""

import csv
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.sources.scratch import shared_folder

LAYOUT = pa.schema([
    ("time", pa.timestamp("us", "UTC")), ("file", pa.string()), ("stretch", pa.int64()), ("row", pa.int64()),
    ("begins", pa.bool_()), ("ends", pa.bool_()), ("record", pa.string()),
])
COLUMNS = "time timestamp, file string, stretch long, row long, begins boolean, ends boolean, record string"


def _one_record(text: str) -> str:
    csv.field_size_limit(1 << 31)
    if sum(1 for _ in csv.reader(io.StringIO(text, newline=""))) != 1:
        raise ValueError(f"a quote inside a field that is not quoted, near {text[:80]!r}")
    return text


class _Stretch:
    """The lines of one stretch, which come batch by batch in order."""

    def __init__(self, opened: bool, base: dict):
        self.inside, self.head, self.base = int(opened), opened, base
        self.held: list[str] = []
        self.held_row = self.n_lines = 0

    def records(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)
        inside = (self.inside + np.cumsum(quotes, dtype=np.int64)) % 2
        ends = np.flatnonzero(inside == 0)
        done = int(ends[-1]) + 1 if len(ends) else 0
        if done:
            starts = np.concatenate(([0], ends[:-1] + 1))
            offsets = pa.array(np.append(starts, done), pa.int32())
            found = pc.binary_join(pa.ListArray.from_arrays(offsets, lines[:done]), "\n").to_pylist()
            rows = starts + self.n_lines
            broken = set(np.flatnonzero(np.diff(np.append(starts, done)) > 1).tolist())
            if self.held:
                found[0], rows[0] = "\n".join([*self.held, found[0]]), self.held_row
                broken.add(0)
            for at in broken - ({0} if self.head else set()):
                _one_record(found[at])
            begins = np.ones(len(found), bool)
            begins[0] = not self.head
            yield self._batch(rows, begins, True, found)
            self.held, self.head = [], False
        if done < len(lines):
            if not self.held:
                self.held_row = self.n_lines + done
            self.held += lines[done:].to_pylist()
        self.inside, self.n_lines = int(inside[-1]), self.n_lines + len(lines)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield self._batch([self.held_row], [not self.head], False, ["\n".join(self.held)])

    def _batch(self, rows, begins, ends: bool, records: list[str]) -> pa.RecordBatch:
        n = len(records)
        same = [pa.repeat(self.base[c], n) for c in ("time", "file", "stretch")]
        return pa.RecordBatch.from_arrays(
            [*same, pa.array(rows, pa.int64()), pa.array(begins, pa.bool_()), pa.array([ends] * n),
             pa.array(records, pa.string())], schema=LAYOUT)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records, and what begins or ends outside of the stretch."""
    key, stretch = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        files = pc.dictionary_encode(batch["file"]).indices.to_numpy()
        places = batch["stretch"].to_numpy()
        cuts = np.flatnonzero((np.diff(files) != 0) | (np.diff(places) != 0)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            here = (batch["file"][start].as_py(), int(places[start]))
            if here != key:
                if stretch is not None:
                    yield from stretch.rest()
                base = {
                    "time": batch["time"][start].cast(LAYOUT.field("time").type), "file": batch["file"][start],
                    "stretch": batch["stretch"][start],
                }
                key, stretch = here, _Stretch(bool(batch["opened"][start].as_py()), base)
            yield from stretch.records(batch["value"].slice(start, end - start))
    if stretch is not None:
        yield from stretch.rest()


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch["record"].to_pylist():
            _one_record(text)
        yield batch


def csv_records(spark: SparkSession, path: str, stretch_bytes: int = 64 << 20) -> DataFrame:
    """(time, file, stretch, row, record): the records of quoted UTF-8 CSV files, unparsed.

    Lines end in \\n or \\r\\n. `row` is the line of the stretch in which a record
    begins. A file that ends inside a quoted field, or has quotes inside fields
    that are not quoted so that records would run together, raises an error. Blank
    lines are left out. What is broadcast has at most one row for `stretch_bytes`.
    """
    # Both readings must cut the files alike, whatever executors come and go: the cut
    # is taken from settings of the session that lists the files, so it is one apart.
    reader = spark.newSession()
    reader.conf.set("spark.sql.files.maxPartitionBytes", str(stretch_bytes))
    reader.conf.set("spark.sql.files.minPartitionNum", "1")
    lines = reader.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("stretch"), "value",
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    folder = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    lines.groupBy("file", "stretch").agg(F.sum(quotes).alias("quotes")).write.parquet(folder)
    before = Window.partitionBy("file").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    opened = (
        spark.read.parquet(folder).withColumn("before", F.sum("quotes").over(before))
        .where("before % 2 = 1").select("file", "stretch", F.lit(True).alias("opened"))
    )
    # The order of the lines stays, as the lines' side of the join is streamed.
    placed = F.broadcast(opened).join(lines, ["file", "stretch"], "right")
    pieces = placed.select("time", "file", "stretch", "opened", "value").mapInArrow(_pieces, COLUMNS)
    whole = pieces.where("begins AND ends")
    order = Window.partitionBy("file").orderBy("stretch", "row")
    joined = (
        pieces.where("NOT (begins AND ends)")
        .withColumn("n", F.sum(F.col("begins").cast("long")).over(order))
        .groupBy("file", "n").agg(
            F.min("time").alias("time"), F.min(F.struct("stretch", "row")).alias("first"),
            F.bool_or("ends").alias("ended"),
            F.sort_array(F.collect_list(F.struct("stretch", "row", "record"))).alias("parts"),
        )
        .select(
            "time", "file", "first.stretch", "first.row", F.lit(True).alias("begins"), "ended",
            F.when(F.col("ended"), F.array_join("parts.record", "\n")).otherwise(
                F.raise_error(F.concat(F.lit("a quoted field is open at the end of "), "file"))
            ).alias("record"),
        )
        .withColumnRenamed("ended", "ends").mapInArrow(_checked, COLUMNS)
    )
    text = F.col("record")
    return (
        whole.unionByName(joined)
        .withColumn("record", F.when(text.endswith("\r"), F.left(text, F.length(text) - 1)).otherwise(text))
        .where("record <> ''").select("time", "file", "stretch", "row", "record")
    )
