"""Reading and upserting of turns."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions.scores import present
from parlance.schema import CSV_COLUMNS, LABEL_COLUMNS, TURNS
from parlance.sources.csv_records import csv_records


def raw_turns(rows: DataFrame) -> DataFrame:
    """Text columns of a turn file as typed turns; a bad number or time raises.

    A column `row_order`, which says which of two rows came later, is kept.
    """
    return rows.select(
        "conv_id",
        F.col("turn_index").cast("int").alias("turn_index"),
        present(F.col("timestamp")).cast("timestamp").alias("timestamp"),
        "role",
        F.coalesce("text", F.lit("")).alias("text_raw"),
        present(F.col("customer_name")).alias("customer_name"),
        present(F.col("agent_name")).alias("agent_name"),
        *(["row_order"] if "row_order" in rows.columns else []),
    )


def row_order(row: Column) -> Column:
    """Order of rows over files: by the file's time and name, then by place in the file.

    `row` counts the rows of a task, which reads a file, or a stretch of it, from
    its start on.
    """
    return F.struct(
        F.col("_metadata.file_modification_time").alias("time"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("stretch"),
        row.alias("row"),
    ).alias("row_order")


def read_turns_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Turns from UTF-8 CSV files with a header, columns taken by name, and `row_order`.

    Quoted fields may hold line breaks and doubled quotes, so a file is read by
    one task: give many files, or say multi_line=False if no field has breaks.
    """
    rows = spark.read.csv(
        path, header=True, multiLine=multi_line, quote='"', escape='"', encoding="UTF-8",
        mode="FAILFAST", enforceSchema=False,
    )
    return raw_turns(rows.select(*CSV_COLUMNS, row_order(F.monotonically_increasing_id())))


def read_turns_csv_split(spark: SparkSession, path: str, stretch_bytes: int = 64 << 20) -> DataFrame:
    """The same turns, with every file cut into stretches that are read side by side.

    For large files whose fields hold line breaks. The first line of each file is
    its header; files with another header than the first one raise an error. The
    files are read three times: for their quotes, for the records that lie within a
    stretch, and for those that cross into the next one.
    """
    names = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').columns
    as_read = {"mode": "FAILFAST", "quote": '"', "escape": '"', "multiLine": "true"}
    fields = F.from_csv("record", ", ".join(f"`{n}` string" for n in names), as_read).alias("f")
    rows = csv_records(spark, path, stretch_bytes).select("time", "file", "stretch", "row", fields)
    is_header = (F.col("stretch") == 0) & (F.col("row") == 0)
    same = F.concat_ws(",", *(F.col(f"f.`{n}`") for n in names)) == F.lit(",".join(names))
    other = F.raise_error(F.concat(F.lit("another header in "), "file")).cast("boolean")
    turns = rows.where(F.when(~is_header, True).when(same, False).otherwise(other))
    order = F.struct("time", "file", "stretch", "row").alias("row_order")
    return raw_turns(turns.select(*(F.col(f"f.`{c}`").alias(c) for c in CSV_COLUMNS), order))


def latest_turns(rows: DataFrame, seq: str | None = None) -> DataFrame:
    """One row per (conv_id, turn_index): the one with the highest `seq`.

    Rows that are equal in `seq`, or all where there is none, are decided by their
    content, so that a rerun decides alike. The rank limit runs on the map side
    too: a key with many versions sends one row per input partition.
    """
    content = F.xxhash64(*[c for c in rows.columns if c != seq])
    order = ([F.desc(seq)] if seq else []) + [content, F.col("text_raw")]
    latest = Window.partitionBy("conv_id", "turn_index").orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(latest)).where("_rank = 1").drop("_rank")


def upsert_turns(current: DataFrame, new: DataFrame, seq: str) -> DataFrame:
    """Insert or replace by (conv_id, turn_index); the row with the highest seq wins.

    A replaced turn loses its labels.
    """
    key = ["conv_id", "turn_index"]
    columns = [c for c in TURNS.fieldNames() if c in current.columns]
    kept = latest_turns(new, seq)
    unlabelled = kept.select(*[
        F.lit(None).cast(TURNS[c].dataType).alias(c)
        if c in LABEL_COLUMNS or c not in kept.columns else F.col(c)
        for c in columns
    ])
    untouched = current.select(*columns).join(kept.select(*key), key, "left_anti")
    return untouched.unionByName(unlabelled)
