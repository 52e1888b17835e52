"""Turn files read as they arrive: the incremental form of reading and upserting."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.cleaning import clean_turns
from parlance.schema import CSV_COLUMNS
from parlance.sources.turns import latest_turns, raw_turns, row_order


def ingest_turns(
    spark: SparkSession, source: str, target: str, marks: str, lexicon: DataFrame | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Append the turns of new CSV files to a log, and return the current turns, cleaned.

    Files are taken once each; `marks` holds what was taken, and belongs in
    shared storage like the target. Files of one layout are expected, columns in
    the order of the header of the raw turn file. The log holds raw turns, so
    that cleaning with a lexicon is the same here and in the offline build.
    """
    rows = (
        spark.readStream.schema(", ".join(f"{c} string" for c in CSV_COLUMNS))
        .option("header", True).option("multiLine", multi_line).option("quote", '"')
        .option("escape", '"').option("mode", "FAILFAST").option("enforceSchema", False)
        .csv(source)
    )
    ordered = rows.select(*CSV_COLUMNS, row_order(F.lit(0).cast("long")))
    numbered = ordered.mapInArrow(_number_rows, ordered.schema)
    query = (
        raw_turns(numbered).writeStream.format("parquet").option("path", target)
        .option("checkpointLocation", marks).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return clean_turns(current_turns(spark.read.parquet(target)), lexicon)


def _number_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count the rows of a task into row_order.row; streams have no such function."""
    seen = 0
    for batch in batches:
        order = batch.column("row_order")
        fields = [order.field(i) for i in range(order.type.num_fields)]
        fields[-1] = pa.array(range(seen, seen + batch.num_rows), pa.int64())
        seen += batch.num_rows
        numbered = pa.StructArray.from_arrays(fields, fields=list(order.type))
        columns = [numbered if n == "row_order" else batch.column(n) for n in batch.schema.names]
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def current_turns(log: DataFrame) -> DataFrame:
    """The latest version of each turn in the log: of the later file, and in it the later row."""
    return latest_turns(log, "row_order").drop("row_order")
