"""Writing of result tables."""

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.rollups import agent_rollup


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None if nothing was written there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def materialize(
    df: DataFrame,
    path: str,
    force: bool = False,
    partition_by: Sequence[str] | None = None,
    expected_rows: int | None = None,
    rows_per_file: int = 0,
) -> DataFrame:
    """Write a stage's result unless it is there, and return the stored table.

    A table is there when its mark, a table beside it, says that it was written
    to the end; a job that was lost on the way leaves no such mark. `force`
    rebuilds it. With `expected_rows` a table of another size is rebuilt too.
    Files are sized by an adaptive rebalance, which also splits a partition value
    that holds most rows; `rows_per_file` bounds them further.
    """
    spark = df.sparkSession
    stored = read_table(spark, path) if is_marked(spark, path) else None
    if stored is not None and not force:
        if expected_rows is None or stored.count() == expected_rows:
            return stored
    mark(spark, path, False)
    keys = list(partition_by or [])
    writer = df.hint("rebalance", *keys).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*keys) if keys else writer).parquet(path)
    mark(spark, path, True)
    return spark.read.parquet(path)


def mark(spark: SparkSession, path: str, finished: bool) -> None:
    marks = spark.range(1).selectExpr(f"{str(finished).lower()} AS finished")
    marks.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}.mark")


def is_marked(spark: SparkSession, path: str) -> bool:
    marks = read_table(spark, f"{path.rstrip('/')}.mark")
    return marks is not None and bool(marks.where("finished").take(1))


def write_rollups(
    conversations: DataFrame, turns: DataFrame, path: str, force: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Store conversations (partitioned by month of start) and the agents rolled up from them."""
    dated = conversations.withColumn("month", F.date_format("start_ts", "yyyy-MM"))
    stored = materialize(dated, f"{path}/conversations", force, ["month"])
    return stored, materialize(agent_rollup(stored, turns), f"{path}/agents", force)


def write_vectors(
    docs: DataFrame, path: str, force: bool = False, expected_rows: int | None = None
) -> DataFrame:
    """Store id, document, metadata and vector; by list if the documents are in lists."""
    lists = ["list"] if "list" in docs.columns else None
    return materialize(docs, path, force, lists, expected_rows)


def write_eval_results(results: DataFrame, summary: DataFrame, path: str) -> None:
    """Store scored answers and their summary as JSON lines."""
    results.write.mode("overwrite").json(f"{path}/results")
    summary.write.mode("overwrite").json(f"{path}/summary")
