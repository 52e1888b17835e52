"""The offline build: raw turns to labelled turns, rollups and vectors."""

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators import cleaning, documents, labelling, rollups, vectors
from parlance.operators.topics import Topics, taxonomy_coverage
from parlance.schema import ANSWERS, LABELS
from parlance.sources import storage
from parlance.sources.turns import latest_turns


@dataclass(frozen=True)
class Tables:
    turns: DataFrame
    labels: DataFrame
    rejected: DataFrame
    coverage: DataFrame
    conversations: DataFrame
    agents: DataFrame
    vectors: DataFrame


@dataclass(frozen=True)
class Asking:
    """How a labeller is asked.

    Answers are kept from `chunks_at_once` chunks of up to `chunk_rows` texts at a time; a
    task asks for up to `workers` batches of `batch_size` texts at once, `attempts` times each.
    """

    batch_size: int = 25
    workers: int = 4
    attempts: int = 3
    wait: float = 1.0
    chunk_rows: int = 1000
    chunks_at_once: int = 64


def label_pending(
    cleaned: DataFrame,
    path: str,
    classified_at: str,
    labeller: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
    limit: int | None = None,
    force: bool = False,
    asking: Asking = Asking(),
) -> tuple[DataFrame, bool]:
    """Label the texts that have no label yet; returns the label table and if it grew.

    A run stores its questions, then the answers chunk by chunk, then its part of
    the label table. A run that was lost on the way is taken up by the next call
    with the chunks that have no answers yet, whatever `cleaned` is by then;
    `force` starts afresh. Answers that are wrong, or that nobody asked for, and
    texts that got none are stored as `labels_rejected`; such texts stay pending.
    """
    spark = cleaned.sparkSession
    run = 0
    while storage.is_marked(spark, f"{path}/labelling/run={run}"):
        run += 1
    here = f"{path}/labelling/run={run}"
    if force and storage.is_marked(spark, f"{here}/asked"):
        # What was begun is given up, so that its answers are not taken for new ones.
        storage.mark(spark, here, True)
        here = f"{path}/labelling/run={run + 1}"
        run += 1
    none = spark.createDataFrame([], LABELS)
    stored = None if force else storage.read_table(spark, f"{path}/labels")
    asked = storage.read_table(spark, f"{here}/asked") if storage.is_marked(spark, f"{here}/asked") else None
    if asked is None or asked.isEmpty():
        storage.mark(spark, f"{here}/anew", force)
        pending = labelling.pending_texts(cleaned, none if stored is None else stored, limit)
        asked = storage.materialize(
            pending, f"{here}/asked", force=True, rows_per_file=asking.chunk_rows
        )
    if stored is not None and asked.isEmpty():
        return stored.drop("run"), False
    if labeller is None:
        answers = storage.materialize(labelling.label_texts(asked), f"{here}/answers", force=True)
        failed = None
    else:
        given = _answers(asked, here, labeller, asking)
        answers = given.where("failure IS NULL").drop("failure")
        failed = given.where("failure IS NOT NULL").select("text_clean", "role", "failure")
    accepted, rejected = labelling.validate_labels(answers, classified_at, pending=asked)
    if failed is not None:
        rejected = rejected.join(failed, ["text_clean", "role"], "left").withColumn(
            "error", F.concat_ws(" after ", "error", "failure")
        ).drop("failure")
    storage.materialize(rejected, f"{path}/labels_rejected", force=True)
    # Written anew by a rerun, so that no label counts twice.
    new = labelling.upsert_labels(none, accepted)
    if storage.is_marked(spark, f"{here}/anew"):
        numbered = new.withColumn("run", F.lit(run))
        numbered.write.mode("overwrite").partitionBy("run").parquet(f"{path}/labels")
    else:
        new.write.mode("overwrite").parquet(f"{path}/labels/run={run}")
    storage.mark(spark, here, True)
    return spark.read.parquet(f"{path}/labels").drop("run"), True


def _answers(
    asked: DataFrame,
    here: str,
    labeller: Callable[[pd.DataFrame], pd.DataFrame],
    asking: Asking,
) -> DataFrame:
    """The answers to stored questions, which are read as a stream of chunks.

    The stream's checkpoint says which chunks are done: their answers are kept, and
    they are not asked again, however often the job is started.
    """
    spark = asked.sparkSession
    chunks = spark.readStream.schema(asked.schema).option(
        "maxFilesPerTrigger", asking.chunks_at_once
    ).parquet(f"{here}/asked")
    ask = labelling.label_batches(
        labeller, asking.batch_size, asking.workers, asking.attempts, asking.wait
    )
    query = (
        chunks.mapInArrow(ask, ANSWERS).writeStream.format("parquet")
        .option("path", f"{here}/answers").option("checkpointLocation", f"{here}/marks")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(ANSWERS).parquet(f"{here}/answers")


def build_tables(
    raw: DataFrame,
    topics: Topics,
    path: str,
    classified_at: str,
    lexicon: DataFrame | None,
    labeller: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
    embedder=None,
    force: bool = False,
) -> Tables:
    """Run every stage, each into its own table under `path`, and return the tables.

    Of rows with the same (conv_id, turn_index) the last counts, by `row_order` if
    the raw turns have it. `lexicon` (token, zipf) is what gibberish is told by;
    None says that texts are only cut and tidied. A stage whose table is there is
    skipped unless `force`; labelling goes on where it stopped. The written tables
    cut the lineage between stages. Rollups fail while a turn has no label.
    """
    seq = "row_order" if "row_order" in raw.columns else None
    latest = latest_turns(raw, seq).drop("row_order")
    cleaned = storage.materialize(cleaning.clean_turns(latest, lexicon), f"{path}/cleaned", force)
    coverage = storage.materialize(
        taxonomy_coverage(cleaned, topics), f"{path}/taxonomy_coverage", force
    )
    labels, grew = label_pending(cleaned, path, classified_at, labeller, force=force)
    turns = storage.materialize(
        labelling.propagate_labels(cleaned, labels), f"{path}/turns", force or grew
    )
    rolled = rollups.conversation_rollup(labelling.require_labelled(turns), topics)
    conversations, agents = storage.write_rollups(rolled, turns, path, force)
    docs = storage.materialize(
        documents.vector_documents(turns, conversations), f"{path}/documents", force
    )
    embedded = storage.write_vectors(
        vectors.embed_documents(docs, embedder), f"{path}/vectors", force, conversations.count()
    )
    rejected = raw.sparkSession.read.parquet(f"{path}/labels_rejected")
    return Tables(turns, labels, rejected, coverage, conversations, agents, embedded)
