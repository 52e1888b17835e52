"""Embedding of documents, and the choice of documents by their metadata."""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance import constants as C
from parlance.operators.conversations import check_choice

# Documents and their vectors go through Python in batches of this many, and of so many bytes if one is not larger.
EMBED_BATCH = 64
EMBED_BYTES = 2 << 20


def fit_embedder(docs: DataFrame, dim: int = 256, document: str = "document") -> PipelineModel:
    """The built-in embedder: hashed word counts weighted by inverse document frequency.

    A conversation in several parts is one document.
    """
    counters = [
        Tokenizer(inputCol=document, outputCol="_words"),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dim),
    ]
    counted = _counted(docs, counters)
    weights = IDF(inputCol="_counts", outputCol="_weights").fit(counted)
    return PipelineModel([
        *counters, weights, Normalizer(inputCol="_weights", outputCol="_unit", p=2.0)
    ])


def _counted(docs: DataFrame, counters: Sequence) -> DataFrame:
    """Add `_counts`; the counts of a conversation's parts are added up."""
    out = docs
    for stage in counters:
        out = stage.transform(out)
    out = out.drop("_words")
    if "part" not in docs.columns:
        return out
    return _one_row(out, docs, Summarizer.sum(F.col("_counts")), "_counts")


def _one_row(parts: DataFrame, docs: DataFrame, gathered: Column, into: str) -> DataFrame:
    """One row per conversation: what is gathered over its parts, the rest from the first one."""
    rest = [c for c in docs.columns if c not in ("conv_id", "part")]
    first = F.min(F.struct("part", *rest)).alias("_first")
    return parts.groupBy("conv_id").agg(first, gathered.alias(into)).select(
        "conv_id", *[F.col(f"_first.{c}").alias(c) for c in rest], into
    )


def embed_documents(
    docs: DataFrame,
    embedder: PipelineModel | Callable[[list[str]], np.ndarray] | None = None,
    dim: int = 256,
    document: str = "document",
) -> DataFrame:
    """Add `embedding`, a unit vector per document.

    `embedder` is a fitted pipeline (embed queries with the same one), or a
    function from a list of texts to a matrix; by default a pipeline is fitted
    on the documents themselves. A conversation in several parts gets one row
    and one vector: its word counts are summed over the parts, or the parts'
    vectors averaged by length; the other columns are those of its first part.
    """
    if embedder is None:
        embedder = fit_embedder(docs, dim, document)
    if isinstance(embedder, PipelineModel):
        counted = _counted(docs, embedder.stages[:2])
        return (
            PipelineModel(embedder.stages[2:]).transform(counted)
            .withColumn("embedding", vector_to_array("_unit", dtype="float32"))
            .drop("_counts", "_weights", "_unit")
        )
    embedded = docs.withColumn("embedding", _unit_vectors(embedder, EMBED_BATCH)(F.col(document)))
    if "part" not in docs.columns:
        return embedded.withColumn("embedding", F.col("embedding").cast("array<float>"))
    length = F.greatest(F.length(document), F.lit(1)).cast("double")
    parts = embedded.withColumns({"_vector": array_to_vector("embedding"), "_length": length})
    mean = Summarizer.mean(F.col("_vector"), F.col("_length"))
    unit = Normalizer(inputCol="_mean", outputCol="_unit", p=2.0)
    return (
        unit.transform(_one_row(parts, docs, mean, "_mean"))
        .withColumn("embedding", vector_to_array("_unit", dtype="float32"))
        .drop("_mean", "_unit")
    )


def _few(texts: pa.Array, rows: int, size: int) -> Iterator[pa.Array]:
    """Stretches of at most so many texts, and of so many bytes if one text is not larger."""
    length = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(length, dtype=np.int64), 0
    while start < len(texts):
        full = np.searchsorted(ends, ends[start] - length[start] + size, "right")
        stop = max(start + 1, min(start + rows, int(full)))
        yield texts.slice(start, stop - start)
        start = stop


def _unit_vectors(embed: Callable[[list[str]], np.ndarray], batch: int):
    """A function's vectors in double precision, so that they are rounded once, when they are stored."""

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        flat, ends = [np.empty(0)], [np.zeros(1, np.int32)]
        for few in _few(texts, batch, EMBED_BYTES):
            found = np.asarray(embed(few.to_pylist()), dtype="float64")
            norms = np.linalg.norm(found, axis=1, keepdims=True)
            flat.append((found / np.where(norms == 0, 1, norms)).ravel())
            ends.append(ends[-1][-1] + np.arange(1, len(found) + 1, dtype=np.int32) * found.shape[1])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate(flat)))

    return run


def filter_documents(
    docs: DataFrame,
    *,
    topic: str | None = None,
    agent: str | None = None,
    language: str | None = None,
    escalation: bool | None = None,
    sentiment_max: float | None = None,
    sentiment_min: float | None = None,
) -> DataFrame:
    """Documents whose metadata meet all given conditions."""
    if language:
        check_choice("language", language, C.LANGUAGE_LABELS)

    def field(name: str) -> Column:
        return F.col(f"metadata.{name}" if "metadata" in docs.columns else name)

    wanted: list[Column] = []
    for name, value in (("topic", topic), ("agent_name", agent), ("language", language)):
        if value:
            wanted.append(field(name) == value)
    if escalation is not None:
        wanted.append(field("escalation_flag") == int(escalation))
    if sentiment_max is not None:
        wanted.append(field("customer_sentiment_overall") <= sentiment_max)
    if sentiment_min is not None:
        wanted.append(field("customer_sentiment_overall") >= sentiment_min)
    kept = docs
    for condition in wanted:
        kept = kept.where(condition)
    return kept
