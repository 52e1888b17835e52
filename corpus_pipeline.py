"""A corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

`run` applies the stages to the documents table; each stage is written and read
again before the next. The packing stage returns the batches. A stage leaves small
tables of keys behind in the shared folder, no texts.

Defined results: a null or empty text is rejected by the quality rules; a null
source is a host of its own there, counts for no line in the line dedup, and is a
source of its own in the mix; a row with a null id is a near-duplicate of nothing;
of rows that repeat an id with different texts, all stay or none; rows that repeat
wholly are treated alike; further columns are carried along under any name; an
empty table gives empty stages.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import settled, stored, table
from parlance.llm.line_dedup import line_dedup
from parlance.llm.minhash import near_duplicates
from parlance.llm.mixing import mixed_documents
from parlance.llm.packing import pack
from parlance.llm.quality_rules import kept_texts, quality_verdicts


def _framed(docs: DataFrame) -> DataFrame:
    """Text and source, and the other columns out of the operators' way."""
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars")))
    return docs.select(rest.alias("_rest"), "text", "source")


def _unframed(judged: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs`, with the text that is left and its number of characters."""
    new = {"text": F.col("left_text"), "n_chars": F.length("left_text").cast(docs.schema["n_chars"].dataType)}
    return judged.select(*(new.get(c, F.col(f"_rest.`{c}`")).alias(c) for c in docs.columns))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; frequent lines leave the others.

    The verdict on each text and host is stored before it is filtered on: a filter
    on an unstored one would be moved to the scan, with all signals copied into it.
    """
    framed = _framed(docs)
    verdicts = settled(spark, lambda: quality_verdicts(framed))
    return _unframed(kept_texts(framed, verdicts), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines leave the texts; every document stays."""
    return _unframed(line_dedup(_framed(docs)), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    gone = settled(spark, lambda: near_duplicates(docs).where("NOT kept").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed_documents(docs)


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch, slot and padding of each document."""
    return pack(docs)


STAGES = [
    ("quality rules", rules),
    ("line dedup", lines),
    ("near dedup", near),
    ("source mix", mix),
    ("packing", batches),
]

# Seeded selection and the dynamic program have no SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
