"""Labelling of distinct texts, and copying of labels onto turns.

A text is labelled once, however many turns hold it. The labeller is a plug: a
function over pandas batches, or the built-in keyword rules.
"""

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance import constants as C
from parlance.functions.text import redact_pii, strip
from parlance.operators.keyed import lookup_join, with_digest
from parlance.schema import ANSWERS, LABEL_COLUMNS, LABELS, RAW_LABELS

# Keyword rules of the built-in labeller: (label, pattern), first match wins.
INTENT_RULES = (
    ("escalation_request", r"(?i)\b(escalate|manager|supervisor)\b"),
    ("urgency_request", r"(?i)\b(urgent|urgently|asap|immediately|jaldi|expedite)\b"),
    ("resolution_confirmation", r"(?i)\b(resolved|works now|issue fixed)\b"),
    ("thanks", r"(?i)\b(thanks|thank you|dhanyavaad|purchase)\b"),
    ("apology", r"(?i)\b(sorry|apologi[sz]e|regret)\b"),
    ("complaint", r"(?i)\b(error|crash|not working|failed|charged twice|hasn.?t arrived)\b"),
    ("info_request", r"(?i)\b(please (share|confirm|provide))\b"),
    ("solution_offer", r"(?i)\b(refund(ed)?|reset|replacement) (is|has been|will be)\b"),
    ("status_update", r"(?i)\b(checking|investigating|in progress)\b"),
    ("acknowledgement", r"(?i)\b(okay|ok|got it|noted|view)\b"),
    ("query", r"(\?|(?i)\bhelp\b)"),
)
EMPATHETIC_RULE = r"(?i)\b(sorry|apologi[sz]e|understand|regret)\b"
DISMISSIVE_RULE = r"(?i)\b(cannot help|not our problem|as per policy)\b"
POSITIVE_RULE = r"(?i)\b(thanks|thank you|great|resolved|purchase|works now)\b"
NEGATIVE_RULE = r"(?i)\b(error|crash|failed|not working|charged twice|urgent|frustrated)\b"
HINDI_RULE = r"(?i)\b(mujhe|hai|mein|baare|chahiye|jaldi|nahi|ho)\b"
ENGLISH_RULE = r"(?i)\b(the|is|my|with|help|please|while|of|and)\b"

# Text that a match of a rule holds in lower case, one of these at least: to look for it costs far less
# than the rule. Rules of short words have none.
RULE_HINTS = {
    "escalation_request": ("escalate", "manager", "supervisor"),
    "urgency_request": ("urgent", "asap", "immediately", "jaldi", "expedite"),
    "resolution_confirmation": ("resolved", "works now", "issue fixed"),
    "thanks": ("thank", "dhanyavaad", "purchase"),
    "apology": ("sorry", "apologi", "regret"),
    "complaint": ("error", "crash", "not working", "failed", "charged twice", "t arrived"),
    "info_request": ("please ",),
    "solution_offer": ("refund", "reset", "replacement"),
    "status_update": ("checking", "investigating", "in progress"),
    "acknowledgement": ("ok", "got it", "noted", "view"),
    "query": ("?", "help"),
    EMPATHETIC_RULE: ("sorry", "apologi", "understand", "regret"),
    DISMISSIVE_RULE: ("cannot help", "not our problem", "per policy"),
    POSITIVE_RULE: ("thank", "great", "resolved", "purchase", "works now"),
    NEGATIVE_RULE: ("error", "crash", "failed", "not working", "charged twice", "urgent", "frustrated"),
}


def pending_texts(
    turns: DataFrame, labels: DataFrame, limit: int | None = None
) -> DataFrame:
    """Distinct (text_clean, role) whose text has no label yet."""
    pending = (
        turns.select("text_clean", "role").distinct()
        .join(labels.select("text_clean"), "text_clean", "left_anti")
        .select("text_clean", "role")
    )
    return pending if limit is None else pending.orderBy("text_clean", "role").limit(limit)


def rule_labels(pending: DataFrame) -> DataFrame:
    """Labels from the keyword rules, as plain column expressions."""
    text = F.col("text_clean")

    def hinted(rule: str) -> Column:
        found = [F.contains(F.col("_low"), F.lit(hint)) for hint in RULE_HINTS[rule]]
        return reduce(Column.__or__, found)

    def fits(pattern: str, rule: str | None = None) -> Column:
        return hinted(rule or pattern) & text.rlike(pattern)

    def count(pattern: str) -> Column:
        return F.when(~hinted(pattern), 0).otherwise(F.regexp_count(text, F.lit(pattern)))

    intent = F.lit("other")
    for label, pattern in reversed(INTENT_RULES):
        intent = F.when(fits(pattern, label), label).otherwise(intent)
    balance, found = F.col("_pos") - F.col("_neg"), F.col("_pos") + F.col("_neg")
    hindi, english = text.rlike(HINDI_RULE), text.rlike(ENGLISH_RULE)
    return (
        pending
        .withColumn("_low", F.lower(text))
        .withColumns({"_pos": count(POSITIVE_RULE), "_neg": count(NEGATIVE_RULE), "_intent": intent})
        .select(
            "text_clean",
            "role",
            F.when(balance > 0, "pos").when(balance < 0, "neg").otherwise("neu")
            .alias("sentiment_label"),
            F.coalesce(
                F.try_divide(balance.cast("double"), found.cast("double")), F.lit(0.0)
            ).alias("sentiment_score"),
            F.col("_intent").alias("intent"),
            F.when(F.col("role") != "agent", "na")
            .when(fits(EMPATHETIC_RULE), "empathetic")
            .when(fits(DISMISSIVE_RULE), "dismissive")
            .otherwise("neutral").alias("empathy_signal"),
            (F.col("_intent") == "escalation_request").cast("int").alias("is_escalation"),
            (redact_pii(text) != text).cast("int").alias("contains_pii"),
            F.when(hindi & english, "mixed").when(hindi, "hi").otherwise("en")
            .alias("language"),
            text.alias("text_en"),
        )
    )


def label_texts(
    pending: DataFrame,
    labeller: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
    partitions: int | None = None,
    batch_size: int = 25,
) -> DataFrame:
    """Label (text_clean, role) pairs with the rules or with a supplied labeller.

    A labeller takes and returns pandas frames of up to `batch_size` rows;
    `partitions` bounds how many run at a time. Write the result before using
    it twice, or the labeller runs twice.
    """
    if labeller is None:
        # max() keeps a filter on the labels from being moved below the grouping,
        # where the rules would run once per turn and not once per text.
        once = pending.groupBy(F.col("text_clean").alias("_text"), "role").agg(
            F.max("text_clean").alias("text_clean")
        )
        return rule_labels(once.select("text_clean", "role"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                yield labeller(frame.iloc[start:start + batch_size])

    spread = pending.repartition(partitions, "text_clean") if partitions else pending
    return spread.mapInPandas(run, RAW_LABELS)


def label_batches(
    labeller: Callable[[pd.DataFrame], pd.DataFrame],
    batch_size: int = 25,
    workers: int = 4,
    attempts: int = 3,
    wait: float = 1.0,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A labeller as a function for mapInArrow that outlives failing batches.

    A task asks for at most `workers` batches at a time, each up to `attempts`
    times with a wait that doubles. A batch fails too if its answers lack a column
    or have values of another type; further columns are left out. A batch without
    answers gives its texts with the last error in `failure`.
    """
    kinds = {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    layout = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in ANSWERS])

    def typed(answers: pd.DataFrame) -> pa.RecordBatch:
        return pa.RecordBatch.from_pandas(answers.astype(object), layout, preserve_index=False)

    def ask(batch: pd.DataFrame) -> pa.RecordBatch:
        failure = None
        for attempt in range(attempts):
            if attempt:
                time.sleep(wait * 2 ** (attempt - 1))
            try:
                return typed(labeller(batch.copy()).assign(failure=None))
            except Exception as error:
                failure = f"{type(error).__name__}: {error}"
        return typed(batch.assign(failure=failure).reindex(columns=layout.names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(workers) as pool:
            for rows in batches:
                # As many batches as workers, so that no more answers wait in memory.
                for at in range(0, rows.num_rows, batch_size * workers):
                    frame = rows.slice(at, batch_size * workers).to_pandas()
                    parts = range(0, len(frame), batch_size)
                    yield from pool.map(ask, [
                        frame.iloc[start:start + batch_size].reset_index(drop=True)
                        for start in parts
                    ])

    return run


def _outside(column: str, allowed: tuple) -> Column:
    return ~F.coalesce(F.col(column).isin(*allowed), F.lit(False))


def check_labels(raw: DataFrame) -> DataFrame:
    """Add `error`, the first rule a labelled text breaks, NULL if it is valid."""
    score = F.col("sentiment_score")
    in_range = F.coalesce(score.between(-1.0, 1.0), F.lit(False))
    text_en = F.coalesce(strip(F.col("text_en")), F.lit(""))
    error = (
        F.when(_outside("sentiment_label", C.SENTIMENT_LABELS), "bad sentiment_label")
        .when(~in_range, "sentiment_score out of range")
        .when(_outside("intent", C.INTENT_LABELS), "bad intent")
        .when(_outside("empathy_signal", C.EMPATHY_LABELS), "bad empathy_signal")
        .when(_outside("is_escalation", (0, 1)), "bad is_escalation")
        .when(_outside("contains_pii", (0, 1)), "bad contains_pii")
        .when(_outside("language", C.LANGUAGE_LABELS), "bad language")
        # The translation of an empty text is empty.
        .when((text_en == "") & (strip(F.col("text_clean")) != ""), "text_en is empty")
    )
    return raw.withColumn("error", error)


def validate_labels(
    raw: DataFrame,
    classified_at: str,
    model: str = "rules",
    pending: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Split labelled texts into (accepted, rejected).

    Accepted rows are ready for the label table; a customer's empathy label
    becomes `na`. With `pending`, labels for pairs that were not asked for are
    rejected, and pairs that got none are listed as rejected too.
    """
    checked = check_labels(raw)
    if pending is not None:
        asked = pending.select("text_clean", "role").withColumn("_asked", F.lit(True))
        checked = checked.withColumn("_labelled", F.lit(True)).join(
            asked, ["text_clean", "role"], "full"
        )
        checked = checked.withColumn(
            "error",
            F.when(F.col("_asked").isNull(), "not asked for")
            .when(F.col("_labelled").isNull(), "no label returned")
            .otherwise(F.col("error")),
        ).drop("_asked", "_labelled")
    accepted = checked.where("error IS NULL").select(
        "text_clean",
        "role",
        "sentiment_label",
        "sentiment_score",
        "intent",
        F.when(F.col("role") == "customer", "na").otherwise(F.col("empathy_signal"))
        .alias("empathy_signal"),
        "is_escalation",
        "contains_pii",
        "language",
        strip(F.col("text_en")).alias("text_clean_en"),
        F.lit(classified_at).cast("timestamp").alias("classified_at"),
        F.lit(model).alias("model"),
    )
    return accepted, checked.where("error IS NOT NULL")


def upsert_labels(labels: DataFrame, new: DataFrame) -> DataFrame:
    """One row per text: new labels replace old ones, role `agent` before `customer`."""
    columns = LABELS.fieldNames()
    both = labels.select(*columns, F.lit(0).alias("_new")).unionByName(
        new.select(*columns, F.lit(1).alias("_new"))
    )
    newest = Window.partitionBy("text_clean").orderBy(
        F.desc("_new"), "role", F.desc("classified_at"), F.xxhash64(*columns)
    )
    return (
        both.withColumn("_rank", F.row_number().over(newest))
        .where("_rank = 1").select(*columns)
    )


def propagate_labels(turns: DataFrame, labels: DataFrame) -> DataFrame:
    """Copy a text's labels onto every turn that holds it; other turns keep theirs.

    Texts are compared by 128 bits of them, so that a text is no key of a join.
    `labels` should be a stored table: its size decides how it is joined.
    """
    found = with_digest(labels.where("text_clean IS NOT NULL"), "text_clean").select(
        "_d1", "_d2",
        F.lit(True).alias("_found"),
        *[F.col(c).alias(f"_{c}") for c in LABEL_COLUMNS],
    )
    joined = lookup_join(
        with_digest(turns, "text_clean"), found, ["_d1", "_d2"], "left", measure=True
    )
    new = {
        c: F.when(F.col("_found"), F.col(f"_{c}")).otherwise(F.col(c))
        if c in turns.columns else F.col(f"_{c}")
        for c in LABEL_COLUMNS
    }
    return joined.withColumns(new).select(
        *turns.columns, *[c for c in LABEL_COLUMNS if c not in turns.columns]
    )


def unlabelled_gate(turns: DataFrame) -> int:
    """Number of turns without a sentiment label."""
    return turns.where("sentiment_label IS NULL").count()


def require_labelled(turns: DataFrame) -> DataFrame:
    """The same turns; the job that reads them fails on an unlabelled one."""
    missing = F.raise_error(F.lit("a turn has no sentiment label; label all texts first"))
    return turns.where(
        F.when(F.col("sentiment_label").isNull(), missing.cast("boolean")).otherwise(True)
    )
