"""Scoring of answers against evaluation specs."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance import constants as C


def _listed(column: str):
    return F.coalesce(column, F.array().cast("array<string>"))


def tool_selection(answers: DataFrame) -> DataFrame:
    """Add tool_selection_pass: was any expected tool used?"""
    used = F.arrays_overlap(_listed("expected_tools"), _listed("tools_used"))
    return answers.withColumn("tool_selection_pass", F.coalesce(used, F.lit(False)))


def keyword_coverage(answers: DataFrame) -> DataFrame:
    """Add coverage_matched, coverage_missed and coverage, the share of keywords found.

    Case does not matter; without keywords the coverage is 1.0.
    """
    lowered = answers.withColumn("_answer", F.lower("answer")).withColumn(
        "_keywords", _listed("expected_keywords")
    )
    found = lambda word: F.contains(F.col("_answer"), F.lower(word))
    share = F.try_divide(F.size("coverage_matched"), F.size("_keywords"))
    return (
        lowered
        .withColumn("coverage_matched", F.filter("_keywords", found))
        .withColumn("coverage_missed", F.filter("_keywords", lambda word: ~found(word)))
        .withColumn("coverage", F.coalesce(share, F.lit(1.0)))
        .drop("_answer", "_keywords")
    )


def evidence_pass(answers: DataFrame) -> DataFrame:
    """Add evidence_pass: is there as much evidence as asked for?"""
    wanted = F.coalesce("min_evidence", F.lit(0))
    return answers.withColumn("evidence_pass", F.col("evidence_count") >= wanted)


def eval_status(scored: DataFrame) -> DataFrame:
    """Add status from the three checks: all pass, two partial, fewer fail."""
    passed = (
        F.col("tool_selection_pass").cast("int")
        + (F.col("coverage") >= C.COVERAGE_PASS).cast("int")
        + F.col("evidence_pass").cast("int")
    )
    return scored.withColumn(
        "status",
        F.when(passed == 3, "pass").when(passed == 2, "partial").otherwise("fail"),
    )


def score_answers(answers: DataFrame, specs: DataFrame | None = None) -> DataFrame:
    """All checks for each answer; an answer with an error fails them all.

    `specs` (id, category, language, expected_tools, expected_keywords,
    min_evidence) is joined by id unless the answers already carry its columns.
    """
    asked = answers if specs is None else answers.join(specs, "id")
    failed = F.col("error").isNotNull()
    answered = asked.withColumns({
        "answer": F.when(failed, "").otherwise(F.col("answer")),
        "evidence_count": F.when(failed, 0).otherwise(F.col("evidence_count")),
        "tools_used": F.when(~failed, F.col("tools_used")),
    })
    scored = evidence_pass(keyword_coverage(tool_selection(answered)))
    checked = scored.withColumns({
        "tool_selection_pass": ~failed & F.col("tool_selection_pass"),
        "evidence_pass": ~failed & F.col("evidence_pass"),
        "coverage": F.when(failed, 0.0).otherwise(F.col("coverage")),
        "coverage_matched": F.when(failed, F.array().cast("array<string>"))
        .otherwise(F.col("coverage_matched")),
        "coverage_missed": F.when(failed, _listed("expected_keywords"))
        .otherwise(F.col("coverage_missed")),
    })
    return eval_status(checked).withColumns({
        "coverage": F.round("coverage", 3),
        "latency_s": F.round("latency_s", 2),
    })


def eval_summary(scored: DataFrame) -> DataFrame:
    """One row: status rates, latency mean, median and p95, mean grounding; 0 if empty.

    Rows are first summed per latency, then numbered inside blocks of latencies
    that grow with the logarithm; there are a few thousand blocks at most, and
    only these meet in one window.
    """
    counted = scored.groupBy(F.round("latency_s", 2).alias("latency_s")).agg(
        F.count("*").alias("n"),
        F.sum("grounding_score").alias("grounding"),
        F.count("grounding_score").alias("n_grounding"),
        *[F.count_if(F.col("status") == s).alias(s) for s in C.EVAL_STATUSES],
    )
    cents = F.col("latency_s") * 100
    blocked = counted.withColumn(
        "_block",
        F.when(F.col("latency_s").isNull(), -1)
        .when(cents > 0, F.floor(F.log2(1 + cents) * 64)).otherwise(0).cast("int"),
    )
    upto = Window.partitionBy(F.lit(0)).orderBy("_block")
    blocks = blocked.groupBy("_block").agg(F.sum("n").alias("_n")).withColumns({
        "_before": F.sum("_n").over(upto) - F.col("_n"),
        "_last": F.sum("_n").over(Window.partitionBy(F.lit(0))) - 1,
    }).drop("_n")
    inside = Window.partitionBy("_block").orderBy("latency_s")
    placed = blocked.withColumn("_inside", F.sum("n").over(inside)).join(
        F.broadcast(blocks), "_block"
    ).withColumn("_seen", F.col("_before") + F.col("_inside"))

    def at(position):
        """The latency at a 0-based position of the sorted list."""
        return F.min(F.when(F.col("_seen") > position, F.col("latency_s")))

    def rounded(value, digits):
        return F.coalesce(F.round(value, digits), F.lit(0.0))

    last, total = F.col("_last"), F.sum("n")
    median = (at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2
    return placed.agg(
        F.coalesce(total, F.lit(0)).alias("n_questions"),
        *[rounded(F.try_divide(F.sum(s), total), 3).alias(f"{s}_rate") for s in C.EVAL_STATUSES],
        rounded(F.try_divide(F.sum(F.col("latency_s") * F.col("n")), total), 2)
        .alias("mean_latency_s"),
        rounded(median, 2).alias("median_latency_s"),
        rounded(at(F.floor(last * F.lit(0.95).cast("double"))), 2).alias("p95_latency_s"),
        F.round(F.try_divide(F.sum("grounding"), F.sum("n_grounding")), 3)
        .alias("mean_grounding"),
    )


def pass_rate_by(scored: DataFrame, key: str) -> DataFrame:
    """Share of passed questions per category or language."""
    passed = (F.col("status") == "pass").cast("int")
    return scored.groupBy(key).agg(F.round(F.avg(passed), 3).alias("pass_rate"))
