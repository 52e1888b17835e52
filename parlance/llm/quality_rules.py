"""Quality rules: signals of each text, and lines that are frequent across a host's documents.

Frequent lines are found from hashes of normalised lines: per host, the distinct
texts that hold a line are counted, lines above the limits are taken out, and a
document that loses too much of its text, or has too few words left, is rejected.
Exact copies count as one text, so a document is not rejected for being copied often.

Only DataFrame functions are used. Defined results: a null text counts as empty
and is rejected by the base rules; a null host is a host of its own; repeated
rows are judged alike; an empty table gives an empty result; extra columns are
kept under any name, but one that is named like an added one is replaced.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import packed, settled, stored, text_key, unpacked, words_column
from parlance.llm.lines import all_lines, has_word, normalised, without_lines, word_chars

SYMBOLS = "#*$%&|<>"
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LEFT = ("n_frequent_lines", "n_left_words", "n_left_chars")


@dataclass(frozen=True)
class Limits:
    """When a document is rejected, and when a line is frequent on a host."""

    min_words: int = 50
    max_repeat_percent: int = 50
    line_texts: int = 10        # a frequent line is in more texts of the host than this
    line_percent: int = 2       # ... and in more than this share of them,
    many_texts: int = 100       # ... or in more than this many
    min_left_percent: int = 50  # of the characters must be left without such lines, and `min_words`


def _placed_windows(words: Column, n_windows: Column) -> Column:
    """(hash, place) of each three-word window, sorted, so that equal ones are neighbours."""
    threes = F.arrays_zip(*(
        F.slice(words, F.lit(at), n_windows).alias(name)
        for at, name in ((1, "a"), (2, "b"), (3, "c"))
    ))
    return F.sort_array(F.transform(
        threes,
        lambda w, at: F.struct(F.xxhash64(w["a"], w["b"], w["c"]).alias("h"), at.alias("at")),
    ))


def _neighbours(array: str) -> Column:
    """Each element of an array column with the next one."""
    size = F.greatest(F.size(array) - 1, F.lit(0))
    return F.arrays_zip(
        F.slice(array, F.lit(1), size).alias("a"), F.slice(array, F.lit(2), size).alias("b")
    )


def _with_signals(rows: DataFrame) -> DataFrame:
    """Add the counts of SIGNALS to packed rows, over whole texts."""
    whole = F.coalesce("text", F.lit(""))
    first = rows.withColumns({
        "words": words_column(F.col("text")),
        "held": F.filter(all_lines(F.col("text")), has_word),
        "word_chars": word_chars(F.col("text")),
        "n_symbols": (
            F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))
        ).cast("long"),
    })
    counted = first.withColumns({
        "n_words": F.size("words").cast("long"),
        "n_dup_lines": (F.size("held") - F.size(F.array_distinct("held"))).cast("long"),
    })
    windows = counted.withColumn(
        "placed",
        F.when(F.size("words") > 3, _placed_windows(F.col("words"), F.size("words") - 2)),
    )
    twice = windows.withColumn(
        "twice", F.filter(_neighbours("placed"), lambda w: w["a"]["h"] == w["b"]["h"])
    )
    places = F.sort_array(F.array_distinct(F.concat(
        F.transform("twice", lambda w: w["a"]["at"]), F.transform("twice", lambda w: w["b"]["at"])
    )))
    at = twice.withColumn("places", F.when(F.size("twice") > 0, places))
    # Each place adds three words, less what it shares with the next one.
    covered = F.aggregate(
        _neighbours("places"), F.lit(3), lambda n, w: n + F.least(F.lit(3), w["b"] - w["a"])
    )
    return at.withColumn(
        "n_repeat_words", F.coalesce(F.when(F.size("places") > 0, covered), F.lit(0)).cast("long")
    )


def base_failed(limits: Limits = Limits()) -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < limits.min_words) | (
        100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words")
    )


def host_lines(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """(host, key, check, place, line, chars, words): each line with a word of each text.

    `key` and `check` tell a text on its host from others, `line` is the hash of
    the line in the form in which lines are compared.
    """
    parts = docs.select(
        F.col(host).alias("host"), *text_key(F.col(host), F.col(text)),
        F.posexplode(all_lines(F.col(text))).alias("place", "part"),
    ).where(has_word(F.col("part")))
    formed = parts.select("host", "key", "check", "place", normalised(F.col("part")).alias("form"))
    # The words of a compared line are parted by one space each.
    bare = F.length(F.translate("form", " ", ""))
    return formed.select(
        "host", "key", "check", "place", F.xxhash64("form").alias("line"),
        bare.alias("chars"), (F.length("form") - bare + 1).alias("words"),
    )


def frequent_lines(
    lines: DataFrame, docs: DataFrame, text: str = "text", host: str = "source", limits: Limits = Limits()
) -> DataFrame:
    """(host, line): the hashes of the lines that are frequent on each host."""
    per_line = (
        lines.select("host", "line", "key", "check").distinct()
        .groupBy("host", "line").agg(F.count("*").alias("n"))
        .where(F.col("n") > limits.line_texts)
    )
    per_host = (
        docs.select(F.col(host).alias("of_host"), F.xxhash64(F.col(text)).alias("text_id"))
        .distinct()
        .groupBy("of_host").agg(F.count("*").alias("n_texts"))
    )
    return (
        per_line.join(per_host, F.col("host").eqNullSafe(F.col("of_host")))
        .where((100 * F.col("n") > limits.line_percent * F.col("n_texts")) | (F.col("n") > limits.many_texts))
        .select("host", "line")
    )


def _frequent_in_texts(docs: DataFrame, text: str, host: str, limits: Limits) -> DataFrame:
    """(key, check, lines, gone, gone_chars, gone_words) of each text that holds frequent lines."""
    lines = stored(host_lines(docs, text, host))
    frequent = stored(frequent_lines(lines, docs, text, host, limits)).withColumnsRenamed(
        {"host": "of_host", "line": "found"}
    )
    same = F.col("host").eqNullSafe(F.col("of_host")) & (F.col("line") == F.col("found"))
    return (
        lines.join(frequent, same, "left_semi")
        .select("key", "check", "place", "line", "chars", "words").distinct()
        .groupBy("key", "check").agg(
            F.collect_set("line").alias("lines"), F.count("*").alias("gone"),
            F.sum("chars").alias("gone_chars"), F.sum("words").alias("gone_words"),
        )
    )


def _judged(docs: DataFrame, text: str, host: str, limits: Limits) -> DataFrame:
    """Packed rows with key, check, the signals, what is left, `lines` to take out, and kept.

    The lines of all texts are hashed once and stored; which of them are frequent
    is joined to them by host and line, and what each distinct text loses is kept.
    """
    key, check = text_key(F.col(host), F.col(text))
    hits = settled(docs.sparkSession, lambda: _frequent_in_texts(docs, text, host, limits))
    # The text stays out of the packed row, so that no shuffle carries it where it isn't asked for.
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("row")
    rows = docs.select(row, F.col(text).alias("text"), key, check)
    joined = _with_signals(rows).join(hits, ["key", "check"], "left")
    return joined.withColumns({
        "base_failed": base_failed(limits),
        "n_frequent_lines": F.coalesce("gone", F.lit(0).cast("long")),
        "n_left_words": F.col("n_words") - F.coalesce("gone_words", F.lit(0)),
        "n_left_chars": F.col("word_chars") - F.coalesce("gone_chars", F.lit(0)),
    }).withColumn(
        "kept",
        ~F.col("base_failed") & (F.col("n_left_words") >= limits.min_words)
        & (100 * F.col("n_left_chars") >= limits.min_left_percent * F.col("word_chars")),
    )


def _left_text() -> Column:
    return F.when(F.col("lines").isNull(), F.col("text")).otherwise(
        without_lines(F.col("text"), F.col("lines"))
    )


def quality_rules(
    docs: DataFrame, text: str = "text", host: str = "source", limits: Limits = Limits()
) -> DataFrame:
    """Add the signals, base_failed, what is left without frequent lines, left_text and kept."""
    done = _judged(docs, text, host, limits).withColumn("left_text", _left_text())
    added = [*SIGNALS, "base_failed", *LEFT, "left_text", "kept"]
    kept = [
        (F.col("text") if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c not in added
    ]
    return done.select(*kept, *added)


def quality_verdicts(
    docs: DataFrame, text: str = "text", host: str = "source", limits: Limits = Limits()
) -> DataFrame:
    """(key, check, kept, lines): the verdict on each distinct text of each host, and the
    hashes of the frequent lines to take out of it (null: none)."""
    return _judged(docs, text, host, limits).groupBy("key", "check").agg(
        F.any_value("kept").alias("kept"), F.any_value("lines").alias("lines")
    )


def kept_texts(
    docs: DataFrame, verdicts: DataFrame, text: str = "text", host: str = "source"
) -> DataFrame:
    """The documents that are kept by stored verdicts, with left_text.

    Verdicts grow with the texts, so they are joined by one shuffle at every size;
    the rows of a hot text are split by the skew join.
    """
    key, check = text_key(F.col(host), F.col(text))
    rows = packed(docs, text=text, key=key, check=check)
    found = rows.join(verdicts.where("kept").hint("merge"), ["key", "check"])
    return unpacked(found.withColumn("left_text", _left_text()), docs.columns, ["left_text"])
