"""Lines of a text, and the form in which they are compared across documents."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.llm.common import SPACE_PATTERN, SPACES

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def all_lines(text: Column) -> Column:
    """The parts of a text between line feeds; none for a null text."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES)) != ""


def normalised(line: Column) -> Column:
    """A line without outer space, inner runs as one space, A-Z folded.

    Digits stay: rows of figures, or log lines, that differ in numbers only are not one line.
    """
    single = F.regexp_replace(F.btrim(line, F.lit(SPACES)), SPACE_PATTERN, " ")
    return F.translate(single, UPPER, UPPER.lower())


def line_hash(line: Column) -> Column:
    return F.xxhash64(normalised(line))


def line_hashes(text: Column) -> Column:
    """Distinct hashes of the lines of a text that have a word."""
    lines = F.filter(all_lines(text), has_word)
    return F.array_distinct(F.transform(lines, line_hash))


def without_lines(text: Column, hashes: Column) -> Column:
    """The text without the lines whose hash is listed; lines without a word stay."""
    kept = F.filter(
        all_lines(text),
        lambda line: ~(has_word(line) & F.array_contains(hashes, line_hash(line))),
    )
    return F.array_join(kept, "\n")


def word_chars(text: Column) -> Column:
    """Code points of a text besides the six spaces."""
    return F.length(F.translate(F.coalesce(text, F.lit("")), SPACES, "")).cast("long")
