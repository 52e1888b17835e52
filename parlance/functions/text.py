"""Column functions over text: truncation, tidying, redaction, excerpts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance import constants as C

# Unicode white space, as a set of characters to trim and as a pattern class.
SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(
    chr(code) for code in [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
SPACE_CLASS = (
    r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"


def strip(text: Column) -> Column:
    """Trim Unicode white space at both ends (Spark's own trim takes only blanks)."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def truncate_last_terminator(text: Column) -> Column:
    """Text up to its last `.`, `!` or `?`, trimmed; '' without one or for NULL."""
    head = F.regexp_extract(text, r"(?s)^(.*[.!?])", 1)
    return F.coalesce(strip(head), F.lit(""))


def tidy_spaces(text: Column) -> Column:
    """Collapse white space, trim, and close the gap before punctuation."""
    single = strip(F.regexp_replace(text, f"[{SPACE_CLASS}]+", " "))
    return F.regexp_replace(single, " ([.,!?;:])", "$1")


def redact_pii(text: Column) -> Column:
    r"""Replace e-mail addresses, then card numbers, then phone numbers.

    `(?U)` gives digits and word boundaries their Unicode meaning; blanks are those
    of SPACE_CLASS, which holds the four separators that `(?U)\s` lacks. Texts
    without an @ or without a stretch of digits skip the costly patterns: every
    card or phone number holds such a stretch.
    """
    no_mail = F.when(
        F.contains(text, F.lit("@")),
        F.regexp_replace(text, "(?U)" + C.EMAIL_PATTERN, C.EMAIL_MARK),
    ).otherwise(text)
    no_card = F.regexp_replace(no_mail, "(?U)" + C.CARD_PATTERN, C.CARD_MARK)
    no_phone = F.regexp_replace(
        no_card, "(?U)" + C.PHONE_PATTERN.replace(r"\s", SPACE_CLASS), C.PHONE_MARK
    )
    digits = text.rlike(r"\p{Nd}[\p{Nd}" + SPACE_CLASS + r"().-]{7,}\p{Nd}")
    return F.when(digits, no_phone).otherwise(no_mail)


def doc_excerpt(document: Column, lines: int = 6) -> Column:
    """First lines of a document; a final line break does not start a line."""
    # One more piece than wanted, so that the rest of a long text is not split.
    pieces = F.split(document, LINE_BREAK, lines + 1)
    ends_open = (F.size(pieces) <= lines) & (F.element_at(pieces, -1) == "")
    wanted = F.when(ends_open, F.size(pieces) - 1).otherwise(F.lit(lines))
    return F.array_join(F.slice(pieces, F.lit(1), wanted), "\n")
