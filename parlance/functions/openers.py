"""Column functions over a conversation's opening text."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance import constants as C
from parlance.functions.text import strip


def plain_apostrophes(text: Column) -> Column:
    """Curly apostrophes written as ASCII ones."""
    return F.translate(text, "’", "'")


def extract_slot(
    opener: Column,
    templates: Sequence[tuple[str, str]] = C.SLOT_TEMPLATES,
    no_slot: Sequence[str] = C.NO_SLOT_OPENERS,
) -> tuple[Column, Column]:
    """(slot, template id) of an opener; the first template that matches decides.

    A no-slot opener has its own template id and a NULL slot; an unknown opener
    has neither. `(?d)` keeps `\\n` as the only line end.
    """
    known = opener.isin(*no_slot)
    slot = F.when(known, F.lit(None).cast("string"))
    template = F.when(known, F.lit(C.NO_SLOT_TEMPLATE))
    for name, pattern in templates:
        hit = opener.rlike("(?d)" + pattern)
        slot = slot.when(hit, strip(F.regexp_extract(opener, "(?d)" + pattern, 1)))
        template = template.when(hit, F.lit(name))
    return slot, template
