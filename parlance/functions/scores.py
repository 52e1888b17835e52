"""Column functions over turn labels."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance import constants as C


def empathy_score(signal: Column) -> Column:
    """Score of an empathy label; NULL for `na`, NULL and anything unknown."""
    score = F.lit(None).cast("double")
    for label, value in C.EMPATHY_SCORES.items():
        score = F.when(signal == label, F.lit(value)).otherwise(score)
    return score


def closes_conversation(role: Column, intent: Column) -> Column:
    """1 for a customer turn that confirms a resolution or says thanks, else 0."""
    closing = (role == "customer") & intent.isin(*C.CLOSING_INTENTS)
    return F.when(closing, F.lit(1)).otherwise(F.lit(0))


def present(text: Column) -> Column:
    """An empty string counts as missing."""
    return F.nullif(text, F.lit(""))
