import pytest

TEXT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text[, source]) tuples."""

    def build(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, TEXT_SCHEMA)

    return build


@pytest.fixture
def with_clashes():
    """Add columns whose names the operators use for themselves."""

    def add(df):
        from pyspark.sql import functions as F

        names = ("id", "key", "row", "host", "lines", "words", "h", "node", "line", "site", "rest", "pattern",
                 "size", "hash", "length", "block", "hits", "check", "times", "copy", "places", "fit", "bands")
        return df.withColumns({n: F.lit(f"own {n}") for n in names if n not in df.columns})

    return add
