import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.compare import session  # noqa: E402
from parlance import schema  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    found = session("4")
    found.sparkContext.setLogLevel("ERROR")
    found.conf.set("spark.sql.shuffle.partitions", "4")
    yield found
    found.stop()


@pytest.fixture(scope="session")
def topics(spark):
    from parlance.sources.taxonomy import taxonomy_tables

    return taxonomy_tables(spark)


@pytest.fixture
def turns_of(spark):
    """Build turns from dicts; what is left out is NULL."""

    def build(*rows):
        names = schema.TURNS.fieldNames()
        full = [
            tuple({"conv_id": "c1", "role": "customer", **row}.get(n) for n in names)
            for row in rows
        ]
        text = ", ".join(
            f"{f.name} {'string' if 'timestamp' in f.dataType.simpleString() else f.dataType.simpleString()}"
            for f in schema.TURNS
        )
        df = spark.createDataFrame(full, text)
        return df.withColumns({
            c: df[c].cast("timestamp") for c in ("timestamp", "classified_at")
        })

    return build
