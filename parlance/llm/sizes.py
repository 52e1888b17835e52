"""Word counts of whole texts."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parlance.llm.common import by_slices, words_of


def with_word_counts(docs: DataFrame, text: str, into: str) -> DataFrame:
    """The table with its text replaced by the text's number of words; null has none."""
    others = [f for f in docs.schema.fields if f.name != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + [f"`{into}` long"])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = np.diff(words_of(batch[text]).first)
        columns = [batch[f.name] for f in others] + [pa.array(counts, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, [f.name for f in others] + [into])

    return by_slices(docs, text, schema, work)
