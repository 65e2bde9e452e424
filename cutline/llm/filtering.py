"""Filtering documents by a decision on each text, as a map: no join, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def keep_rows(docs: DataFrame, text_col: str, decide: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """Rows of docs for whose text decide is true, all columns as they were.

    decide gets a string array, nulls included, and returns a boolean array.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(decide(batch.column(at)))) if batch.num_rows else batch

    return docs.mapInArrow(run, docs.schema)
