"""Filtering rows of a DataFrame by a function of Arrow batches, with their columns as they are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinforge.llm._arrays import text_slices


def rows_kept(docs: DataFrame, mask: Callable[[], Callable[[pa.RecordBatch], np.ndarray]]) -> DataFrame:
    """Rows of ``docs`` for which the function that ``mask()`` makes on each task is true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = mask()
        for big in batches:
            for batch in text_slices(big, "text", 1 << 19):
                yield batch.filter(pa.array(keep(batch)))

    return docs.mapInArrow(run, docs.schema)
