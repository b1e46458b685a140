"""Small helpers for operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows of one Arrow batch.  A batch holds whole texts, so this bounds memory.
BATCH_ROWS = 512
#: Bytes of one Arrow batch; a longer row is a batch of its own.
BATCH_BYTES = "8m"
#: Characters of the texts that are worked on together.
BATCH_CHARS = 2_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Make Spark hand texts to Python in small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def texts_of(column: pa.Array) -> list[str]:
    """Texts of a batch; null counts as the empty text."""
    return [t or "" for t in column.to_pylist()]


def runs_of(texts: list[str], chars: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``texts`` of at most ``chars`` characters, a longer text alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > chars:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def longs(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64))
