"""Bounds of what goes to Python workers at once, and what they give back."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch to a worker, where the session doesn't say; Spark's own bound is 64 MB, which a worker holds in several forms.
BYTES_KEY, BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "1m"
#: Characters of the texts, and items of the lists, that a worker turns into one batch.
SLICE = 1 << 20


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of this session in bytes unless it does so itself."""
    if spark.conf.get(BYTES_KEY, None) is None:
        spark.conf.set(BYTES_KEY, BYTES)
    return spark


def slices(texts: Sequence[str | None], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some ``most`` characters together; each text is whole."""
    begin = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def int_lists(rows: Sequence[Sequence[int]]) -> pa.Array:
    """Lists of integers as one array, without a Python object for each row in between."""
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in rows], out=offsets[1:])
    values = np.empty(offsets[-1], dtype=np.int32)
    for k, x in enumerate(rows):
        values[offsets[k] : offsets[k + 1]] = x
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
