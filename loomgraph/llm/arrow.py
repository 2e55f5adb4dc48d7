"""Feeding whole texts to numpy in slices of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20


#: Rows of an Arrow batch of whole texts; Spark's own default is made for narrow rows.
BATCH_ROWS, SPARK_BATCH_ROWS = 1000, 10_000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark) -> None:
    """Keep what a task holds of texts outside the heap to a few MB, unless the session sets its own batch size."""
    if int(spark.conf.get(_ROWS)) == SPARK_BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that their texts hold about size bytes each; rows keep their order."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        each = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(each) - each) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
        del batch, each, part
        release()


def release() -> None:
    """Give freed memory back to the system: a worker serves one task after another."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts as strings; null is empty."""
    return [t or "" for t in batch.column(column).to_pylist()]
