"""Arrow batches in slices, so that a task's Python lists stay small next to the other workers'; hashes of texts."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ROWS = 500


def give_back() -> None:
    """Memory that this worker's earlier tasks freed goes back to the system: a worker serves one stage after another."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim is not None:
        trim(0)


def small(batches, rows: int = ROWS):
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def text_hashes(text: Column) -> list[Column]:
    """Two hashes that tell texts apart, of 62 and 64 bits (the first one's sign extended)."""
    text = text.cast("string")
    return [F.shiftright(F.xxhash64(text), 2), F.xxhash64(F.lit(1), text)]
