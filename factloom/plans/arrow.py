"""How the Python operators run over Arrow batches.

``map_rows`` takes some columns through a plain function, a slice of a batch at
a time, so that memory is bounded by bytes and not by a count of rows.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of input that a function gets at once; one row may be longer.
SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes, at least one row each."""
    n, start = batch.num_rows, 0
    step = max(1, int(n * limit / max(limit, batch.nbytes)))
    while start < n:
        yield batch.slice(start, step)
        start += step


@contextlib.contextmanager
def no_cycles() -> Iterator[None]:
    """Python's cycle collector rests: large dictionaries make it slow, and the work within makes no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which gives its memory back to the system at its end: the worker waits for its next task beside others that need it."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the system's library has it
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def map_rows(df: DataFrame, make: Callable[[], Callable[..., dict]], schema: StructType) -> DataFrame:
    """``df`` through ``make()``, called once a task; what it returns is called with a list for each column.

    It returns a list or array for each column of ``schema``.
    """
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for batch in slices(whole):
                with no_cycles():
                    out = work(*(c.to_pylist() for c in batch.columns))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if not isinstance(out[f.name], pa.Array) else out[f.name] for f in target], schema=target)

    return df.mapInArrow(giving_back(run), schema)
