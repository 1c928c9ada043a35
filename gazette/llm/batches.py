"""How much text goes to Python at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Spark's default of 10,000 rows is meant for numbers; of texts it is tens of megabytes, several times over on either side.
ROWS = 1000


def bounded(df: DataFrame) -> DataFrame:
    """The frame, with its session set to send at most ROWS rows to Python at a time; a lower setting stays."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(KEY)) <= ROWS:
        conf.set(KEY, str(ROWS))
    return df


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of about `size` bytes, put together from smaller ones."""
    held, have = [], 0
    for batch in batches:
        held.append(batch)
        have += batch.nbytes
        if have >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, have = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def release() -> None:
    """Gives memory that Python and Arrow have freed back to the system; else a worker keeps its largest task's peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """A function over batches that gives freed memory back after each batch and at its end."""

    def wrapped(batches):
        for batch in run(batches):
            yield batch
            release()
        release()

    return wrapped
