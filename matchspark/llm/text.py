"""Small helpers that the corpus operators share inside tasks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

#: ASCII white space of the word pattern [^\x20\x09-\x0D]+; bytes.split() uses the same set.
SPACE = "[\\x20\\x09-\\x0D]"


def words_of(text: str | None) -> list[bytes]:
    """The UTF-8 words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def crc_of_ids(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


#: What gives up memory that a worker process keeps between tasks; modules with such memory add to it.
KEPT: list[Callable[[], None]] = []


def give_back() -> None:
    """Return memory that is not in use to the machine; workers live on between tasks of different kinds."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # C libraries without it
        ctypes.CDLL(None).malloc_trim(0)


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a worker holds few texts at a time; memory goes back before and after them."""
    for forget in KEPT:
        forget()
    give_back()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch  # before the next is read
    del batches
    give_back()


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Spark hands ``rows`` rows at most to Python at once in what runs inside; the session's setting holds again after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    if before is None or not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def per_row(columns: list[str], out: pa.Schema, function: Callable[..., tuple]) -> Callable:
    """A mapInArrow function that turns the named columns of each row into one row of ``out``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            values = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
            rows = [function(*row) for row in zip(*values, strict=True)]
            if rows:
                cells = [pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), out, strict=True)]
                yield pa.RecordBatch.from_arrays(cells, schema=out)

    return run


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where ``docs`` has a column of that name."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def beside(docs: DataFrame, fields: list[StructField], function: Callable[[str | None], tuple]) -> DataFrame:
    """``docs`` with new columns that ``function`` gives for each text, computed in the same pass over the rows."""
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in fields]
    position = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = [function(x) for x in batch.column(position).to_pylist()]
            cells = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
            added = [pa.array(c, t) for c, t in zip(cells, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *(f.name for f in fields)])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *fields]))
