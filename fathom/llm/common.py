"""Helpers shared by the operators: shipping the package, row keys, Arrow columns."""

from __future__ import annotations

import os
import tempfile
import zipfile

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()

#: ASCII upper case to lower case; every other byte as it is.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def word_table() -> bytes:
    """Byte table that lower-cases A-Z and turns every ASCII byte that is neither a
    letter nor a digit into a space; bytes of non-ASCII characters stay."""
    table = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        table[b] = ord(c.lower()) if c.isalnum() else 32
    return bytes(table)


WORDS = word_table()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers (once per application), so that a
    job also runs where the package is not installed on the executors."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(top)
    path = os.path.join(tempfile.mkdtemp(prefix=f"{name}-ship-"), f"{name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, top)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def row_key(id_col: str, text_col: str) -> Column:
    """Key of a document row: rows with equal id and equal text are one document,
    rows that share only the id are not."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h1"),
                    F.hash(F.col(text_col)).alias("h2"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder that the session names in
    ``spark.checkpoint.dir`` (a folder of our own only in a local session without one)."""
    from ..session import cut_lineage
    return cut_lineage(df)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow string column; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def out_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def releasing(run):
    """``run`` for ``mapInArrow``, giving freed Arrow memory back when a task ends: Python workers are
    reused, and an executor's memory is shared by all of them and the JVM."""
    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
    return task


def common_bound(sizes: dict[int, int], most: int) -> int:
    """The largest c with sum(min(size, c)) <= ``most`` (1 at least), of ``sizes`` and how often each occurs."""
    left, count = most, sum(sizes.values())
    for size in sorted(sizes):
        if size * count > left:
            return max(1, left // count)
        left -= size * sizes[size]
        count -= sizes[size]
    return max(sizes, default=1)


def slices(batches, max_bytes: int = 4 << 20, text: int = 1):
    """Cut incoming record batches, whose column ``text`` is the text, into slices of
    about ``max_bytes`` of text; a slice holds one row at least."""
    import numpy as np
    for b in batches:
        if b.num_rows == 0:
            continue
        size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(b.column(text)), 0), dtype=np.int64)
        block = np.cumsum(size) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield b.slice(lo, hi - lo)
