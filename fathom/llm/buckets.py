"""Comparing the members of many buckets, the large ones in blocks.

Rows carry a bucket key. A bucket of more than ``block_rows`` members is dealt into blocks by a
hash of the member, and every pair of its blocks becomes a group of its own, so no task
holds more than about two blocks of a bucket and no pair of members is missed.
Groups are walked in Python as sorted streams, many small ones at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

_BROADCAST_KEYS = 100_000      # hot keys that are broadcast at most; more are joined by shuffle


def deal(members: DataFrame, key: str, member: str, block_rows: int, keys: DataFrame | None = None) -> DataFrame:
    """``keys``: the keys of all members, if they are cheaper to make alone. ``members`` with ``own`` (block of the member), ``lo`` and ``hi`` (the pair of blocks the row
    takes part in). Within a group (key, lo, hi) compare all pairs if lo = hi, else the
    pairs of members of different blocks."""
    hot = checkpoint((members if keys is None else keys).groupBy(key).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > block_rows)
                     .select(key, F.ceil(F.col("c") / block_rows).cast("int").alias("blocks")))
    n_hot = hot.count()
    if n_hot == 0:
        return members.withColumns({c: F.lit(0) for c in ("own", "lo", "hi")})
    if n_hot <= _BROADCAST_KEYS:
        hot = F.broadcast(hot)
    return (members.join(hot, key, "left")
            .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
            .withColumn("own", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
            .drop("blocks", "other"))


def whole_groups(batches, keys: int, rows: int = 1 << 15):
    """From batches whose first ``keys`` (integer) columns are sorted: record batches that hold
    whole groups and, for each, the group boundaries (starts and the end). A batch has
    about ``rows`` rows, more only if a single group does."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if b.num_rows == 0:
            continue
        held.append(b)
        size += b.num_rows
        if size < rows:
            continue
        block = pa.concat_batches(held)
        bounds = _bounds(block, keys)
        last = int(bounds[-2])
        if last:
            yield block.slice(0, last), bounds[:-1]
        held, size = [block.slice(last)], len(block) - last
        rows = max(rows, 2 * size) if last == 0 else rows
    if held:
        block = pa.concat_batches(held)
        yield block, _bounds(block, keys)


def _bounds(block: pa.RecordBatch, keys: int) -> np.ndarray:
    new = np.zeros(len(block), bool)
    new[0] = True
    for k in range(keys):
        a = block.column(k).to_numpy(zero_copy_only=False)
        new[1:] |= a[1:] != a[:-1]
    return np.append(np.flatnonzero(new), len(block))


def offset_pairs(bounds: np.ndarray):
    """For d = 1, 2, ...: the rows i whose group also holds row i + d."""
    end = np.repeat(bounds[1:], np.diff(bounds))
    i = np.arange(len(end))
    d = 1
    while True:
        i = i[i + d < end[i]]
        if not len(i):
            return
        yield i, i + d
        d += 1


def join_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Unite the classes of the linked rows i and j in place (a class is named by its
    least row); returns the links that did so: a link per united class and step, never all
    links of a class."""
    useful = np.zeros(len(i), bool)
    while True:
        a, b = labels[i], labels[j]
        differ = a != b
        if not differ.any():
            return useful
        low, high = np.minimum(a, b)[differ], np.maximum(a, b)[differ]
        # one link for each class that is absorbed: the one to its least partner
        order = np.lexsort((low, high))
        first = np.ones(len(order), bool)
        first[1:] = high[order][1:] != high[order][:-1]
        at = np.flatnonzero(differ)[order[first]]
        useful[at] = True
        to = np.arange(len(labels))
        to[high[order[first]]] = low[order[first]]
        while True:                         # follow chains of absorbed classes
            far = to[to]
            if (far == to).all():
                break
            to = far
        labels[:] = to[labels]
