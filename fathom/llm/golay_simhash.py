"""SimHash near-dedup with Golay-code fuzzy hashing.

A document's 64-bit fingerprint has a bit where more than half of the hashes of its
word shingles have it. Fingerprints that differ in at most four bits are linked, and the
connected groups are near-duplicate classes.

Candidates: the fingerprint is cut into segments of 22, 21 and 21 bits. If two
fingerprints differ in at most four bits, then by pigeonhole either some segment is equal,
or every segment has an error and two of them have exactly one. The first case is caught by
keying each whole segment. For the second, a segment is decoded with the perfect binary
Golay code (23, 12): the indices of the codewords nearest to it and to its one-bit
neighbours (one to six of them) include a common one for any two segments with one
error; each index is joined with either half of another segment, one of which holds no
error. Keys therefore carry 21 to 23 bits. Every pair of fingerprints in a bucket is verified by its
bit distance; large buckets are compared in blocks. A bucket returns links that span its
classes, not all pairs, and components of these give the classes.

Exact copies share a fingerprint and are collapsed to it before any key is made.

Defined results: null and wordless texts have fingerprint zero, linked like any other;
a text of fewer words than a shingle has one shingle; null ids take part but never name
a class unless all its ids are null; rows that repeat an id are separate rows; extra columns
are ignored (:func:`near_duplicates`) or pass through (:func:`keep_one`).
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buckets import deal, join_labels, offset_pairs, whole_groups
from .common import LOWER, checkpoint, out_batch, releasing, row_key, ship, slices, texts_of
from .components import connected_components

#: Generator polynomial of the binary Golay code; segments as (shift, bits).
_GOLAY = 0b110001110101
_SEGMENTS = ((42, 22), (21, 21), (0, 21))
MAX_BITS = 4


def fingerprint(text: str, width: int = 4, chunk: int = 1 << 15) -> int:
    """Unsigned SimHash of the text's word shingles (XXH64, seed 42)."""
    data = b" ".join(text.encode().translate(LOWER).split())
    if not data:
        return 0
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    n = len(gaps) + 1
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(data)]
    width = min(width, n)
    shingles = n - width + 1
    hash64 = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for lo in range(0, shingles, chunk):
        hi = min(lo + chunk, shingles)
        h = np.array([hash64(data[a:b], 42) for a, b in zip(starts[lo:hi], ends[lo + width - 1:hi + width - 1])], ">u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > shingles).tobytes(), "big")


@functools.lru_cache(maxsize=1)
def _golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of the 12 data bits; error pattern of each remainder (weight 3 at most)."""
    def remainder(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= _GOLAY << (bit - 11)
        return x

    checks = np.array([remainder(d << 11) for d in range(1 << 12)], np.int64)
    ones = [1 << b for b in range(23)]
    errors = np.zeros(1 << 11, np.int64)
    for i, a in enumerate(ones):
        errors[remainder(a)] = a
        for j, b in enumerate(ones[:i]):
            errors[remainder(a | b)] = a | b
            for c in ones[:j]:
                errors[remainder(a | b | c)] = a | b | c
    return checks, errors


def golay_index(x: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the one codeword within three bits of each 23-bit word."""
    checks, errors = _golay_tables()
    return (x ^ errors[checks[x >> 11] ^ (x & 0x7FF)]) >> 11


def bucket_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every bucket of the fingerprints (uint64)."""
    segments = [((prints >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in _SEGMENTS]
    every = np.arange(len(prints))
    rows, keys = [], []
    for i, seg in enumerate(segments):
        rows.append(every)
        keys.append(seg | (i << 40))
    kind = len(segments)
    for i in range(len(segments)):
        bits = _SEGMENTS[i][1]
        near = np.stack([golay_index(segments[i] ^ e) for e in (0, *(1 << b for b in range(bits)))], axis=1)
        near.sort(axis=1)
        new = np.ones(near.shape, bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        row, at = np.nonzero(new)
        index = near[row, at]
        for j in range(i + 1, len(segments)):
            half = (_SEGMENTS[j][1] + 1) // 2
            for part in (segments[j] >> half, segments[j] & ((1 << half) - 1)):
                rows.append(row)
                keys.append((index << 11) | part[row] | (kind << 40))
                kind += 1
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(prints: DataFrame) -> DataFrame:
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                fp = b.column(0).slice(lo, 4096).to_numpy(zero_copy_only=False)
                row, key = bucket_keys(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], names=["key", "fp"])

    return prints.mapInArrow(releasing(run), schema)


def _links(groups: DataFrame, max_bits: int) -> DataFrame:
    """Spanning links (u, v) of every group of (key, lo, hi, own, fp)."""
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])

    def run(batches):
        for block, bounds in whole_groups(batches, 3):
            lo, hi, own, fp = (block.column(c).to_numpy(zero_copy_only=False) for c in range(1, 5))
            bits = fp.view(np.uint64)
            labels = np.arange(len(fp))
            u, v = [], []
            for i, j in offset_pairs(bounds):
                near = np.bitwise_count(bits[i] ^ bits[j]) <= max_bits
                near &= (lo[i] == hi[i]) | (own[i] != own[j])
                i, j = i[near], j[near]
                useful = join_labels(labels, i, j)
                u.append(fp[i[useful]])
                v.append(fp[j[useful]])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    return groups.mapInArrow(releasing(run), schema)


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` , ``key`` (see :func:`row_key`) and ``fp`` (as a signed long) of every row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"))
    from pyspark.sql.pandas.types import to_arrow_schema
    full = T.StructType([rows.schema["id"], rows.schema["key"], T.StructField("fp", T.LongType())])
    arrow = to_arrow_schema(full)

    def run(batches):
        for b in slices(batches):
            fp = np.array([fingerprint(t, width) for t in texts_of(b.column(1))], np.uint64).view(np.int64)
            yield out_batch(arrow, [b.column(0), b.column(2), pa.array(fp)])

    return rows.mapInArrow(releasing(run), full)


def classes(prints: DataFrame, max_bits: int = MAX_BITS, block_rows: int = 4096) -> DataFrame:
    """``fp`` and ``root`` of the distinct values of column ``fp`` that link with another."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the keys find all pairs up to {MAX_BITS} bits, not {max_bits}")
    keyed = _keyed(prints.select("fp").distinct())
    dealt = deal(keyed, "key", "fp", block_rows)
    groups = (dealt.select("key", "lo", "hi", "own", "fp").repartition("key", "lo", "hi")
              .sortWithinPartitions("key", "lo", "hi"))
    return connected_components(_links(groups, max_bits)).select(F.col("node").alias("fp"), "root")


def _rooted(prints: DataFrame, max_bits: int, block_rows: int) -> DataFrame:
    """Per distinct fingerprint: ``fp``, ``root``, ``first`` (least id, nulls last, with its row key)."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("key"))).alias("first")
    distinct = prints.groupBy("fp").agg(first)
    return distinct.join(classes(prints, max_bits, block_rows), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = MAX_BITS, id_col: str = "doc_id",
                    text_col: str = "text", block_rows: int = 4096) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``fingerprint`` (16 hex digits) and ``component_id``."""
    prints = checkpoint(fingerprints(docs, width, id_col, text_col))
    rooted = checkpoint(_rooted(prints, max_bits, block_rows).select("fp", "root", F.col("first.id").alias("id")))
    named = rooted.join(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "root")
    return prints.join(named.select("fp", "component_id"), "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 4, max_bits: int = MAX_BITS, id_col: str = "doc_id",
             text_col: str = "text", block_rows: int = 4096) -> DataFrame:
    """``docs`` with one document of each class: the one of least id."""
    prints = checkpoint(fingerprints(docs, width, id_col, text_col))
    stay = (_rooted(prints, max_bits, block_rows).groupBy("root").agg(F.min("first").alias("first"))
            .select(F.col("first.key").alias("key")))
    key = "_row_key"
    while key in docs.columns:
        key += "_"
    return (docs.withColumn(key, row_key(id_col, text_col)).join(stay.withColumnRenamed("key", key), key)
            .dropDuplicates([key]).select(*docs.columns))
