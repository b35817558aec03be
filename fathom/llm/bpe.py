"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

Every match of the split pattern is merged on its own. A segment tree over the byte
positions of the match holds, at its root, the leftmost pair of least rank; a merge
touches three leaves (the merged pair and its two live neighbours), each a point
update along one path of the tree, so a match of n bytes costs O(n log n) however
long it is. Matches of up to 64 bytes are merged many at a time, as rows of one array of
trees (:class:`Forest`); a longer match gets a tree of its own (:func:`merge_ranks`).

Words repeat, so the ids of a run "white space + word" are remembered per worker in
a table of bounded size. Such a run may be encoded on its own: a match of the
pattern never continues across a place where white space follows other text.

Defined results: a null text counts as empty (no ids); rows are independent, so
repeated ids and texts give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import sys
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import out_batch, releasing, ship, slices, texts_of

_NONE = 1 << 62
_SLICE = 2 << 20          # bytes of text encoded at once
_KEEP_CHARS = 48          # runs up to this long are remembered
_KEEP_RUNS = 350_000      # and so many of them in each of two generations
# white space as Unicode has it (Python's \s also takes U+001C..U+001F)
_SPACE = " \t\n\r\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


def merge_ranks(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one match of the split pattern."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    if n < 2:
        return tuple(ranks[piece[i:i + 1]] for i in range(n))
    last = n - 1
    size = 1 << (last - 1).bit_length() if last > 1 else 1
    mask, shift = size - 1, size.bit_length() - 1
    # leaf i: rank of the pair whose left part begins at byte i, and i itself, so
    # that the minimum is the leftmost of the least rank
    get = ranks.get
    level = [_NONE if (r := get(piece[i:i + 2])) is None else (r << shift) | i for i in range(last)]
    level += [_NONE] * (size - last)
    tree = level
    while len(level) > 1:
        level = list(map(min, level[::2], level[1::2]))
        tree = level + tree
    tree = [_NONE, *tree]
    after = list(range(1, n + 2))     # start of the next live part
    before = list(range(-1, n))       # start of the previous live part
    least = tree[1]
    while least != _NONE:
        i = least & mask
        j = after[i]
        k = after[j]
        after[i] = k
        h = before[i]
        # point updates: the merged part's own pair, the pair before it, the pair that is gone
        if k < n:
            before[k] = i
            r = get(piece[i:after[k]])
            changes = ((i, _NONE if r is None else (r << shift) | i), (j, _NONE))
        else:
            changes = ((i, _NONE),) if j >= last else ((i, _NONE), (j, _NONE))
        if h >= 0:
            r = get(piece[h:k])
            changes += ((h, _NONE if r is None else (r << shift) | h),)
        for at, value in changes:
            p = size + at
            if tree[p] == value:
                continue
            tree[p] = value
            while p > 1:
                other = tree[p ^ 1]
                if other < value:
                    value = other
                p >>= 1
                if tree[p] == value:
                    break
                tree[p] = value
        least = tree[1]
    out, i = [], 0
    while i < n:
        k = after[i]
        out.append(ranks[piece[i:k]])
        i = k
    return tuple(out)


class Forest:
    """The same merges for many short matches at once."""

    longest = 64

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {(ranks[t[:c]] << 32) | ranks[t[c:]]: r for t, r in ranks.items()
                 for c in range(1, len(t)) if t[:c] in ranks and t[c:] in ranks}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[p] for p in self.pairs.tolist()], np.int64)

    def leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, shift: int) -> np.ndarray:
        """Leaf values of the pairs of parts (-1: no part) that begin at ``at``."""
        pair = (left << 32) | right
        k = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        known = (self.pairs[k] == pair) & (left >= 0) & (right >= 0)
        return np.where(known, (self.merged[k] << shift) | at, _NONE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (as bytes of 32-bit integers) of matches of 2 to ``longest`` bytes."""
        out: list = [None] * len(pieces)
        lengths = np.array([len(p) for p in pieces])
        size = 1
        while size <= self.longest:
            of = np.flatnonzero((lengths - 1 <= size) & (lengths - 1 > size // 2 * (size > 1)))
            for lo in range(0, len(of), 8192):
                some = of[lo:lo + 8192]
                for at, ids in zip(some.tolist(), self._merge([pieces[x] for x in some.tolist()], size)):
                    out[at] = ids
            size *= 2
        return out

    def _merge(self, pieces: list[bytes], size: int) -> list[bytes]:
        m, width, shift = len(pieces), size + 1, size.bit_length() - 1
        n = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(m, width)
        place = np.arange(width + 1)
        part = np.full((m, width + 1), -1, np.int64)        # id of the part that begins here
        part[:, :width] = np.where(place[:width] < n[:, None], self.bytes[raw], -1)
        after = np.minimum(np.tile(place + 1, (m, 1)), n[:, None])
        before = np.tile(place - 1, (m, 1))
        tree = np.full((m, 2 * size), _NONE, np.int64)
        tree[:, size:] = self.leaf(part[:, :size], part[:, 1:width], place[:size], shift)
        for p in range(size - 1, 0, -1):
            tree[:, p] = np.minimum(tree[:, 2 * p], tree[:, 2 * p + 1])

        def update(rows, at, value):
            p = size + at
            tree[rows, p] = value
            for _ in range(shift):
                p = p >> 1
                tree[rows, p] = np.minimum(tree[rows, 2 * p], tree[rows, 2 * p + 1])

        rows = np.arange(m)
        while True:
            least = tree[rows, 1]
            rows, least = rows[least != _NONE], least[least != _NONE]
            if not len(rows):
                break
            i = least & (size - 1)
            j = after[rows, i]
            k = after[rows, j]
            part[rows, i] = least >> shift
            part[rows, j] = -1
            after[rows, i] = k
            before[rows, k] = i
            here = part[rows, i]
            gone = j < size
            update(rows[gone], j[gone], _NONE)
            update(rows, i, self.leaf(here, part[rows, k], i, shift))
            h = before[rows, i]
            left = h >= 0
            update(rows[left], h[left], self.leaf(part[rows[left], h[left]], here[left], h[left], shift))
        live = part >= 0
        ids, ends = part[live].astype(np.uint32).tobytes(), (4 * np.cumsum(live.sum(axis=1))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]


class Codec:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.pattern = regex.compile(pattern)
        self.forest = Forest(self.ranks)
        # ids as bytes of 32-bit integers: small to keep, and joined without a loop
        self.runs: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode_runs(self, runs: list[str]) -> list[bytes]:
        """Ids of runs, each on its own."""
        pieces = [[m.encode() for m in self.pattern.findall(r)] for r in runs]
        ids: dict[bytes, bytes] = {}
        short = []
        for p in set(chain.from_iterable(pieces)):
            rank = self.ranks.get(p)
            if rank is not None:
                ids[p] = rank.to_bytes(4, sys.byteorder)
            elif len(p) <= self.forest.longest:
                short.append(p)
            else:
                ids[p] = np.array(merge_ranks(p, self.ranks), np.uint32).tobytes()
        ids.update(zip(short, self.forest.merge(short)))
        return [ids[p[0]] if len(p) == 1 else b"".join(map(ids.__getitem__, p)) for p in pieces]

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin (and the end)."""
        if len(self.runs) >= _KEEP_RUNS:
            self.runs, self.older = {}, self.runs
        runs = [_RUN.findall(t) for t in texts]
        known, older = self.runs, self.older
        missing = set().union(*runs).difference(known)
        again = {r: older[r] for r in missing if r in older}
        known.update(again)
        fresh = [r for r in missing if r not in again]
        known.update(zip(fresh, self._encode_runs(fresh)))
        parts = [b"".join(map(known.__getitem__, r)) for r in runs]
        for r in fresh:
            if len(r) > _KEEP_CHARS:
                del known[r]
        ends = np.cumsum([0, *map(len, parts)]) // 4
        return np.frombuffer(b"".join(parts), np.uint32), ends

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def public_vocabulary() -> tuple[str, str]:
    """Path and split pattern of the many-language vocabulary that is installed."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


#: What :func:`encode_documents` can return for a document.
OUTPUTS = {"ids": "array<int>", "n_tokens": "bigint", "ids_sha256": "string", "decoded": "binary",
           "decoded_sha256": "string"}


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                     outputs: tuple[str, ...] = ("ids", "n_tokens")) -> DataFrame:
    """One row per row of ``docs``: ``id_col`` and the chosen ``outputs`` (see
    :data:`OUTPUTS`): token ids, their number, the SHA-256 of the decimal ids joined by
    commas, the bytes decoded from the ids again, and their SHA-256."""
    ship(docs.sparkSession)
    rows = docs.select(id_col, text_col)
    fields = [rows.schema[0]] + [T.StructField(o, T._parse_datatype_string(OUTPUTS[o])) for o in outputs]
    schema = T.StructType(fields)
    arrow = _arrow(schema)

    def run(batches):
        c = codec(path, pattern)
        for b in slices(batches, _SLICE):
            ids, ends = c.encode_batch(texts_of(b.column(1)))
            yield out_batch(arrow, [b.column(0), *_outputs(c, outputs, ids, ends)])

    return rows.mapInArrow(releasing(run), schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def _outputs(c: Codec, kinds: tuple[str, ...], ids: np.ndarray, ends: np.ndarray) -> list:
    made: dict[str, list | pa.Array] = {"n_tokens": pa.array(np.diff(ends))}
    if "ids" in kinds:
        made["ids"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
    if set(kinds) - set(made):
        for k in kinds:
            made.setdefault(k, [])
        for a, b in zip(ends.tolist(), ends[1:].tolist()):
            own = ids[a:b].tolist()
            if "ids_sha256" in kinds:
                made["ids_sha256"].append(hashlib.sha256(",".join(map(c.decimal.__getitem__, own)).encode()).hexdigest())
            if "decoded" in kinds or "decoded_sha256" in kinds:
                data = c.decode(own)
                if "decoded" in kinds:
                    made["decoded"].append(data)
                if "decoded_sha256" in kinds:
                    made["decoded_sha256"].append(hashlib.sha256(data).hexdigest())
    return [made[k] for k in kinds]


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
                     ids_col: str = "ids") -> DataFrame:
    """The text of every row of ids (bytes that are no UTF-8 become U+FFFD); null ids
    give an empty text."""
    ship(encoded.sparkSession)
    rows = encoded.select(id_col, ids_col)
    schema = T.StructType([rows.schema[0], T.StructField("text", T.StringType())])
    arrow = _arrow(schema)

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            texts = [c.decode(ids or ()).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield out_batch(arrow, [b.column(0), texts])

    return rows.mapInArrow(releasing(run), schema)
