"""Best-fit packing of tokenised documents into sequences by bin completion.

A document is its token ids and an end id; only documents longer than a sequence are cut. What decides a
packing is how many pieces there are of each length, so the search works on that table (at
most ``capacity`` rows, whatever the corpus holds): it takes the longest piece left, enumerates the
undominated fillings of the room beside it, uses one as often as the counts allow and goes on
depth first. A branch ends where the waste it has made, or the Martello-Toth bound of what is left,
exceeds what the wanted number of sequences allows; best-fit decreasing gives the first incumbent and
completes branches that end early. The wanted number starts at the lower bound. ``nodes`` and ``width``
bound the search, never the rows: when they run out the best incumbent is used.

The plan (fillings and how often each is used) is then dealt out: a piece's rank among those of its length
is its rank within its task's pieces plus the pieces of the tasks before it, and names its sequence and place.
Only counts per (task, length) pass a window; no group of equal lengths is gathered.

Tokens: a text is cut at white space, which this kind of vocabulary drops; each distinct part goes
through the library once per slice and is remembered in a bounded table, which keeps those met last.

Defined results: a null or empty text is one piece of the end id; rows are independent, also with equal or null
ids; equal lengths are interchangeable; an empty table gives no rows; extra columns are ignored.
Vocabularies whose parts can't be encoded alone (white space kept, or no mark of one token) raise ``ValueError``.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, out_batch, releasing, ship, slices

_MARK = "\x01"                # stands between the parts of a call
_KEEP_CHARS = 64              # parts up to this long are remembered
_KEEP_PARTS = 600_000         # and so many of them (about 50 bytes each, and as much again while a slice looks them up)
_CALL_CHARS = 1 << 16
_SLICE = 3 << 20              # an executor's memory is shared by the workers of all its cores and the JVM


# ------------------------------------------------------------------ tokens
def _runs(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``size`` values of ``flat`` from each ``begin`` in a row, and where each run begins there (and the end)."""
    upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    return flat[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])], upto


class Encoder:
    """Ids of texts with one tokenizer file. Parts met before are kept as Arrow strings beside one array of their ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        if (steps[0].get("type"), steps[0].get("behavior"), steps[0].get("invert")) != ("Split", "Removed", True) or \
                any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])
                    for t in spec["added_tokens"]):
            raise ValueError(f"{path}: parts can't be encoded on their own with this splitting")
        self.lowers = any(n.get("type") == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", ()))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        mark = self._ids(_MARK)
        if len(mark) != 1:
            raise ValueError(f"{path}: no single token for the mark between parts")
        self.mark = mark[0]
        vocabulary, suffix = self.library.get_vocab(), spec["model"].get("end_of_word_suffix")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)        # tokens that end a word
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.known = pa.array([], pa.string())
        self.flat, self.begin = np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self.met, self.slice = np.zeros(0, np.int64), 0                 # the last slice that each was met in, and this one

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _marked(self, call: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts with a marked place between them, and how many each part has."""
        if any(_MARK in p for p in call):
            ids = [self._ids(p) for p in call]
            return np.concatenate(ids), np.array([len(i) for i in ids])
        ids = self._ids(f" {_MARK} ".join(call))
        at = np.flatnonzero(ids == self.mark)
        return np.delete(ids, at), np.diff(at, prepend=-1, append=len(ids)) - 1

    def _words(self, call: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for parts of letters: their last token ends a word, no other does."""
        ids = self._ids(" ".join(call))
        at = np.flatnonzero(self.ends[ids])
        return (ids, np.diff(at, prepend=-1)) if len(at) == len(call) else self._marked(call)

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts in a row, and how many each has; parts of letters have to come first."""
        words = sum(map(str.isalpha, parts))
        flat, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for how, some in ((self._words, parts[:words]), (self._marked, parts[words:])):
            upto = np.cumsum(np.fromiter(map(len, some), np.int64, len(some))) // _CALL_CHARS
            cuts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(some)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    ids, n = how(some[lo:hi])
                    flat.append(ids)
                    sizes.append(n)
        return np.concatenate(flat), np.concatenate(sizes)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin (and the end)."""
        texts = pc.fill_null(texts, "")
        if self.lowers:                # ASCII letters first: fewer different parts
            lowered = pc.ascii_lower(texts)
            for s in self.special:     # but a special string only counts as it is written
                lowered = pc.if_else(pc.match_substring(texts, s, ignore_case=True), texts, lowered)
            texts = lowered
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.known)
        new = np.asarray(pc.is_null(at))
        rows = np.flatnonzero(new)
        fresh = coded.dictionary.take(pa.array(rows)).to_pylist()
        letters = np.fromiter(map(str.isalpha, fresh), bool, len(fresh))
        order = np.argsort(~letters, kind="stable")
        fresh = [fresh[i] for i in order.tolist()]
        more, sizes = self._encode(fresh)
        # ids of the slice's parts: in ``flat`` from ``begin``, ``size`` of them
        flat = np.concatenate([self.flat, more])
        begin, size = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        old = np.asarray(pc.fill_null(at, 0))[~new]
        begin[~new], size[~new] = self.begin[old], np.diff(self.begin)[old]
        ends = len(self.flat) + np.cumsum(sizes)
        begin[rows[order]], size[rows[order]] = ends - sizes, sizes
        index = coded.indices.to_numpy()
        ids, upto = _runs(flat, begin[index], size[index])
        self.slice += 1
        self.met[old] = self.slice
        self._remember(fresh, more, sizes)
        edges = words.offsets.to_numpy().astype(np.int64)
        return ids, upto[edges - edges[0]]

    def _remember(self, fresh: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        keep = np.fromiter(map(len, fresh), np.int64, len(fresh)) <= _KEEP_CHARS
        if not keep.any():
            return
        self.known = pa.concat_arrays([self.known, pa.array(fresh, pa.string()).filter(pa.array(keep))])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes[keep])])
        self.flat = np.concatenate([self.flat, ids[np.repeat(keep, sizes)]])
        self.met = np.concatenate([self.met, np.full(keep.sum(), self.slice)])
        if len(self.known) > _KEEP_PARTS:       # those met last stay, and fewer than there may be, so that this is rare
            stay = np.sort(np.argsort(self.met, kind="stable")[-(_KEEP_PARTS - _KEEP_PARTS // 4):])
            self.known, self.met = self.known.take(pa.array(stay)), self.met[stay]
            self.flat, self.begin = _runs(self.flat, self.begin[stay], np.diff(self.begin)[stay])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def public_vocabulary() -> str:
    """Path of the word-level vocabulary that is installed for the library."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text",
           keep_ids: bool = False) -> DataFrame:
    """The pieces of every row: ``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if wanted, ``ids``; with
    ``_block`` (the task) and ``_rank`` (among the pieces of this length there, from 0)."""
    ship(docs.sparkSession)
    rows = docs.select(id_col, text_col)
    fields = [rows.schema[0], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
              T.StructField("_block", T.IntegerType()), T.StructField("_rank", T.LongType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))
    schema = T.StructType(fields)
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        from pyspark import TaskContext
        context = TaskContext.get()
        block = context.partitionId() if context else 0
        seen = np.zeros(capacity + 1, np.int64)
        e = encoder(path)
        for b in slices(batches, _SLICE):
            ids, edges = e.encode(b.column(1))
            # the end id after every text
            with_end = np.full(len(ids) + b.num_rows, end, "<u4")
            row = np.repeat(np.arange(b.num_rows), np.diff(edges))
            with_end[np.arange(len(ids)) + row] = ids
            edges = edges + np.arange(b.num_rows + 1)
            total = np.diff(edges)
            count = -(-total // capacity)
            row = np.repeat(np.arange(b.num_rows), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(capacity, total[row] - start)
            at = edges[row] + start
            data = memoryview(with_end).cast("B")
            crc = [zlib.crc32(data[4 * a:4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            rank = np.empty(len(row), np.int64)
            rank[order] = np.arange(len(row)) - np.searchsorted(ordered, ordered) + seen[ordered]
            seen += np.bincount(length, minlength=capacity + 1)
            columns = [b.column(0).take(pa.array(row)), piece.astype(np.int32), start, length, crc,
                       np.full(len(row), block, np.int32), rank]
            if keep_ids:
                bounds = np.concatenate([at, [len(with_end)]]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(with_end.astype(np.int64))))
            yield out_batch(arrow, columns)

    return rows.mapInArrow(releasing(run), schema)


# ------------------------------------------------------------------ search over the table of lengths
def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Martello and Toth's bound: items over half a bin need one each; what is too long to go beside them and
    the rest of the rest needs more, for the best of all cuts of "too short to count"."""
    if not counts.any():
        return 0
    number = np.concatenate([[0], np.cumsum(counts)])                       # items shorter than i
    volume = np.concatenate([[0], np.cumsum(counts * np.arange(capacity + 1))])
    short = np.arange(0, capacity // 2 + 1)
    half = capacity // 2 + 1                                                # lengths over half a bin begin here
    long_from = np.maximum(capacity - short + 1, half)
    n_long = number[-1] - number[long_from]
    n_half = number[long_from] - number[half]
    room = n_half * capacity - (volume[long_from] - volume[half])
    rest = volume[half] - volume[short]
    return int((n_long + n_half + np.maximum(0, -(-(rest - room) // capacity))).max())


def rounded_bound(counts: np.ndarray, capacity: int, most: int = 20) -> int:
    """Fekete and Schepers' bound: a length counts as floor((k + 1) * length / capacity) of k parts of a bin (or as it is,
    where that is exact), which no bin holds more than k of; the best of k = 1 to ``most``."""
    length = np.arange(capacity + 1)
    best = 0
    for k in range(1, most + 1):
        parts, rest = np.divmod((k + 1) * length, capacity)
        weight = np.where(rest == 0, parts * k, parts * (k + 1))            # of a bin of k * (k + 1)
        best = max(best, -(-int((counts * weight).sum()) // (k * (k + 1))))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: fillings and how many bins have each. Bins that are filled alike
    are one entry, so it takes a few steps per length."""
    room: dict[int, list[list]] = {}          # room left: [filling, bins]
    full: list[tuple[tuple[int, ...], int]] = []

    def put(filling: tuple[int, ...], bins: int, left: int) -> None:
        if bins and left:
            room.setdefault(left, []).append([filling, bins])
        elif bins:
            full.append((filling, bins))

    for length in np.flatnonzero(counts)[::-1].tolist():
        todo = int(counts[length])
        for left in sorted(r for r in room if r >= length):
            if not todo:
                break
            each = left // length
            groups = room.pop(left)
            while groups:
                filling, bins = groups.pop()
                use = min(bins, todo // each)
                put(filling + (length,) * each, use, left - each * length)
                todo -= use * each
                if use < bins:
                    if todo:
                        put(filling + (length,) * todo, 1, left - todo * length)
                    put(filling, bins - use - bool(todo), left)
                    for f, n in groups:
                        put(f, n, left)
                    todo = 0
                    break
        if todo:
            each = capacity // length
            put((length,) * each, todo // each, capacity - each * length)
            if todo % each:
                put((length,) * (todo % each), 1, capacity - todo % each * length)
    return full + [(f, n) for groups in room.values() for f, n in groups]


def _largest(counts: np.ndarray) -> np.ndarray:
    """For every room, the longest length there is that fits (0: none)."""
    return np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))


def _dominated(filling: tuple[int, ...], counts: np.ndarray, room: int) -> bool:
    """Whether one other piece could stand in for some of the filling (up to three of them) as well or better."""
    left = counts.copy()
    np.subtract.at(left, list(filling), 1)
    largest = _largest(left)
    slack = room - sum(filling)
    distinct = sorted(set(filling))
    if any(largest[min(len(largest) - 1, x + slack)] > x for x in distinct):
        return True
    sums = {sum(some) for n in (2, 3) for some in itertools.combinations(filling, n)}
    return any(s + slack < len(largest) and largest[s + slack] >= s for s in sums)


def fillings(counts: np.ndarray, room: int, waste: int, width: int) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` that waste at most ``waste``, the fullest first, of these the ones that can be used most
    often; at most ``width``."""
    if room == 0 or not counts[1:room + 1].any():
        return [()] if room <= waste else []
    if counts[room]:
        return [(room,)]                       # dominates every other
    largest = _largest(counts)
    found: dict[tuple[int, ...], int] = {}
    steps = 0

    def exact_pairs(chosen: tuple[int, ...], left: int, top: int) -> None:
        """Fillings that end with two pieces that fill the room without waste."""
        lo, hi = max(1, left - top), left // 2
        if lo > hi:
            return
        a = np.arange(lo, hi + 1)
        for x in a[(counts[a] > 0) & (counts[left - a] > 0)][:width].tolist():
            whole = chosen + (left - x, x)
            if all(whole.count(v) <= counts[v] for v in set(whole[-2:])):
                found.setdefault(whole, 0)

    def extend(chosen: tuple[int, ...], left: int, top: int) -> None:
        """Depth first, longest pieces first."""
        nonlocal steps
        steps += 1
        x = int(largest[min(left, top)])
        while x and chosen.count(x) >= counts[x]:
            x = int(largest[x - 1])
        if not x:
            if left <= waste:
                found.setdefault(chosen, left)
            return
        exact_pairs(chosen, left, top)
        tried = 0
        while x and steps < 8 * width and tried < width and len(found) < 4 * width:
            if chosen.count(x) < counts[x]:
                extend(chosen + (x,), left - x, x)
                tried += 1
            x = int(largest[x - 1])

    extend((), room, room)
    ranked = sorted(found, key=lambda f: (found[f], -min(int(counts[x]) // f.count(x) for x in f), len(f)))
    out: list[tuple[int, ...]] = []
    for f in ranked:
        if len(out) == width:
            break
        if not _dominated(f, counts, room):
            out.append(f)
    return out or ranked[:1]


def _moves(left: np.ndarray, capacity: int, waste: int, width: int) -> list[tuple[tuple[int, ...], int]]:
    """Fillings with the longest piece left, and how many bins to fill so: as many as the counts and the waste
    allow, then (for the way back) a single one. The first to try stands last."""
    longest = int(np.flatnonzero(left)[-1])
    beside = left.copy()
    beside[longest] -= 1
    often = []
    for f in fillings(beside, capacity - longest, waste, width):
        filling = (longest, *f)
        times = min(int(left[x]) // filling.count(x) for x in set(filling))
        spill = capacity - sum(filling)
        often.append((filling, min(times, waste // spill) if spill else times))
    return [(f, 1) for f, n in often[::-1] if n > 1] + often[::-1]


def _search(counts: np.ndarray, capacity: int, target: int, best: list, nodes: int, width: int) -> tuple[list, int]:
    """The first plan of at most ``target`` bins, depth first, or the best one that a branch was completed to; and the nodes left."""
    size = lambda plan: sum(n for _, n in plan)
    allowed = target * capacity - int((counts * np.arange(capacity + 1)).sum())
    left, used, waste, plan = counts.copy(), 0, 0, []
    stack: list[tuple] = []                         # state before a longest piece was placed, and the moves not tried yet
    deeper = True
    while nodes > 0:
        nodes -= 1
        moves: list = []
        if used + lower_bound(left, capacity) <= target:
            if not left.any():
                return plan, nodes
            moves = _moves(left, capacity, allowed - waste, width)
        if moves:
            stack.append((left, used, waste, len(plan), moves))
            deeper = True
        elif deeper:                                # a branch ends: complete it by best fit
            deeper = False
            whole = plan + best_fit(left, capacity)
            if size(whole) < size(best):
                best = whole
                if size(best) <= target:
                    break
        while stack and not stack[-1][4]:
            stack.pop()
        if not stack:
            break
        left, used, waste, kept, moves = stack[-1]
        filling, times = moves.pop()
        plan = plan[:kept] + [(filling, times)]
        left = left - times * np.bincount(filling, minlength=capacity + 1)
        used, waste = used + times, waste + times * (capacity - sum(filling))
    return best, nodes


def plan_bins(counts: np.ndarray, capacity: int, nodes: int | None = None, width: int = 8) -> list[tuple[tuple[int, ...], int]]:
    """Fillings (lengths, longest first) and how many bins get each; ``counts[length]`` pieces in all. Half of
    ``nodes`` looks for as many bins as the bound says, the rest for fewer than the incumbent has."""
    counts = np.asarray(counts, np.int64)
    best = best_fit(counts, capacity)
    nodes = 4 * capacity if nodes is None else nodes
    bins, bound = sum(n for _, n in best), max(lower_bound(counts, capacity), rounded_bound(counts, capacity))
    if bins > bound:
        best, left = _search(counts, capacity, bound, best, nodes // 2, width)
        nodes = nodes - nodes // 2 + left
    while sum(n for _, n in best) > bound and nodes > 0:
        bins = sum(n for _, n in best)
        best, nodes = _search(counts, capacity, bins - 1, best, nodes, width)
        if sum(n for _, n in best) == bins:
            break
    return best


class Dealer:
    """Sequence and place of the r-th piece of a length under a plan."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]]):
        length, low, first, each, place = [], [], [], [], []
        dealt: dict[int, int] = {}
        sequence = 0
        for filling, bins in plan:
            at = 0
            for x in dict.fromkeys(filling):
                k = filling.count(x)
                length.append(x)
                low.append(dealt.get(x, 0))
                first.append(sequence)
                each.append(k)
                place.append(at)
                dealt[x] = dealt.get(x, 0) + k * bins
                at += k * x
            sequence += bins
        order = np.lexsort((low, length))
        self.length, self.low, self.first, self.each, self.place = (
            np.array(x, np.int64)[order] for x in (length, low, first, each, place))
        self.begin = np.searchsorted(self.length, np.arange(max(dealt, default=0) + 2))

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        order = np.argsort(length, kind="stable")
        bounds = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
        for lo, hi in zip(bounds, bounds[1:]):
            rows = order[lo:hi]
            x = int(length[rows[0]])
            a, b = self.begin[x], self.begin[x + 1]
            at = a + np.searchsorted(self.low[a:b], rank[rows], side="right") - 1
            inside = rank[rows] - self.low[at]
            sequence[rows] = self.first[at] + inside // self.each[at]
            offset[rows] = self.place[at] + inside % self.each[at] * x
        return sequence, offset


def pack(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text",
         keep_ids: bool = False, nodes: int | None = None, width: int = 8) -> DataFrame:
    """One row per piece: ``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` (and
    ``ids``). A sequence's pieces stand in it without gaps from 0."""
    cut = checkpoint(pieces(docs, path, capacity, end, id_col, text_col, keep_ids))
    per_task = cut.groupBy("_block", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = per_task.select("_block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_ahead"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():       # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    dealer = Dealer(plan_bins(counts, capacity, nodes, width))
    ranked = cut.join(ahead, ["_block", "length"]).withColumn("_rank", F.col("_rank") + F.col("_ahead"))
    outer = [c for c in cut.columns if not c.startswith("_")]
    ranked = ranked.select("length", "_rank", *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(outer)])
    kept = [f for f in cut.schema.fields if f.name in outer]
    more = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    schema = T.StructType([f for f in kept if f.name != "ids"] + more + [f for f in kept if f.name == "ids"])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            sequence, offset = dealer.places(b.column(0).to_numpy(), b.column(1).to_numpy())
            own = dict(zip(outer, b.columns[2:])) | {"sequence_id": sequence, "offset": offset}
            yield out_batch(arrow, [own[f.name] for f in schema.fields])

    return ranked.mapInArrow(releasing(run), schema)
