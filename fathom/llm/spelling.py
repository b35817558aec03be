"""Spelling variants: words one inserted, deleted or replaced letter apart, grouped under the frequent form.

A word's letters are counted in ``len(GROUPS)`` groups; the counts (15 at most, four bits each) in the order of the groups
are its path in a trie. One edit adds a letter to one group (a surplus), takes one from a group (a deficit), or
both, so a depth-first search from a word that may spend one surplus and one deficit reaches every
near word; the words at the leaves it reaches are verified. The search is done for many words at once: a node
is visited once, with all words that can still afford it.

On Spark the trie is cut where a node holds at most ``node_rows`` words. The upper part (its size is bounded, as ``node_rows``
grows with the number of words) goes to every task and tells which cut-off tries a word has to
visit; words are shuffled to their own and, as a pair is found once, to the visited ones of a greater
number. A leaf at full depth with too many words is dealt into blocks. Near words are counted and the best
kept in the task, so only one row per word and visited trie is shuffled again.

Defined results: a null text has no words; a null id counts as the empty string in the hash; repeated rows count as they
come; ties between forms go to the least in code-point order; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import whole_groups
from .common import LOWER, checkpoint, releasing, ship, slices, texts_of

#: Letters counted together, the most telling first; all others are the last group.
GROUPS = ("e", "n", "i", "a", "r", "s", "t", "u", "l", "dk", "hw", "oy", "cz", "gm", "bpfv")
_LEVELS = 16
_FLUSH = 300_000              # different words a task holds while it counts
_LEAF = 8                     # words of a node that are compared without going deeper


# ------------------------------------------------------------------ words and how often they occur
def words(docs: DataFrame, least_length: int = 6, least_count: int = 5, one_in: int = 199, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``word`` and ``n``: runs of letters with A-Z lower-cased; a run whose hash with the document's id ``one_in`` divides
    loses one letter."""
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    run_of = re.compile("[a-zÀ-ÿ]{%d,}" % max(1, least_length))

    def run(batches):
        found: Counter[str] = Counter()
        for b in slices(batches):
            for doc, text in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
                runs = Counter(run_of.findall(text.encode().translate(LOWER).decode()))
                seed = zlib.crc32(f"{doc}:".encode())
                for r, n in runs.items():
                    h = zlib.crc32(r.encode(), seed)
                    if h % one_in == 0:
                        h %= len(r)
                        r = r[:h] + r[h + 1:]
                        if len(r) < least_length:
                            continue
                    found[r] += n
                if len(found) > _FLUSH:
                    yield _pairs(found)
                    found = Counter()
        if found:
            yield _pairs(found)

    counted = rows.mapInArrow(releasing(run), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _pairs(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])


# ------------------------------------------------------------------ the trie
def _group_table() -> np.ndarray:
    table = np.full(256, len(GROUPS), np.int64)
    for i, letters in enumerate(GROUPS):
        table[[ord(c) for c in letters]] = i
    return table


_GROUP = _group_table()


def counts_of(column: pa.Array) -> np.ndarray:
    """Letter-group counts (words x groups, 15 at most) of words with code points below 256."""
    some = column.to_pylist()
    sizes = np.fromiter(map(len, some), np.int64, len(some))
    letters = np.frombuffer("".join(some).encode("latin-1"), np.uint8)
    cell = np.repeat(np.arange(len(some)) * _LEVELS, sizes) + _GROUP[letters]
    return np.minimum(np.bincount(cell, minlength=len(some) * _LEVELS), 15).reshape(-1, _LEVELS)


def path_of(counts: np.ndarray) -> np.ndarray:
    """The counts as one number, the first group in the highest four bits."""
    out = np.zeros(len(counts), np.uint64)
    for level in range(_LEVELS):
        out = out << np.uint64(4) | counts[:, level].astype(np.uint64)
    return out.view(np.int64)


def _afford(own: np.ndarray, there: int, surplus: np.ndarray, deficit: np.ndarray):
    """Which words can go to a node whose count is ``there``, and what they have spent then."""
    more = there - own
    surplus, deficit = surplus + np.maximum(more, 0), deficit + np.maximum(-more, 0)
    ok = (surplus <= 1) & (deficit <= 1)
    return ok, surplus[ok], deficit[ok]


def search(stored: np.ndarray, asked: np.ndarray):
    """Depth first through the trie of ``stored`` (rows sorted): yields (rows of a leaf, words that reach it)."""
    none = np.zeros(len(asked), np.int64)
    stack = [(0, len(stored), 0, np.arange(len(asked)), none, none)]
    while stack:
        lo, hi, level, at, surplus, deficit = stack.pop()
        if hi - lo <= _LEAF or level == _LEVELS:
            yield np.arange(lo, hi), at
            continue
        here = stored[lo:hi, level]
        bounds = [0, *(np.flatnonzero(np.diff(here)) + 1).tolist(), hi - lo]
        own = asked[at, level]
        for a, b in zip(bounds, bounds[1:]):
            ok, s, d = _afford(own, int(here[a]), surplus, deficit)
            if ok.any():
                stack.append((lo + a, lo + b, level + 1, at[ok], s, d))


def candidates(stored: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(asked, stored) pairs whose counts differ by one surplus and one deficit at most."""
    order = np.lexsort(stored.T[::-1])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for leaf, at in search(stored[order], asked):
        for lo in range(0, len(leaf), _LEAF):              # a leaf at full depth may be long
            some = order[leaf[lo:lo + _LEAF]]
            more = stored[some][None] - asked[at][:, None]
            q, s = np.nonzero((np.maximum(more, 0).sum(axis=2) <= 1) & (np.maximum(-more, 0).sum(axis=2) <= 1))
            left.append(at[q])
            right.append(some[s])
    return np.concatenate(left), np.concatenate(right)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point leads from one to the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    for x, y in zip(a, b):
        if x != y:
            break
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:]


class Upper:
    """The part of the trie above the cut. A node is the number of its cut-off trie, or its children by count."""

    def __init__(self, children: list[tuple[int, int, int]], node_rows: int):
        """``children``: (level, path to it, words) of the nodes whose parent was opened; none: one trie."""
        self.root: dict | tuple = {} if children else (0, 1)
        self.tries = 1 if not children else 0
        opened = {(level - 1, path >> 4) for level, path, _ in children}
        nodes: dict[tuple[int, int], dict] = {(0, 0): self.root} if children else {}
        for level, path, rows in sorted(children):
            if (level, path) in opened:
                node: dict | tuple = {}
                nodes[level, path] = node
            else:
                blocks = -(-rows // node_rows) if level == _LEVELS else 1
                node = (self.tries, blocks)
                self.tries += blocks
            nodes[level - 1, path >> 4][path & 15] = node

    def visits(self, asked: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, trie, whether it is its own) of all tries that the words live in or have to visit: those with a
        greater number than their own. ``block``: a number that deals the words of a full leaf."""
        none = np.zeros(len(asked), np.int64)
        stack: list[tuple] = [(self.root, 0, np.arange(len(asked)), none, none)]
        home = np.zeros(len(asked), np.int64)
        reached: list[tuple[np.ndarray, int, int]] = []
        while stack:
            node, level, at, surplus, deficit = stack.pop()
            if isinstance(node, tuple):
                first, blocks = node
                own = at[surplus + deficit == 0]
                home[own] = first + block[own] % blocks
                reached.append((at, first, blocks))
                continue
            own = asked[at, level]
            for there, child in node.items():
                ok, s, d = _afford(own, there, surplus, deficit)
                if ok.any():
                    stack.append((child, level + 1, at[ok], s, d))
        word, trie = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, first, blocks in reached:
            for number in range(first, first + blocks):
                some = at[home[at] <= number]
                word.append(some)
                trie.append(np.full(len(some), number))
        word, trie = np.concatenate(word), np.concatenate(trie)
        return word, trie, home[word] == trie


def _upper(vocabulary: DataFrame, node_rows: int) -> Upper:
    """Nodes of more than ``node_rows`` words are opened: at most ``_LEVELS * words / node_rows``, of 16 children each."""
    level = F.explode(F.sequence(F.lit(0), F.lit(_LEVELS))).alias("level")
    nodes = vocabulary.select("path", level).select(
        "level", F.when(F.col("level") == 0, F.lit(0).cast("long")).otherwise(
            F.expr(f"shiftrightunsigned(path, 4 * ({_LEVELS} - level))")).alias("node"))
    nodes = nodes.groupBy("level", "node").agg(F.count(F.lit(1)).alias("rows"))
    opened = nodes.where((F.col("rows") > node_rows) & (F.col("level") < _LEVELS)).select(
        (F.col("level") + 1).alias("level"), F.col("node").alias("parent"))
    below = nodes.withColumn("parent", F.expr("shiftrightunsigned(node, 4)")).join(F.broadcast(opened), ["level", "parent"])
    unsigned = lambda x: x & (1 << 64) - 1
    return Upper([(r["level"], unsigned(r["node"]), r["rows"]) for r in below.collect()], node_rows)


# ------------------------------------------------------------------ near words
def _dealt(vocabulary: DataFrame, upper: Upper) -> DataFrame:
    """Words with the tries they live in (``visitor`` 0) or visit (1)."""
    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                b = whole.slice(lo, 4096)
                block = np.fromiter((zlib.crc32(w.encode()) for w in b.column(0).to_pylist()), np.int64, b.num_rows)
                word, trie, own = upper.visits(counts_of(b.column(0)), block)
                part = b.take(pa.array(word))
                yield pa.RecordBatch.from_arrays([pa.array(trie), pa.array((~own).astype(np.int32)), part.column(0), part.column(1)],
                                                 names=["trie", "visitor", "word", "n"])

    return vocabulary.select("word", "n").mapInArrow(run, "trie long, visitor int, word string, n long")


def _near(groups: DataFrame) -> DataFrame:
    """Per word and trie: how many near words, and the most frequent of them."""
    def run(batches):
        for block, bounds in whole_groups(batches, 1, 1 << 15):
            counts, every, n = counts_of(block.column(2)), block.column(2).to_pylist(), block.column(3).to_pylist()
            visitor = block.column(1).to_numpy()
            found: dict[int, list] = {}
            for lo, hi in zip(bounds, bounds[1:]):
                lives = lo + np.flatnonzero(visitor[lo:hi] == 0)
                asked, stored = candidates(counts[lives], counts[lo:hi])
                asked, stored = asked + lo, lives[stored]
                once = (visitor[asked] == 1) | (asked < stored)
                for i, j in zip(asked[once].tolist(), stored[once].tolist()):
                    if one_edit(every[i], every[j]):
                        for own, other in ((i, j), (j, i)):
                            best = found.get(own)
                            if best is None:
                                found[own] = [1, other]
                                continue
                            best[0] += 1
                            if (-n[other], every[other]) < (-n[best[1]], every[best[1]]):
                                best[1] = other
            yield pa.RecordBatch.from_arrays(
                [pa.array([every[i] for i in found], pa.string()), pa.array([c for c, _ in found.values()], pa.int64()),
                 pa.array([n[j] for _, j in found.values()], pa.int64()), pa.array([every[j] for _, j in found.values()], pa.string())],
                names=["word", "near", "form_n", "form"])

    return groups.mapInArrow(releasing(run), "word string, near long, form_n long, form string")


def variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, one_in: int = 199, ratio: int = 5,
             node_rows: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: ``word``, ``form`` (its most frequent near word, if that is ``ratio`` times as frequent), ``root``
    (the last form of the chain), ``n``, ``n_near`` and ``form_n``. ``node_rows``: words of a cut-off trie."""
    return group(words(docs, least_length, least_count, one_in, id_col, text_col), ratio, node_rows)


def group(counted: DataFrame, ratio: int = 5, node_rows: int | None = None) -> DataFrame:
    """:func:`variants` of a table of different words (``word``, ``n``) with code points below 256."""
    ship(counted.sparkSession)

    def paths(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(path_of(counts_of(b.column(0))))], names=["word", "n", "path"])

    vocabulary = checkpoint(counted.select("word", "n").mapInArrow(paths, "word string, n long, path long"))
    node_rows = node_rows or max(1024, vocabulary.count() // 16384)
    upper = _upper(vocabulary, node_rows)
    groups = _dealt(vocabulary, upper).repartition("trie").sortWithinPartitions("trie")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    near = _near(groups).groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best"))
    named = vocabulary.select("word", "n").join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= ratio * F.col("n"), F.struct(F.col("best.form").alias("form"), (-F.col("best.less")).alias("n"))).alias("to"))
    named = checkpoint(named)
    # follow the forms: every round doubles the steps taken; a form is rarer than its own form, so chains are short
    roots = named.where("to IS NOT NULL").select("word", F.col("to.form").alias("root"))
    while True:
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        further = checkpoint(roots.join(step, "root", "left").select(
            "word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        roots = further.select("word", "root")
        if further.where("moved").isEmpty():
            break
    return named.join(roots, "word", "left").select(
        "word", F.col("to.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("to.n").alias("form_n"))
