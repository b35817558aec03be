"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (with word ends) and itself, hashed to rows of an
embedding table; its vector is their average, and a window of consecutive words is the
average of its words. A linear softmax of two classes maps it to a probability. Unseen
misspellings share n-grams, and so vectors, with the words they come from. Embeddings and
softmax are trained jointly in numpy from documents' labels: a document is as toxic as its most toxic window,
so one word counts in a text of any length, and length alone counts for nothing. The first half of the training
takes ``1 - prod(1 - p)`` instead, which lets every window be found, the second half the maximum that scoring takes.

As the softmax is linear, a word's contribution to the difference of the two logits is a number;
scoring looks these up, computing them once per distinct word and worker.

Training reads a bounded sample: of each class at most ``max_docs`` labelled documents, the least by
a hash of their id, with all their windows as long as these are at most ``max_windows`` together (defaults 2000 and
two million; the bound of what the driver holds), reweighted to the classes' shares. Beyond that bound the longest
texts are thinned to a common number of windows, drawn over the whole text. Scoring covers every word of every document.

Defined results: null and wordless texts are one window of one empty word; without labelled
rows the score is 0.5; null labels and null ids are not learnt from; labels that repeat an id each
count; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import common_bound, out_batch, releasing, ship, slices, texts_of

_BUCKETS = 1 << 17
_DIM = 8
_GRAMS = (3, 4, 5)
_WINDOW = 3
_EDGE = ".,;:!?\"'()[]{}|#$%&*+-=/\\<>@^_~`"
_KEEP_WORDS = 400_000        # words remembered in each of two generations
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str) -> list[str]:
    return text.split() or [""]


def normal(token: str) -> str:
    return token.strip(_EDGE).lower()


def subwords(words: list[str], chunk: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of every word, one after the other, and where each word's begin (and the end)."""
    parts = [_subwords(words[at:at + chunk]) for at in range(0, len(words), chunk)]
    rows = np.concatenate([r for r, _ in parts]) if parts else np.zeros(0, np.int32)
    return rows, np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in parts]) if parts else [])]).astype(np.int64)


def _subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of the words, and how many each has."""
    marked = [f"<{w}>" for w in words]
    size = np.array([len(w) for w in marked])
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), size)
    end = np.cumsum(size)[word]
    place = np.arange(len(chars))
    rows, owner = [], []
    h = np.zeros(len(chars), np.uint64)
    for n in range(1, max(_GRAMS) + 1):
        shifted = np.zeros(len(chars), np.uint64)
        shifted[:max(0, len(chars) - n + 1)] = chars[n - 1:]
        h = (h ^ (shifted + np.uint64(n))) * _MIX
        h ^= h >> np.uint64(29)
        if n in _GRAMS:
            ok = place + n <= end
            rows.append((h[ok] >> np.uint64(20)) % np.uint64(_BUCKETS))
            owner.append(word[ok])
    # the word itself: a sum over its characters, mixed with their places in it
    at = place - (end - size[word])
    mixed = (chars + np.uint64(1)) * (at.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(31)
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    whole = np.add.reduceat(mixed * _MIX, starts)
    rows.append((whole >> np.uint64(20)) % np.uint64(_BUCKETS))
    owner.append(np.arange(len(words)))
    rows, owner = np.concatenate(rows).astype(np.int32), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return rows[order], np.bincount(owner, minlength=len(words))


def _means(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, bounds[:-1]) / np.diff(bounds)


def window_bounds(n_tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the windows in the texts' tokens laid end to end, and of the texts in the windows."""
    per = -(-n_tokens // _WINDOW)
    of = np.repeat(np.arange(len(n_tokens)), per)
    texts = np.concatenate([[0], np.cumsum(per)])
    begin = np.concatenate([[0], np.cumsum(n_tokens)[:-1]])
    starts = begin[of] + (np.arange(len(of)) - texts[of]) * _WINDOW
    return np.append(starts, n_tokens.sum()), texts


@dataclass
class Model:
    """``weight[row]``: contribution of an embedding row to the difference of the logits."""
    weight: np.ndarray
    bias: float
    known: dict = field(default_factory=dict, repr=False)
    older: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"weight": self.weight, "bias": self.bias, "known": {}, "older": {}}

    def word_scores(self, toks: list[str]) -> dict[str, float]:
        words = [normal(t) for t in toks]
        distinct = list(dict.fromkeys(words))
        if not distinct:
            return {}
        rows, bounds = subwords(distinct)
        value = dict(zip(distinct, _means(self.weight[rows], bounds).tolist()))
        return {t: value[w] for t, w in zip(toks, words)}

    def score(self, texts: list[str]) -> np.ndarray:
        if len(self.known) >= _KEEP_WORDS:
            self.known, self.older = {}, self.known
        split = [tokens(t) for t in texts]
        missing = set().union(*split).difference(self.known)
        again = {w: self.older[w] for w in missing if w in self.older}
        self.known.update(again)
        self.known.update(self.word_scores([w for w in missing if w not in again]))
        value = np.fromiter((v for s in split for v in map(self.known.__getitem__, s)), np.float64)
        bounds, texts_at = window_bounds(np.array([len(s) for s in split]))
        z = np.maximum.reduceat(_means(value, bounds), texts_at[:-1]) + self.bias
        return -np.expm1(-np.logaddexp(0, z))


def train(docs: Iterable[list[str]], labels: np.ndarray, weights: np.ndarray, steps: int = 200, rate: float = 0.1,
          decay: float = 1e-5, seed: int = 1) -> Model:
    """Embeddings and softmax by Adam on the weighted likelihood of the documents' labels."""
    distinct: dict[str, int] = {}
    numbers, sizes = array("i"), []
    for d in docs:
        numbers.extend(distinct.setdefault(normal(t), len(distinct)) for t in d)
        sizes.append(len(d))
    word = np.frombuffer(numbers, np.int32)
    rows, bounds = subwords(list(distinct))
    n_words, n_docs = len(distinct), len(sizes)
    del distinct
    per_word = np.diff(bounds)
    windows, texts = window_bounds(np.array(sizes))
    per_window = np.diff(windows)
    of_window = np.repeat(np.arange(len(per_window), dtype=np.int32), per_window)
    of_text = np.repeat(np.arange(n_docs, dtype=np.int32), np.diff(texts))
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (_BUCKETS, _DIM)), rng.normal(0, 0.1, (_DIM, 2)), np.array([0.0, -4.0])]
    m, v = ([np.zeros_like(p) for p in params] for _ in range(2))
    weights = weights / weights.sum()
    for step in range(1, steps + 1):
        table, soft, bias = params
        u = soft[:, 1] - soft[:, 0]
        word_value = _means((table @ u).astype(np.float32)[rows], bounds)
        z = _means(word_value[word], windows) + bias[1] - bias[0]
        if step <= steps // 2:
            total = np.add.reduceat(np.logaddexp(0, z), texts[:-1])      # -log(1 - p) of the text
            counts = 1.0
        else:
            top = np.maximum.reduceat(z, texts[:-1])
            total = np.logaddexp(0, top)
            counts = z == top[of_text]                                   # windows that tie share the slope
            counts = counts / np.add.reduceat(counts, texts[:-1], dtype=np.int64)[of_text]
        toxic = -np.exp(-total) / np.maximum(-np.expm1(-total), 1e-6)
        slope = weights * np.where(labels > 0, np.maximum(toxic, -50), 1.0)
        dz = slope[of_text] * counts / (1 + np.exp(-z))
        dword = np.bincount(word, (dz / per_window)[of_window], minlength=n_words)
        drow = np.bincount(rows, np.repeat(dword / per_word, per_word), minlength=_BUCKETS)
        du = table.T @ drow
        grads = [drow[:, None] * u, np.stack([-du, du], axis=1), np.array([-dz.sum(), dz.sum()])]
        for k, (p, g) in enumerate(zip(params, grads)):
            g = g + decay * p * (k < 2)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            # the large epsilon keeps rows that few documents touch from being learnt by heart
            p -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-4)
    table, soft, bias = params
    return Model((table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def _drawn(text: str, most: int) -> str:
    """The text's words, or those of ``most`` of its windows, drawn over the whole text."""
    toks = tokens(text)
    n = -(-len(toks) // _WINDOW)
    if n > most:
        at = np.sort(np.random.default_rng(zlib.crc32(text.encode())).choice(n, most, replace=False))
        toks = [t for i in at.tolist() for t in toks[i * _WINDOW:(i + 1) * _WINDOW]]
    return " ".join(toks)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        max_docs: int = 2000, max_windows: int = 2_000_000) -> Model | None:
    """Model learnt from ``labels`` (id and 0/1 label; the caller leaves the held-out ones out)."""
    ship(docs.sparkSession)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    share = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    sample = None
    for y in sorted(share):
        some = known.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(max_docs)
        sample = some if sample is None else sample.unionByName(some)
    if sample is None:
        return None
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")

    def count(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([-(-len(tokens(t)) // _WINDOW) for t in texts_of(b.column(1))])],
                                             names=["windows"])

    sizes = rows.select("id", "text").mapInArrow(releasing(count), "windows bigint").groupBy("windows").count().collect()
    most = common_bound({r["windows"]: r["count"] for r in sizes}, max_windows)

    def run(batches):
        for b in slices(batches):
            bags = [_drawn(t, most) for t in texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(bags), b.column(2)], names=["words", "label"])

    got = rows.select("id", "text", "label").mapInArrow(releasing(run), "words string, label int").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["label", "words"])                # one order, however the tasks end
    y = got.label.to_numpy()
    seen = {k: (y == k).sum() for k in share}
    return train(map(tokens, got.words), y, np.array([share[k] / seen[k] for k in y.tolist()]))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col`` and ``score``."""
    ship(docs.sparkSession)
    rows = docs.select(id_col, text_col)
    schema = T.StructType([rows.schema[0], T.StructField("score", T.DoubleType())])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    sent = docs.sparkSession.sparkContext.broadcast(model)      # 2**17 floats at most

    def run(batches):
        m = sent.value
        for b in slices(batches):
            values = np.full(b.num_rows, 0.5) if m is None else m.score(texts_of(b.column(1)))
            yield out_batch(arrow, [b.column(0), pa.array(values)])

    return rows.mapInArrow(releasing(run), schema)
