"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is labelled good or bad. Unary weights see the line's own features and those of
the lines before and after it; a transition matrix ties neighbours. Forward-backward gives
each line's marginal, and the document's quality is their mean weighted by line length.
The weights are trained in numpy by maximising the conditional likelihood of the label
sequences of labelled documents, each line carrying its document's label.

Training reads a bounded sample: at most ``max_docs`` labelled documents, the least by a hash of
their id, with all their lines as long as these are at most ``max_lines`` together (defaults 3000 and 1.2 million; the
bound of what the driver holds). Beyond that the longest texts are thinned to a common number of lines, drawn over
the whole text; as a text's lines share its label, this leaves the labels of neighbours as they are. Scoring covers every document and every line.

A text over a megabyte is read in stretches (which see the lines around them) and its messages are passed over blocks of
lines, so that scoring holds a few numbers per line and the features of one stretch; a single line is held whole, at
some 30 bytes for each of its own. The driver holds the sampled lines once, in single precision (``max_lines`` rows of 69 numbers).

Defined results: a null or empty text is one empty line; a line of white space counts as empty; without labelled
rows the score is 0.5; null labels and null ids are not learnt from; labels that repeat an
id each count; extra columns are ignored (scores) or pass through (:func:`keep_good`).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import common_bound, out_batch, releasing, ship, slices, texts_of

_CLASSES = ("upper", "lower", "digit", "space", "bar", "bang", "symbol", "other", "wide")


def _class_table() -> np.ndarray:
    table = np.full(256, _CLASSES.index("wide"), np.uint8)
    for b in range(128):
        c = chr(b)
        kind = ("upper" if c.isupper() else "lower" if c.islower() else "digit" if c.isdigit() else
                "space" if c.isspace() else "bar" if c == "|" else "bang" if c == "!" else
                "symbol" if c in "#$%&*+=<>@^_~{}[]\\/" else "other")
        table[b] = _CLASSES.index(kind)
    return table


_TABLE = _class_table()
_SPACES = "".join(c for c in map(chr, range(128)) if c.isspace())
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SLICE = 1 << 20                           # bytes of text whose features are held at once
_OWN = 22                                   # features of a line itself
N_FEATURES = 3 * _OWN + 3


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line (of itself, the line before, the line after, edges and constant), the
    first line of every text (and the end), and the lines' lengths in bytes."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    text_starts = np.cumsum([0, *(len(r) + 1 for r in raw)])
    first = np.searchsorted(starts, text_starts)
    length = ends - starts
    kind = _TABLE[data]

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int32 if len(mask) < 1 << 31 else np.int64)
        np.cumsum(mask, out=total[1:])
        return (total[ends] - total[starts]).astype(np.int64)

    counts = {c: count(kind == i) for i, c in enumerate(_CLASSES)}
    solid = kind != _CLASSES.index("space")
    before = np.concatenate([[False], solid[:-1]])
    word_at = np.flatnonzero(solid & ~before)
    word_end = np.flatnonzero(~solid & before)
    words = np.searchsorted(word_at, ends) - np.searchsorted(word_at, starts)
    # hash of every word, to see repeats: a polynomial hash made independent of the place
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int((word_end - word_at).max(initial=0)), _ODD)]))
    offset = np.arange(len(data)) - np.repeat(np.concatenate([[0], word_at]),
                                              np.diff(np.concatenate([[0], word_at, [len(data)]])))
    value = np.where(solid, (data.astype(np.uint64) + np.uint64(1)) * power[np.minimum(offset, len(power) - 1)], np.uint64(0))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
    hashes = total[word_end] - total[word_at]
    again = np.zeros(len(data), bool)
    again[word_at[1:]] = hashes[1:] == hashes[:-1]
    begins = np.searchsorted(word_at, text_starts[:-1])
    again[word_at[begins[begins < len(word_at)]]] = False           # a text's first word repeats none
    last = np.zeros(len(data), np.uint8)
    last[word_end] = data[word_end - 1]
    marked = count((last == 33) | np.isin(last, np.frombuffer(b"#$%&*", np.uint8)))
    size = np.maximum(length, 1)
    letters = np.maximum(counts["upper"] + counts["lower"], 1)
    n_words = np.maximum(words, 1)
    share = {c: counts[c] / size for c in _CLASSES}
    upper, repeat = counts["upper"] / letters, count(again) / n_words
    own = np.stack([
        np.log1p(length) / 6, upper, upper > 0.5, share["digit"], share["space"], share["bar"], share["bar"] > 0.02,
        share["bang"], share["bang"] > 0.04, share["symbol"], share["symbol"] > 0.04, share["other"], share["wide"],
        size / n_words / 10, repeat, repeat > 0.3, marked / n_words, marked / n_words > 0.3, words == 0, words < 4,
        np.minimum(words, 200) / 100, length > 1000], axis=1).astype(np.float64)
    lines = np.arange(len(starts))
    top, bottom = np.isin(lines, first[:-1]), np.isin(lines + 1, first[1:])
    prev, nxt = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    prev[top], nxt[bottom] = 0, 0
    edges = np.stack([top, bottom, np.ones(len(own))], axis=1)
    return np.concatenate([own, prev, nxt, edges], axis=1), first, length


def _rows(features: np.ndarray, most: int = 1 << 17):
    """Blocks of rows, so that only one at a time is held in double precision."""
    return [features[lo:lo + most] for lo in range(0, max(1, len(features)), most)]


@dataclass
class Model:
    weights: np.ndarray           # unary weight of "good"
    transitions: np.ndarray       # [label, label of the next line]

    def unary(self, features: np.ndarray) -> np.ndarray:
        return np.concatenate([f.astype(np.float64) @ self.weights for f in _rows(features)])


def _columns(first: np.ndarray):
    """Texts by falling number of lines, and how many have a t-th line, for each t."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    longest = int(n.max(initial=0))
    return order, np.searchsorted(-n[order], -np.arange(longest), side="left")


def stretches(texts: list[str], most: int):
    """The lines of the texts in their order, some at a time: :func:`line_features`' features, with the first line of every text that
    begins here and its lines' lengths. A text over ``most`` bytes comes in stretches of about so many (one line at least), which see the
    line before and after them, so that its features are never held together. Yields (features, first lines of texts, lengths)."""
    for text in texts if any(len(t) * 4 > most for t in texts) else [None]:
        if text is None or len(text) * 4 <= most:
            features, first, length = line_features(texts if text is None else [text])
            yield features, first[:-1], length
            continue
        lo = 0
        while lo <= len(text):
            hi = text.find("\n", lo + most // 4)
            hi = len(text) if hi < 0 else hi
            after = text.find("\n", hi + 1) if hi < len(text) else hi
            part = text[lo:len(text) if after < 0 else after]
            if lo:                                 # the line before, and before it the word that its first word may repeat
                before = text.rfind("\n", 0, lo - 1) + 1
                earlier = text[:before].rstrip(_SPACES)
                part = earlier[max(map(earlier.rfind, _SPACES)) + 1:] + "\n" + text[before:lo] + part
            features, _, length = line_features([part])
            own = slice(2 if lo else 0, len(features) - (hi < len(text)))
            yield features[own], np.zeros(0 if lo else 1, np.int64), length[own]
            lo = hi + 1


_LONG = 20_000                             # lines of a text whose messages are passed block by block


def _messages(unary: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Log odds of "good" by the forward messages (with the line's own weight) along one long text, over about as many blocks as a
    block has lines: all blocks are walked at once, first to see what each does to either state that may enter it, then with
    what does enter."""
    n = len(unary)
    side = math.isqrt(n) + 1
    blocks = -(-n // side)
    u = np.concatenate([unary, np.zeros(blocks * side - n)]).reshape(blocks, side)

    def step(message: np.ndarray, own: np.ndarray) -> np.ndarray:
        message = np.logaddexp(message[..., :1] + transitions[0], message[..., 1:] + transitions[1])
        message[..., 1] += own
        return message

    effect = np.tile(np.array([[0.0, -np.inf], [-np.inf, 0.0]]), (blocks, 1, 1))
    for t in range(side):
        effect = step(effect, u[:, t, None])
    begin = np.array([0.0, u[0, 0]])
    message = begin
    for t in range(1, side):
        message = step(message, u[0, t])
    entering = np.zeros((blocks, 2))
    for b in range(1, blocks):
        entering[b] = message
        message = np.logaddexp(message[0] + effect[b, 0], message[1] + effect[b, 1])
    odds = np.empty((blocks, side))
    for t in range(side):
        entering = step(entering, u[:, t])
        if t == 0:
            entering[0] = begin                    # no line before the first
        odds[:, t] = entering[:, 1] - entering[:, 0]
    return odds.ravel()[:n]


def _marginals(unary: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Marginals of "good" of one long text: messages from its begin and, read backwards, from its end."""
    odds = _messages(unary, transitions)
    odds += _messages(unary[::-1], transitions.T)[::-1]
    odds -= unary
    return 1 / (1 + np.exp(-odds))


def forward_backward(unary: np.ndarray, transitions: np.ndarray, first: np.ndarray):
    """Marginals of "good", expected transitions, and log partition of every text."""
    order, alive = _columns(first)
    begin = first[:-1][order]
    alpha = np.zeros((len(unary), 2))
    beta = np.zeros((len(unary), 2))
    for t, m in enumerate(alive):
        at = begin[:m] + t
        alpha[at, 1] = unary[at]
        if t:
            alpha[at] += np.logaddexp(alpha[at - 1, :1] + transitions[0], alpha[at - 1, 1:] + transitions[1])
    for t in range(len(alive) - 2, -1, -1):
        at = begin[:alive[t + 1]] + t
        ahead = beta[at + 1].copy()
        ahead[:, 1] += unary[at + 1]
        beta[at] = np.logaddexp(transitions[:, 0] + ahead[:, :1], transitions[:, 1] + ahead[:, 1:])
    total = np.logaddexp(alpha[:, 0] + beta[:, 0], alpha[:, 1] + beta[:, 1])
    good = np.exp(alpha[:, 1] + beta[:, 1] - total)
    inner = np.setdiff1d(np.arange(len(unary)), first[1:] - 1)
    pair = alpha[inner][:, :, None] + transitions[None] + beta[inner + 1][:, None, :]
    pair[:, :, 1] += unary[inner + 1][:, None]
    expected = np.exp(pair - total[inner][:, None, None]).sum(axis=0)
    return good, expected, total[first[:-1]]


def train(features: np.ndarray, first: np.ndarray, labels: np.ndarray, steps: int = 120, rate: float = 0.1,
          decay: float = 1e-3) -> Model:
    """Adam on the conditional log-likelihood per line."""
    model = Model(np.zeros(features.shape[1]), np.zeros((2, 2)))
    n = np.diff(first)
    truth = np.repeat(labels, n).astype(np.float64)
    same = np.zeros((2, 2))
    for y in (0, 1):
        same[y, y] = (n[labels == y] - 1).sum()
    params = [model.weights, model.transitions]
    m, v = ([np.zeros_like(p) for p in params] for _ in range(2))
    for step in range(1, steps + 1):
        good, expected, _ = forward_backward(model.unary(features), model.transitions, first)
        miss = truth - good
        grads = [sum(f.astype(np.float64).T @ m for f, m in zip(_rows(features), _rows(miss))), same - expected]
        for k, (p, g) in enumerate(zip(params, grads)):
            g = g / len(features) - decay * p
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p += rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-9)
    return model


def held_out(id_col: Column, parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        max_docs: int = 3000, max_lines: int = 1_200_000) -> Model | None:
    """Model learnt from ``labels`` (id and 0/1 label; the caller leaves the held-out ones out)."""
    ship(docs.sparkSession)
    sample = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
              .select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
              .orderBy(F.xxhash64("id"), "id", "label").limit(max_docs))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")

    lines = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^\n]", "")) + 1
    sizes = rows.groupBy(lines.alias("lines")).count().collect()
    most = common_bound({r["lines"]: r["count"] for r in sizes}, max_lines)

    def run(batches):
        for b in slices(batches, _SLICE):
            for text, label in zip(texts_of(b.column(1)), b.column(2).to_pylist()):
                n = text.count("\n") + 1
                chosen = np.arange(n) if n <= most else np.sort(np.random.default_rng(n).choice(n, most, replace=False))
                lines, some = 0, []
                for features, _, _ in stretches([text], _SLICE):
                    at = chosen[np.searchsorted(chosen, lines):np.searchsorted(chosen, lines + len(features))] - lines
                    some.append(features[at].astype(np.float32).tobytes())
                    lines += len(features)
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(some)]), pa.array([label])], names=["features", "label"])

    got = rows.select("id", "text", "label").mapInArrow(releasing(run), "features binary, label double").toArrow().combine_chunks()
    if not got.num_rows:
        return None
    blocks, label = got.column("features").to_pylist(), got.column("label").to_numpy()
    del got
    order = sorted(range(len(label)), key=lambda i: (label[i], blocks[i]))       # one order, however the tasks end
    first = np.cumsum([0, *(len(blocks[i]) // (4 * N_FEATURES) for i in order)])
    features = np.empty((first[-1], N_FEATURES), np.float32)
    for k, i in enumerate(order):
        features[first[k]:first[k + 1]] = np.frombuffer(blocks[i], np.float32).reshape(-1, N_FEATURES)
        blocks[i] = b""
    return train(features, first, label[order])


def _document_scores(texts: list[str], model: Model | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of the texts, marginals of all their lines, and the first line of every text (and the end)."""
    unary, first, length, lines = [], [], [], 0
    for features, begins, sizes in stretches(texts, _SLICE):
        unary.append(np.zeros(len(features)) if model is None else model.unary(features))
        first.append(begins + lines)
        length.append(sizes.astype(np.int32))
        lines += len(features)
    unary, length = np.concatenate(unary), np.concatenate(length)
    first = np.concatenate([*first, [lines]])
    if model is None:
        good = np.full(lines, 0.5)
    elif len(texts) == 1 and lines > _LONG:
        good = _marginals(unary, model.transitions)
    else:
        good, _, _ = forward_backward(unary, model.transitions, first)
    weight = length + 1.0
    scores = np.add.reduceat(weight * good, first[:-1]) / np.add.reduceat(weight, first[:-1])
    return np.clip(scores, 0, 1), good, first


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``score`` and ``line_scores`` (marginals of good)."""
    ship(docs.sparkSession)
    rows = docs.select(id_col, text_col)
    schema = T.StructType([rows.schema[0], T.StructField("score", T.DoubleType()),
                           T.StructField("line_scores", T.ArrayType(T.FloatType()))])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in slices(batches, _SLICE):
            out, good, first = _document_scores(texts_of(b.column(1)), model)
            lines = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(good.astype(np.float32)))
            yield out_batch(arrow, [b.column(0), pa.array(out), lines])

    return rows.mapInArrow(releasing(run), schema)


def keep_good(docs: DataFrame, model: Model | None, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score below ``threshold``."""
    ship(docs.sparkSession)
    text = docs.columns.index(text_col)

    def run(batches):
        for b in slices(batches, _SLICE, text):
            scores, _, _ = _document_scores(texts_of(b.column(text)), model)
            yield b.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(releasing(run), docs.schema)
