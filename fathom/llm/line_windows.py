"""Line dedup over overlapping three-line windows.

A line ends at a newline; a long line is laid out as several: a new one begins after a
word that ends a sentence (``. ! ?``), and after ``wrap`` words. So a passage that stands on one
physical line still consists of lines, and the same passage is laid out the same way
wherever a line begins with it. Joining a document's lines gives back its text exactly.

Every three consecutive lines are hashed. Of the occurrences of a window in one slice of
the input only the first (least document id, then least position) is dealt out by the
window's hash, the others being later ones already; so a window that stands in a third of
all documents meets as one row per slice. There the first of all is found, and the other
places are gathered per document, merged, and the covered lines removed.

Defined results: a null text stays null and has no lines; a text of fewer than three lines
is kept; lines are compared without the blanks around them, and windows of blank
lines only are never removed; rows with equal id and text are one document (all of them
keep or lose the same lines); null ids come first in the order; extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import out_batch, releasing, ship, slices, texts_of

_KIND = np.zeros(256, np.uint8)              # 0: part of a word
_KIND[[9, 32]] = 1
_KIND[10] = 2
_SENTENCE = np.zeros(256, bool)
_SENTENCE[[33, 46, 63]] = True
_SLICE = 3 << 20            # bytes of text laid out at once
_MIX = np.uint64(0x9E3779B97F4A7C15)


def line_pattern(wrap: int = 16) -> str:
    """Regular expression of one line, for engines that lay out text by one."""
    return (r"[ \t]*(?:[^ \t\n]*[^ \t\n.!?][ \t]+){0,%d}[^ \t\n]+[ \t]*\n?|[ \t]*\n|[ \t]+" % (wrap - 1))


class Layout:
    """Lines of many texts: ``data`` (all their bytes), ``start`` and ``end`` of every line in it,
    ``first`` line of every text (and the end), ``begin`` and ``stop`` of the line without the blanks around it."""

    def __init__(self, texts: list[str], wrap: int = 16):
        raw = [t.encode() for t in texts]
        self.data = b"\n".join(raw) + b"\n"                  # the added newlines are cut off below
        data = np.frombuffer(self.data, np.uint8)
        stops = np.cumsum([len(r) + 1 for r in raw]) - 1     # of the texts
        kind = _KIND[data]
        solid = kind == 0
        edge = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
        words, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        newlines = np.flatnonzero(kind == 2)
        followed = np.searchsorted(newlines, ends) < np.searchsorted(newlines, np.append(words[1:], len(data))[:len(ends)])
        hard = followed | _SENTENCE[data[ends - 1]]
        k = np.arange(len(words))
        opening = np.zeros(len(words), np.int64)             # first word since the last hard break
        if len(words) > 1:
            opening[1:] = np.where(hard[:-1], k[1:], 0)
        opening = np.maximum.accumulate(opening)
        breaks = (hard | ((k - opening) % wrap == wrap - 1)) & ~followed
        line_ends = np.union1d(newlines + 1, words[1:][breaks[:-1]])
        line_starts = np.concatenate([[0], line_ends[:-1]])
        text = np.searchsorted(stops, line_starts)           # of every line
        line_ends = np.minimum(line_ends, stops[text])
        keep = line_starts < line_ends
        self.start, self.end, text = line_starts[keep], line_ends[keep], text[keep]
        self.first = np.searchsorted(text, np.arange(len(texts) + 1))
        a, b = np.searchsorted(words, self.start), np.searchsorted(words, self.end)
        self.blank = a == b
        pick = np.minimum(a, max(len(words) - 1, 0)), np.maximum(b - 1, 0)
        none = np.zeros(len(a), np.int64)
        self.begin = words[pick[0]] if len(words) else none
        self.stop = ends[pick[1]] if len(words) else none

    def hashes(self) -> np.ndarray:
        """A hash of every line, 0 if it is blank."""
        data, hash64 = self.data, xxhash.xxh64_intdigest
        h = np.array([hash64(data[a:b]) for a, b in zip(self.begin.tolist(), self.stop.tolist())], np.uint64)
        h[self.blank] = 0
        return h

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, position, hash) of every window that is not blank."""
        h = self.hashes()
        n = len(h) - width + 1
        if n <= 0:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
        mixed, some = np.zeros(n, np.uint64), np.zeros(n, bool)
        for i in range(width):
            mixed = (mixed ^ h[i:i + n]) * _MIX
            mixed ^= mixed >> np.uint64(32)
            some |= ~self.blank[i:i + n]
        at = np.arange(n)
        text = np.searchsorted(self.first, at, side="right") - 1
        inside = some & (at + width <= self.first[text + 1])
        return text[inside], (at - self.first[text])[inside], mixed[inside]


def _places(docs: DataFrame, width: int, wrap: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (later, h, id, mark, p): a window's place. ``later`` rows are known not to be the first."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("mark"))
    schema = T.StructType([T.StructField("later", T.BooleanType()), T.StructField("h", T.LongType()), rows.schema["id"],
                           T.StructField("mark", T.LongType()), T.StructField("p", T.IntegerType())])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in slices(batches, _SLICE):
            text, p, h = Layout(texts_of(b.column(1)), wrap).windows(width)
            ids, mark = b.column(0), b.column(2).to_numpy(zero_copy_only=False)
            # documents of the slice in their order: by id (null first), then by text
            order = pa.compute.sort_indices(pa.table({"id": ids, "mark": b.column(2)}),
                                            sort_keys=[("id", "ascending"), ("mark", "ascending")],
                                            null_placement="at_start").to_numpy()
            same = np.zeros(len(order), bool)
            sorted_ids, sorted_marks = ids.take(pa.array(order)).to_pylist(), mark[order]
            same[1:] = [a == b for a, b in zip(sorted_ids[1:], sorted_ids)]
            same[1:] &= sorted_marks[1:] == sorted_marks[:-1]
            place = np.empty(len(order), np.int64)
            place[order] = np.cumsum(~same)
            doc = place[text]
            by = np.lexsort((p, doc, h))
            text, p, h, doc = text[by], p[by], h[by], doc[by]
            again = np.zeros(len(h), bool)               # the same place of the same document
            again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) & (p[1:] == p[:-1])
            text, p, h = text[~again], p[~again], h[~again]
            later = np.zeros(len(h), bool)
            later[1:] = h[1:] == h[:-1]
            # later places are settled; spread them evenly instead of by their window
            spread = (mark[text].view(np.uint64) ^ p.astype(np.uint64)) * _MIX
            yield out_batch(arrow, [pa.array(later), pa.array(np.where(later, spread, h).view(np.int64)),
                                    ids.take(pa.array(text)), pa.array(mark[text]), pa.array(p.astype(np.int32))])

    return rows.mapInArrow(releasing(run), schema)


def repeated_lines(docs: DataFrame, width: int = 3, wrap: int = 16, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``id``, ``mark`` (xxhash64 of the text) and ``at``: the first lines of the later occurrences
    of repeated windows, sorted. Documents that lose no line have no row."""
    ship(docs.sparkSession)
    places = _places(docs, width, wrap, id_col, text_col)
    rank = F.rank().over(Window.partitionBy("later", "h").orderBy("id", "mark", "p"))
    return (places.withColumn("rank", rank).where(F.col("later") | (F.col("rank") > 1))
            .groupBy("id", "mark").agg(F.array_sort(F.collect_set("p")).alias("at")))


def remove_repeated_lines(docs: DataFrame, width: int = 3, wrap: int = 16, id_col: str = "doc_id",
                          text_col: str = "text", counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with the covered lines taken out of ``text_col``. ``counts`` names two more
    columns: the lines before, and the lines removed."""
    found = repeated_lines(docs, width, wrap, id_col, text_col).alias("f")
    rows = docs.alias("d")
    joined = rows.join(found, F.col(f"d.{id_col}").eqNullSafe(F.col("f.id")) &
                       (F.xxhash64(F.col(f"d.{text_col}")) == F.col("f.mark")), "left")
    rest = F.struct(*(F.col(f"d.{c}").alias(c) for c in docs.columns if c != text_col)) if len(docs.columns) > 1 \
        else F.struct(F.lit(0).alias("_"))
    rows = joined.select(F.lit(0).alias("_"), F.col(f"d.{text_col}").alias("text"), F.col("f.at").alias("at"), rest.alias("rest"))
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("lines", T.LongType()),
                           T.StructField("gone", T.LongType()), rows.schema["rest"]])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in slices(batches, _SLICE):
            layout = Layout(texts_of(b.column(1)), wrap)
            lines = np.diff(layout.first)
            gone = np.zeros(b.num_rows, np.int64)
            texts = b.column(1)
            changed: dict[int, str] = {}
            for i, at in enumerate(b.column(2).to_pylist()):
                if at:
                    covered = np.zeros(lines[i], bool)
                    for step in range(width):
                        covered[np.asarray(at) + step] = True
                    gone[i] = covered.sum()
                    lo = layout.first[i]
                    kept = lo + np.flatnonzero(~covered)
                    changed[i] = b"".join(layout.data[a:z] for a, z in zip(
                        layout.start[kept].tolist(), layout.end[kept].tolist())).decode()
            if changed:
                texts = texts.to_pylist()
                for i, t in changed.items():
                    texts[i] = t
            yield out_batch(arrow, [texts, pa.array(lines), pa.array(gone), b.column(3)])

    out = rows.mapInArrow(releasing(run), schema)
    cols = [F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    return out.select(*cols, *([F.col("lines").alias(counts[0]), F.col("gone").alias(counts[1])] if counts else []))
