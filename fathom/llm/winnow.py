"""Benchmark decontamination by winnowing, in DataFrame functions only.

Item windows are ``span`` consecutive words (a shorter item is one window). A window of
``t`` words is cut into its ``t - w + 1 = k``-grams; its fingerprint is the least k-gram
hash among its ``w`` k-grams, the leftmost of equals. Documents are fingerprinted the same
way, once per sliding window, and consecutive windows that choose the same k-gram keep
it once. As ``t = k + w - 1``, every shared span of ``t`` words chooses the same k-gram at the
same offset on both sides, so joining the fingerprints finds every occurrence. Each hit
is then extended to the window it came from and compared word by word, so a hash
collision never counts.

Plan: one pass over the documents explodes the fingerprints for all window lengths (about ``2 / (w + 1)``
of the words; every word where few different ones repeat) and meets the benchmark's distinct (length, hash, offset),
so a k-gram that many items share counts once per offset. A meeting names a place; the words there are
joined with the distinct windows before anything is gathered, so what a document gathers is at most
its own words. The benchmark's side is broadcast while its measured size is under ``broadcast_bytes``, and texts are then
never shuffled; beyond it, places are shuffled and brought back to their texts. A k-gram is one number (hash bits, then
position), so the least of a window is a comparison of numbers.

Defined results: null or empty texts have no words and no hits; null items and items without
words have no windows; rows with equal id and text are one document (each row is
returned); an item id is compared as a string, a null id as the empty string; extra
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, row_key

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BITS = 30                     # of a position; a string has fewer words
_PLACE = (1 << _BITS) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z (other letters keep their case)."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _SEPARATORS), "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _grams(words: Column, k: int) -> Column:
    """Every k-gram as one number: the high bits of its hash, then its position; none if there are fewer than k words."""
    return F.when(F.size(words) >= k, F.transform(
        F.sequence(F.lit(1), F.size(words) - (k - 1)),
        lambda i: F.xxhash64(F.slice(words, i, k)).bitwiseAND(F.lit(~_PLACE)).bitwiseOR((i - 1).cast("long")))
    ).otherwise(F.array().cast("array<bigint>"))


def fingerprints(words: Column, k: int, w: int) -> Column:
    """The chosen k-gram (see :func:`_grams`) of every sliding window of ``k + w - 1`` words, equal neighbours once. As the hash
    comes first, the least number of a window is its least hash, the leftmost of equals."""
    def chosen(grams):
        if w == 1:
            return grams
        return F.when(F.size(grams) >= w, F.transform(
            F.sequence(F.lit(0), F.size(grams) - w), lambda i: F.least(*[F.get(grams, i + j) for j in range(w)]))
        ).otherwise(F.array().cast("array<bigint>"))

    def once(picks):
        return F.filter(picks, lambda x, i: (i == 0) | (x != F.get(picks, i - 1)))

    return _let(words, lambda ws: _let(_grams(ws, k), lambda g: _let(chosen(g), once)))


def item_windows(bench: DataFrame, span: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item, window words, length) of the benchmark."""
    words = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
                         words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(span))
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    return (words.withColumn("len", length)
            .select("item", "len", F.explode(F.transform(starts, lambda s: F.slice("words", s, F.col("len")))).alias("win"))
            .distinct())


def _places(words: DataFrame, windows: DataFrame, lengths: list[int], broadcast: bool) -> DataFrame:
    """``key``, ``at``, ``len`` and ``win`` (the words there) of every place of ``words`` (key, words) whose fingerprint, for one of
    the window lengths, is that of a window of ``windows`` (win, len)."""
    def prints(column: Column, length: int, around: bool = False) -> Column:
        k = (length + 1) // 2
        w = length - k + 1
        # with the words of every window that could have chosen the k-gram: a text is never repeated per fingerprint
        place = lambda f: f.bitwiseAND(F.lit(_PLACE)).cast("int")
        begin = lambda f: F.greatest(place(f) - (w - 1), F.lit(0))
        more = lambda f: [begin(f).alias("begin"), F.slice(column, begin(f) + 1, w - 1 + length).alias("around")]
        return F.transform(fingerprints(column, k, w), lambda f: F.struct(
            F.lit(length).alias("len"), F.shiftright(f, _BITS).alias("h"), place(f).alias("p"), *(more(f) if around else ())))

    def first(at: Column) -> Column:
        """One-based; also for places before the text, which Spark may look at before it drops them."""
        return F.greatest(at + 1, F.lit(1))

    own = reduce(DataFrame.unionByName, [windows.where(F.col("len") == n).select(F.explode(prints(F.col("win"), n)).alias("f"))
                                         for n in lengths])
    own = own.select("f.len", "f.h", F.col("f.p").alias("q")).distinct()
    every = F.flatten(F.array(*[prints(F.col("words"), n, broadcast) for n in lengths]))
    found = words.select("key", F.explode(every).alias("f")).select("key", "f.*")
    met = found.join(F.broadcast(own) if broadcast else own, ["len", "h"]).where(F.col("p") >= F.col("q")).withColumn("at", F.col("p") - F.col("q"))
    if broadcast:
        return met.select("key", "at", "len", F.slice("around", first(F.col("at") - F.col("begin")), F.col("len")).alias("win"))
    met = met.select("key", F.struct("len", "at").alias("f")).distinct().groupBy("key").agg(F.collect_list("f").alias("places"))   # some per word
    there = F.transform("places", lambda f: F.struct(f["len"].alias("len"), f["at"].alias("at"),
                                                     F.slice("words", first(f["at"]), f["len"]).alias("win")))
    return words.dropDuplicates(["key"]).join(met, "key").select("key", F.explode(there).alias("f")).select("key", "f.at", "f.len", "f.win")


def contamination(docs: DataFrame, bench: DataFrame, span: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text",
                  broadcast_bytes: int = 64 << 20) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``key`` (see :func:`row_key`), ``n_words``,
    ``hit_words`` (sorted positions of the words inside occurrences of item windows) and
    ``item_ids`` (sorted strings)."""
    rows = docs.select(F.col(id_col), row_key(id_col, text_col).alias("key"), words_of(F.col(text_col)).alias("words"))
    owned = checkpoint(item_windows(bench, span, item_col, item_text_col))
    windows = checkpoint(owned.select("win", "len").distinct()).withColumn("wid", F.monotonically_increasing_id())
    measured = (windows.groupBy("len").agg(F.sum(F.octet_length(F.array_join("win", " ")) + 64).alias("b"))
                .collect())                                    # at most ``span`` rows
    plain = rows.select(F.col(id_col), "key", F.size("words").cast("long").alias("n_words"))
    none = {"hit_words": F.array().cast("array<int>"), "item_ids": F.array().cast("array<string>")}
    if not measured:
        return plain.withColumns(none)
    small = sum(r["b"] for r in measured) <= broadcast_bytes
    places = _places(rows.select("key", "words"), windows, sorted(r["len"] for r in measured), small)
    hits = places.join(F.broadcast(windows) if small else windows, ["win", "len"])
    found = checkpoint(hits.groupBy("key").agg(F.collect_set(F.struct("at", "len")).alias("places"), F.collect_set("wid").alias("wids")))
    positions = F.array_sort(F.array_distinct(F.flatten(F.transform(
        "places", lambda x: F.sequence(x["at"], x["at"] + x["len"] - 1)))))
    owners = owned.join(windows, ["win", "len"]).select("wid", "item")
    items = (found.select("key", F.explode("wids").alias("wid")).join(owners, "wid")
             .groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("item_ids")))
    found = found.select("key", positions.alias("hit_words")).join(items, "key")
    return plain.join(found, "key", "left").select(
        F.col(id_col), "key", "n_words", *[F.coalesce(c, e).alias(c) for c, e in none.items()])


def drop_contaminated(docs: DataFrame, bench: DataFrame, span: int = 10, id_col: str = "doc_id",
                      text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without the rows that hold an occurrence of an item window."""
    bad = contamination(docs, bench, span, id_col, text_col, **kw).where(F.size("hit_words") > 0).select("key").distinct()
    key = "_row_key"
    while key in docs.columns:
        key += "_"
    return (docs.withColumn(key, row_key(id_col, text_col))
            .join(bad.withColumnRenamed("key", key), key, "left_anti").select(*docs.columns))
