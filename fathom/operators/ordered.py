"""Ordered operators that stay parallel inside a hot key.

A plain ``Window.partitionBy(key).orderBy(o)`` sends every row of a key to
one task; if one series holds a third of the data that task holds a third of
the data. The helpers here split each key into *chunks* (any expression that
is non-decreasing along the order, e.g. ``floor(step / 1e6)`` or
``date_trunc('hour', ts)``):

1. rows are windowed per ``(key, chunk)`` -- bounded, parallel work;
2. a per-chunk summary (a few rows' payload or a count) is aggregated;
3. a window over the *chunk table* (one row per chunk, small even for a hot
   key) carries state across chunk boundaries;
4. the carry is joined back on ``(key, chunk)`` -- the big side is already
   hash-partitioned on those columns by step 1, so no extra shuffle of it.

All results are exact; the chunking only changes where the work runs.
"""

from __future__ import annotations

import math
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from fathom.functions.exprs import col_of
from fathom.session import cut_lineage

_CH = "__chunk"


def _cols(cs: Sequence[str | Column]) -> list[Column]:
    return [col_of(c) for c in cs]


def by_range(df: DataFrame, order_by: Sequence[str | Column], rows_per_chunk: int = 1_000_000, out: str = "__range",
             rows: int | None = None) -> DataFrame:
    """``df`` with a chunk number ``out`` that does not fall along ``order_by``: rows are laid out by ranges of it (bounds from
    Spark's sampled range partitioner, so none are collected or compared row by row) and kept so by a checkpoint. Equal
    orders share a chunk. ``rows``: the number of rows if it is known; one chunk is not laid out at all."""
    chunks = -(-(df.count() if rows is None else rows) // rows_per_chunk)
    if chunks <= 1:
        return df.withColumn(out, F.lit(0))
    return cut_lineage(df.repartitionByRange(chunks, *_cols(order_by)).withColumn(out, F.spark_partition_id()))


def chunked_row_number(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str | Column],
                       chunk: Column, out: str = "rn") -> DataFrame:
    """Exact ``row_number() over (partition by P order by O)``.

    ``chunk`` must be non-decreasing along ``O`` within each partition.
    """
    P = list(partition_by)
    d = df.withColumn(_CH, chunk)
    w = Window.partitionBy(*_cols(P), F.col(_CH)).orderBy(*_cols(order_by))
    d = d.withColumn("__rn_in", F.row_number().over(w))
    counts = d.groupBy(*_cols(P), F.col(_CH)).agg(F.count(F.lit(1)).alias("__n"))
    wc = Window.partitionBy(*_cols(P)).orderBy(F.col(_CH)).rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*_cols(P), F.col(_CH),
                         F.coalesce(F.sum("__n").over(wc), F.lit(0)).alias("__off"))
    return (d.join(offs, on=[*P, _CH], how="inner")
             .withColumn(out, (F.col("__off") + F.col("__rn_in")).cast("long"))
             .drop("__off", "__rn_in", _CH))


def _empty_of(element_type) -> Column:
    """Typed empty array literal (no column reference, usable inside aggregates)."""
    return F.array().cast(ArrayType(element_type, True))


def chunked_neighbors(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str | Column],
                      chunk: Column, preds: Mapping[str, Column], payload: Mapping[str, Column],
                      k_prev: int = 1, k_next: int = 0,
                      payload_of: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """For every row and every named predicate ``name``, the payload of the
    nearest ``k_prev`` earlier rows and ``k_next`` later rows (strictly before /
    after, within the partition) for which the predicate holds.

    Adds array columns ``{name}__prev`` and ``{name}__next`` (nearest first) of
    ``struct(payload)``; ``payload_of`` names the payload columns a predicate needs
    (default: all), so wide calls do not carry columns x columns values. Exact; the
    work is linear in the rows and per-task work is bounded by the chunk size: both
    directions use a running frame (``unboundedPreceding`` to ``-1``), the following
    side over the descending order.
    """
    P = list(partition_by)
    O = _cols(order_by)
    d = df.withColumn(_CH, chunk)
    fields = {name: list((payload_of or {}).get(name, payload)) for name in preds}
    d = d.withColumns({f"{name}__self": F.struct(*[payload[n].alias(n) for n in fields[name]]) for name in preds})
    d = d.withColumn("__ord", F.struct(*[c for c in O]))
    d = d.withColumns({f"{name}__is": F.coalesce(p, F.lit(False)) for name, p in preds.items()})
    w = Window.partitionBy(*_cols(P), F.col(_CH))
    before = w.orderBy(*O).rowsBetween(Window.unboundedPreceding, -1)
    after = w.orderBy(*[c.desc() for c in O]).rowsBetween(Window.unboundedPreceding, -1)
    empty_of = {name: _empty_of(d.schema[f"{name}__self"].dataType) for name in preds}
    one = lambda s: F.filter(F.array(s), lambda e: e.isNotNull())

    # ---- 1. in-chunk chains: chain_j(r) = the j nearest earlier (later) pred rows.
    # All predicates of one direction and level share one window pass.
    for direction, k, frame in (("prev", k_prev, before), ("next", k_next, after)):
        for level in range(k):
            grown = {}
            for name in preds:
                own, c = F.col(f"{name}__self"), f"{name}__{direction}_in"
                if level == 0:
                    grown[c] = one(F.last(F.when(F.col(f"{name}__is"), own), ignorenulls=True).over(frame))
                else:
                    chain = F.when(F.col(f"{name}__is"), F.slice(F.concat(F.array(own), F.col(c)), 1, k))
                    grown[c] = F.coalesce(F.last(chain, ignorenulls=True).over(frame), empty_of[name])
            d = d.withColumns(grown)

    # ---- 2. chunk summaries: the last k_prev / first k_next pred rows of each chunk
    aggs = []
    for name in preds:
        is_p, own, empty = F.col(f"{name}__is"), F.col(f"{name}__self"), empty_of[name]
        if k_prev > 0:
            tail = F.slice(F.concat(F.array(own), F.col(f"{name}__prev_in")), 1, k_prev)
            aggs.append(F.coalesce(F.max_by(tail, F.when(is_p, F.col("__ord"))), empty).alias(f"{name}__tail"))
        if k_next > 0:
            head = F.slice(F.concat(F.array(own), F.col(f"{name}__next_in")), 1, k_next)
            aggs.append(F.coalesce(F.min_by(head, F.when(is_p, F.col("__ord"))), empty).alias(f"{name}__head"))
    chunks = d.groupBy(*_cols(P), F.col(_CH)).agg(*aggs)

    # ---- 3. carry across chunks (window over the small chunk table)
    wc = Window.partitionBy(*_cols(P))
    cb = wc.orderBy(F.col(_CH)).rowsBetween(Window.unboundedPreceding, -1)
    ca = wc.orderBy(F.col(_CH).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = []
    for direction, k, frame, src in (("prev", k_prev, cb, "tail"), ("next", k_next, ca, "head")):
        for level in range(k):
            grown = {}
            for name in preds:
                arr, c = F.col(f"{name}__{src}"), f"{name}__{direction}_carry"
                chain = arr if level == 0 else F.slice(F.concat(arr, F.col(c)), 1, k)
                grown[c] = F.coalesce(F.last(F.when(F.size(arr) > 0, chain), ignorenulls=True).over(frame), empty_of[name])
            chunks = chunks.withColumns(grown)
        carry_cols += [f"{name}__{direction}_carry" for name in preds if k > 0]
    chunks = chunks.select(*_cols(P), F.col(_CH), *[F.col(c) for c in carry_cols])

    # ---- 4. join the carry back and merge with the in-chunk chains
    d = d.join(chunks, on=[*P, _CH], how="inner")
    for name in preds:
        for direction, k in (("prev", k_prev), ("next", k_next)):
            if k <= 0:
                continue
            d = d.withColumn(f"{name}__{direction}",
                             F.slice(F.concat(F.col(f"{name}__{direction}_in"), F.col(f"{name}__{direction}_carry")), 1, k))
            d = d.drop(f"{name}__{direction}_in", f"{name}__{direction}_carry")
        d = d.drop(f"{name}__is")
    return d.drop("__ord", _CH, *[f"{name}__self" for name in preds])


def nth(arr: str | Column, i: int, field: str | None = None) -> Column:
    """i-th (0-based) element of a neighbour array (NULL when absent), optionally one field."""
    e = F.try_element_at(col_of(arr), F.lit(i + 1))
    return e.getField(field) if field else e


#: Buckets of a column that exact_quantiles splits, and rows of the sample for each of them.
_BUCKETS, _SAMPLED = (1000, 20_000), 30


def _bucket_bounds(df: DataFrame, columns: Sequence[str], rows: int, rows_per_chunk: int) -> list[list[float]]:
    """Ascending distinct bounds per column out of a sample. They only balance the buckets; no result depends on them."""
    buckets = min(max(_BUCKETS[0], 8 * rows // rows_per_chunk), _BUCKETS[1])
    sampled = df.select(*[(col_of(c).cast("double") + F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(columns)])
    sampled = sampled.sample(min(1.0, _SAMPLED * buckets / rows), seed=7)
    cells = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"x{i}").alias("x")) for i in range(len(columns))])
    probs = ", ".join(f"{i / buckets!r}D" for i in range(1, buckets))
    got = (sampled.select(F.explode(cells).alias("s")).select("s.f", "s.x").where(F.col("x").isNotNull())
           .groupBy("f").agg(F.expr(f"percentile_approx(x, array({probs}), {10 * buckets})").alias("at")).collect())
    bounds: list[list[float]] = [[] for _ in columns]
    for r in got:
        bounds[r["f"]] = sorted({v for v in r["at"] if math.isfinite(v)})
    return bounds


def bucket_columns(df: DataFrame, columns: Sequence[str], bounds: Sequence[Sequence[float]], out: Sequence[str]) -> DataFrame:
    """``out``: how many of a column's ascending finite bounds are at or below its value, by binary search (NaN is above all of
    them). The columns hold doubles, none of them -0.0; NULL gives any number."""
    from pyspark.ml.feature import Bucketizer
    splits = [[-math.inf, *b, math.inf] if len(b) else [-math.inf, 0.0, math.inf] for b in bounds]
    d = df.withColumns({f"__b{i}": F.coalesce(F.col(c), F.lit(0.0)) for i, c in enumerate(columns)})
    d = Bucketizer(splitsArray=splits, inputCols=[f"__b{i}" for i in range(len(columns))], outputCols=list(out), handleInvalid="keep").transform(d)
    return d.withColumns({o: F.least(F.col(o), F.lit(float(len(b)))).cast("int") for o, b in zip(out, bounds)}).drop(*[f"__b{i}" for i in range(len(columns))])


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    rows_per_chunk: int = 1_000_000) -> dict[str, list[float | None]]:
    """Exact linear-interpolation quantiles of whole columns, without a single
    task holding a column.

    If a column has more than ``rows_per_chunk`` values, cells are first counted per bucket between bounds from a sample;
    these counts tell which buckets hold a wanted rank, and only the cells of those go on. Such cells are counted per
    (column, bucket, value) with map-side combining, so ties -- also one value on half of the rows -- are a single row from
    then on, and sorted within a bucket for their prefix counts. The fit result (a few numbers per column) goes to the driver.
    """
    cols = list(columns)
    if not cols:
        return {}
    rows = df.agg(*[F.count(col_of(c).cast("double")).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    n = [int(rows[f"n{i}"]) for i in range(len(cols))]
    xs, bs = [f"__x{i}" for i in range(len(cols))], [f"__at{i}" for i in range(len(cols))]
    d = df.select(*[(col_of(c).cast("double") + F.lit(0.0)).alias(x) for c, x in zip(cols, xs)])
    wanted: dict[int, list[tuple[int, int, float]]] = {}
    for i in range(len(cols)):
        h = [(n[i] - 1) * float(p) for p in probs] if n[i] else []
        wanted[i] = [(math.floor(x) + 1, min(math.floor(x) + 2, n[i]) if x > math.floor(x) else math.floor(x) + 1,
                      x - math.floor(x)) for x in h]
    ranks = {i: sorted({r for a, b, _ in w for r in (a, b)}) for i, w in wanted.items() if w}
    if not ranks:
        return {c: [None] * len(probs) for c in cols}
    keep: dict[int, dict[int, tuple[int, list[int]]]] = {i: {0: (0, r)} for i, r in ranks.items()}
    if max(n) > rows_per_chunk:
        d = bucket_columns(d, xs, _bucket_bounds(df, cols, max(n), rows_per_chunk), bs)
        cells = F.array(*[F.struct(F.lit(i).alias("f"), F.when(F.col(x).isNotNull(), F.col(b)).alias("chunk")) for i, (x, b) in enumerate(zip(xs, bs))])
        totals: dict[int, list[tuple[int, int]]] = {}
        for r in (d.select(F.explode(cells).alias("s")).select("s.f", "s.chunk").where(F.col("chunk").isNotNull())
                  .groupBy("f", "chunk").agg(F.count(F.lit(1)).alias("n")).collect()):          # one row per bucket
            totals.setdefault(r["f"], []).append((r["chunk"], int(r["n"])))
        for i in ranks:
            keep[i], ahead = {}, 0
            for at, total in sorted(totals[i]):
                here = [r - ahead for r in ranks[i] if ahead < r <= ahead + total]
                if here:
                    keep[i][at] = (ahead, here)
                ahead += total
    else:
        d = d.withColumns({b: F.lit(0) for b in bs})
    inside = {i: F.col(x).isNotNull() & F.col(b).isin(list(keep.get(i, {}))) for i, (x, b) in enumerate(zip(xs, bs))}
    cells = F.array(*[F.when(inside[i], F.struct(F.lit(i).alias("f"), F.col(b).alias("chunk"), F.col(x).alias("x"))) for i, (x, b) in enumerate(zip(xs, bs))])
    counts = (d.select(F.explode(cells).alias("s")).where(F.col("s").isNotNull()).select("s.f", "s.chunk", "s.x")
              .groupBy("f", "chunk", "x").agg(F.count(F.lit(1)).alias("n")))
    picks = [(i, at, here) for i, chunks in keep.items() for at, (_, here) in chunks.items()]
    hit = df.sparkSession.createDataFrame(picks, "f int, chunk int, hit array<bigint>")
    upto = F.sum("n").over(Window.partitionBy("f", "chunk").orderBy("x"))
    found = (counts.withColumn("upto", upto).join(F.broadcast(hit), ["f", "chunk"])             # a row per wanted bucket
             .withColumn("hit", F.filter("hit", lambda r: (r > F.col("upto") - F.col("n")) & (r <= F.col("upto"))))
             .where(F.size("hit") > 0).select("f", "chunk", "x", "hit").collect())
    value = {(r["f"], keep[r["f"]][r["chunk"]][0] + k): r["x"] for r in found for k in r["hit"]}
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        vals: list[float | None] = []
        for lo, hi, frac in wanted[i]:
            a, b = value[(i, lo)], value[(i, hi)]
            vals.append(a if frac == 0 else a + (b - a) * frac)
        out[c] = vals or [None] * len(probs)
    return out


def key_quantiles(df: DataFrame, key: Sequence[str], columns: Sequence[str], probs: Sequence[float],
                  rows_per_chunk: int = 1_000_000, rows: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles of every (key, column): ``key``, ``f`` (number of the column), ``n`` (values that are
    not null) and ``q`` (one number per probability). Keys without values have no row.

    Cells are counted per (key, column, value) with map-side combining and laid out by ranges of these three, so
    also a key of half of all rows, none alike, is spread over tasks. The totals of a key's chunks tell which ones
    hold its wanted ranks; prefix counts run inside a chunk. No task and no buffer holds a key's values."""
    K = list(key)
    cells = F.array(*[F.struct(F.lit(i).alias("f"), col_of(c).cast("double").alias("x")) for i, c in enumerate(columns)])
    counts = (df.select(*_cols(K), F.explode(cells).alias("s")).select(*_cols(K), "s.f", "s.x").where(F.col("x").isNotNull())
              .groupBy(*_cols(K), "f", "x").agg(F.count(F.lit(1)).alias("n")))
    rows = df.count() if rows is None else rows
    counts = by_range(counts, [*K, "f", "x"], rows_per_chunk, "__range", rows * len(list(columns)))
    group = [*_cols(K), F.col("f")]
    totals = counts.groupBy(*group, "__range").agg(F.sum("n").alias("__in"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "__range", "__in", F.coalesce(F.sum("__in").over(before), F.lit(0)).alias("__ahead"), F.sum("__in").over(whole).alias("__all"))
    h = [(F.col("__all") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array(*[r.cast("long") for x in h for r in (F.floor(x) + 1, F.ceil(x) + 1)])
    here = F.filter(F.array_distinct(ranks), lambda r: (r > F.col("__ahead")) & (r <= F.col("__ahead") + F.col("__in")))
    totals = totals.withColumn("__ranks", here).where(F.size("__ranks") > 0)
    inside = Window.partitionBy(*group, "__range").orderBy("x")
    found = (counts.join(totals, [*K, "f", "__range"]).withColumn("__upto", F.sum("n").over(inside) + F.col("__ahead"))
             .withColumn("__hit", F.filter("__ranks", lambda r: (r > F.col("__upto") - F.col("n")) & (r <= F.col("__upto"))))
             .where(F.size("__hit") > 0).select(*group, "__all", "x", F.explode("__hit").alias("__rank")))
    at = found.groupBy(*group).agg(F.first("__all").alias("__all"),                      # two ranks per probability
                                   F.map_from_entries(F.collect_list(F.struct("__rank", "x"))).alias("__at"))
    out = []
    for x in h:
        low, high = (F.try_element_at("__at", (r + 1).cast("long")) for r in (F.floor(x), F.ceil(x)))
        out.append(low + (high - low) * (x - F.floor(x)))
    return at.select(*group, F.col("__all").alias("n"), F.array(*out).alias("q"))
