"""Interpolating imputation down the rows of each partition.

Positions are row numbers in ``order_by`` within ``partition_by`` (the
reference interpolates by row position). For every missing value the nearest
known points on each side come from ``chunked_neighbors`` (bounded tasks even
for a hot partition); the interpolant is then a closed-form column expression:

* ``linear``  -- line through the two enclosing known points; outside the
  known range, the line through the two nearest (extrapolation);
* ``nearest`` -- nearest known point, half-way ties to the earlier point;
* ``pchip``   -- monotone cubic Hermite (Fritsch-Butland harmonic slopes,
  three-point edge slopes), extrapolated with the end pieces;
* ``akima``   -- Hermite cubic whose slopes weigh the secants on either side by how
  little the secants beyond them turn; two secants are continued past each end of
  the known points, and nothing is extrapolated.

A partition with fewer than two known values is left unchanged. Known
values are never modified.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.exprs import col_of
from fathom.operators.ordered import chunked_neighbors, chunked_row_number, nth

METHODS = ("linear", "nearest", "pchip")       # extrapolate
INNER_METHODS = ("akima",)                     # only between known points


def _pt(arr: str, i: int):
    return nth(arr, i, "pos"), nth(arr, i, "v")


def _linear(x, lo, hi):
    (x0, y0), (x1, y1) = lo, hi
    slope = (y1 - y0) / (x1 - x0)
    return slope * (x - x0) + y0


def _sign(v: Column) -> Column:
    return F.signum(v)


def _interior_slope(d0: Column, d1: Column, h0: Column, h1: Column) -> Column:
    """Weighted harmonic mean of neighbouring secant slopes; 0 at extrema."""
    w1 = F.lit(2.0) * h1 + h0
    w2 = h1 + F.lit(2.0) * h0
    flat = (_sign(d0) != _sign(d1)) | (d0 == 0) | (d1 == 0)
    return F.when(flat, F.lit(0.0)).otherwise((w1 + w2) / (w1 / d0 + w2 / d1))


def _edge_slope(h0: Column, h1: Column, m0: Column, m1: Column) -> Column:
    """Three-point end slope, shape preserving."""
    d = ((F.lit(2.0) * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
    return (F.when(_sign(d) != _sign(m0), F.lit(0.0))
             .when((_sign(m0) != _sign(m1)) & (F.abs(d) > F.abs(F.lit(3.0) * m0)), F.lit(3.0) * m0)
             .otherwise(d))


def _pchip_columns(d: DataFrame, x: Column, out: str) -> DataFrame:
    """Hermite cubic with PCHIP slopes, built in small projection steps (one
    expression per step keeps generated code far below the JVM method limit).

    Expects the segment columns ``__xa..__yd``: B, C enclose the point (or are
    the end piece used for extrapolation); A before B and D after C may be NULL.
    """
    c = lambda n: F.col(n)
    d = (d.withColumn("__hab", c("__xb") - c("__xa")).withColumn("__hbc", c("__xc") - c("__xb"))
          .withColumn("__hcd", c("__xd") - c("__xc")))
    d = (d.withColumn("__mab", (c("__yb") - c("__ya")) / c("__hab"))
          .withColumn("__mbc", (c("__yc") - c("__yb")) / c("__hbc"))
          .withColumn("__mcd", (c("__yd") - c("__yc")) / c("__hcd")))
    has_a, has_d = c("__xa").isNotNull(), c("__xd").isNotNull()
    d = d.withColumn("__db", F.when(has_a, _interior_slope(c("__mab"), c("__mbc"), c("__hab"), c("__hbc")))
                              .when(has_d, _edge_slope(c("__hbc"), c("__hcd"), c("__mbc"), c("__mcd")))
                              .otherwise(c("__mbc")))
    d = d.withColumn("__dc", F.when(has_d, _interior_slope(c("__mbc"), c("__mcd"), c("__hbc"), c("__hcd")))
                              .when(has_a, _edge_slope(c("__hbc"), c("__hab"), c("__mbc"), c("__mab")))
                              .otherwise(c("__mbc")))
    d = d.withColumn("__t", (x - c("__xb")) / c("__hbc"))
    t = c("__t")
    t2, t3 = t * t, t * t * t
    h00 = F.lit(2.0) * t3 - F.lit(3.0) * t2 + F.lit(1.0)
    h10 = t3 - F.lit(2.0) * t2 + t
    h01 = F.lit(-2.0) * t3 + F.lit(3.0) * t2
    h11 = t3 - t2
    val = h00 * c("__yb") + h10 * c("__hbc") * c("__db") + h01 * c("__yc") + h11 * c("__hbc") * c("__dc")
    d = d.withColumn(out, val)
    return d.drop("__hab", "__hbc", "__hcd", "__mab", "__mbc", "__mcd", "__db", "__dc", "__t",
                  "__xa", "__ya", "__xb", "__yb", "__xc", "__yc", "__xd", "__yd")


def _akima_slope(m: Sequence[Column]) -> Column:
    """Slope at a point from the two secants before it and the two after it; their mean turn decides, or, where
    neither side turns, the outer two are averaged."""
    after, before = F.abs(m[3] - m[2]), F.abs(m[1] - m[0])
    turns = after + before > F.lit(1e-9) * (F.abs(m[0]) + F.abs(m[1]) + F.abs(m[2]) + F.abs(m[3]))
    return F.when(turns, (after * m[1] + before * m[2]) / (after + before)).otherwise(F.lit(0.5) * (m[3] + m[0]))


def _akima_columns(d: DataFrame, x: Column, P, N, out: str) -> DataFrame:
    """Akima's value between the nearest known points (NULL outside), one projection step after the other. ``P`` and
    ``N``: the three known points on either side, nearest first."""
    secant = lambda a, b: (b[1] - a[1]) / (b[0] - a[0])
    c = lambda n: F.col(n)
    two = F.lit(2.0)
    d = d.withColumns({"__s0": secant(P[2], P[1]), "__s1": secant(P[1], P[0]), "__s2": secant(P[0], N[0]),
                       "__s3": secant(N[0], N[1]), "__s4": secant(N[1], N[2])})
    # past an end secants go on by the last difference; between two points alone all are the one there is
    d = d.withColumns({"__m1": F.coalesce(c("__s1"), two * c("__s2") - c("__s3"), c("__s2")),
                       "__m3": F.coalesce(c("__s3"), two * c("__s2") - c("__s1"), c("__s2"))})
    d = d.withColumns({"__m0": F.coalesce(c("__s0"), two * c("__m1") - c("__s2")), "__m4": F.coalesce(c("__s4"), two * c("__m3") - c("__s2"))})
    d = d.withColumns({"__ta": _akima_slope([c("__m0"), c("__m1"), c("__s2"), c("__m3")]),
                       "__tb": _akima_slope([c("__m1"), c("__s2"), c("__m3"), c("__m4")])})
    d = d.withColumns({"__h": N[0][0] - P[0][0], "__t": x - P[0][0]})
    square = (F.lit(3.0) * c("__s2") - two * c("__ta") - c("__tb")) / c("__h")
    cube = (c("__ta") + c("__tb") - two * c("__s2")) / (c("__h") * c("__h"))
    d = d.withColumn(out, P[0][1] + c("__t") * (c("__ta") + c("__t") * (square + c("__t") * cube)))
    return d.drop("__h", "__t", "__ta", "__tb", *[f"__s{i}" for i in range(5)], *[f"__m{i}" for i in (0, 1, 3, 4)])


def interpolate(df: DataFrame, columns: Sequence[str], method: str, partition_by: Sequence[str],
                order_by: Sequence[str | Column], chunk: Column) -> DataFrame:
    """Fill NULLs of ``columns`` by interpolation within each partition.

    ``order_by`` has to be a total order. All columns share one row numbering and one
    neighbour pass, whatever their number."""
    if method not in METHODS + INNER_METHODS:
        raise ValueError(f"unknown interpolation method {method!r}")
    k = 3 if method in ("pchip", "akima") else 2
    cols, P = list(columns), list(partition_by)
    d = chunked_row_number(df, P, order_by, chunk, out="__pos")
    x = F.col("__pos").cast("double")
    if len(cols) <= 2:
        vals = {f"c{i}": col_of(c).cast("double") for i, c in enumerate(cols)}
        d = chunked_neighbors(d, P, order_by, chunk, preds={f"__kn{i}": v.isNotNull() for i, v in enumerate(vals.values())},
                              payload={"pos": x, **vals}, k_prev=k, k_next=k,
                              payload_of={f"__kn{i}": ["pos", f"c{i}"] for i in range(len(cols))})
        for i, c in enumerate(cols):
            d = _fill(d, f"__kn{i}", x, col_of(c).cast("double"), f"c{i}", method, k, c)
        return d.drop("__pos", *[f"__kn{i}__{side}" for i in range(len(cols)) for side in ("prev", "next")])
    # many columns: one row per cell, so the plan has one column's size however many there are;
    # only the filled cells come back
    d = d.withColumn("__ck", chunk)
    cells = d.select(*[col_of(p) for p in P], "__pos", "__ck",
                     F.posexplode(F.array(*[col_of(c).cast("double") for c in cols])).alias("__f", "__v"))
    cells = chunked_neighbors(cells, [*P, "__f"], ["__pos"], F.col("__ck"), preds={"__kn": F.col("__v").isNotNull()},
                              payload={"pos": x, "v": F.col("__v")}, k_prev=k, k_next=k)
    cells = _fill(cells.where(F.col("__v").isNull()), "__kn", x, F.col("__v"), "v", method, k, "__v")
    filled = cells.groupBy(*[col_of(p) for p in P], "__pos").agg(
        *[F.max(F.when(F.col("__f") == i, F.col("__v"))).alias(f"__v{i}") for i in range(len(cols))])
    d = d.join(filled, [*P, "__pos"], "left")
    keep = [F.coalesce(col_of(c).cast("double"), F.col(f"__v{cols.index(c)}")).alias(c) if c in cols else col_of(c)
            for c in df.columns]
    return d.select(*keep)


def _fill(d: DataFrame, known: str, x: Column, v: Column, field: str, method: str, k: int, out: str) -> DataFrame:
    """``out``: ``v``, where NULL interpolated at ``x`` from the neighbours ``{known}__prev`` / ``__next``."""
    pa, na = f"{known}__prev", f"{known}__next"
    P = [(nth(pa, j, "pos"), nth(pa, j, field)) for j in range(k)]
    N = [(nth(na, j, "pos"), nth(na, j, field)) for j in range(k)]
    has_p, has_n = P[0][0].isNotNull(), N[0][0].isNotNull()
    enough = (F.size(pa) + F.size(na)) >= 2
    if method == "linear":
        est = (F.when(has_p & has_n, _linear(x, P[0], N[0]))
                .when(has_n, _linear(x, N[0], N[1]))
                .otherwise(_linear(x, P[1], P[0])))
    elif method == "nearest":
        est = (F.when(has_p & has_n, F.when((x - P[0][0]) <= (N[0][0] - x), P[0][1]).otherwise(N[0][1]))
                .when(has_n, N[0][1]).otherwise(P[0][1]))
    elif method == "akima":
        d = _akima_columns(d, x, P, N, "__est")
        est = F.col("__est")
    else:
        # segment (A, B, C, D): interior, left end piece, or right end piece
        none = F.lit(None).cast("double")
        inner, left = has_p & has_n, has_n
        for name, (a_in, a_left, a_right) in {
                "a": (P[1], (none, none), P[2]), "b": (P[0], N[0], P[1]),
                "c": (N[0], N[1], P[0]), "d": (N[1], N[2], (none, none))}.items():
            d = d.withColumn(f"__x{name}", F.when(inner, a_in[0]).when(left, a_left[0]).otherwise(a_right[0]))
            d = d.withColumn(f"__y{name}", F.when(inner, a_in[1]).when(left, a_left[1]).otherwise(a_right[1]))
        d = _pchip_columns(d, x, "__est")
        est = F.col("__est")
    return d.withColumn(out, F.when(v.isNotNull() | ~enough, v).otherwise(est)).drop("__est")
