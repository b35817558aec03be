"""Brute-force checks of the custom distributed algorithms on small frames."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom.operators import evaluate, interpolate, ordered, stats
from fathom.functions.exprs import clip_keep_null, ordinal_round, rowwise_mean
from fathom.operators.encode import bin_index, equal_width_bin


def _skewed(spark, n=3000, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k = 0 if rng.random() < 0.5 else rng.randint(1, 20)   # one hot key holds half the rows
        v = None if rng.random() < 0.2 else rng.randint(-5, 5) * 1.0
        rows.append((k, i, v, rng.random() < 0.6))
    return spark.createDataFrame(rows, "k int, o long, v double, m boolean")


def test_chunked_row_number_equals_row_number(spark):
    df = _skewed(spark)
    got = ordered.chunked_row_number(df, ["k"], ["o"], F.floor(F.col("o") / 97), out="rn")
    ref = df.withColumn("rn2", F.row_number().over(Window.partitionBy("k").orderBy("o")))
    j = got.join(ref.select("k", "o", "rn2"), ["k", "o"])
    assert j.filter(F.col("rn") != F.col("rn2")).count() == 0
    assert j.count() == df.count()


def test_chunked_neighbors_equal_masked_lag(spark):
    df = _skewed(spark)
    got = ordered.chunked_neighbors(df, ["k"], ["o"], F.floor(F.col("o") / 61), preds={"m": F.col("m")},
                                    payload={"v": F.col("v"), "o": F.col("o")}, k_prev=2, k_next=2)
    pdf = df.toPandas().sort_values(["k", "o"])
    exp = {}
    for k, g in pdf.groupby("k"):
        masked = g[g.m]
        for _, r in g.iterrows():
            before = masked[masked.o < r.o].o.tolist()[::-1][:2]
            after = masked[masked.o > r.o].o.tolist()[:2]
            exp[(k, r.o)] = (before, after)
    for r in got.select("k", "o", "m__prev", "m__next").collect():
        assert [x.o for x in r.m__prev] == exp[(r.k, r.o)][0]
        assert [x.o for x in r.m__next] == exp[(r.k, r.o)][1]


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=2001), 2)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = ordered.exact_quantiles(df, ["x"], probs, rows_per_chunk=400)["x"]
    assert np.allclose(got, np.percentile(x, [p * 100 for p in probs]), atol=1e-12)


def test_kappa_closed_form_equals_confusion_matrix(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 4, 500)
    p = np.clip(y + rng.integers(-1, 2, 500), 0, 3)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(y, p)], "y int, p int")
    got = evaluate.quadratic_weighted_kappa(df, "y", "p").first()[0]
    K = 4
    O = np.zeros((K, K))
    for a, b in zip(y, p):
        O[a, b] += 1
    W = np.array([[(i - j) ** 2 for j in range(K)] for i in range(K)]) / (K - 1) ** 2
    E = np.outer(O.sum(1), O.sum(0)) / O.sum()
    assert math.isclose(got, 1 - (W * O).sum() / (W * E).sum(), rel_tol=1e-12)


def test_kappa_identity_is_one(spark):
    df = spark.createDataFrame([(i % 4, i % 4) for i in range(40)], "y int, p int")
    assert evaluate.quadratic_weighted_kappa(df, "y", "p").first()[0] == pytest.approx(1.0)


def test_kendall_tau_b_equals_pairwise_count(spark):
    rng = np.random.default_rng(2)
    n = 300
    y = rng.integers(0, 4, n).astype(float)
    x = np.round(y + rng.normal(size=n), 1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = stats.kendall_tau(df, "y", ["x"], rows_per_chunk=200).first()
    s = 0.0
    for i in range(n):
        s += np.sum(np.sign(x[i] - x[i + 1:]) * np.sign(y[i] - y[i + 1:]))
    n0 = n * (n - 1) / 2
    _, cx = np.unique(x, return_counts=True)
    _, cy = np.unique(y, return_counts=True)
    tau = s / math.sqrt((n0 - (cx * (cx - 1) / 2).sum()) * (n0 - (cy * (cy - 1) / 2).sum()))
    assert got.tau == pytest.approx(tau, abs=1e-12)
    assert 0.0 <= got.p_value <= 1.0


def test_corr_constant_column_is_null(spark):
    df = spark.createDataFrame([(float(i), 1.0, float(i % 3)) for i in range(20)], "x double, c double, y double")
    imp = {r.feature: r.importance for r in stats.corr_importance(df, "y", ["x", "c"]).collect()}
    assert imp["c"] is None and imp["x"] is not None


def test_linear_interpolation_matches_numpy(spark):
    vals = [None, 1.0, None, None, 4.0, 2.0, None, None, None, 10.0, None]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(vals)], "g int, o int, v double")
    out = interpolate.interpolate(df, ["v"], "linear", ["g"], ["o"], F.floor(F.col("o") / 3))
    got = [r.v for r in out.orderBy("o").collect()]
    xs = [i for i, v in enumerate(vals) if v is not None]
    ys = [v for v in vals if v is not None]
    exp = list(np.interp(range(len(vals)), xs, ys))
    exp[0] = ys[0] + (ys[1] - ys[0]) / (xs[1] - xs[0]) * (0 - xs[0])          # extrapolation
    exp[-1] = ys[-2] + (ys[-1] - ys[-2]) / (xs[-1] - xs[-2]) * (len(vals) - 1 - xs[-2])
    assert np.allclose(got, exp)


def test_interpolation_leaves_short_series(spark):
    df = spark.createDataFrame([(0, 0, None), (0, 1, 3.0), (0, 2, None)], "g int, o int, v double")
    out = interpolate.interpolate(df, ["v"], "pchip", ["g"], ["o"], F.lit(0))
    assert [r.v for r in out.orderBy("o").collect()] == [None, 3.0, None]


def test_bins_right_closed_and_lowest_included(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 1.0, 1.5, 2.0, 3.0, 3.5, None]], "x double")
    edges = F.array(*[F.lit(v) for v in [0.0, 1.0, 2.0, 3.0]])
    got = [r.b for r in df.select(bin_index(F.col("x"), edges).alias("b")).collect()]
    assert got == [0.0, 0.0, 1.0, 1.0, 2.0, None, None]


def test_equal_width_bins_on_integers(spark):
    df = spark.createDataFrame([(float(v),) for v in range(0, 51)], "x double")
    got = [r.b for r in df.select(equal_width_bin(F.col("x"), F.lit(0.0), F.lit(50.0), 10).alias("b")).collect()]
    exp = [0] + [min(9, math.ceil(v / 5) - 1) for v in range(1, 51)]
    assert got == exp


def test_scalar_traps(spark):
    df = spark.createDataFrame([(None, None), (70.0, 1.0), (2.0, None)], "x double, y double")
    r = df.select(clip_keep_null("x", 9, 60).alias("c"), rowwise_mean(["x", "y"]).alias("m"),
                  ordinal_round("x", [0.5, 1.5, 2.5]).alias("o")).collect()
    assert [x.c for x in r] == [None, 60.0, 9.0]
    assert [x.m for x in r] == [None, 35.5, 2.0]
    assert [x.o for x in r] == [None, 3, 2]


def test_tune_cuts_beats_initial_cuts(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 4, 400)
    pred = y * 0.7 + rng.normal(scale=0.4, size=400)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, pred)], "y double, pred double")
    best = evaluate.tune_cuts(df, "y", "pred", n_candidates=24).first()
    base = evaluate.quadratic_weighted_kappa(df.withColumn("p", ordinal_round("pred", [0.5, 1.5, 2.5])), "y", "p")
    assert best.cut_1 < best.cut_2 < best.cut_3
    assert best.Kappa >= base.first()[0] - 1e-12


def _akima(xs, ys, x):
    """By the textbook, with the secants written out."""
    n = len(xs)
    m = [(b - a) / (d - c) for a, b, c, d in zip(ys, ys[1:], xs, xs[1:])]
    m = [m[0]] * 2 + m + [m[0]] * 2 if n == 2 else [3 * m[0] - 2 * m[1], 2 * m[0] - m[1], *m, 2 * m[-1] - m[-2], 3 * m[-1] - 2 * m[-2]]
    i = next(j for j in range(n - 1) if xs[j] <= x <= xs[j + 1])

    def slope(j):
        a, b, c, d = m[j:j + 4]
        w, v = abs(d - c), abs(b - a)
        return (w * b + v * c) / (w + v) if w + v > 1e-9 * (abs(a) + abs(b) + abs(c) + abs(d)) else (a + d) / 2

    h, t, s, p, q = xs[i + 1] - xs[i], x - xs[i], m[i + 2], slope(i), slope(i + 1)
    return ys[i] + p * t + (3 * s - 2 * p - q) / h * t ** 2 + (p + q - 2 * s) / h ** 2 * t ** 3


def test_akima_against_its_definition_and_without_extrapolation(spark):
    import numpy as np
    from fathom.operators.interpolate import interpolate
    rng = np.random.default_rng(8)
    rows = []
    for g, n in enumerate((60, 60, 5, 4, 3, 30)):
        v = [None if rng.random() < 0.5 else float(rng.normal()) for _ in range(n)]
        if g == 2:
            v = [None, 1.0, None, 3.0, None]                 # two points: a line
        elif g == 3:
            v = [None, 1.0, None, None]                      # one: unchanged
        elif g == 5:
            v = [None if i % 3 else float(i) for i in range(n)]     # no turn anywhere
        rows += [(g, i, x) for i, x in enumerate(v)]
    d = spark.createDataFrame(rows, "g int, i int, v double").repartition(4)
    got = {(r.g, r.i): r.v for r in interpolate(d, ["v"], "akima", ["g"], ["i"], F.floor(F.col("i") / 7)).collect()}
    for g in range(6):
        known = [(i + 1, x) for h, i, x in rows if h == g and x is not None]
        for h, i, x in rows:
            if h != g:
                continue
            if x is not None or len(known) < 2 or not known[0][0] <= i + 1 <= known[-1][0]:
                assert got[g, i] == x
            else:
                assert abs(got[g, i] - _akima([k for k, _ in known], [v for _, v in known], i + 1)) < 1e-9
