"""Ranges instead of bounds: quantiles per key, codes, row numbers and tau when one key or value holds half of the rows."""

import numpy as np
from pyspark.sql import functions as F

from fathom.operators import encode, ordered, stats
from fathom.operators.series import describe_series


def test_by_range_chunks_do_not_fall(spark):
    d = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), "id")
    laid = ordered.by_range(d, ["v"], rows_per_chunk=300)
    got = laid.groupBy("__range").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n")).orderBy("__range").collect()
    assert len(got) > 10 and all(a.hi < b.lo for a, b in zip(got, got[1:])) and sum(r.n for r in got) == 5000
    assert ordered.by_range(d, ["v"]).select("__range").distinct().collect()[0][0] == 0


def _series(n=6000, seed=1):
    rng = np.random.default_rng(seed)
    rows = [("hot", float(v), float(i % 3), None) for i, v in enumerate(rng.normal(size=n // 2))]     # half of the rows, none alike
    rows += [(f"k{i % 40}", None if i % 11 == 0 else float(round(v, 1)), None if i % 40 == 3 else float(i), None) for i, v in enumerate(rng.normal(size=n // 2))]
    rows += [(None, 5.0, 1.0, None), ("one", 2.5, None, None), ("none", None, None, None)]
    return rows


def test_quantiles_per_key_with_a_hot_key(spark):
    rows = _series()
    d = spark.createDataFrame(rows, "k string, a double, b double, c double").repartition(6)
    probs = [0.0, 0.25, 0.5, 0.731, 1.0]
    for per_chunk in (100, 10 ** 6):
        got = {(r.k, r.f): (r.n, r.q) for r in ordered.key_quantiles(d, ["k"], ["a", "b", "c"], probs, per_chunk).collect()}
        want = {}
        for key in {r[0] for r in rows} - {None}:
            for f in (0, 1, 2):
                v = [r[1 + f] for r in rows if r[0] == key and r[1 + f] is not None]
                if v:
                    want[key, f] = len(v), np.quantile(v, probs)
        assert {k: g[0] for k, g in got.items() if k[0] is not None} == {k: w[0] for k, w in want.items()}
        assert all(np.allclose(got[k][1], w[1]) for k, w in want.items())


def test_describe_series_with_a_hot_series(spark):
    rows = _series()
    d = spark.createDataFrame(rows, "k string, a double, b double, c double").repartition(6)
    got = {r.k: r for r in describe_series(d, "k", ["a", "b"], rows_per_chunk=200).collect()}
    assert len(got) == len({r[0] for r in rows})
    for key in ("hot", "k5", "one", "none"):
        for i, f in enumerate(("a", "b")):
            v = np.array([r[1 + i] for r in rows if r[0] == key and r[1 + i] is not None])
            have = [got[key][f"Stat_{2 * s + i}"] for s in range(8)]
            assert have[0] == len(v)
            if len(v):
                want = [v.mean(), v.std(ddof=1) if len(v) > 1 else None, v.min(), *np.quantile(v, [0.25, 0.5, 0.75]), v.max()]
                assert all(b is None and a is None or np.isclose(a, b) for a, b in zip(have[1:], want))
            else:
                assert have[1:] == [None] * 7


def test_codes_of_columns_with_many_values(spark):
    d = spark.range(4000).select("id", F.when(F.col("id") % 10 > 0, F.concat(F.lit("v"), F.col("id") * 7919 % 3000)).alias("s"), (F.col("id") % 3).cast("string").alias("t"))
    tables = encode.code_tables(d, ["s", "t"], rows_per_chunk=250)
    values = sorted({r.s for r in d.collect()} - {None})
    assert {r.value: r.code for r in tables["s"].collect()} == {v: i for i, v in enumerate([*values, None])}
    assert {r.value: r.code for r in tables["t"].collect()} == {"0": 0, "1": 1, "2": 2}
    first = encode.code_tables(d, ["s", "t"], "first_seen", F.col("id"), rows_per_chunk=250)
    seen = list(dict.fromkeys(r.s for r in d.orderBy("id").collect()))
    assert {r.value: r.code for r in first["s"].collect()} == {v: i for i, v in enumerate(seen)}
    plan = encode.code_tables(d, ["s"], rows_per_chunk=250)["s"]._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_quantiles_and_tau_do_not_depend_on_the_ranges(spark):
    rng = np.random.default_rng(3)
    x = np.where(rng.random(3000) < 0.5, 7.0, rng.normal(size=3000) * 10)
    d = spark.createDataFrame([(float(a), float(i % 7), int((a > 0) + (a > 7))) for i, a in enumerate(x)], "x double, z double, y int").repartition(4)
    assert np.allclose(ordered.exact_quantiles(d, ["x", "z"], [0.1, 0.5, 0.9], 200)["x"], np.quantile(x, [0.1, 0.5, 0.9]))
    a, b = (sorted(map(tuple, stats.kendall_tau(d, "y", ["x", "z"], rows_per_chunk=n).collect())) for n in (150, 10 ** 6))
    assert [r[0] for r in a] == [r[0] for r in b] and all(np.allclose(p[1:], q[1:]) for p, q in zip(a, b))
