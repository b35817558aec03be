"""How often, and over which rows, the steps of training, search and coding go: each case is checked against plain results too."""

import numpy as np
from pyspark.sql import functions as F

from fathom import constants as K
from fathom.functions.exprs import ordinal_round
from fathom.operators import encode, evaluate, folds, ordered
from fathom.plans import q_models as Q
from fathom.plans import workflows as W
from fathom.session import stored


def _rows(spark, n=400):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=n), rng.normal(size=n)
    score = 20 + 5 * a + 2 * b
    return spark.createDataFrame([(i, float(x), None if i % 9 == 0 else float(y), None if i % 5 == 0 else float(min(3, max(0, s // 10))),
                                   None if i % 5 == 0 else float(s)) for i, (x, y, s) in enumerate(zip(a, b, score))],
                                 f"id long, a double, b double, {K.SII} double, `{K.PCIAT_TOTAL}` double").repartition(3)


def test_quantiles_sort_only_the_buckets_that_hold_a_rank(spark, monkeypatch):
    def whole(*_, **__):
        raise AssertionError("the whole column is laid out")
    monkeypatch.setattr(ordered, "by_range", whole)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=3000), np.full(2000, 0.25), [-0.0, 0.0, np.inf, -np.inf]])
    z = [None if i % 3 else float(v) for i, v in enumerate(x)]
    d = spark.createDataFrame([(float(v), w, None) for v, w in zip(x, z)], "x double, z double, none double").repartition(5)
    probs = [0.01, 0.1, 0.25, 0.333, 0.5, 0.9, 0.999]
    got = ordered.exact_quantiles(d, ["x", "z", "none"], probs, rows_per_chunk=300)
    assert np.allclose(got["x"], np.quantile(x, probs))
    assert np.allclose(got["z"], np.quantile([v for v in z if v is not None], probs))
    assert got["none"] == [None] * len(probs)
    one = spark.range(2000).select(F.lit(7.5).alias("c"))
    assert ordered.exact_quantiles(one, ["c"], [0.0, 0.5, 1.0], 100)["c"] == [7.5] * 3


def test_cuts_by_binary_search_are_those_of_a_scan(spark):
    rng = np.random.default_rng(5)
    p = [*rng.normal(size=300).round(1).tolist(), float("nan"), float("inf"), float("-inf"), -0.0, 0.0]
    d = spark.createDataFrame([(float(i % 4), v) for i, v in enumerate(p)], "y double, pred double")
    for cands in ([-0.5, 0.0, 0.4, 0.9], [0.1, float("inf"), float("inf")], [-1.0, 0.0, 0.0, 0.7]):
        got = evaluate.tune_cuts(d, "y", "pred", candidates=cands).first()
        arr = F.array(*map(F.lit, cands))
        cells = d.groupBy("y", F.size(F.filter(arr, lambda t: t <= F.col("pred"))).alias("i")).count().collect()
        assert got == evaluate._search(spark, [(r["y"], r["i"], r["count"]) for r in cells], cands, 3).first()


def test_scores_read_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    base = spark.createDataFrame([(float(i % 4), float((i * 7 + i // 5) % 4)) for i in range(200)] + [(None, 1.0), (2.0, None)], "y double, p double").repartition(2)
    row = evaluate.evaluate(base.select("y", counted("p").alias("p")), "y", "p", 9).first()
    assert seen.value == 202
    y, p = (np.array(v) for v in zip(*[(r.y, r.p) for r in base.dropna().collect()]))
    assert np.isclose(row[K.RMSE], np.sqrt(((y - p) ** 2).mean())) and np.isclose(row[K.MAE], np.abs(y - p).mean())
    assert np.isclose(row[K.R2], 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    expected = ((y[:, None] - p[None, :]) ** 2).mean() * len(y)
    assert np.isclose(row[K.KAPPA], 1 - ((y - p) ** 2).sum() / expected)
    cls = base.select(ordinal_round("y", [2.5, 0.5]).alias("c"), "y").collect()
    assert all(r.c == (None if r.y is None else (r.y >= 0.5) + (r.y >= 2.5)) for r in cls)


def test_codes_of_few_values_do_not_shuffle_the_rows(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = spark.range(60).select("id", F.when(F.col("id") % 4 > 0, F.concat(F.lit("s"), (F.col("id") % 4).cast("string"))).alias("s"))
        a, _ = encode.shared_codes(d.where("id < 30"), d.where("id >= 30"), ["s"])
        assert "BroadcastHashJoin" in a._jdf.queryExecution().toString()
        assert {r.id: r.s for r in a.collect()} == {i: (i % 4 - 1) % 4 for i in range(30)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_refits_share_the_preparation_and_trials_their_folds(spark, monkeypatch):
    d, calls = _rows(spark), {"prepared": 0, "folded": 0}
    fit, fold = W.fit_preparation, folds.stratified_folds

    def prepared(*a, **k):
        calls["prepared"] += 1
        return fit(*a, **k)

    def folded(*a, **k):
        calls["folded"] += 1
        return fold(*a, **k)

    r = W.Recipe(["a", "b"], "decision_tree", {"max_depth": 3})
    fm = W.fit(W._weights(d.dropna(subset=[K.SII]), K.PCIAT_TOTAL), r, K.PCIAT_TOTAL, "w")
    monkeypatch.setattr(W, "fit_preparation", prepared)
    assert W.pseudo_rows_regressor(d, fm, r, K.SII, K.PCIAT_TOTAL, runs=3).count() == 80
    assert calls["prepared"] == 1
    monkeypatch.setattr(folds, "stratified_folds", folded)
    assert W.random_search(d, ["a", "b"], "ridge", n_trials=2, seed=57, k=2).count() == 2
    assert calls["folded"] == 1


def test_stacked_rows_are_scored_and_joined_once(spark):
    out = W.stacking(_rows(spark), ["a", "b"], ["linear_regression"], k=2)
    assert "Join" not in out._jdf.queryExecution().toString()
    assert out.count() == 320 and out.where("stacked IS NULL").count() == 0


def test_pseudo_labelled_training_prepares_rows_once_for_all_refits(spark, monkeypatch, tmp_path):
    _rows(spark).coalesce(1).write.parquet(f"{tmp_path}/rows")
    d, calls, prepare = spark.read.parquet(f"{tmp_path}/rows"), [], W.prepare       # one file: a row's draws follow its partition
    monkeypatch.setattr(W, "prepare", lambda *a: calls.append(1) or prepare(*a))
    seeds, reseeded = [], W._reseeded
    monkeypatch.setattr(W, "_reseeded", lambda r, seed: seeds.append(seed) or reseeded(r, seed))
    r = W.Recipe(["a", "b"], "random_forest", {"n_estimators": 3, "max_depth": 3})
    scores, cuts, refitted = W.train_regressor(d, r, pseudo=True)
    assert len(calls) == 3 and seeds == [0, 1, 2, 3, 4]      # labelled rows, unlabelled rows, their union
    plain, own, fm = W.train_regressor(d, r)
    assert scores.collect() == plain.collect() and cuts == own
    kept = W.pseudo_rows_regressor(d, fm, r, K.SII, K.PCIAT_TOTAL)
    lab = W._needed(d.where(f"{K.SII} IS NOT NULL"), r, K.SII, K.PCIAT_TOTAL)
    again = W.fit(lab.unionByName(kept, allowMissingColumns=True), r, K.PCIAT_TOTAL)
    x, y = ([p.pred for p in W.predict(m, d).orderBy("id").collect()] for m in (again, refitted))
    assert np.allclose(x, y)


def test_models_that_share_a_preparation_predict_as_alone(spark):
    d = _rows(spark).withColumn("q", F.lit("x"))
    r = W.Recipe(["a", "b"], "decision_tree", {"max_depth": 3})
    lab = W._weights(d.where(f"{K.SII} IS NOT NULL"), K.PCIAT_TOTAL)
    one = W.fit(lab, r, K.PCIAT_TOTAL, "w")
    two = W.fit(lab, W.Recipe(["a", "b"], "ridge", {"alpha": 1.0}), K.PCIAT_TOTAL, "w", preparation=(one.fill, one.scaling))
    other = W.fit(lab, W.Recipe(["a", "b"], "linear_regression", {}, "median", "minmax"), K.PCIAT_TOTAL, "w")
    got = W.predict_each({"p": one, "q": two, "o": other}, d)
    assert set(got.columns) == {*d.columns, "p", "o"} and len(got.columns) == len(d.columns) + 2
    alone = W.predict(other, W.predict(two, W.predict(one, d, "p"), "q"), "o")
    assert got.select(alone.columns).orderBy("id").collect() == alone.orderBy("id").collect()


def test_the_input_of_a_pseudo_labelled_training_is_read_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    d = _rows(spark)
    monkeypatch.setattr(Q, "FEATS", ["a", "b"])
    monkeypatch.setattr(Q, "_data", lambda *_: d.withColumn("a", counted("a")))
    got = {r.split: r for r in Q.q_train_ordinal_pseudo(spark, "").collect()}
    assert set(got) == {"train", "refit"} and all(r.Kappa > 0.8 for r in got.values())
    assert seen.value == 400


def test_stored_rows_are_dealt_by_rows_and_go_with_the_block(spark):
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    first = stored(spark.range(1000).repartition(2), 100)
    a = first.__enter__()
    second = stored(a.where("id < 500"), 100)
    b = second.__enter__()
    assert a.rdd.getNumPartitions() >= 10 and a.count() == 1000 and b.count() == 500
    first.__exit__(None, None, None)                         # blocks end in any order
    assert spark.conf.get("spark.sql.files.openCostInBytes") != before and b.count() == 500
    path = b.inputFiles()[0]
    second.__exit__(None, None, None)
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder.getParent())
