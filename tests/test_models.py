"""Search spaces and stages, model persistence, search, imputation and selection rules."""

import json
import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from fathom import ml
from fathom.operators import lasso, ordered, scale, stats
from fathom.operators.interpolate import INNER_METHODS, METHODS, interpolate
from fathom.plans import models as M
from fathom.plans import workflows as W


def _table(spark, n=400, string_key=False):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 3))
    y = 10 * x[:, 0] - 5 * x[:, 1] + rng.normal(size=n)
    cls = np.digitize(y, [-8, 0, 8])
    rows = [(f"k{i:05d}" if string_key else i, *(None if rng.random() < 0.1 else float(v) for v in x[i]),
             float(y[i]) + 50, None if i % 9 == 0 else int(cls[i])) for i in range(n)]
    return spark.createDataFrame(rows, f"id {'string' if string_key else 'long'}, a double, b double, c double, `PCIAT-PCIAT_Total` double, sii int")


def test_sampled_parameters_reach_the_stage_uncapped(spark):
    assert M.make_estimator("random_forest", {"n_estimators": 1000})[0].getNumTrees() == 1000
    assert M.make_estimator("extra_trees_classifier", {"n_estimators": 500})[0].getNumTrees() == 500
    gbt = M.make_estimator("lightgbm", {"n_estimators": 900, "max_depth": 90, "num_leaves": 100, "bagging_fraction": 0.7,
                                        "min_data_in_leaf": 60, "colsample_bytree": 0.6})[0]
    assert (gbt.getMaxIter(), gbt.getMaxDepth(), gbt.getMinInstancesPerNode(), gbt.getFeatureSubsetStrategy()) == (900, 7, 60, "0.6")
    assert M.make_estimator("ridge", {"alpha": 8.0, "n_rows": 400})[0].getRegParam() == 0.02
    assert M.make_estimator("lasso", {"alpha": 8.0, "n_rows": 400})[0].getRegParam() == 8.0
    clf = M.make_estimator("xgb_classifier", {"n_estimators": 700, "subsample": 0.9})[0].getClassifier()
    assert (clf.getMaxIter(), clf.getSubsamplingRate()) == (700, 0.9)


def test_spaces_have_a_stage_and_draws_stay_in_range(spark):
    for name in set(M.SPACES) - {"voting", "stacking"}:
        for t in range(20):
            p = M.sample_params(M.SPACES[name], random.Random(t))
            for k, v in p.items():
                kind, *spec = M.SPACES[name][k]
                assert v in spec[0] if kind == "cat" else spec[0] <= v <= spec[1]
            done = M.effective(name, p)
            assert set(done["ignored"]) <= set(p) and json.dumps(done)


def test_pipeline_saved_and_loaded_predicts_alike(spark, tmp_path):
    d = _table(spark)
    for imputer, scaler in (("lasso", "power"), ("pchip", "quantile"), ("median", "minmax")):
        r = W.Recipe(["a", "b", "c"], "ridge", {"alpha": 1.0}, imputer, scaler)
        scores, cuts, fitted = W.train_regressor(d, r)
        assert scores.first()["Kappa"] > 0.7
        before, path = ml.as_pipeline(fitted, cuts), f"{tmp_path}/{imputer}"
        before.write().overwrite().save(path)
        a, b = (sorted(map(tuple, ml.predict_classes(p, d).collect())) for p in (before, PipelineModel.load(path)))
        assert a == b and len(a) == 400


def test_kappa_evaluator_and_prepare_stage(spark):
    d = _table(spark)
    model = ml.Prepare(features=["a", "b"], imputer="mean", scaler="standard").fit(d)
    got = model.transform(d).agg(F.avg("a").alias("m"), F.count("a").alias("n")).first()
    assert abs(got.m) < 1e-9 and got.n == 400
    e = ml.KappaEvaluator(labelCol="y", predictionCol="p")
    assert e.evaluate(spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "y int, p int")) == 1.0 and e.isLargerBetter()


def test_search_goes_on_where_it_stopped(spark, tmp_path):
    d, store = _table(spark), f"{tmp_path}/trials"
    first = W.random_search(d, ["a", "b", "c"], "ridge", 1, seed=4, store=store, k=2).collect()
    both = W.random_search(d, ["a", "b", "c"], "ridge", 2, seed=4, store=store, k=2).collect()
    assert [r.trial for r in first] == [0] and sorted(r.trial for r in both) == [0, 1]
    assert [r for r in both if r.trial == 0] == first
    recipe = W.recipe_from_trial(W.best_trial(spark.createDataFrame(both)).first())
    assert recipe.estimator == "ridge" and set(recipe.params) == {"alpha"}
    with pytest.raises(ValueError):
        W.random_search(d, ["a"], "tabnet", 1)


def test_pseudo_labels(spark):
    d = _table(spark)
    r = W.Recipe(["a", "b", "c"], "decision_tree", {"max_depth": 3})
    _, _, fitted = W.train_regressor(d, r, pseudo=True)
    assert W.predict(fitted, d).where("pred IS NULL").count() == 0


def test_predict_returns_the_columns_as_they_came(spark):
    d = _table(spark).withColumn("pred", F.lit("x"))
    for imputer, scaler in (("mean", "standard"), ("linear", "power"), ("median", "quantile")):
        fitted = W.fit(d, W.Recipe(["a", "b", "c"], imputer=imputer, scaler=scaler), "PCIAT-PCIAT_Total")
        got = W.predict(fitted, d)
        assert got.columns == d.columns and dict(got.dtypes)["pred"] == "double"
        assert sorted(map(tuple, got.drop("pred").collect())) == sorted(map(tuple, d.drop("pred").collect()))


def test_votes_are_those_of_the_bases_alone(spark):
    d, bases = _table(spark), ["linear_regression", "decision_tree", "ridge"]
    lab = d.where("sii IS NOT NULL")
    both = W.voting(d, ["a", "b", "c"], bases, [0.5, 0.3, 0.2]).orderBy("id").toPandas()
    votes = []
    for b in bases:
        fitted = W.fit(W._weights(lab, "PCIAT-PCIAT_Total"), W.Recipe(["a", "b", "c"], b), "PCIAT-PCIAT_Total", "w")
        votes.append(W.predict(fitted, lab).orderBy("id").toPandas()["pred"])
        assert np.allclose(both[f"p_{b}"], votes[-1])
    assert np.allclose(both["voted"], 0.5 * votes[0] + 0.3 * votes[1] + 0.2 * votes[2])


def test_pseudo_labelled_rows_are_their_source_rows(spark):
    d = _table(spark)
    source = {r.id: (r.a, r.b, r.c) for r in d.collect()}
    r = W.Recipe(["a", "b", "c"], "random_forest", {"n_estimators": 5, "max_depth": 3})
    fitted = W.fit(W._weights(d.where("sii IS NOT NULL"), "PCIAT-PCIAT_Total"), r, "PCIAT-PCIAT_Total", "w")
    kept = W.pseudo_rows_regressor(d, fitted, r, "sii", "PCIAT-PCIAT_Total").collect()
    n = d.where("sii IS NULL").count()
    assert n / 5 < len(kept) < n / 2                       # the quarter with the least spread
    assert all((x.a, x.b, x.c) == source[x.id] and x.sii is None for x in kept)
    alone = {x.id: x.pred for x in W.predict(fitted, d).collect()}
    assert all(abs(abs(alone[x.id]) - x["PCIAT-PCIAT_Total"]) < 1e-9 for x in kept)
    # a model without a seed does not spread, so all rows stay
    r = W.Recipe(["a", "b", "c"], "ridge", {"alpha": 1.0})
    fitted = W.fit(W._weights(d.where("sii IS NOT NULL"), "PCIAT-PCIAT_Total"), r, "PCIAT-PCIAT_Total", "w")
    lab, base = W._weights(d.where("sii IS NOT NULL"), "PCIAT-PCIAT_Total"), d.where("sii IS NULL")
    for i in (1, 2):
        base = W.predict(W.fit(lab, W._reseeded(r, i), "PCIAT-PCIAT_Total", "w"), base, f"p{i}")
    assert base.where("abs(p1 - p2) > 1e-6").count() == 0
    r = W.Recipe(["a", "b", "c"], "extra_trees_classifier", {"n_estimators": 5, "max_depth": 4})
    fitted = W.fit(W._weights(d.where("sii IS NOT NULL"), "sii"), r, "sii", "w")
    kept = W.pseudo_rows_classifier(d, fitted, "sii", 0.6).collect()
    assert kept and all((x.a, x.b, x.c) == source[x.id] and x.sii in (0, 1, 2, 3) for x in kept)


def test_stacking_predicts_a_test_table(spark):
    d = _table(spark)
    test = d.drop("sii", "PCIAT-PCIAT_Total").where("id % 2 = 0")
    bases = ["linear_regression", "decision_tree"]
    out = W.stacking(d, ["a", "b", "c"], bases, k=2, test=test).orderBy("id").toPandas()
    assert len(out) == 200 and not out.stacked.isna().any()
    for b in bases:
        fitted = W.fit(W._weights(d.where("sii IS NOT NULL"), "PCIAT-PCIAT_Total"), W.Recipe(["a", "b", "c"], b), "PCIAT-PCIAT_Total", "w")
        assert np.allclose(out[f"oof_{b}"], W.predict(fitted, test).orderBy("id").toPandas()["pred"])


def test_interpolation_of_string_keys_and_many_columns(spark):
    d = _table(spark, 120, string_key=True).withColumn("g", F.lit(0))
    for method in METHODS:
        together = interpolate(d, ["a", "b", "c"], method, ["g"], ["id"], F.lit(0)).orderBy("id").toPandas()
        for c in ("a", "b", "c"):
            alone = interpolate(d, [c], method, ["g"], ["id"], F.lit(0)).orderBy("id").toPandas()
            assert np.allclose(together[c], alone[c])
    fill = W._impute_apply(d, W.Recipe(["a", "b", "c"], imputer="linear"), ("interp", "linear"), {"a": 0.0, "b": 0.0, "c": 0.0})
    assert fill.where("a IS NULL OR b IS NULL OR c IS NULL").count() == 0


def test_inner_interpolation_of_many_columns_leaves_the_ends_null(spark):
    d = _table(spark, 120, string_key=True).withColumn("g", F.lit(0))
    for method in INNER_METHODS:
        assert method not in METHODS
        together = interpolate(d, ["a", "b", "c"], method, ["g"], ["id"], F.lit(0)).orderBy("id").toPandas()
        for c in ("a", "b", "c"):
            known = d.orderBy("id").toPandas()[c].notna()
            alone = interpolate(d, [c], method, ["g"], ["id"], F.lit(0)).orderBy("id").toPandas()
            assert np.allclose(together[c], alone[c], equal_nan=True)
            inside = known.cummax() & known[::-1].cummax()[::-1]
            assert (alone[c].notna() == inside).all()


def test_quantiles_of_a_column_with_one_value_on_half_of_the_rows(spark):
    rng = np.random.default_rng(3)
    x = np.where(rng.random(5000) < 0.5, 7.0, rng.normal(size=5000) * 10)
    y = np.arange(5000) % 3
    d = spark.createDataFrame([(float(a), float(b), None) for a, b in zip(x, y)], "x double, y double, z double").repartition(4)
    probs = [0.0, 0.1, 0.25, 0.5, 0.731, 1.0]
    got = ordered.exact_quantiles(d, ["x", "y", "z"], probs, rows_per_chunk=300)
    assert np.allclose(got["x"], np.quantile(x, probs)) and np.allclose(got["y"], np.quantile(y, probs))
    assert got["z"] == [None] * len(probs)


def test_lasso_from_moments_is_the_lasso_of_the_rows():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 5)) + 100
    y = x @ [1, 0, -2, 0, 0.5] + rng.normal(size=800)
    z = np.concatenate([np.ones((800, 1)), x - x.mean(0), (y - y.mean())[:, None]], axis=1)
    fold = np.arange(800) % 4
    moments = np.array([z[fold == f].T @ z[fold == f] for f in range(4)])
    intercept, w, alpha = lasso.fit_lasso_cv(moments, 5, list(range(5)), n_alphas=30)
    residual = z[:, 6] - intercept - z[:, 1:6] @ w
    slope = z[:, 1:6].T @ residual / 800               # optimality: |slope| <= alpha, equal where w is not 0
    assert (np.abs(slope) <= alpha * 1.001).all() and np.allclose(slope[w != 0], alpha * np.sign(w[w != 0]), atol=1e-4)
    assert np.allclose(w, [1, 0, -2, 0, 0.5], atol=0.1)


def test_step_up_rule_passes_over_a_failure_in_the_middle(spark):
    p = [0.001, 0.04, 0.011, 0.9, None]
    d = spark.createDataFrame([(f"f{i}", v) for i, v in enumerate(p)], "feature string, p_value double")
    got = {r.feature: r.relevant for r in stats.fdr_select(d, 0.1, independent=True).collect()}
    assert got == {"f0": True, "f1": True, "f2": True, "f3": False, "f4": False}
    hard = spark.createDataFrame([("a", 0.03), ("b", 0.035), ("c", 0.04)], "feature string, p_value double")
    assert all(r.relevant for r in stats.fdr_select(hard, 0.05, independent=True).collect())


def test_power_fit_leaves_the_first_grid(spark):
    rng = np.random.default_rng(1)
    x = np.exp(rng.normal(size=2000) * 0.05) ** 40
    lam = scale.fit_yeo_johnson(spark.createDataFrame([(float(v),) for v in x], "x double"), ["x"])["x"]

    def likelihood(t):
        z = ((x + 1) ** t - 1) / t if abs(t) > 1e-12 else np.log1p(x)
        return -len(x) / 2 * np.log(z.var()) + (t - 1) * np.log1p(x).sum()

    grid = np.arange(-6, 8, 0.001)
    assert abs(lam - grid[np.argmax([likelihood(t) for t in grid])]) < 0.002


def test_labels_are_checked_before_they_are_collected(spark):
    from fathom.operators import evaluate
    with pytest.raises(ValueError):
        evaluate.quadratic_weighted_kappa(spark.range(3000).selectExpr("id AS y", "id AS p"), "y", "p")


def test_selection_uses_ks_for_two_values_and_projects_both_tables(spark, tmp_path):
    rng = np.random.default_rng(7)
    n = 600
    cls = rng.integers(0, 4, n)
    rows = [(i, float(c + rng.normal()), float(rng.normal()), float(c > 1), float(rng.random() < 0.5), None if i % 7 == 0 else int(c), "k")
            for i, c in enumerate(cls)]
    d = spark.createDataFrame(rows, "id long, good double, noise double, flag double, coin double, sii int, other string").repartition(3)
    feats = ["good", "noise", "flag", "coin"]
    assert stats.binary_features(d, feats) == ["flag", "coin"]
    p = {r.feature: r.p_value for r in stats.relevance(d, "sii", feats).collect()}
    tau = {r.feature: r.p_value for r in stats.kendall_tau(d, "sii", ["good", "noise"]).collect()}
    ks = {r.feature: r.p_value for r in stats.ks_binary(d, "sii", ["flag", "coin"]).collect()}
    assert p == tau | ks
    train, test = W.select_and_project(d, d.drop("sii"), feats, f"{tmp_path}/lists", corr_threshold=0.2)
    assert train.columns == ["id", "good", "flag", "sii", "other"] and test.columns == ["id", "good", "flag", "other"]
    from fathom.sources import sinks
    assert sinks.read_feature_list(spark, f"{tmp_path}/lists/correlation") == ["good", "flag"]
    assert set(sinks.read_feature_list(spark, f"{tmp_path}/lists/univariate")) >= {"good", "flag"}
