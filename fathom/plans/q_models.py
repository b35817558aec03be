"""Bindings for model-based operators (rows-only checks: their results depend
on iterative fits that SQL cannot express). Inputs: the participant fixture
(labelled rows for training, unlabelled ones as the pseudo-label pool),
``embeddings`` for PCA, ``events`` for the series embedding."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from fathom import constants as K
from fathom.functions.exprs import ordinal_round
from fathom.operators import clean, stats
from fathom.operators.series import describe_series
from fathom import ml
from fathom.plans import workflows as W
from fathom.plans.estimators import KnnRegressor
from fathom.plans.fixtures import participants, participants_cte, q
from fathom.plans.q_prep import _knn_mean_sql
from fathom.plans.q_series import events_prepared
from fathom.plans.registry import ORACLE, query
from fathom.plans.tables import rnd, round_doubles, table
from fathom.session import shared_folder, stored
from fathom.sources import readers, sinks
from fathom.sources.materialize import materialize

FEATS = ["Physical-BMI", "Physical-HeartRate", "BIA-BIA_Fat", "BIA-BIA_FFMI", "BIA-BIA_ICW", "FGC-FGC_CU",
         "FGC-FGC_SRR", "PAQ_A-PAQ_A_Total", "Basic_Demos-Age", "BIA-BIA_BMC"]


def _data(spark, sf_dir):
    p = participants(spark, sf_dir)
    return p.select("id", *[F.col(f"`{c}`") for c in FEATS], F.col(K.SII), F.col(f"`{K.PCIAT_TOTAL}`"))


@query("preprocess_chain")
def q_preprocess_chain(spark, sf_dir):
    p = participants(spark, sf_dir)
    tr, te = p.filter(F.col("split") == "train"), p.filter(F.col("split") == "test")
    a, b = W.preprocess(tr, te, K.BINNED_COLUMNS, K.SEASON_COLUMNS)
    return a.unionByName(b, allowMissingColumns=True)


@query("feature_select_chain")
def q_feature_select_chain(spark, sf_dir):
    d = _data(spark, sf_dir)
    kept = W.select_features(d, FEATS, corr_threshold=0.01)
    return spark.createDataFrame([(i, f) for i, f in enumerate(kept)], "pos int, feature string") \
        if kept else spark.createDataFrame([], "pos int, feature string")


@query("train_ordinal")
def q_train_ordinal(spark, sf_dir):
    scores, cuts, _ = W.train_regressor(_data(spark, sf_dir), W.Recipe(FEATS, "linear_regression"))
    return scores.withColumn("cuts", F.array(*[F.lit(float(c)) for c in cuts]))


@query("train_ordinal_pseudo")
def q_train_ordinal_pseudo(spark, sf_dir):
    """Scores of a seeded model on the labelled rows before (split ``train``) and after (split ``refit``) the
    pseudo-labelled refit, under the same cut points; a row's seed decides which unlabelled rows are kept."""
    r = W.Recipe(FEATS, "random_forest", {"n_estimators": 10, "max_depth": 5})
    with stored(_data(spark, sf_dir)) as d:               # seven fits and their scores read it
        scores, cuts, refitted = W.train_regressor(d, r, pseudo=True, kept=True)
        after = W.predict(refitted, clean.keep_labelled(d, K.SII)).withColumn("pc", ordinal_round("pred", cuts))
        again = W._collected(W._scores(after, K.SII, "pc", estimator=r.estimator, split="refit"))
    return scores.unionByName(again).withColumn("cuts", F.array(*[F.lit(float(c)) for c in cuts]))


@query("train_classifier")
def q_train_classifier(spark, sf_dir):
    r = W.Recipe(FEATS, "extra_trees_classifier", {"n_estimators": 20, "max_depth": 6})
    scores, _, _ = W.train_classifier(_data(spark, sf_dir), r)
    return scores


@query("cv_ordinal")
def q_cv_ordinal(spark, sf_dir):
    return W.cross_validate(_data(spark, sf_dir), W.Recipe(FEATS, "linear_regression"), "regressor", parallelism=2)


@query("cv_classifier")
def q_cv_classifier(spark, sf_dir):
    r = W.Recipe(FEATS, "extra_trees_classifier", {"n_estimators": 10, "max_depth": 5})
    return W.cross_validate(_data(spark, sf_dir), r, "classifier", parallelism=2)


@query("rfe_log")
def q_rfe_log(spark, sf_dir):
    log, sel = W.rfe_cv(_data(spark, sf_dir), W.Recipe(FEATS, "linear_regression"), step=K.RFE_STEP)
    n_sel = sel.count()   # selected feature list: schema-sized
    return log.withColumn("chosen", F.col("n_features") == F.lit(n_sel))


@query("hpo_log")
def q_hpo_log(spark, sf_dir):
    trials = W.random_search(_data(spark, sf_dir), FEATS, "ridge", n_trials=2, seed=57)
    return trials


@query("hpo_best")
def q_hpo_best(spark, sf_dir):
    return W.best_trial(W.random_search(_data(spark, sf_dir), FEATS, "elastic_net", n_trials=2, seed=6))


@query("stacking")
def q_stacking(spark, sf_dir):
    out = W.stacking(_data(spark, sf_dir), FEATS, ["linear_regression", "decision_tree"], "linear_regression")
    return round_doubles(out.select("id", "oof_linear_regression", "oof_decision_tree", "stacked"))


@query("voting_models")
def q_voting_models(spark, sf_dir):
    out = W.voting(_data(spark, sf_dir), FEATS, ["linear_regression", "decision_tree"], [0.7, 0.3])
    return round_doubles(out.select("id", "voted"))


@query("impute_model")
def q_impute_model(spark, sf_dir):
    d = _data(spark, sf_dir)
    cols = ["Physical-BMI", "FGC-FGC_SRR", "BIA-BIA_Fat", "BIA-BIA_FFMI", "Physical-HeartRate"]
    tr, te = d.filter(F.col("id") % 2 == 0), d.filter(F.col("id") % 2 == 1)
    a, b = W.impute_with_model(tr, te, cols)
    return round_doubles(a.unionByName(b).select("id", *[F.col(f"`{c}`") for c in cols]))


KNN_FEATS = ["Physical-HeartRate", "BIA-BIA_Fat", "FGC-FGC_CU", "Basic_Demos-Age"]
KNN = 25


def _knn_regressor_sql():
    names = ", ".join(f"{q(c)} AS c{i}" for i, c in enumerate(KNN_FEATS))
    cols = ", ".join(f"c{i}" for i in range(len(KNN_FEATS)))
    total = " + ".join(f"(x.c{i} - d.c{i}) * (x.c{i} - d.c{i})" for i in range(len(KNN_FEATS)))
    same = " AND ".join(f"x.c{i} = r.c{i}" for i in range(len(KNN_FEATS)))
    n = len(KNN_FEATS)
    return (f"WITH {participants_cte()}, r AS (SELECT id, split, {q(K.PCIAT_TOTAL)} AS y, {names} FROM participants), "
            f"x AS (SELECT row_number() OVER (ORDER BY {cols}) AS key, * FROM (SELECT DISTINCT {cols} FROM r WHERE split = 'test')), "
            f"d AS (SELECT {cols}, y, least(count(*), {KNN}) AS w FROM r WHERE split = 'train' AND y IS NOT NULL GROUP BY ALL), "
            f"best AS (SELECT key, unnest(min({{'d2': d2, 'v': y, 'w': w}}, {KNN})) AS s FROM (SELECT key, ({total}) * {n} / {n} AS d2, y, w FROM x, d) GROUP BY key), "
            f"{_knn_mean_sql(KNN)}\nSELECT r.id, {rnd('uniform')} AS uniform, {rnd('distance')} AS distance FROM r JOIN x ON {same} JOIN filled USING (key) WHERE split = 'test'")


@query("knn_regressor", _knn_regressor_sql())
def q_knn_regressor(spark, sf_dir):
    """Scores of the test rows by the nearest labelled train rows, both weightings, through the fitted stage."""
    p = participants(spark, sf_dir).select("id", "split", *[F.col(f"`{c}`") for c in KNN_FEATS], F.col(f"`{K.PCIAT_TOTAL}`").alias("label"))
    rows = VectorAssembler(inputCols=KNN_FEATS, outputCol="features").transform(p).select("id", "split", "features", "label")
    train, out = rows.where("split = 'train' AND label IS NOT NULL"), rows.where("split = 'test'").select("id", "features")
    for weights in ("uniform", "distance"):
        out = KnnRegressor(nNeighbors=KNN, weights=weights, predictionCol=weights).fit(train).transform(out)
    return round_doubles(out.drop("features"))


@query("pca_embed")
def q_pca_embed(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    cols = [f"e{i}" for i in range(64)]
    wide = emb.select(F.col("vec_id").alias("id"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    tr, te = wide.filter(F.col("id") % 2 == 0), wide.filter(F.col("id") % 2 == 1)
    a, b = W.pca_embed(tr, te, cols, 15)
    return round_doubles(a.unionByName(b))


@query("series_pca_join")
def q_series_pca_join(spark, sf_dir):
    desc = describe_series(events_prepared(spark, sf_dir), "user_id", ["value", "k"])
    stat_cols = [c for c in desc.columns if c.startswith("Stat_")]
    desc = desc.withColumnRenamed("user_id", "id")
    tr, te = desc.filter(F.col("id") % 2 == 0), desc.filter(F.col("id") % 2 == 1)
    a, b = W.pca_embed(tr, te, stat_cols, 5)
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    return round_doubles(cust.join(a.unionByName(b), "id", "left"))


@query("materialize", ORACLE.get("series_describe"))
def q_materialize(spark, sf_dir):
    """Keyed materialisation of the series summary under the shared checkpoint
    folder; a second call with the same inputs reads the stored table."""
    ev = events_prepared(spark, sf_dir)
    base = shared_folder(spark)
    import hashlib
    tag = hashlib.md5(sf_dir.rstrip("/").encode()).hexdigest()[:12]   # stable across processes
    path = f"{base}/fathom-materialized/series_describe_{tag}"
    params = {"op": "describe_series", "columns": ["value", "k"], "key": "user_id"}
    out = materialize(spark, path, params, ev, lambda: describe_series(ev, "user_id", ["value", "k"]))
    return round_doubles(out)


def _folder(spark, sf_dir, name):
    """A folder of its own for every call, under the shared one."""
    import uuid
    return f"{shared_folder(spark)}/fathom-{name}-{uuid.uuid4().hex}"


_LABELLED = f"WITH {participants_cte()} SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_changed, " \
            f"count(*) AS n_predicted FROM participants WHERE {q(K.SII)} IS NOT NULL"


@query("model_roundtrip", _LABELLED)
def q_model_roundtrip(spark, sf_dir):
    """A trained pipeline (imputer, scaler, model, cuts) saved and loaded predicts as before."""
    d = clean.keep_labelled(_data(spark, sf_dir), K.SII)
    _, cuts, fitted = W.train_regressor(d, W.Recipe(FEATS, "decision_tree", {"max_depth": 4}, "median", "robust"))
    before = ml.as_pipeline(fitted, cuts)
    path = _folder(spark, sf_dir, "model")
    sinks.save_model(before, path)
    after = sinks.load_model(path)
    both = ml.predict_classes(before, d).withColumnRenamed(K.SII, "a").join(ml.predict_classes(after, d), "id")
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.sum((~F.col("a").eqNullSafe(F.col(K.SII))).cast("long")).alias("n_changed"),
                    F.count(F.when(F.col(K.SII).between(0, 3), 1)).alias("n_predicted"))


@query("search_submission", f"WITH {participants_cte()} SELECT count(*) AS n_rows, count(*) AS n_predicted, CAST(1 AS BIGINT) AS n_scores "
       "FROM participants WHERE split = 'test'")
def q_search_submission(spark, sf_dir):
    """Search, refit, scores, model, features and submission written and read back."""
    p = participants(spark, sf_dir)
    p = p.select("id", "split", *[F.col(f"`{c}`") for c in FEATS], F.col(K.SII), F.col(f"`{K.PCIAT_TOTAL}`"))
    root = _folder(spark, sf_dir, "search")
    submission, _ = ml.search_and_submit(p.where("split = 'train'").drop("split"), p.where("split = 'test'").drop("split"), FEATS,
                                         "ridge", n_trials=2, root=root, k=2, seed=57)
    scores = spark.read.parquet(f"{root}/scores/train").count()
    return submission.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col(K.SII).between(0, 3), 1)).alias("n_predicted"),
                          F.lit(scores).cast("long").alias("n_scores"))


@query("csv_pair", "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'train' ELSE 'test' END AS split, c_custkey AS id, c_name, c_nationkey, c_acctbal, "
       "CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def q_csv_pair(spark, sf_dir):
    """Header CSVs of a train and a test table, written and scanned back with their schema."""
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), "c_name", "c_nationkey", "c_acctbal",
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    root = _folder(spark, sf_dir, "csv")
    sinks.save_csv(c.where("id % 2 = 0"), f"{root}/train.csv")
    sinks.save_csv(c.where("id % 2 = 1"), f"{root}/test.csv")
    return readers.with_split(*readers.read_tabular_pair(spark, root, schema=c.schema))


@query("series_scan", "SELECT CAST(user_id AS VARCHAR) AS id, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event "
       "FROM events GROUP BY 1")
def q_series_scan(spark, sf_dir):
    """Key-partitioned series folders, written and scanned back with the key as a string."""
    root = _folder(spark, sf_dir, "series")
    sinks.save_series(table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", "value"), root)
    s = readers.read_series(spark, root, file_name="part-*.parquet")
    return s.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


LIST_THRESHOLD = 0.05


def _feature_list_sql():
    score = q(K.PCIAT_TOTAL)

    def r(c):
        x, y = (f"CASE WHEN {q(c)} IS NOT NULL AND {score} IS NOT NULL THEN {v} END" for v in (q(c), score))
        return f"abs(covar_samp({x}, {y}) / NULLIF(stddev_samp({x}) * stddev_samp({y}), 0))"

    kept = " UNION ALL ".join(f"SELECT {i} AS n, '{c}' AS feature, {r(c)} AS importance FROM lab" for i, c in enumerate(FEATS))
    counts = " UNION ALL ".join(f"SELECT split, '{c}' AS feature, count({q(c)}) AS n_present, min({q(c)}) AS least FROM participants GROUP BY split" for c in FEATS)
    return (f"WITH {participants_cte()}, lab AS (SELECT * FROM participants WHERE split = 'train' AND {q(K.SII)} IS NOT NULL), "
            f"corr AS ({kept}), list AS (SELECT CAST(row_number() OVER (ORDER BY n) - 1 AS INTEGER) AS pos, feature FROM corr WHERE importance >= {LIST_THRESHOLD}), "
            f"counts AS ({counts}) SELECT split, pos, feature, n_present, {rnd('least')} AS least FROM list JOIN counts USING (feature)")


@query("feature_list", _feature_list_sql())
def q_feature_list(spark, sf_dir):
    """The features that correlate with the score on the train rows: the list written, read back, and both splits
    projected on it."""
    path = _folder(spark, sf_dir, "features")
    p = participants(spark, sf_dir).select("id", "split", *[F.col(f"`{c}`") for c in FEATS], F.col(K.SII), F.col(f"`{K.PCIAT_TOTAL}`"))
    importance = stats.corr_importance(clean.keep_labelled(p.where("split = 'train'"), K.SII), K.PCIAT_TOTAL, FEATS)
    kept = {r.feature for r in clean.filter_features(importance, LIST_THRESHOLD).collect()}       # a row per column
    sinks.save_feature_list(spark, [f for f in FEATS if f in kept], path)
    names = sinks.read_feature_list(spark, path)
    cells = F.posexplode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("v")) for c in names])).alias("pos", "s")
    return round_doubles(p.select("split", *[F.col(f"`{c}`") for c in names]).select("split", cells).groupBy("split", "pos", "s.feature").agg(
        F.count("s.v").alias("n_present"), F.min("s.v").alias("least")))
