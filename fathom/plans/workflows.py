"""Training workflows composed from the operators and ``pyspark.ml`` stages.

Every step is a Spark job over the whole labelled table; the driver only
loops over folds, trials and elimination steps (counts fixed by parameters)
and holds fitted parameters (means, cut points, model coefficients).
"""

from __future__ import annotations

import json
import random
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack
from dataclasses import dataclass, field
from functools import reduce
from typing import Any, Sequence

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.errors import AnalysisException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom import constants as K
from fathom.functions.exprs import col_of, ordinal_round
from fathom.operators import clean, combine, encode, evaluate, folds, lasso, scale, stats
from fathom.operators.interpolate import interpolate
from fathom.operators.neighbours import impute_knn
from fathom.operators.ordered import by_range, exact_quantiles
from fathom.plans.models import FEATURES, IMPUTER_SPACE, LABEL, PRED, REGISTRY, SCALER_SPACE, SPACES, WEIGHT, \
    effective, importance_vector, make_estimator, sample_params
from fathom.session import cut_lineage, shared_folder, stored


# ------------------------------------------------------------------ preprocessing
@dataclass
class Recipe:
    """Imputer -> scaler -> estimator over a feature list."""
    features: list[str]
    estimator: str = "linear_regression"
    params: dict = field(default_factory=dict)
    imputer: str = "mean"
    scaler: str = "standard"
    key: str = K.ID


@dataclass
class Fitted:
    recipe: Recipe
    fill: dict
    scaling: Any
    model: Any
    kind: str


#: Cut candidates of every cut-point search (training, CV, elimination).
N_CANDIDATES = 64
ROWS_PER_CHUNK = 1_000_000


def _impute_fit(train: DataFrame, r: Recipe):
    if r.imputer in ("mean", "median", "most_frequent"):
        return ("simple", scale.fit_impute(train, r.features, r.imputer))
    if r.imputer.startswith("knn:"):                  # knn:<neighbours>:<weights>; the rows themselves are what is learnt
        _, k, weights = r.imputer.split(":")
        path = f"{shared_folder(train.sparkSession)}/fathom-donors-{uuid.uuid4().hex}"
        train.select(*[col_of(c).cast("double").alias(c) for c in r.features]).write.parquet(path)
        return ("knn", {"path": path, "k": int(k), "weights": weights})
    if r.imputer == "lasso":
        return ("lasso", fit_model_imputer(train, r.features, na_frac=0.4))
    return ("interp", r.imputer)


def _impute_apply(df: DataFrame, r: Recipe, fit, means: dict) -> DataFrame:
    kind, p = fit
    if kind == "simple":
        d = stats.fill_with(df, p)
    elif kind == "knn":
        d = impute_knn(df, df.sparkSession.read.parquet(p["path"]), r.features, p["k"], p["weights"])
    elif kind == "lasso":
        d = apply_model_imputer(df, p)
    else:
        # interpolate down the rows in key order (one global series, in ranges of the key)
        laid = by_range(df.withColumn("__one", F.lit(0)), [col_of(r.key).asc_nulls_first()], ROWS_PER_CHUNK)
        d = interpolate(laid, r.features, p, ["__one"], [col_of(r.key)], F.col("__range")).drop("__one", "__range")
    return stats.fill_with(d, means)     # anything still missing: train mean


def _scale_fit(train: DataFrame, r: Recipe):
    if r.scaler in ("standard", "minmax", "maxabs", "robust"):
        f = {"standard": scale.fit_standard, "minmax": scale.fit_minmax, "maxabs": scale.fit_maxabs,
             "robust": scale.fit_robust}[r.scaler]
        return ("affine", f(train, r.features))
    if r.scaler == "quantile":
        return ("quantile", scale.fit_quantile_transform(train, r.features))
    if r.scaler == "power":
        lams = scale.fit_yeo_johnson(train, r.features)
        t = train.select(*[scale.yeo_johnson(col_of(c).cast("double"), lams[c]).alias(c) for c in r.features])
        return ("power", (lams, scale.fit_standard(t, r.features)))
    raise ValueError(r.scaler)


def _scale_apply(df: DataFrame, r: Recipe, fit) -> DataFrame:
    kind, p = fit
    if kind == "affine":
        return scale._apply(df, p)
    if kind == "quantile":
        return scale.apply_quantile_transform(df, [c for c in r.features], p)
    lams, std = p
    t = df.select(*[scale.yeo_johnson(col_of(c).cast("double"), lams[c]).alias(c) if c in r.features else col_of(c)
                    for c in df.columns])
    return scale._apply(t, std)


def fit_preparation(train: DataFrame, r: Recipe) -> tuple[dict, Any]:
    """Fitted imputer and scaler (numbers only). Where the imputed frame feeds several passes of the scaler, it is
    persisted meanwhile (recomputed from lineage if an executor is lost)."""
    means = stats.column_means(train, r.features)
    fill = {"imp": ("simple", dict(means)) if r.imputer == "mean" else _impute_fit(train, r), "means": means}
    filled = _impute_apply(train, r, fill["imp"], means).select(*[col_of(c) for c in r.features])
    if fill["imp"][0] == "simple" and r.scaler in ("standard", "minmax", "maxabs"):      # one pass
        return fill, _scale_fit(filled, r)
    filled = filled.persist()
    try:
        return fill, _scale_fit(filled, r)
    finally:
        filled.unpersist()


def apply_preparation(df: DataFrame, r: Recipe, fill: dict, scaling) -> DataFrame:
    return _scale_apply(_impute_apply(df, r, fill["imp"], fill["means"]), r, scaling)


def prepare(df: DataFrame, r: Recipe, fill: dict, scaling) -> DataFrame:
    return VectorAssembler(inputCols=r.features, outputCol=FEATURES, handleInvalid="keep").transform(
        apply_preparation(df, r, fill, scaling))


#: Estimators that read their rows once (normal equations), and those that keep a copy of their own (binned rows of trees).
_ONE_PASS = ("linear_regression", "ridge", "lasso", "elastic_net")
_OWN_COPY = ("decision_tree", "random_forest", "extra_trees_classifier")


def _needed(df: DataFrame, r: Recipe, *more: str) -> DataFrame:
    """The columns of ``df`` that a fit by ``r`` and its scores read."""
    return df.select(*[col_of(c) for c in df.columns if c in (r.key, *r.features, *more)])


#: The class of a prepared row.
_CLASS = "__class"


def _prepared(train: DataFrame, r: Recipe, label: str, weight: str | None, preparation: tuple[dict, Any],
              cls: str | None = None) -> DataFrame:
    """What a fit by ``r`` reads: prepared features, label and weight; with ``cls`` the class as well."""
    d = prepare(train, r, *preparation).withColumn(LABEL, col_of(label).cast("double"))
    d = d.withColumn(WEIGHT, col_of(weight).cast("double") if weight else F.lit(1.0))
    return d.select(FEATURES, LABEL, WEIGHT, *([col_of(cls).alias(_CLASS)] if cls else []))


def fit(train: DataFrame, r: Recipe, label: str, weight: str | None = None, cached: bool = False,
        preparation: tuple[dict, Any] | None = None, prepared: DataFrame | None = None) -> Fitted:
    """Fit imputer, scaler and estimator on ``train``. The prepared frame is persisted for the duration of the fit where it
    feeds many passes; not where the estimator reads it once, or keeps a copy of its own and ``train`` is ``cached``.
    ``preparation``: the fitted imputer and scaler, if they are known; ``prepared``: the rows of :func:`_prepared` by them,
    if they are stored."""
    fill, scaling = preparation or fit_preparation(train, r)
    d = prepared.select(FEATURES, LABEL, WEIGHT) if prepared is not None else _prepared(train, r, label, weight, (fill, scaling))
    once = (prepared is not None or fill["imp"][0] == "simple") and (
        r.estimator in _ONE_PASS or (cached or prepared is not None) and r.estimator in _OWN_COPY)
    d = d if once else d.persist()
    try:
        params = {**r.params, "n_rows": (train if once and prepared is None else d).count()} if r.estimator == "ridge" else r.params
        est, kind = make_estimator(r.estimator, params, n_features=len(r.features))
        model = est.fit(d)
    finally:
        if not once:
            d.unpersist()
    return Fitted(r, fill, scaling, model, kind)


def predict(fm: Fitted, df: DataFrame, out: str = "pred") -> DataFrame:
    """``df`` as it came, with the prediction ``out`` (and ``probs`` of a model that gives probabilities). The
    features are imputed and scaled in place, so their own values are carried along under private names."""
    own = {c: f"__own_{i}" for i, c in enumerate(df.columns) if c in fm.recipe.features}
    p = fm.model.transform(prepare(df.withColumns({name: col_of(c) for c, name in own.items()}), fm.recipe, fm.fill, fm.scaling))
    made = {out} | ({"probs"} if "probability" in p.columns else set())
    cols = [col_of(own.get(c, c)).alias(c) for c in df.columns if c not in made] + [F.col(PRED).cast("double").alias(out)]
    if "probs" in made:
        cols.append(vector_to_array("probability").alias("probs"))
    return p.select(*cols)


def predict_each(fitted: dict[str, Fitted], df: DataFrame) -> DataFrame:
    """``df`` as it came, with the prediction of every regressor under its name. Models that share a fitted preparation
    score rows that are prepared once."""
    sharing: dict[tuple[int, int], dict[str, Fitted]] = {}
    for name, fm in fitted.items():
        sharing.setdefault((id(fm.fill), id(fm.scaling)), {})[name] = fm
    for some in sharing.values():
        fm = next(iter(some.values()))
        own = {c: f"__own_{i}" for i, c in enumerate(df.columns) if c not in some}
        d = prepare(df.withColumns({o: col_of(c) for c, o in own.items()}), fm.recipe, fm.fill, fm.scaling).select(*own.values(), FEATURES)
        for name, one in some.items():
            d = one.model.transform(d).select(*d.columns, F.col(PRED).cast("double").alias(name))
        df = d.select(*[F.col(o).alias(c) for c, o in own.items()], *some)
    return df


# ------------------------------------------------------------------ training
def _weights(df: DataFrame, target: str) -> DataFrame:
    return encode.inverse_frequency_weights(df, target, out="w").drop("target_bin")


def _scores(pred: DataFrame, y: str, p: str, **tags) -> DataFrame:
    s = evaluate.evaluate(pred, y, p)
    for k, v in tags.items():
        s = s.withColumn(k, F.lit(v))
    return s


def _ordinal(pred: DataFrame, cls: str, n_candidates: int) -> list[float]:
    row = evaluate.tune_cuts(pred, cls, "pred", n_candidates=n_candidates).first()
    return [row[f"cut_{i}"] for i in (1, 2, 3)]


def train_regressor(df: DataFrame, r: Recipe, cls: str = K.SII, score: str = K.PCIAT_TOTAL,
                    pseudo: bool = False, n_candidates: int = N_CANDIDATES, kept: bool = False):
    """Fit the score with inverse-frequency weights, tune cut points on the training predictions and
    evaluate the rounded classes; with ``pseudo`` the model is refitted after that on the pseudo-labelled
    union. ``kept``: the rows of ``df`` are stored, and read again rather than persisted.
    Returns (scores, cuts, model)."""
    rows = _needed(clean.keep_labelled(df, cls), r, cls, score)
    with ExitStack() as done:
        if not kept:
            rows = rows.persist()
            done.callback(rows.unpersist)
        lab = _weights(rows, score)
        preparation = prepared = None
        if pseudo:                                        # the refits read the same prepared rows
            preparation = fit_preparation(lab, r)
            prepared = done.enter_context(stored(_prepared(lab, r, score, "w", preparation, cls), ROWS_PER_CHUNK))
        fm = fit(lab, r, score, "w", cached=True, preparation=preparation, prepared=prepared)
        pred = predict(fm, lab).select(col_of(cls), "pred") if prepared is None else \
            fm.model.transform(prepared.select(_CLASS, FEATURES)).select(F.col(_CLASS).alias(cls), F.col(PRED).cast("double").alias("pred"))
        pred = pred.persist()
        try:
            cuts = _ordinal(pred, cls, n_candidates)
            scores = _collected(_scores(pred.withColumn("pc", ordinal_round("pred", cuts)), cls, "pc",
                                        estimator=r.estimator, split="train"))
        finally:
            pred.unpersist()
        if pseudo:
            fm = pseudo_label_regressor(df, fm, r, cls, score, labelled=rows, preparation=preparation, prepared=prepared)
    return scores, cuts, fm


def _collected(scores: DataFrame) -> DataFrame:
    """A score table (one row per split) as data, so the frames behind it can be released."""
    return scores.sparkSession.createDataFrame(scores.collect(), scores.schema)


def train_classifier(df: DataFrame, r: Recipe, cls: str = K.SII, pseudo: bool = False):
    rows = _needed(clean.keep_labelled(df, cls), r, cls).persist()
    try:
        lab = _weights(rows, cls)
        fm = fit(lab, r, cls, "w", cached=True)
        scores = _collected(_scores(predict(fm, lab), cls, "pred", estimator=r.estimator, split="train"))
        if pseudo:
            fm = pseudo_label_classifier(df, fm, r, cls)
    finally:
        rows.unpersist()
    return scores, None, fm


def _reseeded(r: Recipe, seed: int) -> Recipe:
    return Recipe(r.features, r.estimator, {**r.params, "seed": seed}, r.imputer, r.scaler, r.key)


def pseudo_rows_regressor(df: DataFrame, fm: Fitted, r: Recipe, cls: str, score: str, runs: int = K.PSEUDO_REFITS,
                          q: float = K.PSEUDO_STD_QUANTILE, labelled: DataFrame | None = None,
                          preparation: tuple[dict, Any] | None = None, prepared: DataFrame | None = None) -> DataFrame | None:
    """The unlabelled rows on which ``runs`` refits (same rows, other seeds) spread within the ``q`` quantile of the
    spread, as they came, with the absolute prediction of ``fm`` as their score. None without unlabelled rows.
    ``preparation`` and ``prepared``: of the weighted labelled rows, if they are known; no seed enters them."""
    cols = [f"p{i}" for i in range(1, runs + 1)]
    with ExitStack() as done:
        if prepared is None:
            lab = labelled
            if lab is None:
                lab = _needed(clean.keep_labelled(df, cls), r, cls, score).persist()
                done.callback(lab.unpersist)
            weighted = _weights(lab, score)
            preparation = fit_preparation(weighted, r)
            prepared = done.enter_context(stored(_prepared(weighted, r, score, "w", preparation), ROWS_PER_CHUNK))
        refits = {c: fit(prepared, _reseeded(r, i), score, "w", preparation=preparation, prepared=prepared)
                  for i, c in enumerate(cols)}
        # every pass over it would score all models again
        base = cut_lineage(predict_each({"p0": fm, **refits}, clean.keep_unlabelled(df, cls)))
    cut = exact_quantiles(base.select(combine.prediction_spread(cols).alias("s")), ["s"], [q])["s"][0]
    if cut is None:
        return None
    return combine.confident_by_spread(base, cols, "p0", cut, label=score).drop("p0", *cols, "spread")


def pseudo_label_regressor(df: DataFrame, fm: Fitted, r: Recipe, cls: str, score: str,
                           runs: int = K.PSEUDO_REFITS, q: float = K.PSEUDO_STD_QUANTILE,
                           labelled: DataFrame | None = None, preparation: tuple[dict, Any] | None = None,
                           prepared: DataFrame | None = None) -> Fitted:
    """A refit (unweighted) on the labelled rows and the rows of :func:`pseudo_rows_regressor`."""
    lab = labelled if labelled is not None else clean.keep_labelled(df, cls)
    conf = pseudo_rows_regressor(df, fm, r, cls, score, runs, q, lab, preparation, prepared)
    return fm if conf is None else fit(lab.unionByName(conf, allowMissingColumns=True), r, score, cached=labelled is not None)


def pseudo_rows_classifier(df: DataFrame, fm: Fitted, cls: str, threshold: float = K.PSEUDO_CONFIDENCE) -> DataFrame:
    """The unlabelled rows, as they came, whose most likely class reaches ``threshold``; that class is their label.
    Raises for a model that gives no probabilities."""
    p = predict(fm, clean.keep_unlabelled(df, cls).drop(cls))
    if "probs" not in p.columns:
        raise ValueError(f"{fm.recipe.estimator} gives no class probabilities to pseudo-label by")
    conf = combine.confident_by_probability(p, "probs", threshold, label=cls).drop("probs", "max_prob", "pred")
    return conf.withColumn(cls, F.col(cls).cast("double"))


def pseudo_label_classifier(df: DataFrame, fm: Fitted, r: Recipe, cls: str, threshold: float = K.PSEUDO_CONFIDENCE,
                            labelled: DataFrame | None = None) -> Fitted:
    """A weighted refit on the labelled rows and the rows of :func:`pseudo_rows_classifier`."""
    lab = labelled if labelled is not None else clean.keep_labelled(df, cls)
    conf = pseudo_rows_classifier(df, fm, cls, threshold)
    return fit(_weights(lab.unionByName(conf, allowMissingColumns=True), cls), r, cls, "w")


def _folded(df: DataFrame, r: Recipe, k: int, seed: int, cls: str, score: str) -> DataFrame:
    """The labelled rows with the columns that fits by ``r`` read and their folds, persisted."""
    return folds.stratified_folds(_needed(clean.keep_labelled(df, cls), r, cls, score), cls, r.key, k, seed).persist()


def cross_validate(df: DataFrame, r: Recipe, kind: str = "regressor", k: int = K.N_FOLDS, seed: int = 0,
                   cls: str = K.SII, score: str = K.PCIAT_TOTAL, parallelism: int = 1,
                   n_candidates: int = N_CANDIDATES, pseudo: bool = False, folded: DataFrame | None = None) -> DataFrame:
    """Stratified k-fold CV; regressors tune cut points on the training folds and apply them to
    the validation fold. With ``pseudo`` each fold's model is refitted with pseudo labels before it
    predicts. One score row per (fold, split). ``folded``: the labelled rows with their folds, persisted by the caller."""
    lab = folded if folded is not None else _folded(df, r, k, seed, cls, score)

    def one(f: int) -> DataFrame:
        tr, va = lab.filter(F.col(K.FOLD) != f), lab.filter(F.col(K.FOLD) == f)
        if kind == "regressor":
            fm = fit(_weights(tr, score), r, score, "w", cached=True)
            if pseudo:
                fm = pseudo_label_regressor(df, fm, r, cls, score, labelled=tr)
            pt = predict(fm, tr).select(col_of(cls), "pred").persist()
            try:
                cuts = _ordinal(pt, cls, n_candidates)
                a = _scores(pt.withColumn("pc", ordinal_round("pred", cuts)), cls, "pc", fold=f, split="train")
                b = _scores(predict(fm, va).withColumn("pc", ordinal_round("pred", cuts)), cls, "pc", fold=f, split="val")
                return _collected(a.unionByName(b))
            finally:
                pt.unpersist()
        fm = fit(_weights(tr, cls), r, cls, "w", cached=True)
        if pseudo:
            fm = pseudo_label_classifier(df, fm, r, cls, labelled=tr)
        a = _scores(predict(fm, tr), cls, "pred", fold=f, split="train")
        b = _scores(predict(fm, va), cls, "pred", fold=f, split="val")
        return _collected(a.unionByName(b))

    try:
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
            parts = list(ex.map(one, range(k)))
    finally:
        if folded is None:
            lab.unpersist()
    return reduce(lambda a, b: a.unionByName(b), parts).withColumn(K.ESTIMATOR, F.lit(r.estimator))


def mean_scores(cv: DataFrame, split: str = "val") -> DataFrame:
    return cv.filter(F.col("split") == split).groupBy(K.ESTIMATOR).agg(
        *[F.avg(c).alias(c) for c in (K.KAPPA, K.RMSE, K.MAE, K.R2)])


# ------------------------------------------------------------------ search
def _imputer_of(p: dict) -> str:
    return {"SimpleImputer": p["imputer_strategy"], "InterpolationTransformer": p["interpolation_method"],
            "KNNImputer": f"knn:{p.get('imputer_neighbors')}:{p.get('imputer_weights')}", "LassoImputer": "lasso"}[p["imputer"]]


_PREPARATION = ("imputer", "imputer_neighbors", "imputer_weights", "imputer_strategy", "interpolation_method", "scaler")
_TRIAL_SCHEMA = "trial int, estimator string, params string, value double, features array<string>"


def _stored_trials(spark: SparkSession, store: str | None, estimator: str) -> DataFrame | None:
    """Trials of the estimator in the store; None where there is no store yet."""
    if store is None:
        return None
    try:
        return spark.read.schema(_TRIAL_SCHEMA).parquet(store).where(F.col(K.ESTIMATOR) == estimator)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def random_search(df: DataFrame, features: Sequence[str], estimator: str, n_trials: int, seed: int = 0,
                  store: str | None = None, k: int = K.N_FOLDS, rfe: bool = False, parallelism: int = 1) -> DataFrame:
    """Seeded random search over the declared space (imputer, scaler and model parameters). Each trial is
    a Spark CV and is appended to ``store`` as soon as it ends, so an interrupted search goes on where
    it stopped. With ``rfe`` every trial first eliminates features with its own parameters, and its row keeps
    them. Returns the trial table ``trial, estimator, params, value, features``; ``params`` also holds the
    values the stage really uses and the sampled ones it has no counterpart for."""
    spark = df.sparkSession
    if estimator not in REGISTRY:
        raise ValueError(f"no estimator {estimator!r} to search")
    kind = REGISTRY[estimator][1]
    stored = _stored_trials(spark, store, estimator)
    done = {r.trial for r in stored.select("trial").collect()} if stored is not None else set()
    rows, folded = [], None
    for t in range(n_trials):
        if t in done:
            continue
        p = sample_params({**IMPUTER_SPACE, **SCALER_SPACE, **SPACES[estimator]}, random.Random(f"{seed}:{estimator}:{t}"))
        own = {n: v for n, v in p.items() if n not in _PREPARATION}
        r = Recipe(list(features), estimator, own, _imputer_of(p), p["scaler"])
        if folded is None:                                    # the folds of all trials
            folded = _folded(df, r, k, seed, K.SII, K.PCIAT_TOTAL)
        if rfe:
            _, selected = rfe_cv(df, r, k=k, seed=seed)
            r.features = [x.feature for x in selected.orderBy("pos").collect()]
        value = mean_scores(cross_validate(df, r, kind, k=k, seed=seed, parallelism=parallelism, folded=folded)).first()[K.KAPPA]
        row = (t, estimator, json.dumps({**p, **effective(estimator, own)}, sort_keys=True, default=str), value, r.features)
        rows.append(row)
        if store:
            spark.createDataFrame([row], _TRIAL_SCHEMA).coalesce(1).write.mode("append").parquet(store)
    if folded is not None:
        folded.unpersist()
    stored = _stored_trials(spark, store, estimator)
    return stored if stored is not None else spark.createDataFrame(rows, _TRIAL_SCHEMA)


def best_trial(trials: DataFrame) -> DataFrame:
    return trials.orderBy(F.col("value").desc_nulls_last(), F.col("trial")).limit(1)


def recipe_from_trial(row, key: str = K.ID) -> Recipe:
    """Rebuild the typed recipe from a stored trial row."""
    p = json.loads(row["params"])
    own = {n: v for n, v in p.items() if n not in (*_PREPARATION, "effective", "ignored")}
    return Recipe(list(row["features"]), row["estimator"], own, _imputer_of(p), p["scaler"], key)


# ------------------------------------------------------------------ recursive feature elimination
def rfe_cv(df: DataFrame, r: Recipe, step: int = K.RFE_STEP, k: int = K.N_FOLDS, seed: int = 0,
           cls: str = K.SII, score: str = K.PCIAT_TOTAL, min_features: int = 1):
    """Recursive elimination with k-fold CV scored by kappa of the rounded
    score prediction (cut points tuned on the training fold). Per fold: fit,
    score, drop the ``step`` least important features, repeat. The feature
    count with the best mean score (ties -> fewer features) is then selected by
    elimination on all rows. Returns (log table, selected feature table)."""
    spark = df.sparkSession
    lab = _folded(df, r, k, seed, cls, score)
    log = []

    def eliminate(train: DataFrame, val: DataFrame | None, fold: int, stop_at: int):
        feats = list(r.features)
        while True:
            if val is None and len(feats) <= max(min_features, stop_at):
                return feats
            rr = Recipe(feats, r.estimator, r.params, r.imputer, r.scaler, r.key)
            fm = fit(_weights(train, score), rr, score, "w", cached=True)
            if val is not None:
                pt = predict(fm, train).select(col_of(cls), "pred").persist()
                try:
                    cuts = _ordinal(pt, cls, N_CANDIDATES)
                finally:
                    pt.unpersist()
                pv = predict(fm, val).withColumn("pc", ordinal_round("pred", cuts))
                kap = evaluate.quadratic_weighted_kappa(pv, cls, "pc").first()[K.KAPPA]
                log.append((fold, len(feats), float(kap) if kap is not None else None))
            if len(feats) <= max(min_features, stop_at):
                return feats
            imp = importance_vector(fm.model)
            n_drop = min(step, len(feats) - max(min_features, stop_at))
            order = sorted(range(len(feats)), key=lambda i: (imp[i], feats[i]))
            drop = {feats[i] for i in order[:n_drop]}
            feats = [f for f in feats if f not in drop]

    for f in range(k):
        eliminate(lab.filter(F.col(K.FOLD) != f), lab.filter(F.col(K.FOLD) == f), f, min_features)
    log_df = spark.createDataFrame(log, "fold int, n_features int, score double")
    means = log_df.groupBy("n_features").agg(F.avg("score").alias("mean_score")).collect()
    best_n = sorted(means, key=lambda m: (-(m.mean_score if m.mean_score is not None else -1e300), m.n_features))[0].n_features
    selected = eliminate(lab, None, -1, best_n)
    lab.unpersist()
    sel_df = spark.createDataFrame([(i, f) for i, f in enumerate(selected)], "pos int, feature string")
    return log_df, sel_df


# ------------------------------------------------------------------ stacking / voting
def stacking(df: DataFrame, features: Sequence[str], bases: Sequence[str], final: str = "linear_regression",
             k: int = K.N_FOLDS, seed: int = 0, cls: str = K.SII, score: str = K.PCIAT_TOTAL,
             test: DataFrame | None = None) -> DataFrame:
    """Out-of-fold predictions of each base are the features of a final regressor; then the bases are
    refitted on all labelled rows. Returns the rows of ``test`` (default: the labelled rows) with
    ``oof_<base>`` and ``stacked``: for ``test`` the base columns come from the refitted bases, for the
    labelled rows they are the out-of-fold predictions."""
    lab = _folded(df, Recipe(list(features)), k, seed, cls, score)
    try:
        oof, refitted = None, []
        for b in bases:
            recipe = Recipe(list(features), b)
            parts = []
            for f in range(k):
                tr, va = lab.filter(F.col(K.FOLD) != f), lab.filter(F.col(K.FOLD) == f)
                parts.append(predict(fit(_weights(tr, score), recipe, score, "w", cached=True), va, f"oof_{b}").select(K.ID, f"oof_{b}"))
            pb = reduce(lambda a, c: a.unionByName(c), parts)
            oof = pb if oof is None else oof.join(pb, K.ID)
            if test is not None:
                refitted.append((b, fit(_weights(lab, score), recipe, score, "w", cached=True)))
        table = cut_lineage(lab.select(K.ID, cls, score).join(oof, K.ID))      # every pass over it would score and join again
        fm = fit(_weights(table, score), Recipe([f"oof_{b}" for b in bases], final, scaler="standard"), score, "w", cached=True)
    finally:
        lab.unpersist()
    if test is None:
        return predict(fm, table, "stacked")
    for b, model in refitted:
        test = predict(model, test, f"oof_{b}")
    return predict(fm, test, "stacked")


def voting(df: DataFrame, features: Sequence[str], bases: Sequence[str], weights: Sequence[float],
           score: str = K.PCIAT_TOTAL, cls: str = K.SII, test: DataFrame | None = None) -> DataFrame:
    """Weighted mean of the bases fitted on the labelled rows, for ``test`` (default: those rows)."""
    lab = clean.keep_labelled(df, cls)
    out = lab if test is None else test
    cols = []
    for b in bases:
        fm = fit(_weights(lab, score), Recipe(list(features), b), score, "w")
        out = predict(fm, out, f"p_{b}")
        cols.append(f"p_{b}")
    return combine.weighted_vote(out, cols, weights, out="voted")


# ------------------------------------------------------------------ PCA
def pca_embed(train: DataFrame, test: DataFrame, columns: Sequence[str], k: int, key: str = K.ID,
              prefix: str = "PC_") -> tuple[DataFrame, DataFrame]:
    """Standard-scale on train (population std), fill with the train mean (0
    after scaling), fit PCA on train, project both. Component signs are fixed
    so that each component's largest-magnitude loading is positive."""
    std = scale.fit_standard(train, columns)
    zeros = {c: 0.0 for c in columns}
    prep = lambda d: VectorAssembler(inputCols=list(columns), outputCol="__v").transform(
        stats.fill_with(scale._apply(d.select(key, *[col_of(c) for c in columns]), std), zeros))
    model = PCA(k=k, inputCol="__v", outputCol="__pc").fit(prep(train))
    pc = model.pc.toArray()
    signs = []
    for j in range(pc.shape[1]):
        col = pc[:, j]
        signs.append(-1.0 if col[abs(col).argmax()] < 0 else 1.0)

    def project(d):
        p = model.transform(prep(d)).select(key, vector_to_array("__pc").alias("__a"))
        return p.select(key, *[(F.col("__a")[j] * F.lit(signs[j])).alias(f"{prefix}{j + 1}") for j in range(k)])

    return project(train), project(test)


# ------------------------------------------------------------------ model-based imputation
def fit_model_imputer(train: DataFrame, columns: Sequence[str], na_frac: float = 0.5, min_samples: int = 0,
                      k: int = 5) -> dict:
    """Per column with missing values: a lasso on the rows where it is present, its inputs the other columns
    that are missing in at most ``na_frac`` of its missing rows (mean-filled), its penalty chosen by
    ``k``-fold CV; else the column mean. Returns ``column -> (intercept, {input: coefficient})``."""
    cols = list(columns)
    means = stats.column_means(train, cols)
    usable = stats.conditional_features(stats.missing_share(train, cols), cols, na_frac).collect()
    inputs: dict[str, set[str]] = {}
    for r in usable:
        inputs.setdefault(r.feature, set()).add(r.other)
    nulls = train.agg(*[F.sum(F.when(col_of(c).isNull(), 1).otherwise(0)).alias(f"n{i}") for i, c in enumerate(cols)],
                      F.count(F.lit(1)).alias("rows")).first()
    xs = {c: [x for x in cols if x in inputs.get(c, ())] for i, c in enumerate(cols)
          if nulls[f"n{i}"] and nulls["rows"] - nulls[f"n{i}"] > min_samples}
    fitted = [c for c, x in xs.items() if x]
    moments = lasso.fold_moments(train, cols, fitted, means, k) if fitted else {}
    models: dict[str, tuple[float | None, dict[str, float]]] = {}
    for i, c in enumerate(cols):
        if not nulls[f"n{i}"]:
            continue
        if c not in moments:
            models[c] = (means[c], {})
            continue
        intercept, w, _ = lasso.fit_lasso_cv(moments[c], i, [cols.index(x) for x in xs[c]])
        shift = sum(float(v) * (means[x] or 0.0) for v, x in zip(w, xs[c]))
        models[c] = (intercept + (means[c] or 0.0) - shift, dict(zip(xs[c], map(float, w))))
    return {"means": means, "models": models}


def apply_model_imputer(df: DataFrame, fitted: dict) -> DataFrame:
    """Columns are filled in order, later ones seeing earlier imputations."""
    means = fitted["means"]
    for c, (intercept, weights) in fitted["models"].items():
        value = reduce(lambda a, b: a + b, [F.lit(w) * F.coalesce(col_of(x), F.lit(means[x])) for x, w in weights.items()],
                       F.lit(intercept))
        df = df.withColumn(c, F.coalesce(col_of(c), value))
    return df


def impute_with_model(train: DataFrame, test: DataFrame, columns: Sequence[str], na_frac: float = 0.5,
                      min_samples: int = 0) -> tuple[DataFrame, DataFrame]:
    fitted = fit_model_imputer(train, columns, na_frac, min_samples)
    return apply_model_imputer(train, fitted), apply_model_imputer(test, fitted)


# ------------------------------------------------------------------ preprocessing chain
def preprocess(train: DataFrame, test: DataFrame, binned: Sequence[str], seasons: Sequence[str],
               n_bins: int = K.N_BINS) -> tuple[DataFrame, DataFrame]:
    """Cleaning rules, both groups of derived features, shared quantile bins,
    shared season codes; leakage columns dropped and non-finite values nulled
    (train and test alike)."""
    from fathom.operators import derive
    train, test = clean.nonfinite_to_null(train), clean.nonfinite_to_null(test)    # before any rule sees NaN
    tr, te = clean.clean_features(train), clean.clean_features(test)
    tr, te = derive.add_pair_features(tr), derive.add_pair_features(te)
    tr, te = derive.add_group_features(tr), derive.add_group_features(te)
    tr, te = encode.bin_data(tr, te, [c for c in binned if c in tr.columns], n_bins)
    tr, te = encode.shared_codes(tr, te, [c for c in seasons if c in tr.columns])
    return clean.drop_leakage(tr), clean.drop_leakage(te)


def select_features(train: DataFrame, features: Sequence[str], cls: str = K.SII, fdr_level: float = 0.05,
                    corr_threshold: float = 0.0) -> list[str]:
    """Relevance tests (Kendall's tau, Kolmogorov-Smirnov for features of two values; FDR-controlled) on mean-filled
    labelled rows, then correlation threshold; returns the kept feature names (a schema-sized list)."""
    return _selected(train, features, cls, fdr_level, corr_threshold)[1]


def _selected(train: DataFrame, features: Sequence[str], cls: str, fdr_level: float, corr_threshold: float) -> tuple[list[str], list[str]]:
    lab = clean.keep_labelled(train, cls)
    pv = stats.relevance(stats.fill_means(lab, list(features)), cls, list(features))
    found = {r.feature for r in stats.fdr_select(pv, fdr_level).filter("relevant").select("feature").collect()}
    relevant = [f for f in features if f in found]
    if not relevant:
        return [], []
    kept = {r.feature for r in clean.filter_features(stats.corr_importance(lab, cls, relevant), corr_threshold).select("feature").collect()}
    return relevant, [f for f in relevant if f in kept]


def select_and_project(train: DataFrame, test: DataFrame, features: Sequence[str], path: str, cls: str = K.SII, fdr_level: float = 0.05,
                       corr_threshold: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Both selections' lists saved under ``path`` (``univariate``, ``correlation``); ``train`` and ``test`` without the
    features that the saved correlation list leaves out. Other columns stay."""
    from fathom.sources import sinks
    spark, root = train.sparkSession, path.rstrip("/")
    relevant, kept = _selected(train, features, cls, fdr_level, corr_threshold)
    sinks.save_feature_list(spark, relevant, f"{root}/univariate")
    sinks.save_feature_list(spark, kept, f"{root}/correlation")
    kept = sinks.read_feature_list(spark, f"{root}/correlation")
    gone = [f for f in features if f not in kept]
    return tuple(d.select(*[col_of(c) for c in d.columns if c not in gone]) for d in (train, test))
