"""``pyspark.ml`` stages of this library, so a trained model is an ordinary persistable pipeline.

``Prepare`` (imputer and scaler), ``OrdinalCuts`` (score to class) and ``KappaEvaluator`` can be
combined with Spark's own stages, ``CrossValidator`` and ``PipelineModel.save`` / ``load``.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasOutputCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom import constants as K
from fathom.functions.exprs import col_of, ordinal_round
from fathom.operators import evaluate
from fathom.plans import workflows as W
from fathom.plans.models import FEATURES


class KappaEvaluator(Evaluator, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Quadratic weighted kappa of two label columns; larger is better."""

    @keyword_only
    def __init__(self, *, labelCol: str = K.SII, predictionCol: str = "prediction"):
        super().__init__()
        self._setDefault(labelCol=K.SII, predictionCol="prediction")
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset: DataFrame) -> float:
        value = evaluate.quadratic_weighted_kappa(dataset, self.getLabelCol(), self.getPredictionCol()).first()[K.KAPPA]
        return float("nan") if value is None else float(value)

    def isLargerBetter(self) -> bool:
        return True


class OrdinalCuts(Transformer, HasPredictionCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Class of a score: how many of the ascending ``cuts`` it reaches."""

    cuts = Param(Params._dummy(), "cuts", "ascending cut points", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, predictionCol: str = "prediction", outputCol: str = K.SII, cuts: list[float] | None = None):
        super().__init__()
        self._setDefault(predictionCol="prediction", outputCol=K.SII)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), ordinal_round(self.getPredictionCol(), self.getOrDefault(self.cuts)))


class _Preparation(Params):
    features = Param(Params._dummy(), "features", "columns to impute and scale", TypeConverters.toListString)
    imputer = Param(Params._dummy(), "imputer", "mean, median, most_frequent, knn:<neighbours>:<weights>, lasso, linear, nearest or pchip",
                    TypeConverters.toString)
    scaler = Param(Params._dummy(), "scaler", "standard, minmax, maxabs, robust, quantile or power", TypeConverters.toString)
    key = Param(Params._dummy(), "key", "row order of the interpolating imputers", TypeConverters.toString)

    def _recipe(self) -> W.Recipe:
        get = self.getOrDefault
        return W.Recipe(get(self.features), imputer=get(self.imputer), scaler=get(self.scaler), key=get(self.key))


class Prepare(Estimator, _Preparation, DefaultParamsReadable, DefaultParamsWritable):
    """Fits an imputer, then a scaler on what it filled."""

    @keyword_only
    def __init__(self, *, features: list[str] | None = None, imputer: str = "mean", scaler: str = "standard", key: str = K.ID):
        super().__init__()
        self._setDefault(imputer="mean", scaler="standard", key=K.ID)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "PrepareModel":
        r = self._recipe()
        fill, scaling = W.fit_preparation(dataset, r)
        return prepared(r, fill, scaling)


class PrepareModel(Model, _Preparation, DefaultParamsReadable, DefaultParamsWritable):
    """What ``Prepare`` learnt: a few numbers per column, kept as JSON."""

    state = Param(Params._dummy(), "state", "fitted numbers (JSON)", TypeConverters.toString)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        s = json.loads(self.getOrDefault(self.state))
        return W.apply_preparation(dataset, self._recipe(), s["fill"], s["scaling"])


def prepared(r: W.Recipe, fill: dict, scaling) -> PrepareModel:
    m = PrepareModel()
    m._set(features=list(r.features), imputer=r.imputer, scaler=r.scaler, key=r.key,
           state=json.dumps({"fill": fill, "scaling": scaling}))
    return m


def as_pipeline(fitted: W.Fitted, cuts: list[float] | None = None, out: str = K.SII) -> PipelineModel:
    """A trained model as one persistable pipeline: preparation, features, estimator and, for a
    score model, its cut points."""
    stages = [prepared(fitted.recipe, fitted.fill, fitted.scaling),
              VectorAssembler(inputCols=fitted.recipe.features, outputCol=FEATURES, handleInvalid="keep"), fitted.model]
    if cuts:
        stages.append(OrdinalCuts(predictionCol="prediction", outputCol=out, cuts=[float(c) for c in cuts]))
    return PipelineModel(stages)


def predict_classes(pipeline: PipelineModel, df: DataFrame, key: str = K.ID, out: str = K.SII) -> DataFrame:
    """``key`` and the predicted class (of a classifier: its prediction)."""
    p = pipeline.transform(df.drop(out))
    return p.select(col_of(key), F.col(out if out in p.columns else "prediction").cast("int").alias(out))


def search_and_submit(train: DataFrame, test: DataFrame, features: list[str], estimator: str, n_trials: int, root: str,
                      seed: int = 0, k: int = K.N_FOLDS, rfe: bool = False, pseudo: bool = False) -> tuple[DataFrame, PipelineModel]:
    """Search, refit the best trial, score, predict ``test`` and write everything under ``root``: ``trials`` (resumable),
    ``scores/train``, ``features``, ``model`` and ``submission`` (CSV). Returns (submission, pipeline)."""
    from fathom.sources import sinks
    spark, root = train.sparkSession, root.rstrip("/")
    best = W.best_trial(W.random_search(train, features, estimator, n_trials, seed, f"{root}/trials", k=k, rfe=rfe)).first()
    r = W.recipe_from_trial(best)
    fit = W.train_regressor if W.REGISTRY[estimator][1] == "regressor" else W.train_classifier
    scores, cuts, model = fit(train, r, pseudo=pseudo)
    sinks.save_scores({"train": scores}, f"{root}/scores")
    sinks.save_feature_list(spark, r.features, f"{root}/features")
    sinks.save_model(as_pipeline(model, cuts), f"{root}/model")
    pipeline = PipelineModel.load(f"{root}/model")
    sinks.save_submission(predict_classes(pipeline, test), f"{root}/submission")
    return spark.read.option("header", True).schema(f"`{K.ID}` long, `{K.SII}` int").csv(f"{root}/submission"), pipeline
