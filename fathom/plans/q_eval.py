"""Bindings: ordinal rounding, kappa, regression metrics, cut-point search,
stratified folds, class-probability argmax.

Scored stand-in: labelled participants, ``y = sii`` (0..3) and a continuous
prediction ``pred = quantity / 6.5 + (discount - 0.05) * 8`` (quantity drives
the class, discount adds noise)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom import constants as K
from fathom.functions.exprs import argmax_index, ordinal_round
from fathom.operators import clean, evaluate, folds
from fathom.plans.fixtures import participants, participants_cte, q
from fathom.plans.registry import query
from fathom.plans.tables import rnd, round_doubles

_P = participants_cte()
PRED_SQL = f'({q("BIA-BIA_FFMI")} / 6.5 + ({q("BIA-BIA_Fat")} / 700.0 - 0.05) * 8.0)'
_SCORED = (f"{_P}, sc AS (SELECT id, CAST({q(K.SII)} AS DOUBLE) AS y, CAST({PRED_SQL} AS DOUBLE) AS pred "
           f"FROM participants WHERE {q(K.SII)} IS NOT NULL)")
CUTS = K.INITIAL_CUTS


def pred_col():
    return (F.col("`BIA-BIA_FFMI`") / 6.5 + (F.col("`BIA-BIA_Fat`") / 700.0 - 0.05) * 8.0).cast("double")


def scored(spark, sf_dir):
    p = clean.keep_labelled(participants(spark, sf_dir))
    return p.select("id", F.col(K.SII).cast("double").alias("y"), pred_col().alias("pred"))


def _round_sql(pred="pred"):
    return "CAST(" + " + ".join(f"CASE WHEN {pred} >= {t} THEN 1 ELSE 0 END" for t in sorted(CUTS)) + " AS INTEGER)"


@query("ordinal_round", f"WITH {_SCORED} SELECT id, {_round_sql()} AS {q(K.SII)} FROM sc")
def q_ordinal_round(spark, sf_dir):
    return scored(spark, sf_dir).select("id", ordinal_round("pred", CUTS).alias(K.SII))


def _kappa_sql(y, p, src):
    return (f"SELECT 1.0 - sum(({y} - {p}) * ({y} - {p})) / (sum({y} * {y}) + sum({p} * {p}) "
            f"- 2.0 * sum({y}) * sum({p}) / count(*)) AS k FROM {src}")


@query("kappa", f"WITH {_SCORED}, r AS (SELECT y, CAST({_round_sql()} AS DOUBLE) AS p FROM sc)\n"
       f"SELECT {rnd('k')} AS {K.KAPPA} FROM ({_kappa_sql('y', 'p', 'r')})")
def q_kappa(spark, sf_dir):
    d = scored(spark, sf_dir).withColumn("p", ordinal_round("pred", CUTS))
    return round_doubles(evaluate.quadratic_weighted_kappa(d, "y", "p"))


@query("regression_metrics",
       f"WITH {_SCORED} SELECT {rnd('sqrt(avg((y - pred) * (y - pred)))')} AS {K.RMSE}, "
       f"{rnd('avg(abs(y - pred))')} AS {K.MAE}, "
       f"{rnd('1.0 - sum((y - pred) * (y - pred)) / (sum(y * y) - sum(y) * sum(y) / count(*))')} AS {K.R2} FROM sc")
def q_regression_metrics(spark, sf_dir):
    return round_doubles(evaluate.regression_metrics(scored(spark, sf_dir), "y", "pred"))


@query("evaluate_scores",
       f"WITH {_SCORED}, r AS (SELECT y, CAST({_round_sql()} AS DOUBLE) AS p FROM sc)\n"
       f"SELECT round_even(1.0 - sum((y - p) * (y - p)) / (sum(y * y) + sum(p * p) - 2.0 * sum(y) * sum(p) / count(*)), 3) AS {K.KAPPA}, "
       f"round_even(sqrt(avg((y - p) * (y - p))), 3) AS {K.RMSE}, round_even(avg(abs(y - p)), 3) AS {K.MAE}, "
       f"round_even(1.0 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 3) AS {K.R2} FROM r")
def q_evaluate_scores(spark, sf_dir):
    d = scored(spark, sf_dir).withColumn("p", ordinal_round("pred", CUTS))
    return evaluate.evaluate(d, "y", "p")


_NC = 64


def _tune_sql():
    probs = "[" + ", ".join(f"CAST({i / (_NC + 1)!r} AS DOUBLE)" for i in range(1, _NC + 1)) + "]"
    return (f"WITH {_SCORED}, "
            f"cq AS (SELECT list_sort(list_distinct(quantile_cont(pred, {probs}))) AS c FROM sc), "
            "cand AS (SELECT CAST(unnest(generate_series(0, len(c) - 1)) AS INTEGER) AS i, unnest(c) AS t FROM cq), "
            "cells AS (SELECT sc.y, (SELECT count(*) FROM cand WHERE cand.t <= sc.pred) AS ci, count(*) AS n "
            "FROM sc GROUP BY 1, 2), "
            "tr AS (SELECT a.i AS c1, b.i AS c2, d.i AS c3 FROM cand a JOIN cand b ON b.i > a.i JOIN cand d ON d.i > b.i), "
            "sums AS (SELECT c1, c2, c3, sum(n) AS nn, sum(n * y) AS sy, sum(n * pc) AS sp, sum(n * y * y) AS syy, "
            "sum(n * pc * pc) AS spp, sum(n * (y - pc) * (y - pc)) AS sd FROM ("
            "SELECT tr.*, cells.y, CAST(cells.n AS DOUBLE) AS n, CAST((cells.ci >= c1 + 1)::INT + (cells.ci >= c2 + 1)::INT "
            "+ (cells.ci >= c3 + 1)::INT AS DOUBLE) AS pc FROM tr, cells) GROUP BY 1, 2, 3), "
            "best AS (SELECT c1, c2, c3, (nn * sd) / (nn * (syy + spp) - 2.0 * sy * sp) AS ratio FROM sums "
            "ORDER BY ratio ASC NULLS LAST, c1, c2, c3 LIMIT 1)\n"
            f"SELECT {rnd('a.t')} AS cut_1, {rnd('b.t')} AS cut_2, {rnd('d.t')} AS cut_3, {rnd('1.0 - ratio')} AS {K.KAPPA} "
            "FROM best JOIN cand a ON a.i = best.c1 JOIN cand b ON b.i = best.c2 JOIN cand d ON d.i = best.c3")


@query("tune_cuts", _tune_sql())
def q_tune_cuts(spark, sf_dir):
    return round_doubles(evaluate.tune_cuts(scored(spark, sf_dir), "y", "pred", n_cuts=3, n_candidates=_NC))


@query("stratified_folds",
       f"WITH {_P} SELECT id, {q(K.SII)}, CAST((row_number() OVER (PARTITION BY {q(K.SII)} "
       f"ORDER BY md5('0:' || CAST(id AS VARCHAR)), id) - 1) % {K.N_FOLDS} AS INTEGER) AS fold "
       f"FROM participants WHERE {q(K.SII)} IS NOT NULL")
def q_stratified_folds(spark, sf_dir):
    p = clean.keep_labelled(participants(spark, sf_dir)).select("id", K.SII)
    return folds.stratified_folds(p, K.SII, "id", K.N_FOLDS, seed=0)


# class probabilities: p_k proportional to exp(-3 |pred - k|), k = 0..3
def _probs_spark():
    pr = pred_col()
    scores = [F.exp(F.lit(-3.0) * F.abs(pr - F.lit(float(k)))) for k in range(4)]
    tot = scores[0] + scores[1] + scores[2] + scores[3]
    return F.array(*[s / tot for s in scores])


def _probs_sql():
    s = [f"exp(-3.0 * abs({PRED_SQL} - {float(k)}))" for k in range(4)]
    tot = " + ".join(f"({x})" for x in s)
    return "[" + ", ".join(f"({x}) / ({tot})" for x in s) + "]"


@query("argmax_prob",
       f"WITH {_P}, pr AS (SELECT id, {_probs_sql()} AS probs FROM participants)\n"
       f"SELECT id, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS label, "
       f"{rnd('list_max(probs)')} AS max_prob FROM pr")
def q_argmax_prob(spark, sf_dir):
    d = participants(spark, sf_dir).select("id", _probs_spark().alias("probs"))
    return round_doubles(d.select("id", argmax_index("probs").alias("label"), F.array_max("probs").alias("max_prob")))
