"""Bindings: key joins, vote combination, weighted-vote search, best trial,
pseudo-label selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom import constants as K
from fathom.functions.exprs import ordinal_round
from fathom.operators import clean, combine, evaluate
from fathom.operators.ordered import exact_quantiles
from fathom.plans.fixtures import participants, participants_cte, q
from fathom.plans.q_eval import PRED_SQL, pred_col
from fathom.plans.registry import query
from fathom.plans.tables import rnd, round_doubles, table

_P = participants_cte()


# ------------------------------------------------------------------ J1 / J2
@query("left_join_embedding",
       "SELECT c.c_custkey AS id, c.c_acctbal, "
       + ", ".join(f"{rnd(f'CAST(e.embedding[{i}] AS DOUBLE)')} AS encoded_{i}" for i in range(1, 65))
       + " FROM customer c LEFT JOIN embeddings e ON c.c_custkey = e.vec_id")
def q_left_join_embedding(spark, sf_dir):
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    emb = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), *[F.col("embedding")[i - 1].cast("double").alias(f"encoded_{i}") for i in range(1, 65)])
    return round_doubles(combine.left_join(cust, emb, "id"))


# ------------------------------------------------------------------ vote tables
# four submissions: classes from quantity, price, line number and part size
_VOTES_SQL = {
    "v1": f"CASE WHEN {q('BIA-BIA_FFMI')} * 2 <= 12 THEN 0 WHEN {q('BIA-BIA_FFMI')} * 2 <= 25 THEN 1 "
          f"WHEN {q('BIA-BIA_FFMI')} * 2 <= 37 THEN 2 ELSE 3 END",
    "v2": f"CASE WHEN {q('Physical-Weight')} <= 20 THEN 0 WHEN {q('Physical-Weight')} <= 40 THEN 1 "
          f"WHEN {q('Physical-Weight')} <= 60 THEN 2 ELSE 3 END",
    "v3": f"CAST({q('BIA-BIA_Frame_num')} AS INTEGER) % 4",
    "v4": f"CAST({q('FGC-FGC_CU')} AS INTEGER) % 4",
}


def _vote_tables(spark, sf_dir):
    p = participants(spark, sf_dir)
    out = []
    for name, expr in _VOTES_SQL.items():
        e = F.expr(expr.replace('"', "`")).cast("int")
        out.append(p.select("id", e.alias(K.SII)))
    return out


def _votes_cte():
    cols = ", ".join(f"CAST({e} AS INTEGER) AS {n}" for n, e in _VOTES_SQL.items())
    return f"{_P}, vt AS (SELECT id, {cols} FROM participants)"


@query("combine_average",
       f"WITH {_votes_cte()} SELECT id, CAST(round_even((v1 + v2 + v3 + v4) / 4.0, 0) AS INTEGER) AS {q(K.SII)} FROM vt")
def q_combine_average(spark, sf_dir):
    bound = combine.bind_predictions(_vote_tables(spark, sf_dir), "id", K.SII, ["v1", "v2", "v3", "v4"])
    return combine.average_vote(bound, ["v1", "v2", "v3", "v4"]).select("id", K.SII)


@query("combine_majority",
       f"WITH {_votes_cte()}, l AS (SELECT id, unnest([v1, v2, v3]) AS v FROM vt), "
       "c AS (SELECT id, v, count(*) AS n FROM l GROUP BY 1, 2)\n"
       f"SELECT id, CAST(arg_min(v, (-n) * 10 + v) AS INTEGER) AS {q(K.SII)} FROM c GROUP BY id")
def q_combine_majority(spark, sf_dir):
    bound = combine.bind_predictions(_vote_tables(spark, sf_dir)[:3], "id", K.SII, ["v1", "v2", "v3"])
    return combine.majority_vote(bound, ["v1", "v2", "v3"]).select("id", K.SII)


_W = [0.5, 0.3, 0.2]


@query("vote_weighted",
       f"WITH {_votes_cte()} SELECT id, {rnd(f'({_W[0]} * v1 + {_W[1]} * v2 + {_W[2]} * v3) / {sum(_W)!r}')} AS pred FROM vt")
def q_vote_weighted(spark, sf_dir):
    bound = combine.bind_predictions(_vote_tables(spark, sf_dir)[:3], "id", K.SII, ["v1", "v2", "v3"])
    return round_doubles(combine.weighted_vote(bound, ["v1", "v2", "v3"], _W).select("id", "pred"))


# ------------------------------------------------------------------ weight search and best trial
_GRID = [0.0, 0.25, 0.5, 0.75, 1.0]
_TRIALS = [(i * len(_GRID) + j, a, b) for i, a in enumerate(_GRID) for j, b in enumerate(_GRID) if a + b > 0]


def vote_weight_trials(spark, sf_dir):
    """Trial table of a voting-weight search: every (w1, w2) on a grid is scored
    by the kappa of the rounded weighted vote of two submissions against the
    label. Each row is expanded to the (parameter-bounded) trials and the
    kappa sums are partial-aggregated per trial."""
    v = _vote_tables(spark, sf_dir)
    lab = clean.keep_labelled(participants(spark, sf_dir)).select("id", F.col(K.SII).cast("double").alias("y"))
    d = combine.bind_predictions(v[:2], "id", K.SII, ["v1", "v2"]).join(lab, "id")
    trials = F.array(*[F.struct(F.lit(t).alias("trial"), F.lit(a).alias("w1"), F.lit(b).alias("w2"))
                       for t, a, b in _TRIALS])
    x = d.select("y", "v1", "v2", F.explode(trials).alias("t")).select("y", "v1", "v2", "t.*")
    x = x.withColumn("p", ordinal_round((F.col("w1") * F.col("v1") + F.col("w2") * F.col("v2")) / (F.col("w1") + F.col("w2")),
                                        K.INITIAL_CUTS).cast("double"))
    g = x.groupBy("trial", "w1", "w2").agg(*evaluate.kappa_column_sums(F.col("y"), F.col("p")))
    return g.select("trial", "w1", "w2", evaluate.kappa_from_sums().alias("value"))


def _trials_sql():
    vals = ", ".join(f"({t}, {a!r}, {b!r})" for t, a, b in _TRIALS)
    pr = "((w1 * v1 + w2 * v2) / (w1 + w2))"
    pcls = " + ".join(f"CASE WHEN {pr} >= {c} THEN 1 ELSE 0 END" for c in K.INITIAL_CUTS)
    return (f"{_votes_cte()}, tr AS (SELECT * FROM (VALUES {vals}) AS v(trial, w1, w2)), "
            f"lab AS (SELECT vt.v1, vt.v2, CAST(p.{q(K.SII)} AS DOUBLE) AS y FROM vt JOIN participants p USING (id) "
            f"WHERE p.{q(K.SII)} IS NOT NULL), "
            f"x AS (SELECT trial, w1, w2, y, CAST({pcls} AS DOUBLE) AS p FROM lab, tr), "
            "trials AS (SELECT trial, w1, w2, 1.0 - sum((y - p) * (y - p)) / (sum(y * y) + sum(p * p) "
            "- 2.0 * sum(y) * sum(p) / count(*)) AS value FROM x GROUP BY 1, 2, 3)")


@query("vote_weight_search", f"WITH {_trials_sql()} SELECT trial, w1, w2, {rnd('value')} AS value FROM trials")
def q_vote_weight_search(spark, sf_dir):
    return round_doubles(vote_weight_trials(spark, sf_dir))


@query("best_trial", f"WITH {_trials_sql()} SELECT trial, w1, w2, {rnd('value')} AS value FROM trials "
       f"ORDER BY {rnd('value')} DESC, trial LIMIT 1")
def q_best_trial(spark, sf_dir):
    t = round_doubles(vote_weight_trials(spark, sf_dir))
    return t.orderBy(F.col("value").desc(), F.col("trial")).limit(1)


# ------------------------------------------------------------------ pseudo labels
def _runs_spark():
    base = pred_col()
    jitter = F.col("`BIA-BIA_ICW`") / 1000.0 - 0.04   # tax - 0.04
    return [(base + F.lit(float(r)) * jitter * 0.5).alias(f"r{r}") for r in range(K.PSEUDO_REFITS)]


def _runs_sql():
    jitter = f"({q('BIA-BIA_ICW')} / 1000.0 - 0.04)"
    return ", ".join(f"{PRED_SQL} + {float(r)} * {jitter} * 0.5 AS r{r}" for r in range(K.PSEUDO_REFITS))


def _std_sql():
    rs = [f"r{r}" for r in range(K.PSEUDO_REFITS)]
    mean = f"(({' + '.join(rs)}) / {float(len(rs))})"
    return f"sqrt(({' + '.join(f'({r} - {mean}) * ({r} - {mean})' for r in rs)}) / {float(len(rs))})"


@query("pseudo_std_select",
       f"WITH {_P}, u AS (SELECT id, {_runs_sql()} FROM participants WHERE {q(K.SII)} IS NULL), "
       f"s AS (SELECT id, r0, {_std_sql()} AS spread FROM u), "
       f"c AS (SELECT quantile_cont(spread, {K.PSEUDO_STD_QUANTILE}) AS cut FROM s)\n"
       f"SELECT id, {rnd('spread')} AS spread, {rnd('abs(r0)')} AS {q(K.PCIAT_TOTAL)} FROM s, c WHERE spread <= cut")
def q_pseudo_std_select(spark, sf_dir):
    u = clean.keep_unlabelled(participants(spark, sf_dir)).select("id", *_runs_spark())
    runs = [f"r{r}" for r in range(K.PSEUDO_REFITS)]
    spread = u.select(combine.prediction_spread(runs).alias("spread"))
    cut = exact_quantiles(spread, ["spread"], [K.PSEUDO_STD_QUANTILE])["spread"][0]
    sel = combine.confident_by_spread(u, runs, "r0", cut)
    return round_doubles(sel.select("id", "spread", F.col(f"`{K.PCIAT_TOTAL}`")))


@query("pseudo_prob_select",
       f"WITH {_P}, pr AS (SELECT id, " + "[" + ", ".join(
           f"exp(-3.0 * abs({PRED_SQL} - {float(k)})) / ("
           + " + ".join(f"exp(-3.0 * abs({PRED_SQL} - {float(j)}))" for j in range(4)) + ")" for k in range(4))
       + f"] AS probs FROM participants WHERE {q(K.SII)} IS NULL)\n"
       f"SELECT id, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS {q(K.SII)}, "
       f"{rnd('list_max(probs)')} AS max_prob FROM pr WHERE list_max(probs) >= {K.PSEUDO_CONFIDENCE}")
def q_pseudo_prob_select(spark, sf_dir):
    from fathom.plans.q_eval import _probs_spark
    u = clean.keep_unlabelled(participants(spark, sf_dir)).select("id", _probs_spark().alias("probs"))
    sel = combine.confident_by_probability(u, "probs", K.PSEUDO_CONFIDENCE)
    return round_doubles(sel.select("id", K.SII, "max_prob"))
