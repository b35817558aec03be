"""Bindings: column statistics, correlation / MI / Kendall relevance, FDR
selection, conditional missing shares. Input: labelled training rows of the
participant fixture (target ``sii``) plus one constant column."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fathom import constants as K
from fathom.operators import clean, stats
from fathom.plans.fixtures import participants, participants_cte, q
from fathom.plans.registry import query
from fathom.plans.tables import rnd, round_doubles

FEATS = ["Physical-BMI", "BIA-BIA_Fat", "BIA-BIA_FMI", "BIA-BIA_ICW", "FGC-FGC_CU", "Physical-HeartRate",
         "PAQ_A-PAQ_A_Total", "FGC-FGC_SRR", "FGC-FGC_GSD", "const"]
TARGET = K.SII
THRESHOLD = 0.05
_P = participants_cte()
_TRAIN = (f"{_P}, tr AS (SELECT id, {', '.join(q(c) for c in FEATS if c != 'const')}, CAST(1.0 AS DOUBLE) AS const, "
          f"{q(TARGET)} FROM participants WHERE split = 'train' AND {q(TARGET)} IS NOT NULL)")


def _train(spark, sf_dir):
    p = participants(spark, sf_dir).filter(F.col("split") == "train")
    p = clean.keep_labelled(p, TARGET)
    return p.select("id", *[F.col(f"`{c}`") for c in FEATS if c != "const"], F.lit(1.0).alias("const"),
                    F.col(TARGET))


@query("column_means", f"WITH {_TRAIN} SELECT " + ", ".join(f"{rnd(f'avg({q(c)})')} AS {q(c)}" for c in FEATS)
       + " FROM tr")
def q_column_means(spark, sf_dir):
    d = _train(spark, sf_dir)
    return round_doubles(d.agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in FEATS]))


@query("mean_fill",
       f"WITH {_P}, m AS (SELECT " + ", ".join(f"avg({q(c)}) AS {q(c)}" for c in FEATS if c != "const")
       + " FROM participants WHERE split = 'train')\nSELECT p.id, p.split, "
       + ", ".join(f"{rnd(f'coalesce(p.{q(c)}, m.{q(c)})')} AS {q(c)}" for c in FEATS if c != "const")
       + " FROM participants p, m")
def q_mean_fill(spark, sf_dir):
    """Both splits filled with the *train* means."""
    cols = [c for c in FEATS if c != "const"]
    p = participants(spark, sf_dir).select("id", "split", *[F.col(f"`{c}`") for c in cols])
    train = p.filter(F.col("split") == "train")
    return round_doubles(stats.fill_means(p, cols, fit_on=train))


@query("value_counts", f"WITH {_P} SELECT {q(TARGET)}, count(*) AS count FROM participants GROUP BY 1")
def q_value_counts(spark, sf_dir):
    return stats.value_counts(participants(spark, sf_dir), TARGET)


def _corr_sql():
    parts = []
    for c in FEATS:
        both = f"{q(c)} IS NOT NULL AND {q(TARGET)} IS NOT NULL"
        xm, ym = f"CASE WHEN {both} THEN {q(c)} END", f"CASE WHEN {both} THEN {q(TARGET)} END"
        e = f"abs(covar_samp({xm}, {ym}) / NULLIF(stddev_samp({xm}) * stddev_samp({ym}), 0))"
        parts.append(f"SELECT '{c}' AS feature, {e} AS importance FROM tr")
    return f"corr AS ({' UNION ALL '.join(parts)})"


@query("corr_importance", f"WITH {_TRAIN}, {_corr_sql()} SELECT feature, {rnd('importance')} AS importance FROM corr")
def q_corr_importance(spark, sf_dir):
    return round_doubles(stats.corr_importance(_train(spark, sf_dir), TARGET, FEATS))


@query("importance_sort",
       f"WITH {_TRAIN}, {_corr_sql()} SELECT feature, {rnd('importance')} AS importance, "
       f"CAST(row_number() OVER (ORDER BY {rnd('importance')} ASC NULLS LAST, feature) AS INTEGER) AS rank FROM corr")
def q_importance_sort(spark, sf_dir):
    # rank the rounded values: features with mathematically equal |r| tie exactly
    imp = round_doubles(stats.corr_importance(_train(spark, sf_dir), TARGET, FEATS))
    return stats.importance_rank(imp)


@query("corr_select",
       f"WITH {_TRAIN}, {_corr_sql()} SELECT feature, {rnd('importance')} AS importance FROM corr "
       f"WHERE importance >= {THRESHOLD}")
def q_corr_select(spark, sf_dir):
    imp = stats.corr_importance(_train(spark, sf_dir), TARGET, FEATS)
    return round_doubles(clean.filter_features(imp, THRESHOLD))


# ------------------------------------------------------------------ mutual information
_MI_FEATS = [c for c in FEATS if c != "const"]
_PROBS = "[" + ", ".join(f"CAST({i / K.N_BINS!r} AS DOUBLE)" for i in range(K.N_BINS + 1)) + "]"


def _mi_sql():
    edges = ", ".join(f"list_sort(list_distinct(quantile_cont(CAST({q(c)} AS DOUBLE), {_PROBS}))) AS {q(c)}"
                      for c in _MI_FEATS)
    longs = []
    for c in _MI_FEATS:
        e, x = f"e.{q(c)}", f"CAST(tr.{q(c)} AS DOUBLE)"
        b = (f"CASE WHEN {x} IS NOT NULL AND len({e}) >= 2 AND {x} >= {e}[1] AND {x} <= {e}[len({e})] "
             f"THEN greatest(len(list_filter({e}, lambda v: v < {x})) - 1, 0) END")
        longs.append(f"SELECT '{c}' AS feature, {b} AS bx, tr.{q(TARGET)} AS y FROM tr, e")
    return (f"WITH {_TRAIN}, e AS (SELECT {edges} FROM tr), "
            f"l AS ({' UNION ALL '.join(longs)}), "
            "j AS (SELECT feature, bx, y, CAST(count(*) AS DOUBLE) AS nxy FROM l WHERE bx IS NOT NULL GROUP BY 1, 2, 3), "
            "t AS (SELECT *, sum(nxy) OVER (PARTITION BY feature) AS n, sum(nxy) OVER (PARTITION BY feature, bx) AS nx, "
            "sum(nxy) OVER (PARTITION BY feature, y) AS ny FROM j), "
            "mi AS (SELECT feature, sum((nxy / n) * ln((nxy * n) / (nx * ny))) AS mi FROM t GROUP BY 1), "
            "r AS (SELECT min(mi) AS lo, max(mi) AS hi FROM mi)\n"
            f"SELECT feature, {rnd('CASE WHEN hi > lo THEN (mi - lo) / (hi - lo) ELSE 0.0 END')} AS importance FROM mi, r")


@query("mutual_information", _mi_sql())
def q_mutual_information(spark, sf_dir):
    return round_doubles(stats.mutual_information(_train(spark, sf_dir), TARGET, _MI_FEATS, K.N_BINS))


# ------------------------------------------------------------------ Kendall tau + FDR
_KT_FEATS = [c for c in FEATS if c != "const"] + ["const"]


def _erfc_sql(z):
    t = f"(1.0 / (1.0 + 0.5 * ({z})))"
    poly = repr(stats.ERFC_COEFFS[-1])
    for c in reversed(stats.ERFC_COEFFS[:-1]):
        poly = f"({c!r} + {t} * {poly})"
    return f"({t} * exp(-({z}) * ({z}) + {poly}))"


def _kendall_sql():
    tot = "(kt.n * (kt.n - 1) / 2)"
    m = "(kt.n * (kt.n - 1))"
    var = (f"(({m} * (2 * kt.n + 5) - kt.x1 - ky.y1) / 18 + (2 * kt.xtie * ky.ytie) / NULLIF({m}, 0) "
           f"+ (kt.x0 * ky.y0) / NULLIF(9 * {m} * (kt.n - 2), 0))")
    tau = f"(s.s / NULLIF(sqrt({tot} - kt.xtie) * sqrt({tot} - ky.ytie), 0))"
    z = f"(s.s / NULLIF(sqrt({var}), 0))"
    p = f"CASE WHEN {z} IS NOT NULL AND {tau} IS NOT NULL THEN least(1.0, {_erfc_sql(f'abs({z}) / {math.sqrt(2.0)!r}')}) END"
    return (f"WITH {_TRAIN}, {_KENDALL_CTE_CLEAN}\n"
            f"SELECT kt.feature, {tau} AS tau, {p} AS p_value FROM kt JOIN ky USING (feature) JOIN s USING (feature)")


# prefix-count formulation for S (independent of the Spark chunking): a dense
# (feature, x, class) grid, cumulative sums over x per feature and class
def _kendall_clean():
    longs = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({q(c)} AS DOUBLE) AS x, {q(TARGET)} AS y FROM tr "
        f"WHERE {q(c)} IS NOT NULL AND {q(TARGET)} IS NOT NULL" for c in _KT_FEATS)
    return (f"kl AS ({longs}), "
            "cls AS (SELECT y, CAST(row_number() OVER (ORDER BY y) - 1 AS INTEGER) AS ci FROM (SELECT DISTINCT y FROM kl)), "
            "kc AS (SELECT feature, x, ci, CAST(count(*) AS DOUBLE) AS n FROM kl JOIN cls USING (y) GROUP BY 1, 2, 3), "
            "grid AS (SELECT f.feature, f.x, c.ci FROM (SELECT DISTINCT feature, x FROM kc) f, cls c), "
            "g AS (SELECT grid.feature, grid.x, grid.ci, coalesce(kc.n, 0) AS n FROM grid LEFT JOIN kc "
            "ON grid.feature = kc.feature AND grid.x = kc.x AND grid.ci = kc.ci), "
            "gl AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY feature, ci ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING "
            "AND 1 PRECEDING), 0) AS l, sum(n) OVER (PARTITION BY feature, ci) AS na FROM g), "
            "pairs AS (SELECT b.feature, b.x, b.n * (2 * a.l + a.n - a.na) AS s FROM gl b JOIN gl a "
            "ON a.feature = b.feature AND a.x = b.x AND a.ci < b.ci), "
            "s AS (SELECT feature, sum(s) AS s FROM pairs GROUP BY 1), "
            "kt AS (SELECT feature, sum(t) AS n, sum(t * (t - 1) / 2) AS xtie, sum(t * (t - 1) * (t - 2)) AS x0, "
            "sum(t * (t - 1) * (2 * t + 5)) AS x1 FROM (SELECT feature, x, sum(n) AS t FROM kc GROUP BY 1, 2) GROUP BY 1), "
            "ky AS (SELECT feature, sum(na * (na - 1) / 2) AS ytie, sum(na * (na - 1) * (na - 2)) AS y0, "
            "sum(na * (na - 1) * (2 * na + 5)) AS y1 FROM (SELECT DISTINCT feature, ci, na FROM gl) GROUP BY 1)")


_KENDALL_CTE_CLEAN = _kendall_clean()
KENDALL_SQL = _kendall_sql()


@query("kendall_relevance", f"SELECT feature, {rnd('tau')} AS tau, {rnd('p_value')} AS p_value FROM ({KENDALL_SQL})")
def q_kendall_relevance(spark, sf_dir):
    return round_doubles(stats.kendall_tau(_train(spark, sf_dir), TARGET, _KT_FEATS))


# the step-up rule by its definition: a feature is relevant if any feature of no lesser
# p-value stays under its own line
@query("fdr_select",
       f"WITH kt0 AS ({KENDALL_SQL}), t AS (SELECT feature, p_value FROM kt0 WHERE p_value IS NOT NULL), "
       "h AS (SELECT count(*) AS m, list_sum(list_transform(range(1, count(*) + 1), lambda i: 1.0 / i)) AS c FROM t), "
       "r AS (SELECT a.feature, a.p_value, (SELECT count(*) FROM t b WHERE b.p_value < a.p_value "
       "OR (b.p_value = a.p_value AND b.feature <= a.feature)) AS k FROM t a)\n"
       f"SELECT feature, {rnd('p_value')} AS p_value, EXISTS (SELECT 1 FROM r z, h WHERE z.k >= r.k "
       "AND z.p_value * h.m * h.c <= 0.05 * z.k) AS relevant FROM r "
       f"UNION ALL SELECT feature, {rnd('p_value')} AS p_value, false AS relevant FROM kt0 WHERE p_value IS NULL")
def q_fdr_select(spark, sf_dir):
    pv = stats.kendall_tau(_train(spark, sf_dir), TARGET, _KT_FEATS)
    return round_doubles(stats.fdr_select(pv.select("feature", "p_value")))


# binary features: measurements above a cut, and a constant (no test)
_KS = {"heavy": "Physical-Weight", "fast": "Physical-HeartRate", "fat": "BIA-BIA_Fat"}
_KS_CUT = 30.0
_KS_FEATS = [*_KS, "const"]


def _ks_sql():
    long = " UNION ALL ".join(
        [f"SELECT '{n}' AS feature, CASE WHEN {q(c)} > {_KS_CUT} THEN 1 ELSE 0 END AS g, {q(TARGET)} AS y FROM participants "
         f"WHERE split = 'train' AND {q(TARGET)} IS NOT NULL AND {q(c)} IS NOT NULL" for n, c in _KS.items()])
    return (f"WITH {_P}, kl AS ({long}), n AS (SELECT feature, sum(g) AS n1, count(*) - sum(g) AS n0 FROM kl GROUP BY 1), "
            "cdf AS (SELECT v.feature, v.y, (SELECT avg(CASE WHEN b.y <= v.y THEN 1.0 ELSE 0.0 END) FROM kl b WHERE b.feature = v.feature AND b.g = 0) "
            "AS f0, (SELECT avg(CASE WHEN b.y <= v.y THEN 1.0 ELSE 0.0 END) FROM kl b WHERE b.feature = v.feature AND b.g = 1) AS f1 "
            "FROM (SELECT DISTINCT feature, y FROM kl) v), "
            "d AS (SELECT feature, max(abs(f0 - f1)) AS d FROM cdf GROUP BY 1), "
            "z AS (SELECT feature, d, CAST(n0 * n1 AS DOUBLE) / (n0 + n1) * d * d AS sq FROM d JOIN n USING (feature))\n"
            f"SELECT feature, {rnd('d')} AS \"D\", {rnd('CASE WHEN sq < 0.04 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * k * k * sq))))) END')} AS p_value FROM z "
            "UNION ALL SELECT 'const' AS feature, CAST(NULL AS DOUBLE) AS \"D\", CAST(NULL AS DOUBLE) AS p_value")


@query("ks_relevance", _ks_sql())
def q_ks_relevance(spark, sf_dir):
    p = clean.keep_labelled(participants(spark, sf_dir).filter(F.col("split") == "train"), TARGET)
    p = p.select(TARGET, F.lit(1.0).alias("const"), *[(F.col(f"`{c}`") > _KS_CUT).cast("double").alias(n) for n, c in _KS.items()])
    return round_doubles(stats.ks_binary(p, TARGET, _KS_FEATS))


_MS_FEATS = ["Physical-BMI", "BIA-BIA_BMI", "FGC-FGC_SRR", "FGC-FGC_GSD"] + K.ZONE_COLUMNS[:3]


def _missing_sql():
    arr = ", ".join(f"CASE WHEN {q(c)} IS NULL THEN '{c}' END" for c in _MS_FEATS)
    return (f"WITH {_P}, nl AS (SELECT id, list_filter([{arr}], lambda v: v IS NOT NULL) AS l FROM participants), "
            "f AS (SELECT l, unnest(l) AS feature FROM nl), "
            "pairs AS (SELECT feature, unnest(l) AS other FROM f), "
            "both_ AS (SELECT feature, other, count(*) AS n_both FROM pairs GROUP BY 1, 2), "
            "base AS (SELECT feature, n_both AS n_f FROM both_ WHERE feature = other)\n"
            f"SELECT b.feature, b.other, {rnd('CAST(b.n_both AS DOUBLE) / base.n_f')} AS share FROM both_ b "
            "JOIN base USING (feature) WHERE b.feature <> b.other")


@query("missing_share", _missing_sql())
def q_missing_share(spark, sf_dir):
    return round_doubles(stats.missing_share(participants(spark, sf_dir), _MS_FEATS))
