"""Bindings: simple imputation, scalers, quantile / power transforms (fit on
the train split, applied to both) and interpolating imputation on ``events``
with holes punched by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators import interpolate as interp
from fathom.operators import scale
from fathom.operators.neighbours import impute_knn
from fathom.plans.fixtures import participants, participants_cte, q
from fathom.plans.registry import query
from fathom.plans.tables import rnd, round_doubles, table

COLS = ["Physical-BMI", "BIA-BIA_FMI", "FGC-FGC_SRR", "Physical-HeartRate"]
_P = participants_cte()


def _frame(spark, sf_dir):
    p = participants(spark, sf_dir).select("id", "split", *[F.col(f"`{c}`") for c in COLS])
    return p, p.filter(F.col("split") == "train")


def _sel(exprs):
    return "SELECT p.id, p.split, " + ", ".join(f"{rnd(e)} AS {q(c)}" for c, e in zip(COLS, exprs))


# ------------------------------------------------------------------ imputation
def _impute_query(name, strategy, stat_sql):
    stats = ", ".join(f"{stat_sql(q(c))} AS s{i}" for i, c in enumerate(COLS))
    sql = (f"WITH {_P}, st AS (SELECT {stats} FROM participants WHERE split = 'train')\n"
           + _sel([f"coalesce(p.{q(c)}, st.s{i})" for i, c in enumerate(COLS)]) + " FROM participants p, st")

    @query(name, sql)
    def run(spark, sf_dir):
        p, train = _frame(spark, sf_dir)
        return round_doubles(scale.impute(p, COLS, strategy, fit_on=train))
    return run


_impute_query("impute_mean", "mean", lambda c: f"avg({c})")
_impute_query("impute_median", "median", lambda c: f"quantile_cont({c}, 0.5)")


def _mode_sql():
    parts = []
    for i, c in enumerate(COLS):
        parts.append(f"m{i} AS (SELECT first(v ORDER BY n DESC, v ASC) AS s{i} FROM (SELECT {q(c)} AS v, count(*) AS n "
                     f"FROM participants WHERE split = 'train' AND {q(c)} IS NOT NULL GROUP BY 1))")
    return (f"WITH {_P}, {', '.join(parts)}\n" + _sel([f"coalesce(p.{q(c)}, m{i}.s{i})" for i, c in enumerate(COLS)])
            + " FROM participants p, " + ", ".join(f"m{i}" for i in range(len(COLS))))


@query("impute_mode", _mode_sql())
def q_impute_mode(spark, sf_dir):
    p, train = _frame(spark, sf_dir)
    return round_doubles(scale.impute(p, COLS, "most_frequent", fit_on=train))


KNN_COLS = ["Physical-BMI", "BIA-BIA_BMI", "FGC-FGC_SRR", "BIA-BIA_FMI"]
KNN = 5


def _knn_mean_sql(k: int) -> str:
    """From ``best`` (keys, ``s``: struct of d2, v, w of the k least rows): both means per key."""
    return (f"used AS (SELECT key, s.d2 AS d2, s.v AS v, greatest(least(s.w, {k} - coalesce(sum(s.w) OVER (PARTITION BY key ORDER BY s "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS u, min(s.d2) OVER (PARTITION BY key) AS nearest FROM best), "
            "filled AS (SELECT key, sum(u * v) / sum(u) AS uniform, CASE WHEN any_value(nearest) = 0 THEN sum(u * v) FILTER (d2 = 0) / sum(u) FILTER (d2 = 0) "
            "ELSE sum(u * v / sqrt(d2)) / sum(u / sqrt(d2)) END AS distance FROM used GROUP BY key)")


def _knn_sql() -> str:
    names = ", ".join(f"{q(c)} AS c{i}" for i, c in enumerate(KNN_COLS))
    m = len(KNN_COLS)
    cols = ", ".join(f"c{i}" for i in range(m))
    same = " AND ".join(f"x.c{i} IS NOT DISTINCT FROM r.c{i}" for i in range(m))
    total = " + ".join(f"coalesce((x.c{i} - d.c{i}) * (x.c{i} - d.c{i}), 0.0)" for i in range(m))
    shared = " + ".join(f"CAST(x.c{i} IS NOT NULL AND d.c{i} IS NOT NULL AS INT)" for i in range(m))
    best = " UNION ALL ".join(
        f"SELECT {{'x': x, 't': {t}}} AS key, unnest(min({{'d2': d2, 'v': y{t}, 'w': w}}, {KNN})) AS s FROM pairs WHERE x{t} IS NULL AND y{t} IS NOT NULL GROUP BY x"
        for t in range(m))
    pairs = ", ".join(f"x.c{i} AS x{i}, d.c{i} AS y{i}" for i in range(m))
    out = lambda how: ", ".join(f"{rnd(f'coalesce(r.c{t}, f{t}.{how})')} AS {q(c)}" for t, c in enumerate(KNN_COLS))
    fills = " ".join(f"LEFT JOIN filled f{t} ON f{t}.key = {{'x': x.n, 't': {t}}}" for t in range(m))
    return (f"WITH {_P}, r AS (SELECT id, split, {names} FROM participants), "
            f"x AS (SELECT row_number() OVER (ORDER BY {cols}) AS n, * FROM (SELECT DISTINCT {cols} FROM r WHERE {' OR '.join(f'c{i} IS NULL' for i in range(m))})), "
            f"d AS (SELECT {cols}, least(count(*), {KNN}) AS w FROM r WHERE split = 'train' GROUP BY ALL), "
            f"pairs AS (SELECT x.n AS x, {pairs}, w, ({total}) * {m} / ({shared}) AS d2 FROM x JOIN d ON ({shared}) > 0), "
            f"best AS ({best}), {_knn_mean_sql(KNN)}\n"
            + " UNION ALL ".join(f"SELECT r.id, r.split, '{how}' AS weights, {out(how)} FROM r LEFT JOIN x ON {same} {fills}" for how in ("uniform", "distance")))


@query("impute_knn", _knn_sql())
def q_impute_knn(spark, sf_dir):
    """Both weightings of the k-NN imputer; donors are the train rows."""
    p = participants(spark, sf_dir).select("id", "split", *[F.col(f"`{c}`") for c in KNN_COLS])
    train = p.filter(F.col("split") == "train")
    both = [impute_knn(p, train, KNN_COLS, KNN, w).withColumn("weights", F.lit(w)) for w in ("uniform", "distance")]
    return round_doubles(both[0].unionByName(both[1]))


# ------------------------------------------------------------------ scalers
def _nz(e):
    return f"coalesce(nullif({e}, 0), 1.0)"


_SCALERS = {
    "scale_standard": ("standard", lambda c: (f"avg({c})", _nz(f"stddev_pop({c})"))),
    "scale_minmax": ("minmax", lambda c: (f"min({c})", _nz(f"max({c}) - min({c})"))),
    "scale_maxabs": ("maxabs", lambda c: ("0.0", _nz(f"max(abs({c}))"))),
    "scale_robust": ("robust", lambda c: (f"quantile_cont({c}, 0.5)",
                                          _nz(f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))),
}


def _scaler_query(name, how, stat):
    stats = ", ".join(f"{stat(q(c))[0]} AS a{i}, {stat(q(c))[1]} AS b{i}" for i, c in enumerate(COLS))
    sql = (f"WITH {_P}, st AS (SELECT {stats} FROM participants WHERE split = 'train')\n"
           + _sel([f"(p.{q(c)} - st.a{i}) / st.b{i}" for i, c in enumerate(COLS)]) + " FROM participants p, st")

    @query(name, sql)
    def run(spark, sf_dir):
        p, train = _frame(spark, sf_dir)
        return round_doubles(scale.scale(p, COLS, how, fit_on=train))
    return run


for _name, (_how, _stat) in _SCALERS.items():
    _scaler_query(_name, _how, _stat)

_NQ = 1000


def _quantile_sql():
    refs = [i / (_NQ - 1) for i in range(_NQ)]
    ref_list = "[" + ", ".join(f"CAST({r!r} AS DOUBLE)" for r in refs) + "]"
    qs = ", ".join(f"quantile_cont({q(c)}, {ref_list}) AS q{i}" for i, c in enumerate(COLS))
    exprs = []
    for i, c in enumerate(COLS):
        x, qq = f"CAST(p.{q(c)} AS DOUBLE)", f"st.q{i}"
        le = f"len(list_filter({qq}, lambda t: t <= {x}))"
        lt = f"len(list_filter({qq}, lambda t: t < {x}))"
        r = "st.refs"
        interp_ = (f"({r}[{le}] + ({x} - {qq}[{le}]) * ({r}[{le} + 1] - {r}[{le}]) "
                   f"/ ({qq}[{le} + 1] - {qq}[{le}]))")
        tied = f"(({r}[{lt} + 1] + {r}[{le}]) / 2.0)"
        e = (f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} >= {qq}[{_NQ}] THEN 1.0 WHEN {x} <= {qq}[1] THEN 0.0 "
             f"WHEN {le} > {lt} THEN {tied} ELSE {interp_} END")
        exprs.append(f"least(greatest({e}, 0.0), 1.0)")
    return (f"WITH {_P}, st AS (SELECT {qs}, {ref_list} AS refs FROM participants WHERE split = 'train')\n"
            + _sel(exprs) + " FROM participants p, st")


@query("scale_quantile", _quantile_sql())
def q_scale_quantile(spark, sf_dir):
    p, train = _frame(spark, sf_dir)
    return round_doubles(scale.quantile_transform(p, COLS, _NQ, fit_on=train))


LAMBDA = 0.5


def _yj_sql(x, lam=LAMBDA):
    return (f"CASE WHEN {x} >= 0 THEN (pow({x} + 1.0, {lam}) - 1.0) / {lam} "
            f"ELSE -(pow(-{x} + 1.0, {2.0 - lam}) - 1.0) / {2.0 - lam} END")


def _power_sql():
    t = ", ".join(f"{_yj_sql(q(c))} AS {q(c)}" for c in COLS)
    stats = ", ".join(f"avg({q(c)}) AS a{i}, {_nz(f'stddev_pop({q(c)})')} AS b{i}" for i, c in enumerate(COLS))
    return (f"WITH {_P}, tp AS (SELECT id, split, {t} FROM participants), "
            f"st AS (SELECT {stats} FROM tp WHERE split = 'train')\n"
            + _sel([f"(p.{q(c)} - st.a{i}) / st.b{i}" for i, c in enumerate(COLS)]) + " FROM tp p, st")


@query("scale_power_fixed", _power_sql())
def q_scale_power_fixed(spark, sf_dir):
    p, train = _frame(spark, sf_dir)
    return round_doubles(scale.power_transform(p, COLS, {c: LAMBDA for c in COLS}, fit_on=train))


# ------------------------------------------------------------------ interpolation
def _events_holes(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    hole = (F.col("event_id") % 7 == 0) | (F.col("event_id") % 11 == 3) | (F.col("user_id") % 50 == 7)
    return ev.select("event_id", "user_id", "ts", F.when(hole, F.lit(None)).otherwise(F.col("value")).alias("v"))


_EVH = ("ev AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 3 OR user_id % 50 = 7 "
        "THEN NULL ELSE value END AS v FROM events), "
        "b AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS pos, "
        "coalesce(count(v) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING "
        "AND 1 PRECEDING), 0) AS cb, count(v) OVER (PARTITION BY user_id) AS nk FROM ev), "
        "kn AS (SELECT user_id, pos, v, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS kn FROM b "
        "WHERE v IS NOT NULL), "
        "nb AS (SELECT b.*, p1.pos AS p1x, p1.v AS p1y, p2.pos AS p2x, p2.v AS p2y, p3.pos AS p3x, p3.v AS p3y, "
        "n1.pos AS n1x, n1.v AS n1y, n2.pos AS n2x, n2.v AS n2y, n3.pos AS n3x, n3.v AS n3y FROM b "
        "LEFT JOIN kn p1 ON p1.user_id = b.user_id AND p1.kn = b.cb "
        "LEFT JOIN kn p2 ON p2.user_id = b.user_id AND p2.kn = b.cb - 1 "
        "LEFT JOIN kn p3 ON p3.user_id = b.user_id AND p3.kn = b.cb - 2 "
        "LEFT JOIN kn n1 ON n1.user_id = b.user_id AND n1.kn = b.cb + (CASE WHEN b.v IS NULL THEN 1 ELSE 2 END) "
        "LEFT JOIN kn n2 ON n2.user_id = b.user_id AND n2.kn = b.cb + (CASE WHEN b.v IS NULL THEN 2 ELSE 3 END) "
        "LEFT JOIN kn n3 ON n3.user_id = b.user_id AND n3.kn = b.cb + (CASE WHEN b.v IS NULL THEN 3 ELSE 4 END))")


def _lin(x0, y0, x1, y1):
    return f"(({y1} - {y0}) / ({x1} - {x0}) * (pos - {x0}) + {y0})"


def _interp_sql(est):
    return (f"WITH {_EVH}\nSELECT event_id, user_id, {rnd(f'CASE WHEN v IS NOT NULL OR nk < 2 THEN v ELSE {est} END')} AS v "
            "FROM nb")


_LINEAR = (f"CASE WHEN p1x IS NOT NULL AND n1x IS NOT NULL THEN {_lin('p1x', 'p1y', 'n1x', 'n1y')} "
           f"WHEN n1x IS NOT NULL THEN {_lin('n1x', 'n1y', 'n2x', 'n2y')} ELSE {_lin('p2x', 'p2y', 'p1x', 'p1y')} END")
_NEAREST = ("CASE WHEN p1x IS NOT NULL AND n1x IS NOT NULL THEN (CASE WHEN pos - p1x <= n1x - pos THEN p1y ELSE n1y END) "
            "WHEN n1x IS NOT NULL THEN n1y ELSE p1y END")


def _sgn(e):
    return f"sign({e})"


def _interior(d0, d1, h0, h1):
    w1, w2 = f"(2.0 * {h1} + {h0})", f"({h1} + 2.0 * {h0})"
    return (f"(CASE WHEN {_sgn(d0)} <> {_sgn(d1)} OR {d0} = 0 OR {d1} = 0 THEN 0.0 "
            f"ELSE ({w1} + {w2}) / ({w1} / {d0} + {w2} / {d1}) END)")


def _edge(h0, h1, m0, m1):
    d = f"(((2.0 * {h0} + {h1}) * {m0} - {h0} * {m1}) / ({h0} + {h1}))"
    return (f"(CASE WHEN {_sgn(d)} <> {_sgn(m0)} THEN 0.0 WHEN {_sgn(m0)} <> {_sgn(m1)} AND abs({d}) > abs(3.0 * {m0}) "
            f"THEN 3.0 * {m0} ELSE {d} END)")


def _pchip_sql(A, B, C, D):
    (xa, ya), (xb, yb), (xc, yc), (xd, yd) = A, B, C, D
    hab, hbc, hcd = f"({xb} - {xa})", f"({xc} - {xb})", f"({xd} - {xc})"
    mab, mbc, mcd = f"(({yb} - {ya}) / {hab})", f"(({yc} - {yb}) / {hbc})", f"(({yd} - {yc}) / {hcd})"
    db = (f"(CASE WHEN {xa} IS NOT NULL THEN {_interior(mab, mbc, hab, hbc)} "
          f"WHEN {xd} IS NOT NULL THEN {_edge(hbc, hcd, mbc, mcd)} ELSE {mbc} END)")
    dc = (f"(CASE WHEN {xd} IS NOT NULL THEN {_interior(mbc, mcd, hbc, hcd)} "
          f"WHEN {xa} IS NOT NULL THEN {_edge(hbc, hab, mbc, mab)} ELSE {mbc} END)")
    t = f"((pos - {xb}) / {hbc})"
    return (f"((2.0 * {t}*{t}*{t} - 3.0 * {t}*{t} + 1.0) * {yb} + ({t}*{t}*{t} - 2.0 * {t}*{t} + {t}) * {hbc} * {db} "
            f"+ (-2.0 * {t}*{t}*{t} + 3.0 * {t}*{t}) * {yc} + ({t}*{t}*{t} - {t}*{t}) * {hbc} * {dc})")


def _akima_sql():
    """Statement of its own: the secants and slopes are named step by step."""
    secant = lambda a, b: f"({b}y - {a}y) / ({b}x - {a}x)"

    def slope(m):
        after, before = f"abs({m[3]} - {m[2]})", f"abs({m[1]} - {m[0]})"
        size = " + ".join(f"abs({v})" for v in m)
        return (f"CASE WHEN {after} + {before} > CAST(1e-9 AS DOUBLE) * ({size}) THEN ({after} * {m[1]} + {before} * {m[2]}) / ({after} + {before}) "
                f"ELSE 0.5 * ({m[3]} + {m[0]}) END")

    est = "p1y + t * (ta + t * ((3.0 * s2 - 2.0 * ta - tb) / h + t * ((ta + tb - 2.0 * s2) / (h * h))))"
    return (f"WITH {_EVH}, sec AS (SELECT *, {secant('p3', 'p2')} AS s0, {secant('p2', 'p1')} AS s1, {secant('p1', 'n1')} AS s2, "
            f"{secant('n1', 'n2')} AS s3, {secant('n2', 'n3')} AS s4, n1x - p1x AS h, pos - p1x AS t FROM nb), "
            "ext AS (SELECT *, coalesce(s1, 2.0 * s2 - s3, s2) AS m1, coalesce(s3, 2.0 * s2 - s1, s2) AS m3 FROM sec), "
            "ext2 AS (SELECT *, coalesce(s0, 2.0 * m1 - s2) AS m0, coalesce(s4, 2.0 * m3 - s2) AS m4 FROM ext), "
            f"sl AS (SELECT *, {slope(['m0', 'm1', 's2', 'm3'])} AS ta, {slope(['m1', 's2', 'm3', 'm4'])} AS tb FROM ext2)\n"
            f"SELECT event_id, user_id, {rnd(f'CASE WHEN v IS NOT NULL OR nk < 2 THEN v ELSE {est} END')} AS v FROM sl")


_NONE = ("CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)")
_PCHIP = (f"CASE WHEN p1x IS NOT NULL AND n1x IS NOT NULL THEN "
          f"{_pchip_sql(('p2x', 'p2y'), ('p1x', 'p1y'), ('n1x', 'n1y'), ('n2x', 'n2y'))} "
          f"WHEN n1x IS NOT NULL THEN {_pchip_sql(_NONE, ('n1x', 'n1y'), ('n2x', 'n2y'), ('n3x', 'n3y'))} "
          f"ELSE {_pchip_sql(('p3x', 'p3y'), ('p2x', 'p2y'), ('p1x', 'p1y'), _NONE)} END")


def _interp_query(name, method, sql):
    @query(name, sql)
    def run(spark, sf_dir):
        ev = _events_holes(spark, sf_dir)
        out = interp.interpolate(ev, ["v"], method, ["user_id"], ["ts", "event_id"], F.date_trunc("day", F.col("ts")))
        return round_doubles(out.select("event_id", "user_id", "v"))
    return run


_interp_query("interp_linear", "linear", _interp_sql(_LINEAR))
_interp_query("interp_nearest", "nearest", _interp_sql(_NEAREST))
_interp_query("interp_pchip", "pchip", _interp_sql(_PCHIP))
_interp_query("interp_akima", "akima", _akima_sql())
