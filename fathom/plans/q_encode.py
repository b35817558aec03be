"""Bindings: categorical codes, quantile / equal-width bins, weights, unions.

Train / test stand-in: ``orders`` split by key parity, with ``o_orderpriority``
and ``o_orderstatus`` as categories (holes punched by key); binned columns
come from the participant fixture.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom import constants as K
from fathom.operators import clean, encode
from fathom.plans.fixtures import PARTICIPANT_COLUMNS, participants, participants_cte, q
from fathom.plans.registry import query
from fathom.plans.tables import rnd, round_doubles, table

_ORDERS_SQL = ("o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'train' ELSE 'test' END AS split, "
               "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS prio, "
               "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS status FROM orders)")


def _orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select("o_orderkey",
                    F.when(k % 2 == 0, "train").otherwise("test").alias("split"),
                    F.when(k % 11 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("prio"),
                    F.when(k % 13 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")).alias("status"))


def _split(df):
    return df.filter(F.col("split") == "train"), df.filter(F.col("split") == "test")


def _codes_sql(col):
    return (f"v_{col} AS (SELECT {col} AS value, CAST(row_number() OVER (ORDER BY {col} ASC NULLS LAST) - 1 AS INTEGER) "
            f"AS code FROM (SELECT DISTINCT {col} FROM o))")


@query("shared_codes",
       f"WITH {_ORDERS_SQL}, {_codes_sql('prio')}, {_codes_sql('status')}\n"
       "SELECT o.o_orderkey, o.split, vp.code AS prio, vs.code AS status FROM o "
       "LEFT JOIN v_prio vp ON o.prio IS NOT DISTINCT FROM vp.value "
       "LEFT JOIN v_status vs ON o.status IS NOT DISTINCT FROM vs.value")
def q_shared_codes(spark, sf_dir):
    train, test = _split(_orders(spark, sf_dir))
    tr, te = encode.shared_codes(train, test, ["prio", "status"])
    return tr.unionByName(te)


def _first_seen_sql(col):
    return (f"f_{col} AS (SELECT value, CAST(row_number() OVER (ORDER BY first_key) - 1 AS INTEGER) AS code FROM "
            f"(SELECT coalesce({col}, 'Missing') AS value, min(ord) AS first_key FROM o2 GROUP BY 1))")


@query("first_seen_codes",
       f"WITH {_ORDERS_SQL}, o2 AS (SELECT *, (CASE WHEN split = 'train' THEN 0 ELSE 1 END) * 1000000000000 "
       f"+ o_orderkey AS ord FROM o), {_first_seen_sql('prio')}, {_first_seen_sql('status')}\n"
       "SELECT o2.o_orderkey, o2.split, fp.code AS prio, fs.code AS status FROM o2 "
       "LEFT JOIN f_prio fp ON coalesce(o2.prio, 'Missing') = fp.value "
       "LEFT JOIN f_status fs ON coalesce(o2.status, 'Missing') = fs.value")
def q_first_seen_codes(spark, sf_dir):
    o = _orders(spark, sf_dir)
    train, test = _split(o)
    both = train.unionByName(test)  # concatenation order: train rows, then test rows
    ord_key = F.when(F.col("split") == "train", F.lit(0)).otherwise(F.lit(1)) * F.lit(10 ** 12) + F.col("o_orderkey")
    return encode.first_seen_codes(both, ["prio", "status"], ord_key).select("o_orderkey", "split", "prio", "status")


_SEASONS = [f"s{i}" for i in range(len(K.SEASON_COLUMNS))]
_SEASONS_SQL = (f"{participants_cte()}, o AS (SELECT id, split, " + ", ".join(f"{q(c)} AS {s}" for c, s in zip(K.SEASON_COLUMNS, _SEASONS))
                + " FROM participants), o2 AS (SELECT *, (CASE WHEN split = 'train' THEN 0 ELSE 1 END) * CAST(1000000000000000000 AS BIGINT) + id AS ord FROM o)")


def _seasons(spark, sf_dir):
    return participants(spark, sf_dir).select("id", "split", *[F.col(f"`{c}`").alias(s) for c, s in zip(K.SEASON_COLUMNS, _SEASONS)])


def _coded_sql(tables, prefix, value):
    return (f"WITH {_SEASONS_SQL}, {', '.join(map(tables, _SEASONS))}\nSELECT o2.id, o2.split, "
            + ", ".join(f"{prefix}_{c}.code AS {c}" for c in _SEASONS) + " FROM o2 "
            + " ".join(f"LEFT JOIN {prefix}_{c} ON {value(c)} IS NOT DISTINCT FROM {prefix}_{c}.value" for c in _SEASONS))


@query("season_codes", _coded_sql(_codes_sql, "v", lambda c: f"o2.{c}"))
def q_season_codes(spark, sf_dir):
    """Shared codes of all ten categories of the participant table."""
    tr, te = encode.shared_codes(*_split(_seasons(spark, sf_dir)), _SEASONS)
    return tr.unionByName(te)


@query("season_codes_first_seen", _coded_sql(_first_seen_sql, "f", lambda c: f"coalesce(o2.{c}, 'Missing')"))
def q_season_codes_first_seen(spark, sf_dir):
    rows = _seasons(spark, sf_dir)
    ord_key = F.when(F.col("split") == "train", F.lit(0)).otherwise(F.lit(1)) * F.lit(10 ** 18) + F.col("id")
    return encode.first_seen_codes(rows, _SEASONS, ord_key)


@query("distinct_union",
       f"WITH {_ORDERS_SQL} SELECT DISTINCT prio FROM (SELECT prio FROM o WHERE split = 'train' "
       "UNION ALL SELECT prio FROM o WHERE split = 'test')")
def q_distinct_union(spark, sf_dir):
    train, test = _split(_orders(spark, sf_dir))
    return encode.distinct_union(train, test, "prio")


# ------------------------------------------------------------------ bins
# the binned columns that are measured; the others are derived from them
BINS = [c for c in K.BINNED_COLUMNS if c in dict(PARTICIPANT_COLUMNS)]
_PROBS = "[" + ", ".join(f"CAST({i / K.N_BINS!r} AS DOUBLE)" for i in range(K.N_BINS + 1)) + "]"
_P = participants_cte()


def _edges_cte():
    cols = ", ".join(f"list_sort(list_distinct(quantile_cont(CAST({q(c)} AS DOUBLE), {_PROBS}))) AS {q(c)}"
                     for c in BINS)
    return f"edges AS (SELECT {cols} FROM participants)"


def _edges_sql():
    parts = [f"SELECT '{c}' AS feature, CAST(unnest(generate_series(0, len({q(c)}) - 1)) AS INTEGER) AS edge_idx, "
             f"unnest({q(c)}) AS edge FROM edges" for c in BINS]
    return (f"WITH {_P}, {_edges_cte()}\nSELECT feature, edge_idx, {rnd('edge')} AS edge FROM ("
            + " UNION ALL ".join(parts) + ")")


@query("quantile_edges", _edges_sql())
def q_quantile_edges(spark, sf_dir):
    p = participants(spark, sf_dir)
    e = encode.quantile_edges_frame(p, BINS, K.N_BINS)
    return round_doubles(e.select("feature", F.posexplode("edges").alias("edge_idx", "edge")))


def _bin_sql(c):
    e = f"edges.{q(c)}"
    x = f"CAST(p.{q(c)} AS DOUBLE)"
    return (f"CASE WHEN {x} IS NOT NULL AND len({e}) >= 2 AND {x} >= {e}[1] AND {x} <= {e}[len({e})] "
            f"THEN CAST(greatest(len(list_filter({e}, lambda v: v < {x})) - 1, 0) AS DOUBLE) END AS {q(c)}")


@query("quantile_bins", f"WITH {_P}, {_edges_cte()}\nSELECT p.id, p.split, "
       + ", ".join(_bin_sql(c) for c in BINS) + " FROM participants p, edges")
def q_quantile_bins(spark, sf_dir):
    p = participants(spark, sf_dir).select("id", "split", *[F.col(f"`{c}`") for c in BINS])
    train, test = _split(p)
    tr, te = encode.bin_data(train, test, BINS, K.N_BINS)
    return tr.unionByName(te)


_EW = "Physical-HeartRate"


def _ew_sql(x, lo="lo", hi="hi"):
    return (f"CAST(CASE WHEN {x} IS NULL THEN NULL WHEN {hi} = {lo} THEN 0 ELSE "
            f"least(greatest(ceil(({x} - {lo}) / (({hi} - {lo}) / CAST(10 AS DOUBLE))) - 1, 0), 9) END AS INTEGER)")


@query("equal_width_bins",
       f"WITH {_P}, r AS (SELECT min({q(_EW)}) AS lo, max({q(_EW)}) AS hi FROM participants)\n"
       f"SELECT id, {_ew_sql(q(_EW))} AS bin FROM participants, r")
def q_equal_width_bins(spark, sf_dir):
    p = participants(spark, sf_dir)
    lo, hi = encode.fit_range(p, _EW)
    return p.select("id", encode.equal_width_bin(F.col(f"`{_EW}`"), F.lit(lo), F.lit(hi), 10).alias("bin"))


@query("inverse_freq_weights",
       f"WITH {_P}, p AS (SELECT id, {q(K.PCIAT_TOTAL)} AS x FROM participants WHERE sii IS NOT NULL), "
       "r AS (SELECT min(x) AS lo, max(x) AS hi FROM p), "
       f"b AS (SELECT id, {_ew_sql('x')} AS bin FROM p, r), "
       "c AS (SELECT bin, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY bin), "
       "t AS (SELECT sum(n) AS nn, count(*) AS k FROM c)\n"
       f"SELECT b.id, b.bin AS target_bin, {rnd('CAST(t.nn AS DOUBLE) / (CAST(t.k AS DOUBLE) * CAST(c.n AS DOUBLE))')} "
       "AS weight FROM b LEFT JOIN c ON b.bin = c.bin, t")
def q_inverse_freq_weights(spark, sf_dir):
    p = clean.keep_labelled(participants(spark, sf_dir)).select("id", F.col(f"`{K.PCIAT_TOTAL}`"))
    w = encode.inverse_frequency_weights(p, K.PCIAT_TOTAL)
    return round_doubles(w.select("id", "target_bin", "weight"))


_U_TRAIN = ["id", "Physical-BMI", "BIA-BIA_Fat", K.SII]
_U_TEST = ["id", "Physical-BMI", "FGC-FGC_CU"]


@query("union_by_name",
       f"WITH {_P}\nSELECT {', '.join(q(c) for c in _U_TRAIN)} FROM participants WHERE split = 'train' "
       f"UNION ALL BY NAME SELECT {', '.join(q(c) for c in _U_TEST)} FROM participants WHERE split = 'test'")
def q_union_by_name(spark, sf_dir):
    p = participants(spark, sf_dir)
    train, test = _split(p)
    a = train.select(*[F.col(f"`{c}`") for c in _U_TRAIN])
    b = test.select(*[F.col(f"`{c}`") for c in _U_TEST])
    return a.unionByName(b, allowMissingColumns=True)
