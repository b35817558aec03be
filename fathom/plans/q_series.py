"""Series summaries on ``events`` (series key ``user_id``, order ``ts, event_id``).

Stand-ins: ``value`` and the integer inside ``props`` are the sensor columns,
``event_type = 'error'`` is the 0/1 flag, ``hour(ts)`` drives the night/day
masks, ``value >= 25`` is the activity threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators.series import describe_series, masked_diff, night_day_masks, series_features
from fathom.plans.registry import query
from fathom.plans.tables import rnd, round_doubles, table

KEYS = ["value", "k"]


def _expand(sql: str) -> str:
    """Expand ``RND<<expr>>`` markers into the engine-stable rounding expression."""
    import re
    return re.sub(r"RND<<(.*?)>>", lambda m: rnd(m.group(1)), sql)

MASKS = ["all", "night", "day"]
ACTIVE = 25.0


def events_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "user_id", "ts", "event_id", "value",
        F.regexp_extract("props", r"(\d+)", 1).cast("double").alias("k"),
        F.when(F.col("event_type") == "error", 1.0).otherwise(0.0).alias("flag"),
        F.hour("ts").alias("hour"),
    )


def _chunk() -> F.Column:
    # one chunk per series-day: bounded window tasks even for a hot series
    return F.date_trunc("day", F.col("ts"))


def _masks():
    return night_day_masks(F.col("hour"), 22, 5, 7, 20)


def series_time_features_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events_prepared(spark, sf_dir)
    return series_features(ev, "user_id", ["ts", "event_id"], _chunk(), KEYS, _masks(),
                           flag="flag", active_col="value", active_threshold=ACTIVE)


# ---------------------------------------------------------------- oracle SQL
_E = r"""
e AS (
  SELECT user_id, ts, event_id, value,
         CAST(regexp_extract(props, '(\d+)', 1) AS DOUBLE) AS k,
         CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END AS flag,
         hour(ts) AS h
  FROM events),
m AS (
  SELECT *, true AS m_all, (h >= 22 OR h <= 5) AS m_night, (h <= 20 AND h >= 7) AS m_day FROM e)"""


def _diff_sql() -> str:
    parts = []
    for c in KEYS:
        for mk in MASKS:
            parts.append(f"CASE WHEN m_{mk} THEN {c} - lag({c}) OVER (PARTITION BY user_id, m_{mk} "
                         f"ORDER BY ts, event_id) END AS d_{c}_{mk}")
    return ",\n         ".join(parts)


def _features_sql() -> str:
    aggs = ["RND<<avg(flag)>> AS flag_mean",
            f"RND<<coalesce(sum(CASE WHEN value >= {ACTIVE} THEN value END), 0.0)>> AS active_sum"]
    for c in KEYS:
        for mk in MASKS:
            v = f"CASE WHEN m_{mk} THEN {c} END"
            dv = f"d_{c}_{mk}"
            aggs += [f"RND<<avg({v})>> AS {c}_{mk}_mean", f"RND<<stddev_samp({v})>> AS {c}_{mk}_std",
                     f"RND<<max({v})>> AS {c}_{mk}_max", f"RND<<min({v})>> AS {c}_{mk}_min",
                     f"RND<<avg({dv})>> AS {c}_{mk}_diff_mean",
                     f"RND<<stddev_samp({dv})>> AS {c}_{mk}_diff_std"]
    return (f"WITH {_E},\nd AS (SELECT *, {_diff_sql()} FROM m)\n"
            f"SELECT user_id, {', '.join(aggs)} FROM d GROUP BY user_id")


SERIES_FEATURES_SQL = _expand(_features_sql())


@query("series_time_features", SERIES_FEATURES_SQL)
def q_series_time_features(spark, sf_dir):
    return round_doubles(series_time_features_df(spark, sf_dir))


def _join_sql() -> str:
    return (f"WITH f AS ({SERIES_FEATURES_SQL})\n"
            "SELECT c.c_custkey, c.c_name, c.c_mktsegment, f.* EXCLUDE (user_id) "
            "FROM customer c LEFT JOIN f ON c.c_custkey = f.user_id")


@query("series_features_join", _join_sql())
def q_series_features_join(spark, sf_dir):
    """Flagship: customers left-joined to their series feature vector."""
    feats = series_time_features_df(spark, sf_dir)
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    joined = cust.join(feats, cust.c_custkey == feats.user_id, "left").drop("user_id")
    return round_doubles(joined)


_DESCRIBE_COLS = ["value", "k"]


def _describe_sql() -> str:
    stats = []
    i = 0
    for s in ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]:
        for c in _DESCRIBE_COLS:
            e = {"count": f"CAST(count({c}) AS DOUBLE)", "mean": f"avg({c})", "std": f"stddev_samp({c})",
                 "min": f"min({c})", "q25": f"quantile_cont({c}, 0.25)", "q50": f"quantile_cont({c}, 0.5)",
                 "q75": f"quantile_cont({c}, 0.75)", "max": f"max({c})"}[s]
            stats.append(f"RND<<{e}>> AS Stat_{i}")
            i += 1
    return f"WITH {_E}\nSELECT {', '.join(stats)}, user_id FROM e GROUP BY user_id"


@query("series_describe", _expand(_describe_sql()))
def q_series_describe(spark, sf_dir):
    ev = events_prepared(spark, sf_dir)
    return round_doubles(describe_series(ev, "user_id", _DESCRIBE_COLS))


def _masked_diff_sql() -> str:
    cols = []
    for c in KEYS:
        for mk in MASKS:
            cols.append(f"RND<<d_{c}_{mk}>> AS {c}__{mk}__diff")
    return (f"WITH {_E},\nd AS (SELECT *, {_diff_sql()} FROM m)\n"
            f"SELECT event_id, user_id, {', '.join(cols)} FROM d")


@query("masked_diff", _expand(_masked_diff_sql()))
def q_masked_diff(spark, sf_dir):
    ev = events_prepared(spark, sf_dir)
    d = masked_diff(ev, "user_id", ["ts", "event_id"], _chunk(), KEYS, _masks())
    cols = [f"{c}__{m}__diff" for c in KEYS for m in MASKS]
    return round_doubles(d.select("event_id", "user_id", *cols))


@query("thresholded_sum", _expand(
       f"SELECT user_id, RND<<coalesce(sum(CASE WHEN value >= {ACTIVE} THEN value END), 0.0)>> AS active_sum, "
       "RND<<avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END)>> AS flag_mean "
       "FROM events GROUP BY user_id"))
def q_thresholded_sum(spark, sf_dir):
    ev = events_prepared(spark, sf_dir)
    v = F.col("value")
    return round_doubles(ev.groupBy("user_id").agg(
        F.coalesce(F.sum(F.when(v >= F.lit(ACTIVE), v)), F.lit(0.0)).alias("active_sum"),
        F.avg("flag").alias("flag_mean")))


@query("hour_of_day",
       "SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, "
       "CAST((epoch_us(ts) % 86400000000) * 1000 // 3600000000000 AS BIGINT) AS hour_from_ns FROM events")
def q_hour_of_day(spark, sf_dir):
    from fathom.functions.exprs import hour_of_day, hours_from_time_of_day
    ev = table(spark, sf_dir, "events")
    # nanoseconds since midnight, the reference's time_of_day representation
    tod = (F.hour("ts").cast("long") * 3600 + F.minute("ts") * 60 + F.second("ts")) * F.lit(1_000_000_000)
    return ev.select("event_id", hour_of_day("ts").alias("hour"),
                     hours_from_time_of_day(tod, 3_600_000_000_000).alias("hour_from_ns"))
