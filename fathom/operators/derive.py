"""Derived features: products and ratios, age-group norms, row-wise summaries.

All formulas are data (below) evaluated in a single projection; divisions use
``try_divide`` so a zero divisor gives NULL (the missing-value convention)
instead of an ANSI error or an infinity.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom import constants as K
from fathom.functions.exprs import age_group, col_of, rowwise_max, rowwise_mean, rowwise_min, safe_div
from fathom.operators.clean import drop_columns

# ---------------------------------------------------------------- FIXED VALUES
# first group of derived features: (name, operator, left, right)
PAIR_FEATURES = [
    ("BMI_Age", "*", "Physical-BMI", "Basic_Demos-Age"),
    ("Internet_Hours_Age", "*", "PreInt_EduHx-computerinternet_hoursday", "Basic_Demos-Age"),
    ("BMI_Internet_Hours", "*", "Physical-BMI", "PreInt_EduHx-computerinternet_hoursday"),
    ("BFP_BMI", "/", "BIA-BIA_Fat", "BIA-BIA_BMI"),
    ("FFMI_BFP", "/", "BIA-BIA_FFMI", "BIA-BIA_Fat"),
    ("FMI_BFP", "/", "BIA-BIA_FMI", "BIA-BIA_Fat"),
    ("LST_TBW", "/", "BIA-BIA_LST", "BIA-BIA_TBW"),
    ("BFP_BMR", "*", "BIA-BIA_Fat", "BIA-BIA_BMR"),
    ("BFP_DEE", "*", "BIA-BIA_Fat", "BIA-BIA_DEE"),
    ("BMR_Weight", "/", "BIA-BIA_BMR", "Physical-Weight"),
    ("DEE_Weight", "/", "BIA-BIA_DEE", "Physical-Weight"),
    ("SMM_Height", "/", "BIA-BIA_SMM", "Physical-Height"),
    ("Muscle_to_Fat", "/", "BIA-BIA_SMM", "BIA-BIA_FMI"),
    ("Hydration_Status", "/", "BIA-BIA_TBW", "Physical-Weight"),
    ("ICW_TBW", "/", "BIA-BIA_ICW", "BIA-BIA_TBW"),
]

# second group: value divided by the norm of the age group
#   (name, norm table, columns reduced row-wise, reduction)
NORMED_FEATURES = [
    ("BMI_mean_norm", "BMI", ["Physical-BMI", "BIA-BIA_BMI"], "mean"),
    ("GS_max", "GS_max", ["FGC-FGC_GSND", "FGC-FGC_GSD"], "max"),
    ("GS_min", "GS_min", ["FGC-FGC_GSND", "FGC-FGC_GSD"], "min"),
    ("CU_norm", "CU", ["FGC-FGC_CU"], "value"),
    ("PU_norm", "PU", ["FGC-FGC_PU"], "value"),
    ("TL_norm", "TL", ["FGC-FGC_TL"], "value"),
    ("BMR_norm", "BMR", ["BIA-BIA_BMR"], "value"),
    ("DEE_norm", "DEE", ["BIA-BIA_DEE"], "value"),
    ("FFM_norm", "FFM", ["BIA-BIA_FFM"], "value"),
]
# row-wise summaries without a norm: (name, columns, reduction)
ROW_FEATURES = [
    ("FGC_Zones_mean", K.ZONE_COLUMNS, "mean"),
    ("FGC_Zones_min", K.ZONE_COLUMNS, "min"),
    ("FGC_Zones_max", K.ZONE_COLUMNS, "max"),
    ("SR_min", ["FGC-FGC_SRL", "FGC-FGC_SRR"], "min"),
    ("SR_max", ["FGC-FGC_SRL", "FGC-FGC_SRR"], "max"),
]
# differences and ratios of the second group: (name, operator, left, right)
SECOND_PAIR_FEATURES = [
    ("DEE_BMR", "-", "BIA-BIA_DEE", "BIA-BIA_BMR"),
    ("ICW_ECW", "/", "BIA-BIA_ECW", "BIA-BIA_ICW"),   # ECW / ICW despite the name
]
AGE_COLUMN = "Basic_Demos-Age"
GROUP_COLUMN = "group"
# ------------------------------------------------------------ end FIXED VALUES


def pair_expr(op: str, a: str, b: str) -> Column:
    x, y = col_of(a).cast("double"), col_of(b).cast("double")
    if op == "*":
        return x * y
    if op == "-":
        return x - y
    if op == "+":
        return x + y
    if op == "/":
        return safe_div(x, y)
    raise ValueError(op)


def _reduce(cols: Sequence[str], how: str) -> Column:
    if how == "mean":
        return rowwise_mean(cols)
    if how == "min":
        return rowwise_min(cols)
    if how == "max":
        return rowwise_max(cols)
    if how == "value":
        return col_of(cols[0]).cast("double")
    raise ValueError(how)


def norm_lookup(group: Column, values: Sequence[float]) -> Column:
    """``values[group]`` from a literal array (NULL for a NULL / out-of-range group)."""
    return F.try_element_at(F.array(*[F.lit(float(v)) for v in values]), group + F.lit(1))


def add_pair_features(df: DataFrame, features: Sequence[tuple[str, str, str, str]] = PAIR_FEATURES) -> DataFrame:
    """First group of derived features (products and ratios) appended as columns."""
    return df.select("*", *[pair_expr(op, a, b).alias(n) for n, op, a, b in features])


def add_group_features(df: DataFrame, age: str = AGE_COLUMN, thresholds: Sequence[float] = K.AGE_THRESHOLDS,
                       norms: Mapping[str, Sequence[float]] = K.NORMS,
                       drop: Sequence[str] | None = K.DERIVED_DROP_COLUMNS) -> DataFrame:
    """Second group: age group, group-normalised values, row-wise summaries,
    differences; then the consumed source columns are dropped."""
    g = age_group(age, thresholds)
    d = df.select("*", g.alias(GROUP_COLUMN))
    grp = F.col(GROUP_COLUMN)
    new = []
    for name, table, cols, how in NORMED_FEATURES:
        new.append(F.try_divide(_reduce(cols, how), norm_lookup(grp, norms[table])).alias(name))
    for name, cols, how in ROW_FEATURES:
        new.append(_reduce(cols, how).alias(name))
    for name, op, a, b in SECOND_PAIR_FEATURES:
        new.append(pair_expr(op, a, b).alias(name))
    d = d.select("*", *new)
    return drop_columns(d, drop) if drop else d


def norms_frame(spark: SparkSession, norms: Mapping[str, Sequence[float]] = K.NORMS) -> DataFrame:
    """The norm tables as a dimension ``(group, <table>...)`` -- 9 rows, a
    proven size bound, so it is always safe to broadcast."""
    names = list(norms)
    n = len(next(iter(norms.values())))
    rows = [(i, *[float(norms[t][i]) for t in names]) for i in range(n)]
    schema = "group int, " + ", ".join(f"{t} double" for t in names)
    return spark.createDataFrame(rows, schema)


def join_norms(df: DataFrame, norms_df: DataFrame, group: str = GROUP_COLUMN) -> DataFrame:
    """Dictionary lookup as a left join on the group (unmatched -> NULL)."""
    return df.join(F.broadcast(norms_df), on=group, how="left")
