"""Projections, filters and value-cleaning rules (narrow, single-stage operators)."""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom import constants as K
from fathom.functions.exprs import clip_keep_null, col_of, null_if_nonfinite


def drop_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Drop the listed columns that exist (names may contain '-')."""
    drop = set(columns)
    return df.select(*[col_of(c) for c in df.columns if c not in drop])


def nonfinite_to_null(df: DataFrame) -> DataFrame:
    """NaN and +-inf become NULL in every floating column."""
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(*[null_if_nonfinite(c).alias(c) if c in floats else col_of(c) for c in df.columns])


def drop_leakage(df: DataFrame, columns: Sequence[str] = K.LEAKAGE_COLUMNS) -> DataFrame:
    """Drop the leakage columns and turn NaN/+-inf into NULL in every floating column."""
    return nonfinite_to_null(drop_columns(df, columns))


def subset_of_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = (),
                       labels: Sequence[str] = K.LABEL_COLUMNS) -> DataFrame:
    """Project to ``keep`` + ``features``, re-adding label columns when present."""
    cols = list(keep) + [f for f in features if f not in keep]
    cols += [lab for lab in labels if lab in df.columns and lab not in cols]
    return df.select(*[col_of(c) for c in cols])


def keep_labelled(df: DataFrame, label: str = K.SII) -> DataFrame:
    return df.filter(col_of(label).isNotNull())


def keep_unlabelled(df: DataFrame, label: str = K.SII) -> DataFrame:
    return df.filter(col_of(label).isNull())


def drop_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(subset))


def clip_columns(df: DataFrame, columns: Sequence[str] = K.CLIP_COLUMNS,
                 lower: float = K.CLIP_LOWER, upper: float = K.CLIP_UPPER) -> DataFrame:
    cs = set(columns)
    return df.select(*[clip_keep_null(c, lower, upper).alias(c) if c in cs else col_of(c)
                       for c in df.columns])


_OPS = {"<": lambda x, b: x < b, "<=": lambda x, b: x <= b,
        ">": lambda x, b: x > b, ">=": lambda x, b: x >= b}


def apply_range_rules(df: DataFrame, rules: Sequence[tuple[str, str, float]] = K.RANGE_RULES) -> DataFrame:
    """Every rule ``(col, op, bound)`` that holds turns the value into NULL.

    All rules of a column fold into one ``CASE`` in a single projection.
    """
    by_col: dict[str, list] = {}
    for c, op, b in rules:
        by_col.setdefault(c, []).append((op, b))
    out = []
    for c in df.columns:
        if c not in by_col:
            out.append(col_of(c))
            continue
        x = col_of(c)
        bad = None
        for op, b in by_col[c]:
            p = _OPS[op](x, F.lit(b))
            bad = p if bad is None else (bad | p)
        out.append(F.when(bad, F.lit(None).cast("double")).otherwise(x).alias(c))
    return df.select(*out)


def clean_features(df: DataFrame) -> DataFrame:
    """Grip clipping followed by the implausible-value rules."""
    return apply_range_rules(clip_columns(df))


def filter_features(importance: DataFrame, threshold: float, feature: str = "feature",
                    value: str = "importance") -> DataFrame:
    """Features whose importance is ``>= threshold`` (NULL importance never passes)."""
    return importance.filter(col_of(value) >= F.lit(threshold)).select(feature, value)
