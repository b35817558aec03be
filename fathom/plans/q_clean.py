"""Bindings: scans, projections, filters, cleaning rules and derived features."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom import constants as K
from fathom.operators import clean, derive
from fathom.plans.fixtures import NUMERIC_PARTICIPANT_COLUMNS, PARTICIPANT_COLUMNS, participants, participants_cte, q
from fathom.plans.registry import query
from fathom.plans.tables import rnd, round_doubles, table
from fathom.sources.readers import nonfinite_to_null, read_parquet

P = participants_cte()


def _sql(select: str, extra_ctes: str = "") -> str:
    return f"WITH {P}{',' + extra_ctes if extra_ctes else ''}\n{select}"


# ------------------------------------------------------------------ scans
@query("scan_project",
       "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem "
       "WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_quantity > 10")
def q_scan_project(spark, sf_dir):
    li = read_parquet(spark, f"{sf_dir}/lineitem.parquet")
    return (li.filter((F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
                      & (F.col("l_quantity") > 10))
              .select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"))


# ------------------------------------------------------------------ projections
_KEPT_AFTER_LEAK = [n for n, _ in PARTICIPANT_COLUMNS if n not in K.LEAKAGE_COLUMNS]


@query("drop_columns", _sql("SELECT " + ", ".join(
    rnd(q(c)) + f" AS {q(c)}" if c in NUMERIC_PARTICIPANT_COLUMNS else q(c) for c in _KEPT_AFTER_LEAK)
    + " FROM participants"))
def q_drop_columns(spark, sf_dir):
    return round_doubles(clean.drop_leakage(participants(spark, sf_dir)))


_SUBSET = ["Physical-BMI", "BIA-BIA_Fat", "FGC-FGC_CU"]


@query("feature_subset", _sql("SELECT id, " + ", ".join(rnd(q(c)) + f" AS {q(c)}" for c in _SUBSET + K.LABEL_COLUMNS)
                              + " FROM participants"))
def q_feature_subset(spark, sf_dir):
    return round_doubles(clean.subset_of_features(participants(spark, sf_dir), _SUBSET, keep=["id"]))


@query("label_filter", _sql(f"SELECT id, {q('sii')}, {rnd(q(K.PCIAT_TOTAL))} AS {q(K.PCIAT_TOTAL)} "
                            "FROM participants WHERE sii IS NOT NULL"))
def q_label_filter(spark, sf_dir):
    d = clean.keep_labelled(participants(spark, sf_dir))
    return round_doubles(d.select("id", "sii", F.col(f"`{K.PCIAT_TOTAL}`")))


@query("unlabeled_filter", _sql(f"SELECT id, split FROM participants WHERE sii IS NULL"))
def q_unlabeled_filter(spark, sf_dir):
    return clean.keep_unlabelled(participants(spark, sf_dir)).select("id", "split")


@query("dropna_subset", _sql(f"SELECT id FROM participants WHERE {q('Physical-BMI')} IS NOT NULL "
                             f"AND {q('FGC-FGC_GSD')} IS NOT NULL"))
def q_dropna_subset(spark, sf_dir):
    return clean.drop_missing(participants(spark, sf_dir), ["Physical-BMI", "FGC-FGC_GSD"]).select("id")


# ------------------------------------------------------------------ non-finite values
_INF_COLS = ["BIA-BIA_Fat", "BIA-BIA_FMI", "Physical-BMI"]


def _with_nonfinite(df):
    key = F.col("id")
    out = []
    for i, c in enumerate(_INF_COLS):
        x = F.col(f"`{c}`")
        out.append(F.when(key % 13 == i, F.lit(float("inf"))).when(key % 17 == i, F.lit(float("-inf")))
                   .when(key % 19 == i, F.lit(float("nan"))).otherwise(x).alias(c))
    return df.select("id", *out)


def _inf_sql():
    cols = []
    for i, c in enumerate(_INF_COLS):
        raw = (f"CASE WHEN id % 13 = {i} THEN 'inf'::DOUBLE WHEN id % 17 = {i} THEN '-inf'::DOUBLE "
               f"WHEN id % 19 = {i} THEN 'nan'::DOUBLE ELSE {q(c)} END")
        cols.append(f"CASE WHEN isinf({raw}) OR isnan({raw}) THEN NULL ELSE {rnd(raw)} END AS {q(c)}")
    return _sql("SELECT id, " + ", ".join(cols) + " FROM participants")


@query("inf_to_null", _inf_sql())
def q_inf_to_null(spark, sf_dir):
    return round_doubles(nonfinite_to_null(_with_nonfinite(participants(spark, sf_dir))))


# ------------------------------------------------------------------ cleaning rules
@query("clip_range", _sql("SELECT id, " + ", ".join(
    f"CASE WHEN {q(c)} IS NULL THEN NULL ELSE {rnd(f'least(greatest({q(c)}, 9.0), 60.0)')} END AS {q(c)}"
    for c in K.CLIP_COLUMNS) + " FROM participants"))
def q_clip_range(spark, sf_dir):
    d = clean.clip_columns(participants(spark, sf_dir))
    return round_doubles(d.select("id", *[F.col(f"`{c}`") for c in K.CLIP_COLUMNS]))


_RULE_COLS = list(dict.fromkeys(c for c, _, _ in K.RANGE_RULES))


def _rules_sql():
    cols = []
    for c in _RULE_COLS:
        conds = " OR ".join(f"{q(c)} {op} {b}" for cc, op, b in K.RANGE_RULES if cc == c)
        cols.append(f"CASE WHEN {conds} THEN NULL ELSE {rnd(q(c))} END AS {q(c)}")
    return _sql("SELECT id, " + ", ".join(cols) + " FROM participants")


@query("range_rules", _rules_sql())
def q_range_rules(spark, sf_dir):
    d = clean.apply_range_rules(participants(spark, sf_dir))
    return round_doubles(d.select("id", *[F.col(f"`{c}`") for c in _RULE_COLS]))


# ------------------------------------------------------------------ derived features
def _pair_sql(op, a, b):
    if op == "/":
        return f"CAST({q(a)} AS DOUBLE) / NULLIF(CAST({q(b)} AS DOUBLE), 0)"
    return f"CAST({q(a)} AS DOUBLE) {op} CAST({q(b)} AS DOUBLE)"


_PRODUCTS = [f for f in derive.PAIR_FEATURES if f[1] == "*"]
_RATIOS = [f for f in derive.PAIR_FEATURES if f[1] == "/"] + [f for f in derive.SECOND_PAIR_FEATURES]


def _pairs_query(name, feats):
    sql = _sql("SELECT id, " + ", ".join(f"{rnd(_pair_sql(op, a, b))} AS {q(n)}" for n, op, a, b in feats)
               + " FROM participants")

    @query(name, sql)
    def run(spark, sf_dir):
        d = participants(spark, sf_dir)
        return round_doubles(d.select("id", *[derive.pair_expr(op, a, b).alias(n) for n, op, a, b in feats]))
    return run


_pairs_query("products", _PRODUCTS)
_pairs_query("ratios", _RATIOS)


def _group_sql(age=q("Basic_Demos-Age")):
    cases = " ".join(f"WHEN {age} <= {t} THEN {i}" for i, t in enumerate(K.AGE_THRESHOLDS))
    return f"CAST(CASE {cases} ELSE NULL END AS INTEGER)"


def _rowmean_sql(cols):
    s = " + ".join(f"coalesce(CAST({q(c)} AS DOUBLE), 0.0)" for c in cols)
    n = " + ".join(f"(CASE WHEN {q(c)} IS NULL THEN 0 ELSE 1 END)" for c in cols)
    return f"({s}) / NULLIF(CAST({n} AS DOUBLE), 0)"


def _reduce_sql(cols, how):
    if how == "mean":
        return _rowmean_sql(cols)
    if how in ("min", "max"):
        f = "least" if how == "min" else "greatest"
        return f"{f}({', '.join('CAST(' + q(c) + ' AS DOUBLE)' for c in cols)})"
    return f"CAST({q(cols[0])} AS DOUBLE)"


def _norm_sql(table_name, group="grp"):
    arr = ", ".join(repr(float(v)) for v in K.NORMS[table_name])
    return f"([{arr}])[{group} + 1]"


@query("age_group", _sql(f"SELECT id, {_group_sql()} AS {q('group')} FROM participants"))
def q_age_group(spark, sf_dir):
    from fathom.functions.exprs import age_group
    d = participants(spark, sf_dir)
    return d.select("id", age_group("Basic_Demos-Age", K.AGE_THRESHOLDS).alias("group"))


@query("rowwise_mean", _sql("SELECT id, " + ", ".join(
    f"{rnd(_reduce_sql(cols, 'mean'))} AS {q(n)}" for n, cols, how in derive.ROW_FEATURES if how == "mean")
    + f", {rnd(_rowmean_sql(['Physical-BMI', 'BIA-BIA_BMI']))} AS bmi_mean FROM participants"))
def q_rowwise_mean(spark, sf_dir):
    from fathom.functions.exprs import rowwise_mean
    d = participants(spark, sf_dir)
    return round_doubles(d.select("id", *[rowwise_mean(cols).alias(n) for n, cols, how in derive.ROW_FEATURES
                                          if how == "mean"],
                                  rowwise_mean(["Physical-BMI", "BIA-BIA_BMI"]).alias("bmi_mean")))


@query("rowwise_minmax", _sql("SELECT id, " + ", ".join(
    f"{rnd(_reduce_sql(cols, how))} AS {q(n)}" for n, cols, how in derive.ROW_FEATURES if how != "mean")
    + " FROM participants"))
def q_rowwise_minmax(spark, sf_dir):
    d = participants(spark, sf_dir)
    return round_doubles(d.select("id", *[derive._reduce(cols, how).alias(n) for n, cols, how in derive.ROW_FEATURES
                                          if how != "mean"]))


def _normed_sql_cols():
    return [f"{rnd(f'({_reduce_sql(cols, how)}) / NULLIF({_norm_sql(t)}, 0)')} AS {q(n)}"
            for n, t, cols, how in derive.NORMED_FEATURES]


@query("group_norm", _sql("SELECT id, grp AS " + q("group") + ", " + ", ".join(_normed_sql_cols())
                          + f" FROM (SELECT *, {_group_sql()} AS grp FROM participants)"))
def q_group_norm(spark, sf_dir):
    d = derive.add_group_features(participants(spark, sf_dir), drop=None)
    return round_doubles(d.select("id", "group", *[F.col(n) for n, _, _, _ in derive.NORMED_FEATURES]))


def _all_derived_sql():
    # the full two-stage feature set with the consumed columns dropped
    base = [n for n, _ in PARTICIPANT_COLUMNS]
    pair1 = [f"{_pair_sql(op, a, b)} AS {q(n)}" for n, op, a, b in derive.PAIR_FEATURES]
    inner = f"SELECT *, {', '.join(pair1)}, {_group_sql()} AS grp FROM participants"
    new = (_normed_sql_cols()
           + [f"{rnd(_reduce_sql(cols, how))} AS {q(n)}" for n, cols, how in derive.ROW_FEATURES]
           + [f"{rnd(_pair_sql(op, a, b))} AS {q(n)}" for n, op, a, b in derive.SECOND_PAIR_FEATURES])
    kept = [c for c in base + [n for n, *_ in derive.PAIR_FEATURES] if c not in K.DERIVED_DROP_COLUMNS]
    num = set(NUMERIC_PARTICIPANT_COLUMNS) | {n for n, *_ in derive.PAIR_FEATURES}
    sel = [rnd(q(c)) + f" AS {q(c)}" if c in num else q(c) for c in kept]
    return _sql(f"SELECT {', '.join(sel)}, grp AS {q('group')}, {', '.join(new)} FROM ({inner})")


@query("literature_features", _all_derived_sql())
def q_literature_features(spark, sf_dir):
    d = derive.add_group_features(derive.add_pair_features(participants(spark, sf_dir)))
    return round_doubles(d)


@query("lookup_join", _sql(
    "SELECT p.id, p.grp AS " + q("group") + ", " + ", ".join(f"{rnd(repr(0.0) + ' + n.' + t)} AS {t}" for t in K.NORMS)
    + f" FROM (SELECT id, {_group_sql()} AS grp FROM participants) p LEFT JOIN (SELECT * FROM (VALUES "
    + ", ".join("(" + ", ".join([str(i)] + [repr(float(K.NORMS[t][i])) for t in K.NORMS]) + ")" for i in range(9))
    + ") AS v(grp, " + ", ".join(K.NORMS) + ")) n ON p.grp = n.grp"))
def q_lookup_join(spark, sf_dir):
    from fathom.functions.exprs import age_group
    d = participants(spark, sf_dir).select("id", age_group("Basic_Demos-Age", K.AGE_THRESHOLDS).alias("group"))
    return round_doubles(derive.join_norms(d, derive.norms_frame(spark)))
