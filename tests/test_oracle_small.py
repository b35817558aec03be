"""Spark bindings against their DuckDB twins on the smallest driver tables."""

import duckdb
import pytest

from fathom.plans.registry import ORACLE, QUERIES, load_all
from fathom.plans.tables import TABLES

SF = "/root/testdata/sf0.001"
# queries binding tables by the fixture key: that key repeats once at sf0.001
# (lineitem has one duplicated (order, line, part, supplier) row), so use sf0.01
UNIQUE_KEY_SF = "/root/testdata/sf0.01"
NEEDS_UNIQUE_KEY = {"combine_majority", "combine_average", "best_trial"}
FAST = ["series_time_features", "masked_diff", "series_describe", "hour_of_day", "drop_columns", "inf_to_null",
        "clip_range", "range_rules", "ratios", "age_group", "rowwise_mean", "group_norm", "lookup_join",
        "shared_codes", "first_seen_codes", "quantile_edges", "quantile_bins", "equal_width_bins",
        "inverse_freq_weights", "union_by_name", "corr_importance", "importance_sort", "mutual_information",
        "kendall_relevance", "fdr_select", "missing_share", "kappa", "regression_metrics", "tune_cuts",
        "stratified_folds", "combine_majority", "combine_average", "best_trial", "pseudo_std_select",
        "impute_mode", "scale_robust", "scale_power_fixed", "interp_linear", "interp_nearest", "interp_pchip"]

load_all()


def _duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle(spark, name):
    from tools.oracle_check import compare
    assert name in ORACLE
    sf = UNIQUE_KEY_SF if name in NEEDS_UNIQUE_KEY else SF
    sp = QUERIES[name](spark, sf).toPandas()
    dd = _duck(sf).execute(ORACLE[name]).df()
    assert compare(sp, dd) == "OK"


def test_every_query_has_oracle_or_is_model_based():
    rows_only = set(QUERIES) - set(ORACLE)
    from fathom.plans import q_models
    model_names = {n for n, f in QUERIES.items() if f.__module__ == q_models.__name__}
    assert rows_only <= model_names
