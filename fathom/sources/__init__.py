"""Scans, sinks and keyed materialisation."""

from fathom.sources.readers import (  # noqa: F401
    nonfinite_to_null,
    read_csv,
    read_parquet,
    read_series,
    read_tabular_pair,
    with_split,
)
from fathom.sources.sinks import (  # noqa: F401
    feature_list_frame,
    load_model,
    read_feature_list,
    save_csv,
    save_feature_list,
    save_model,
    save_scores,
    save_submission,
)
from fathom.sources.materialize import fingerprint_frame, materialize, materialize_key  # noqa: F401
