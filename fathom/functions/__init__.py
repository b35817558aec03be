"""Column-level expressions (JVM-side, codegen-friendly, no Python UDFs)."""

from fathom.functions.exprs import (  # noqa: F401
    age_group,
    argmax_index,
    clip_keep_null,
    col_of,
    hour_of_day,
    hours_from_time_of_day,
    null_if_nonfinite,
    ordinal_round,
    rowwise_max,
    rowwise_mean,
    rowwise_min,
    round_half_even,
    safe_div,
    split_key_value,
)
