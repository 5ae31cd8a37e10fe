"""Column functions with explicit null rules."""

from cairn.functions.nullsafe import (  # noqa: F401
    canonical_missing, clip_high, clip_low, clipped_logit, flag_where, is_one_of, keep_where, known_flag, latest, level_map, plain_flag, safe_ratio, sum_or_zero, value_if, without_sentinel,
)
