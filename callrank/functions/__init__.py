"""Column-level helpers (all built-in Spark expressions, no Python UDF)."""

from callrank.functions.expressions import (  # noqa: F401
    binary_target, decision, indicator, lift, pct, recode_sentinel, safe_ratio,
    sentinel_to_null, token_to_null, value_map, hash_unit, hash_hex_key,
)
