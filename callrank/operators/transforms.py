"""Frame-level cleaning and projection (P-operators on whole frames)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callrank.functions import expressions as X
from callrank.spec import FeatureSpec, LeakageError


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def replace_tokens(df: DataFrame, tokens: Iterable[str] = ("unknown",),
                   cols: Iterable[str] | None = None) -> DataFrame:
    """Exact-cell tokens become NULL in every string column (numeric untouched)."""
    tokens = list(tokens)
    targets = set(cols) if cols is not None else set(string_columns(df))
    return df.withColumns({c: X.token_to_null(c, tokens) for c in df.columns if c in targets})


def null_sentinel(df: DataFrame, col: str, value, out: str | None = None) -> DataFrame:
    """Sentinel -> NULL, into ``out`` (default: in place)."""
    return df.withColumn(out or col, X.sentinel_to_null(col, value))


def recode(df: DataFrame, col: str, old, new, out: str | None = None) -> DataFrame:
    """Sentinel -> other sentinel."""
    return df.withColumn(out or col, X.recode_sentinel(col, old, new))


def add_target(df: DataFrame, col: str, positive="yes", out: str = "label") -> DataFrame:
    """0/1 target column."""
    return df.withColumn(out, X.binary_target(col, positive))


def map_values(df: DataFrame, col: str, mapping: Mapping, out: str | None = None) -> DataFrame:
    """P5: dictionary recode, unmapped values -> NULL."""
    return df.withColumn(out or col, X.value_map(col, mapping))


def cast_columns(df: DataFrame, types: Mapping[str, str], safe: bool = True) -> DataFrame:
    """Casts; ``safe`` uses try_cast so dirty input gives NULL under ANSI mode."""
    return df.withColumns({c: (F.col(c).try_cast(t) if safe else F.col(c).cast(t))
                           for c, t in types.items()})


def project(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Keep the feature list (put it first so the scan is pruned)."""
    return df.select(*cols)


def drop_leakage(df: DataFrame, spec: FeatureSpec, keep_target: bool = False) -> DataFrame:
    """Drop leakage columns (and the raw target) from a frame."""
    bad = set(spec.features) & set(spec.leakage)
    if bad:
        raise LeakageError(f"leakage columns used as features: {sorted(bad)}")
    drop = list(spec.leakage) + ([] if keep_target else [spec.target])
    return df.drop(*[c for c in drop if c in df.columns])


def add_flags(df: DataFrame, flags: Mapping[str, object]) -> DataFrame:
    """0/1 flags from named conditions, e.g.
    ``{"was_contacted": F.col("pdays") != -1, "intensive": F.col("campaign") > 3}``."""
    return df.withColumns({name: X.indicator(cond) for name, cond in flags.items()})
