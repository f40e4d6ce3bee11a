"""Scalar expressions (P-operators) built from pyspark.sql.functions.

All of them stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def token_to_null(col, tokens: Iterable[str]) -> Column:
    """P1 for one column: listed tokens become NULL."""
    c = _c(col)
    return F.when(c.isin(list(tokens)), F.lit(None)).otherwise(c)


def sentinel_to_null(col, value) -> Column:
    """A sentinel value becomes NULL."""
    return F.nullif(_c(col), F.lit(value))


def recode_sentinel(col, old, new) -> Column:
    """One sentinel becomes another."""
    c = _c(col)
    return F.when(c == F.lit(old), F.lit(new)).otherwise(c)


def indicator(cond: Column) -> Column:
    """1 when the condition holds, else 0 (NULL counts as 0)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def binary_target(col, positive="yes") -> Column:
    """The 0/1 target; a NULL target gives 0, as ``when/otherwise`` does."""
    return indicator(_c(col) == F.lit(positive))


def value_map(col, mapping: Mapping) -> Column:
    """P5: dictionary recode; values without an entry become NULL."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.create_map(*pairs)[_c(col)]


def safe_ratio(num, den) -> Column:
    """Division that returns NULL for a zero denominator (ANSI mode safe)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def pct(num, den, places: int | None = None) -> Column:
    """Percentage, optionally rounded half-up."""
    v = F.try_divide(_c(num).cast("double") * F.lit(100.0), _c(den).cast("double"))
    return F.round(v, places) if places is not None else v


def decision(prob, threshold: float, yes="CALL", no="SKIP") -> Column:
    """The boundary belongs to the positive decision."""
    return F.when(_c(prob) >= F.lit(threshold), F.lit(yes)).otherwise(F.lit(no))


def lift(prob, base) -> Column:
    """P / base; NULL (not NaN) when the base rate is not positive."""
    b = _c(base).cast("double")
    return F.when(b > 0, _c(prob).cast("double") / b)


def hash_hex_key(*parts) -> Column:
    """md5 of the parts joined by ':' (strings of any column type)."""
    return F.md5(F.concat_ws(":", *[_c(p).cast("string") if not isinstance(p, (int, float)) else F.lit(str(p))
                                   for p in parts]))


def hash_unit(*parts) -> Column:
    """Deterministic number in [0, 1) from md5(parts): first 8 hex digits / 2^32.

    Depends on the row's values only, never on partitioning, so split, folds
    and SMOTE draws repeat under any repartition and can be re-derived in SQL.
    """
    h = hash_hex_key(*parts)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint").cast("double") / F.lit(4294967296.0)
