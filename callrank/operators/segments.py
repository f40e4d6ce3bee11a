"""Class balance, conversion by segment and lift.

Totals are scalar subqueries (``DataFrame.scalar()``) over the grouped
result, never an eager ``count()`` while the plan is being built.  Every
grouping is a partial + final hash aggregate, so a segment holding a third
of all rows is combined map-side before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callrank.functions.expressions import lift, safe_ratio


def _cnt() -> Column:
    return F.count(F.lit(1))


def class_balance(df: DataFrame, col: str) -> DataFrame:
    """A1: per class count and share of all rows, largest first."""
    g = df.groupBy(col).agg(_cnt().alias("count"))
    total = g.agg(F.sum("count")).scalar()
    share = safe_ratio(F.col("count"), total)
    return (g.withColumn("share", share)
             .withColumn("pct", F.round(share * 100, 2))
             .orderBy(F.desc("count"), F.asc(col)))


def conversion_by_segment(df: DataFrame, segment, label: str = "label",
                          order: str = "rate") -> DataFrame:
    """A2/A3: total, converted, rate (and percent, 2 places) per segment.

    ``segment`` is a column name or a named Column (A4 groups on
    ``col.isNull()``)."""
    seg = F.col(segment) if isinstance(segment, str) else segment
    name = segment if isinstance(segment, str) else None
    g = df.groupBy(seg).agg(_cnt().alias("total"),
                            F.sum(F.col(label)).cast("bigint").alias("converted"))
    name = name or g.columns[0]
    g = (g.withColumn("rate", safe_ratio(F.col("converted"), F.col("total")))
          .withColumn("rate_pct", F.round(F.col("rate") * 100, 2)))
    if order == "rate":
        return g.orderBy(F.desc("rate"), F.asc(name))
    return g.orderBy(F.asc(name))


def conversion_by_null_flag(df: DataFrame, col: str, flag: str = "never_contacted",
                            label: str = "label") -> DataFrame:
    """A4: conversion grouped on ``col IS NULL`` (after P2), ascending flag."""
    return conversion_by_segment(df, F.col(col).isNull().alias(flag), label, order="key")


def value_counts(df: DataFrame, col: str, drop_null: bool = True) -> DataFrame:
    """A5: count per value, largest first; NULL keys dropped (pandas default)."""
    src = df.where(F.col(col).isNotNull()) if drop_null else df
    return src.groupBy(col).agg(_cnt().alias("count")).orderBy(F.desc("count"), F.asc(col))


def value_shares(df: DataFrame, col: str, drop_null: bool = True) -> DataFrame:
    """Share per value over the non-missing rows."""
    g = value_counts(df, col, drop_null)
    total = g.agg(F.sum("count")).scalar()
    return g.withColumn("share", safe_ratio(F.col("count"), total))


def conversion_with_overall(df: DataFrame, feature: str, label: str = "label") -> DataFrame:
    """Mean of the label per non-missing value (ascending) plus the overall
    mean over *all* rows, including rows where the feature is missing."""
    overall = df.agg(F.avg(F.col(label).cast("double"))).scalar()
    return (df.where(F.col(feature).isNotNull())
              .groupBy(feature).agg(F.avg(F.col(label).cast("double")).alias("rate"))
              .withColumn("overall_rate", overall)
              .orderBy(F.asc("rate"), F.asc(feature)))


def conditional_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Count of each class in one pass."""
    return df.agg(F.count_if(F.col(label) == 0).alias("n_0"),
                  F.count_if(F.col(label) == 1).alias("n_1"))


def positive_rate(df: DataFrame, label: str = "label") -> DataFrame:
    """Mean of the 0/1 label."""
    return df.agg(F.avg(F.col(label).cast("double")).alias("positive_rate"),
                  _cnt().alias("n"))


def segment_lift(df: DataFrame, segments: Mapping[str, Column], label: str = "label",
                 reference: str | None = None) -> DataFrame:
    """A10: named predicates -> one pass of conditional counts -> one row per
    segment with rate, lift over the base rate and over a reference segment.

    An "overall" row (all rows) is always added."""
    y = F.col(label) == 1
    aggs = [_cnt().alias("__all_n"), F.count_if(y).alias("__all_c")]
    names = list(segments)
    for i, n in enumerate(names):
        p = segments[n]
        aggs += [F.count_if(p).alias(f"__s{i}_n"), F.count_if(p & y).alias(f"__s{i}_c")]
    one = df.agg(*aggs)
    recs = [F.struct(F.lit(n).alias("segment"), F.col(f"__s{i}_n").alias("total"),
                     F.col(f"__s{i}_c").alias("converted")) for i, n in enumerate(names)]
    recs.append(F.struct(F.lit("overall").alias("segment"), F.col("__all_n").alias("total"),
                         F.col("__all_c").alias("converted")))
    base = safe_ratio(F.col("__all_c"), F.col("__all_n"))
    cols = [F.col("r.segment"), F.col("r.total"), F.col("r.converted"),
            safe_ratio(F.col("r.converted"), F.col("r.total")).alias("rate"), base.alias("base_rate")]
    if reference is not None:
        i = names.index(reference)
        cols.append(safe_ratio(F.col(f"__s{i}_c"), F.col(f"__s{i}_n")).alias("reference_rate"))
    out = one.select(F.explode(F.array(*recs)).alias("r"), *[F.col(c) for c in one.columns]).select(*cols)
    out = out.withColumn("lift_vs_base", lift(F.col("rate"), F.col("base_rate")))
    if reference is not None:
        out = out.withColumn("lift_vs_reference", lift(F.col("rate"), F.col("reference_rate")))
    return out


def channel_efficiency(conversion: DataFrame, segment: str) -> DataFrame:
    """From an A2/A3 table, the largest-volume segment and the worst-rate
    segment (ties broken by the smaller segment key), one row."""
    top = F.min(F.struct((-F.col("total")).alias("k"), F.col(segment).alias("s"), F.col("total").alias("v")))
    worst = F.min(F.struct(F.col("rate").alias("k"), F.col(segment).alias("s")))
    return (conversion.agg(top.alias("top"), worst.alias("worst"))
            .select(F.col("top.s").alias("top_volume_segment"), F.col("top.v").alias("top_volume_total"),
                    F.col("worst.s").alias("worst_rate_segment"), F.col("worst.k").alias("worst_rate")))


def conversion_report(df: DataFrame, features: Iterable[str], label: str = "label",
                      drop_null: bool = False) -> DataFrame:
    """Conversion of every value of every feature in one table and one
    scan (unpivot, then a single grouped aggregate), not a job per feature."""
    features = list(features)
    long = (df.select(*[F.col(f).cast("string").alias(f) for f in features], F.col(label))
              .unpivot([label], features, "feature", "value"))
    if drop_null:
        long = long.where(F.col("value").isNotNull())
    return (long.groupBy("feature", "value")
                .agg(_cnt().alias("total"), F.sum(F.col(label)).cast("bigint").alias("converted"))
                .withColumn("rate", safe_ratio(F.col("converted"), F.col("total")))
                .orderBy("feature", F.desc("rate"), "value"))


def ordered(df: DataFrame, by: Iterable, ascending: bool | list = False,
            tiebreak: Iterable[str] = ()) -> DataFrame:
    """Order by the given columns with a key tie-break for determinism."""
    by = list(by)
    asc = ascending if isinstance(ascending, list) else [ascending] * len(by)
    keys = [F.col(c).asc() if a else F.col(c).desc() for c, a in zip(by, asc)]
    return df.orderBy(*keys, *[F.col(t).asc() for t in tiebreak])
