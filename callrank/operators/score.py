"""Scoring (K1) and input validation against learned domains (K2)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callrank.functions.expressions import decision, lift
from callrank.operators.models import with_scores
from callrank.session import BROADCAST_BYTES, join_small, row_bytes, scratch_path


def batch_score(model: PipelineModel, df: DataFrame, base_rate, threshold: float = 0.30,
                keep: Iterable[str] = (), probability: str = "probability") -> DataFrame:
    """K1: P(class 1), lift over the base rate and CALL/SKIP for every row.

    ``base_rate`` is a float or a Column (e.g. a scalar subquery); a one-row
    request is the same call on a one-row frame."""
    base = F.lit(float(base_rate)) if isinstance(base_rate, (int, float)) else base_rate
    p = F.col("_p")
    return with_scores(model, df, probability).select(*keep, p.alias("p_yes"), lift(p, base).alias("lift"),
                      decision(p, threshold).alias("decision"))


def numeric_ranges(ref: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Learned (column_name, lo, hi) of numeric inputs: one aggregate pass."""
    cols = list(cols)
    one = ref.agg(*[F.min(c).cast("double").alias(f"{c}__lo") for c in cols],
                  *[F.max(c).cast("double").alias(f"{c}__hi") for c in cols])
    recs = [F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__lo").alias("lo"), F.col(f"{c}__hi").alias("hi"))
            for c in cols]
    return one.select(F.explode(F.array(*recs)).alias("r")).select("r.*")


def domain_violations(df: DataFrame, key: Iterable[str], domains: DataFrame,
                      ranges: DataFrame | None = None) -> DataFrame:
    """K2: rows (key..., column_name, value) whose category was never seen in
    training or whose number lies outside the learned range.  NULL inputs are
    not violations (the encoder keeps them as 'unseen' zeros), and a column
    absent from ``domains`` and ``ranges`` is not validated.

    Each column is looked up in its own domain while the rows are scanned, and
    only violations become rows.  The domains are written once and summed by
    column; a column beyond ``BROADCAST_BYTES`` has its distinct values
    checked first, so a frequent value is shuffled once a task."""
    key = list(key)
    if domains.columns != ["column_name", "value"]:
        raise ValueError("domains must be (column_name, value) rows")
    cols = [f for f in df.schema.fields if f.name not in key]
    texts = [f.name for f in cols if f.dataType.simpleString() == "string"]
    spark = df.sparkSession
    path = scratch_path(spark, "domains")
    domains.where(F.col("column_name").isin(texts) & F.col("value").isNotNull()).distinct().write.parquet(path)
    known = spark.read.schema(domains.schema).parquet(path)
    # one row per column: a fact of the schema
    sizes = known.groupBy("column_name").agg(F.sum(row_bytes(known)).alias("n")).collect()
    x, found = df, []

    def violation(name, bad, value):
        found.append(F.when(bad, F.struct(F.lit(name).alias("column_name"), value.alias("value"))))

    for i, (name, size) in enumerate(sorted(sizes)):
        values = known.where(F.col("column_name") == name).select(F.col("value").alias(f"_v{i}"))
        if size <= BROADCAST_BYTES:
            x = x.join(F.broadcast(values.withColumn(f"_s{i}", F.lit(True))), F.col(name) == F.col(f"_v{i}"), "left")
            bad = F.col(name).isNotNull() & F.col(f"_s{i}").isNull()
        else:
            unseen = df.select(F.col(name).alias(f"_u{i}")).distinct().join(
                values, F.col(f"_u{i}") == F.col(f"_v{i}"), "left_anti")
            x = join_small(x, unseen, F.col(name) == F.col(f"_u{i}"), "left")
            bad = F.col(f"_u{i}").isNotNull()
        violation(name, bad, F.col(name))
    numbers = [f.name for f in cols if f.name not in texts]
    for r in (ranges.where(F.col("column_name").isin(numbers)).collect() if ranges is not None else []):
        v = F.col(r["column_name"]).cast("double")
        violation(r["column_name"], (v < F.lit(r["lo"])) | (v > F.lit(r["hi"])), v.cast("string"))
    none = F.lit(None).cast("struct<column_name: string, value: string>")
    return (x.select(*key, F.explode(F.array_compact(F.array(*found, none))).alias("_r"))
             .select(*key, "_r.column_name", "_r.value"))
