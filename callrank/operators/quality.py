"""Schema inspection and data-quality operators (Q1-Q10).

Profiles are computed in one scan: the frame is unpivoted to
(column, value) and partially aggregated before any shuffle, so a hot
value (a third of all rows) collapses map-side.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class NameCollisionError(ValueError):
    """Two columns map to the same normalised name."""


def normalize_names(df: DataFrame, old: str = ".", new: str = "_") -> DataFrame:
    """Q1: replace ``old`` by ``new`` in every column name; fail on collisions
    (Spark names are case-insensitive, so compare lower-cased)."""
    names = [c.replace(old, new) for c in df.columns]
    seen = {}
    for src, dst in zip(df.columns, names):
        k = dst.lower()
        if k in seen:
            raise NameCollisionError(f"{src!r} and {seen[k]!r} both become {dst!r}")
        seen[k] = src
    return df.toDF(*names)


def shape(df: DataFrame) -> DataFrame:
    """Q2: one row (n_rows, n_cols)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("bigint").alias("n_cols"))


def schema_rows(df: DataFrame) -> DataFrame:
    """Q3: the schema as rows (position, column_name, data_type); metadata only."""
    spark = df.sparkSession
    rows = [(i + 1, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "position int, column_name string, data_type string, nullable boolean")


def columns_of_type(df: DataFrame, *types: type) -> list[str]:
    """Q10: names of the columns whose type is one of ``types``."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, types)]


def select_of_type(df: DataFrame, *types: type) -> DataFrame:
    """Q10 as a projection."""
    return df.select(*columns_of_type(df, *types))


def _long(df: DataFrame, cols: Iterable[str], value_type: str) -> DataFrame:
    cols = list(cols)
    return (df.select(*[F.col(c).cast(value_type).alias(c) for c in cols])
              .unpivot([], cols, "column_name", "value"))


def describe_typed(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Q4: count, mean, stddev (sample), min, max per numeric column, as typed rows."""
    if cols is None:
        cols = columns_of_type(df, T.NumericType)
    return (_long(df, cols, "double")
            .groupBy("column_name")
            .agg(F.count("value").alias("count"), F.avg("value").alias("mean"),
                 F.stddev_samp("value").alias("stddev"), F.min("value").alias("min"),
                 F.max("value").alias("max")))


def first_sorted_distinct(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """Q5: the k smallest distinct values (a top-k report: partial distinct,
    then TakeOrderedAndProject keeps k rows per task)."""
    return df.select(col).distinct().orderBy(F.col(col).asc_nulls_last()).limit(k)


def count_value(df: DataFrame, col: str, value) -> DataFrame:
    """Q6: number of rows where ``col == value``."""
    return df.agg(F.count_if(F.col(col) == F.lit(value)).alias("n"))


def category_domains(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Q7: (column_name, value) rows, one per distinct non-null value.

    Rows, not one array per column, so a large domain is never gathered
    into one group."""
    return (_long(df, cols, "string").where(F.col("value").isNotNull())
            .distinct())


def quality_report(df: DataFrame, cols: Iterable[str] | None = None,
                   tokens: Iterable[str] = ("unknown",), exact: bool = True) -> DataFrame:
    """Q8: per column: rows, nulls, token cells, distinct non-null values.

    exact=True: one scan -> (column, value) counts with map-side combine ->
    per-column totals.  exact=False: one-row aggregate with
    approx_count_distinct (no shuffle of values at all)."""
    cols = list(cols) if cols is not None else df.columns
    tokens = list(tokens)
    if not exact:
        aggs = []
        for c in cols:
            s = F.col(c).cast("string")
            aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}__n_null"),
                     F.count_if(s.isin(tokens)).alias(f"{c}__n_token"),
                     F.approx_count_distinct(c).alias(f"{c}__n_distinct")]
        one = df.agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
        recs = [F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__n_null").alias("n_null"),
                         F.col(f"{c}__n_token").alias("n_token"),
                         F.col(f"{c}__n_distinct").alias("n_distinct")) for c in cols]
        return (one.select("n_rows", F.explode(F.array(*recs)).alias("r"))
                   .select("r.column_name", "n_rows", "r.n_null", "r.n_token", "r.n_distinct"))
    counts = _long(df, cols, "string").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    return (counts.groupBy("column_name")
            .agg(F.sum("n").alias("n_rows"),
                 F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
                 F.coalesce(F.sum(F.when(F.col("value").isin(tokens), F.col("n"))), F.lit(0)).alias("n_token"),
                 F.count("value").alias("n_distinct")))


def value_distribution(df: DataFrame, col: str) -> DataFrame:
    """Q9 univariate: count per value (NULL kept as its own group)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Q9 bivariate: long contingency table (a, b, n)."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def contingency_wide(df: DataFrame, a: str, b: str, values: list | None = None) -> DataFrame:
    """Q9 bivariate, one column per value of ``b`` (pass ``values`` to avoid
    the extra distinct job)."""
    return df.groupBy(a).pivot(b, values).agg(F.count(F.lit(1)))
