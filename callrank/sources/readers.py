"""Sources: catalog tables, delimited files, anonymous layouts, fallbacks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callrank.functions.expressions import value_map
from callrank.operators.transforms import replace_tokens


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Catalog scan."""
    return spark.table(name)


def read_parquet(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Parquet scan; pass ``columns`` so only they are read (ReadSchema)."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns is not None else df


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                   sep: str = ";", header: bool = True) -> DataFrame:
    """S3: raw delimited scan.  Give a schema in production; without one the
    types are inferred (an extra pass, for exploration only)."""
    r = spark.read.option("header", header).option("sep", sep).option("mode", "PERMISSIVE")
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", True)
    return r.csv(path)


def load_data(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
              sep: str = ";", null_tokens: Iterable[str] = ("unknown",)) -> DataFrame:
    """Delimited scan, then the listed tokens become NULL in every string
    column (Spark's ``nullValue`` takes one token only)."""
    return replace_tokens(read_delimited(spark, path, schema, sep), null_tokens)


def from_anonymous(df: DataFrame, column_map: Mapping[str, str], target_source: str | None = None,
                   target: str = "y", target_map: Mapping | None = None,
                   categorical: Iterable[str] = ()) -> DataFrame:
    """Restore names of an anonymised layout (V1..Vn), categories to
    string, and recode the target (e.g. 1/2 -> no/yes; unmapped -> NULL)."""
    out = df.withColumnsRenamed(dict(column_map))
    cats = list(categorical)
    if cats:
        out = out.withColumns({c: F.col(c).cast("string") for c in cats})
    if target_source is not None and target_map is not None:
        out = out.withColumn(target, value_map(target_source, target_map))
        if target_source != target:
            out = out.drop(target_source)
    return out


class NoSourceError(RuntimeError):
    """None of the candidate sources could be read."""


def first_readable(candidates: Iterable[Callable[[], DataFrame]]) -> DataFrame:
    """The first candidate reader that resolves wins.  Readers are lazy;
    a missing path or table is raised at ``load``/analysis, which is what is
    caught here (no data is read to decide)."""
    errors = []
    for make in candidates:
        try:
            df = make()
            df.schema  # force analysis
            return df
        except (AnalysisException, FileNotFoundError) as e:  # noqa: PERF203
            errors.append(str(e).splitlines()[0])
    raise NoSourceError("no source could be read: " + " | ".join(errors))


def source_report(df: DataFrame, source: str) -> DataFrame:
    """What the chosen source holds, as one row: source, n_rows, n_columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(source).alias("source"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))


def literal_frame(spark: SparkSession, rows: list, schema: T.StructType | str) -> DataFrame:
    """A frame from given values (lookup tables, one-row requests)."""
    return spark.createDataFrame(rows, schema)
