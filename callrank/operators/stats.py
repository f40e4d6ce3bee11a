"""Significance of segment differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chi_square_statistic(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson chi-square of independence of ``a`` and ``b``, with dof.

    Rows with a NULL in either column are left out, as in
    ``chi_square_test``.  The rows are counted into cells once; the margins
    are sums of the cells, and n * (sum(o^2 / (row * column)) - 1) needs
    neither expected counts nor the cells that have no rows."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("o"))
    j = (cells.withColumn("rt", F.sum("o").over(Window.partitionBy(a)))
              .withColumn("ct", F.sum("o").over(Window.partitionBy(b))))
    o, margins = F.col("o").cast("double"), F.col("rt").cast("double") * F.col("ct").cast("double")
    out = j.agg(F.sum(o * o / margins).alias("_s"), F.sum("o").alias("n"),
                F.count_distinct(a).alias("_r"), F.count_distinct(b).alias("_c"))
    return out.select((F.col("n").cast("double") * (F.col("_s") - 1)).alias("statistic"),
                      ((F.col("_r") - 1) * (F.col("_c") - 1)).cast("long").alias("dof"),
                      F.col("n").cast("long").alias("n"))


def chi_square_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """H11 with p-value: pyspark.ml ChiSquareTest on indexed categories
    (distributed; the p-value comes from the JVM chi-square distribution).
    Rows with a NULL in either column are left out."""
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.stat import ChiSquareTest

    df = df.select(a, b).dropna()
    idx = StringIndexer(inputCols=[a, b], outputCols=["_a", "_b"], handleInvalid="keep",
                        stringOrderType="alphabetAsc").fit(df.select(a, b))
    x = idx.transform(df.select(a, b))
    x = VectorAssembler(inputCols=["_a"], outputCol="_f").transform(x)
    r = ChiSquareTest.test(x, "_f", "_b", flatten=True)
    return r.select(F.col("statistic").alias("statistic"), F.col("degreesOfFreedom").cast("long").alias("dof"),
                    F.col("pValue").alias("p_value"))


def two_proportion_z(df: DataFrame, flag, label: str = "label") -> DataFrame:
    """Pooled two-proportion z test between flag = true and flag = false.

    z squared equals the 1-dof chi-square of the 2x2 table, so its p-value is
    ``chi_square_test`` on (flag, label)."""
    f = F.col(flag) if isinstance(flag, str) else flag
    y = F.col(label) == 1
    c = df.agg(F.count_if(f).alias("n1"), F.count_if(f & y).alias("c1"),
               F.count_if(~f).alias("n2"), F.count_if(~f & y).alias("c2"))
    p1 = F.col("c1") / F.col("n1").cast("double")
    p2 = F.col("c2") / F.col("n2").cast("double")
    pp = (F.col("c1") + F.col("c2")) / (F.col("n1") + F.col("n2")).cast("double")
    se = F.sqrt(pp * (1 - pp) * (F.lit(1.0) / F.col("n1") + F.lit(1.0) / F.col("n2")))
    return c.select("n1", "c1", "n2", "c2", p1.alias("p1"), p2.alias("p2"),
                    F.when(se > 0, (p1 - p2) / se).alias("z"))
