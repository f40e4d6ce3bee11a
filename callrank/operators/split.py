"""Stratified, repeatable split and folds.

Each row's place is decided by md5(seed:key), never by partitioning, so
the same rows are chosen after any repartition and the choice can be
re-derived in SQL.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callrank.functions.expressions import hash_hex_key, hash_unit
from callrank.operators.ranking import exact_row_number
from callrank.session import join_null_safe, join_small, scratch_path


def _h(key: list[str], seed: int):
    return hash_hex_key(seed, *key)


def _cutoffs(hashed: DataFrame, label: str, fraction: float) -> DataFrame:
    """Per class the md5 of its round(n_c * f)-th smallest row: ``_cut``, the
    rows of that very md5 (``_at``) and how many of them are still below the
    cutoff (``_take``).  Classes without a test row have no entry.

    A radix selection: counts by the first three hex digits name the one group
    that holds the cutoff, and only that group (1/4096 of a class) is read
    again, as counts per md5.  Its counts by four more digits name the next
    group, whose few rows are summed in order.  The result is a written table,
    so Spark knows its size."""
    spark = hashed.sparkSession
    before = Window.partitionBy(label).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)

    def holds(counts: DataFrame, m) -> DataFrame:
        """The group of ``counts`` in which position ``m`` of its class lies."""
        run = counts.withColumn("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        return run.where((F.col("_b") < m) & (m <= F.col("_b") + F.col("_n")))

    first = hashed.groupBy(label, F.substring("_h", 1, 3).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    first = first.withColumn("_m", F.round(F.sum("_n").over(Window.partitionBy(label)) * F.lit(fraction)))
    first = holds(first, F.col("_m")).select(
        label, F.col("_d").alias("_d1"), (F.col("_m") - F.col("_b")).cast("long").alias("_left"))
    first = _written(first, "split-digits")
    group = join_null_safe(hashed.select(label, "_h", F.substring("_h", 1, 3).alias("_d1")), first, [label, "_d1"])
    group = _written(group.groupBy(label, "_h", "_left").agg(F.count(F.lit(1)).alias("_n")), "split-group")
    digits = F.substring("_h", 1, 7)
    second = holds(group.groupBy(label, "_left", digits.alias("_d")).agg(F.sum("_n").alias("_n")), F.col("_left"))
    second = second.select(label, F.col("_d").alias("_d2"), (F.col("_left") - F.col("_b")).alias("_left"))
    last = join_null_safe(group.drop("_left").withColumn("_d2", digits), second, [label, "_d2"])
    last = holds(last.withColumn("_d", F.col("_h")), F.col("_left"))
    return _written(last.select(F.col(label).alias("_lab"), F.col("_h").alias("_cut"), F.col("_n").alias("_at"),
                                (F.col("_left") - F.col("_b")).alias("_take")), "split-cutoffs")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stratified_split(df: DataFrame, label: str, key: Iterable[str], test_fraction: float = 0.2,
                     seed: int = 42, exact: bool = True, col: str = "split") -> DataFrame:
    """Add ``split`` = 'train' / 'test'.

    exact=True: in each class the round(n_c * f) rows with the smallest
    (md5(seed:key), key) are test, so class shares are kept to one row.
    Two reads of label and key find each class's cutoff (``_cutoffs``); then
    one pass over the rows compares hashes, with no shuffle of rows unless
    the classes are too many for Spark to broadcast their cutoffs.  Rows of
    one md5 (repeated keys) that straddle a cutoff are ranked by key.
    exact=False: test when hash_unit < f (one pass, shares kept only in
    expectation)."""
    key = list(key)
    if not exact:
        return df.withColumn(col, F.when(hash_unit(seed, *key) < test_fraction, "test").otherwise("train"))
    x = df.withColumn("_h", _h(key, seed))
    cut = _cutoffs(x.select(label, "_h"), label, test_fraction)
    tied = not cut.where(F.col("_take") < F.col("_at")).isEmpty()
    x = x.join(cut, x[label].eqNullSafe(cut["_lab"]), "left")
    below = F.coalesce(F.col("_h") <= F.col("_cut"), F.lit(False))
    own = ["_h", "_lab", "_cut", "_at", "_take"]
    side = F.when(below, "test").otherwise("train")
    if not tied:
        return x.withColumn(col, side).drop(*own)
    straddles = F.coalesce((F.col("_h") == F.col("_cut")) & (F.col("_take") < F.col("_at")), F.lit(False))
    ranked = exact_row_number(x.where(straddles), key, [label], name="_rk")
    ranked = ranked.withColumn(col, F.when(F.col("_rk") <= F.col("_take"), "test").otherwise("train"))
    return x.where(~straddles).withColumn(col, side).unionByName(ranked.drop("_rk")).drop(*own)


def hash_rank(df: DataFrame, label: str | None, key: Iterable[str], seed: int = 42,
              name: str = "_rk", prefix_hex: int = 4) -> DataFrame:
    """Exact 1-based rank of every row within its class by (md5(seed:key), key).

    md5 prefixes are uniform, so the rank is (rows of the class with a
    smaller prefix, from a small offsets table) + (rank inside the row's own
    prefix, a window over an evenly sized group).  Rows are shuffled once, by
    class and prefix; the offsets (at most 65,536 rows a class) are broadcast
    once their bytes are summed.  No range sort, no checkpoint of the data."""
    key = list(key)
    part = [label] if label else []
    x = df.withColumn("_h", _h(key, seed)).withColumn("_hp", F.substring("_h", 1, prefix_hex))
    cnt = x.groupBy(*part, "_hp").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*part).orderBy("_hp").rowsBetween(Window.unboundedPreceding, -1)
    off = cnt.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*part, "_hp").orderBy("_h", *key)
    ranked = x.withColumn("_in", F.row_number().over(inside))
    out = join_small(ranked, off, [*part, "_hp"])  # NULL class kept
    return out.withColumn(name, F.col("_off") + F.col("_in")).drop("_h", "_hp", "_in", "_off")


def stratified_folds(df: DataFrame, label: str, key: Iterable[str], k: int = 3, seed: int = 42,
                     col: str = "fold") -> DataFrame:
    """fold = (per-class md5 rank - 1) mod k; each class is dealt round
    robin, so fold sizes per class differ by at most one.  Feed ``col`` to
    ``CrossValidator(foldCol=...)``."""
    ranked = hash_rank(df, label, list(key), seed, name="_rk")
    return ranked.withColumn(col, ((F.col("_rk") - 1) % k).cast("int")).drop("_rk")
