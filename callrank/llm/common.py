"""Helpers shared by the operators: written tables, row keys, size checks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callrank.session import fits_broadcast, scratch_path

#: Rows of an Arrow batch handed to Python.  Documents can be very long, so
#: batches are kept small in rows to stay small in bytes.
ARROW_ROWS = 256


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared scratch folder and read it
    back: cuts lineage, survives lost executors, pins generated ids."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:8]}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of Arrow batches for the operators that run Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def ascii_lower(col: Column | str) -> Column:
    """Lower-case A-Z only; other letters stay as they are.

    ``lower`` does the same for pure ASCII text, and is much faster."""
    c = F.col(col) if isinstance(col, str) else col
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, low))


def join_checked(big: DataFrame, small: DataFrame, on: list[str], row_bytes: Column, spread: list[str],
                 salts: int = 16) -> DataFrame:
    """Inner equi-join.  ``small`` is broadcast if its size is proven to be
    within the session module's ``BROADCAST_BYTES``; beyond it both sides shuffle on the key and
    a salt (a hash of ``spread``), so one hot key of ``big`` is dealt to
    ``salts`` tasks."""
    if fits_broadcast(small, row_bytes):
        return big.join(F.broadcast(small), on)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    return dealt.join(salted, [*on, "_salt"]).drop("_salt")


def boxed(docs: DataFrame, **keys: Column) -> DataFrame:
    """The whole rows as one struct column ``row`` beside ``keys``: whatever
    the input's columns are called, they clash with nothing."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(whole.alias("row"), *[k.alias(name) for name, k in keys.items()])


def unboxed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of ``boxed`` as they were."""
    return rows.select(*[F.col("row").getField(c).alias(c) for c in columns])


#: Words of the membership map, 64 bits each: at most so many rows of two longs are broadcast, whatever the number of ids.
MAP_WORDS = 1 << 20


def likely_members(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The ``rows`` whose bigint ``key`` is probably among ``ids[key]``: all
    that are, and some that only share a bit of a map of bounded size, which
    is broadcast.  Put before a join, it keeps most other rows from the shuffle."""
    at = F.xxhash64(key)
    word = F.pmod(at, F.lit(MAP_WORDS)).cast("long").alias("_word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(at, 58).cast("int"))
    words = ids.select(word, bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    met = rows.withColumn("_word", word).join(F.broadcast(words), "_word")
    return met.where(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits")
