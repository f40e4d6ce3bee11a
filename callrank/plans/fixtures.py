"""Bindings of the test tables to the campaign roles (see FIXTURES.md).

ORD: orders, positive = status 'F', segment = priority, month of order date.
LIN: lineitem, positive = return flag 'R', line number 7 plays the
     "never contacted" sentinel, ship date the leakage column.
DOC: labels joined to documents, label = 1 - quality (imbalanced),
     integer features n_chars, toxic, length(text) % 50.
SCO: DOC plus given scores for three "models" (many ties on purpose).

Each loader reads only the columns it needs so the parquet scan is pruned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callrank.functions.expressions import binary_target

# Fixed values of the bindings (roles given to the test tables).
ORD_POSITIVE = "F"
ORD_TOKEN = "4-NOT SPECIFIED"
LIN_POSITIVE = "R"
LIN_SENTINEL = 7
LIN_KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
SCO_CUT = 48


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def ord_frame(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    cols = cols or ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    need = list(dict.fromkeys([*cols, "o_orderstatus", "o_orderdate"]))
    df = table(spark, sf_dir, "orders", *need)
    return (df.withColumn("label", binary_target("o_orderstatus", ORD_POSITIVE))
              .withColumn("month", F.month("o_orderdate")))


def lin_frame(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    cols = cols or (*LIN_KEY, "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    need = list(dict.fromkeys([*cols, "l_returnflag"]))
    return table(spark, sf_dir, "lineitem", *need).withColumn("label", binary_target("l_returnflag", LIN_POSITIVE))


def doc_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    docs = table(spark, sf_dir, "documents", "doc_id", "n_chars", "text")
    return (labels.join(docs, "doc_id")
                  .select("doc_id", (F.lit(1) - F.col("quality")).alias("label"), "n_chars", "toxic",
                          (F.length("text") % 50).alias("len_mod")))


def sco_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = doc_frame(spark, sf_dir)
    return d.select("doc_id", "label", "n_chars", "toxic", "len_mod",
                    (F.col("n_chars") % 97).alias("score_a"),
                    (F.col("n_chars") % 13).alias("score_b"),
                    F.col("toxic").alias("score_c"),
                    ((F.col("n_chars") % 97) >= SCO_CUT).cast("int").alias("prediction"),
                    ((F.col("n_chars") % 97) / F.lit(97.0)).alias("probability"))


def sco_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, doc_id, label, score) for the three given scores."""
    s = sco_frame(spark, sf_dir)
    return (s.select("doc_id", "label", "score_a", "score_b", "score_c")
             .unpivot(["doc_id", "label"], ["score_a", "score_b", "score_c"], "model", "score")
             .withColumn("model", F.substring("model", 7, 1))
             .withColumn("score", F.col("score").cast("double")))
