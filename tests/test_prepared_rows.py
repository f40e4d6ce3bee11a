"""The models of ``lineitem`` read its prepared rows; none is kept by an executor."""

from pyspark.sql import functions as F


def _lineitem(spark, folder):
    n = F.col("id")
    rows = spark.range(400).select(
        n.alias("l_orderkey"), (n % 40).alias("l_partkey"), (n % 7).alias("l_suppkey"), (n % 7 + 1).cast("int").alias("l_linenumber"),
        (n % 50 + 1).cast("double").alias("l_quantity"), ((n % 11) / 100).alias("l_discount"), ((n % 9) / 100).alias("l_tax"),
        F.when(n % 50 > 30, "R").otherwise("N").alias("l_returnflag"), F.when(n % 2 == 0, "F").otherwise("O").alias("l_linestatus"),
        F.lit("1995-01-01").cast("timestamp").alias("l_shipdate"))
    rows.write.parquet(f"{folder}/lineitem.parquet")


def test_importances_keep_no_prepared_rows(spark, tmp_path):
    from callrank.plans import catalog
    _lineitem(spark, tmp_path)
    got = {r["feature"]: r["importance"] for r in catalog.QUERIES["m8_feature_importances"](spark, str(tmp_path)).collect()}
    assert set(got) == {"l_quantity", "l_discount", "l_tax", "l_linenumber", "l_linestatus_F", "l_linestatus_O"}
    assert max(got, key=got.get) == "l_quantity" and abs(sum(got.values()) - 1) < 1e-9
    level = catalog._lin_prepared(spark, str(tmp_path)).storageLevel
    assert not level.useDisk and not level.useMemory
    split = catalog._lin_prepared(spark, str(tmp_path)).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"test": 80, "train": 320}
