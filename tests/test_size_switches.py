"""Ranks are numbered by all tasks, and broadcasts are bounded by bytes."""

from pyspark.sql import functions as F

from callrank import session
from callrank.operators import ranking


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_call_list_has_no_window_over_rows(spark):
    df = spark.range(5000).withColumn("s", F.pmod(F.xxhash64("id"), F.lit(500)))
    got = ranking.top_fraction(df, "s", ["id"], 0.1)
    assert "Window" not in plan(got)
    want = sorted(((r["s"], r["id"]) for r in df.collect()), key=lambda r: (-r[0], r[1]))[:500]
    assert [(r["s"], r["id"]) for r in got.orderBy("call_rank").collect()] == want


def test_few_wide_rows_are_not_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = spark.range(100)
        wide = keys.withColumn("t", F.repeat(F.lit("x"), 500_000))  # 50 MB
        assert "Broadcast" not in plan(session.join_small(keys, wide, ["id"]))
        assert "Broadcast" in plan(session.join_small(keys, keys.withColumn("t", F.lit(1)), ["id"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
