"""Connected components of an edge table: distributed union-find.

Alternates large-star and small-star steps until the edges no longer change;
then every node points to the smallest node of its component.  Each step is
one aggregation and one equi-join, written to the shared folder, so no step
holds a component in one task and no link ever reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callrank.llm.common import materialise


def _fingerprint(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"),
              F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return r["n"], r["x"], r["s"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` has bigint columns u, v.  Returns (node, root) for every node
    with a link to another node; root is the smallest node reachable.

    Self links, repeated links and either direction are allowed; null ends
    are not links.  An empty table gives an empty result.
    """
    e = edges.where((F.col("u") != F.col("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = materialise(e.distinct(), "edges")
    before = _fingerprint(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = e.select(F.col("v").alias("u"), F.col("u").alias("w")).join(low, "u")
        large = large.select(F.col("w").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u != v").distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        small = small.unionByName(low.select("u", F.col("m").alias("v")))
        e = materialise(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small-star")
        after = _fingerprint(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
