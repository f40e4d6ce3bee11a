"""Exact global ranks without a one-partition window (T2-T5 and friends).

``exact_row_number`` is the scalable form of
``row_number() over (partition by P order by O)`` for low-cardinality P
(a class label, nothing at all): rows are range-partitioned on (P, O) so
one hot class is spread over many tasks, each task numbers its rows, and a
small table of per-(task, P) counts gives every task its offset.  The
tagged frame is checkpointed (reliably) so partition ids and row ids are
pinned even if an executor is lost between the two passes.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callrank.functions.expressions import safe_ratio
from callrank.session import cut_lineage, default_parallelism, join_small


def bucket_desc(df: DataFrame, col: str, cuts: list[float], out: str = "_b") -> DataFrame:
    """``out`` = number of cut points strictly above ``col`` (0 = the highest
    values), by binary search (Bucketizer, JVM side), so thousands of cut
    points cost log2(B) comparisons per row."""
    from pyspark.ml.feature import Bucketizer
    if not cuts:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf")] + [float(c) for c in cuts] + [float("inf")]
    tmp = f"{out}__asc"
    b = Bucketizer(splits=splits, inputCol=f"{out}__x", outputCol=tmp, handleInvalid="keep").transform(
        df.withColumn(f"{out}__x", F.col(col).cast("double")))
    return b.withColumn(out, (F.lit(len(cuts)) - F.col(tmp)).cast("int")).drop(tmp, f"{out}__x")


def _order(col) -> Column:
    return F.col(col).asc() if isinstance(col, str) else col


def exact_row_number(df: DataFrame, order: Iterable, partition: Iterable[str] = (),
                     name: str = "rn", num_partitions: int | None = None) -> DataFrame:
    """Exact 1-based row number within ``partition`` by ``order``.

    ``order`` must make rows unique (add a key) for a stable result.  The
    per-(task, partition-key) table has at most tasks x keys rows."""
    order = [_order(c) for c in order]
    part = list(partition)
    n = num_partitions or default_parallelism(df.sparkSession)
    keys = [F.col(p).asc() for p in part] + order
    tagged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = cut_lineage(tagged)
    stats = tagged.groupBy("_pid", *part).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = Window.partitionBy(*part).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    s = stats.select(F.col("_pid").alias("_spid"), *[F.col(p).alias(f"_s_{p}") for p in part], "_off", "_first")
    cond = [F.col("_pid") == F.col("_spid")] + [F.col(p).eqNullSafe(F.col(f"_s_{p}")) for p in part]
    out = join_small(tagged, s, cond)  # tasks x keys rows, size checked before broadcast
    out = out.withColumn(name, F.col("_off") + F.col("_mid") - F.col("_first") + 1)
    return out.drop("_pid", "_mid", "_spid", "_off", "_first", *[f"_s_{p}" for p in part])


def ntile_from_rank(rn, n, k: int) -> Column:
    """The bucket that ``ntile(k)`` gives the row at 1-based position ``rn``
    of ``n``: the first ``n mod k`` buckets hold one row more."""
    rn = F.col(rn) if isinstance(rn, str) else rn
    q = F.floor(n / F.lit(k))
    r = n - q * F.lit(k)
    big = r * (q + 1)
    return F.when(rn <= big, F.ceil(F.try_divide(rn, q + 1))).otherwise(
        r + F.ceil(F.try_divide(rn - big, q))).cast("int")


def top_fraction(df: DataFrame, score: str, key: Iterable[str], fraction: float = 0.1,
                 rank_col: str = "call_rank", rel_error: float = 1e-3) -> DataFrame:
    """T4 exact: the first ceil(n * fraction) rows by score desc, key asc,
    with their rank (the ranked call list).

    Only a candidate set is sorted: t0 = approximate (1 - f - 2e) quantile
    of the score has at least ceil(n f) rows at or above it (quantile rank
    error <= e n), so every row of the answer has score >= t0.  If the
    guarantee does not hold (tiny n) all rows are candidates."""
    key = list(key)
    n = df.agg(F.count(F.lit(1))).scalar()
    q = max(0.0, 1.0 - fraction - 2 * rel_error)
    t0 = df.approxQuantile(score, [q], rel_error) if q > 0 else []
    cand = df
    if t0:
        k = df.agg(F.ceil(F.count(F.lit(1)) * F.lit(fraction)).alias("k"),
                   F.count_if(F.col(score) >= F.lit(t0[0])).alias("a")).first()
        if k["a"] >= k["k"]:  # the guarantee holds: rank only the candidates
            cand = df.where(F.col(score) >= F.lit(t0[0]))
    ranked = exact_row_number(cand, [F.col(score).desc()] + [F.col(c).asc() for c in key], name=rank_col)
    return ranked.where(F.col(rank_col) <= F.ceil(n * F.lit(fraction)))


def top_fraction_approx(df: DataFrame, score: str, fraction: float = 0.1,
                        accuracy: int = 10000) -> DataFrame:
    """T4 scalable approximate: threshold = percentile_approx(score, 1 - f)."""
    t = df.agg(F.percentile_approx(score, 1.0 - fraction, accuracy)).scalar()
    return df.where(F.col(score) >= t)


def equal_count_bins(df: DataFrame, score: str, key: Iterable[str], bins: int = 10,
                     name: str = "bin", buckets: int | None = None, rel_error: float = 1e-3) -> DataFrame:
    """Exact ``ntile(bins) over (order by score desc, key asc)`` without a
    global sort.

    Scores are cut into buckets at approximate quantiles (bounded cut
    points), rows are counted per bucket (bounded table), and the rank range
    of every bucket follows from the counts.  A bucket whose whole range
    lies in one bin gets that bin directly; only the (at most bins - 1)
    buckets that straddle a bin edge are ranked row by row, by
    ``exact_row_number``."""
    key = list(key)
    B = buckets or max(4 * bins, 4 * default_parallelism(df.sparkSession))
    cuts = sorted(set(df.approxQuantile(score, [i / B for i in range(1, B)], rel_error)))
    x = bucket_desc(df, score, cuts, "_b")  # 0 = highest scores
    # NULL scores come last, as in the window's order: a bucket below all others
    x = x.withColumn("_b", F.when(F.col(score).isNull(), F.lit(len(cuts) + 2)).otherwise(F.col("_b")))
    counts = sorted((r["_b"], r["n"]) for r in x.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect())
    n = sum(c for _, c in counts)
    if n == 0:
        return x.withColumn(name, F.lit(None).cast("int")).drop("_b")
    q, r = divmod(n, bins)

    def bin_of(pos):  # ntile of a 1-based position
        big = r * (q + 1)
        return (pos - 1) // (q + 1) + 1 if pos <= big else r + (pos - big - 1) // q + 1

    pure, mixed, start = {}, {}, 0
    for b, c in counts:
        lo, hi = start + 1, start + c
        if bin_of(lo) == bin_of(hi):
            pure[b] = bin_of(lo)
        else:
            mixed[b] = start
        start = hi
    direct = x.where(~F.col("_b").isin(list(mixed))) if mixed else x
    # bucket ids are dense: a constant array, looked up by position
    bins_of = F.array(*[F.lit(pure.get(b)).cast("int") for b in range(len(cuts) + 3)])
    out = direct.withColumn(name, F.get(bins_of, F.col("_b")))
    if mixed:
        offs = []
        for b, v in mixed.items():
            offs += [F.lit(b), F.lit(v)]
        edge = exact_row_number(x.where(F.col("_b").isin(list(mixed))),
                                [F.col(score).desc()] + [F.col(k).asc() for k in key], ["_b"],
                                name="_rn")
        pos = F.create_map(*offs)[F.col("_b")] + F.col("_rn")
        edge = edge.withColumn(name, ntile_from_rank(pos, F.lit(n), bins)).drop("_rn")
        out = out.unionByName(edge)
    return out.drop("_b")


def gains_table(df: DataFrame, score: str, key: Iterable[str], label: str = "label",
                bins: int = 10, cuts: list[float] | None = None) -> DataFrame:
    """T5: conversions and lift per score bin, best bin first.

    Default: exact equal-count bins (same rows as ``ntile(bins)`` over score
    desc, key asc; see ``equal_count_bins``).  With ``cuts`` (ascending
    fixed cut points) rows are binned by value in one pass; bin 1 is then
    the highest score band."""
    key = list(key)
    if cuts is None:
        binned = equal_count_bins(df, score, key, bins)
    else:
        above = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col(score)))
        binned = df.withColumn("bin", (F.lit(len(cuts) + 1) - above).cast("int"))
    g = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"),
                                  F.sum(F.col(label)).cast("bigint").alias("converted"),
                                  F.min(score).alias("min_score"), F.max(score).alias("max_score"))
    base = g.agg(safe_ratio(F.sum("converted"), F.sum("n"))).scalar()
    total_conv = g.agg(F.sum("converted")).scalar()
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # <= bins rows
    return (g.withColumn("rate", safe_ratio(F.col("converted"), F.col("n")))
             .withColumn("lift", safe_ratio(F.col("rate"), base))
             .withColumn("cum_converted", F.sum("converted").over(upto))
             .withColumn("cum_gain", safe_ratio(F.col("cum_converted"), total_conv))
             .orderBy("bin"))


def leaderboard(results: DataFrame, metric: str = "auc", name: str = "model") -> DataFrame:
    """Models by metric, best first."""
    return results.orderBy(F.desc(metric), F.asc(name))


def top_k(df: DataFrame, by: str, k: int, tiebreak: str | None = None) -> DataFrame:
    """The k largest rows (TakeOrderedAndProject: k rows per task)."""
    keys = [F.desc(by)] + ([F.asc(tiebreak)] if tiebreak else [])
    return df.orderBy(*keys).limit(k)
