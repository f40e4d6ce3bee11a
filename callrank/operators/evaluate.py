"""Evaluation on a (label, score[, prediction]) frame.

Everything is built on ``score_table``: one row per distinct score (per
group, e.g. per model) with running positive/negative counts in descending
score order.  Running sums are computed without a one-partition window:
rows are first collapsed to distinct scores (a hot score becomes one row),
cut into buckets by approximate quantiles of the distinct scores, and each
bucket adds the exact totals of the buckets above it.  The result is exact
at any size; only bucket cut points (a bounded array) are approximate, and
they only affect the work split.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callrank.functions.expressions import safe_ratio
from callrank.operators.ranking import bucket_desc
from callrank.session import cut_lineage, default_parallelism, join_small


def _cnt() -> Column:
    return F.count(F.lit(1))


def score_table(df: DataFrame, label: str = "label", score: str = "score",
                groups: Iterable[str] = (), buckets: int | None = None) -> DataFrame:
    """Per (groups, distinct score): pos, neg, tp/fp (counts with score >= s),
    n_pos/n_neg (group totals), position (1 = highest score) and next_pos /
    next_neg, the counts of the next lower score (NULL at the lowest)."""
    G = list(groups)
    g = (df.where(F.col(score).isNotNull())
           .groupBy(*G, score)
           .agg(F.sum(F.col(label).cast("long")).alias("pos"), _cnt().alias("_c"))
           .withColumn("neg", F.col("_c") - F.col("pos")).drop("_c"))
    # read three times below (cut points, bucket totals, rows): aggregate the
    # input once and keep the narrow distinct-score table in the shared folder
    g = cut_lineage(g)
    B = buckets or max(16, 4 * default_parallelism(df.sparkSession))
    # B - 1 cut points (bounded) at quantiles of the distinct (group, score)
    # rows, pooled over groups: every bucket, hence every (group, bucket)
    # window, holds at most about 1/B of the rows
    pts = sorted(set(g.approxQuantile(score, [i / B for i in range(1, B)], 1.0 / (4 * B))))
    g = bucket_desc(g, score, pts, "_b")
    tot = g.groupBy(*G, "_b").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"), _cnt().alias("_bc"),
                                  F.max(F.struct(score, "pos", "neg")).alias("_top"))
    above = Window.partitionBy(*G).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*G)
    off = (tot.withColumn("_op", F.coalesce(F.sum("_bp").over(above), F.lit(0)))
              .withColumn("_on", F.coalesce(F.sum("_bn").over(above), F.lit(0)))
              .withColumn("_oc", F.coalesce(F.sum("_bc").over(above), F.lit(0)))
              .withColumn("n_pos", F.sum("_bp").over(whole))
              .withColumn("n_neg", F.sum("_bn").over(whole))
              # the first score of the bucket below follows the last one here
              .withColumn("_below", F.lead("_top").over(Window.partitionBy(*G).orderBy("_b")))
              .drop("_bp", "_bn", "_bc", "_top"))
    down = Window.partitionBy(*G, "_b").orderBy(F.desc(score))
    inb = down.rowsBetween(Window.unboundedPreceding, 0)
    return (join_small(g, off, [*G, "_b"])  # groups x buckets rows
             .withColumn("tp", F.col("_op") + F.sum("pos").over(inb))
             .withColumn("fp", F.col("_on") + F.sum("neg").over(inb))
             .withColumn("position", F.col("_oc") + F.row_number().over(inb))
             .withColumn("next_pos", F.coalesce(F.lead("pos").over(down), F.col("_below.pos")))
             .withColumn("next_neg", F.coalesce(F.lead("neg").over(down), F.col("_below.neg")))
             .drop("_op", "_on", "_oc", "_b", "_below"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score",
            groups: Iterable[str] = (), buckets: int | None = None) -> DataFrame:
    """H1 (H7 with groups): exact ROC-AUC, ties counted half; NULL when only
    one class is present.  Integer numerator, so the value is exact."""
    return auc_of(score_table(df, label, score, groups, buckets), groups)


def auc_of(st: DataFrame, groups: Iterable[str] = ()) -> DataFrame:
    """H1 from a ``score_table``."""
    G = list(groups)
    num = F.sum((F.col("neg") * (F.lit(2) * F.col("tp") - F.col("pos"))).cast("decimal(38,0)"))
    out = st.groupBy(*G).agg(num.alias("_num"), F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"))
    den = F.lit(2.0) * F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    return out.select(*G, F.when(den > 0, F.col("_num").cast("double") / den).alias("auc"), "n_pos", "n_neg")


def average_precision(df: DataFrame, label: str = "label", score: str = "score",
                      groups: Iterable[str] = (), buckets: int | None = None) -> DataFrame:
    """H2: average precision = sum over thresholds of (R_n - R_{n-1}) * P_n."""
    return average_precision_of(score_table(df, label, score, groups, buckets), groups)


def average_precision_of(st: DataFrame, groups: Iterable[str] = ()) -> DataFrame:
    """H2 from a ``score_table``."""
    G = list(groups)
    term = F.col("pos").cast("double") * (F.col("tp").cast("double") / (F.col("tp") + F.col("fp")).cast("double"))
    return (st.groupBy(*G).agg(F.sum(term).alias("_s"), F.max("n_pos").alias("n_pos"))
              .select(*G, F.when(F.col("n_pos") > 0, F.col("_s") / F.col("n_pos").cast("double"))
                      .alias("average_precision")))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score",
              groups: Iterable[str] = (), drop_intermediate: bool = False,
              buckets: int | None = None) -> DataFrame:
    """H6: (threshold, fpr, tpr) from the highest score down, starting at
    (+inf, 0, 0).  ``drop_intermediate`` drops points whose fpr and tpr
    steps both equal the step after (collinear); the first and the last
    score stay."""
    return roc_curve_of(score_table(df, label, score, groups, buckets), score, groups, drop_intermediate)


def roc_curve_of(st: DataFrame, score: str = "score", groups: Iterable[str] = (),
                 drop_intermediate: bool = False) -> DataFrame:
    """H6 from a ``score_table``, which carries the next step of every point:
    no join on positions and no window beyond its buckets."""
    G = list(groups)
    pts = st.select(*G, F.col(score).cast("double").alias("threshold"), "position", "tp", "fp", "n_pos", "n_neg",
                    "pos", "neg", "next_pos", "next_neg")
    start = (st.where(F.col("position") == 1)
               .select(*G, F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("position"),
                       F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), "n_pos", "n_neg"))
    if drop_intermediate:
        pts = pts.where((F.col("position") == 1) | F.col("next_pos").isNull()
                        | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg")))
    pts = pts.drop("pos", "neg", "next_pos", "next_neg")
    pts = pts.unionByName(start)
    return pts.select(*G, "threshold", "position",
                      safe_ratio(F.col("fp"), F.col("n_neg")).alias("fpr"),
                      safe_ratio(F.col("tp"), F.col("n_pos")).alias("tpr"))


def pr_curve(df: DataFrame, label: str = "label", score: str = "score",
             groups: Iterable[str] = (), buckets: int | None = None) -> DataFrame:
    """H8: (threshold, precision, recall) per distinct score."""
    G = list(groups)
    st = score_table(df, label, score, G, buckets)
    return st.select(*G, F.col(score).cast("double").alias("threshold"), "position",
                     safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                     safe_ratio(F.col("tp"), F.col("n_pos")).alias("recall"))


def _rates(tp, fp, fn, tn) -> list[Column]:
    zero = F.lit(0.0)
    prec = F.coalesce(safe_ratio(tp, tp + fp), zero)
    rec = F.coalesce(safe_ratio(tp, tp + fn), zero)
    f1 = F.coalesce(safe_ratio(F.lit(2) * tp, F.lit(2) * tp + fp + fn), zero)
    acc = safe_ratio(tp + tn, tp + fp + fn + tn)
    return [acc.alias("accuracy"), prec.alias("precision"), rec.alias("recall"), f1.alias("f1")]


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """H3: accuracy, precision, recall, F1 of class 1 (0 on a zero denominator)."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    c = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
               F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    return c.select("tp", "fp", "fn", "tn", *_rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def model_evaluation(df: DataFrame, name: str, label: str = "label", prediction: str = "prediction",
                     score: str | None = None) -> DataFrame:
    """H3: the evaluation of one model as a row: model, accuracy, precision,
    recall, f1 (of class 1) and roc_auc, NULL for a model without scores or
    rows of one class only.  Rows of several models can be put in one table."""
    auc = roc_auc(df, label, score).select("auc").scalar() if score else F.lit(None).cast("double")
    one = binary_metrics(df, label, prediction).select("accuracy", "precision", "recall", "f1")
    return one.select(F.lit(name).alias("model"), "*", auc.alias("roc_auc"))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction",
                     classes: tuple = (0, 1)) -> DataFrame:
    """H5: (actual, predicted, n) for every cell of the class grid, zero cells
    kept; one conditional-count pass, no join."""
    aggs = [F.count_if((F.col(label) == a) & (F.col(prediction) == p)).alias(f"c_{i}_{j}")
            for i, a in enumerate(classes) for j, p in enumerate(classes)]
    one = df.agg(*aggs)
    recs = [F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"c_{i}_{j}").alias("n"))
            for i, a in enumerate(classes) for j, p in enumerate(classes)]
    return one.select(F.explode(F.array(*recs)).alias("r")).select("r.*")


def confusion_wide(cm: DataFrame) -> DataFrame:
    """H5 as a 2-D table: rows actual, one column per predicted class."""
    return cm.groupBy("actual").pivot("predicted").agg(F.sum("n")).orderBy("actual")


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """H4: per-class precision/recall/F1/support, accuracy, macro and
    weighted averages, as rows (row_name, precision, recall, f1, support)."""
    cm = binary_metrics(df, label, prediction)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)

    def prf(t, f_p, f_n):
        p = F.coalesce(safe_ratio(t, t + f_p), zero)
        r = F.coalesce(safe_ratio(t, t + f_n), zero)
        f = F.coalesce(safe_ratio(F.lit(2) * t, F.lit(2) * t + f_p + f_n), zero)
        return p, r, f

    p1, r1, f1 = prf(tp, fp, fn)
    p0, r0, f0 = prf(tn, fn, fp)
    s1, s0 = tp + fn, tn + fp
    n = s0 + s1
    acc = safe_ratio(tp + tn, n)

    def rec(name, p, r, f, s):
        return F.struct(F.lit(name).alias("row_name"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1"),
                        s.cast("long").alias("support"))

    w0, w1 = safe_ratio(s0, n), safe_ratio(s1, n)
    rows = [rec("0", p0, r0, f0, s0), rec("1", p1, r1, f1, s1),
            rec("accuracy", F.lit(None), F.lit(None), acc, n),
            rec("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
            rec("weighted avg", p0 * w0 + p1 * w1, r0 * w0 + r1 * w1, f0 * w0 + f1 * w1, n)]
    return cm.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def best_threshold(df: DataFrame, label: str = "label", score: str = "score",
                   metric: str = "f1", fp_cost: float = 1.0, fn_cost: float = 1.0,
                   groups: Iterable[str] = ()) -> DataFrame:
    """H9 over all distinct scores: the threshold with the best F1 (ties: the
    higher threshold) or the lowest cost fp*fp_cost + fn*fn_cost."""
    G = list(groups)
    st = score_table(df, label, score, G).withColumn("fn", F.col("n_pos") - F.col("tp"))
    if metric == "f1":
        val = F.coalesce(safe_ratio(F.lit(2) * F.col("tp"), F.lit(2) * F.col("tp") + F.col("fp") + F.col("fn")),
                         F.lit(0.0))
        best = F.max(F.struct(val.alias("v"), F.col(score).cast("double").alias("t")))
    else:
        val = F.col("fp") * F.lit(float(fp_cost)) + F.col("fn") * F.lit(float(fn_cost))
        best = F.min(F.struct(val.alias("v"), (-F.col(score).cast("double")).alias("nt")))
    out = st.groupBy(*G).agg(best.alias("b"))
    t = F.col("b.t") if metric == "f1" else -F.col("b.nt")
    return out.select(*G, t.alias("threshold"), F.col("b.v").alias(metric if metric == "f1" else "cost"))


def threshold_grid(df: DataFrame, label: str = "label", score: str = "score",
                   thresholds: Iterable[float] | None = None) -> DataFrame:
    """H9 on a fixed grid (default 0.05..0.95 step 0.05): confusion counts and
    rates per threshold, all thresholds in one conditional-count pass."""
    ts = list(thresholds) if thresholds is not None else [round(0.05 * i, 2) for i in range(1, 20)]
    y, s = F.col(label) == 1, F.col(score)
    aggs = [F.count_if(y).alias("n_pos"), F.count_if(~y).alias("n_neg")]
    for i, t in enumerate(ts):
        aggs += [F.count_if(y & (s >= t)).alias(f"tp{i}"), F.count_if(~y & (s >= t)).alias(f"fp{i}")]
    one = df.agg(*aggs)
    recs = [F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"))
            for i, t in enumerate(ts)]
    r = one.select("n_pos", "n_neg", F.explode(F.array(*recs)).alias("r"))
    r = r.select(F.col("r.threshold").alias("threshold"), F.col("r.tp").alias("tp"), F.col("r.fp").alias("fp"),
                 (F.col("n_pos") - F.col("r.tp")).alias("fn"), (F.col("n_neg") - F.col("r.fp")).alias("tn"))
    return r.select("*", *_rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def model_comparison(long: DataFrame, model: str = "model", label: str = "label",
                     score: str = "score") -> DataFrame:
    """AUC per model from a long (model, label, score) table, best first."""
    return roc_auc(long, label, score, [model]).orderBy(F.desc("auc"), F.asc(model))
