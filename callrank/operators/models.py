"""Tree models, tuning and model reports (M1-M9) on pyspark.ml.

Every fit is distributed; only fitted trees, parameter maps and metrics
(bounded) reach the driver.
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callrank.operators.forest import CellForest, CountedBoosting, FlatForest
from callrank.session import default_parallelism, written_small


def _mb(text: str) -> int:
    t = text.strip().lower()
    units = {"k": 1 / 1024, "m": 1, "g": 1024, "t": 1024 * 1024}
    if t and t[-1] == "b":
        t = t[:-1]
    return int(float(t[:-1]) * units[t[-1]]) if t and t[-1] in units else int(t)  # bare number: MiB


def tree_memory_mb(spark: SparkSession | None = None) -> int:
    """Split-statistics budget per task: the heap of one executor shared by
    its task slots, an eighth of each slot's share, between 16 and 256 MB."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return 64
    conf = spark.sparkContext.getConf()
    master = conf.get("spark.master", "local[*]")
    if master.startswith("local"):
        mem = conf.get("spark.driver.memory", "1g")
        n = master[master.find("[") + 1:master.find("]")] if "[" in master else "1"
        cores = (os.cpu_count() or 1) if n.startswith("*") else int(n.split(",")[0])
    else:
        mem = conf.get("spark.executor.memory", "1g")
        cores = int(conf.get("spark.executor.cores", "1"))
    return int(max(16, min(256, _mb(mem) // (8 * max(cores, 1)))))


def decision_tree(features: str = "features", label: str = "label", max_depth: int = 5,
                  seed: int = 42, max_bins: int = 64, weight: str | None = None) -> DecisionTreeClassifier:
    """M1: single tree, depth 5."""
    m = DecisionTreeClassifier(featuresCol=features, labelCol=label, maxDepth=max_depth, seed=seed,
                               maxBins=max_bins)
    return m.setWeightCol(weight) if weight else m


def random_forest(features: str = "features", label: str = "label", trees: int = 100, max_depth: int = 10,
                  seed: int = 42, min_leaf: int = 1, weight: str | None = None,
                  max_bins: int = 64, memory_mb: int | None = None) -> RandomForestClassifier:
    """M2: forest of 100 trees of depth 10, sqrt(features) per split, grown on
    counted cells (``forest.CellForest``).

    Data that do not collapse are fitted by MLlib on rows: ``memory_mb``
    bounds the split statistics one task aggregates per pass
    (several tasks share an executor heap).  Deep forests cache node ids
    on the executors (instead of shipping the growing trees every pass),
    with the cache checkpointed every 10 passes to the shared folder."""
    m = CellForest(featuresCol=features, labelCol=label, numTrees=trees, maxDepth=max_depth,
                   featureSubsetStrategy="sqrt", seed=seed, minInstancesPerNode=min_leaf,
                   maxBins=max_bins, maxMemoryInMB=memory_mb or tree_memory_mb(),
                   cacheNodeIds=max_depth > 8, checkpointInterval=10)
    return m.setWeightCol(weight) if weight else m


def balanced_forest(features: str = "features", label: str = "label", weight: str = "weight",
                    trees: int = 300, max_depth: int = 12, min_leaf: int = 20, seed: int = 42) -> RandomForestClassifier:
    """M3: 300 trees, depth 12, leaf >= 20 rows, balanced class weights
    (E5 ``with_class_weight`` supplies ``weight``)."""
    return random_forest(features, label, trees, max_depth, seed, min_leaf, weight)


def boosted_trees(features: str = "features", label: str = "label", rounds: int = 100, max_depth: int = 5,
                  step: float = 0.1, seed: int = 42, subsample: float = 1.0) -> GBTClassifier:
    """M4: gradient-boosted trees (first-order boosting, logistic loss), fitted
    on distinct rows weighted by their counts where no row is drawn."""
    return CountedBoosting(featuresCol=features, labelCol=label, maxIter=rounds, maxDepth=max_depth,
                           stepSize=step, seed=seed, subsamplingRate=subsample, checkpointInterval=10)


def auc_evaluator(label: str = "label", raw: str = "rawPrediction") -> BinaryClassificationEvaluator:
    return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=raw, metricName="areaUnderROC")


def grid_search(estimator, grid: Mapping[str, list], folds: int = 3, fold_col: str | None = None,
                parallelism: int = 4, seed: int = 42, label: str = "label",
                param_owner=None) -> CrossValidator:
    """M5: grid x folds by AUC, best refit.  ``grid`` maps parameter names of
    ``param_owner`` (default: the estimator) to value lists.  With
    ``fold_col`` (E7) the folds are the stratified ones."""
    owner = param_owner or estimator
    b = ParamGridBuilder()
    for name, values in grid.items():
        b = b.addGrid(owner.getParam(name), list(values))
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=b.build(), evaluator=auc_evaluator(label),
                        numFolds=folds, parallelism=parallelism, seed=seed)
    return cv.setFoldCol(fold_col) if fold_col else cv


def cv_results(spark: SparkSession, cv_model) -> DataFrame:
    """M6: one row per setting: params (JSON), mean and std of the fold AUC,
    and whether it is the best (the refit) one."""
    maps = cv_model.getEstimatorParamMaps()
    avg = list(cv_model.avgMetrics)
    std = list(getattr(cv_model, "stdMetrics", []) or [None] * len(avg))
    best = max(range(len(avg)), key=lambda i: avg[i]) if avg else -1
    rows = [(json.dumps({p.name: v for p, v in m.items()}, sort_keys=True), float(a),
             None if s is None else float(s), i == best) for i, (m, a, s) in enumerate(zip(maps, avg, std))]
    return spark.createDataFrame(rows, "params string, cv_auc double, cv_auc_std double, best boolean")


def cv_gap(cv_table: DataFrame, test_auc, threshold: float = 0.05) -> DataFrame:
    """M7: best CV AUC against test AUC; ``leak_suspected`` when CV exceeds
    test by more than ``threshold`` (resampling before folding does that)."""
    t = F.lit(float(test_auc)) if isinstance(test_auc, (int, float)) else test_auc
    return (cv_table.where("best").select("params", "cv_auc", t.alias("test_auc"))
            .withColumn("gap", F.col("cv_auc") - F.col("test_auc"))
            .withColumn("leak_suspected", F.col("gap") > threshold))


def feature_importances(spark: SparkSession, model, names: list[str]) -> DataFrame:
    """M8: (feature, importance) rows from a fitted tree model."""
    imp = model.featureImportances.toArray().tolist()
    rows = [(names[i] if i < len(names) else str(i), float(v)) for i, v in enumerate(imp)]
    return spark.createDataFrame(rows, "feature string, importance double")


def with_scores(model, df: DataFrame, probability: str = "probability") -> DataFrame:
    """``df`` and ``_p``, P(class 1), and ``_class``, the prediction, of every
    row.  Walking an ensemble's trees costs far more than a join, so it scores
    each distinct feature vector once, if these fit a broadcast; else, and
    for single trees and streams, every row."""
    stages = model.stages if isinstance(model, PipelineModel) else [model]
    *first, last = stages
    own = [vector_to_array(F.col(probability))[1].alias("_p"), F.col("prediction").alias("_class")]
    if not df.isStreaming and hasattr(last, "getNumTrees"):
        features = last.getFeaturesCol()
        rows = PipelineModel(first).transform(df).select(*[f"`{c}`" for c in df.columns], vector_to_array(F.col(features)).alias("_x"))
        seen, fits = written_small(rows.select("_x").distinct())
        if fits:
            spread = seen.repartition(default_parallelism(df.sparkSession)).select("_x", array_to_vector("_x").alias(features))
            if type(last) is RandomForestClassificationModel:
                last = FlatForest(last)
            scores, _ = written_small(last.transform(spread).select("_x", *own))
            return rows.join(F.broadcast(scores), "_x", "left").drop("_x")
    return model.transform(df).select(*[f"`{c}`" for c in df.columns], *own)


def predict(model, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """M9: P(class 1) and the 0/1 prediction for every row."""
    cols = keep if keep is not None else [c for c in df.columns]
    return with_scores(model, df).select(*cols, F.col("_p").alias("p_yes"), F.col("_class").cast("int").alias("prediction"))
