"""T2 on the balanced path: prepared set (E11) -> SMOTE of the train split
(E8) -> decision tree, forest, boosted trees (M1, M2, M4) and the winner of
the grid with SMOTE inside each fold (M5 over E9) -> ROC-AUC on the untouched
test split (H1), best model first."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callrank.operators import evaluate, models, ranking, resample, split, tuning
from callrank.plans.prepare import encode_on_train
from callrank.session import scratch_path
from callrank.spec import FeatureSpec

TUNED = "tuned_boosted_trees"


@dataclass
class Leaderboard:
    board: DataFrame       # model, auc, params: one row a model, best first
    balanced: DataFrame    # resampled train split: key, copy, features, label, synthetic
    scores: DataFrame      # model, key, label, score of the test rows (not of the tuned model)
    search: DataFrame      # every setting of the grid
    models: Mapping[str, object]


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def balance(encoded: DataFrame, spec: FeatureSpec, k: int = 5, split_col: str = "split") -> DataFrame:
    """E8 on the train split only: its rows and the synthetic ones.  The label
    codes of the categorical columns are resampled as categories."""
    codes = [f"{c}_idx" for c in spec.categorical]
    own = encoded.where(F.col(split_col) == "train")
    return resample.smote(own, [*spec.numeric, *codes], spec.label, list(spec.key), k, spec.seed, nominal=codes)


def balanced_leaderboard(prepared: DataFrame, spec: FeatureSpec, grid: Mapping[str, list], classifiers: Mapping | None = None,
                         folds: int = 3, k: int = 5, split_col: str = "split") -> Leaderboard:
    """The four-row leaderboard of a ``prepared`` set.

    Models learn from the balanced train split; the tuned one is chosen by the
    AUC of folds whose training part alone is resampled, and its ``auc`` is
    that of the fit on all folds (``tuning.search``).  Test rows are original in
    every case.
    ``tuning.refit`` makes the winner an MLlib model of any size.  Numeric
    features must not be null; the spec needs a key."""
    names = [*spec.numeric, *[f"{c}_idx" for c in spec.categorical]]
    encoded = _written(encode_on_train(prepared, spec, split_col), "encoded")
    vec = VectorAssembler(inputCols=names, outputCol="features")
    balanced = _written(balance(encoded, spec, k, split_col), "balanced")
    train, test = vec.transform(balanced), vec.transform(encoded.where(F.col(split_col) == "test"))
    classifiers = classifiers or {
        "decision_tree": models.decision_tree(label=spec.label, max_depth=5, seed=spec.seed),
        "random_forest": models.random_forest(label=spec.label, trees=100, max_depth=10, seed=spec.seed),
        "boosted_trees": models.boosted_trees(label=spec.label, rounds=100, max_depth=5, step=0.1, seed=spec.seed)}
    fitted, scores = {}, None
    for name, classifier in classifiers.items():
        fitted[name] = classifier.fit(train)
        one = models.predict(fitted[name], test, [*spec.key, spec.label])
        one = one.select(F.lit(name).alias("model"), *spec.key, spec.label, F.col("p_yes").alias("score"))
        scores = one if scores is None else scores.unionByName(one)
    scores = _written(scores, "board-scores")
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in spec.key])
    plain = vec.transform(split.stratified_folds(encoded.where(F.col(split_col) == "train"), spec.label, list(spec.key), folds, spec.seed))
    rows = tuning.smote_folded(plain.withColumn("_key", key), "fold", "_key", label=spec.label, test=test.withColumn("_key", key),
                               folds=folds, k=k, seed=spec.seed, nominal=len(spec.categorical))
    search = tuning.search(rows, grid, folds, spec.seed)
    search = _written(search, "board-search")
    fixed = evaluate.roc_auc(scores, spec.label, "score", ["model"]).select("model", "auc", F.lit(None).cast("string").alias("params"))
    tuned = search.where("best").select(F.lit(TUNED).alias("model"), F.col("test_auc").alias("auc"), "params")
    return Leaderboard(ranking.leaderboard(fixed.unionByName(tuned), "auc", "model"), balanced, scores, search, fitted)
