"""Forests and boosted trees on counted cells: the whole job of MLlib's row by row fits."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from callrank.operators import forest, models


def _rows(spark, n=6000, times=1):
    u = [F.pmod(F.xxhash64(F.lit(i), "id"), F.lit(1000)) / 1000.0 for i in range(4)]
    df = spark.range(0, n).select("id", F.floor(u[0] * 12).cast("double").alias("a"), F.floor(u[1] * 7).cast("double").alias("b"),
                                  F.floor(u[2] * 2).cast("double").alias("c"), u[3].alias("u"))
    df = df.withColumn("label", (F.col("u") < 0.15 + 0.05 * F.col("a") + 0.1 * F.col("c")).cast("int")).drop("u")
    df = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features", handleInvalid="keep").transform(df)


def _plain(cls, ours):
    out = cls()
    return out._set(**{p.name: v for p, v in ours.extractParamMap().items() if ours.isSet(p)})


def _p(model, df):
    return np.array([r.p_yes for r in models.predict(model, df, ["id"]).orderBy("id").collect()])


def test_fit_reads_cells_not_rows(spark, monkeypatch):
    """MLlib's fit of rows, whose disk and time follow rows x trees, is not called."""
    called = []
    plain = RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, df: called.append(df.count()) or plain(self, df))
    model = models.random_forest(trees=5, max_depth=4).fit(_rows(spark))
    assert model.getNumTrees == 5 and max(called) <= 2  # the layout's own two rows


def test_forest_scores_are_those_of_mllib(spark):
    df = _rows(spark).cache()
    ours = models.random_forest(trees=60, max_depth=6)
    a, b = _p(ours.fit(df), df), _p(_plain(RandomForestClassifier, ours).fit(df), df)
    assert np.corrcoef(a, b)[0, 1] > 0.98 and abs(a - b).max() < 0.15


def test_every_row_is_drawn_and_leaves_hold_enough(spark, tmp_path):
    df = _rows(spark, 2000, 3).withColumn("weight", F.when(F.col("label") == 1, 2.0).otherwise(0.5))
    model = models.random_forest(trees=12, max_depth=8, min_leaf=40, weight="weight").fit(df)
    model.save(str(tmp_path / "m"))
    nodes = spark.read.parquet(str(tmp_path / "m" / "data")).select("treeID", "nodeData.*")
    assert nodes.where("leftChild < 0").agg(F.min("rawCount")).first()[0] >= 40
    roots = [r.rawCount for r in nodes.where("id = 0").collect()]
    assert len(roots) == 12 and abs(np.mean(roots) - 6000) < 150 and len(set(roots)) > 6
    back = RandomForestClassificationModel.load(str(tmp_path / "m"))
    assert (_p(back, df) == _p(model, df)).all()


def test_forest_repeats_under_any_partitioning(spark):
    df = _rows(spark)
    fit = [models.random_forest(trees=6, max_depth=5).fit(df.repartition(n)) for n in (1, 7)]
    assert (_p(fit[0], df) == _p(fit[1], df)).all()


def test_first_split_by_hand():
    """Two features, the second decides: best gain, its cut, and pure leaves."""
    codes = np.array([[0, 1, 0, 1], [0, 0, 1, 2]])
    t = forest.grow_tree(codes, np.array([0, 0, 1, 1]), np.array([5, 5, 3, 7]), np.ones(4), 2, [2, 3], 2, 4, 1, 0.0, 0.0, np.random.default_rng(1))
    assert t["feature"].tolist() == [1, -1, -1] and t["cut"][0] == 0 and t["gain"][0] == pytest.approx(0.5)
    assert t["stats"].tolist() == [[10, 10], [10, 0], [0, 10]] and t["raw"].tolist() == [20, 10, 10]


def test_many_values_and_missing_ones(spark):
    """More values than bins are cut at quantiles; a missing one is refused, as by MLlib."""
    df = _rows(spark).withColumn("z", F.col("id") / 7.0)
    at = VectorAssembler(inputCols=["a", "z"], outputCol="features", handleInvalid="keep")
    ours = models.random_forest(trees=5, max_depth=6)
    p = _p(ours.fit(at.transform(df.drop("features"))), at.transform(df.drop("features")))
    assert len(p) == 6000 and ((p >= 0) & (p <= 1)).all()
    odd = at.transform(df.drop("features").withColumn("z", F.when(F.col("id") != 5, F.col("z"))))
    with pytest.raises(Exception, match="NaN"):
        ours.fit(odd)


def test_too_many_cells_are_fitted_by_mllib_on_all_rows(spark, monkeypatch):
    monkeypatch.setattr(forest, "CELLS", 10)
    df = _rows(spark, 1000)
    ours = models.random_forest(trees=4, max_depth=4)
    assert (_p(ours.fit(df), df) == _p(_plain(RandomForestClassifier, ours).fit(df), df)).all()


def test_boosting_on_counts_is_boosting_on_rows(spark, monkeypatch):
    df = _rows(spark, 1500, 4).cache()
    ours = models.boosted_trees(rounds=8, max_depth=4)
    want = _p(_plain(GBTClassifier, ours).fit(df), df)
    fitted = []
    plain = GBTClassifier._fit
    monkeypatch.setattr(GBTClassifier, "_fit", lambda self, d: fitted.append(d.count()) or plain(self, d))
    got = _p(ours.fit(df), df)
    assert abs(got - want).max() < 1e-9 and fitted == [df.select("a", "b", "c", "label").distinct().count()]


def test_each_distinct_vector_is_scored_once(spark, monkeypatch):
    """Scores of all rows, as ``transform`` gives them, from one walk a vector."""
    df = _rows(spark, 500, 3)
    model = models.random_forest(trees=5, max_depth=4).fit(df)
    want = {r.id: r.probability[1] for r in model.transform(df).collect()}
    walked = []
    plain = RandomForestClassificationModel.transform
    monkeypatch.setattr(RandomForestClassificationModel, "transform", lambda self, d: walked.append(d.count()) or plain(self, d))
    got = models.predict(model, df, ["id", "copy"]).collect()
    assert len(got) == 1500 and all(r.p_yes == want[r.id] for r in got)
    assert walked == [df.select("a", "b", "c").distinct().count()]
    monkeypatch.setattr("callrank.session.BROADCAST_BYTES", 0)
    assert sorted(map(tuple, models.predict(model, df, ["id", "copy"]).collect())) == sorted(map(tuple, got))


def _saved(spark, model, path):
    from pyspark.ml import PipelineModel

    from callrank.sources import sinks
    sinks.save_model(PipelineModel([model]), path)
    return sinks.load_model(spark, path).stages[-1]


def test_a_forest_is_scored_without_walking_it_row_by_row(spark, tmp_path, monkeypatch):
    """Fitted, and read back from a folder written anew since: the same scores
    as MLlib's walk, to the last bit, also for missing values; MLlib's
    walk of every tree for every vector is not called."""
    df = _rows(spark, 900)
    test = df.withColumn("a", F.when(F.col("id") % 7 == 0, float("nan")).otherwise(F.col("a"))).drop("features")
    test = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features", handleInvalid="keep").transform(test)
    for label in ("label", "three"):  # two and three classes
        own = df.withColumn("three", (F.col("a") % 3).cast("int"))
        model = models.random_forest(trees=9, max_depth=5, label=label).fit(own)
        want = {r.id: (r.probability[1], int(r.prediction)) for r in model.transform(test).collect()}
        loaded = _saved(spark, model, str(tmp_path / label))
        _saved(spark, models.random_forest(trees=2, max_depth=2, label=label).fit(own), str(tmp_path / label))
        with monkeypatch.context() as m:
            m.setattr(RandomForestClassificationModel, "_transform", None)
            for one in (model, loaded):
                got = models.predict(one, test, ["id"]).collect()
                assert len(got) == 900 and all((r.p_yes, r.prediction) == want[r.id] for r in got)


def test_forests_with_categories_or_thresholds_are_walked_by_mllib(spark):
    from pyspark.ml.feature import OneHotEncoder
    df = OneHotEncoder(inputCol="b", outputCol="b1").fit(_rows(spark, 900)).transform(_rows(spark, 900)).drop("features")
    df = VectorAssembler(inputCols=["a", "b1"], outputCol="features").transform(df)
    rows = RandomForestClassifier(numTrees=4, maxDepth=4, seed=1).fit(df)  # one-hot slots are categories for MLlib
    sure = models.random_forest(trees=4, max_depth=4).fit(df)
    sure.setThresholds([0.3, 0.7])
    for model in (rows, sure):
        want = {r.id: (r.probability[1], int(r.prediction)) for r in model.transform(df).collect()}
        got = models.predict(model, df, ["id"]).collect()
        assert len(got) == 900 and all((r.p_yes, r.prediction) == want[r.id] for r in got)
