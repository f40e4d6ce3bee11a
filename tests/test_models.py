"""Models, tuning, resampling inside folds, persistence and scoring on a
frame with real signal (c_signal, built from spark.range and hashes)."""

import pytest
from pyspark.sql import functions as F

from callrank.operators import encode, evaluate, models, resample, score, split
from callrank.sources import sinks
from callrank.spec import FeatureSpec


def _u(col, salt):
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), col.cast("string"))), 1, 8), 16, 10
                  ).cast("double") / 4294967296.0


@pytest.fixture(scope="module")
def signal(spark):
    df = spark.range(0, 2000).select(
        F.col("id"), _u(F.col("id"), "a").alias("f1"), _u(F.col("id"), "b").alias("f2"),
        _u(F.col("id"), "c").alias("f3"), _u(F.col("id"), "d").alias("f4"),
        F.when(_u(F.col("id"), "e") < 0.5, "x").otherwise("y").alias("cat"))
    z = F.col("f1") * 2.0 + F.when(F.col("cat") == "x", 0.6).otherwise(0.0) + _u(F.col("id"), "n") * 0.8
    df = df.withColumn("y", F.when(z > 2.2, "yes").otherwise("no"))
    return df.persist()


SPEC = FeatureSpec(numeric=("f1", "f2", "f3", "f4"), categorical=("cat",), target="y", positive="yes",
                   key=("id",), seed=42)


@pytest.fixture(scope="module")
def prepared(spark, signal):
    from callrank.plans.prepare import prepare
    return prepare(signal, SPEC).persist()


def test_signal_is_imbalanced(prepared):
    rate = prepared.agg(F.avg("label")).first()[0]
    assert 0.03 < rate < 0.3


def test_tree_models_learn_signal(spark, prepared):
    tr, te = prepared.where("split = 'train'"), prepared.where("split = 'test'")
    for clf in (models.decision_tree(), models.random_forest(trees=30, max_depth=6),
                models.boosted_trees(rounds=20, max_depth=3)):
        m = encode.build_pipeline(SPEC.numeric, SPEC.categorical, clf).fit(tr)
        auc = evaluate.roc_auc(models.predict(m, te, ["label"]), "label", "p_yes").first()["auc"]
        assert auc > 0.7, type(clf).__name__


def test_balanced_weights(prepared):
    w = encode.class_weights(prepared, "label")
    n1 = prepared.where("label = 1").count()
    n = prepared.count()
    assert abs(w[1] - n / (2 * n1)) < 1e-12


def test_resampling_inside_folds_has_no_leak(spark, prepared):
    from pyspark.ml import Pipeline
    tr = prepared.where("split = 'train'")
    te = prepared.where("split = 'test'")
    pre = Pipeline(stages=encode.preprocessor(SPEC.numeric, SPEC.categorical)).fit(tr)
    trf = split.stratified_folds(pre.transform(tr), "label", ["id"], 3).withColumn("label", F.col("label").cast("double"))
    tef = pre.transform(te)
    rf = models.random_forest(trees=20, max_depth=8)
    inside = resample.SmoteClassifier(rf, k=5, seed=42, keyCol="id")
    cvm = models.grid_search(inside, {"maxDepth": [4, 8]}, fold_col="fold", param_owner=rf).fit(trf)
    assert len(cvm.avgMetrics) == 2 and cvm.avgMetrics[0] != cvm.avgMetrics[1]  # grid reaches the inner model
    test_auc = evaluate.roc_auc(models.predict(cvm.bestModel, tef, ["label"]), "label", "p_yes").first()["auc"]
    # before folding (the leaky order): CV is inflated against test
    from pyspark.ml.functions import array_to_vector, vector_to_array
    arr = trf.select("id", "fold", "label", vector_to_array("features").alias("_x"))
    syn = resample.smote_samples(arr.select("id", "_x", "label"), "_x", 6, "label", ["id"], 5, 42)
    leaky = arr.select("id", "fold", "_x", "label").unionByName(
        syn.join(arr.select("id", "fold"), "id").select("id", "fold", "_x", "label"))
    leaky = leaky.select(array_to_vector("_x").alias("features"), F.col("label").cast("double"), "fold")
    cvl = models.grid_search(rf, {"maxDepth": [8]}, fold_col="fold").fit(leaky)
    assert max(cvm.avgMetrics) - test_auc < max(cvl.avgMetrics) - test_auc


def test_save_load_same_scores_and_batch_score(spark, prepared, tmp_path):
    tr, te = prepared.where("split = 'train'"), prepared.where("split = 'test'")
    m = encode.build_pipeline(SPEC.numeric, SPEC.categorical, models.decision_tree()).fit(tr)
    path = str(tmp_path / "model")
    sinks.save_model(m, path)
    back = sinks.load_model(spark, path)
    a = models.predict(m, te, ["id"]).orderBy("id").collect()
    b = models.predict(back, te, ["id"]).orderBy("id").collect()
    assert a == b
    scored = score.batch_score(back, te, 0.1, 0.3, ["id"]).collect()
    assert all((r.decision == "CALL") == (r.p_yes >= 0.3) for r in scored)
    assert all(abs(r.lift - r.p_yes / 0.1) < 1e-12 for r in scored)


def test_train_job_and_model_card(spark, signal):
    from callrank.plans.train import model_card, train
    res = train(spark, signal, SPEC, models.balanced_forest(trees=20, max_depth=6, min_leaf=5))
    m = res.metrics.first()
    assert m.n_train + m.n_test == 2000 and m.test_roc_auc > 0.7
    card = model_card(res)
    assert {r.section for r in card.select("section").distinct().collect()} == {"metric", "confusion", "roc",
                                                                                  "top_feature"}
    assert res.importances.count() <= 15


def test_artifact_from_the_folder_alone(spark, signal, tmp_path):
    """What is stored equals what was trained; a second reader needs no more."""
    from callrank.plans.train import invalid_inputs, load_artifact, model_card, score_with_artifact, train
    with pytest.raises(sinks.ArtifactMissingError):
        load_artifact(spark, str(tmp_path / "none"))
    path = str(tmp_path / "artifact")
    res = train(spark, signal, SPEC, models.balanced_forest(trees=10, max_depth=5, min_leaf=5), out_dir=path)
    back = load_artifact(spark, path)

    def rows(df):
        return sorted(map(tuple, df.collect()), key=str)
    assert rows(model_card(back)) == rows(model_card(res))
    assert back.metrics.drop("confusion", "top_features").columns == res.metrics.columns
    assert sum(r.n for r in back.confusion.collect()) == back.metrics.first().n_test
    test = res.prepared.where("split = 'test'")
    scored = score_with_artifact(back, test, keep=["id"]).collect()
    rate = signal.where("y = 'yes'").count() / 2000
    assert len(scored) == test.count() and all(abs(r.lift - r.p_yes / rate) < 1e-9 for r in scored)
    train_rows = res.prepared.where("split = 'train'")
    assert invalid_inputs(back, train_rows.select("id", "cat", "f1"), ["id"]).count() == 0
    odd = spark.createDataFrame([(1, "z", 0.5), (2, "x", 9.0), (3, None, None)], "id long, cat string, f1 double")
    assert {(r.id, r.column_name) for r in invalid_inputs(back, odd, ["id"]).collect()} == {(1, "cat"), (2, "f1")}


def test_stream_scoring(spark, prepared, tmp_path):
    from callrank.streaming.scoring import score_stream
    tr, te = prepared.where("split = 'train'"), prepared.where("split = 'test'")
    m = encode.build_pipeline(SPEC.numeric, SPEC.categorical, models.decision_tree()).fit(tr)
    src = str(tmp_path / "in")
    te.drop("split").repartition(3).write.parquet(src)
    schema = spark.read.parquet(src).schema
    q = score_stream(spark, m, src, schema, str(tmp_path / "out"), 0.1, keep=["id"],
                     checkpoint=str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == te.count()
