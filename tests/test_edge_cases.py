"""Hand-made frames for the corner cases (FIXTURES.md part C)."""

import pytest
from pyspark.sql import functions as F

from callrank.operators import evaluate, quality, segments, transforms
from callrank.functions import expressions as X

SCORE = "label double, score double"


def _auc(spark, rows):
    return evaluate.roc_auc(spark.createDataFrame(rows, SCORE)).first()["auc"]


def test_empty_frame(spark):
    df = spark.createDataFrame([], SCORE)
    assert [r.auc for r in evaluate.roc_auc(df).collect()] in ([], [None])
    m = evaluate.binary_metrics(df.withColumn("prediction", F.lit(1.0))).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (0, 0, 0, 0)
    assert m.precision == 0.0 and m.recall == 0.0 and m.f1 == 0.0 and m.accuracy is None
    assert segments.class_balance(df, "label").collect() == []


def test_one_class_auc_is_null(spark):
    assert _auc(spark, [(1.0, 0.3), (1.0, 0.7)]) is None


def test_all_tied_auc_half(spark):
    assert _auc(spark, [(1.0, 0.5), (0.0, 0.5), (1.0, 0.5), (0.0, 0.5)]) == 0.5
    roc = evaluate.roc_curve(spark.createDataFrame([(1.0, 0.5), (0.0, 0.5)], SCORE)).orderBy("position").collect()
    assert [(r.fpr, r.tpr) for r in roc] == [(0.0, 0.0), (1.0, 1.0)]


def test_perfect_scores(spark):
    rows = [(1.0, 1.0), (0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    df = spark.createDataFrame(rows, SCORE)
    assert evaluate.roc_auc(df).first()["auc"] == 1.0
    assert evaluate.average_precision(df).first()["average_precision"] == 1.0


def test_nulls_and_unknown(spark):
    df = spark.createDataFrame([(None, "yes"), ("a", None), ("unknown", "yes"), (" b", "no"), ("a", "yes")],
                               "seg string, y string")
    clean = transforms.replace_tokens(df, ["unknown"])
    assert clean.where("seg IS NULL").count() == 2
    lab = transforms.add_target(clean, "y", "yes")
    assert [r.label for r in lab.orderBy("seg", "y").collect()].count(1) == 3  # NULL y -> 0
    vc = segments.value_counts(lab, "seg").collect()
    assert {r.seg for r in vc} == {"a", " b"}
    ov = segments.conversion_with_overall(lab, "seg").collect()
    assert all(r.overall_rate == 3 / 5 for r in ov)  # overall over all rows, nulls included


def test_dotted_name_collision(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "`emp.var.rate` double, emp_var_rate double")
    with pytest.raises(quality.NameCollisionError):
        quality.normalize_names(df)
    ok = quality.normalize_names(spark.createDataFrame([(1.0,)], "`emp.var.rate` double"))
    assert ok.columns == ["emp_var_rate"]


def test_unseen_category_all_zeros(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    from callrank.operators import encode
    fit = spark.createDataFrame([("a",), ("b",), ("c",)], "x string")
    model = Pipeline(stages=encode.one_hot(["x"])).fit(fit)
    out = model.transform(spark.createDataFrame([("a",), ("zz",), (None,)], "x string"))
    rows = {r.x: r.v for r in out.select("x", vector_to_array("x_ohe").alias("v")).collect()}
    assert rows["a"] == [1.0, 0.0, 0.0]
    assert rows["zz"] == [0.0, 0.0, 0.0]
    assert rows[None] == [0.0, 0.0, 0.0]


def test_zero_base_lift_is_null(spark):
    df = spark.createDataFrame([(0, 0.4), (0, 0.6)], "label int, p double")
    base = df.agg(F.avg("label")).scalar()
    assert all(r.l is None for r in df.select(X.lift("p", base).alias("l")).collect())


def test_threshold_boundary(spark):
    df = spark.createDataFrame([(0.3,), (0.2999999,), (0.3000001,)], "p double")
    got = {r.p: r.d for r in df.select("p", X.decision("p", 0.3).alias("d")).collect()}
    assert got == {0.3: "CALL", 0.2999999: "SKIP", 0.3000001: "CALL"}


def test_sentinels_and_flags(spark):
    df = spark.createDataFrame([(999, 1, -1.0), (-1, 3, 0.0), (0, 4, 1.0), (3, 5, -0.5)],
                               "pdays int, campaign int, emp_var_rate double")
    assert transforms.null_sentinel(df, "pdays", 999).where("pdays IS NULL").count() == 1
    rec = transforms.recode(df, "pdays", 999, -1)
    assert rec.where("pdays = -1").count() == 2
    fl = transforms.add_flags(rec, {"was_contacted": F.col("pdays") != -1, "intensive": F.col("campaign") > 3,
                                    "favourable": F.col("emp_var_rate") < 0}).orderBy("campaign").collect()
    assert [(r.was_contacted, r.intensive, r.favourable) for r in fl] == [(0, 0, 1), (0, 0, 0), (1, 1, 0), (1, 1, 1)]


def test_leakage_spec_refused():
    from callrank.spec import FeatureSpec, LeakageError
    with pytest.raises(LeakageError):
        FeatureSpec(numeric=("age", "duration"), leakage=("duration",))


def test_smote_tiny_minority(spark):
    from callrank.operators import resample
    rows = [(i, 1, float(i), float(i % 2)) for i in range(3)] + [(100 + i, 0, float(i), 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, label int, f1 double, f2 double")
    out = resample.smote(df, ["f1", "f2"], "label", ["id"], k=5)
    counts = {r.label: r.n for r in out.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 20, 1: 20}  # k cut to 2 neighbours
    one = spark.createDataFrame([(1, 1, 5.0, 5.0)] + rows[3:], "id int, label int, f1 double, f2 double")
    syn = resample.smote(one, ["f1", "f2"], "label", ["id"]).where("synthetic").collect()
    assert len(syn) == 19 and all((r.f1, r.f2) == (5.0, 5.0) for r in syn)  # replication


def test_source_fallback_and_missing_model(spark, tmp_path):
    from callrank.sources import readers, sinks
    with pytest.raises(readers.NoSourceError):
        readers.first_readable([lambda: spark.read.parquet(str(tmp_path / "nope"))])
    with pytest.raises(sinks.ArtifactMissingError):
        sinks.load_model(spark, str(tmp_path / "no_model"))


def test_null_class_rows_are_kept(spark):
    from callrank.operators import split
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(200)], "id int, label int")
    folds = split.stratified_folds(df, "label", ["id"], 3)
    assert folds.count() == 200 and folds.where("label IS NULL").count() == 40
    sp = split.stratified_split(df, "label", ["id"])
    assert sp.count() == 200 and sp.where("label IS NULL AND split = 'test'").count() == 8
    long = spark.createDataFrame([(None if i % 4 == 0 else "m", i % 2, float(i % 7)) for i in range(100)],
                                 "model string, label int, score double")
    auc = evaluate.roc_auc(long, groups=["model"]).collect()
    assert len(auc) == 2 and sum(r.n_pos + r.n_neg for r in auc) == 100


def test_chi_square_leaves_null_keys_out(spark):
    from callrank.operators import stats
    rows = [("x", "u")] * 30 + [("x", "v")] * 10 + [("y", "u")] * 10 + [("y", "v")] * 30 + [(None, "u")] * 25 + [("x", None)] * 15
    df = spark.createDataFrame(rows, "a string, b string")
    r = stats.chi_square_statistic(df, "a", "b").first()
    assert (round(r["statistic"], 9), r["dof"], r["n"]) == (20.0, 1, 80)
    t = stats.chi_square_test(df, "a", "b").first()
    assert (round(t["statistic"], 9), t["dof"]) == (20.0, 1)


def test_null_scores_are_in_the_last_bins(spark):
    from callrank.operators import ranking
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 5) for i in range(40)], "id long, s long")
    got = {r["id"]: r["bin"] for r in ranking.equal_count_bins(df, "s", ["id"], 5).collect()}
    order = sorted(range(40), key=lambda i: (i % 4 == 0, -(i % 5) if i % 4 else 0, i))
    assert got == {i: k // 8 + 1 for k, i in enumerate(order)}


def test_reduced_roc_curve_keeps_first_and_last_point(spark):
    from callrank.operators import evaluate
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 1), (0.6, 0), (0.5, 0)], "score double, label int")
    got = [r["threshold"] for r in evaluate.roc_curve(df, drop_intermediate=True).orderBy("position").collect()]
    assert got == [float("inf"), 0.9, 0.7, 0.5]


def test_missing_feature_column_is_an_error(spark):
    from callrank.plans.prepare import prepare
    from callrank.spec import FeatureSpec
    df = spark.createDataFrame([(1, "a")], "id long, c string")
    spec = FeatureSpec(numeric=("n",), categorical=("c",), target="y", positive="yes", key=("id",))
    with pytest.raises(ValueError, match="n"):
        prepare(df, spec)


def test_domain_violations_beyond_a_broadcast(spark, monkeypatch):
    """Both ways give the same rows; no domain, no range and no column to
    check give none."""
    from callrank.operators import score
    df = spark.createDataFrame([(1, "a", "q", 1.0), (2, "z", "q", 5.0), (3, None, "r", None), (4, "z", "s", -1.0)],
                               "id long, c string, e string, n double")
    doms = spark.createDataFrame([("c", "a"), ("c", "a"), ("c", None), ("e", "q"), ("e", "r"), ("gone", "x")],
                                 "column_name string, value string")
    ranges = spark.createDataFrame([("n", 0.0, 2.0), ("gone", 0.0, 1.0)], "column_name string, lo double, hi double")
    want = {(2, "c", "z"), (4, "c", "z"), (4, "e", "s"), (2, "n", "5.0"), (4, "n", "-1.0")}
    small = score.domain_violations(df, ["id"], doms, ranges)
    assert sorted(map(tuple, small.collect())) == sorted(want)
    assert "hashpartitioning" not in small._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(score, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, score.domain_violations(df, ["id"], doms, ranges).collect())) == sorted(want)
    assert score.domain_violations(df, ["id"], doms.limit(0)).count() == 0
    assert score.domain_violations(df.select("id"), ["id"], doms, ranges).count() == 0


def test_model_evaluation_row(spark):
    """No scores, one class or no rows: the AUC is NULL, the rest is defined."""
    from callrank.operators import evaluate
    df = spark.createDataFrame([(1, 1, 0.9), (0, 1, 0.4), (1, 0, 0.6), (0, 0, 0.1)], "label int, prediction int, s double")
    r = evaluate.model_evaluation(df, "m", score="s").first()
    assert (r["model"], r["accuracy"], r["precision"], r["recall"], r["f1"], r["roc_auc"]) == ("m", 0.5, 0.5, 0.5, 0.5, 1.0)
    assert evaluate.model_evaluation(df, "m").first()["roc_auc"] is None
    assert evaluate.model_evaluation(df.where("label = 1"), "m", score="s").first()["roc_auc"] is None
    empty = evaluate.model_evaluation(df.where("false"), "m", score="s").collect()
    assert len(empty) == 1 and empty[0]["accuracy"] is None and empty[0]["f1"] == 0.0


def test_source_report(spark):
    from callrank.sources import readers
    r = readers.source_report(spark.createDataFrame([], "a int, b int"), "none").collect()
    assert [tuple(x) for x in r] == [("none", 0, 2)]
