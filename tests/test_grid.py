"""The whole grid is fitted, stages of one fit are those of
separate fits, and a tree is that of a brute-force search."""

import itertools
import json

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from callrank.operators import models, resample, split, tuning
from callrank.plans import catalog

GRID = {"maxIter": [5, 10], "maxDepth": [2, 3], "stepSize": [0.1, 0.3], "subsamplingRate": [1.0]}


def frame(spark, n=1500):
    """Three features, the first two decide the label, most of the time."""
    d = spark.range(n).select("id", *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(20))).cast("double").alias(f"a{i}") for i in range(3)],
                              F.pmod(F.xxhash64("id", F.lit(9)), F.lit(10)).alias("u"))
    sure = (F.col("a0") > 9) != (F.col("a1") > 14)
    d = d.withColumn("label", F.when(F.col("u") < 9, sure).otherwise(~sure).cast("int"))
    return d.select("id", "label", array_to_vector(F.array("a0", "a1", "a2")).alias("features"))


def test_registered_queries_fit_the_whole_grid(spark, monkeypatch):
    monkeypatch.setattr(catalog, "_CACHE", {})
    rows = catalog.QUERIES["m5_grid_search"](spark, SF_SMALL).collect()
    assert {r["params"] for r in rows} == {
        json.dumps({"maxDepth": d, "maxIter": n, "stepSize": s, "subsamplingRate": r}, sort_keys=True)
        for n in (100, 200) for d in (3, 5, 7) for s in (0.05, 0.1, 0.2) for r in (0.8, 1.0)}
    assert len(rows) == 36 and all(0 <= r["cv_auc"] <= 1 for r in rows) and sum(r["best"] for r in rows) == 1
    best = catalog.QUERIES["m6_best_params"](spark, SF_SMALL).collect()
    assert len(best) == 1 and best[0]["cv_auc"] == max(r["cv_auc"] for r in rows)
    gap = catalog.QUERIES["m7_cv_gap"](spark, SF_SMALL).first()
    assert gap["params"] == best[0]["params"] and abs(gap["gap"] - gap["cv_auc"] + gap["test_auc"]) < 1e-12


def test_leak_shows_in_the_gap(spark):
    rows = {r["mode"]: r for r in catalog.QUERIES["e9_resample_in_folds"](spark, "/root/testdata/sf0.01").collect()}
    assert set(rows) == {"inside_folds", "before_folds"}
    assert rows["before_folds"]["cv_auc"] > rows["inside_folds"]["cv_auc"] + 0.05


def test_search_on_a_target_with_signal(spark):
    d = frame(spark)
    tr = split.stratified_folds(d.where("id % 5 > 0"), "label", ["id"], 3, 42)
    rows = tuning.folded(tr, "fold", ["id"], test=d.where("id % 5 = 0"))
    got = tuning.search(rows, GRID).collect()
    assert len(got) == 8 and all(r["cv_auc"] > 0.8 and r["test_auc"] > 0.8 for r in got)
    again = tuning.search(rows.repartition(5), GRID).collect()
    assert {(r["params"], round(r["cv_auc"], 9), round(r["test_auc"], 9), r["best"]) for r in got} == {
        (r["params"], round(r["cv_auc"], 9), round(r["test_auc"], 9), r["best"]) for r in again}
    winner = tuning.refit(spark, spark.createDataFrame(got), models.boosted_trees(seed=42), d)
    assert winner.getNumTrees == json.loads(next(r["params"] for r in got if r["best"]))["maxIter"]
    few = tuning.fit_cells(rows, rows_per_fit=200).groupBy("fit").agg(F.sum(F.col("positive") + F.col("negative")).alias("n")).collect()
    assert all(100 < r["n"] < 400 for r in few)


def test_same_scores_as_the_library(spark):
    d = frame(spark)
    model = models.boosted_trees(rounds=12, max_depth=3, step=0.2).setMaxBins(32).fit(d)
    want = {r["id"]: r["rawPrediction"][1] for r in model.transform(d).collect()}
    rows = sorted((r["id"], list(r["features"]), r["label"]) for r in d.collect())
    codes = np.array([r[1] for r in rows], np.int64).T
    y = np.array([r[2] for r in rows])
    f = tuning.boost(codes, y, 1 - y, codes, [12], 3, 0.2, 1.0, 0)[12]
    # the library's margin is twice the sum of its trees
    lib = np.array([want[r[0]] for r in rows])
    assert np.corrcoef(lib, f)[0, 1] > 0.999
    assert abs(tuning.cell_auc(f, y, 1 - y) - tuning.cell_auc(lib, y, 1 - y)) < 0.005


def test_stages_are_those_of_separate_fits():
    rnd = np.random.default_rng(1)
    x, y = rnd.integers(0, 8, (3, 300)), rnd.integers(0, 3, 300)
    n = rnd.integers(0, 3, 300)
    both = tuning.boost(x, y, n, x, [4, 9], 3, 0.1, 0.8, 7)
    for r in (4, 9):
        assert (tuning.boost(x, y, n, x, [r], 3, 0.1, 0.8, 7)[r] == both[r]).all()


def test_first_split_by_brute_force():
    rnd = np.random.default_rng(2)
    for _ in range(20):
        x, c = rnd.integers(0, 5, (2, 40)), rnd.integers(0, 4, 40).astype(float)
        t = rnd.normal(size=40) * c
        feature, cut, value = tuning.grow(x, t, c, 1)

        def loss(mask):
            return -t[mask].sum() ** 2 / c[mask].sum() if c[mask].sum() else 0.0
        best = min(loss(x[j] <= b) + loss(x[j] > b) for j, b in itertools.product(range(2), range(5)))
        at = x[feature[0]] <= cut[0]
        assert loss(at) + loss(~at) == pytest.approx(best)
        assert tuning.apply((feature, cut, value), x) == pytest.approx(np.where(at, t[at].sum() / c[at].sum(), t[~at].sum() / c[~at].sum()))


def test_auc_of_cells():
    rnd = np.random.default_rng(3)
    score, p, n = rnd.integers(0, 4, 12).astype(float), rnd.integers(0, 3, 12), rnd.integers(0, 3, 12)
    wins = sum(a * b * ((s > t) + 0.5 * (s == t)) for s, a in zip(score, p) for t, b in zip(score, n))
    assert tuning.cell_auc(score, p, n) == pytest.approx(wins / (p.sum() * n.sum()))
    assert tuning.cell_auc(np.zeros(3), np.ones(3), np.ones(3)) == 0.5
    assert tuning.cell_auc(np.zeros(3), np.ones(3), np.zeros(3)) is None


def test_smote_resamples_once_for_all_settings(spark, monkeypatch):
    calls, real = [], resample.smote_samples
    monkeypatch.setattr(resample, "smote_samples", lambda *a, **k: calls.append(1) or real(*a, **k))
    d = frame(spark, 200).withColumn("label", F.when(F.col("id") % 4 == 0, 1.0).otherwise(0.0))
    gbt = models.boosted_trees(rounds=1, max_depth=2)
    est = resample.SmoteClassifier(gbt, k=3, seed=1, keyCol="id")
    maps = [{gbt.maxDepth: 1}, {gbt.maxDepth: 2}, {gbt.maxDepth: 3}]
    fitted = dict(est.fitMultiple(d, maps))
    assert len(calls) == 1 and sorted(fitted) == [0, 1, 2]
    assert [max(t.depth for t in fitted[i].trees) <= i + 1 for i in range(3)] == [True] * 3


def test_counted_rows_are_all_used(spark):
    """Beyond ``rows_per_fit`` rows, equal rows are counted, not sampled; both ways give the same cells below it."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from callrank.operators import tuning
    df = spark.range(0, 3000).select("id", (F.col("id") % 3).cast("int").alias("fold"), (F.col("id") % 7 % 2).cast("int").alias("label"),
                                     array_to_vector(F.array((F.col("id") % 10).cast("double"), (F.col("id") % 4).cast("double"))).alias("features"))
    test = df.where("id < 500")
    counted = tuning.counted_folds(df, "fold", test=test)

    def rows(cells):
        return sorted((r.fit, r.train, *r.codes, r.positive, r.negative) for r in cells.collect())
    got = rows(tuning.fit_cells(counted, rows_per_fit=100))
    assert got == rows(tuning.fit_cells(tuning.folded(df, "fold", ["id"], test=test)))
    assert sum(r[-1] + r[-2] for r in got) == 3 * 3000 + 3000 + 500
    few = rows(tuning.fit_cells(counted, rows_per_fit=15))
    assert 0 < sum(r[-1] + r[-2] for r in few if r[0] == 3 and r[1]) < 60


def test_no_row_is_left_out(spark, monkeypatch):
    """However many rows or cells, all are learned from and scored: nothing is drawn."""
    d = spark.range(140_000).select("id", (F.col("id") % 3).cast("int").alias("fold"), (F.xxhash64("id") % 2 == 0).cast("int").alias("label"),
                                    *[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(997)).cast("double").alias(f"a{i}") for i in range(4)])
    d = d.select("id", "fold", "label", array_to_vector(F.array("a0", "a1", "a2", "a3")).alias("features"))
    test, calls, real = d.where("id < 7000"), [], tuning.grid_fits

    def kept(cells, *a):
        calls.append({(r.fit, r.train): (r.n, r.cells) for r in cells.groupBy("fit", "train").agg(
            F.sum(F.col("positive") + F.col("negative")).alias("n"), F.count("*").alias("cells")).collect()})
        return real(cells, *a)
    monkeypatch.setattr(tuning, "grid_fits", kept)
    grid = {"maxIter": [1], "maxDepth": [1], "stepSize": [0.1], "subsamplingRate": [1.0]}
    for rows in (tuning.counted_folds(d, "fold", test=test), tuning.folded(d, "fold", ["id"], test=test)):
        assert tuning.search(rows, grid).count() == 1
    for got in calls:
        per_fold = [sum(i % 3 == f for i in range(140_000)) for f in range(3)]
        assert {k: n for k, (n, _) in got.items()} == {(3, True): 140_000, (3, False): 7000} | {
            (f, t): 140_000 - per_fold[f] if t else per_fold[f] for f in range(3) for t in (True, False)}
        assert got[3, True][1] > 60_000
    assert len(calls) == 2


def test_cells_dealt_to_the_tasks_give_the_same_fits(spark, monkeypatch):
    """What does not go to each task is fitted by the same rounds, block by block."""
    d = frame(spark, 4000)
    tr = split.stratified_folds(d.where("id % 5 > 0"), "label", ["id"], 3, 42)
    cells = tuning.fit_cells(tuning.counted_folds(tr, "fold", test=d.where("id % 5 = 0")))
    grid = GRID | {"subsamplingRate": [0.8, 1.0]}

    def rows():
        got = {(r.params, r.fit): r.auc for r in tuning.grid_fits(cells, grid).collect()}
        assert len(got) == 16 * 4
        return got
    want = rows()
    monkeypatch.setattr(tuning, "CODES", 0)
    monkeypatch.setattr(tuning, "_shared_fits", None)
    assert rows() == want
    # few shuffle partitions: a task fits several settings
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows() == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_blocks_of_cells_in_files_give_the_same_fit(monkeypatch):
    rnd = np.random.default_rng(4)
    x, y = rnd.integers(0, 32, (4, 700)), rnd.integers(0, 32, (4, 500))
    p, n = rnd.integers(0, 4, 700), rnd.integers(0, 4, 700) * (x[0] > 11)
    yp, yn = rnd.integers(0, 4, 500), rnd.integers(0, 4, 500)
    for subsample in (0.8, 1.0):
        want = tuning.boost(x, p, n, y, [3, 8], 4, 0.2, subsample, 5)
        with monkeypatch.context() as m:
            m.setattr(tuning, "BLOCK", 37)
            got = tuning.boost(x, p, n, y, [3, 8], 4, 0.2, subsample, 5)
            assert isinstance(got[8], np.memmap)
            for r in (3, 8):
                assert np.allclose(got[r], want[r], rtol=1e-9, atol=1e-9)
            areas = [tuning.cell_auc(want[r], yp, yn) for r in (3, 8)]
            tied = tuning.cell_auc(np.round(want[8], 1), yp, yn)
            one, none = tuning.cell_auc(np.zeros(500), yp, yn), tuning.cell_auc(want[8], yp, np.zeros(500))
        assert areas == pytest.approx([tuning.cell_auc(want[r], yp, yn) for r in (3, 8)], abs=1e-12)
        assert tied == pytest.approx(tuning.cell_auc(np.round(want[8], 1), yp, yn), abs=1e-12)
        assert one == 0.5 and none is None
