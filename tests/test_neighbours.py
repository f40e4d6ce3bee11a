"""Neighbour search in many dimensions and with categories."""

import numpy as np
from pyspark.sql import functions as F

from callrank.operators import resample
from callrank.session import cut_lineage


def _clustered(n, dims, seed):
    rnd = np.random.default_rng(seed)
    centre = rnd.normal(size=(40, dims)) * 10
    return (centre[rnd.integers(0, 40, n)] + rnd.normal(size=(n, dims))).round(4)


def _brute(x, k, penalty=0.0, nominal=0):
    cont = x.shape[1] - nominal
    out = {}
    for q in x:
        d = np.zeros(len(x))
        for j in range(cont):
            d = d + (q[j] - x[:, j]) ** 2
        for j in range(cont, x.shape[1]):
            d = d + np.where(q[j] != x[:, j], penalty, 0.0)
        few = np.flatnonzero(d <= np.sort(d)[min(k, len(d) - 1)])
        rows = sorted((d[i], tuple(x[i])) for i in few if tuple(x[i]) != tuple(q))
        out[tuple(q)] = rows[:k]
    return out


def _found(df, *args, **kwargs):
    out = {}
    for r in resample.knn_distinct(df, "x", *args, **kwargs).collect():
        out.setdefault(tuple(r.x), {})[r.nb_rank] = (r.d2, tuple(r.nb))
    return {q: [got[i] for i in range(len(got))] for q, got in out.items()}


def test_sixteen_dimensions_meet_few_pairs(spark):
    x = np.unique(_clustered(3000, 16, 5), axis=0)
    df = cut_lineage(spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>"))
    assert _found(df, 16, 5, per_cell=16) == _brute(x, 5)
    cells, levels = resample._cells(df, "x", 16, 6, 16, 0, 0.0)
    sizes = {r["_c"]: r["n"] for r in cells.groupBy("_c").agg(F.count("*").alias("n")).collect()}
    assert min(sizes.values()) >= 6 and sum(sizes.values()) == len(x)
    near = resample.knn_distinct(df, "x", 16, 5, per_cell=16).groupBy("x").agg(F.max("d2").alias("d2"))
    touched = resample._touched(cells.join(near, "x"), levels, "x", 16)
    met = sum(sizes[r["_at"]] * r["n"] for r in touched.groupBy("_at").agg(F.count("*").alias("n")).collect())
    assert met + sum(n * n for n in sizes.values()) < len(x) ** 2 / 8


def test_crowded_cells_are_cut_again(spark, monkeypatch):
    """Two levels of cells, with splits fitted on a small part of each."""
    monkeypatch.setattr(resample, "FIT_ROWS", 40)
    monkeypatch.setattr(resample, "DEPTH", 2)
    x = np.unique(_clustered(600, 3, 8), axis=0)
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    assert len(resample._cells(df, "x", 3, 4, 8, 0, 0.0)[1]) > 1
    assert _found(df, 3, 3, per_cell=8) == _brute(x, 3)


def test_vectors_that_no_split_divides(spark):
    """Unit vectors: every feature is 1 in one vector only, ties everywhere."""
    x = np.eye(40)
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    assert _found(df, 40, 3, per_cell=4) == _brute(x, 3)


def test_null_and_nan_entries_have_no_neighbours(spark):
    rows = [([1.0, 2.0],), ([1.0, None],), ([float("nan"), 2.0],), (None,), ([4.0, 6.0],), ([4.0, 6.0],)]
    got = _found(spark.createDataFrame(rows, "x array<double>"), 2, 5)
    assert got == {(1.0, 2.0): [(25.0, (4.0, 6.0))], (4.0, 6.0): [(25.0, (1.0, 2.0))]}
    assert _found(spark.createDataFrame([], "x array<double>"), 2, 5) == {}


def test_mixed_distance_against_all_pairs(spark):
    rnd = np.random.default_rng(3)
    x = np.unique(np.c_[rnd.integers(0, 60, (500, 2)), rnd.integers(0, 4, 500), rnd.integers(0, 2, 500)].astype(float), axis=0)
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    assert _found(df, 4, 5, per_cell=6, nominal=2, penalty=37.5) == _brute(x, 5, 37.5, 2)


def test_synthetic_rows_take_the_most_frequent_category(spark):
    rnd = np.random.default_rng(9)
    rows = [(i, int(i % 5 == 0), float(rnd.integers(0, 30)), float(rnd.integers(0, 9)), float(rnd.integers(0, 3)))
            for i in range(400)]
    df = spark.createDataFrame(rows, "id long, label int, a double, b double, cat double")
    out = resample.smote(df, ["a", "cat", "b"], "label", ["id"], k=4, nominal=["cat"])
    new = out.where("synthetic").collect()
    own = np.array([r[2:] for r in rows if r[1] == 1])
    sd = float(np.round(np.median(own[:, :2].std(axis=0)), 6))
    near = _brute(np.unique(own, axis=0), 4, sd * sd, 1)
    parent = {r[0]: r[2:] for r in rows}
    assert len(new) == 320 - 80
    for r in new:
        codes = [nb[2] for _, nb in near[parent[r.id]]]
        assert r["cat"] == min(set(codes), key=lambda c: (-codes.count(c), c))
        assert any(min(p, q) - 1e-9 <= r["a"] <= max(p, q) + 1e-9 for p, q in [(parent[r.id][0], nb[0]) for _, nb in near[parent[r.id]]])


def test_only_categories(spark):
    df = spark.createDataFrame([(i, int(i < 6), float(i % 3)) for i in range(20)], "id long, label int, c double")
    new = resample.smote(df, ["c"], "label", ["id"], nominal=["c"]).where("synthetic").collect()
    assert len(new) == 8 and {r["c"] for r in new} <= {0.0, 1.0, 2.0}


def test_cells_are_joined_by_key(spark):
    """No nested-loop join, though the walk begins at one cell."""
    x = _clustered(600, 3, 8)
    df = cut_lineage(spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>"))
    cells, levels = resample._cells(df, "x", 3, 4, 8, 0, 0.0)
    walk = resample._touched(cells.withColumn("d2", F.lit(4.0)), levels, "x", 3)
    assert levels and "NestedLoop" not in walk._jdf.queryExecution().executedPlan().toString()


def test_many_features_use_array_loops(spark):
    x = _clustered(300, 50, 2)
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    want, got = _brute(x, 3), _found(df, 50, 3, per_cell=8)
    assert {q: [v for _, v in rows] for q, rows in want.items()} == {q: [v for _, v in rows] for q, rows in got.items()}


def test_many_features_meet_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK_BYTES", 8 * 40 * 64)  # 64 vectors a block
    monkeypatch.setattr(resample, "TILE", 500)
    x = np.unique(np.vstack([_clustered(300, 40, 4), np.eye(40)]), axis=0)
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    assert _found(df, 40, 5) == _brute(x, 5)
    x[:, -2:] = np.arange(2 * len(x)).reshape(-1, 2) % 3
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    assert _found(df, 40, 3, nominal=2, penalty=7.5) == _brute(x, 3, 7.5, 2)
