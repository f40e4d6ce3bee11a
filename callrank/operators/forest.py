"""Tree models fitted on counted cells (M2, M3, M4).

Trees see a row as its bins and label only, so rows are collapsed before the
fit: equal (features, label, weight) rows become one with a count, and for
forests equal bins become one cell.  Nothing that a tree could tell apart is
lost, and a fit costs what the cells cost, not what the rows do.

Forests: a bootstrap draws each row Poisson(1) times, so a cell of n rows is
drawn Poisson(n) times, and leaves are bounded by drawn rows as before.  The
cells are bounded (``CELLS`` codes, counted first) and go to each task, which
grows its tree alone; nodes are written by the tasks in the layout of a saved
MLlib forest and read back as one.  Data that do not collapse to so many codes
are fitted by MLlib on all rows.

A forest scores by flat arrays of its written nodes, walked level by level for
a batch of vectors at once (``FlatForest``): the votes are MLlib's, in its order.

Boosted trees without subsampling use no draws and bound no leaf: MLlib fits
them on the collapsed rows, weighted by their counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callrank.session import default_parallelism, scratch_path

#: Codes (cells x features) of a forest that go to each task.
CELLS = 1 << 23

#: Cells that share one stream of draws.
BLOCK = 1 << 14

NODE_SCHEMA = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, "
               "gain: double, leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, "
               "numCategories: int>>")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted_rows(df: DataFrame, features: str, label: str, weight: str | None) -> DataFrame:
    """(x, label, weight, n), written: the distinct rows and how often they occur."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("label"), w.alias("weight"))
    return _written(rows.groupBy("x", "label", "weight").agg(F.count(F.lit(1)).alias("n")), "counted-rows")


def bin_cuts(counted: DataFrame, dims: int, max_bins: int) -> list[list[float]]:
    """For each feature the cuts between its bins: midpoints of its values if
    there are at most ``max_bins``, else approximate quantiles of the rows."""
    if not dims:
        return []
    x = [F.col("x")[i] for i in range(dims)]
    about = counted.agg(*[F.approx_count_distinct(c, 0.02) for c in x]).first()
    cuts: list[list[float]] = [[]] * dims
    few = [i for i in range(dims) if about[i] <= 2 * max_bins]
    if few:  # bounded: at most about two times max_bins values of a feature
        sets = counted.agg(*[F.collect_set(x[i]).alias(f"v{i}") for i in few]).first()
        for i in few:
            values = sorted(v for v in sets[f"v{i}"] if v == v)
            cuts[i] = [(a + b) / 2 for a, b in zip(values, values[1:])]
    many = [i for i in range(dims) if i not in few or len(cuts[i]) >= max_bins]
    if many:
        rows = counted.select(*[x[i].alias(f"x{i}") for i in many], F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("col")
        found = rows.approxQuantile([f"x{i}" for i in many], [q / max_bins for q in range(1, max_bins)], 1e-3)
        for i, c in zip(many, found):
            cuts[i] = sorted(set(c))
    return cuts


def _codes(cuts: list[list[float]]) -> Column:
    return F.array(*[reduce(add, [(F.col("x")[i] > F.lit(c)).cast("int") for c in own], F.lit(0)).cast("smallint")
                     for i, own in enumerate(cuts)]).cast("array<smallint>")


def cells(counted: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """(codes, label, weight, n), written: the distinct bins and their rows."""
    own = counted.select(_codes(cuts).alias("codes"), "label", "weight", "n")
    return _written(own.groupBy("codes", "label", "weight").agg(F.sum("n").alias("n")), "forest-cells")


def drawn(count: np.ndarray, rate: float, bootstrap: bool, seed: int, tree: int) -> np.ndarray:
    """How often the rows of each cell are drawn for a tree."""
    out = np.empty(len(count), np.int64)
    for b in range(0, len(count), BLOCK):
        own, rnd = count[b:b + BLOCK], np.random.default_rng([seed & 0xFFFFFFFF, tree, b // BLOCK])
        out[b:b + BLOCK] = rnd.poisson(own * rate) if bootstrap else own if rate >= 1.0 else rnd.binomial(own, rate)
    return out


def _gini(w: np.ndarray) -> np.ndarray:
    total = w.sum(axis=-1, keepdims=True)
    share = np.divide(w, total, out=np.zeros_like(w), where=total > 0)
    return 1.0 - (share * share).sum(axis=-1)


def _best(hist: np.ndarray, raw: np.ndarray, least: int, least_weight: float) -> tuple[np.ndarray, np.ndarray]:
    """(gain, cut) of the best split of each node by one feature: ``hist`` is
    (nodes x bins x classes) weights, ``raw`` (nodes x bins) drawn rows."""
    left, n_left = hist.cumsum(axis=1)[:, :-1], raw.cumsum(axis=1)
    whole, n = hist.sum(axis=1)[:, None], n_left[:, -1:]
    n_left = n_left[:, :-1]
    right = whole - left
    wl, wr = left.sum(axis=-1), right.sum(axis=-1)
    total = np.maximum(wl + wr, 1e-300)
    gain = _gini(whole) - (wl * _gini(left) + wr * _gini(right)) / total
    fits = (n_left >= least) & (n - n_left >= least) & (wl >= least_weight) & (wr >= least_weight)
    gain = np.where(fits, gain, -np.inf)
    cut = gain.argmax(axis=1)
    return gain[np.arange(len(gain)), cut], cut


def grow_tree(codes: np.ndarray, label: np.ndarray, raw: np.ndarray, weight: np.ndarray, classes: int, bins: list[int], subset: int,
              depth: int, least: int, least_share: float, least_gain: float, rnd: np.random.Generator) -> dict[str, np.ndarray]:
    """One classification tree, grown level by level.  ``codes`` is (features x
    cells).  Nodes are numbered by level; ``left`` is -1 in a leaf, else the
    right child is the next one.  Each node has a random ``subset`` of the
    features that have more than one bin."""
    live = np.flatnonzero(raw > 0)
    codes, label, raw, weight = codes[:, live], label[live], raw[live], (raw * weight)[live]
    usable = np.array([j for j, b in enumerate(bins) if b > 1], np.int64)
    stats = [np.bincount(label, weight, classes)[None, :]]
    counts = [np.array([raw.sum()])]
    feature, cut, gains, left = [], [], [], []
    least_weight = least_share * weight.sum()
    node, first = np.zeros(len(raw), np.int64), 0  # node within its level
    for level in range(depth + 1):
        k = len(counts[level])
        by, after, best = np.full(k, -1), np.zeros(k, np.int64), np.full(k, -1.0)
        # a pure node, or one too small to be cut, stays a leaf
        tried = (counts[level] >= 2 * least) & (stats[level].max(axis=1) < stats[level].sum(axis=1)) & (level < depth)
        if len(usable) and tried.any():
            picked = rnd.random((k, len(usable))).argsort(axis=1)[:, :subset]  # places in ``usable``
            for u, j in enumerate(usable):
                has = tried & (picked == u).any(axis=1)
                number = np.cumsum(has) - 1
                rows = np.flatnonzero(has[node])
                if not len(rows):
                    continue
                m, b = int(has.sum()), bins[j]
                place = number[node[rows]] * b + codes[j, rows]
                hist = np.bincount(place * classes + label[rows], weight[rows], m * b * classes).reshape(m, b, classes)
                gain, at = _best(hist, np.bincount(place, raw[rows], m * b).reshape(m, b), least, least_weight)
                own = np.flatnonzero(has)
                more = (gain > best[own]) & (gain > 0) & (gain >= least_gain)
                best[own[more]], by[own[more]], after[own[more]] = gain[more], j, at[more]
        cuts_here = by >= 0
        feature.append(by)
        cut.append(after)
        gains.append(np.where(cuts_here, best, -1.0))
        child = 2 * (np.cumsum(cuts_here) - 1)
        left.append(np.where(cuts_here, first + k + child, -1))
        first += k
        if not cuts_here.any():
            break
        rows = np.flatnonzero(cuts_here[node])  # the others have come to a leaf
        at = node[rows]
        node = child[at] + (codes[by[at], rows] > after[at])
        codes, label, raw, weight = codes[:, rows], label[rows], raw[rows], weight[rows]
        m = 2 * int(cuts_here.sum())
        stats.append(np.bincount(node * classes + label, weight, m * classes).reshape(m, classes))
        counts.append(np.bincount(node, raw, m).astype(np.int64))
    return {"feature": np.concatenate(feature), "cut": np.concatenate(cut), "gain": np.concatenate(gains), "left": np.concatenate(left),
            "stats": np.concatenate(stats), "raw": np.concatenate(counts)}


def pruned(tree: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """As MLlib does: two leaves of one prediction become one."""
    left, vote = tree["left"].copy(), tree["stats"].argmax(axis=1)
    for i in range(len(left) - 1, -1, -1):  # children come after their parent
        a = left[i]
        if a >= 0 and left[a] < 0 and left[a + 1] < 0 and vote[a] == vote[a + 1]:
            left[i] = -1
    return tree | {"left": left}


def node_rows(tree_id: int, tree: dict[str, np.ndarray], cuts: list[list[float]]) -> pa.RecordBatch:
    """The nodes of a tree as a saved MLlib model holds them, numbered in preorder."""
    left, order, place, todo = tree["left"], [], {}, [0]
    while todo:
        i = todo.pop()
        place[i] = len(order)
        order.append(i)
        if left[i] >= 0:
            todo += [left[i] + 1, left[i]]
    own = np.array(order)
    leaf = left[own] < 0
    stats, feature = tree["stats"][own], np.where(leaf, -1, tree["feature"][own])
    down = [(-1, -1) if left[i] < 0 else (place[left[i]], place[left[i] + 1]) for i in order]
    threshold = [[] if left[i] < 0 else [cuts[tree["feature"][i]][tree["cut"][i]]] for i in order]
    i32, n = pa.int32(), len(order)
    split = pa.StructArray.from_arrays([pa.array(feature, i32), pa.array(threshold, pa.list_(pa.float64())), pa.array(np.full(n, -1), i32)],
                                       ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    data = pa.StructArray.from_arrays(
        [pa.array(np.arange(n), i32), pa.array(stats.argmax(axis=1).astype(float)), pa.array(_gini(stats)), pa.array(list(stats), pa.list_(pa.float64())),
         pa.array(tree["raw"][own], pa.int64()), pa.array(np.where(leaf, -1.0, tree["gain"][own])), pa.array([d[0] for d in down], i32),
         pa.array([d[1] for d in down], i32), split],
        ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, tree_id), i32), data], ["treeID", "nodeData"])


def subset_size(strategy: str, dims: int, trees: int) -> int:
    """Features tried at a node, as MLlib counts them."""
    s = strategy.lower()
    if s == "auto":
        s = "all" if trees == 1 else "sqrt"
    named = {"all": dims, "sqrt": int(np.ceil(np.sqrt(dims))), "log2": max(1, int(np.ceil(np.log2(max(dims, 1))))),
             "onethird": int(np.ceil(dims / 3.0))}
    if s in named:
        return named[s]
    return min(int(s), dims) if s.isdigit() else int(np.ceil(float(s) * dims))


class CellForest(RandomForestClassifier):
    """MLlib's forest; the fit on counted cells where they are few enough."""

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel:
        get = self.getOrDefault
        weight = get(self.weightCol) if self.isDefined(self.weightCol) and get(self.weightCol) else None
        if get(self.impurity) != "gini" or self.isSet("thresholds"):
            return super()._fit(dataset)
        counted = counted_rows(dataset, get(self.featuresCol), get(self.labelCol), weight)
        def finite(v: Column) -> Column:
            return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))

        label_ok = finite(F.col("label")) & (F.col("label") >= 0) & (F.col("label") == F.floor("label"))
        ok = F.forall("x", finite) & label_ok & finite(F.col("weight")) & (F.col("weight") >= 0)
        facts = counted.agg(F.max(F.size("x")), F.max("label"), F.count_if(~F.coalesce(ok, F.lit(False))), F.sum("n"))
        dims, top, bad, n = facts.first()
        if not n or bad or not dims or top >= 100:  # MLlib raises its own errors
            return super()._fit(dataset)
        bins = int(min(get(self.maxBins), n))
        cuts = bin_cuts(counted, dims, bins)
        table = cells(counted, cuts)
        if table.count() * dims > CELLS:
            return super()._fit(dataset)
        return self._grown(dataset.sparkSession, table, cuts, int(top) + 1 if top >= 1 else 2)

    def _grown(self, spark: SparkSession, table: DataFrame, cuts: list[list[float]], classes: int) -> RandomForestClassificationModel:
        get = self.getOrDefault
        got = table.orderBy("codes", "label", "weight").toArrow()  # bounded by CELLS
        dims, trees, seed = len(cuts), get(self.numTrees), get(self.seed)
        codes = np.ascontiguousarray(got["codes"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).T)
        columns = [got["label"].to_numpy().astype(np.int64), got["n"].to_numpy(), got["weight"].to_numpy()]
        shared = spark.sparkContext.broadcast((codes, *columns, cuts))
        subset = subset_size(get(self.featureSubsetStrategy), dims, trees)
        rate, bootstrap = get(self.subsamplingRate), get(self.bootstrap)
        rule = (get(self.maxDepth), get(self.minInstancesPerNode), get(self.minWeightFractionPerNode), get(self.minInfoGain))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, label, count, weight, own_cuts = shared.value
            for b in batches:
                for t in b.column(0).to_pylist():
                    raw = drawn(count, rate, bootstrap, seed, t)
                    tree = grow_tree(x, label, raw, weight, classes, [len(c) + 1 for c in own_cuts], subset, *rule,
                                     np.random.default_rng([seed & 0xFFFFFFFF, t, 1 << 31]))
                    yield node_rows(t, pruned(tree), own_cuts)

        path = scratch_path(spark, "forest")
        # a task takes its trees one by one; several, so that the cells are not unpacked for each
        tasks = min(trees, 4 * default_parallelism(spark))
        spark.range(0, trees, 1, numPartitions=tasks).mapInArrow(run, NODE_SCHEMA).write.parquet(f"{path}/data")
        shared.destroy()
        return self._read_back(spark, path, dims, classes)

    def _read_back(self, spark: SparkSession, path: str, dims: int, classes: int) -> RandomForestClassificationModel:
        """The written nodes as a model with this estimator's parameters.  The
        layout of what stands beside them is that of a forest of one leaf."""
        get = self.getOrDefault
        own = [(Vectors.dense([0.0] * dims), float(i), 1.0) for i in (0, 1)]
        names = [get(self.featuresCol), get(self.labelCol), get(self.weightCol) if self.isDefined(self.weightCol) else "weight"]
        small = self.copy({self.numTrees: 1, self.cacheNodeIds: False})
        super(CellForest, small)._fit(spark.createDataFrame(own, names).coalesce(1)).save(f"{path}-layout")
        head = json.loads(spark.read.text(f"{path}-layout/metadata").first()[0])
        trees = get(self.numTrees)
        head |= {"numFeatures": dims, "numClasses": classes, "numTrees": trees}
        head["paramMap"] |= {"numTrees": trees}
        spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        one = spark.read.parquet(f"{path}-layout/treesMetadata").where("_1 = 0")
        one.crossJoin(spark.range(0, trees, 1, 1)).select(F.col("id").cast("int").alias("_1"), "_2", "_3").write.parquet(f"{path}/treesMetadata")
        model = RandomForestClassificationModel.load(path)
        model.flat = flat_nodes(spark, path)
        return model


def flat_nodes(spark: SparkSession, path: str) -> tuple[np.ndarray, ...] | None:
    """(feature, threshold, left, right, shares, roots) of the nodes of the
    forest saved at ``path``; a leaf leads to itself, ``shares`` are its votes
    by class.  None if a split is by categories.  No larger than the model."""
    nodes = spark.read.schema(NODE_SCHEMA).parquet(f"{path}/data")
    split, n = F.col("nodeData.split"), F.col("nodeData")
    rows = nodes.select("treeID", n["id"].alias("id"), n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["impurityStats"].alias("stats"),
                        split["featureIndex"].alias("feature"), split["numCategories"].alias("categories"),
                        F.get(split["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"))
    got = rows.orderBy("treeID", "id").toArrow()
    if not got.num_rows or (got["categories"].to_numpy() != -1).any():
        return None
    roots = np.flatnonzero(got["id"].to_numpy() == 0)
    first = np.repeat(roots, np.diff(np.append(roots, got.num_rows)))
    left, here = got["left"].to_numpy(), np.arange(got.num_rows)
    leaf = left < 0
    stats = got["stats"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(got.num_rows, -1)
    total = np.zeros(len(stats))
    for c in stats.T:  # one after the other, as MLlib adds them
        total = total + c
    shares = np.divide(stats, total[:, None], out=np.zeros_like(stats), where=total[:, None] != 0)
    return (np.where(leaf, 0, got["feature"].to_numpy()).astype(np.int32), np.where(leaf, 0.0, got["threshold"].to_numpy(zero_copy_only=False)),
            np.where(leaf, here, first + left).astype(np.int32), np.where(leaf, here, first + got["right"].to_numpy()).astype(np.int32), shares, roots)


def votes(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, right: np.ndarray, shares: np.ndarray,
          roots: np.ndarray) -> np.ndarray:
    """(rows x classes) sums of the shares of the leaves to which the trees
    lead, tree after tree; a missing value goes right."""
    out = np.zeros((len(x), shares.shape[1]))
    flat, dims = np.ascontiguousarray(x).ravel(), x.shape[1]
    for root in roots:
        at, rows = np.full(len(x), root, np.int32), np.arange(len(x))
        while len(rows):
            own = at[rows]
            after = np.where(flat[rows * dims + feature[own]] <= threshold[own], left[own], right[own])
            at[rows] = after
            rows = rows[left[after] != after]
        out += shares[at]
    return out


class FlatForest(RandomForestClassificationModel):
    """A fitted forest that scores by ``votes``; what it cannot walk so
    (splits by categories, thresholds, leaf ids) is left to MLlib."""

    def __init__(self, model: RandomForestClassificationModel):
        super().__init__(model._java_obj.copy(self._empty_java_param_map()))  # its own: a wrapper that goes frees its object
        self._resetUid(model.uid)
        self._transfer_params_from_java()
        self.flat = getattr(model, "flat", None)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get, spark = self.getOrDefault, dataset.sparkSession
        plain = get(self.leafCol) or self.isSet("thresholds")
        if not plain and self.flat is None:
            path = scratch_path(spark, "forest-nodes")
            self.save(path)
            self.flat = flat_nodes(spark, path)
        if plain or self.flat is None:
            return super()._transform(dataset)
        shared = spark.sparkContext.broadcast(self.flat)

        @F.pandas_udf("array<double>")
        def walked(vectors: pd.Series) -> pd.Series:
            return pd.Series(list(votes(np.stack(vectors.to_numpy()), *shared.value))) if len(vectors) else vectors

        raw, names = F.col("_votes"), [get(c) for c in (self.rawPredictionCol, self.probabilityCol, self.predictionCol)]
        total = F.aggregate(raw, F.lit(0.0), lambda a, b: a + b)
        new = [array_to_vector(raw), array_to_vector(F.transform(raw, lambda v: F.when(total != 0, v / total).otherwise(v))),
               (F.array_position(raw, F.array_max(raw)) - 1).cast("double")]
        out = dataset.withColumn("_votes", walked(vector_to_array(F.col(get(self.featuresCol)))))
        return out.withColumns({name: c for name, c in zip(names, new) if name}).drop("_votes")


class CountedBoosting(GBTClassifier):
    """MLlib's boosted trees, on distinct rows weighted by their counts."""

    def _fit(self, dataset: DataFrame):
        get = self.getOrDefault
        weight = get(self.weightCol) if self.isDefined(self.weightCol) and get(self.weightCol) else None
        if get(self.subsamplingRate) < 1.0 or get(self.minInstancesPerNode) > 1 or (
                self.isDefined(self.validationIndicatorCol) and get(self.validationIndicatorCol)):
            return super()._fit(dataset)
        counted = counted_rows(dataset, get(self.featuresCol), get(self.labelCol), weight)
        meta = dataset.schema[get(self.featuresCol)].metadata
        rows = counted.select(array_to_vector("x").alias(get(self.featuresCol), metadata=meta), F.col("label").alias(get(self.labelCol)),
                              (F.col("weight") * F.col("n")).alias(weight or "_n"))
        return super(CountedBoosting, self.copy({self.weightCol: weight or "_n"}))._fit(rows)
