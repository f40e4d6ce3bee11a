"""SMOTE at scale (E8) and resampling inside each fold.

Neighbours.  SMOTE interpolates between a minority row and one of its k
nearest minority neighbours.  Neighbours are searched among *distinct*
minority vectors (a vector repeated by a third of the rows is one point;
interpolating between two copies of one point would only copy it).  The
search is exact and, up to ``UNROLLED`` features, never forms all pairs.
Space is cut into box cells by median splits of the widest feature, up to 256
cells a level, and cells that are still crowded are cut again.  Each vector first meets its own cell, which
bounds the distance of its k-th neighbour; then it walks down the boxes,
keeps those that its own ball touches, and meets only their vectors.  So
every query stops alone, and what it meets follows how the data lie, not a
fixed number of bands.  With more features a ball touches nearly every cell:
there blocks of vectors, bounded in size, are compared with each other.

Categories.  With trailing label codes (``nominal``) the distance is that of
SMOTE-NC: a differing code adds the squared median of the standard deviations
of the class's continuous features.  A synthetic row takes its parent's
neighbours' most frequent code, so no code between two categories appears.

Draws.  Copies, neighbour choice and the interpolation weight u come from
md5(seed:key[:copy]), never from partitioning, so the output repeats
under any repartition and can be re-derived in SQL.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callrank.functions.expressions import hash_hex_key
from callrank.operators.split import hash_rank
from callrank.session import cut_lineage, join_small, scratch_path


#: Beyond so many features a distance is a loop over arrays, as the compiled
#: code of a sum of single terms would grow too large.
UNROLLED = 32


def _sum_squares(gap, arrays: list[Column], dims: int) -> Column:
    """Sum of ``gap(entries of the arrays)`` squared over the first ``dims`` entries, in their order."""
    if dims <= UNROLLED:
        terms = [gap(*[a[i] for a in arrays]) for i in range(dims)]
        return reduce(add, [t * t for t in terms], F.lit(0.0))
    rows = F.slice(F.arrays_zip(*[a.alias(f"a{j}") for j, a in enumerate(arrays)]), 1, dims)
    gaps = F.transform(rows, lambda r: gap(*[r[f"a{j}"] for j in range(len(arrays))]))
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)


def _penalties(differs, dims: int, nominal: int, penalty: float) -> list[Column]:
    return [F.when(differs(i), F.lit(penalty)).otherwise(F.lit(0.0)) for i in range(dims - nominal, dims)]


def sq_dist(a: str, b: str, dims: int, nominal: int = 0, penalty: float = 0.0) -> Column:
    """Squared distance of two array<double> columns: Euclidean, and
    ``penalty`` for each of the last ``nominal`` entries that differs."""
    x, y = F.col(a), F.col(b)
    near = _sum_squares(lambda p, q: p - q, [x, y], dims - nominal)
    return reduce(add, _penalties(lambda i: x[i] != y[i], dims, nominal, penalty), near)


def _box_dist(x: str, lo: str, hi: str, dims: int, nominal: int, penalty: float) -> Column:
    """The least ``sq_dist`` that a vector inside the box can have: each term
    is at most that of any vector there, in doubles too."""
    v, p, q = F.col(x), F.col(lo), F.col(hi)
    near = _sum_squares(lambda c, a, b: F.greatest(a - c, c - b, F.lit(0.0)), [v, p, q], dims - nominal)
    return reduce(add, _penalties(lambda i: (v[i] < p[i]) | (v[i] > q[i]), dims, nominal, penalty), near)


def _hex_unit(h: Column, start: int) -> Column:
    return F.conv(F.substring(h, start, 8), 16, 10).cast("bigint")


#: The splits of a cell are fitted on about this many of its vectors, whatever its size.
FIT_ROWS = 4096

#: Median splits between a cell and its children: at most 2 ** DEPTH of them.
DEPTH = 8


def median_splits(points: np.ndarray, least: int, spread: np.ndarray) -> tuple[list[int], list[float]]:
    """(feature, cut) of the inner nodes of a tree of ``DEPTH`` levels, children
    of i at 2 i + 1 (values up to the cut) and 2 i + 2.  A node that is not
    split has the cut infinity.  Each side of a split has at least ``least`` of
    the points; the feature is the widest one (``spread`` replaces the variance
    where it is not NaN) that leaves an eighth on either side, else the one
    that splits most evenly."""
    size = 2 ** DEPTH - 1
    feature, cut = [0] * size, [float("inf")] * size
    todo = [(0, np.arange(len(points)))]
    while todo:
        node, rows = todo.pop()
        if node >= size or len(rows) < 2 * least:
            continue
        own, m, best = points[rows], len(rows), None
        width = np.where(np.isnan(spread), own.var(axis=0), spread)
        for j in np.argsort(-width, kind="stable"):
            x = np.sort(own[:, j])
            steps = np.flatnonzero(x[1:] > x[:-1]) + 1  # how many values lie up to each possible cut
            steps = steps[(steps >= least) & (m - steps >= least)]
            if not len(steps):
                continue
            left = steps[np.abs(2 * steps - m).argmin()]
            small = min(left, m - left)
            if best is None or small > best[0]:
                best = (small, int(j), float(x[left - 1]))
            if 8 * small >= m:
                best = (small, int(j), float(x[left - 1]))
                break
        if best is None:
            continue
        _, feature[node], cut[node] = best
        right = own[:, best[1]] > best[2]
        todo += [(2 * node + 1, rows[~right]), (2 * node + 2, rows[right])]
    return feature, cut


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _cells(V: DataFrame, vec: str, dims: int, least: int, per_cell: int, nominal: int,
           penalty: float) -> tuple[DataFrame, list[DataFrame]]:
    """(``vec``, _c) with the cell of every vector, and for each level the
    boxes (_p, _c, _lo, _hi) of the cells below each cell of the level above
    (the first is cell 0).  A cell of more than two times ``per_cell`` vectors
    is cut again, unless its last cut left it whole.  Every cell holds at
    least ``least`` vectors if the table does."""
    spread = np.array([np.nan] * (dims - nominal) + [penalty / 2] * nominal)

    def fit(key, table):
        n = table["_n"][0].as_py()
        points = np.array(table["_v"].to_pylist(), float).reshape(table.num_rows, dims)
        # stop where a side would stand for fewer than half of per_cell vectors
        feature, cut = median_splits(points, max(least, per_cell * table.num_rows // (2 * n)), spread)
        return pa.table({"_c": pa.array([key[0].as_py()], pa.int64()), "_dim": pa.array([feature], pa.list_(pa.int32())),
                         "_cut": pa.array([cut], pa.list_(pa.float64()))})

    V = V.select(vec, F.lit(0).cast("long").alias("_c"))
    crowded = V.groupBy("_c").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 2 * per_cell)
    levels = []
    while True:
        crowded = _written(crowded, "crowded-cells")
        if crowded.isEmpty():
            return V, levels
        rows = join_small(V, crowded, ["_c"]).select("_c", "_n", F.col(vec).alias("_v"))
        rows = rows.where(F.pmod(F.xxhash64("_v"), F.ceil(F.col("_n") / FIT_ROWS)) == 0)
        trees = rows.groupBy("_c").applyInArrow(fit, "_c long, _dim array<int>, _cut array<double>")
        at = join_small(V, trees, ["_c"], "left")
        down = F.aggregate(F.array_repeat(F.lit(0), DEPTH), F.lit(0), lambda i, _: i * 2 + 1 + F.when(
            F.get(F.col(vec), F.get(F.col("_dim"), i)) > F.get(F.col("_cut"), i), 1).otherwise(0))
        leaf = F.coalesce(F.when(F.col("_dim").isNotNull(), down - (2 ** DEPTH - 1)), F.lit(0))
        V = _written(at.select(vec, F.col("_c").alias("_p"), (F.col("_c") * 2 ** DEPTH + leaf).alias("_c")), "cells")
        edge = V.select("_p", "_c", F.posexplode(vec).alias("_i", "_x")).groupBy("_p", "_c", "_i").agg(
            F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        edge = edge.groupBy("_p", "_c").agg(F.max("_n").alias("_n"), F.sort_array(F.collect_list(F.struct("_i", "_lo", "_hi"))).alias("_e"))
        boxes = _written(edge.select("_p", "_c", "_n", F.col("_e._lo").alias("_lo"), F.col("_e._hi").alias("_hi")), "boxes")
        levels.append(boxes.select("_p", "_c", "_lo", "_hi"))
        crowded = boxes.withColumn("_all", F.sum("_n").over(Window.partitionBy("_p"))).where(
            (F.col("_n") > 2 * per_cell) & (F.col("_n") < F.col("_all"))).select("_c", "_n")
        V = V.select(vec, "_c")


def _touched(own: DataFrame, levels: list[DataFrame], vec: str, dims: int, nominal: int = 0,
             penalty: float = 0.0) -> DataFrame:
    """(``vec``, _rad, _at): the cells other than its own that the ball of a
    vector touches, found from the top by joins on the cell above."""
    walk = own.groupBy(vec).agg(F.first("_c").alias("_own"), F.max("d2").alias("_rad"))
    # a column, not a constant: the join with the first level stays an equi-join
    walk = walk.withColumn("_at", F.shiftright("_own", DEPTH * len(levels)))
    for boxes in levels:
        walk = join_small(walk, boxes, F.col("_at") == F.col("_p"))
        walk = walk.where(_box_dist(vec, "_lo", "_hi", dims, nominal, penalty) <= F.col("_rad"))
        walk = walk.select(vec, "_own", "_rad", F.col("_c").alias("_at"))
    return walk.where(F.col("_at") != F.col("_own")).drop("_own")


#: Bytes of the vectors of a block, and pairs that are held at once where two blocks meet.
BLOCK_BYTES, TILE = 1 << 21, 1 << 17


def block_nearest(x: np.ndarray, ids: np.ndarray, y: np.ndarray, others: np.ndarray, k: int, nominal: int = 0,
                  penalty: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, other, squared distance) of the ``k`` rows of ``y`` nearest to each
    row of ``x``, ties by their ids, the row itself left out.  Terms are added
    in the order of ``sq_dist``, so the doubles are the same."""
    dims, cols, found = x.shape[1], np.ascontiguousarray(y.T), []
    step, last = max(1, TILE // max(len(y), 1)), min(k, len(y) - 1)  # one more than k: the row itself may be among them
    for a in range(0, len(x) if len(y) else 0, step):
        own, mine = x[a:a + step], ids[a:a + step]
        d, term = np.zeros((len(own), len(y))), np.empty((len(own), len(y)))
        with np.errstate(over="ignore", invalid="ignore"):
            for j in range(dims):
                if j < dims - nominal:
                    np.subtract(own[:, j, None], cols[j], out=term)
                    np.multiply(term, term, out=term)
                else:
                    term = np.where(own[:, j, None] != cols[j], penalty, 0.0)
                np.add(d, term, out=d)
            bound = np.partition(d, last, axis=1)[:, last, None]
            r, c = np.nonzero(~(d > bound))  # not greater: NaN comes last
        apart = mine[r] != others[c]
        r, c = r[apart], c[apart]
        order = np.lexsort((others[c], d[r, c], r))
        r, c = r[order], c[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        r, c = r[keep], c[keep]
        found.append((mine[r], others[c], d[r, c]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(part) for part in zip(*found))


def _block_neighbours(V: DataFrame, vec: str, dims: int, k: int, n: int, nominal: int, penalty: float) -> DataFrame:
    """The ``k`` nearest of each of the ``n`` distinct vectors, from all pairs
    of blocks: one task holds two blocks at a time, and only ids leave it."""
    # ids in the order of the vectors, so that they break ties as the vectors do
    V = _written(V.select(F.col(vec).alias("_v")).orderBy("_v").withColumn("_id", F.monotonically_increasing_id()), "numbered-vectors")
    blocks = -(-n // max(1, BLOCK_BYTES // (8 * dims)))
    own = F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = V.select("_id", "_v", own.alias("_i"), every.alias("_j")).groupBy("_i", "_j")
    right = V.select("_id", "_v", every.alias("_i"), own.alias("_j")).groupBy("_i", "_j")

    def vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        x = table["_v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return x.reshape(-1, dims), table["_id"].to_numpy()

    def nearest(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            got = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        else:
            got = block_nearest(*vectors(a), *vectors(b), k, nominal, penalty)
        return pa.table(dict(zip(("_id", "_nb", "d2"), map(pa.array, got))))

    pairs = left.cogroup(right).applyInArrow(nearest, "_id long, _nb long, d2 double")
    near = Window.partitionBy("_id").orderBy("d2", "_nb")
    best = pairs.withColumn("nb_rank", (F.row_number().over(near) - 1).cast("int")).where(F.col("nb_rank") < k)
    best = best.join(V.select("_id", F.col("_v").alias(vec)), "_id")
    return best.join(V.select(F.col("_id").alias("_nb"), F.col("_v").alias("nb")), "_nb").select(vec, "nb_rank", "nb", "d2")


def knn_distinct(points: DataFrame, vec: str, dims: int, k: int, per_cell: int = 64, nominal: int = 0,
                 penalty: float = 0.0) -> DataFrame:
    """Exact k nearest *other* distinct vectors of every distinct vector.

    Returns (vec, nb_rank 0..k'-1, nb, d2), k' = min(k, distinct - 1); ties
    in distance are broken by the neighbour vector (lexicographic).  Vectors
    with a null or NaN entry have no neighbours and are nobody's.

    The k-th candidate of a vector's own cell bounds its search; of all other
    cells only those whose box is not farther than that are joined (equal
    distances included).  A cell that no split divides (nearly all its vectors
    agree in every feature but a few) is compared whole.

    Beyond ``UNROLLED`` features all pairs are compared, block by block."""
    spark = points.sparkSession
    odd = F.exists(F.col(vec), lambda x: x.isNull() | F.isnan(x))
    V = _written(points.select(vec).where(F.col(vec).isNotNull() & ~odd).distinct(), "distinct-vectors")
    n = V.count()
    kk = min(k, n - 1)
    if kk <= 0:
        return spark.createDataFrame([], f"{vec} array<double>, nb_rank int, nb array<double>, d2 double")
    if dims > UNROLLED:
        return _written(_block_neighbours(V, vec, dims, kk, n, nominal, penalty), "neighbours")
    V, levels = _cells(V, vec, dims, kk + 1, per_cell, nominal, penalty)
    dist = sq_dist(vec, "nb", dims, nominal, penalty)
    near = Window.partitionBy(vec).orderBy("d2", "nb")

    def nearest(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("nb_rank", (F.row_number().over(near) - 1).cast("int")).where(F.col("nb_rank") < kk)

    members = V.select(F.col("_c").alias("_n"), F.col(vec).alias("nb"))
    own = V.join(members, F.col("_c") == F.col("_n")).where(F.col(vec) != F.col("nb")).withColumn("d2", dist)
    own = _written(nearest(own.select(vec, "_c", "nb", "d2")), "own-cell")
    got = own.select(vec, "nb", "d2")
    if levels:
        walk = _touched(own, levels, vec, dims, nominal, penalty)
        other = walk.join(members, F.col("_at") == F.col("_n"))
        other = other.withColumn("d2", dist).where(F.col("d2") <= F.col("_rad"))
        got = got.unionByName(other.select(vec, "nb", "d2"))
    return _written(nearest(got).select(vec, "nb_rank", "nb", "d2"), "neighbours")


def nominal_penalty(rows: DataFrame, vec: str, dims: int, nominal: int) -> float:
    """What a differing code adds to the squared distance: the square of the
    median of the continuous features' standard deviations, to six decimals
    (so that it does not hang on the order of summation); 1 without any."""
    if not nominal or nominal == dims:
        return 1.0
    sd = rows.agg(*[F.stddev_pop(F.col(vec)[i]) for i in range(dims - nominal)]).first()
    mid = round(float(np.median([x or 0.0 for x in sd])), 6)
    return mid * mid


def smote_samples(df: DataFrame, vec: str, dims: int, label: str, key: Iterable[str], k: int = 5,
                  seed: int = 42, minority=None, per_cell: int = 64, nominal: int = 0) -> DataFrame:
    """Synthetic rows that grow every smaller class to the majority count.
    The last ``nominal`` entries of the vector are label codes (SMOTE-NC).

    Returns (key..., copy, vec, label) of the synthetic rows only; ``key``
    is the parent row's key.  Row i of a class with n_c rows and need
    n_max - n_c gets floor(need / n_c) copies, plus one for the
    (need mod n_c) rows first in md5(seed:key) order."""
    key = list(key)
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(10001).collect()  # classes: bounded
    if len(counts) > 10000:
        raise ValueError("too many classes for SMOTE")
    n_max = max(r["n"] for r in counts)
    classes = [r for r in counts if r["n"] < n_max and (minority is None or r[label] == minority)]
    out = None
    for c in classes:
        cls, n_c = c[label], c["n"]
        need = n_max - n_c
        rows = df.where(F.col(label) == F.lit(cls)).select(*key, vec)
        penalty = nominal_penalty(rows, vec, dims, nominal)
        nbrs = knn_distinct(rows, vec, dims, k, per_cell, nominal, penalty)
        kk = nbrs.agg(F.max("nb_rank")).first()[0]
        kk = 0 if kk is None else kk + 1
        ranked = hash_rank(rows, None, key, seed, name="_rn")
        base, extra = divmod(need, n_c)
        copies = (ranked.withColumn("_c", F.lit(base) + F.when(F.col("_rn") <= extra, 1).otherwise(0))
                        .where(F.col("_c") > 0)
                        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_c"))))
                        .withColumn("_h2", hash_hex_key(seed, *key, F.col("copy"))))
        u = _hex_unit(F.col("_h2"), 9).cast("double") / F.lit(4294967296.0)
        if kk > 0:
            copies = copies.withColumn("nb_rank", (_hex_unit(F.col("_h2"), 1) % kk).cast("int"))
            # AQE splits a hot parent vector on the big side; the neighbour side is k rows per vector
            j = copies.join(nbrs.select(vec, "nb_rank", "nb"), [vec, "nb_rank"])
            syn = F.zip_with(F.col(vec), F.col("nb"), lambda a, b: a + u * (b - a))
            if nominal:  # the neighbours' most frequent code, the smallest among equals
                codes = [F.mode(F.col("nb")[i], True) for i in range(dims - nominal, dims)]
                codes = nbrs.groupBy(vec).agg(F.array(*codes).alias("_codes"))
                j, syn = j.join(codes, vec), F.concat(F.slice(syn, 1, dims - nominal), F.col("_codes"))
        else:  # one distinct vector: SMOTE degenerates to replication
            j, syn = copies, F.col(vec)
        part = j.select(*key, "copy", syn.alias(vec), F.lit(cls).alias(label))
        out = part if out is None else out.unionByName(part)
    if out is None:
        schema = df.select(*key, F.lit(0).cast("int").alias("copy"), vec, label).schema
        return df.sparkSession.createDataFrame([], schema)
    return out


def smote(df: DataFrame, features: list[str], label: str, key: Iterable[str], k: int = 5,
          seed: int = 42, vec: str = "_x", nominal: Iterable[str] = ()) -> DataFrame:
    """E8 on feature columns: originals plus synthetic rows, with a
    ``synthetic`` flag; synthetic rows keep their parent's key.  ``nominal``
    names those of the features that are label codes (SMOTE-NC)."""
    key, nominal = list(key), list(nominal)
    features = [f for f in features if f not in nominal] + nominal
    arr = df.select(*key, F.array(*[F.col(f).cast("double") for f in features]).alias(vec), label)
    # the narrow (key, vector, label) table is read by every pass below; write it
    # once instead of re-deriving it from the wide source each time
    arr = cut_lineage(arr)
    syn = smote_samples(arr, vec, len(features), label, key, k, seed, nominal=len(nominal))
    orig = arr.withColumn("copy", F.lit(0)).withColumn("synthetic", F.lit(False))
    both = orig.unionByName(syn.withColumn("synthetic", F.lit(True)))
    return both.select(*key, "copy", *[F.col(vec)[i].alias(f) for i, f in enumerate(features)], label, "synthetic")


class SmoteClassifier(Estimator):
    """An Estimator that resamples its *training* data with SMOTE and
    returns the inner classifier's model.  Because resampling happens in
    ``fit`` only, ``CrossValidator`` resamples each training fold and never
    the validation fold; ``transform`` of the returned model never resamples.

    Grid parameters of the inner estimator pass through ``copy``."""

    k = Param(Params._dummy(), "k", "neighbours", typeConverter=TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the draws", typeConverter=TypeConverters.toInt)
    keyCol = Param(Params._dummy(), "keyCol", "row key for the draws", typeConverter=TypeConverters.toString)

    def __init__(self, estimator, k: int = 5, seed: int = 42, keyCol: str | None = None):
        super().__init__()
        self.estimator = estimator
        self._setDefault(k=5, seed=42)
        self._set(k=k, seed=seed)
        if keyCol:
            self._set(keyCol=keyCol)

    def copy(self, extra=None):
        extra = extra or {}
        that = super().copy(extra)
        that.estimator = self.estimator.copy(extra)
        return that

    def _resampled(self, dataset: DataFrame) -> DataFrame:
        fcol, lcol = self.estimator.getFeaturesCol(), self.estimator.getLabelCol()
        k, seed = self.getOrDefault(self.k), self.getOrDefault(self.seed)
        key = [self.getOrDefault(self.keyCol)] if self.isDefined(self.keyCol) else None
        arr = dataset.select(vector_to_array(F.col(fcol)).alias("_x"), F.col(lcol),
                             *([F.col(key[0])] if key else []))
        if not key:
            arr = arr.withColumn("_key", F.to_json(F.col("_x")))
            key = ["_key"]
        dims = len(arr.select("_x").first()[0]) if not arr.isEmpty() else 0
        syn = smote_samples(arr, "_x", dims, lcol, key, k, seed)
        train = arr.select("_x", lcol).unionByName(syn.select("_x", lcol))
        return train.select(array_to_vector("_x").alias(fcol), F.col(lcol).cast("double").alias(lcol))

    def _fit(self, dataset: DataFrame):
        return self.estimator.fit(self._resampled(dataset))

    def fitMultiple(self, dataset: DataFrame, paramMaps):
        """Fits for several settings of the inner estimator: the rows are
        resampled once and written, so a cross validation of n settings
        resamples each training fold once, not n times."""
        own = {p.name for m in paramMaps for p in m if p.parent == self.uid}
        if own:  # settings of the resampling itself
            return super().fitMultiple(dataset, paramMaps)
        return self.estimator.fitMultiple(cut_lineage(self._resampled(dataset)), paramMaps)
