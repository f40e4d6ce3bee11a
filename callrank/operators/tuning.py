"""Grid search of boosted trees (M5-M7), and of resampled folds.

A grid is many fits of one small table, so the fits are dealt to the tasks,
not the table: each task takes one (setting, fold) and fits it alone, and
fits that differ only in their number of rounds are one fit, read at several
stages.  The table is binned once with Spark (approximate quantiles, at most
``BINS`` a feature, as many as MLlib's trees take) and collapsed to distinct
(bins, label) cells with counts, which loses nothing that the trees could
see.  Every fit and every area under ROC is of all rows, however many; only a
caller that asks for ``rows_per_fit`` has a fixed hash sample.  Up to ``CODES``
the cells go to each task.  Beyond that they are dealt to the tasks by a
shuffle, and a task keeps the cells of its fit in files of its own and works on
``BLOCK`` cells at a time, so its disk and time grow with the cells, its memory
does not.  The winner is refitted on all rows by MLlib (``refit``).

Boosting is first-order with logistic loss, the same as MLlib's: the first
tree fits the labels -1 and 1, every further one the residuals, least squares
decide splits, a leaf holds the mean.
"""

from __future__ import annotations

import itertools
import json
import tempfile
from collections.abc import Iterable, Iterator, Mapping
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callrank.functions.expressions import hash_unit
from callrank.session import default_parallelism, scratch_path

#: Bins of a feature.
BINS = 32

#: Codes (cells x features) of all fits that go to each task; more are dealt to the tasks.
CODES = 1 << 23

#: Cells of a fit that are worked on at once; what is kept for more lies in files.
BLOCK = 1 << 17


def blocks(n: int) -> list[slice]:
    return [slice(b, min(b + BLOCK, n)) for b in range(0, n, BLOCK)]


def room(n: int, kind: type = float) -> np.ndarray:
    """``n`` zeros, beyond ``BLOCK`` in a file that goes with them."""
    if n <= BLOCK:
        return np.zeros(n, kind)
    with tempfile.TemporaryFile() as f:
        return np.memmap(f, kind, "w+", shape=(n,))


def split_gains(total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Least-squares gain of cutting after each bin, for rows of (nodes x
    bins) sums and counts; no gain where a side is empty."""
    left, n = total.cumsum(axis=1), count.cumsum(axis=1)
    s, c = left[:, -1:], n[:, -1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left ** 2 / n + (s - left) ** 2 / (c - n) - s ** 2 / c
    return np.where((n > 0) & (c - n > 0), gain, 0.0)


def grow(codes: np.ndarray, total: np.ndarray, count: np.ndarray, depth: int,
         node: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, cut, value) of the nodes of one tree, children of i at 2 i + 1
    and 2 i + 2; feature -1 is a leaf.  ``codes`` is (features x cells).  A
    ``node`` that is given is left with the leaf of each cell."""
    size = 2 ** (depth + 1) - 1
    feature, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
    dims, cells = codes.shape
    node = room(cells, np.int32) if node is None else node
    for b in blocks(cells):
        node[b] = 0
    for level in range(depth + 1):
        first, k = 2 ** level - 1, 2 ** level
        s, c, hist = np.zeros(k), np.zeros(k), np.zeros((dims if level < depth else 0, 2, k * BINS))
        for b in blocks(cells):
            own = np.flatnonzero((count[b] > 0) & (node[b] >= first))
            at, t, n = node[b][own].astype(np.int64) - first, total[b][own], count[b][own]
            s, c = s + np.bincount(at, t, k), c + np.bincount(at, n, k)
            for j, both in enumerate(hist):
                place = at * BINS + codes[j, b][own]
                both += np.bincount(place, t, k * BINS), np.bincount(place, n, k * BINS)
        value[first:first + k] = np.divide(s, c, out=value[first:first + k], where=c > 0)
        if level == depth:
            break
        best, by, after = np.full(k, 1e-9), np.full(k, -1), np.zeros(k, np.int64)
        for j, (sums, counts) in enumerate(hist):
            gain = split_gains(sums.reshape(k, BINS), counts.reshape(k, BINS))
            top = gain.argmax(axis=1)
            more = gain[np.arange(k), top] > best
            best[more], by[more], after[more] = gain[np.arange(k), top][more], j, top[more]
        feature[first:first + k], cut[first:first + k] = by, after
        if (by < 0).all():
            break
        for b in blocks(cells):
            x, at = codes[:, b], node[b]
            # a leaf's value is handed down: its rows stay where they are
            here = np.flatnonzero((at >= first) & (feature[at] >= 0))
            own = at[here]
            at[here] = 2 * own + 1 + (x[feature[own], here] > cut[own])
    return feature, cut, value


def apply(tree: tuple[np.ndarray, np.ndarray, np.ndarray], codes: np.ndarray) -> np.ndarray:
    feature, cut, value = tree
    node = np.zeros(codes.shape[1], np.int64)
    while True:
        here = np.flatnonzero(feature[node] >= 0)
        if not len(here):
            return value[node]
        at = node[here]
        node[here] = 2 * at + 1 + (codes[feature[at], here] > cut[at])


def boost(codes: np.ndarray, positive: np.ndarray, negative: np.ndarray, other: np.ndarray, stages: list[int], depth: int, step: float,
          subsample: float, seed: int) -> dict[int, np.ndarray]:
    """Scores of the ``other`` cells after each number of rounds in
    ``stages``: one fit of the largest, read on the way."""
    rnd = np.random.default_rng(seed)
    cells, others = codes.shape[1], other.shape[1]
    f, p, n, total, count, node = *[room(cells) for _ in range(5)], room(cells, np.int32)
    g, out = room(others), {}
    for i in range(1, max(stages) + 1):
        for drawn, of in ((p, positive), (n, negative)):
            for b in blocks(cells):
                drawn[b] = rnd.binomial(of[b], subsample) if subsample < 1.0 else of[b]
        for b in blocks(cells):
            total[b] = p[b] - n[b] if i == 1 else 4.0 * p[b] / (1.0 + np.exp(2.0 * f[b])) - 4.0 * n[b] / (1.0 + np.exp(-2.0 * f[b]))
            count[b] = p[b] + n[b]
        tree = grow(codes, total, count, depth, node)
        weight = 1.0 if i == 1 else step
        for b in blocks(cells):
            f[b] += weight * tree[2][node[b]]
        for b in blocks(others):
            g[b] += weight * apply(tree, other[:, b])
        if i in stages:
            out[i] = room(others)
            for b in blocks(others):
                out[i][b] = g[b]
    return out


def cell_auc(score: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> float | None:
    """Area under ROC of counted cells, ties half; None with one class.  The
    distinct scores of each block are sorted, then merged a range at a time."""
    v, p, n, ends = room(len(score)), room(len(score)), room(len(score)), [0]
    for b in blocks(len(score)):
        values, at = np.unique(score[b], return_inverse=True)
        own = slice(ends[-1], ends[-1] + len(values))
        v[own], p[own], n[own] = values, np.bincount(at, positive[b]), np.bincount(at, negative[b])
        ends.append(own.stop)
    runs = [slice(*r) for r in itertools.pairwise(ends)]
    steps = max(1, BLOCK // len(runs)) if runs else 1
    marks = np.sort(np.concatenate([v[r][steps::steps] for r in runs])) if len(runs) > 1 else np.zeros(0)
    marks = np.unique(marks[len(runs) - 1::len(runs)])  # a few blocks of scores lie between two of them
    edges = [np.concatenate([[r.start], r.start + np.searchsorted(v[r], marks), [r.stop]]) for r in runs]
    area, below, above = 0.0, 0.0, 0.0
    for own in zip(*[itertools.pairwise(e) for e in edges]):
        _, at = np.unique(np.concatenate([v[a:z] for a, z in own]), return_inverse=True)
        ps, ns = [np.bincount(at, np.concatenate([c[a:z] for a, z in own])) for c in (p, n)]
        area += (ps * (below + ns.cumsum() - ns / 2)).sum()
        below, above = below + ns.sum(), above + ps.sum()
    return float(area / (above * below)) if above and below else None


def _bins(x: Column, cuts: list[float]) -> Column:
    return reduce(add, [(x > F.lit(c)).cast("int") for c in cuts], F.lit(0)).cast("tinyint")


def _cells(rows: DataFrame, features: str, times: Column, learned_times: Column | None) -> DataFrame:
    """(fit, train, codes, positive, negative), written: ``rows`` binned and
    counted, a row ``times`` times (``learned_times``: how often it is repeated
    where bins are learned)."""
    dims = rows.agg(F.max(F.size(features))).first()[0] or 0
    flat = rows.select("fit", "train", "label", times.alias("n"), *[F.col(features)[i].alias(f"x{i}") for i in range(dims)])
    learned = flat.where("train")
    if learned_times is not None:
        learned = learned.select("*", F.explode(F.sequence(F.lit(1).cast("long"), learned_times)))
    cuts = learned.approxQuantile([f"x{i}" for i in range(dims)], [i / BINS for i in range(BINS)], 1e-3) if dims else []
    code = F.array(*[_bins(F.col(f"x{i}"), sorted(set(c))[:BINS - 1]) for i, c in enumerate(cuts)])
    cells = flat.select("fit", "train", code.alias("codes"), "label", "n").groupBy("fit", "train", "codes").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("positive"),
        F.sum(F.when(F.col("label") == 1, 0).otherwise(F.col("n"))).alias("negative"))
    path = scratch_path(rows.sparkSession, "fit-cells")
    cells.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _most(rows: DataFrame, n: Column) -> int:
    return rows.groupBy("fit", "train").agg(n.alias("n")).agg(F.max("n")).first()[0] or 0


def fit_cells(rows: DataFrame, features: str = "x", rows_per_fit: int | None = None) -> DataFrame:
    """(fit, train, codes, positive, negative), written: the ``rows`` (fit,
    train, ``features`` array, label 0/1, and key or n) binned and counted, all
    of them.  A caller may ask for a hash sample of about ``rows_per_fit`` rows
    a fit (of rows with n only if their cells are more)."""
    n = F.col("n") if "n" in rows.columns else None
    if n is None:
        path = scratch_path(rows.sparkSession, "fit-rows")
        rows.select("fit", "train", features, "label", "key").write.parquet(path)
        rows = rows.sparkSession.read.parquet(path)
    if rows_per_fit is None:
        return _cells(rows, features, F.lit(1).cast("long") if n is None else n, n)
    if n is not None:
        cells = _cells(rows, features, n, n)
        if _most(cells, F.count("*")) <= rows_per_fit:
            return cells
        # each of a row's n copies stays with one probability; only the fraction is drawn
        share = rows_per_fit / _most(rows, F.sum("n"))
        drawn = F.floor(n * share + hash_unit(17, F.to_json(features), "label")).cast("long")
        return _cells(rows.withColumn("n", drawn).where("n > 0"), features, n, n)
    most = _most(rows, F.count("*"))
    if most > rows_per_fit:
        rows = rows.where(hash_unit(17, "key") < rows_per_fit / most)
    return _cells(rows, features, F.lit(1).cast("long"), None)


def counted_folds(df: DataFrame, fold: str, features: str = "features", label: str = "label", test: DataFrame | None = None,
                  folds: int = 3) -> DataFrame:
    """The fits of ``folded`` with equal rows counted (n) before they are dealt
    to the fits: one pass over ``df``, whatever the number of folds."""
    def slim(d, fold):
        x = d.select(fold.alias("fold"), vector_to_array(F.col(features)).alias("x"), F.col(label).cast("int").alias("label"))
        return x.groupBy("fold", "x", "label").agg(F.count("*").alias("n"))
    own = slim(df, F.col(fold)) if test is None else slim(df, F.col(fold)).unionByName(slim(test, F.lit(None).cast("int")))
    path = scratch_path(df.sparkSession, "counted-folds")
    own.write.parquet(path)
    own = df.sparkSession.read.schema(own.schema).parquet(path)
    # null folds are the test rows, of the last fit alone
    fits = F.when(F.col("fold").isNull(), F.array(F.lit(folds))).otherwise(F.sequence(F.lit(0), F.lit(folds if test is not None else folds - 1)))
    return own.withColumn("fit", F.explode(fits)).select(
        "fit", F.coalesce(F.col("fit") != F.col("fold"), F.lit(False)).alias("train"), "x", "label", "n")


def folded(df: DataFrame, fold: str, key: Iterable[str], features: str = "features", label: str = "label",
           test: DataFrame | None = None, folds: int = 3) -> DataFrame:
    """The rows of every fit of a cross validation: fit f trains on the folds
    other than f and is tested on f; fit ``folds`` trains on all and is tested
    on ``test``."""
    def slim(d, train, fit):
        return d.select(fit.alias("fit"), train.alias("train"), vector_to_array(F.col(features)).alias("x"), F.col(label).cast("int").alias("label"),
                        F.concat_ws(":", *[F.col(k).cast("string") for k in key]).alias("key"))
    fits = df.withColumn("_fit", F.explode(F.sequence(F.lit(0), F.lit(folds if test is not None else folds - 1))))
    out = slim(fits, F.col("_fit") != F.col(fold), F.col("_fit"))
    return out if test is None else out.unionByName(slim(test, F.lit(False), F.lit(folds)))


FIT_SCHEMA = "params string, fit int, auc double"


def _read_fit(tables: tuple, job: tuple, stages: list[int], seed: int) -> pa.RecordBatch:
    """The stages of one fit; ``tables`` holds its cells to learn from and to be scored."""
    depth, step, subsample, f = job
    (x, p, n), (y, yp, yn) = tables
    done = boost(x, p, n, y, stages, depth, step, subsample, seed) if x.size and y.size else {r: None for r in stages}
    rows = [(json.dumps({"maxDepth": depth, "maxIter": r, "stepSize": step, "subsamplingRate": subsample}, sort_keys=True), f,
             None if g is None else cell_auc(g, yp, yn)) for r, g in done.items()]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()),
                                       pa.array([r[2] for r in rows], pa.float64())], ["params", "fit", "auc"])


def _flat_codes(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _shared_fits(cells: DataFrame, settings: list[tuple], stages: list[int], seed: int, path: str) -> None:
    """One task a fit and setting; the cells go to each."""
    spark = cells.sparkSession
    got = cells.orderBy("fit", "train", "codes").toArrow()  # bounded by CODES
    fit, train = got["fit"].to_numpy(), got["train"].to_numpy(zero_copy_only=False)
    codes = _flat_codes(got["codes"].combine_chunks()).astype(np.int64)
    data = {int(f): [(np.ascontiguousarray(codes[m].T), got["positive"].to_numpy()[m], got["negative"].to_numpy()[m])
                     for m in ((fit == f) & train, (fit == f) & ~train)] for f in np.unique(fit)}
    jobs = [(*s, f) for s in settings for f in data]
    shared = spark.sparkContext.broadcast((data, jobs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, todo = shared.value
        for b in batches:
            for i in b.column(0).to_pylist():
                yield _read_fit(tables[todo[i][-1]], todo[i], stages, seed)

    spark.range(0, len(jobs), 1, numPartitions=max(1, len(jobs))).mapInArrow(run, FIT_SCHEMA).write.parquet(path)
    shared.destroy()


def _filed(batches: Iterable[pa.RecordBatch]) -> tuple:
    """Cells, those to be scored first, in files: those to learn from, those to be scored."""
    with tempfile.TemporaryFile() as x, tempfile.TemporaryFile() as p, tempfile.TemporaryFile() as n:
        size, learned, dims = 0, 0, 0
        for b in batches:
            codes = _flat_codes(b["codes"])
            for f, column in ((x, codes), (p, b["positive"].to_numpy()), (n, b["negative"].to_numpy())):
                column.tofile(f)
            size, learned, dims = size + b.num_rows, learned + b["train"].true_count, codes.shape[1]
        codes = np.memmap(x, np.int8, "r", shape=(size, dims)).T
        p, n = [np.memmap(f, np.int64, "r", shape=(size,)) for f in (p, n)]
    return tuple((codes[:, m], p[m], n[m]) for m in (slice(size - learned, size), slice(0, size - learned)))


def _dealt_fits(cells: DataFrame, settings: list[tuple], stages: list[int], seed: int, path: str) -> None:
    """A task has the cells of one fit and some of the settings, which it fits
    one after the other; as many tasks as keep the session busy, so that no more
    copies of the cells are shuffled."""
    spark = cells.sparkSession
    fits = sorted(r.fit for r in cells.select("fit").distinct().collect())  # the folds, and one
    parts = min(len(settings), -(-2 * default_parallelism(spark) // len(fits)))
    todo = {(f, i): settings[i::parts] for f in fits for i in range(parts)}
    place = F.create_map(*[F.lit(v) for i, f in enumerate(fits) for v in (f, i * parts)])[F.col("fit")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (b for b in batches if b.num_rows)
        first = next(own, None)
        if first is not None:
            key = fit, _ = first["fit"][0].as_py(), first["part"][0].as_py()
            tables = _filed(itertools.chain([first], own))
            for s in todo[key]:
                yield _read_fit(tables, (*s, fit), stages, seed)

    dealt = cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = dealt.repartitionById(len(todo), (place + F.col("part")).cast("int")).sortWithinPartitions("train", "codes")
    dealt.mapInArrow(run, FIT_SCHEMA).write.parquet(path)


def grid_fits(cells: DataFrame, grid: Mapping[str, list], seed: int = 42) -> DataFrame:
    """(params, fit, auc) of every setting of the grid (maxIter, maxDepth,
    stepSize, subsamplingRate) and fit of ``cells`` (``fit_cells``)."""
    spark = cells.sparkSession
    settings = list(itertools.product(grid["maxDepth"], grid["stepSize"], grid["subsamplingRate"]))
    settings.sort(key=lambda s: -s[0])  # deep trees first: they take longest
    count, dims = cells.agg(F.count("*"), F.max(F.size("codes"))).first()
    path = scratch_path(spark, "grid-fits")
    fitted = _shared_fits if count * (dims or 0) <= CODES else _dealt_fits
    fitted(cells, settings, sorted(grid["maxIter"]), seed, path)
    return spark.read.schema(FIT_SCHEMA).parquet(path)


def search(rows: DataFrame, grid: Mapping[str, list], folds: int = 3, seed: int = 42, rows_per_fit: int | None = None) -> DataFrame:
    """M5/M6: one row for each setting: params (JSON), cv_auc and cv_auc_std
    over the folds, best (the first by params among equals), and test_auc (of
    the fit on all folds; null if ``rows`` hold no test rows).  All rows are
    used unless ``rows_per_fit`` asks for a sample."""
    fits = grid_fits(fit_cells(rows, rows_per_fit=rows_per_fit), grid, seed)
    inside = F.when(F.col("fit") < folds, F.col("auc"))
    out = fits.groupBy("params").agg(F.avg(inside).alias("cv_auc"), F.stddev_samp(inside).alias("cv_auc_std"),
                                     F.max(F.when(F.col("fit") == folds, F.col("auc"))).alias("test_auc"))
    top = out.orderBy(F.desc_nulls_last("cv_auc"), "params").limit(1).select("params").scalar()
    return out.withColumn("best", F.col("params") == top)


def refit(spark: SparkSession, results: DataFrame, estimator, df: DataFrame):
    """The winner fitted by MLlib on all rows of ``df``."""
    best = json.loads(results.where("best").first()["params"])
    return estimator.copy({estimator.getParam(k): v for k, v in best.items()}).fit(df)


def smote_folded(df: DataFrame, fold: str, key: str, features: str = "features", label: str = "label", test: DataFrame | None = None,
                 folds: int = 3, k: int = 5, seed: int = 42, nominal: int = 0) -> DataFrame:
    """The rows of every fit with SMOTE inside it (the last ``nominal``
    features are label codes).  The training rows of
    each fold are resampled once, whatever the number of settings; test rows
    are the original ones."""
    from callrank.operators.resample import smote_samples
    plain = folded(df, fold, [key], features, label, test, folds)
    path = scratch_path(df.sparkSession, "fold-rows")
    plain.write.parquet(path)
    plain = df.sparkSession.read.parquet(path)
    dims = plain.agg(F.max(F.size("x"))).first()[0] or 0
    out = plain
    for f in range(folds + (test is not None)):
        own = plain.where((F.col("fit") == f) & F.col("train")).select("key", "x", "label")
        new = smote_samples(own, "x", dims, "label", ["key"], k, seed, nominal=nominal)
        out = out.unionByName(new.select(F.lit(f).alias("fit"), F.lit(True).alias("train"), "x", "label",
                                         F.concat_ws(":", "key", F.col("copy").cast("string")).alias("key")))
    return out
