"""Target-distribution importance resampling.

Hashed word and word-pair features are counted over all source documents and
over the target texts; the log ratio of both shares is an array of gains, one
for each bucket, and a document's weight is the mean gain of its features.
With a Gumbel draw added, the highest scores are a weighted sample without
replacement.  A quantile sketch brackets the lowest score that is drawn, exact
counts outside validate the bracket or widen it, and only the bracket is
sorted to find the cutoff.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callrank.llm.common import materialise, small_batches
from callrank.operators.ranking import exact_row_number

#: Words of lower-cased UTF-8: digits, a-z and every byte of a wide character.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Distinct words whose hashes a Python worker remembers, and their longest.
WORDS_KEPT, WORD_BYTES = 400_000, 64

#: Rank error of the quantile sketch, a share of the rows.
SKETCH_ERROR = 1e-3


class _Hashes(dict):
    """word -> (its crc32, the word with a blank before it)."""

    def __missing__(self, word: bytes) -> tuple[int, bytes]:
        got = crc32(word), b" " + word
        if len(self) < WORDS_KEPT and len(word) <= WORD_BYTES:
            self[word] = got
        return got


def text_buckets(text: str | None, buckets: int, known: dict | None = None) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of one or two words."""
    known = _Hashes() if known is None else known
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
    if not words:
        return 0, np.zeros(0, np.uint32)
    one, spaced = zip(*[known[w] for w in words])
    # a pair's hash goes on from its first word's
    pairs = map(crc32, spaced[1:], one)
    return len(words), np.fromiter((*one, *pairs), np.uint32, 2 * len(words) - 1) % np.uint32(buckets)


def bucket_table(docs: DataFrame, buckets: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n_words, buckets) written once: little-endian unsigned
    integers, of two bytes if ``buckets`` allows it."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    width = _width(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for b in batches:
            got = [text_buckets(t, buckets, known) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in got], pa.int64()),
                                              pa.array([x.astype(width).tobytes() for _, x in got], pa.binary())],
                                             ["doc_id", "n_words", "buckets"])

    schema = T.StructType([own.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("buckets", T.BinaryType())])
    return materialise(own.mapInArrow(run, schema), "feature-buckets")


def _width(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def bucket_counts(table: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows: one array a task, summed."""
    width = _width(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.bincount(np.frombuffer(x.as_py(), width), minlength=buckets)
        at = total.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    rows = table.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Scaled log ratio of the smoothed shares of each bucket."""
    b, s, t = len(source), float(source.sum()), float(target.sum())
    ratio = ((target + 1.0) * (s + b)) / ((source + 1.0) * (t + b))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighted(table: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain."""
    width = _width(len(gains))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.frombuffer(x.as_py(), width) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(x) for x in rows], pa.int64()),
                 pa.array([int(gains[x].sum()) // len(x) if len(x) else 0 for x in rows], pa.int64())],
                ["doc_id", "n_words", "n_features", "weight"])

    fields = [table.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]]
    return table.select("doc_id", "n_words", "buckets").mapInArrow(run, T.StructType(fields))


def gumbel(seed: int):
    """floor(1000 times a Gumbel variate) from the hash of ``seed:doc_id``."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def bracket(rows: DataFrame, score: str, n: int, k: int, error: float = SKETCH_ERROR) -> tuple[float, float, int]:
    """(low, high, above): the k-th highest score lies between low and high,
    both included, and exactly ``above`` < k rows lie above high.  Both ends
    come from a quantile sketch; exact counts validate them, and a bracket
    that misses is widened until it holds the k-th."""
    at, margin = 1.0 - k / n, 2 * error
    while True:
        low, high = rows.approxQuantile(score, [max(0.0, at - margin), min(1.0, at + margin)], error)
        got = rows.agg(F.count_if(F.col(score) > high).alias("above"), F.count_if(F.col(score) >= low).alias("from")).first()
        if got["above"] < k <= got["from"]:
            return low, high, got["above"]
        if margin >= 1.0:  # a sketch of error above 0 may miss the ends themselves
            ends = rows.agg(F.min(score).alias("low"), F.max(score).alias("high")).first()
            return ends["low"], ends["high"], 0
        margin *= 4


def draw_highest(rows: DataFrame, score: str, ties: list[str], k: int, n: int, name: str = "rank",
                 error: float = SKETCH_ERROR) -> DataFrame:
    """``rows`` (n of them, written) with ``name``: 1 to k for the k highest
    scores, ties by ``ties`` ascending; null for the rest.  Ranks are numbered
    by all tasks (range partitions), the bracket's apart from those above."""
    none = F.lit(None).cast("long").alias(name)
    if k <= 0 or n <= 0:
        return rows.select("*", none)
    low, high, above = bracket(rows, score, n, k, error)
    order = [F.col(score).desc(), *[F.col(c).asc() for c in ties]]
    edge = exact_row_number(rows.where(F.col(score).between(low, high)), order, name=name)
    edge = edge.withColumn(name, F.when(F.col(name) <= k - above, F.col(name) + above))
    out = edge.unionByName(rows.where(F.col(score) < low).select("*", none))
    if above:
        out = out.unionByName(exact_row_number(rows.where(F.col(score) > high), order, name=name))
    return out


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000,
                        seed: int = 7, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_words, n_features, weight, score
    and rank (1, 2, ... for the floor(percent * N / 100) highest scores of the
    N documents with at least ``least_words`` words; null for all others).

    * Null, empty and wordless texts have no feature and weight 0.
    * Equal scores: the smaller id first, null ids before all; rows that
      repeat an id go by n_features, then weight, and rows equal in all of
      these hold ranks next to each other.  A null id is hashed as empty.
    * Whole texts are read, however long; counts cover all documents, those
      that cannot be drawn as well, and all target texts.
    * Extra columns are not read.  An empty target or source counts nothing;
      an empty table gives an empty result.
    """
    table = bucket_table(docs, buckets, doc_id, text)
    wanted = bucket_table(target.withColumn("_id", F.lit(0)), buckets, "_id", target_text)
    gains = bucket_gains(bucket_counts(table, buckets), bucket_counts(wanted, buckets))
    rows = weighted(table, gains).withColumn("score", F.col("weight") + gumbel(seed))
    rows = materialise(rows, "importance-scores")
    able = rows.where(F.col("n_words") >= least_words)
    n = able.count()
    drawn = draw_highest(able, "score", ["doc_id", "n_features", "weight"], n * percent // 100, n)
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_words", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
