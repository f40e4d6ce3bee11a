"""Document fingerprints by winnowing.

Rolling hashes of all ``k``-grams of code points; of every ``window``
consecutive hashes the smallest is kept, the rightmost on ties, with its
position.  Any passage of at least window + k - 1 code points shared by two
texts then leaves at least one common hash in both fingerprints.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callrank.llm.common import materialise, small_batches
from callrank.session import default_parallelism

K, WINDOW = 16, 64

#: Buckets of the document order for each shuffle partition; their first keys
#: are held by the driver, so their number never follows the documents.
BUCKETS = 8

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so powers never vanish
_MIX = np.uint64(0xD6E8FEB86659FD93)


def rolling_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of every k-gram (of the whole, if shorter): polynomial
    over 64 bits, doubling the gram length, then mixed."""
    x = points.astype(np.uint64) + np.uint64(1)
    if not len(x):
        return np.empty(0, np.uint64)
    k = min(k, len(x))
    h, done, power = x, 1, _BASE
    rest, rest_len, rest_power = None, 0, np.uint64(1)
    with np.errstate(over="ignore"):
        bits = k
        while True:
            if bits & 1:
                if rest is None:
                    rest, rest_len, rest_power = h, done, power
                else:
                    n = len(x) - rest_len - done + 1
                    rest = rest[:n] * power + h[rest_len:rest_len + n]
                    rest_len, rest_power = rest_len + done, rest_power * power
            bits >>= 1
            if not bits:
                break
            n = len(h) - done
            h = h[:n] * power + h[done:done + n]
            done, power = 2 * done, power * power
        rest = rest ^ (rest >> np.uint64(32))
        rest = rest * _MIX
        return rest >> np.uint64(32)


def winnow(points: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) kept, in order of position."""
    h = rolling_hashes(points, k)
    if not len(h):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    at = np.arange(len(h), dtype=np.uint64)
    # hash above, reversed position below: the least value is the rightmost of the least hashes
    m = (h << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - at)
    w, done = min(window, len(h)), 1
    low = m
    while done < w:
        step = min(done, w - done)
        low = np.minimum(low[:len(low) - step], low[step:])
        done += step
    keep = np.r_[True, low[1:] != low[:-1]]
    low = low[keep]
    return (low >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets of hashes; two empty ones are alike."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - both
    return both / every if every else 1.0


def hex_of(hashes: np.ndarray) -> str:
    """Eight hex digits for each kept hash, in order of position."""
    return hashes.astype(">u4").tobytes().hex()


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def document_fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, hashes, positions) for each row: the winnowed fingerprint of
    the whole text.  Null and empty texts have none; a text shorter than k
    is one gram.  Equal texts have equal fingerprints.  Extra columns are
    not read; an empty table gives an empty result."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [winnow(_points(t or ""), k, window) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([h.astype(np.int64) for h, _ in got], pa.list_(pa.int64())),
                 pa.array([p for _, p in got], pa.list_(pa.int64()))], ["doc_id", "hashes", "positions"])

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, hashes array<long>, positions array<long>")


def edited_fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text",
                        bucket_rows: int = 400) -> DataFrame:
    """One row for each document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, positions, edited_positions
    (of the kept hashes, in code points).

    The edited text has its last floor(n_chars / 3) code points replaced by
    the first as many (or all) of the next document's, in descending doc_id
    order (nulls last, equal ids by the hash of the text); after the last
    comes the first.  A lone document is its own next one.

    * Null text is empty.  Repeated rows follow one another.  Ids are whole
      numbers; a string id that is not one raises.
    * ``near_*`` is the Jaccard likeness of the sets of kept hashes.
    * Extra columns are not read; an empty table gives an empty result.

    The order is cut at sampled quantiles into ``BUCKETS`` buckets for each
    shuffle partition (fewer, if they would hold less than ``bucket_rows``
    documents); a bucket is one Spark group of rows, sorted, read as a
    stream, and gets a copy of the next bucket's first document.  So texts
    are shuffled once, and no task holds more than two of them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # ~doc_id falls as doc_id rises, and has no overflow
    own = own.select("doc_id", "text", F.coalesce(F.bitwise_not("doc_id"), F.lit(2 ** 63 - 1).cast("long")).alias("d"),
                     F.xxhash64("text").alias("h"))
    keys = materialise(own.select(F.struct("d", "h").alias("o")), "order")
    parts = max(1, min(BUCKETS * default_parallelism(spark), -(-keys.count() // bucket_rows)))
    firsts = keys.repartitionByRange(parts, "o").groupBy(F.spark_partition_id().alias("p")).agg(F.min("o").alias("o"))
    cuts = sorted((r["o"]["d"], r["o"]["h"]) for r in firsts.select("o").collect())
    buckets = {c: i for i, c in enumerate(cuts)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, ahead, bucket = [], [], []
            for i, o in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                own_bucket = bisect_right(cuts, o) - 1
                at.append(i), ahead.append(False), bucket.append(own_bucket)
                if o in buckets:  # also what follows the bucket before
                    at.append(i), ahead.append(True), bucket.append((own_bucket - 1) % len(cuts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.int64()), pa.array(ahead, pa.bool_()), *[c.take(pa.array(at, pa.int64())) for c in b.columns]],
                ["bucket", "ahead", "doc_id", "text", "d", "h"])

    dealt = own.mapInArrow(deal, "bucket long, ahead boolean, doc_id long, text string, d long, h long")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "ahead", "d", "h")

    def row(doc, points, kept, places, after):
        """``doc`` with its code points, kept hashes and their positions, and those of the next."""
        n = len(points)
        k_out = n // 3
        edited = np.concatenate([points[:n - k_out], after[0][:k_out]])
        got, at = winnow(edited, k, window)
        sha = hashlib.sha256(edited.astype("<u4").tobytes().decode("utf-32-le").encode()).hexdigest()
        return doc, n, sha, hex_of(kept), hex_of(got), likeness(kept, got), likeness(kept, after[1]), places, at

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            out = []
            bucket, ahead, ids = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            for i, t in enumerate(b.column(3).to_pylist()):
                points = _points(t)
                now = (points, *winnow(points, k, window))
                if last is not None and last[0] == bucket[i]:
                    out.append(row(last[1], *last[2], now))
                last = None if ahead[i] else (bucket[i], ids[i], now)
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate(
                (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int64()),
                 pa.list_(pa.int64())))], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
             "positions", "edited_positions"]
    return dealt.mapInArrow(prints, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                    "edited_fingerprint string, near_edited double, near_next double, "
                                    "positions array<long>, edited_positions array<long>")
