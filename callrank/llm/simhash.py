"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits are cut into groups of correlated bits.  Each group i
has its own threshold t_i, with sum(t_i + 1) = distance + 1, so two
fingerprints within ``distance`` bits differ by at most t_i bits in some
group i (t_i = -1: the group is not probed).  The thresholds, and the number
of groups, come from a dynamic program over estimated candidate counts.
Every distinct fingerprint probes its groups with all variants within t_i
bits; probes that meet are verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callrank.llm.common import boxed, materialise, small_batches, unboxed
from callrank.llm.components import connected_components

BITS, SEED = 64, 42

#: Rows of one comparison cell; larger probe groups are dealt over cells.
CELL_ROWS = 4096

#: Estimated cost of shuffling one probe, in verified pairs.
PROBE_COST = 50.0


# ------------------------------------------------------------ fingerprints

def fingerprint(text: bytes | None, shingle: int) -> int:
    """Unsigned fingerprint of UTF-8 ``text``: A-Z lower-cased, words between
    ASCII white space, XXH64 (seed 42) of every ``shingle``-word shingle."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = list(accumulate((len(w) + 1 for w in words)))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip([0, *ends], [e - 1 for e in ends[shingle - 1:]])]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[at:at + (1 << 15)], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) for each row; fp is the fingerprint as a signed bigint."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                      F.col(text).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], ["doc_id", "text_hash", "fp"])

    return own.mapInArrow(run, "doc_id long, text_hash long, fp long")


# ------------------------------------------------- bit groups, thresholds

def _bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and how often bits i and j are both set, over all fingerprints:
    one 64 x 64 table for each task, added up by Spark."""
    def run(batches):
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            both += (x.T.astype(np.float32) @ x.astype(np.float32)).astype(np.int64)
            n += len(x)
        at = np.arange(BITS * BITS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(both.ravel(), n))], ["at", "n"])

    rows = fps.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for r in rows:
        flat[r["at"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, groups: int) -> list[list[int]]:
    """Cut the bits into equal groups, each grown around the strongest
    correlation left, so that what one group tells is not told by another."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, -1)
    left, out = list(range(BITS)), []
    for g in range(groups):
        size = BITS // groups + (g < BITS % groups)
        sub = corr[np.ix_(left, left)]
        first = left[int(np.unravel_index(np.argmax(sub), sub.shape)[0])] if len(left) > 1 else left[0]
        own = [first]
        left.remove(first)
        while len(own) < size:
            nxt = max(left, key=lambda b: (corr[b, own].sum(), -b))
            own.append(nxt)
            left.remove(nxt)
        out.append(sorted(own))
    return out


def variants(width: int, t: int) -> list[int]:
    """XOR masks of at most ``t`` of ``width`` bits."""
    return [sum(1 << b for b in c) for k in range(t + 1) for c in combinations(range(width), k)]


def allocate(n: int, both: np.ndarray, distance: int, max_variants: int = 3000) -> list[tuple[list[int], int]]:
    """The bit groups and thresholds of least estimated cost."""
    p = np.diag(both) / max(n, 1)
    same = p * p + (1 - p) * (1 - p)
    best = None
    for m in range(1, distance + 2):
        groups = group_bits(n, both, m)
        cost = []
        for bits in groups:
            # n * v probes; any two meet by the chance that the whole group agrees
            meet = float(np.prod(same[bits]))
            row, v, c = [0.0], 0.0, 1.0
            for t in range(distance + 1):
                v += c
                c = c * (len(bits) - t) / (t + 1)
                row.append(PROBE_COST * n * v + n * n / 2 * v * v * meet if v <= max_variants else np.inf)
            cost.append(row)
        # dynamic program: least cost of groups[:i] with ``used`` units of t + 1
        table = {0: (0.0, ())}
        for row in cost:
            nxt = {}
            for used, (c, picks) in table.items():
                for k, more in enumerate(row):
                    if used + k <= distance + 1 and c + more < nxt.get(used + k, (np.inf,))[0]:
                        nxt[used + k] = (c + more, (*picks, k - 1))
            table = nxt
        got = table.get(distance + 1)
        if got and (best is None or got[0] < best[0]):
            best = (got[0], [(g, t) for g, t in zip(groups, got[1]) if t >= 0])
    return best[1]


# ------------------------------------------------------ probing, verifying

def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if np.array_equal(up, x):
            return x
        x = up


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        ra, rb = _find(parent, a), _find(parent, b)
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def _link_cells(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each run of equal keys."""
    parent = np.arange(len(fps))
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    small = np.flatnonzero((sizes > 1) & (sizes <= 64))
    inside = np.zeros(len(keys), bool)
    for s in small:
        inside[starts[s]:starts[s] + sizes[s]] = True
    rows = np.flatnonzero(inside)
    for shift in range(1, 64):
        rows = rows[rows + shift < len(keys)]
        rows = rows[keys[rows] == keys[rows + shift]]
        if not len(rows):
            break
        ok = np.bitwise_count(fps[rows] ^ fps[rows + shift]) <= distance
        _union(parent, rows[ok], rows[ok] + shift)
    for s in np.flatnonzero(sizes > 64):
        own = np.arange(starts[s], starts[s] + sizes[s])
        for at in range(0, len(own), 256):
            a = own[at:at + 256]
            near = np.bitwise_count(fps[a][:, None] ^ fps[own[at:]][None, :]) <= distance
            i, j = np.nonzero(near)
            _union(parent, a[i], own[at + j])
    root = _find(parent, np.arange(len(fps)))
    linked = fps[root] != fps
    return fps[linked], fps[root[linked]]


def near_links(fps: DataFrame, distance: int) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of the distinct
    fingerprints ``fp`` within ``distance`` bits.

    Probes with the same value of the same bit group meet in one cell; a
    group of more than ``CELL_ROWS`` probes is dealt over triangular cells,
    so that every two of its members still meet.  Tasks return a spanning
    forest of what they verified, never all pairs.
    """
    small_batches(fps.sparkSession)
    n, both = _bit_counts(fps)
    plan = allocate(n, both, distance)
    masks = [np.array([sum(1 << bits[b] for b in range(len(bits)) if v >> b & 1) for v in variants(len(bits), t)], np.uint64)
             for bits, t in plan]
    select = np.array([sum(1 << b for b in bits) for bits, _ in plan], np.uint64)

    def probes(batches):
        for b in batches:
            x = b.column(0).to_numpy().view(np.uint64)
            for i, m in enumerate(masks):
                sig = ((x & select[i])[:, None] ^ m[None, :]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), i, np.int32)), pa.array(sig),
                                                  pa.array(np.repeat(x, len(m)).view(np.int64))], ["part", "sig", "fp"])

    rows = fps.select("fp").mapInArrow(probes, "part int, sig long, fp long")
    count = rows.groupBy("part", "sig").agg(F.count("*").alias("n")).where(F.col("n") > CELL_ROWS)
    hot = materialise(count.select("part", "sig", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("blocks")), "hot-probes")
    dealt = rows.join(hot, ["part", "sig"], "left")
    mine = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int")
    dealt = dealt.withColumn("_b", mine).withColumn(
        "cell", F.explode(F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda c: F.struct(
            F.least(c, F.col("_b")).alias("a"), F.greatest(c, F.col("_b")).alias("b")))))
    dealt = dealt.select(F.xxhash64("part", "sig", "cell.a", "cell.b").alias("key"), "fp")
    dealt = dealt.repartition("key").sortWithinPartitions("key", "fp")

    def verify(batches):
        keep_k, keep_f = np.empty(0, np.int64), np.empty(0, np.uint64)
        for b in batches:
            k = np.concatenate([keep_k, b.column(0).to_numpy()])
            f = np.concatenate([keep_f, b.column(1).to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(k, k[-1], "left")) if len(k) else 0
            if cut and len(k) > 4 * CELL_ROWS:  # whole cells only; the last may go on in the next batch
                yield from links(k[:cut], f[:cut])
                k, f = k[cut:], f[cut:]
            keep_k, keep_f = k, f
        if len(keep_k):
            yield from links(keep_k, keep_f)

    def links(k, f):
        u, v = _link_cells(k, f, distance)
        pairs = np.unique(np.stack([u, v], axis=1), axis=0) if len(u) else np.empty((0, 2), np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].view(np.int64)) if len(u) else pa.array([], pa.int64()),
                                          pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64)) if len(u) else pa.array([], pa.int64())], ["u", "v"])

    return dealt.mapInArrow(verify, "u long, v long").distinct()


def _rooted(docs: DataFrame, shingle: int, distance: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The fingerprint rows, and (fp, least_id, root) for each distinct fingerprint."""
    own = materialise(fingerprints(docs, shingle, doc_id, text), "fingerprints")
    classes = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "classes")
    comp = connected_components(near_links(classes, distance)).withColumnRenamed("node", "fp")
    return own, materialise(classes.join(comp, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    * ``fingerprint``: 16 lowercase hex digits.  Null and empty texts, and
      texts of white space only, have fingerprint zero, linked like any other.
    * ``component_id``: the smallest doc_id reachable over links of at most
      ``distance`` differing bits, the row's own included; null only if no
      row of the component has an id.  Ids are whole numbers; a string id that
      is not one raises.
    * Equal fingerprints are one class, so copies are never paired; repeated
      rows and repeated or null ids each give their own row.  Extra columns
      are not read; an empty table gives an empty result.
    """
    own, rooted = _rooted(docs, shingle, distance, doc_id, text)
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of = rooted.join(least, "root").select("fp", "component_id")
    out = own.join(of, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, with all its columns: the one with the
    smallest id (rows without id come last); rows that share it are told
    apart by the hash of the text, and of fully equal rows one stays."""
    own, rooted = _rooted(docs, shingle, distance, doc_id, text)
    rows = own.groupBy("doc_id", "text_hash").agg(F.first("fp").alias("fp"), F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n")
    keep = rows.join(rooted.select("fp", "root"), "fp").groupBy("root").agg(F.min(order).alias("m"))
    keep = materialise(keep.select(F.col("m.doc_id").alias("_id"), F.col("m.text_hash").alias("_hash"),
                                   F.col("m.n").alias("_n")), "kept-rows")
    rows = boxed(docs, d=F.col(doc_id).cast("long"), h=F.xxhash64(text))
    found = rows.join(keep, F.col("d").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_hash")))
    once = found.where("_n = 1").select("row")
    again = found.where("_n > 1").dropDuplicates(["_id", "_hash"]).select("row")
    return unboxed(once.unionByName(again), docs.columns)
