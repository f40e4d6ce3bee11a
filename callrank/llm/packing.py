"""Packing by column generation for the cutting-stock problem.

Documents are cut into classes of pieces: whole sequences, a body whose
length is a multiple of ``GRID`` and a tail shorter than ``GRID``.  So the
histogram of piece lengths has a fixed number of rows for any corpus.  A
linear program over patterns (how many pieces of each length share one
sequence) is solved by column generation: an unbounded knapsack, by dynamic
programming, prices the next pattern.  The patterns are rounded down to whole
numbers, what is left is filled by subset sums, and the pieces, ranked within
their class, are dealt to the sequences of their patterns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callrank.llm.common import materialise, small_batches
from callrank.llm.tokens import Encoder

GRID = 32


def piece_lengths(n: int, capacity: int, grid: int = GRID) -> list[int]:
    """Lengths, in order, of the pieces of a document of ``n`` tokens."""
    full, rest = divmod(n, capacity)
    body = rest - rest % grid
    return [capacity] * full + [x for x in (body, rest % grid) if x]


# --------------------------------------------------------- linear program

def _price(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack: counts of the most worthy pattern."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(lengths)
    lens, w = lengths[order], worth[order]
    for c in range(1, capacity + 1):
        k = int(np.searchsorted(lens, c, "right"))
        best[c] = best[c - 1]
        if k:
            v = best[c - lens[:k]] + w[:k]
            j = int(np.argmax(v))
            if v[j] > best[c] + 1e-12:
                best[c], pick[c] = v[j], j
    counts, c = np.zeros(len(lengths), np.int64), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[order[pick[c]]] += 1
            c -= int(lens[pick[c]])
    return counts


def solve_patterns(lengths: np.ndarray, need: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, float]]:
    """Patterns with their (fractional) number of sequences: least sequences
    in all.  Every basis is a valid packing, so ``rounds`` only bounds how
    close to the optimum the search comes."""
    k = len(lengths)
    columns = np.diag(capacity // lengths).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    x = inverse @ need
    floor = float(lengths @ need) / capacity
    for _ in range(rounds):
        if x.sum() <= floor + 0.25:
            break
        dual = inverse.sum(axis=0)
        new = _price(lengths, dual, capacity).astype(float)
        if dual @ new <= 1 + 1e-9:
            break
        move = inverse @ new
        up = move > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, move, 1), np.inf)
        out = int(np.argmin(ratio))
        columns[:, out] = new
        row = inverse[out] / move[out]
        inverse = inverse - np.outer(move, row)
        inverse[out] = row
        x = np.maximum(inverse @ need, 0)
        if _ % 200 == 199:  # rounding errors add up in the updated inverse
            inverse = np.linalg.inv(columns)
            x = np.maximum(inverse @ need, 0)
    return [(columns[:, j].astype(np.int64), float(x[j])) for j in range(k) if x[j] > 0]


def _fill(lengths: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """Counts, at most ``left``, that fill one sequence as far as can be,
    long pieces first."""
    reach = {0: ()}
    for c in np.argsort(-lengths):
        size, nxt = int(lengths[c]), dict(reach)
        for used, picks in reach.items():
            for m in range(1, min(int(left[c]), (capacity - used) // size) + 1):
                nxt.setdefault(used + m * size, (*picks, (int(c), m)))
        reach = nxt
        if capacity in reach:
            break
    counts = np.zeros(len(lengths), np.int64)
    for c, m in reach[max(reach)]:
        counts[c] = m
    return counts


def plan_sequences(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Segments (length, first rank, pieces a sequence, first sequence,
    offset): where the pieces of each length go, by their rank."""
    out, sequence = [], 0
    used: dict[int, int] = {}

    def use(counts: dict[int, int], times: int) -> None:
        nonlocal sequence
        at = 0
        for size in sorted(counts, reverse=True):
            m = counts[size]
            out.append((size, used.get(size, 0), m, sequence, at))
            used[size] = used.get(size, 0) + m * times
            at += m * size
        sequence += times

    if histogram.get(capacity):
        use({capacity: 1}, histogram[capacity])
    sizes = sorted(s for s, n in histogram.items() if n and s < capacity)
    if sizes:
        lengths, left = np.array(sizes), np.array([histogram[s] for s in sizes], np.int64)
        for pattern, x in sorted(solve_patterns(lengths, left.astype(float), capacity), key=lambda p: -p[1]):
            # no more than there are pieces left: rounding down keeps every count
            whole = min([int(x + 1e-6), *(int(left[c] // pattern[c]) for c in np.flatnonzero(pattern))])
            if whole > 0 and pattern.any():
                use({sizes[c]: int(pattern[c]) for c in np.flatnonzero(pattern)}, whole)
                left = left - whole * pattern
        while left.any():
            counts = _fill(lengths, left, capacity)
            times = min(int(left[c] // counts[c]) for c in np.flatnonzero(counts))
            use({sizes[c]: int(counts[c]) for c in np.flatnonzero(counts)}, times)
            left = left - times * counts
    return out


# ------------------------------------------------------------------ Spark

def cut_documents(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece, ids included: doc_id, start, length, ids
    (little-endian unsigned 32-bit), ids_crc32, doc_tokens, task, rank (the
    piece's place among those of its length in its task)."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, seen = Encoder.at(tokenizer), TaskContext.get().partitionId(), {}
        for b in batches:
            at, cols = [], [[] for _ in range(6)]
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = np.append(np.frombuffer(enc.encode(t), enc.dtype).astype("<u4"), np.array([end_id], "<u4"))
                raw, start = memoryview(ids.tobytes()), 0
                for n in piece_lengths(len(ids), capacity):
                    piece = raw[4 * start:4 * (start + n)]
                    at.append(i)
                    for col, v in zip(cols, (start, n, bytes(piece), zlib.crc32(piece), len(ids), seen.get(n, 0))):
                        col.append(v)
                    seen[n] = seen.get(n, 0) + 1
                    start += n
            start, n, ids, crc, total, rank = cols
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(n, pa.int64()),
                 pa.array(ids, pa.binary()), pa.array(crc, pa.int64()), pa.array(total, pa.int64()),
                 pa.array([task] * len(at), pa.int64()), pa.array(rank, pa.int64())],
                ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "task", "rank"])

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, task long, rank long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text",
         with_ids: bool = True) -> DataFrame:
    """Every document's ids, ``end_id`` last, laid into sequences of at most
    ``capacity`` ids: one row for each piece with doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset, and the ids if ``with_ids``.

    * Null and empty texts are documents of the end id alone.
    * Each id lies in exactly one piece; offsets are gapless from 0.
    * Repeated rows and repeated or null ids are documents of their own;
      very long texts give many whole sequences.
    * Extra columns are not read; an empty table gives no piece.

    The driver sees one count for each piece length (at most
    capacity / GRID + GRID of them) and the patterns, whatever the corpus.
    """
    cut = cut_documents(docs, tokenizer, capacity, end_id, doc_id, text)
    pieces = materialise(cut if with_ids else cut.drop("ids"), "pieces")
    mine = materialise(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in mine.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    segments: dict[int, list[tuple[int, int, int, int]]] = {}
    for size, first, each, sequence, at in plan_sequences(histogram, capacity):
        segments.setdefault(size, []).append((first, each, sequence, at))
    tables = {size: np.array(rows, np.int64).T for size, rows in segments.items()}
    before = F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    base = mine.select("length", "task", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("base"))
    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    ranked = ranked.select(*own, "rank")

    def deal(batches):
        for b in batches:
            size, rank = b.column(2).to_numpy(), b.column(b.num_columns - 1).to_numpy()
            seq, off = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                first, each, sequence, at = tables[int(n)]
                s = np.searchsorted(first, rank[rows], "right") - 1
                turn, slot = np.divmod(rank[rows] - first[s], each[s])
                seq[rows], off[rows] = sequence[s] + turn, at[s] + slot * n
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seq), pa.array(off)], [*own, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1])
    return ranked.mapInArrow(deal, f"{schema}, sequence_id long, offset long")
