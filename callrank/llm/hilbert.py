"""Sharding along a Hilbert curve over document metadata.

Several metadata dimensions are quantised to ``bits`` bits, the cell's index
on the Hilbert curve orders the rows, and the order is cut into runs of equal
row counts.  Neighbours on the curve are neighbours in every dimension, so a
filter on any of them reads few shards.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callrank.llm.common import boxed, materialise


def _gray(i: int) -> int:
    return i ^ (i >> 1)


def _entry(w: int) -> int:
    """Entry corner of the w-th sub-cube."""
    return 0 if w == 0 else _gray(2 * ((w - 1) // 2))


def _direction(w: int, n: int) -> int:
    """Axis along which the w-th sub-cube is left."""
    if w == 0:
        return 0
    i = w if w % 2 else w - 1
    return ((i + 1 & -(i + 1)).bit_length() - 1) % n


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of a cell whose coordinates are integers
    of ``bits`` bits.  One step a bit, top bit first: the corner of the
    sub-cube, seen from the current entry corner e and axis d, is a Gray
    code whose rank w is the next digit; e and d then follow from w."""
    n = len(cells)
    every = range(1 << n)
    rank = F.array(*[F.lit(next(i for i in every if _gray(i) == g)) for g in every])
    entry = F.array(*[F.lit(_entry(w)) for w in every])
    axis = F.array(*[F.lit(_direction(w, n)) for w in every])
    mask = F.lit((1 << n) - 1)

    def shift(x: Column, by: Column, left: bool) -> Column:
        name = "shiftleft" if left else "shiftright"
        return F.call_function(name, x, by)

    def rotate(x: Column, by: Column, left: bool) -> Column:
        by = F.pmod(by, F.lit(n))
        return shift(x, by, left).bitwiseOR(shift(x, F.lit(n) - by, not left)).bitwiseAND(mask)

    def step(state: Column, i: Column) -> Column:
        corner = F.lit(0)
        for j, c in enumerate(cells):
            bit = shift(c, F.lit(bits - 1) - i, False).bitwiseAND(F.lit(1))
            corner = corner.bitwiseOR(shift(bit, F.lit(j), True))
        w = F.get(rank, rotate(corner.bitwiseXOR(state["e"]), state["d"] + 1, False))
        return F.struct(
            state["e"].bitwiseXOR(rotate(F.get(entry, w), state["d"] + 1, True)).cast("int").alias("e"),
            F.pmod(state["d"] + F.get(axis, w) + 1, F.lit(n)).cast("int").alias("d"),
            (state["h"] * (1 << n) + w).cast("long").alias("h"))

    zero = F.struct(F.lit(0).alias("e"), F.lit(0).alias("d"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), zero, step)["h"]


def log_cell(number: Column, bits: int) -> Column:
    """A non-negative number on a logarithmic scale up to 2**32; null is 0."""
    top = (1 << bits) - 1
    return F.coalesce(F.least(F.lit(top), F.floor(F.log2(number.cast("double") + 1) * (top / 32.0))), F.lit(0)).cast("int")


def name_cell(name: Column, bits: int) -> Column:
    """A name's hash: equal names share a cell; null has its own."""
    return F.pmod(F.xxhash64(name), F.lit(1 << bits)).cast("int")


def hilbert_shards(docs: DataFrame, cells: list[Column], bits: int = 8, shards: int = 16, text: str = "text",
                   tie: list[str] | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, with bigint ``hilbert``, int
    ``shard`` and bigint ``slot``: shard sizes differ by one row at most, slots are
    gapless from 0 within a shard, along the curve.

    * Within a cell rows go by the hash of ``text`` (equal texts side by
      side), then by ``tie`` columns; what still ties is in one run in any
      order.  Groups of copies are split like other rows: the sort key ends
      in a generated id, so no key has to lie in one task.
    * Null metadata have a cell of their own; null texts hash like any.
    * Input columns named hilbert, shard or slot are replaced.  An empty table gives an empty result.
    """
    spare = [c for c in docs.columns if c.lower() not in ("hilbert", "shard", "slot")]
    keys = {f"tie{i}": F.col(c) for i, c in enumerate(tie or [])}
    own = boxed(docs, hilbert=hilbert_index(cells, bits), h=F.xxhash64(text), **keys)
    own = own.withColumn("id", F.monotonically_increasing_id())
    order = ["hilbert", "h", *keys, "id"]
    run = own.repartitionByRange(*order).sortWithinPartitions(*order).select("row", "hilbert")
    # the place of a row in its partition is in the low bits of the generated id
    run = materialise(run.withColumn("at", F.monotonically_increasing_id()), "hilbert-run")
    part, place = F.shiftrightunsigned("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = materialise(run.groupBy(part.alias("part")).agg(F.count("*").alias("n")), "run-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    # one row for each partition, however many rows it has
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    base = counts.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    out = run.withColumn("part", part).join(F.broadcast(base), "part").withColumn("rank", F.col("base") + place)
    # rank r is in shard floor(r * shards / total), which begins at ceil(shard * total / shards)
    out = out.withColumn("shard", F.expr(f"cast((rank * {shards}) div {max(total, 1)} as int)"))
    first = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return out.select(*[F.col("row").getField(c).alias(c) for c in spare], "hilbert", "shard", (F.col("rank") - first).alias("slot"))


def write_shards(sharded: DataFrame, path: str, files: int = 8) -> None:
    """Write one folder for each shard; rows lie along the curve in its
    files, so a reader prunes files by their column statistics."""
    dealt = sharded.repartitionByRange("shard", "hilbert", F.col("slot")) if files > 1 else sharded.repartition("shard")
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
