"""Token ids as raw binary shards with a minimal perfect hash index.

A dataset is a folder:

* ``ids-*.bin``: the ids of the documents, end id included, in ascending
  doc_id order: little-endian unsigned integers of one width (2 bytes if the
  vocabulary fits, else 4), nothing between them;
* ``index``: a table of one row for each bucket of keys: a minimal perfect
  hash over the bucket's document keys and, at each key's slot, a fingerprint
  of the key, the shard, the offset in it and the number of ids;
* ``shards``: a table of the shards' files, first positions and lengths.

A key is the document id and its copy number (0 for the first row with that
id).  A lookup hashes the key to its bucket, walks the bucket's bit levels to
the slot, compares the fingerprint and reads that range of one shard.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callrank.llm.common import join_checked, materialise, small_batches
from callrank.llm.tokens import Encoder

#: A shard is closed when it holds so many bytes.
SHARD_BYTES = 64 << 20

#: Keys of one index bucket, on average.
BUCKET_KEYS = 20_000


# -------------------------------------------------- minimal perfect hashing

def key_hashes(keys: list[bytes], seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(k, seed) for k in keys], np.uint64)


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit hashes.

    Level l is a bit array twice as long as the keys still without a place;
    a key alone at its bit is placed there, the others go to the next level.
    A key's slot is the number of set bits before its own."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], np.unique(hashes)
        while len(left):
            size = max(2 * len(left), 1)
            at = (_mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash; -1 where no level has its bit."""
        out, open_ = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = (_mix(hashes[open_], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            hit = self.bits[at]
            out[open_[hit]] = self.before[at[hit]]
            open_ = open_[~hit]
        return out

    def to_bytes(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    @classmethod
    def from_bytes(cls, sizes: list[int], raw: bytes) -> PerfectHash:
        return cls(list(sizes), np.unpackbits(np.frombuffer(raw, np.uint8), count=sum(sizes)).astype(bool))


#: What the index stores at a slot.
ENTRY = np.dtype([("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u8")])


def key_of(doc_id, copy: int) -> bytes:
    return f"{'' if doc_id is None else doc_id}/{copy}".encode()


# ------------------------------------------------------------------ writing

def write_token_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text",
                       shard_bytes: int = SHARD_BYTES) -> None:
    """Encode every whole text and write the dataset to the folder ``path``
    (a URI that driver and executors share).

    * Null and empty texts are documents of the end id alone.
    * Null ids come first; rows with equal ids follow one another, by the
      hash of their text, as copies 0, 1, ...
    * Very long texts make a longer shard; extra columns are not read; an
      empty table makes an empty dataset.

    A task writes its shards under names of its own attempt and reports
    them; the index names the files that the successful attempt reported, so
    an attempt that is lost or runs twice leaves files that nothing reads.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # a generated id last in the key: rows of one id need not lie in one task
    order = ["doc_id", F.xxhash64("text"), "_id"]
    own = own.withColumn("_id", F.monotonically_increasing_id())
    run = own.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    uri = path.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = Encoder.at(tokenizer), TaskContext.get().partitionId()
        store, base = pafs.FileSystem.from_uri(uri)
        store.create_dir(base, recursive=True)
        out, name, size, last, copy = None, None, 0, object(), 0
        end, turn = np.array([end_id], enc.dtype).tobytes(), 0
        for b in batches:
            rows = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if out is None:
                    name, size = f"ids-{part:06d}-{turn:04d}-{uuid.uuid4().hex}.bin", 0
                    out = store.open_output_stream(f"{base}/{name}")
                raw = enc.encode(t) + end
                copy = copy + 1 if doc == last else 0
                last = doc
                out.write(raw)
                rows.append((copy, turn, name, size // enc.width, len(raw) // enc.width))
                size += len(raw)
                if size >= shard_bytes:
                    out.close()
                    out, turn = None, turn + 1
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([part] * len(rows), pa.int64()), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]],
                ["doc_id", "part", "copy", "turn", "file", "offset", "n"])
        if out is not None:
            out.close()

    kind = own.schema["doc_id"].dataType.simpleString()
    made = materialise(run.mapInArrow(
        write, f"doc_id {kind}, part long, copy long, turn long, file string, offset long, n long"), "token-entries")
    # shards in order, with the position of their first id: sums of each
    # part (one row a writing task) are run up, then those inside each part
    size = materialise(made.groupBy("part", "turn", "file").agg(F.sum("n").alias("n_ids"), F.count("*").alias("n_docs")), "shard-sizes")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = size.groupBy("part").agg(F.sum("n_ids").alias("_ids"), F.count("*").alias("_shards"))
    parts = parts.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_ids", "_shards")])
    along = W.partitionBy("part").orderBy("turn")
    size = size.withColumn("_turn", F.row_number().over(along) - 1).withColumn(
        "_own", F.coalesce(F.sum("n_ids").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    size = size.join(parts, "part").withColumn("shard", F.col("_shards") + F.col("_turn")).withColumn("first", F.col("_ids") + F.col("_own"))
    width = Encoder.at(tokenizer).width
    shards = size.select("shard", "part", "turn", "file", "first", "n_ids", "n_docs", F.lit(width).alias("width"))
    shards.write.mode("overwrite").parquet(f"{uri}/shards")
    shards = spark.read.parquet(f"{uri}/shards")
    # an id that goes on from earlier partitions: its copies there come first
    ends = made.groupBy("part").agg(F.min_by("doc_id", F.struct("turn", "offset")).alias("doc_id"))
    counts = made.join(ends.select(F.col("doc_id").alias("_first")).distinct(), F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi")
    counts = counts.groupBy("doc_id", "part").agg(F.count("*").alias("c"))
    carry = counts.withColumn("carry", F.coalesce(F.sum("c").over(
        W.partitionBy("doc_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    carry = carry.where("carry > 0").select(F.col("doc_id").alias("_doc"), F.col("part").alias("_part"), "carry")
    entries = join_checked(made, shards.select("part", "turn", "shard"), ["part", "turn"], F.lit(48), ["offset"])
    entries = entries.join(carry, entries["doc_id"].eqNullSafe(F.col("_doc")) & (F.col("part") == F.col("_part")), "left")
    entries = entries.select("doc_id", (F.col("copy") + F.coalesce("carry", F.lit(0))).alias("copy"), "shard", "offset", "n")
    total = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, -(-total // BUCKET_KEYS))
    _index(entries, buckets).write.mode("overwrite").parquet(f"{uri}/index")


def _bucket(buckets: int):
    return F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy")), F.lit(buckets))


def _index(entries: DataFrame, buckets: int) -> DataFrame:
    """One row for each bucket; buckets have about BUCKET_KEYS keys, as keys
    are distinct and hashed."""
    def build(key, table):
        keys = [key_of(d, c) for d, c in zip(table["doc_id"].to_pylist(), table["copy"].to_pylist())]
        seed = 0
        hashes = key_hashes(keys, seed)
        while len(np.unique(hashes)) < len(keys):  # two keys with one 64-bit hash: another seed
            seed += 1
            hashes = key_hashes(keys, seed)
        mph = PerfectHash.build(hashes)
        slot, entry = mph.slots(hashes), np.zeros(len(keys), ENTRY)
        entry["print"][slot] = key_hashes(keys, seed + 1_000_003).astype(np.uint32)
        for name in ("shard", "offset", "n"):
            entry[name][slot] = table[name].to_numpy()
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "seed": pa.array([seed], pa.int64()),
                         "sizes": pa.array([mph.sizes], pa.list_(pa.int64())), "bits": pa.array([mph.to_bytes()], pa.binary()),
                         "entries": pa.array([entry.tobytes()], pa.binary()), "buckets": pa.array([buckets], pa.int64())})

    return entries.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInArrow(
        build, "bucket long, seed long, sizes array<long>, bits binary, entries binary, buckets long")


# ------------------------------------------------------------------ reading

def locate(keys: DataFrame, path: str) -> DataFrame:
    """(doc_id, copy, shard, offset, n) of the given distinct (doc_id, copy)
    keys, by the index.  Keys that the fingerprint shows to be absent are
    left out (one in 2**32 absent keys is not recognised)."""
    spark = keys.sparkSession
    index = spark.read.parquet(f"{path.rstrip('/')}/index")
    first = index.select("buckets").first()
    buckets = first["buckets"] if first else 1
    kind = keys.schema["doc_id"].dataType.simpleString()

    def look(left, right):
        ids, copies = left["doc_id"].to_pylist(), left["copy"].to_pylist()
        found, place = np.zeros(len(ids), bool), np.zeros(len(ids), ENTRY)
        if right.num_rows and ids:
            row = right.to_pylist()[0]
            names = [key_of(d, c) for d, c in zip(ids, copies)]
            slot = PerfectHash.from_bytes(row["sizes"], row["bits"]).slots(key_hashes(names, row["seed"]))
            entry = np.frombuffer(row["entries"], ENTRY)
            place = entry[np.maximum(slot, 0)]
            found = (slot >= 0) & (place["print"] == key_hashes(names, row["seed"] + 1_000_003).astype(np.uint32))
        at = pa.array(np.flatnonzero(found))
        return pa.table({"doc_id": left["doc_id"].take(at), "copy": left["copy"].take(at),
                         **{n: pa.array(place[n][found].astype(np.int64)) for n in ("shard", "offset", "n")}})

    asked = keys.select("doc_id", F.col("copy").cast("long").alias("copy")).withColumn("bucket", _bucket(buckets))
    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(
        look, f"doc_id {kind}, copy long, shard long, offset long, n long")


def read_documents(keys: DataFrame, path: str) -> DataFrame:
    """(doc_id, copy, start, n_tokens, ids) of the given keys: ids as
    little-endian unsigned 32-bit integers, ``start`` the number of ids of
    all documents before it.  Ranges of one shard are read in order."""
    return _read(keys, path, True)


def token_digests(keys: DataFrame, path: str) -> DataFrame:
    """(doc_id, copy, start, n_tokens, ids_crc32) of the given keys, as read
    from the shards; the ids themselves do not leave the task."""
    return _read(keys, path, False)


def _read(keys: DataFrame, path: str, with_ids: bool) -> DataFrame:
    spark, uri = keys.sparkSession, path.rstrip("/")
    small_batches(spark)
    shards = spark.read.parquet(f"{uri}/shards").select("shard", "file", "first", "width")
    at = join_checked(locate(keys, uri), shards, ["shard"], F.lit(64) + F.octet_length("file"), ["offset"])
    kind = keys.schema["doc_id"].dataType.simpleString()
    # whole ranges of a shard go to one task, as one file is read from there
    at = at.select("doc_id", "copy", "file", "offset", "n", "first", "width", F.floor(F.col("offset") / (1 << 22)).alias("block"))
    at = at.repartition("file", "block").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(uri)
        name, source = None, None
        for b in batches:
            c = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            got = []
            for file, off, n, width in zip(c["file"], c["offset"], c["n"], c["width"]):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, store.open_input_file(f"{base}/{file}")
                raw = np.frombuffer(source.read_at(n * width, off * width), f"<u{width}").astype("<u4").tobytes()
                if len(raw) != 4 * n:
                    raise OSError(f"{file}: {n} ids from {off} are not there")
                got.append(raw)
            last = pa.array(got, pa.binary()) if with_ids else pa.array([zlib.crc32(g) for g in got], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([f + o for f, o in zip(c["first"], c["offset"])], pa.int64()),
                 pa.array(c["n"], pa.int64()), last], ["doc_id", "copy", "start", "n_tokens", tail])
        if source is not None:
            source.close()

    tail = "ids" if with_ids else "ids_crc32"
    return at.mapInArrow(run, f"doc_id {kind}, copy long, start long, n_tokens long, {tail} {'binary' if with_ids else 'long'}")


def keys_of(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The distinct (doc_id, copy) keys of a table: copies are counted, not
    gathered, so an id with very many rows is one row until it is expanded."""
    n = docs.groupBy(F.col(doc_id).alias("doc_id")).agg(F.count("*").alias("n"))
    return n.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))


def default_path(spark: SparkSession) -> str:
    from callrank.session import scratch_path
    path = scratch_path(spark, "token-shards")
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
