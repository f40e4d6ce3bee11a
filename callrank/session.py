"""Session construction and lineage-cutting helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest summed size of a side that is broadcast; beyond it the same join
#: shuffles.
BROADCAST_BYTES = 32 << 20


def build_session(master: str | None = None, app: str = "callrank",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Session with AQE on, UI off and UTC time; used by tests and bench."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": os.environ.get("CALLRANK_DRIVER_MEMORY", "8g"),
        # checkpoints of unreferenced frames are removed from the shared folder
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    Taken from ``spark.checkpoint.dir`` (the cluster names it) or from the
    context's checkpoint dir.  Only when neither is set (local tests) a
    private temporary folder is created.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="callrank-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/callrank-scratch/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never a local one): survives executor loss and
    pins non-deterministic columns such as partition ids."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def default_parallelism(spark: SparkSession) -> int:
    try:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    except Exception:  # noqa: BLE001
        return os.cpu_count() or 8


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row of ``df``: strings and binaries by their own length,
    nested values as JSON, all else 16."""
    def size(field: T.StructField) -> Column:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.octet_length(col).cast("long") + 16
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.octet_length(F.to_json(F.struct(col))).cast("long") + 16
        return F.lit(16)
    total = F.lit(32).cast("long")
    for field in df.schema.fields:
        total = total + F.coalesce(size(field), F.lit(16))
    return total


def fits_broadcast(df: DataFrame, row_size: Column) -> bool:
    """True if the rows' own sizes add up to at most ``BROADCAST_BYTES``."""
    total = df.agg(F.sum(row_size.cast("long") + F.lit(32))).first()[0]
    return (total or 0) <= BROADCAST_BYTES


def written_small(df: DataFrame) -> tuple[DataFrame, bool]:
    """``df`` written once to the shared folder, and whether its rows fit a
    broadcast.  (The bytes are summed from the written table: an observed
    metric would tie the session's state to the closures of fitted models.)"""
    path = scratch_path(df.sparkSession, "small")
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return back, fits_broadcast(back, row_bytes(back))


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join with a side that is small by construction (per class, per
    bucket, per task tables).  The small side is written (computed once,
    reliably) and its bytes are summed; up to ``BROADCAST_BYTES``
    it is broadcast, beyond that it is a regular shuffle join."""
    small, fits = written_small(small)
    if isinstance(on, (list, tuple)) and all(isinstance(c, str) for c in on):
        return join_null_safe(big, small, on, how, broadcast_right=fits)
    return big.join(F.broadcast(small) if fits else small, on, how)


def join_null_safe(left: DataFrame, right: DataFrame, cols, how: str = "inner",
                   broadcast_right: bool = False) -> DataFrame:
    """Equi-join on ``cols`` where NULL keys match NULL keys (``<=>``), so a
    row with a NULL class or group is kept, not silently dropped."""
    cols = list(cols)
    r = right.select(*[F.col(c).alias(f"__r_{c}") if c in cols else F.col(c) for c in right.columns])
    if broadcast_right:
        r = F.broadcast(r)
    cond = [left[c].eqNullSafe(r[f"__r_{c}"]) for c in cols]
    return left.join(r, cond, how).drop(*[f"__r_{c}" for c in cols])
