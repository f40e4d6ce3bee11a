"""Sinks: delimited files, partitioned parquet, models and metrics."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.pipeline import PipelineSharedReadWrite
from pyspark.sql import DataFrame, SparkSession

from callrank.operators.forest import flat_nodes


def write_delimited(df: DataFrame, path: str, sep: str = ";", mode: str = "overwrite") -> None:
    """Delimited text with a header, one file per task (no coalesce to 1)."""
    df.write.mode(mode).option("header", True).option("sep", sep).csv(path)


def write_prepared(df: DataFrame, path: str, partition_by: str = "split", mode: str = "overwrite") -> None:
    """Persist the prepared set partitioned by split, so a reader of the
    train part prunes the test directory away."""
    df.write.mode(mode).partitionBy(partition_by).parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    """Fitted pipeline to a directory (overwrite)."""
    model.write().overwrite().save(path)


def write_metrics(metrics: DataFrame, path: str, drop: tuple[str, ...] = ("feature_schema",)) -> None:
    """Metrics as JSON, minus the schema block."""
    metrics.drop(*[c for c in drop if c in metrics.columns]).coalesce(1).write.mode("overwrite").json(path)


class ArtifactMissingError(FileNotFoundError):
    """The model directory does not exist or is incomplete."""


def require(spark: SparkSession, path: str) -> None:
    """Raises ``ArtifactMissingError`` if ``path`` does not exist."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise ArtifactMissingError(f"model artifact not found at {path!r}: train first")


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    """Load a fitted pipeline, with a clear error when it is missing.
    Other errors (unreadable files, wrong class) come through as they are."""
    require(spark, f"{path.rstrip('/')}/metadata")
    model = PipelineModel.load(path)
    if isinstance(model, PipelineModel):
        for i, stage in enumerate(model.stages):
            if isinstance(stage, RandomForestClassificationModel):  # read now: the folder may be written anew
                stage.flat = flat_nodes(spark, PipelineSharedReadWrite.getStagePath(stage.uid, i, len(model.stages), f"{path.rstrip('/')}/stages"))
    return model


def load_metrics(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Metrics written by ``write_metrics``; without a schema its types
    are read off the JSON."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def metrics_json(row: dict) -> str:
    """Plain JSON text for a bounded metrics dict (numpy floats coerced)."""
    return json.dumps(row, default=lambda o: float(o))
