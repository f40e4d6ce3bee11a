"""K1 on a stream: score client files as they land in a folder.

``PipelineModel.transform`` and the K1 columns are stateless per row, so
the streaming plan is the batch plan per micro-batch.  ``checkpoint``
(offsets + commits) is a shared folder that the caller names: a query
restarted with the same one resumes without re-scoring or losing files.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from callrank.operators.score import batch_score


def score_stream(spark: SparkSession, model: PipelineModel, source_dir: str, schema: StructType | str,
                 sink_dir: str, base_rate: float, threshold: float = 0.30, keep=(),
                 *, checkpoint: str, available_now: bool = True,
                 max_files_per_trigger: int | None = None) -> StreamingQuery:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(source_dir)
    scored = batch_score(model, src, base_rate, threshold, keep)
    w = (scored.writeStream.format("parquet").outputMode("append")
               .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start(sink_dir)
