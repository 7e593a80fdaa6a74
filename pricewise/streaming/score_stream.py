"""H3: scoring of request files as they arrive (Structured Streaming).

The transform is stateless (H1 encoding + H2 scoring are projections), so
every micro-batch is scored independently and the file sink with its
checkpoint gives exactly-once output across restarts and lost executors.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from pricewise.operators.score import LinearScorer, encode_request, score_requests


def score_stream(stream_df: DataFrame, model: LinearScorer | PipelineModel, compat: bool = False,
                 keep=("id",)) -> DataFrame:
    """Streaming frame of scores for a streaming frame of requests."""
    return score_requests(encode_request(stream_df, compat=compat), model, keep=keep)


def run_score_stream(spark: SparkSession, source_dir: str, schema: StructType | str,
                     model: LinearScorer | PipelineModel, sink_dir: str, checkpoint: str,
                     max_files_per_trigger: int | None = None, compat: bool = False) -> None:
    """Score every request file under ``source_dir`` that has not been
    scored yet and stop (``availableNow``); rerunning picks up new files
    only.  ``sink_dir`` and ``checkpoint`` must be on shared storage."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    scored = score_stream(reader.parquet(source_dir), model, compat=compat)
    query = (scored.writeStream.format("parquet")
             .option("path", sink_dir)
             .option("checkpointLocation", checkpoint)
             .outputMode("append")
             .trigger(availableNow=True)
             .start())
    query.awaitTermination()
