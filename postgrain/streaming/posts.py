"""Continuous prefilter and scoring of arriving posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from postgrain.operators.filters import corpus_prefilter, with_keys
from postgrain.operators.quality import LinearModel, score_quality


def stream_table(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet folder as a stream of its files."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_prefilter(stream: DataFrame, **rules) -> DataFrame:
    """Stateless: the batch filter applied to a stream of posts."""
    return corpus_prefilter(with_keys(stream, "post_id", "text"), **rules)


def append_available(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process everything that has arrived since the last run and append it to a Parquet table.

    The checkpoint folder remembers what was processed, so a stopped run continues and nothing is written twice.
    """
    writer = stream.writeStream.format("parquet").outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def stream_score(stream: DataFrame, model: LinearModel, out: str, checkpoint: str) -> StreamingQuery:
    """Score arriving vectors with a frozen model and append ``(id columns, score)``; ranking stays a batch job."""
    return append_available(score_quality(model, stream).drop("embedding"), out, checkpoint)
