"""An extension: the same row-local transforms and per-mode counts over a stream of responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mullion.operators.aggregate import failure_accounting
from mullion.operators.scoring import with_metrics

RESPONSE_STREAM = "ordinal bigint, task_id string, mode string, raw_response string, completion_tokens bigint, at timestamp"


def read_responses(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(RESPONSE_STREAM).option("maxFilesPerTrigger", files_per_trigger).json(path)


def live_metrics(responses: DataFrame) -> DataFrame:
    """Row-local, so nothing is kept between batches."""
    return with_metrics(responses)


def live_accounting(results: DataFrame) -> DataFrame:
    """Counts a mode, for update or complete output; state is a row a mode."""
    return failure_accounting(results)


def windowed_counts(results: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Responses a mode and window of time; the watermark bounds the state."""
    return results.withWatermark("at", late).groupBy(F.window("at", width), "mode").agg(F.count("*").alias("n"), F.sum("total_tokens").alias("tokens"))
