"""Scoring a stream of commands with the batch functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import features as X
from ..functions.normalize import normalize_commands
from ..operators import scoring

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, command string"


def read_log(spark: SparkSession, path: str, schema: str = SCHEMA, files_per_batch: int = 8) -> DataFrame:
    """A command log that grows by Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def scored_stream(log: DataFrame, model: scoring.Model, bias: float, warn: float, block: float) -> DataFrame:
    """event_id, event_type, risk, verdict of each command, as one plan without state: a row is scored from itself alone."""
    if model.sparse is None:
        raise ValueError("a stream needs a model whose n-grams fit into every task")
    ready = X.dense(normalize_commands(log)).drop("segments", "dropped_non_ascii")
    scored = scoring.score(ready, model, bias, "event_id")
    return scored.select("event_id", "event_type", "risk", scoring.decided(F.col("risk"), warn, block).alias("verdict"))


def score_stream(log: DataFrame, out: str, checkpoint: str, model: scoring.Model, bias: float, warn: float, block: float) -> StreamingQuery:
    """Writes the scored stream as Parquet files, each micro-batch exactly once. Takes what is there and ends."""
    writer = scored_stream(log, model, bias, warn, block).writeStream.format("parquet").outputMode("append")
    return writer.option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
