"""Structured Streaming paths (extensions: the reference has none; IN1, IN2, IN4, IN8 as streams)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.writes import digest


def read_new(spark, path: str, schema, files: int = 100) -> DataFrame:
    """Files of a landing folder, as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def changed_items(stream: DataFrame, key: str, payload: list[str], ts: str = "ts", delay: str = "7 days") -> DataFrame:
    """IN4: items whose content is new within the watermark; state is bounded by it."""
    rows = stream.withColumn("digest", digest(payload)).withWatermark(ts, delay)
    return rows.dropDuplicatesWithinWatermark([key, "digest"])


def windowed_counts(stream: DataFrame, by: str, ts: str = "ts", window: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Counts by event-time window, late rows dropped after the delay."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, window), by)
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), by, "n")
    )


def ingest(
    stream: DataFrame,
    known: Callable[[], DataFrame],
    keys: list[str],
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    **trigger,
) -> StreamingQuery:
    """IN1: each micro-batch's rows of unknown keys go to ``write``; a batch that runs again writes the same rows."""
    def batch(rows: DataFrame, number: int) -> None:
        write(rows.dropDuplicates(keys).join(known().select(*keys), keys, "left_anti"), number)

    return (
        stream.writeStream
        .foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger or {"availableNow": True})
        .start()
    )


def on_arrival(
    stream: DataFrame,
    hooks: list[Callable[[DataFrame], DataFrame]],
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    **trigger,
) -> StreamingQuery:
    """IN2, IN8: hooks (assignment to clusters, learned tags) run over each micro-batch of new vectors."""
    def batch(rows: DataFrame, number: int) -> None:
        for hook in hooks:
            rows = hook(rows)
        write(rows, number)

    return (
        stream.writeStream
        .foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger or {"availableNow": True})
        .start()
    )
