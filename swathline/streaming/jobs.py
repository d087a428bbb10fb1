"""Structured Streaming forms of the scoreboard and the latency windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathline.functions.answers import normalise


def prediction_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_scoreboard(rows: DataFrame, event_time: str, watermark: str = "1 day") -> DataFrame:
    """Hits and rows per question type; state is one row per type, emitted in update mode."""
    hit = normalise(F.col("prediction")) == normalise(F.col("answer"))
    return rows.withWatermark(event_time, watermark).groupBy("question_type").agg(
        F.count("*").alias("n"), F.sum(hit.cast("long")).alias("correct")
    )


def latency_windows(steps: DataFrame, window: str = "1 hour", slide: str | None = None, lateness: str = "30 minutes") -> DataFrame:
    """Step count, mean latency and fallback share per tool and event-time window; rows later than ``lateness`` are dropped.

    A replay of a backlog in any file order needs a lateness of the backlog's whole span.
    """
    bucket = F.window("ts", window, slide) if slide else F.window("ts", window)
    return steps.withWatermark("ts", lateness).groupBy(bucket.alias("w"), "tool").agg(
        F.count("*").alias("steps"), F.avg("latency_ms").alias("mean_latency_ms"),
        F.avg((F.col("threshold_method") == "fixed_fallback").cast("double")).alias("fallback_share"),
    ).select(F.col("w.start").alias("window_start"), "tool", "steps", "mean_latency_ms", "fallback_share")


def run_to_table(stream: DataFrame, mode: str, path: str, checkpoint: str, keys: list[str]) -> None:
    """Drain the available input into Parquet; each batch appends its changed rows with the batch number.

    A file sink takes no updates, so the newest row per key is the result.
    """
    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:08d}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.start().awaitTermination()


def latest(table: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Newest version of each key."""
    newest = table.groupBy(*keys).agg(F.max(F.struct("batch", *values)).alias("v"))
    return newest.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])
