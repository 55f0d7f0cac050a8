"""Telemetry as a stream: hourly counts by kind under a watermark, kept in a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.shared_store import shared_folder


def windowed(events: DataFrame, *, time: str = "ts", key: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, key, n, total) of a stream or a table. In a stream, rows later than `late` after the newest don't count."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    w = events.withWatermark(time, late) if events.isStreaming else events
    g = w.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), key, "n", "total")


def keep_latest(spark: SparkSession, sink: str, schema: str, *keys: str) -> DataFrame:
    """What the sink's batches say last of each key."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(sink)
    rest = [c for c in rows.columns if c not in (*keys, "batch", "part")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def run_available(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Take in what has arrived since the last run and end. A batch that is written again after a failure replaces itself."""

    def put(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{sink}/part={n}")

    stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def hourly(spark: SparkSession, source: str, label: str, *, late: str = "2 hours", per_batch: int | None = None) -> DataFrame:
    """The hourly table of a folder (or file) of events, brought up to date; `label` names the stream's own folder."""
    base = f"{shared_folder(spark)}/sparkloom-stream-{label}"
    source = f"{source[:-1]}[{source[-1]}]"  # as a pattern, since a stream takes a single file in no other way
    schema = spark.read.parquet(source).schema
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader
    run_available(windowed(reader.parquet(source), late=late), f"{base}/sink", f"{base}/checkpoint")
    return keep_latest(spark, f"{base}/sink", "window_start timestamp, event_type string, n long, total double", "window_start", "event_type")
