"""Streaming panels: message topics, cleaning with watermarks, regular steps, anomaly events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidepanel.functions.numeric import finite
from tidepanel.operators import analysis as an
from tidepanel.session import scratch_path
from tidepanel.sources.readers import parse_messages


def topic_options(servers: str, topic: str, batch_size: int = 1000, **extra: str) -> dict[str, str]:
    """Kafka source options; a micro-batch takes at most `batch_size` messages."""
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "maxOffsetsPerTrigger": str(batch_size), "startingOffsets": "earliest", **extra}


def read_topic(spark: SparkSession, servers: str, topic: str, batch_size: int = 1000, **extra: str) -> DataFrame:
    """Streaming panel from a topic of JSON messages."""
    raw = spark.readStream.format("kafka").options(**topic_options(servers, topic, batch_size, **extra)).load()
    return parse_messages(raw.select("value"))


def read_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None, **options) -> DataFrame:
    """Streaming table from files arriving below a path."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def valid_rows(panel: DataFrame) -> DataFrame:
    return panel.withColumn("y", finite("y")).where("series_id is not null and ts is not null and y is not null")


def rejected_rows(panel: DataFrame) -> DataFrame:
    y = finite("y")
    reason = F.when(F.col("series_id").isNull(), "missing id").when(F.col("ts").isNull(), "missing timestamp").when(y.isNull(), "missing or non-finite target")
    return panel.withColumn("reason", reason).where(F.col("reason").isNotNull())


def first_per_timestamp(panel: DataFrame, lateness: str = "1 day", order: str | None = None) -> DataFrame:
    """One row of every (series, ts); state older than `lateness` is dropped.

    With `order` (a column that grows with arrival, such as an offset) it is the first to arrive, however rows fall into batches:
    the state of a (series, ts) holds the row with the smallest order, and it is emitted when the watermark passes ts. Without one
    the row that is processed first leaves at once; which one that is among the rows of one batch is not defined.
    """
    late = panel.withWatermark("ts", lateness)
    if order is None:
        return late.dropDuplicatesWithinWatermark(["series_id", "ts"])
    rest = [c for c in panel.columns if c not in ("series_id", "ts")]
    held = late.groupBy("series_id", "ts").agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return held.select(*[f"_row.{c}" if c in rest else c for c in panel.columns])


def regular_steps(panel: DataFrame, step: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Mean and count per series and time step, emitted once the watermark has passed the step."""
    w = F.window("ts", step)
    agg = panel.withWatermark("ts", lateness).groupBy("series_id", w).agg(F.avg("y").alias("y"), F.count("y").alias("points"))
    return agg.select("series_id", F.col("window.start").alias("ts"), "y", "points")


def anomaly_events(stream: DataFrame, bounds: DataFrame) -> DataFrame:
    """Stream rows outside the fences of their series, as `anomaly.detected` events (stream-static join)."""
    hit = stream.join(bounds.select("series_id", "iqr", "lo", "hi"), "series_id").where((F.col("y") < F.col("lo")) | (F.col("y") > F.col("hi")))
    far = F.when(F.col("y") > F.col("hi"), F.col("y") - F.col("hi")).otherwise(F.col("lo") - F.col("y")) / F.col("iqr")
    severity = F.when(far >= 2, "high").when(far >= 1, "medium").otherwise("low")
    return hit.select(F.lit("anomaly.detected").alias("event"), "series_id", "ts", F.col("y").alias("value"), severity.alias("severity"))


def history_bounds(panel: DataFrame, k: float = 1.5) -> DataFrame:
    """Fences from a history panel, to be refreshed by a batch job."""
    return an.anomaly_bounds(panel, k)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write everything available to a parquet table and stop."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process everything available with a per-batch writer and stop."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(stream: DataFrame, good_path: str, bad_path: str, checkpoint: str) -> StreamingQuery:
    """Good rows and rejected rows to two tables; a repeated batch replaces its own partition."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            valid_rows(batch).write.mode("overwrite").parquet(f"{good_path}/batch_id={batch_id}")
            rejected_rows(batch).write.mode("overwrite").parquet(f"{bad_path}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return run_batches(stream, write, checkpoint)


def collect_run(spark: SparkSession, stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream to its end into a scratch table and return that table."""
    path, checkpoint = scratch_path(spark, f"{label}-out"), scratch_path(spark, f"{label}-checkpoint")
    run_to_table(stream, path, checkpoint, mode).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
