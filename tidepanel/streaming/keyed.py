"""Keyed rolling records and counters fed by streams.

Every micro-batch leaves a bounded, pre-aggregated delta in its own partition (overwritten if the batch is
repeated), and reading combines the deltas. No key's full history passes through one task, and a lost
executor or a restarted query never counts a batch twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidepanel.operators import trust as tr
from tidepanel.streaming.ingest import run_batches


def keep_recent(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[Column], count: int) -> StreamingQuery:
    """Per batch, the newest `count` rows of every key (the rank limit applies before the exchange)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        tr.recent(batch, keys, count, order).drop("rn").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return run_batches(stream, write, checkpoint)


def recent_rows(spark: SparkSession, path: str, schema, keys: Sequence[str], order: Sequence[Column], count: int) -> DataFrame:
    """The newest `count` rows of every key over all batches."""
    return tr.recent(spark.read.schema(schema).parquet(path).drop("batch_id"), keys, count, order).drop("rn")


def compact(spark: SparkSession, path: str, target: str, schema, keys: Sequence[str], order: Sequence[Column], count: int) -> None:
    """Rewrite many deltas into one; run between queries."""
    recent_rows(spark, path, schema, keys, order, count).write.mode("errorifexists").parquet(f"{target}/batch_id=0")


def count_usage(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Usage deltas per key (key_id, inference_ms, series, ts) and batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        delta = batch.groupBy("key_id").agg(
            F.count(F.lit(1)).alias("requests"),
            F.sum(F.greatest("inference_ms", F.lit(0.0))).alias("inference_ms"),
            F.sum(F.greatest("series", F.lit(0))).alias("series"),
            F.max("ts").alias("updated_at"),
        )
        delta.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return run_batches(stream, write, checkpoint)


def usage_totals(spark: SparkSession, path: str) -> DataFrame:
    """Current usage per key."""
    d = spark.read.parquet(path)
    return d.groupBy("key_id").agg(
        F.sum("requests").alias("requests"), F.sum("inference_ms").alias("inference_ms"), F.sum("series").alias("series"), F.max("updated_at").alias("updated_at")
    )
