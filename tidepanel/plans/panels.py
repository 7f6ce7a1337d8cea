"""Panels built from the driver tables, and the same panels as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.operators.blocks import number_rows
from tidepanel.session import table


def _rollup(df: DataFrame, series: str, ts: str, grain: str, y) -> DataFrame:
    flat = df.groupBy(F.col(series).alias("series_id"), F.date_trunc(grain, F.col(ts)).alias("ts")).agg(y.alias("y"))
    return number_rows(flat, bucket_seconds=None)


def events_daily(spark: SparkSession, sf: str) -> DataFrame:
    return _rollup(table(spark, sf, "events"), "event_type", "ts", "day", F.round(F.avg("value"), 6))


def events_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return _rollup(table(spark, sf, "events"), "event_type", "ts", "hour", F.round(F.sum("value"), 4))


def orders_daily(spark: SparkSession, sf: str) -> DataFrame:
    return _rollup(table(spark, sf, "orders"), "o_orderpriority", "o_orderdate", "day", F.round(F.sum("o_totalprice"), 2))


def ship_monthly(spark: SparkSession, sf: str) -> DataFrame:
    return _rollup(table(spark, sf, "lineitem"), "l_returnflag", "l_shipdate", "month", F.round(F.sum("l_extendedprice"), 2))


def events_raw(spark: SparkSession, sf: str) -> DataFrame:
    """One irregular series per user; event_id breaks ties of equal timestamps."""
    ev = table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("series_id"),
        "ts",
        F.col("event_id").alias("ord"),
        F.col("value").alias("y"),
    )
    return number_rows(ev, order=("ts", "ord"))


def lineitem_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every line item in time order, one series per return flag: a few very long series."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("series_id"), F.col("l_shipdate").cast("timestamp").alias("ts"), "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y")
    )
    return number_rows(rows, order=("ts", "l_orderkey", "l_linenumber"), bucket_seconds=86_400)


def _cte(name: str, source: str, series: str, ts: str, y: str) -> str:
    return (
        f"{name} AS (SELECT series_id, ts, y, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS pos,"
        f" count(*) OVER (PARTITION BY series_id) AS n FROM (SELECT {series} AS series_id, {ts} AS ts, {y} AS y"
        f" FROM {source} GROUP BY 1, 2))"
    )


EVENTS_DAILY = _cte("events_daily", "events", "event_type", "date_trunc('day', ts)", "round(avg(value), 6)")
EVENTS_HOURLY = _cte("events_hourly", "events", "event_type", "date_trunc('hour', ts)", "round(sum(value), 4)")
ORDERS_DAILY = _cte(
    "orders_daily", "orders", "o_orderpriority", "date_trunc('day', o_orderdate)", "round(sum(o_totalprice), 2)"
)
SHIP_MONTHLY = _cte(
    "ship_monthly", "lineitem", "l_returnflag", "date_trunc('month', l_shipdate)", "round(sum(l_extendedprice), 2)"
)
EVENTS_RAW = (
    "events_raw AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS series_id, ts, event_id AS ord, value AS y,"
    " row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,"
    " count(*) OVER (PARTITION BY user_id) AS n FROM events)"
)


def stamp(c: str = "ts", out: str | None = None):
    """A timestamp as text, the same in every time zone setting and engine."""
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss").alias(out or c)


def sql_stamp(c: str = "ts", out: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {out or c.split('.')[-1]}"
