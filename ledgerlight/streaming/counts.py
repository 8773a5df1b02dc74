"""Streams without custom state: message mix and interval sums by event time, and sequence counters of arriving segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def message_mix(messages: DataFrame, watermark: str = "10 seconds", every: str = "1 minute") -> DataFrame:
    """Counts by type and window of event time (``ts_ns``); the watermark is an addition that bounds the state."""
    timed = messages.withColumn("ts", F.timestamp_micros(F.call_function("div", F.col("ts_ns"), F.lit(1000))))
    return timed.withWatermark("ts", watermark).groupBy(F.window("ts", every), "msg_type").agg(F.count("*").alias("n"))


def trade_bars(trades: DataFrame, watermark: str = "10 seconds", every: str = "1 second") -> DataFrame:
    """Trades, shares and cents by symbol and window of event time."""
    timed = trades.withColumn("ts", F.timestamp_micros(F.call_function("div", F.col("ts_ns"), F.lit(1000))))
    cents = F.call_function("div", F.col("price") * F.col("size"), F.lit(100))
    return timed.withWatermark("ts", watermark).groupBy(F.window("ts", every), "symbol").agg(F.count("*").alias("trades"), F.sum("size").alias("shares"), F.sum(cents).alias("notional_cents"))
