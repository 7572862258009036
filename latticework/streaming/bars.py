"""Incremental bars from a stream of trades, an addition for live panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(trades: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(ts, symbol, open, high, low, close, volume) of windows of (at, symbol, price, size); later trades than `late` are dropped. Trades of one moment are ordered by price and size."""
    place = F.struct("at", "price", "size")
    w = trades.withWatermark("at", late).groupBy(F.window("at", length), "symbol")
    return w.agg(
        F.min_by("price", place).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", place).alias("close"), F.sum("size").alias("volume")
    ).select(F.col("window.start").alias("ts"), "symbol", "open", "high", "low", "close", "volume")
