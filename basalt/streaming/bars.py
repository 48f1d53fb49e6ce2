"""Minute bars from a stream of trades. The same columns as the batch builder; late trades wait for the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def minute_bars(trades: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """symbol, window_start_utc, open, high, low, close, volume, transactions of (symbol, ts, price, size, trade_id)."""
    t = trades.withWatermark("ts", lateness)
    order = F.struct("ts", "trade_id")
    bars = t.groupBy("symbol", F.window("ts", "1 minute")).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("transactions"))
    return bars.select("symbol", F.col("window.start").alias("window_start_utc"), "open", "high", "low", "close", "volume", "transactions")
