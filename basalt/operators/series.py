"""Return series and backward indices."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions.columns import ratio, safe_ln


def backward(bars: DataFrame) -> DataFrame:
    """idx (0 at the last bar) and, from the bar before, prev_close."""
    w = Window.partitionBy("instrument_id").orderBy(F.desc("market_date"))
    return bars.withColumns({"idx": F.row_number().over(w) - 1, "prev_close": F.lead("close").over(w)})


def log_returns(bars: DataFrame) -> DataFrame:
    """instrument_id, market_date, lr of the bars that have one."""
    return backward(bars).select("instrument_id", "market_date", safe_ln(ratio("close", "prev_close")).alias("lr")).filter("lr is not null")


def return_series(market, policy: str, observations: int, as_of: dt.date | None = None, ids: list[str] | None = None) -> DataFrame:
    """The last ``observations`` adjusted closes of each instrument, with their returns from the bar before and from the first."""
    if observations < 2:
        raise ValueError("observations must be at least 2")
    last = backward(market.adjusted(policy, as_of, ids)).filter(F.col("idx") < observations)
    w = Window.partitionBy("instrument_id").orderBy("market_date")
    prev = F.lag("close").over(w)
    first = F.first("close").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return last.select("instrument_id", F.col("market_date").alias("date"), "close", (ratio("close", prev) - 1).alias("one_day_return"), (ratio("close", first) - 1).alias("return_from_start"))


def moving_averages(bars: DataFrame, periods: tuple[int, ...] = (20, 50, 200)) -> DataFrame:
    """instrument_id, market_date, sma<n>: averages of the last n closes, null until there are n."""
    w = Window.partitionBy("instrument_id").orderBy("market_date")
    sma = lambda n: F.when(F.row_number().over(w) >= n, F.avg("close").over(w.rowsBetween(-(n - 1), 0))).alias(f"sma{n}")
    return bars.select("instrument_id", "market_date", *[sma(n) for n in periods])


def session_vwap(minutes: DataFrame) -> DataFrame:
    """Minute bars with vwap: typical price by volume since the day's first bar, null while nothing has traded."""
    w = Window.partitionBy("instrument_id", "market_date").orderBy("window_start_utc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return minutes.withColumn("vwap", ratio(F.sum(typical * F.col("volume")).over(w), F.sum("volume").over(w)))


def volume_cap(bars: DataFrame, share: float = 0.98, headroom: float = 1.15) -> DataFrame:
    """instrument_id, volume_cap: top of a volume scale that a few spikes do not flatten.

    The order statistic at index floor(n * share) of the positive volumes, or
    the last, with some headroom; 0 without any.
    """
    w = Window.partitionBy("instrument_id")
    at = F.least(F.count("v").over(w) - 1, F.floor(F.count("v").over(w) * share))
    rows = bars.select("instrument_id", F.when(F.col("volume") > 0, F.col("volume")).alias("v"))
    rows = rows.withColumns({"i": F.row_number().over(w.orderBy(F.asc_nulls_last("v"))) - 1, "at": at})
    return rows.groupBy("instrument_id").agg((F.coalesce(F.max(F.when(F.col("i") == F.col("at"), F.col("v"))), F.lit(0.0)) * headroom).alias("volume_cap"))
