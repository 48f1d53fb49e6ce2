"""Session metrics at a minute T: bars of the regular session strictly before T."""

from __future__ import annotations

import datetime as dt
import math
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions.columns import first_by, ratio, safe_ln
from basalt.functions.dates import local_minute
from basalt.functions.text import session_minute
from basalt.plans.catalog import SESSION, long_rows


class Session(NamedTuple):
    zone: str
    open: int
    close: int
    minutes: int


#: Time zone, first and last minute (both included), regular minutes.
SESSIONS = {"us_stocks": Session("America/New_York", 570, 960, 390)}
PACE_SESSIONS, PACE_LEAST, VOL_LEAST = 20, 5, 21


def session_metrics_at(market, scope: str, day: dt.date, minute: str, ids: list[str] | None = None, zone: str | None = None) -> DataFrame:
    """instrument_id, id, family, value, bars_available, reason, unit: 17 rows for each instrument with a visible bar."""
    if scope not in SESSIONS:
        raise ValueError(f"no minute bars for {scope}")
    s, at = SESSIONS[scope], session_minute(minute)
    if at <= s.open:
        raise ValueError(f"{minute} is before the first complete bar of the session")
    m = market if ids is None else market.only(ids)
    mb = m.bars_minute if ids is None else m.bars_minute.filter(F.col("instrument_id").isin(*ids))
    D, date = F.lit(day), F.col("market_date")
    mb = mb.filter(date <= D).withColumn("et", local_minute(F.col("window_start_utc"), zone or s.zone)).filter(F.col("et").between(s.open, s.close) & (F.col("et") < at))
    mb = mb.withColumn("dv", F.col("close") * F.col("volume"))
    w = Window.partitionBy("instrument_id")
    vis = mb.filter(date == D).withColumns({"idx": F.row_number().over(w.orderBy(F.desc("et"))) - 1, "prev": F.lag("close").over(w.orderBy("et"))})
    has = F.col("prev").isNotNull()
    a = vis.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("bars"), F.max_by("close", "et").alias("last"), F.min_by("open", "et").alias("first_open"), F.max("high").alias("hi"), F.min("low").alias("lo"),
        F.sum((F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume")).alias("pv"), F.sum("volume").alias("v"), F.sum("dv").alias("dv"),
        F.max(F.when(F.col("idx") == 30, F.col("close"))).alias("close30"), F.max(F.when(F.col("idx") == 60, F.col("close"))).alias("close60"),
        F.stddev_samp(safe_ln(ratio("close", "prev"))).alias("vol"), F.avg(F.when(has, F.when(F.col("close") > F.col("prev"), 1.0).otherwise(0.0))).alias("up"), F.count("prev").alias("returns"),
    )
    days = mb.filter(date < D).groupBy("instrument_id", "market_date").agg(F.sum("dv").alias("dv"))
    rank = F.row_number().over(w.orderBy(F.desc("market_date")))
    sums = days.withColumn("n", rank).filter(F.col("n") <= PACE_SESSIONS)
    # the dates are few and known by the folders: read the last ones first, and the others only if an instrument needs them
    dates = [r[0] for r in mb.filter(date < D).select("market_date").distinct().orderBy(F.desc("market_date")).limit(2 * PACE_SESSIONS).collect()]
    if len(dates) == 2 * PACE_SESSIONS:
        recent = days.filter(date >= F.lit(dates[-1])).withColumn("n", rank).filter(F.col("n") <= PACE_SESSIONS)
        full = recent.groupBy("instrument_id").agg(F.max("n").alias("n"))
        seen = vis.select("instrument_id").distinct()
        if seen.join(full.filter(F.col("n") == PACE_SESSIONS), "instrument_id", "left_anti").isEmpty():
            sums = recent
    pace = sums.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("sessions"), F.avg("dv").alias("pace"))
    # the bar before the day is seldom far: the earliest of them, of the instruments seen, bounds what is adjusted
    last = m.canonical.filter(date < D).join(vis.select("instrument_id").distinct(), "instrument_id", "left_semi").groupBy("instrument_id").agg(F.max("market_date").alias("last"))
    since = last.agg(F.min("last")).first()[0]
    prev = first_by(m.adjusted("split_dividend", day, since=since).filter(date < D), ["instrument_id"], F.desc("market_date")).select("instrument_id", F.col("close").alias("prev_close"))
    a = a.join(pace, "instrument_id", "left").join(prev, "instrument_id", "left").withColumn("sessions", F.coalesce("sessions", F.lit(0)))
    diff = lambda x, y: ratio(x, y) - 1
    enough = F.col("returns") >= VOL_LEAST
    v = {
        "last_price": F.col("last"), "cum_dollar_volume": F.col("dv"), "minutes_since_open": F.col("bars"), "session_fraction": F.least(F.lit(1.0), F.col("bars") / s.minutes), "gap_at_open": diff("first_open", "prev_close"),
        "session_ret": diff("last", "first_open"), "ret_from_prev_close": diff("last", "prev_close"), "vwap_dist": F.when(F.col("v") > 0, diff("last", ratio("pv", "v"))), "session_range_pos": ratio(F.col("last") - F.col("lo"), F.col("hi") - F.col("lo")),
        "session_high_dist": diff("last", "hi"), "session_low_dist": diff("last", "lo"), "range_pct_so_far": ratio(F.col("hi") - F.col("lo"), "prev_close"), "ret_30m": diff("last", "close30"), "ret_60m": diff("last", "close60"),
        "session_vol": F.when(enough, F.col("vol") * math.sqrt(s.minutes * 252)), "up_minutes_share": F.when(enough, F.col("up")), "rvol_pace": F.when(F.col("sessions") >= PACE_LEAST, ratio("dv", "pace")),
    }
    a = a.withColumns({f"m_{k}": x.cast("double") for k, x in v.items()})
    short = lambda d: (F.col("bars") < d.min_bars) | (F.col("sessions") < PACE_LEAST) if d.id == "rvol_pace" else F.col("bars") < d.min_bars
    value = lambda d: (F.when(~short(d), F.col(f"m_{d.id}")).alias("value"),)
    reason = lambda d: F.when(short(d), "insufficient_window").when(F.col(f"m_{d.id}").isNull(), "undefined_input")
    return a.select("instrument_id", F.explode(long_rows(SESSION, value, lambda d: F.col("bars"), reason)).alias("m")).select("instrument_id", "m.*")
