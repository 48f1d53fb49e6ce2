"""Forward returns from a date or from a minute, for all instruments that traded then."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions.columns import ratio
from basalt.functions.dates import local_minute
from basalt.functions.text import one_of, session_minute
from basalt.operators.adjust import apply_factors, with_action_factors
from basalt.operators.session import SESSIONS

HORIZONS = (1, 5, 21, 63, 126, 252)
ENTRIES = ("next_open", "t_close")
MINUTE_HORIZONS = (("to_close", 0), ("next_open", 0), ("1d", 1), ("3d", 3))


def checked_horizons(horizons) -> tuple[int, ...]:
    """Distinct ascending horizons of 1 to 2000 open days."""
    out = tuple(sorted(set(HORIZONS if horizons is None else horizons)))
    if not out or any(not isinstance(h, int) or isinstance(h, bool) or not 1 <= h <= 2000 for h in out):
        raise ValueError("horizons must be whole numbers from 1 to 2000")
    return out


def future_days(market, t: dt.date) -> DataFrame:
    """market_scope, n, target: the n-th open day after T, as far as the scope has bars."""
    first = market.exchanges.groupBy("market_scope").agg(F.min("calendar_id").alias("calendar_id"))
    frontier = market.bars_daily.groupBy("market_scope").agg(F.max("market_date").alias("frontier"))
    days = market.trading_days.filter(F.col("is_open") & (F.col("market_date") > F.lit(t)))
    days = days.join(F.broadcast(first.join(frontier, "market_scope")), "calendar_id").filter("market_date <= frontier")  # a row for each scope
    return days.select("market_scope", F.row_number().over(Window.partitionBy("market_scope").orderBy("market_date")).alias("n"), F.col("market_date").alias("target"))


def _targets(market, t: dt.date, horizons: tuple[int, ...]) -> DataFrame:
    """market_scope, horizon, target of every scope and horizon; null beyond the calendar."""
    spark = market.bars_daily.sparkSession
    wanted = market.exchanges.select("market_scope").distinct().withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    days = future_days(market, t).filter(F.col("n").isin(*horizons)).withColumnRenamed("n", "horizon")
    rows = wanted.join(days, ["market_scope", "horizon"], "left").collect()  # one for each scope and horizon
    return spark.createDataFrame([tuple(r) for r in rows], "market_scope string, horizon int, target date")


def forward_returns(market, t: dt.date, policy: str = "split_dividend", horizons=None, entry: str = "next_open", anchor: dt.date | None = None, ids: list[str] | None = None) -> DataFrame:
    """instrument_id, horizon, date, ret, mae, mfe, delisted, stale, bars_used, reason.

    One join of the bars from T on with the few targets of their scope, then
    one conditional aggregation by instrument and horizon.
    """
    horizons, _ = checked_horizons(horizons), one_of(entry, ENTRIES, "entry")
    m = market if ids is None else market.only(ids)
    targets = _targets(market, t, horizons)
    last = targets.agg(F.max("target")).first()[0]
    if anchor is not None and last is not None and anchor < last:
        raise ValueError(f"the adjustment anchor {anchor} is before the horizon {last}")
    T, day = F.lit(t), F.col("market_date")
    scope = m.instruments.select("instrument_id", F.col("primary_market_scope").alias("market_scope"), "delisted_date")
    bars = m.adjusted(policy, anchor or last or t, since=t)
    w = Window.partitionBy("instrument_id")
    second = F.min(F.when(day > T, day)).over(w)
    entry_day = T if entry == "t_close" else second
    bars = bars.select("instrument_id", "market_date", "open", "high", "low", "close", entry_day.alias("entry_date"), F.min("market_date").over(w).alias("first")).filter(F.col("first") == T)
    price = F.max(F.when(day == F.col("entry_date"), F.col("close" if entry == "t_close" else "open"))).over(w)
    bars = bars.withColumn("price", price).join(scope, "instrument_id").join(F.broadcast(targets), "market_scope")  # targets: a few rows for each scope
    inside = day <= F.col("target")
    path = inside & (day > F.col("entry_date"))
    a = bars.groupBy("instrument_id", "horizon", "target", "delisted_date", "entry_date", "price").agg(
        F.max_by(F.when(inside, F.col("close")), F.when(inside, day)).alias("value"), F.max(F.when(inside, day)).alias("valued"), F.min(F.when(path, F.col("low"))).alias("low"), F.max(F.when(path, F.col("high"))).alias("high"), F.count_if(inside & (day >= F.col("entry_date"))).alias("used")
    )
    beyond, out = F.col("target").isNull(), F.col("entry_date").isNull() | (F.col("entry_date") > F.col("target"))
    live = ~beyond & ~out
    carried = F.col("valued") < F.col("target")
    dead = F.coalesce(F.col("delisted_date") <= F.col("target"), F.lit(False))
    gain = lambda c: F.when(live, ratio(c, "price") - 1)
    return a.select(
        "instrument_id", "horizon", F.col("target").alias("date"), gain("value").alias("ret"), gain("low").alias("mae"), gain("high").alias("mfe"),
        F.coalesce(live & carried & dead, F.lit(False)).alias("delisted"), F.coalesce(live & carried & ~dead, F.lit(False)).alias("stale"), F.when(live, F.col("used")).otherwise(0).cast("long").alias("bars_used"),
        F.when(beyond, "beyond_calendar").when(out, "no_entry_bar").alias("reason"),
    )


def forward_from_minute(market, scope: str, day: dt.date, minute: str, ids: list[str] | None = None, zone: str | None = None) -> DataFrame:
    """instrument_id, horizon, date, ret, mae, mfe, delisted, stale, bars_used, reason from the first session bar at or after a minute.

    Raw minute prices are scaled by the day's factor of the daily series, whose
    anchor is the last date that any horizon needs, so entry and valuation are on
    one basis even where an event lies past the minute tape.
    """
    s = SESSIONS[scope]
    at = session_minute(minute)
    m = market if ids is None else market.only(ids)
    days = future_days(market, day).filter((F.col("market_scope") == scope) & F.col("n").isin(1, 3))
    target = {r["n"]: r["target"] for r in days.collect()}  # two rows
    D, date = F.lit(day), F.col("market_date")
    mb = m.bars_minute.filter(date == D) if ids is None else m.bars_minute.filter((date == D) & F.col("instrument_id").isin(*ids))
    mb = mb.select("instrument_id", local_minute(F.col("window_start_utc"), zone or s.zone).alias("et"), "open", "high", "low").filter(F.col("et").between(s.open, s.close))
    late = F.col("et") >= at
    entry = mb.withColumn("e", F.min(F.when(late, F.col("et"))).over(Window.partitionBy("instrument_id")))
    path = F.col("et") > F.col("e")
    e = entry.groupBy("instrument_id").agg(F.min("e").alias("e"), F.max(F.when(F.col("et") == F.col("e"), F.col("open"))).alias("raw"), F.min(F.when(path, F.col("low"))).alias("lo"), F.max(F.when(path, F.col("high"))).alias("hi"), F.count_if(F.col("et") >= F.col("e")).alias("n"))
    # the anchor is by instrument: its next bar may lie past the calendar targets
    later = m.canonical.filter(date >= D)
    nexts = later.filter(date > D).groupBy("instrument_id").agg(F.min("market_date").alias("next_bar"))
    known = [d for d in (day, target.get(1), target.get(3)) if d]
    bound = e.select("instrument_id").join(nexts, "instrument_id", "left").select("instrument_id", F.greatest(F.lit(max(known)), "next_bar").alias("anchor"))
    tape = later.join(bound, "instrument_id").filter(date <= F.col("anchor")).drop("anchor")
    daily = apply_factors(with_action_factors(tape, m.corporate_actions, m.instruments, "split_dividend", since=day))
    aggs = [F.max(F.when(date == D, F.col("cum_price_factor"))).alias("factor"), F.max(F.when(date == D, F.col("close"))).alias("day_close"), F.min(F.when(date > D, date)).alias("next_date"), F.min_by("open", F.when(date > D, date)).alias("next_open")]
    for n in (1, 3):
        if n in target:
            upto = date <= F.lit(target[n])
            aggs += [F.max_by("close", F.when(upto, date)).alias(f"value{n}"), F.max(F.when(upto, date)).alias(f"valued{n}"), F.min(F.when(upto & (date > D), F.col("low"))).alias(f"lo{n}"), F.max(F.when(upto & (date > D), F.col("high"))).alias(f"hi{n}"), F.count_if(upto & (date > D)).alias(f"n{n}")]
    d = daily.groupBy("instrument_id").agg(*aggs)
    x = e.join(d, "instrument_id", "left").join(m.instruments.select("instrument_id", "delisted_date"), "instrument_id", "left")
    f = F.coalesce("factor", F.lit(1.0))
    x = x.withColumns({"entry": F.col("raw") * f, "lo": F.col("lo") * f, "hi": F.col("hi") * f})
    no = F.lit(False)
    gain = lambda c: ratio(c, "entry") - 1

    def row(name, date=None, ret=None, mae=None, mfe=None, delisted=no, stale=no, used=None, reason=None) -> Column:
        null = lambda v, kind: F.lit(None).cast(kind) if v is None else v
        return F.struct(F.lit(name).alias("horizon"), null(date, "date").alias("date"), null(ret, "double").alias("ret"), null(mae, "double").alias("mae"), null(mfe, "double").alias("mfe"), F.coalesce(delisted, no).alias("delisted"), F.coalesce(stale, no).alias("stale"), F.coalesce(null(used, "long"), F.lit(0)).cast("long").alias("bars_used"), null(reason, "string").alias("reason"))

    has_day, has_next = F.col("day_close").isNotNull(), F.col("next_date").isNotNull()
    rows = [
        F.when(has_day, row("to_close", D, gain("day_close"), gain("lo"), gain("hi"), used=F.col("n"))).otherwise(row("to_close", D, stale=F.lit(True))),
        F.when(has_next, row("next_open", F.col("next_date"), gain("next_open"), used=F.lit(1))).otherwise(row("next_open", delisted=F.col("delisted_date").isNotNull(), stale=F.col("delisted_date").isNull())),
    ]
    for name, n in MINUTE_HORIZONS[2:]:
        if n not in target:
            rows.append(row(name, reason=F.lit("beyond_calendar")))
            continue
        goal = F.lit(target[n])
        dead = F.coalesce(F.col("delisted_date") <= goal, no)
        carried = F.col(f"valued{n}") < goal
        some = row(name, goal, gain(f"value{n}"), gain(F.least("lo", f"lo{n}")), gain(F.greatest("hi", f"hi{n}")), carried & dead, carried & ~dead, F.col("n") + F.col(f"n{n}"))
        rows.append(F.when(F.col(f"valued{n}").isNotNull(), some).otherwise(row(name, goal, delisted=dead, stale=~dead)))
    none = F.array(*[row(name, reason=F.lit("no_entry_bar")) for name, _ in MINUTE_HORIZONS])
    return x.select("instrument_id", F.explode(F.when(F.col("e").isNull(), none).otherwise(F.array(*rows))).alias("h")).select("instrument_id", "h.*")
