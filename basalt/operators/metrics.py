"""All daily metrics at a date T, for one instrument or for all that traded then.

One pass: bars and factors meet in one stream for each instrument, backward
indices and returns come from windows with the same partitioning. What looks at
the whole history (its length, the streak, bars since an event) is counted in
these windows too; then only the last 253 bars of an instrument go on, into one
conditional aggregation. Calendars, listings and dividends are small arrays of
each scope or instrument, so nothing is cached and no bar is shuffled again.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions.columns import ratio, safe_ln, sample_kurtosis, valid_at, when_idx
from basalt.operators.adjust import apply_factors, dividend_cash, with_action_factors
from basalt.plans.catalog import DAILY, NO_EVENT_IDS, long_rows

YEAR = math.sqrt(252)
#: Yang-Zhang's weight for 21 bars.
YZ_K = 0.34 / (1.34 + 22.0 / 20.0)
CALENDAR_DAYS = 63
#: Greatest backward index that a window looks at.
LAST = 252


class DateError(ValueError):
    """T is not a bar date; carries the nearest ones."""

    def __init__(self, t, previous, following):
        super().__init__(f"no bar on {t}; the nearest are {previous} and {following}")
        self.t, self.previous, self.following = t, previous, following


def date_gate(market, instrument_id: str, scope: str, t: dt.date) -> None:
    """ValueError unless the instrument is in the scope, DateError unless it has a bar on T."""
    if market.instruments.filter((F.col("instrument_id") == instrument_id) & (F.col("primary_market_scope") == scope)).isEmpty():
        raise ValueError(f"instrument {instrument_id} is not in {scope}")
    d = F.col("market_date")
    r = market.only([instrument_id]).canonical.agg(F.bool_or(d == F.lit(t)).alias("there"), F.max(F.when(d < F.lit(t), d)).alias("a"), F.min(F.when(d > F.lit(t), d)).alias("b")).first()
    if not r.there:
        raise DateError(t, r.a, r.b)


def calc(market, t: dt.date) -> DataFrame:
    """The last 253 bars up to T of the instruments that have one on T: raw and adjusted prices, idx, returns and
    their like, and what is counted over all bars."""
    raw = {f"raw_{c}": F.col(c) for c in ("open", "high", "low", "close", "volume")}
    bars = market.canonical.withColumns(raw)
    rows = apply_factors(with_action_factors(bars, market.corporate_actions, market.instruments, "split_dividend", t))
    every = Window.partitionBy("instrument_id")
    w = every.orderBy(F.desc("market_date"))
    rows = rows.withColumns({"idx": F.row_number().over(w) - 1, "prev": F.lead("close").over(w), "last_date": F.max("market_date").over(every)})
    rows = rows.filter(F.col("last_date") == F.lit(t)).join(_events(market, t), "instrument_id", "left")
    rows = rows.withColumns({"r": ratio("close", "prev") - 1, "lr": safe_ln(ratio("close", "prev"))})
    now = lambda c: F.max(when_idx(c, 0)).over(every)
    later = lambda c: F.count_if(F.col("market_date") > F.col(c)).over(every)
    rows = rows.withColumns({"r0": now("r"), "lr0": now("lr"), "total": F.count(F.lit(1)).over(every), "n_r": F.count("r").over(every), "since_split": later("last_split"), "since_dividend": later("last_dividend")})
    turned = F.col("r").isNotNull() & (F.signum("r") != F.signum("r0"))
    rows = rows.withColumn("turn", F.min(F.when(turned, F.col("idx"))).over(every)).filter(F.col("idx") <= LAST)
    return rows.withColumns({
        "gap_i": ratio("open", "prev") - 1,
        "dv": F.col("raw_close") * F.col("raw_volume"),
        "tr": F.greatest("high", "prev") - F.least("low", "prev"),
        "yz_on": safe_ln(ratio("open", "prev")),
        "yz_oc": safe_ln(ratio("close", "open")),
        "yz_rs": safe_ln(ratio("high", "close")) * safe_ln(ratio("high", "open")) + safe_ln(ratio("low", "close")) * safe_ln(ratio("low", "open")),
        "rel_range": ratio(F.col("high") - F.col("low"), "prev"),
        "park": F.pow(safe_ln(ratio("raw_high", "raw_low")), F.lit(2.0)),
    })


def _events(market, t: dt.date) -> DataFrame:
    day, T = F.col("ex_date"), F.lit(t)
    return market.corporate_actions.groupBy("instrument_id").agg(
        F.max(F.when(F.col("action_type").isin("split", "stock_dividend") & (day <= T), day)).alias("last_split"),
        F.max(F.when((F.col("action_type") == "cash_dividend") & (day <= T), day)).alias("last_dividend"),
        F.min(F.when((day > T) & (F.col("declaration_date") <= T), day)).alias("next_ex"),
    )


def _calendar_of(market) -> DataFrame:
    """market_scope, market_date of open days."""
    first = market.exchanges.groupBy("market_scope").agg(F.min("calendar_id").alias("calendar_id"))
    return market.trading_days.filter("is_open").join(F.broadcast(first), "calendar_id").select("market_scope", "market_date")  # a row for each scope


def _calendars(market, t: dt.date) -> DataFrame:
    """market_scope, days (the last open ones up to T), ahead (the later ones): a row for each scope."""
    day = F.col("market_date")
    c = _calendar_of(market).groupBy("market_scope").agg(F.sort_array(F.collect_set(F.when(day <= F.lit(t), day)), False).alias("days"), F.collect_set(F.when(day > F.lit(t), day)).alias("ahead"))
    return c.select("market_scope", F.slice("days", 1, CALENDAR_DAYS).alias("days"), "ahead")


def _listed(ranges, day):
    """Whether one of the validity ranges holds the day."""
    return F.exists(ranges, lambda r: valid_at(day, r["valid_from"], r["valid_to"]))


def _paid(market, t: dt.date) -> DataFrame:
    """instrument_id, dividends (array of ex_date, cash_amount) up to T."""
    cash = dividend_cash(market.corporate_actions, market.instruments).filter((F.col("cash_amount") > 0) & (F.col("ex_date") <= F.lit(t)))
    return cash.groupBy("instrument_id").agg(F.collect_list(F.struct("ex_date", "cash_amount")).alias("dividends"))


def wide(market, t: dt.date) -> DataFrame:
    """A row for each instrument with a bar on T: its scope, bars, and all metrics but those against a baseline."""
    rows = calc(market, t)
    at = lambda c, i: F.max(when_idx(c, i))
    mean = lambda c, a, b: F.avg(when_idx(c, a, b))
    num = lambda c, a, b: F.count(when_idx(c, a, b))
    flag = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    one = lambda c: F.first(c).alias(c)  # noqa: E731  the same on all rows
    a = rows.groupBy("instrument_id").agg(
        *[one(c) for c in ("total", "lr0", "r0", "turn", "n_r", "last_split", "since_split", "last_dividend", "since_dividend", "next_ex")], at("raw_close", 0).alias("c0"), at("raw_high", 0).alias("h0"), at("raw_low", 0).alias("l0"), at("open", 0).alias("ao0"),
        *[at("close", i).alias(f"ac{i}") for i in (0, 1, 5, 21, 63, 126, 252)],
        mean("dv", 1, 21).alias("adv"), num("dv", 1, 21).alias("adv_n"), at("dv", 0).alias("dv0"), mean("dv", 0, 4).alias("dv5"), mean("dv", 0, 62).alias("dv63"), num("dv", 0, 62).alias("dv63_n"), num("dv", 0, 20).alias("dv21_n"), F.min(when_idx("dv", 0, 20)).alias("dv21_min"),
        mean(flag(F.abs("gap_i") > 0.02), 0, 62).alias("gap_freq_63d"), F.median(when_idx(F.abs("gap_i"), 0, 62)).alias("abs_gap_med_63d"),
        mean("close", 0, 19).alias("sma20"), mean("close", 0, 49).alias("sma50"), mean("close", 0, 199).alias("sma200"),
        F.max(when_idx("high", 0, 251)).alias("high252"), F.min(when_idx("low", 0, 251)).alias("low252"), F.max(when_idx("close", 0, 251)).alias("top252"),
        mean(flag(F.col("r") > 0), 0, 20).alias("up_days_21d"), (F.stddev_samp(when_idx("lr", 0, 20)) * YEAR).alias("vol_21d"), (F.stddev_samp(when_idx("lr", 0, 62)) * YEAR).alias("vol_63d"),
        (F.sqrt(mean("park", 0, 20) / (4 * math.log(2))) * YEAR).alias("parkinson_21d"), F.sqrt(mean("park", 1, 21) / (4 * math.log(2))).alias("park_prev"),
        mean("tr", 0, 13).alias("atr14"), F.max(when_idx(F.abs("r"), 0, 20)).alias("max_abs_ret_21d"), (mean(ratio(F.abs("r"), "dv"), 0, 20) * 1000000).alias("amihud"),
        F.var_samp(when_idx("yz_on", 0, 20)).alias("yz_on"), F.var_samp(when_idx("yz_oc", 0, 20)).alias("yz_oc"), mean("yz_rs", 0, 20).alias("yz_rs"), num("yz_on", 0, 20).alias("yz_n"),
        F.median(when_idx("rel_range", 1, 21)).alias("range_med"), num("rel_range", 1, 21).alias("range_n"), at("rel_range", 0).alias("rel_range0"),
        F.count_if(F.col("idx").between(1, 252) & (F.col("lr") < F.col("lr0"))).alias("below"), F.count_if(F.col("idx").between(1, 252) & (F.col("lr") == F.col("lr0"))).alias("equal"), num("lr", 1, 252).alias("n252"), sample_kurtosis("lr", F.col("idx").between(1, 252)).alias("kurt"),
        F.min(when_idx("market_date", 0, 251)).alias("first252"),
        F.collect_list(F.struct("market_date", "raw_close")).alias("closes"),
    )
    scope = market.instruments.select("instrument_id", F.col("primary_market_scope").alias("market_scope"))
    ranges = market.symbols.groupBy("instrument_id", "market_scope").agg(F.collect_list(F.struct("valid_from", "valid_to")).alias("ranges"))
    a = a.join(scope, "instrument_id").join(ranges, ["instrument_id", "market_scope"], "left").join(_paid(market, t), "instrument_id", "left")
    a = a.join(F.broadcast(_calendars(market, t)), "market_scope", "left")  # a row for each scope
    listed = F.filter("days", lambda d: _listed(F.col("ranges"), d))
    missing = F.array_except(listed, F.transform("closes", lambda b: b["market_date"]))
    # yields of the dividends within the last 252 bars, each on the raw close before it
    before = lambda d: F.array_max(F.filter("closes", lambda b: b["market_date"] < d["ex_date"]))["raw_close"]
    recent = F.filter("dividends", lambda d: (d["ex_date"] >= F.col("first252")) & (before(d) > 0))
    paid = F.when(F.size(recent) > 0, F.aggregate(recent, F.lit(0.0), lambda x, d: x + d["cash_amount"] / before(d)))
    size = lambda c: F.when(c.isNotNull(), F.size(c))
    a = a.withColumns({"calendar_days": size(F.col("days")), "listed_days": size(listed), "missing_days": size(missing), "paid": paid, "listed": F.coalesce(_listed(F.col("ranges"), F.lit(t)), F.lit(False)), "ex_days": F.when(F.col("next_ex").isNotNull(), F.coalesce(size(F.filter("ahead", lambda d: d <= F.col("next_ex"))), F.lit(0)))})
    adv = (F.col("adv_n") == 21) & (F.col("adv") > 0)
    z = F.when(F.col("park_prev") > 0, F.col("lr0") / F.col("park_prev"))
    diff = lambda x, y: ratio(x, y) - 1
    direction = F.signum("r0")
    m = {
        "close_raw": F.col("c0"), "dollar_adv21_log10": F.when(adv, F.log10("adv")), "listed_bars": F.col("total"), "active_at_t": F.coalesce("listed", F.lit(False)).cast("double"),
        **{f"ret_{n}d": diff("ac0", f"ac{n}") for n in (1, 5, 21, 63, 126, 252)}, "mom_12_1": diff("ac21", "ac252"), "gap": diff("ao0", "ac1"), "gap_freq_63d": F.col("gap_freq_63d"), "abs_gap_med_63d": F.col("abs_gap_med_63d"),
        **{f"close_vs_sma{n}": diff("ac0", f"sma{n}") for n in (20, 50, 200)}, "sma50_vs_sma200": diff("sma50", "sma200"), "high_252_dist": diff("ac0", "high252"), "low_252_dist": diff("ac0", "low252"), "drawdown_252": diff("ac0", "top252"),
        "up_streak": F.when(direction != 0, direction * F.coalesce("turn", "n_r")).otherwise(0.0), "up_days_21d": F.col("up_days_21d"), "vol_21d": F.col("vol_21d"), "vol_63d": F.col("vol_63d"), "vol_ratio_21_63": ratio("vol_21d", "vol_63d"), "parkinson_21d": F.col("parkinson_21d"),
        "atr_pct_14": ratio("atr14", "ac0"), "max_abs_ret_21d": F.col("max_abs_ret_21d"), "range_pct": ratio(F.col("h0") - F.col("l0"), "c0"), "clv": ratio(2 * F.col("c0") - F.col("h0") - F.col("l0"), F.col("h0") - F.col("l0")),
        "rvol_21d": F.when(adv, F.col("dv0") / F.col("adv")), "volume_trend_5_63": F.when((F.col("dv63_n") == 63) & (F.col("dv63") > 0), F.col("dv5") / F.col("dv63")), "amihud_21d": F.when((F.col("dv21_n") == 21) & (F.col("dv21_min") > 0), F.col("amihud")),
        "suspended_days_63d": F.when((F.col("calendar_days") == CALENDAR_DAYS) & (F.col("listed_days") == CALENDAR_DAYS), F.col("missing_days") / 63.0),
        "days_since_split": F.when(F.col("last_split").isNotNull(), F.col("since_split")), "days_since_dividend": F.when(F.col("last_dividend").isNotNull(), F.col("since_dividend")), "declared_ex_days": F.col("ex_days"), "div_yield_ttm": F.col("paid"),
        "yz_vol_21d": F.when(F.col("yz_n") == 21, F.sqrt(F.col("yz_on") + YZ_K * F.col("yz_oc") + (1 - YZ_K) * F.col("yz_rs")) * YEAR),
        "range_med_21d": F.when(F.col("range_n") == 21, F.col("range_med")), "range_surprise": F.when((F.col("range_n") == 21) & (F.col("range_med") > 0), F.col("rel_range0") / F.col("range_med")),
        "ret_z_21d": z, "ret_z_vadj_21d": F.when(adv & (F.col("dv0") > 0), z / F.sqrt(F.col("dv0") / F.col("adv"))), "ret_pctile_252d": F.when(F.col("n252") == 252, (F.col("below") + 0.5 * F.col("equal")) / 252.0), "ret_kurt_252d": F.when(F.col("n252") == 252, F.col("kurt")),
    }
    return a.select("instrument_id", "market_scope", F.col("total").alias("bars"), F.coalesce("listed_days", F.lit(0)).alias("listed_days"), *[v.cast("double").alias(k) for k, v in m.items()])


def metrics_at(market, t: dt.date, ids: list[str] | None = None, context: DataFrame | None = None) -> DataFrame:
    """instrument_id, id, family, value, text, bars_available, reason, unit: 61 rows for each instrument.

    ``context`` is what :func:`basalt.operators.context.context_at` gives; without
    it, the metrics against a baseline have no value.
    """
    w = wide(market if ids is None else market.only(ids), t)
    if context is not None:
        w = w.join(context.withColumnRenamed("bars", "ctx_bars").withColumnRenamed("reason", "ctx_reason"), "instrument_id", "left")
    have = set(w.columns)
    null = F.lit(None)

    def number(m):
        if m.family != "context":
            return F.col(m.id)
        if m.id == "resid_z_vadj_spy" and "resid_z_spy" in have:
            return F.when(F.col("rvol_21d") > 0, F.col("resid_z_spy") / F.sqrt("rvol_21d"))
        return F.col(m.id) if m.id in have and m.id != "tracking_etf" else null.cast("double")

    def short(m):
        is_short = F.col("bars") < m.min_bars
        return is_short | (F.col("listed_days") < CALENDAR_DAYS) if m.id == "suspended_days_63d" else is_short

    def gone(m):
        return (F.col("market_scope") == "cn_stocks") | short(m) if m.family == "context" else short(m)

    def value(m):
        text = F.col(m.id) if m.id == "tracking_etf" and m.id in have else null.cast("string")
        return F.when(~gone(m), number(m)).alias("value"), F.when(~gone(m), text).alias("text")

    def bars(m):
        if m.family != "context" or "spy_bars" not in have:
            return F.col("bars")
        mine = F.col("tracking_bars") if "tracking" in m.id else F.col("spy_bars")
        return F.when(gone(m), F.col("bars")).otherwise(F.coalesce(mine, F.lit(0)))

    def reason(m):
        out = F.when(F.col("market_scope") == "cn_stocks", "no_market_baseline") if m.family == "context" else F.when(F.lit(False), "")
        out = out.when(short(m), "insufficient_window")
        empty = F.col(m.id).isNull() if m.id == "tracking_etf" and m.id in have else number(m).isNull()
        if m.family == "context":
            side = ("tracking_reason" if "tracking" in m.id else "spy_reason") if "spy_reason" in have else None
            late = F.lit("insufficient_window") if m.id in ("resid_z_spy", "resid_z_vadj_spy") and side else F.lit("undefined_input")
            if m.id == "resid_z_vadj_spy" and side:
                late = F.when(F.col("resid_z_spy").isNull(), "insufficient_window").otherwise("undefined_input")
            why = F.coalesce(F.col(side), F.when(F.col("spy_bars").isNull() & F.lit("tracking" not in m.id), "undefined_input"), late) if side else F.lit("undefined_input")
            return out.when(empty, why)
        return out.when(empty, F.lit("no_known_event" if m.id in NO_EVENT_IDS else "undefined_input"))

    rows = w.select("instrument_id", F.explode(long_rows(DAILY, value, bars, reason)).alias("m"))
    return rows.select("instrument_id", "m.*")
