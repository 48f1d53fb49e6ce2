"""Canonical bars, corporate-action factors and adjusted bars."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions.columns import first_by
from basalt.functions.text import one_of
from basalt.operators.asof import asof_join

#: The vendor of each market scope, and the actions of each policy.
SOURCE_OF_SCOPE = {"us_stocks": "polygon", "cn_stocks": "baostock"}
POLICIES = {"none": (), "split": ("split", "stock_dividend"), "split_dividend": ("split", "stock_dividend", "cash_dividend")}
PRICES = ("open", "high", "low", "close", "vwap")
DEFAULT_CURRENCY = "USD"


def canonical_bars(bars: DataFrame) -> DataFrame:
    """One vendor for each scope, then one tape line for each instrument and day: the most volume, then the symbol.

    Rows are dealt by instrument alone, so that the windows by instrument that
    follow need no further shuffle.
    """
    mine = F.lit(False)
    for scope, source in SOURCE_OF_SCOPE.items():
        mine = mine | ((F.col("market_scope") == scope) & (F.col("source_id") == source))
    rows = bars.filter(mine).select("instrument_id", "market_date", "symbol_as_traded", "open", "high", "low", "close", "volume", "vwap")
    return first_by(rows.repartition("instrument_id"), ["instrument_id", "market_date"], F.desc_nulls_last("volume"), F.asc("symbol_as_traded"))


def dividend_cash(actions: DataFrame, instruments: DataFrame) -> DataFrame:
    """Cash by instrument and ex-date: distinct statements in the instrument's currency are added up, others counted."""
    currency = lambda c, default: F.coalesce(F.nullif(F.upper(c), F.lit("")), default)
    own = instruments.select("instrument_id", currency(F.col("currency"), F.lit(DEFAULT_CURRENCY)).alias("expected_currency"))
    stated = actions.filter("action_type = 'cash_dividend' and cash_amount > 0").join(own, "instrument_id")
    stated = stated.select("instrument_id", "ex_date", F.coalesce("dividend_type", F.lit("")).alias("dividend_type"), "cash_amount", "expected_currency", currency(F.col("currency"), F.col("expected_currency")).alias("currency")).distinct()
    same = F.col("currency") == F.col("expected_currency")
    evidence = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dividend_type", "cash_amount"))), lambda s: F.concat(s["dividend_type"], F.lit(":"), s["cash_amount"].cast("string"))), ",")
    return stated.groupBy("instrument_id", "ex_date", "expected_currency").agg(F.coalesce(F.sum(F.when(same, F.col("cash_amount"))), F.lit(0.0)).alias("cash_amount"), F.count_if(~same).alias("currency_mismatch_rows"), evidence.alias("evidence"))


def _source_names() -> Column:
    return F.array_join(F.array_sort(F.collect_list(F.concat("source_id", F.lit(":"), "source_action_id"))), ",").alias("evidence")


def ratio_factors(actions: DataFrame) -> DataFrame:
    """Factors of splits and stock dividends, which need no bars.

    Splits stated twice for a day count once, the least id; equal stock statements count once, others add up.
    """
    key = ["instrument_id", "ex_date"]
    splits = actions.filter("action_type = 'split' and split_from > 0 and split_to > 0")
    splits = splits.groupBy(*key).agg(F.min_by(F.struct("split_from", "split_to"), "source_action_id").alias("s"), _source_names())
    splits = splits.select("instrument_id", F.col("ex_date").alias("event_date"), F.lit("split").alias("action_type"), (F.col("s.split_from") / F.col("s.split_to")).alias("price_factor"), (F.col("s.split_to") / F.col("s.split_from")).alias("volume_factor"), "evidence")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    stock = actions.filter("action_type = 'stock_dividend'").withColumns({"bonus": zero("bonus_ratio"), "conversion": zero("conversion_ratio")}).filter("bonus + conversion > 0")
    stock = stock.groupBy(*key, "bonus", "conversion").agg(F.min(F.struct("source_id", "source_action_id")).alias("s"))
    stock = stock.select(*key, "bonus", "conversion", "s.*").groupBy(*key).agg(F.sum("bonus").alias("bonus"), F.sum("conversion").alias("conversion"), _source_names())
    more = 1.0 + F.col("bonus") + F.col("conversion")
    stock = stock.select("instrument_id", F.col("ex_date").alias("event_date"), F.lit("stock_dividend").alias("action_type"), (1.0 / more).alias("price_factor"), more.alias("volume_factor"), "evidence")
    return splits.unionByName(stock)


def factor_events(actions: DataFrame, instruments: DataFrame, canonical: DataFrame) -> DataFrame:
    """instrument_id, event_date, action_type, price_factor, volume_factor, evidence of every usable action."""
    cash = asof_join(dividend_cash(actions, instruments).repartition("instrument_id"), canonical, ["instrument_id"], "ex_date", "market_date", {"close": "prev_close"}, inner=True)
    cash = cash.filter("cash_amount > 0 and prev_close > cash_amount")
    cash = cash.select("instrument_id", F.col("ex_date").alias("event_date"), F.lit("cash_dividend").alias("action_type"), (1 - F.col("cash_amount") / F.col("prev_close")).alias("price_factor"), F.lit(1.0).alias("volume_factor"), "evidence")
    return ratio_factors(actions).unionByName(cash)


def unadjustable_dividends(actions: DataFrame, instruments: DataFrame, canonical: DataFrame) -> DataFrame:
    """Dividends without a factor, with the reason."""
    rows = asof_join(dividend_cash(actions, instruments).repartition("instrument_id"), canonical, ["instrument_id"], "ex_date", "market_date", {"close": "prev_close"})
    none = F.col("cash_amount") == 0
    reason = F.when(none & (F.col("expected_currency") == DEFAULT_CURRENCY), "non_usd_only").when(none, "currency_mismatch_only").when(F.col("prev_close").isNull(), "no_prev_close").otherwise("cash_exceeds_prev_close")
    bad = rows.filter("cash_amount = 0 or prev_close is null or prev_close <= cash_amount")
    return bad.select("instrument_id", "ex_date", "prev_close", reason.alias("reason"), "cash_amount", "expected_currency", "currency_mismatch_rows")


def _carry(rows: DataFrame, cash: bool = False) -> DataFrame:
    """Bars (``_bar``) with the product of the factors (``_pf``, ``_vf``) of later events.

    An event counts that has a bar on or after it. Bars and events run in one
    stream for each instrument from the latest date to the earliest, a bar
    before the events of its own date, and the product is carried along. With
    ``cash``, dividends (``_cash``) get their factor from the close of the next
    bar in the stream, which is the last one before their date. One shuffle and
    one sort, linear; no range join, and nothing is broadcast.
    """
    rows = rows.withColumn("_event", F.col("_bar").isNull())
    order = ["_event", "_pf", "_cash"] if cash else ["_event", "_pf"]
    w = Window.partitionBy("instrument_id").orderBy(F.desc("_day"), *order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = {"_seen": F.count("_bar").over(upto)}
    factor = F.col("_pf")
    if cash:
        new["_prev"] = F.expr("lead(_close) ignore nulls over (partition by instrument_id order by _day desc, _event, _pf, _cash)")
        factor = F.coalesce("_pf", F.when(F.col("_prev") > F.col("_cash"), 1 - F.col("_cash") / F.col("_prev")))
    rows = rows.withColumns(new)
    live = F.col("_event") & (F.col("_seen") > 0)
    rows = rows.withColumns({"_live_pf": F.when(live, factor), "_live_vf": F.when(live, F.col("_vf"))})
    carried = lambda c: F.coalesce(F.product(c).over(upto), F.lit(1.0))
    rows = rows.withColumns({"cum_price_factor": carried("_live_pf"), "cum_volume_factor": carried("_live_vf")})
    return rows.filter("not _event").select("_bar.*", "cum_price_factor", "cum_volume_factor")


def _stream(bars: DataFrame, *more: str) -> DataFrame:
    return bars.select("instrument_id", F.col("market_date").alias("_day"), F.struct(*bars.columns).alias("_bar"), *more)


def _within(rows: DataFrame, day: str, since: dt.date | None, as_of: dt.date | None, after: bool = False) -> DataFrame:
    """Rows from ``since`` (``after``: later than it) to ``as_of``."""
    d = F.col(day)
    if as_of is not None:
        rows = rows.filter(d <= F.lit(as_of))
    if since is not None:
        rows = rows.filter(d > F.lit(since) if after else d >= F.lit(since))
    return rows


def with_factors(bars: DataFrame, events: DataFrame, policy: str, as_of: dt.date | None = None, since: dt.date | None = None) -> DataFrame:
    """``bars`` (instrument_id, market_date, ...) with cum_price_factor and cum_volume_factor from given factor events."""
    one_of(policy, tuple(POLICIES), "policy")
    bars = _within(bars, "market_date", since, as_of)
    if not POLICIES[policy]:
        return bars.withColumns({"cum_price_factor": F.lit(1.0), "cum_volume_factor": F.lit(1.0)})
    used = _within(events, "event_date", since, None, after=True).filter(F.col("action_type").isin(*POLICIES[policy]))
    used = used.select("instrument_id", F.col("event_date").alias("_day"), F.col("price_factor").alias("_pf"), F.col("volume_factor").alias("_vf"))
    return _carry(_stream(bars).unionByName(used.repartition("instrument_id"), allowMissingColumns=True))


def with_action_factors(canonical: DataFrame, actions: DataFrame, instruments: DataFrame, policy: str, as_of: dt.date | None = None, since: dt.date | None = None) -> DataFrame:
    """As :func:`with_factors`, from the actions themselves: a dividend's close before its date is found in the
    same stream as the product, so canonical bars are made and shuffled once.

    ``since`` prunes bars and actions below the scan and changes no row that is left: an action changes the bars
    before it, and where the last of these is before ``since``, so are all of them.
    """
    one_of(policy, tuple(POLICIES), "policy")
    kinds, actions = POLICIES[policy], _within(actions, "ex_date", since, None, after=True)
    if "cash_dividend" not in kinds:
        return with_factors(canonical, ratio_factors(actions), policy, as_of, since)
    ratios = ratio_factors(actions).select("instrument_id", F.col("event_date").alias("_day"), F.col("price_factor").alias("_pf"), F.col("volume_factor").alias("_vf"))
    cash = dividend_cash(actions, instruments).filter("cash_amount > 0").select("instrument_id", F.col("ex_date").alias("_day"), F.col("cash_amount").alias("_cash"))
    bars = _stream(_within(canonical, "market_date", since, as_of), "close").withColumnRenamed("close", "_close")
    # events are few; dealt as the bars are, they join these without another shuffle of the bars
    events = ratios.unionByName(cash, allowMissingColumns=True).repartition("instrument_id")
    return _carry(bars.unionByName(events, allowMissingColumns=True), cash=True)


def apply_factors(rows: DataFrame) -> DataFrame:
    """Prices and volume multiplied by the factors."""
    new = {c: F.col(c) * F.col("cum_price_factor") for c in PRICES if c in rows.columns}
    return rows.withColumns(new | {"volume": F.col("volume") * F.col("cum_volume_factor")})


def adjusted_bars(canonical: DataFrame, actions: DataFrame, instruments: DataFrame, policy: str, as_of: dt.date | None = None, since: dt.date | None = None) -> DataFrame:
    """Adjusted daily bars, from ``since`` on."""
    rows = apply_factors(with_action_factors(canonical, actions, instruments, policy, as_of, since))
    return rows.select("instrument_id", "market_date", F.lit(policy).alias("adjustment_policy"), *PRICES[:4], "volume", "vwap", "cum_price_factor", "cum_volume_factor", "symbol_as_traded")


def adjusted_minutes(minutes: DataFrame, events: DataFrame, policy: str, as_of: dt.date | None = None, instruments: list[str] | None = None) -> DataFrame:
    """Adjusted minute bars: factors are by day, and the series' last minute bar is the anchor.

    Factors are made once for each instrument and day and joined to its minutes.
    """
    if instruments is not None:
        minutes, events = (d.filter(F.col("instrument_id").isin(*instruments)) for d in (minutes, events))
    if as_of is not None:
        minutes = minutes.filter(F.col("market_date") <= F.lit(as_of))
    days = with_factors(minutes.select("instrument_id", "market_date").distinct(), events, policy)
    rows = apply_factors(minutes.join(days, ["instrument_id", "market_date"]))
    return rows.select("instrument_id", "market_date", "window_start_utc", F.lit(policy).alias("adjustment_policy"), *PRICES[:4], "volume", "transactions", "cum_price_factor", "cum_volume_factor", "symbol_as_traded")
