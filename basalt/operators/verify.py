"""Verification queries: parity with a vendor, minutes against days, continuity, vendor factors, overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions.columns import ratio, valid_at
from basalt.functions.dates import local_minute
from basalt.operators.adjust import POLICIES, adjusted_minutes
from basalt.sources.readers import date_range


def parity(ours: DataFrame, theirs: DataFrame, instruments: DataFrame) -> DataFrame:
    """Our split-adjusted closes beside a vendor's (symbol, market_date, close, volume), for instruments with one ticker.

    The number of tickers is the size of a window's set: distinct counts are not window functions here.
    """
    w = Window.partitionBy("instrument_id")
    one = ours.withColumn("lo", F.min("symbol_as_traded").over(w)).withColumn("hi", F.max("symbol_as_traded").over(w)).filter("lo = hi")
    one = one.select("instrument_id", F.col("symbol_as_traded").alias("symbol"), "market_date", F.col("close").alias("close_ours"), F.col("volume").alias("volume_ours"))
    t = theirs.select("symbol", "market_date", F.col("close").alias("close_theirs"), F.col("volume").alias("volume_theirs"))
    diff = F.abs(F.col("close_ours") - F.col("close_theirs"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = one.join(t, ["symbol", "market_date"]).join(instruments.select("instrument_id", "active"), "instrument_id")
    return rows.select("symbol", "market_date", "active", "close_ours", "close_theirs", diff.alias("close_diff"), (diff > F.greatest(F.lit(0.01), F.col("close_theirs") * 0.0005)).alias("close_mismatch"), (F.abs(zero("volume_ours") - zero("volume_theirs")) > zero("volume_theirs") * 0.005 + 1).alias("volume_mismatch"))


def parity_summary(rows: DataFrame) -> DataFrame:
    """Counts by segment and over all, by grouping sets."""
    sets = rows.groupingSets([["active"], []], "active")
    pct = 100.0 * (1 - F.count_if("close_mismatch") / F.count(F.lit(1)))
    out = sets.agg(F.grouping("active").alias("every"), F.count(F.lit(1)).alias("bars_compared"), F.count_if("close_mismatch").alias("close_mismatches"), pct.alias("close_match_pct"), F.max("close_diff").alias("max_close_diff"), F.count_if("volume_mismatch").alias("volume_mismatches"))
    segment = F.when(F.col("every") == 1, "all").when(F.col("active"), "active instruments").otherwise("delisted instruments")
    return out.select(segment.alias("segment"), "bars_compared", "close_mismatches", "close_match_pct", "max_close_diff", "volume_mismatches")


def minute_days(canonical: DataFrame, minutes: DataFrame, zone: str = "America/New_York", close_minute: int = 960) -> DataFrame:
    """Daily bars beside what the day's minutes say: the auction bar's open or the last regular close, and volume."""
    et = local_minute(F.col("window_start_utc"), zone)
    m = minutes.withColumn("et", et).groupBy("instrument_id", "market_date").agg(
        F.sum("volume").alias("minute_volume"), F.max_by(F.when(F.col("et") == close_minute, F.col("open")), F.when(F.col("et") == close_minute, F.col("window_start_utc"))).alias("auction_open"),
        F.max_by(F.when(F.col("et") < close_minute, F.col("close")), F.when(F.col("et") < close_minute, F.col("window_start_utc"))).alias("last_close"), F.count(F.lit(1)).alias("minute_bars"),
    )
    regular = F.coalesce("auction_open", "last_close")
    d = canonical.join(m, ["instrument_id", "market_date"])
    return d.select(F.col("symbol_as_traded").alias("symbol"), "market_date", F.col("close").alias("daily_close"), regular.alias("regular_close"), F.col("auction_open").isNotNull().alias("has_auction_bar"), F.col("volume").alias("daily_volume"), "minute_volume", "minute_bars", ratio("minute_volume", "volume").alias("volume_ratio"), (F.abs(regular - F.col("close")) > F.greatest(F.lit(0.01), F.col("close") * 0.001)).alias("close_mismatch"), (F.col("minute_volume") > F.coalesce("volume", F.lit(0.0)) * 1.02 + 100).alias("volume_violation"))


def _match():
    return 100.0 * (1 - F.count_if("close_mismatch") / F.count(F.lit(1)))


def minute_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("instrument_days"), F.count_distinct("market_date").alias("dates"), F.count_if("close_mismatch").alias("close_mismatches"), _match().alias("close_match_pct"), F.count_if("volume_violation").alias("volume_violations"), F.median("volume_ratio").alias("volume_ratio_median"), F.percentile("volume_ratio", 0.1).alias("volume_ratio_p10"))


def minute_segments(rows: DataFrame) -> DataFrame:
    """Agreement by auction bar and trading pattern."""
    n = F.col("minute_bars")
    pattern = F.when(n >= 390, "continuous (>=390 bars)").when(n >= 100, "intermittent (100-389)").otherwise("sparse (<100 bars)")
    return rows.groupBy(F.when(F.col("has_auction_bar"), "auction bar").otherwise("no auction bar").alias("close_source"), pattern.alias("trading_pattern")).agg(F.count(F.lit(1)).alias("instrument_days"), F.count_if("close_mismatch").alias("close_mismatches"), _match().alias("close_match_pct"), F.median("volume_ratio").alias("volume_ratio_median"))


def worst(rows: DataFrame, where, order, k: int = 10) -> DataFrame:
    """The ``k`` first rows of a report."""
    return rows.filter(where).orderBy(order, "symbol", "market_date").limit(k)


def continuity(fetches: DataFrame, bars_daily: DataFrame, minutes: DataFrame, daily_from, intraday_from, to) -> DataFrame:
    """problem, market_date: weekdays that break the contract between raw files, facts and minutes."""
    spark = fetches.sparkSession
    days = date_range(spark, daily_from, to).filter(F.weekday("market_date") < 5)
    us = fetches.filter("source_id = 'polygon'")
    daily = us.filter("dataset = 'grouped_daily'").groupBy("market_date").agg((F.max(F.coalesce("row_count", F.lit(0))) > 0).alias("open"))
    facts = bars_daily.filter("source_id = 'polygon' and market_scope = 'us_stocks'").select("market_date").distinct()
    raw_minutes = us.filter("dataset = 'minute_aggs'").select("market_date").distinct()
    parsed = minutes.select("market_date").distinct()
    is_open, closed = daily.filter("open").select("market_date"), daily.filter("not open").select("market_date")
    late = days.filter(F.col("market_date") >= F.lit(intraday_from).cast("date")).join(is_open, "market_date", "left_semi")
    found = {
        "missing_raw": days.join(daily, "market_date", "left_anti"),
        "open_day_missing_facts": days.join(is_open, "market_date", "left_semi").join(facts, "market_date", "left_anti"),
        "contradicted_closure": days.join(closed, "market_date", "left_semi").join(parsed, "market_date", "left_semi"),
        "intraday_missing_raw": late.join(raw_minutes, "market_date", "left_anti"),
        "intraday_missing_parquet": late.join(raw_minutes, "market_date", "left_semi").join(parsed, "market_date", "left_anti"),
    }
    out = None
    for name, rows in found.items():
        rows = rows.select(F.lit(name).alias("problem"), "market_date")
        out = rows if out is None else out.unionByName(rows)
    return out


def cn_gaps(identifiers: DataFrame, windows: DataFrame, first, last) -> DataFrame:
    """vendor_code, missing_dates, first_missing, last_missing: days that no complete window of a code covers."""
    codes = identifiers.filter("identifier_type = 'baostock_code'").select(F.col("identifier_value").alias("vendor_code"))
    days = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 day"))).alias("market_date")
    covered = windows.select("vendor_code", F.explode(F.sequence("window_start", "window_end", F.expr("interval 1 day"))).alias("market_date"))
    return _missing(codes.select("vendor_code", days).join(covered, ["vendor_code", "market_date"], "left_anti"))


def cn_missing_rows(identifiers: DataFrame, symbols: DataFrame, trading_days: DataFrame, coverage: DataFrame, first, last) -> DataFrame:
    """Open days of listed codes without a raw row."""
    codes = identifiers.filter("identifier_type = 'baostock_code'").select(F.col("identifier_value").alias("vendor_code"), "instrument_id")
    days = trading_days.filter((F.col("calendar_id") == "cn_equities") & F.col("is_open") & F.col("market_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    listed = codes.join(symbols.filter("market_scope = 'cn_stocks'").select("instrument_id", "valid_from", "valid_to"), "instrument_id")
    expected = listed.join(days.select("market_date"), valid_at("market_date", "valid_from", "valid_to")).select("vendor_code", "market_date")
    return _missing(expected.join(coverage.select("vendor_code", "market_date"), ["vendor_code", "market_date"], "left_anti"))


def _missing(rows: DataFrame) -> DataFrame:
    return rows.groupBy("vendor_code").agg(F.count(F.lit(1)).alias("missing_dates"), F.min("market_date").alias("first_missing"), F.max("market_date").alias("last_missing"))


def factor_comparison(local: DataFrame, vendor: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Our factors beside the vendor's increments, classified, by a full outer join."""
    ids = identifiers.filter("identifier_type = 'baostock_code'").select("instrument_id", F.col("identifier_value").alias("code"), "valid_from", "valid_to")
    ours = local.filter(F.col("action_type").isin("cash_dividend", "stock_dividend")).groupBy("instrument_id", "event_date").agg(F.product("price_factor").alias("local_price_factor"), F.bool_or(F.col("action_type") == "cash_dividend").alias("has_cash"), F.bool_or(F.col("action_type") == "stock_dividend").alias("has_stock"))
    i = ids.withColumnRenamed("instrument_id", "_id")
    ours = ours.join(i, (F.col("instrument_id") == F.col("_id")) & valid_at("event_date", "valid_from", "valid_to"), "left").select("instrument_id", "event_date", "local_price_factor", "has_cash", "has_stock", F.col("code").alias("local_code"))
    theirs = vendor.join(ids, (F.col("vendor_code") == F.col("code")) & valid_at("event_date", "valid_from", "valid_to"), "left").select("vendor_code", "event_date", "cumulative_factor", F.col("factor").alias("vendor_price_factor"), "status", F.col("instrument_id").alias("vendor_instrument"))
    v = theirs.withColumnRenamed("event_date", "vendor_date")
    both = v.join(ours, (F.col("vendor_instrument") == F.col("instrument_id")) & (F.col("vendor_date") == F.col("event_date")), "full_outer")
    cash, stock = F.coalesce("has_cash", F.lit(False)), F.coalesce("has_stock", F.lit(False))
    kind = F.when(F.col("vendor_code").isNull(), "no_vendor_event").when(F.col("vendor_instrument").isNull(), "vendor_code_unresolved").when(F.col("status") == "vendor_baseline", "vendor_baseline").when(F.col("instrument_id").isNull(), "no_local_factor").otherwise("comparable")
    segment = F.when(cash & stock, "cash_plus_stock").when(stock, "stock_only").when(cash, "cash_only").otherwise("no_local_factor")
    residual = F.col("local_price_factor") - F.col("vendor_price_factor")
    return both.select(F.coalesce("vendor_code", "local_code", F.lit("(unresolved)")).alias("vendor_code"), F.coalesce("vendor_date", "event_date").alias("event_date"), "cumulative_factor", "vendor_price_factor", "local_price_factor", kind.alias("comparison_class"), segment.alias("action_segment"), residual.alias("signed_residual"), F.abs(residual).alias("absolute_residual"))


def factor_segments(rows: DataFrame) -> DataFrame:
    a = F.col("absolute_residual")
    return rows.filter("comparison_class = 'comparable'").groupBy("action_segment").agg(F.count(F.lit(1)).alias("events"), F.avg("signed_residual").alias("mean_signed_residual"), F.median(a).alias("median_absolute_residual"), F.percentile(a, 0.95).alias("p95_absolute_residual"), F.max(a).alias("max_absolute_residual"))


def continuity_summary(problems: DataFrame) -> DataFrame:
    """problem, days, first, last of what :func:`continuity` found; no row where all is continuous."""
    return problems.groupBy("problem").agg(F.count(F.lit(1)).alias("days"), F.min("market_date").alias("first"), F.max("market_date").alias("last"))


def status_overview(market, fetches: DataFrame | None = None, unresolved: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """section, item, value: the size and reach of every table, of what was fetched, of what could not be resolved,
    and of the latest runs; and what is computed by name."""
    def section(name, rows: DataFrame, item, value):
        return rows.groupBy(item.cast("string").alias("item")).agg(value.cast("string").alias("value")).select(F.lit(name).alias("section"), "item", "value")

    n, lit = F.count(F.lit(1)), F.lit
    parts = [
        section("bars by scope", market.bars_daily, F.col("market_scope"), n), section("last bar by scope", market.bars_daily, F.col("market_scope"), F.max("market_date")), section("instruments by scope", market.instruments, F.col("primary_market_scope"), n),
        section("symbols by scope", market.symbols, F.col("market_scope"), n), section("ended symbols by scope", market.symbols.filter("valid_to is not null"), F.col("market_scope"), n), section("actions by type", market.corporate_actions, F.col("action_type"), n), section("open days by calendar", market.trading_days.filter("is_open"), F.col("calendar_id"), n),
        section("minute bars by date", market.bars_minute, F.col("market_date"), n), section("traded instruments", market.bars_daily, lit("all"), F.count_distinct("instrument_id")),
    ]
    spark = market.bars_daily.sparkSession
    parts.append(spark.createDataFrame([("computed", p, ", ".join(kinds) or "no action") for p, kinds in POLICIES.items()], "section string, item string, value string"))
    if fetches is not None:
        parts += [section("raw files by dataset", fetches, F.col("dataset"), n), section("raw rows by dataset", fetches, F.col("dataset"), F.sum(F.coalesce("row_count", lit(0))))]
    if unresolved is not None:
        parts.append(section("unresolved", unresolved, F.concat_ws(": ", "dataset", "reason"), n))
    if runs is not None:
        parts.append(recent_runs(runs, 8).select(lit("runs").alias("section"), F.col("run_id").alias("item"), F.concat_ws(" ", "job", "status", F.col("seconds").cast("string")).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def recent_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    """The latest runs (run_id, job, status, started_at, finished_at, error) with their seconds."""
    took = F.round(F.unix_micros("finished_at") / 1e6 - F.unix_micros("started_at") / 1e6).cast("int")
    return runs.orderBy(F.desc("started_at"), "run_id").limit(limit).select("run_id", "job", "status", "started_at", took.alias("seconds"), "error")


def unresolved_summary(unresolved: DataFrame) -> DataFrame:
    """dataset, reason, entries, first_date, last_date."""
    return unresolved.groupBy("dataset", "reason").agg(F.count(F.lit(1)).alias("entries"), F.min("market_date").alias("first_date"), F.max("market_date").alias("last_date"))


def scopes(market) -> DataFrame:
    """The market scopes that the data has."""
    return market.symbols.select(F.col("market_scope").alias("scope")).distinct()


def minute_day_list(market, instrument_id: str, limit: int = 30, zone: str = "America/New_York") -> DataFrame:
    """The latest days with minute bars of an instrument: bars, first and last local time, range and volume."""
    clock = lambda f: F.date_format(F.from_utc_timestamp(f("window_start_utc"), zone), "HH:mm")
    m = market.bars_minute.filter(F.col("instrument_id") == instrument_id).groupBy("market_date")
    m = m.agg(F.count(F.lit(1)).alias("bars"), clock(F.min).alias("first_et"), clock(F.max).alias("last_et"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("volume").cast("long").alias("volume"))
    return m.orderBy(F.desc("market_date")).limit(limit)


def day_minutes(market, instrument_id: str, day, policy: str = "split", as_of=None) -> DataFrame:
    """Adjusted minute bars of one instrument and day, by UTC seconds."""
    m = adjusted_minutes(market.bars_minute, market.factors, policy, as_of, [instrument_id]).filter(F.col("market_date") == F.lit(day).cast("date"))
    return m.select(F.unix_seconds("window_start_utc").alias("time"), "open", "high", "low", "close", "volume", "cum_price_factor", "symbol_as_traded")


def bars_of(market, instrument_id: str, policy: str = "split_dividend", as_of=None) -> DataFrame:
    """Adjusted daily bars of one instrument."""
    return market.adjusted(policy, as_of, [instrument_id]).select(F.col("market_date").alias("date"), "open", "high", "low", "close", "volume", "cum_price_factor", "symbol_as_traded")


def search(market, q: str, scope: str, limit: int = 20) -> DataFrame:
    """Usages of symbols that begin with ``q``, or whose instrument's name contains it: the exact symbol first, then
    current ones, the shortest, and of one symbol the latest."""
    u = q.upper()
    s = market.symbols.filter(F.col("market_scope") == scope).select("instrument_id", "symbol", "market_scope", "valid_from", "valid_to")
    rows = s.join(market.instruments.select("instrument_id", "name"), "instrument_id").filter(F.upper("symbol").startswith(u) | F.contains(F.upper("name"), F.lit(u)))
    text = lambda c: F.col(c).cast("string")
    usage = F.when(F.col("valid_to").isNull(), "current").otherwise(F.concat(F.coalesce(text("valid_from"), F.lit("…")), F.lit(" → "), text("valid_to")))
    order = [(F.upper("symbol") == u).desc(), F.col("valid_to").isNull().desc(), F.char_length("symbol"), F.asc("symbol"), F.desc_nulls_first("valid_to"), F.asc("instrument_id")]
    return rows.orderBy(*order).limit(limit).select("instrument_id", "symbol", usage.alias("symbol_usage"), "name", "market_scope")


def detail(market, instrument_id: str) -> dict[str, DataFrame]:
    """The instrument's row, symbols, actions, and bar reach."""
    mine = F.col("instrument_id") == instrument_id
    reach = market.bars_daily.filter(mine).agg(F.count(F.lit(1)).alias("bars"), F.min("market_date").alias("first"), F.max("market_date").alias("last"), F.count_distinct("symbol_as_traded").alias("lines"))
    return {"instrument": market.instruments.filter(mine), "symbols": market.symbols.filter(mine).orderBy(F.asc_nulls_first("valid_from")), "actions": market.corporate_actions.filter(mine).orderBy("ex_date", "source_action_id"), "reach": reach}


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other has not, with the side that has them."""
    one = lambda x, y, side: x.exceptAll(y.select(x.columns)).withColumn("side", F.lit(side))
    return one(a, b, "first").unionByName(one(b, a, "second"))


def contract(a: DataFrame, b: DataFrame) -> list[str]:
    """Differences between the columns and types of two sources of one table."""
    x, y = dict(a.dtypes), dict(b.dtypes)
    return sorted(f"{c}: {x.get(c)} / {y.get(c)}" for c in x.keys() | y.keys() if x.get(c) != y.get(c))
