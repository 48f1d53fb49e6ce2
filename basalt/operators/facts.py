"""Facts of the US scope from parsed payloads: identity, calendar, actions and bars, with what could not be resolved."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions.columns import classify, deterministic_uuid, first_by
from basalt.operators.asof import interval_join
from basalt.sources.readers import path_part

SCOPE, SOURCE, CALENDAR = "us_stocks", "polygon", "us_equities"


class Identity(NamedTuple):
    instruments: DataFrame
    symbols: DataFrame
    identifiers: DataFrame
    unresolved: DataFrame


def unresolved_rows(rows: DataFrame, dataset: str, scope: str, symbol, day, reason: str, sample) -> DataFrame:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return rows.select(F.lit(dataset).alias("dataset"), F.lit(scope).alias("market_scope"), c(symbol).alias("symbol"), c(day).alias("market_date"), F.lit(reason).alias("reason"), c(sample).alias("sample"))


def exchanges(raw: DataFrame) -> DataFrame:
    """The latest snapshot of each exchange."""
    rows = first_by(raw.filter("mic is not null and mic <> ''").withColumn("snapshot", path_part("snapshot_date")), ["mic"], F.desc_nulls_last("snapshot"), F.asc_nulls_last("name"))
    us = F.col("locale") == "us"
    return rows.select(F.col("mic").alias("exchange_mic"), "name", F.col("type").alias("exchange_type"), F.concat("locale", F.lit("_"), "asset_class").alias("market_scope"), F.when(us, CALENDAR).otherwise(F.concat("locale", F.lit("_equities"))).alias("calendar_id"), F.when(us, "America/New_York").otherwise("UTC").alias("timezone"), F.col("locale").alias("country"), F.when(us, "USD").alias("currency"))


def trading_days(fetches: DataFrame, holidays: DataFrame) -> DataFrame:
    """Past days from what was fetched (rows mean open), future special days from the latest list; the past wins."""
    past = fetches.filter((F.col("source_id") == SOURCE) & (F.col("dataset") == "grouped_daily") & F.col("market_date").isNotNull())
    past = past.groupBy("market_date").agg((F.max(F.coalesce("row_count", F.lit(0))) > 0).alias("is_open"), F.lit(False).alias("is_half_day"), F.lit(None).cast("timestamp").alias("open_utc"), F.lit(None).cast("timestamp").alias("close_utc"))
    h = holidays.withColumn("snapshot", path_part("snapshot_date"))
    latest = h.join(F.broadcast(h.agg(F.max("snapshot").alias("snapshot"))), "snapshot")  # one row
    future = latest.select(F.to_date("date").alias("market_date"), "status", F.try_to_timestamp("open").alias("open"), F.try_to_timestamp("close").alias("close")).filter("market_date is not null")
    future = future.groupBy("market_date").agg((~F.bool_or(F.col("status") == "closed")).alias("is_open"), F.bool_or(F.col("status") == "early-close").alias("is_half_day"), F.max("open").alias("open_utc"), F.max("close").alias("close_utc"))
    days = past.unionByName(future.join(past, "market_date", "left_anti"))
    return days.select(F.lit(CALENDAR).alias("calendar_id"), "market_date", "is_open", "is_half_day", "open_utc", "close_utc", F.lit(SOURCE).alias("source_id"))


def keyed_tickers(raw: DataFrame) -> DataFrame:
    """Ticker rows with their identity key: the FIGI, else the symbol with its delisting."""
    blank = lambda c: F.nullif(c, F.lit(""))
    rows = raw.filter("ticker is not null").select(
        F.col("ticker").alias("symbol"), "name", F.col("type").alias("type_code"), *[blank(F.col(c)).alias(c) for c in ("composite_figi", "share_class_figi", "cik")], blank(F.col("primary_exchange")).alias("primary_exchange_mic"),
        blank(F.upper("currency_name")).alias("currency"), F.coalesce("active", F.lit(False)).alias("active"), F.coalesce("last_updated_utc", F.lit("")).alias("last_updated_utc"),
        F.try_to_date(F.substring("delisted_utc", 1, 10)).alias("delisted_date"), path_part("snapshot_date").cast("date").alias("snapshot_date"),
    )
    no_figi = F.concat(F.lit("nofigi:"), "symbol", F.lit(":"), F.coalesce(F.col("delisted_date").cast("string"), F.lit("active")))
    return rows.withColumn("identity_key", F.coalesce("composite_figi", no_figi))


def identity(tickers: DataFrame, events: DataFrame) -> Identity:
    """Instruments, symbols with validity, identifiers and ambiguous usages.

    Usages of one ticker are chained: each begins where the one before ended.
    Ticker-change events replace the chained range of the same instrument and symbol.
    """
    keyed = keyed_tickers(tickers)
    of = keyed.groupBy("identity_key").agg(F.bool_or("active").alias("any_active"), F.max("delisted_date").alias("max_delisted"), F.min("snapshot_date").alias("first_seen_date"))
    picked = first_by(keyed, ["identity_key"], F.desc("active"), F.desc("last_updated_utc"), F.desc_nulls_last("snapshot_date"), F.asc("symbol"))
    inst = picked.join(of, "identity_key").withColumns({"instrument_id": deterministic_uuid("instrument", "identity_key"), "kind": classify("type_code")})
    instruments = inst.select("instrument_id", F.lit("equity").alias("asset_class"), "kind.*", F.coalesce("name", "symbol").alias("name"), F.lit(SCOPE).alias("primary_market_scope"), "primary_exchange_mic", "currency", F.col("any_active").alias("active"), F.when(~F.col("any_active"), F.col("max_delisted")).alias("delisted_date"), "first_seen_date")
    ids = inst.select("identity_key", "instrument_id", "primary_exchange_mic")

    pairs = keyed.groupBy("identity_key", "symbol").agg(F.bool_or("active").alias("live"), F.max("delisted_date").alias("delisted"), F.max(F.try_to_date(F.substring("last_updated_utc", 1, 10))).alias("updated"))
    pairs = pairs.join(ids, "identity_key").withColumn("valid_to", F.when(~F.col("live"), F.coalesce("delisted", "updated")))
    chain = Window.partitionBy("symbol").orderBy(F.coalesce("valid_to", F.lit("9999-12-31").cast("date")), "instrument_id")
    pairs = pairs.withColumns({"valid_from": F.lag("valid_to").over(chain), "place": F.row_number().over(chain)})
    ambiguous = F.col("valid_from").isNull() & (F.col("place") > 1)
    closes = Window.partitionBy("composite_figi").orderBy("event_date")
    overlay = events.withColumn("valid_to", F.lead("event_date").over(closes)).join(ids, events["composite_figi"] == ids["identity_key"])
    overlay = overlay.select("instrument_id", "primary_exchange_mic", "symbol", F.col("event_date").alias("valid_from"), "valid_to", F.lit('{"basis":"ticker_events"}').alias("evidence"))
    basis = F.when(F.col("valid_from").isNull(), '{"basis":"reference_snapshot"}').otherwise('{"basis":"reference_snapshot_chained"}')
    base = pairs.filter(~ambiguous).join(overlay.select("instrument_id", "symbol"), ["instrument_id", "symbol"], "left_anti")
    both = base.select("instrument_id", "primary_exchange_mic", "symbol", "valid_from", "valid_to", basis.alias("evidence")).unionByName(overlay)
    key = F.concat(F.lit(f"{SCOPE}:"), "symbol", F.lit(":"), "instrument_id", F.lit(":"), F.coalesce(F.col("valid_from").cast("string"), F.lit("open")))
    symbols = both.select(deterministic_uuid("symbol", key).alias("symbol_id"), "instrument_id", F.lit(SCOPE).alias("market_scope"), "symbol", F.col("primary_exchange_mic").alias("exchange_mic"), "valid_from", "valid_to", F.lit(True).alias("is_primary"), "evidence")

    last = keyed.agg(F.max("snapshot_date").alias("last"))
    bad = pairs.filter(ambiguous).crossJoin(F.broadcast(last))  # one row
    unresolved = unresolved_rows(bad, "reference_tickers", SCOPE, "symbol", "last", "ambiguous", F.to_json(F.struct("instrument_id")))

    types = F.explode(F.array(*[F.struct(F.lit(c).alias("identifier_type"), F.col(c).alias("identifier_value")) for c in ("composite_figi", "share_class_figi", "cik")])).alias("i")
    values = keyed.select("identity_key", "snapshot_date", types).select("identity_key", "snapshot_date", "i.*").filter("identifier_value is not null").join(ids, "identity_key")
    values = values.groupBy("identifier_type", "identifier_value").agg(F.min("snapshot_date").alias("valid_from"), F.min("instrument_id").alias("instrument_id"), F.max("instrument_id").alias("other"))
    identifiers = values.filter("instrument_id = other").select("identifier_type", "identifier_value", "valid_from", "instrument_id", F.lit(SOURCE).alias("source_id"), F.lit(None).cast("date").alias("valid_to"))
    return Identity(instruments, symbols, identifiers, unresolved)


def _ranges(symbols: DataFrame) -> DataFrame:
    return symbols.filter(F.col("market_scope") == SCOPE).select("symbol", "instrument_id", "valid_from", "valid_to")


def corporate_actions(splits: DataFrame, dividends: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Actions resolved at their ex-date, and a row for each symbol that has unresolved ones."""
    s = splits.filter("id is not null and execution_date is not null").select(F.col("id").alias("source_action_id"), F.col("ticker").alias("symbol"), F.lit("split").alias("action_type"), F.to_date("execution_date").alias("ex_date"), "split_from", "split_to").distinct()
    d = dividends.filter("id is not null and ex_dividend_date is not null").select(
        F.col("id").alias("source_action_id"), F.col("ticker").alias("symbol"), F.lit("cash_dividend").alias("action_type"), F.to_date("ex_dividend_date").alias("ex_date"), *[F.try_to_date(c).alias(c) for c in ("declaration_date", "record_date", "pay_date")],
        "cash_amount", F.nullif(F.upper("currency"), F.lit("")).alias("currency"), F.nullif("dividend_type", F.lit("")).alias("dividend_type"), "frequency",
    ).distinct()
    done, bad = [], []
    for dataset, rows in (("splits", s), ("dividends", d)):
        r = interval_join(rows, _ranges(symbols), ["symbol"], "ex_date", ["source_action_id"]).drop("valid_from", "valid_to")
        done.append(r.filter("instrument_id is not null"))
        missing = r.filter("instrument_id is null").groupBy("symbol").agg(F.min("ex_date").alias("day"), F.to_json(F.struct(F.count(F.lit(1)).alias("count"))).alias("sample"))
        bad.append(unresolved_rows(missing, dataset, SCOPE, "symbol", "day", "no_symbol_match", "sample"))
    all_ = done[0].unionByName(done[1], allowMissingColumns=True)
    null = lambda kind: F.lit(None).cast(kind)
    actions = all_.select(F.lit(SOURCE).alias("source_id"), "source_action_id", "instrument_id", F.lit(SCOPE).alias("market_scope"), F.col("symbol").alias("symbol_as_stated"), "action_type", "ex_date", "declaration_date", "record_date", "pay_date", "split_from", "split_to", "cash_amount", null("double").alias("cash_amount_post_tax"), null("double").alias("bonus_ratio"), null("double").alias("conversion_ratio"), "currency", "dividend_type", "frequency")
    return actions, bad[0].unionByName(bad[1])


def bars_daily(grouped: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Daily bars resolved at their date, and those without a symbol."""
    rows = grouped.filter("T is not null").select(F.col("T").alias("symbol"), path_part("date").cast("date").alias("market_date"), F.col("o").alias("open"), F.col("h").alias("high"), F.col("l").alias("low"), F.col("c").alias("close"), F.col("v").alias("volume"), F.col("vw").alias("vwap"), F.col("n").alias("trade_count"))
    r = interval_join(rows, _ranges(symbols), ["symbol"], "market_date", ["symbol", "market_date"])
    good = r.filter("instrument_id is not null").select(F.lit(SOURCE).alias("source_id"), "instrument_id", "market_date", F.lit(SCOPE).alias("market_scope"), F.col("symbol").alias("symbol_as_traded"), "open", "high", "low", "close", "volume", "vwap", "trade_count")
    return good, unresolved_rows(r.filter("instrument_id is null"), "grouped_daily", SCOPE, "symbol", "market_date", "no_symbol_match", F.to_json(F.struct("close")))


def bars_minute(minutes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Minute bars of resolved symbols. Each (day, symbol) is resolved once, before its minutes are joined."""
    days = interval_join(minutes.select("market_date", "symbol").distinct(), _ranges(symbols), ["symbol"], "market_date", ["symbol", "market_date"])
    days = days.filter("instrument_id is not null").select("market_date", "symbol", "instrument_id")
    return minutes.join(days, ["market_date", "symbol"]).select("instrument_id", "market_date", "window_start_utc", "open", "high", "low", "close", "volume", "transactions", F.col("symbol").alias("symbol_as_traded"))


def unresolved_minutes(minutes: DataFrame, resolved: DataFrame) -> DataFrame:
    """market_date, symbol, minute_bars of the symbol-days that no instrument has."""
    known = resolved.select("market_date", F.col("symbol_as_traded").alias("symbol")).distinct()
    return minutes.groupBy("market_date", "symbol").agg(F.count(F.lit(1)).alias("minute_bars")).join(known, ["market_date", "symbol"], "left_anti")
