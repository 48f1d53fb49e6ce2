"""Facts of the CN scope from framed records (columns c1, c2, ... as sources.readers gives them)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.functions.columns import deterministic_uuid, first_by
from basalt.operators.asof import interval_join
from basalt.operators.facts import Identity, unresolved_rows
from basalt.sources.readers import path_part

SCOPE, SOURCE, CALENDAR = "cn_stocks", "baostock", "cn_equities"
CODE = r"^(sh|sz)\.[0-9]{6}$"
_is_code = lambda c: F.col(c).rlike(CODE)
_date = lambda c: F.try_to_date(F.nullif(F.col(c), F.lit("")))
_number = lambda c: F.expr(f"try_cast(nullif({c}, '') as double)")
_label = lambda: F.coalesce(F.nullif("code", F.lit("")), F.lit("(blank)"))


def exchanges(spark: SparkSession) -> DataFrame:
    """Two constant rows."""
    rows = [(mic, name, "exchange", SCOPE, CALENDAR, "Asia/Shanghai", "cn", "CNY") for mic, name in (("XSHG", "Shanghai Stock Exchange"), ("XSHE", "Shenzhen Stock Exchange"))]
    return spark.createDataFrame(rows, "exchange_mic string, name string, exchange_type string, market_scope string, calendar_id string, timezone string, country string, currency string")


def _basics(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("c1").alias("code"), F.col("c2").alias("code_name"), F.col("c3").alias("ipo_text"), F.col("c4").alias("out_text"), F.col("c5").alias("type_code"), F.col("c6").alias("status"), _date("c3").alias("ipo_date"), _date("c4").alias("out_date"), path_part("snapshot_date").cast("date").alias("snapshot_date"))


def _reused(basics: DataFrame) -> DataFrame:
    return basics.filter(_is_code("code")).groupBy("code").agg(F.count_distinct(F.nullif("ipo_text", F.lit(""))).alias("n")).filter("n > 1").select("code")


def identity(raw: DataFrame) -> Identity:
    """Instruments, symbols and identifiers; reused codes and bad rows are left out and reported."""
    b = _basics(raw)
    reused = _reused(b)
    bad_dates = ((F.col("ipo_text") != "") & F.col("ipo_date").isNull()) | ((F.col("out_text") != "") & F.col("out_date").isNull())
    bad = ~F.coalesce(_is_code("code"), F.lit(False)) | (F.col("type_code") != "1") | bad_dates
    again = b.join(reused, "code", "left_semi").groupBy("code").agg(F.max("snapshot_date").alias("day"), F.array_join(F.array_sort(F.collect_set("ipo_text")), ",").alias("listing_dates"))
    unresolved = unresolved_rows(again, "stock_basic", SCOPE, "code", "day", "code_reuse_suspected", F.to_json(F.struct("listing_dates")))
    sample = F.to_json(F.struct(F.col("ipo_text").alias("ipoDate"), F.col("out_text").alias("outDate"), F.col("type_code").alias("type")))
    unresolved = unresolved.unionByName(unresolved_rows(b.filter(bad), "stock_basic", SCOPE, _label(), "snapshot_date", "bad_row", sample))
    good = first_by(b.filter(~bad).join(reused, "code", "left_anti"), ["code"], F.desc_nulls_last("snapshot_date"), F.asc("code_name"))
    good = good.withColumns({"symbol": F.substring("code", 4, 6), "mic": F.when(F.col("code").startswith("sh."), "XSHG").otherwise("XSHE")})
    good = good.withColumn("instrument_id", deterministic_uuid("instrument", F.concat(F.lit("cn:"), "mic", F.lit(":"), "symbol")))
    instruments = good.select("instrument_id", F.lit("equity").alias("asset_class"), F.lit("common_stock").alias("instrument_type"), F.lit("ordinary_common").alias("security_form"), F.lit(True).alias("is_clean_common_stock"), F.coalesce(F.nullif("code_name", F.lit("")), "symbol").alias("name"), F.lit(SCOPE).alias("primary_market_scope"), F.col("mic").alias("primary_exchange_mic"), F.lit("CNY").alias("currency"), ((F.col("status") == "1") & F.col("out_date").isNull()).alias("active"), F.col("out_date").alias("delisted_date"), F.col("ipo_date").alias("first_seen_date"))
    key = F.concat(F.lit(f"{SCOPE}:"), "symbol", F.lit(":"), "instrument_id", F.lit(":"), F.coalesce(F.col("ipo_date").cast("string"), F.lit("open")))
    evidence = F.to_json(F.struct(F.lit("baostock_stock_basic").alias("basis"), F.col("code").alias("vendor_code")))
    symbols = good.select(deterministic_uuid("symbol", key).alias("symbol_id"), "instrument_id", F.lit(SCOPE).alias("market_scope"), "symbol", F.col("mic").alias("exchange_mic"), F.col("ipo_date").alias("valid_from"), F.col("out_date").alias("valid_to"), F.lit(True).alias("is_primary"), evidence.alias("evidence"))
    identifiers = good.select(F.lit("baostock_code").alias("identifier_type"), F.col("code").alias("identifier_value"), F.coalesce("ipo_date", "snapshot_date").alias("valid_from"), "instrument_id", F.lit(SOURCE).alias("source_id"), F.col("out_date").alias("valid_to"))
    return Identity(instruments, symbols, identifiers, unresolved)


def name_changes(raw: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Events where a code's name differs from the snapshot before."""
    b = _basics(raw)
    b = b.filter(_is_code("code")).join(_reused(b), "code", "left_anti")
    h = b.withColumn("old", F.lag("code_name").over(Window.partitionBy("code").orderBy("snapshot_date"))).filter("old is not null and old <> code_name")
    ids = identifiers.filter("identifier_type = 'baostock_code'").select(F.col("identifier_value").alias("code"), "instrument_id")
    event_id = F.concat(F.lit("baostock:"), "code", F.lit(":"), F.col("snapshot_date").cast("string"), F.lit(":name_change"))
    return h.join(ids, "code").select(F.lit(SOURCE).alias("source_id"), event_id.alias("source_event_id"), "instrument_id", F.lit("name_change").alias("event_type"), F.col("snapshot_date").alias("event_date"), F.lit("unknown").alias("timing"), F.concat(F.lit("Name changed to "), "code_name").alias("title"), F.to_json(F.struct(F.col("old").alias("old_name"), F.col("code_name").alias("new_name"))).alias("payload"))


def _latest(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("snapshot_date", path_part("snapshot_date").cast("date"))
    return rows.join(F.broadcast(rows.agg(F.max("snapshot_date").alias("snapshot_date"))), "snapshot_date")  # one row


def trading_days(calendar: DataFrame, universe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The latest calendar, and its bad rows and contradictions with whether anything traded."""
    c = _latest(calendar).select(_date("c1").alias("market_date"), F.col("c1").alias("text"), F.col("c2").alias("flag"), "snapshot_date")
    ok = F.col("market_date").isNotNull() & F.coalesce(F.col("flag").isin("0", "1"), F.lit(False))
    days = first_by(c.filter(ok), ["market_date"], F.desc("snapshot_date"), F.desc("flag")).select(F.lit(CALENDAR).alias("calendar_id"), "market_date", (F.col("flag") == "1").alias("is_open"), F.lit(False).alias("is_half_day"), F.lit(None).cast("timestamp").alias("open_utc"), F.lit(None).cast("timestamp").alias("close_utc"), F.lit(SOURCE).alias("source_id"))
    bad = unresolved_rows(c.filter(~ok), "trade_cal", SCOPE, F.lit("*"), "snapshot_date", "bad_row", F.to_json(F.struct(F.col("text").alias("calendar_date"), "flag")))
    traded = _latest(universe).filter(_is_code("c1")).groupBy(F.try_to_date("field8").alias("market_date")).agg(F.bool_or(F.col("c2") == "1").alias("any_security_traded"))
    clash = traded.join(days.select("market_date", F.col("is_open").alias("calendar_open")), "market_date").filter("calendar_open <> any_security_traded")
    return days, bad.unionByName(unresolved_rows(clash, "universe", SCOPE, F.lit("*"), "market_date", "calendar_trade_status_conflict", F.to_json(F.struct("calendar_open", "any_security_traded"))))


def _resolve(rows: DataFrame, identifiers: DataFrame, day: str, key: list[str]) -> DataFrame:
    ids = identifiers.filter("identifier_type = 'baostock_code'").select(F.col("identifier_value").alias("code"), "instrument_id", "valid_from", "valid_to")
    return interval_join(rows, ids, ["code"], day, key, latest=False).drop("valid_from", "valid_to")


def corporate_actions(raw: DataFrame, identifiers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A cash and a stock action from each implemented plan, the latest file's; and bad or unresolved ones."""
    r = raw.select(
        F.col("c1").alias("code"), _date("c4").alias("declaration_date"), _date("c6").alias("record_date"), F.col("c7").alias("ex_text"), _date("c7").alias("ex_date"), _date("c8").alias("pay_date"), F.col("c10").alias("cash_text"), _number("c10").alias("cash_amount"),
        F.expr("try_cast(nullif(regexp_extract(c11, '[0-9]+(\\\\.[0-9]+)?', 0), '') as double)").alias("cash_amount_post_tax"), F.col("c12").alias("bonus_text"), _number("c12").alias("bonus_ratio"), F.col("c14").alias("conversion_text"), _number("c14").alias("conversion_ratio"),
        F.concat(path_part("year", r"\d{4}"), F.lit("-01-01")).cast("date").alias("evidence_date"), "file",
    )
    broken = lambda text, value: (F.col(text) != "") & F.col(value).isNull()
    wrong = broken("cash_text", "cash_amount") | broken("bonus_text", "bonus_ratio") | broken("conversion_text", "conversion_ratio")
    code = F.coalesce(_is_code("code"), F.lit(False))
    sample = F.to_json(F.struct(F.col("ex_text").alias("ex_date"), F.col("cash_text").alias("cash"), F.col("bonus_text").alias("bonus"), F.col("conversion_text").alias("conversion")))
    bad = unresolved_rows(r.filter((F.col("ex_text") != "") & (~code | F.col("ex_date").isNull() | wrong)), "dividend", SCOPE, _label(), F.coalesce("ex_date", "evidence_date"), "bad_row", sample)
    done = first_by(r.filter(F.col("ex_date").isNotNull() & code & ~wrong), ["code", "ex_date"], F.desc("file"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    null = F.lit(None).cast("double")
    day = ["code", "ex_date", "declaration_date", "record_date", "pay_date"]
    cash = done.filter("cash_amount > 0").select(*day, F.lit("cash").alias("component"), F.lit("cash_dividend").alias("action_type"), "cash_amount", "cash_amount_post_tax", null.alias("bonus_ratio"), null.alias("conversion_ratio"))
    stock = done.filter(zero("bonus_ratio") + zero("conversion_ratio") > 0).select(*day, F.lit("stock").alias("component"), F.lit("stock_dividend").alias("action_type"), null.alias("cash_amount"), null.alias("cash_amount_post_tax"), zero("bonus_ratio").alias("bonus_ratio"), zero("conversion_ratio").alias("conversion_ratio"))
    both = _resolve(cash.unionByName(stock).withColumn("source_action_id", F.concat(F.lit("baostock:"), "code", F.lit(":"), F.col("ex_date").cast("string"), F.lit(":"), "component")), identifiers, "ex_date", ["source_action_id"])
    actions = both.filter("instrument_id is not null").select(F.lit(SOURCE).alias("source_id"), "source_action_id", "instrument_id", F.lit(SCOPE).alias("market_scope"), F.substring("code", 4, 6).alias("symbol_as_stated"), "action_type", "ex_date", "declaration_date", "record_date", "pay_date", null.alias("split_from"), null.alias("split_to"), "cash_amount", "cash_amount_post_tax", "bonus_ratio", "conversion_ratio", F.lit("CNY").alias("currency"), F.lit(None).cast("string").alias("dividend_type"), F.lit(None).cast("int").alias("frequency"))
    lost = unresolved_rows(both.filter("instrument_id is null"), "dividend", SCOPE, "code", "ex_date", "no_symbol_match", F.to_json(F.struct("source_action_id")))
    return actions, bad.unionByName(lost)


def bar_is_valid():
    """One rule for accepting a traded row: a date, volume, prices, and a range that holds open and close."""
    there = F.col("market_date").isNotNull() & (F.coalesce("volume", F.lit(0.0)) > 0)
    for c in ("open", "high", "low", "close"):
        there = there & F.col(c).isNotNull()
    return F.coalesce(there & (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close")), F.lit(False))


def bars_daily(raw: DataFrame, identifiers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Daily bars of traded rows, the latest file's; and bad or unresolved ones."""
    r = raw.select(F.col("c2").alias("code"), F.col("c1").alias("date_text"), _date("c1").alias("market_date"), *[_number(c).alias(n) for c, n in (("c3", "open"), ("c4", "high"), ("c5", "low"), ("c6", "close"), ("c8", "volume"))], F.col("c12").alias("status"), F.col("c14").alias("is_st"), F.try_to_date(path_part("window")).alias("evidence_date"), "file")
    r = first_by(r, ["code", "market_date"], F.desc("file"), F.asc("date_text"))
    traded = F.coalesce(F.col("status") == "1", F.lit(False))
    idle = F.coalesce(F.col("status") == "0", F.lit(False))
    sample = F.to_json(F.struct(F.col("date_text").alias("date"), F.col("status").alias("trade_status"), "open", "high", "low", "close", "volume"))
    bad = unresolved_rows(r.filter(~idle & ~(traded & bar_is_valid())), "daily_k", SCOPE, _label(), F.coalesce("market_date", "evidence_date"), "bad_row", sample)
    good = _resolve(r.filter(traded & bar_is_valid()), identifiers, "market_date", ["code", "market_date"])
    bars = good.filter("instrument_id is not null").select(F.lit(SOURCE).alias("source_id"), "instrument_id", "market_date", F.lit(SCOPE).alias("market_scope"), F.substring("code", 4, 6).alias("symbol_as_traded"), "open", "high", "low", "close", "volume", F.lit(None).cast("double").alias("vwap"), F.lit(None).cast("long").alias("trade_count"))
    return bars, bad.unionByName(unresolved_rows(good.filter("instrument_id is null"), "daily_k", SCOPE, "code", "market_date", "no_symbol_match", F.to_json(F.struct("close", "is_st"))))


def vendor_factors(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vendor's cumulative factors as increments (the first of a code is its baseline), and invalid rows."""
    r = raw.select(F.col("c1").alias("vendor_code"), F.col("c2").alias("event_date_text"), _date("c2").alias("event_date"), F.col("c4").alias("cumulative_factor_text"), _number("c4").alias("cumulative_factor"), "file")
    why = F.when(~F.coalesce(_is_code("vendor_code"), F.lit(False)), "invalid_vendor_code").when(F.col("event_date").isNull(), "invalid_event_date").when(F.col("cumulative_factor").isNull(), "invalid_cumulative_factor").when(F.col("cumulative_factor") <= 0, "nonpositive_cumulative_factor")
    r = r.withColumn("reason", why)
    good = first_by(r.filter("reason is null"), ["vendor_code", "event_date"], F.desc("file"))
    before = F.lag("cumulative_factor").over(Window.partitionBy("vendor_code").orderBy("event_date"))
    events = good.withColumn("before", before).select("vendor_code", "event_date", "cumulative_factor", (F.col("before") / F.col("cumulative_factor")).alias("factor"), F.when(F.col("before").isNull(), "vendor_baseline").otherwise("comparable").alias("status"))
    return events, r.filter("reason is not null").select("vendor_code", "event_date_text", "cumulative_factor_text", "reason")


def raw_windows(fetches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Complete download windows of daily rows, and those that are not, with the reason.

    ``fetches``: source_id, dataset and request_params (JSON with code, start_date, end_date, frame_count), a row for each frame.
    """
    p = F.from_json("request_params", "code string, start_date string, end_date string, frame_count string")
    f = fetches.filter("source_id = 'baostock' and dataset = 'daily_k'").select(p.alias("p")).select("p.*")
    w = f.groupBy(F.col("code").alias("vendor_code"), "start_date", "end_date").agg(F.count(F.lit(1)).alias("actual"), F.max(F.expr("try_cast(frame_count as int)")).alias("expected"))
    w = w.withColumns({"window_start": F.try_to_date("start_date"), "window_end": F.try_to_date("end_date")})
    shape = F.coalesce(_is_code("vendor_code"), F.lit(False)) & F.col("window_start").isNotNull() & F.col("window_end").isNotNull() & (F.col("window_start") <= F.col("window_end"))
    counted = F.coalesce(F.col("expected") > 0, F.lit(False))
    why = F.when(~counted, "missing_frame_count").when(F.col("actual") != F.col("expected"), "incomplete_raw_window").when(~F.coalesce(shape, F.lit(False)), "invalid_raw_window")
    w = w.withColumn("reason", why)
    text = F.concat(F.coalesce("start_date", F.lit("")), F.lit(".."), F.coalesce("end_date", F.lit("")))
    bad = w.filter("reason is not null").select(F.coalesce("vendor_code", F.lit("(blank)")).alias("vendor_code"), text.alias("market_date_text"), "reason")
    return w.filter("reason is null").select("vendor_code", "window_start", "window_end"), bad


def daily_coverage(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """vendor_code, market_date, is_traded, is_suspended of the latest file's rows, and invalid rows."""
    r = raw.select(F.col("c2").alias("vendor_code"), F.col("c1").alias("market_date_text"), _date("c1").alias("market_date"), F.col("c12").alias("status"), _number("c8").alias("volume"), "file")
    traded = F.coalesce(F.col("status") == "1", F.lit(False))
    why = F.when(~F.coalesce(_is_code("vendor_code"), F.lit(False)), "invalid_vendor_code").when(F.col("market_date").isNull(), "invalid_market_date").when(~F.coalesce(F.col("status").isin("0", "1"), F.lit(False)), "invalid_trade_status").when(traded & (F.coalesce("volume", F.lit(0.0)) <= 0), "traded_without_volume")
    r = r.withColumn("reason", why)
    good = first_by(r.filter("reason is null"), ["vendor_code", "market_date"], F.desc("file"))
    bad = r.filter("reason is not null").select(F.coalesce(F.nullif("vendor_code", F.lit("")), F.lit("(blank)")).alias("vendor_code"), "market_date_text", "reason")
    return good.select("vendor_code", "market_date", (F.col("status") == "1").alias("is_traded"), (F.col("status") == "0").alias("is_suspended")), bad
