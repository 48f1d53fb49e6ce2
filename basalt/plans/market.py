"""The tables of a market, and the driver's tables seen as one.

The mapping is deterministic and has a SQL twin (``MARKET_SQL``), so that
every operator can be checked against SQL on the same rows: suppliers are
instruments, grouped line items are daily bars (one tape line for each return
flag), certain line items are corporate actions, ship dates are the calendar,
events are minute trades, and all line items together are the index ``MKT``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions.columns import rounded
from basalt.operators import adjust


@dataclass
class Market:
    """Facts of one or more market scopes. Derived tables are made once and lazily."""

    bars_daily: DataFrame
    instruments: DataFrame
    symbols: DataFrame
    corporate_actions: DataFrame
    trading_days: DataFrame
    exchanges: DataFrame
    bars_minute: DataFrame | None = None
    raw_minutes: DataFrame | None = None

    @cached_property
    def canonical(self) -> DataFrame:
        return adjust.canonical_bars(self.bars_daily)

    @cached_property
    def factors(self) -> DataFrame:
        return adjust.factor_events(self.corporate_actions, self.instruments, self.canonical)

    def only(self, ids: list[str] | DataFrame) -> Market:
        """The market with bars and actions of some instruments (their ids, or rows with instrument_id), chosen below every shuffle."""
        if isinstance(ids, DataFrame):
            chosen = ids.select("instrument_id").distinct()
            keep = lambda df: df.join(chosen, "instrument_id", "left_semi")
        else:
            keep = lambda df: df.filter(F.col("instrument_id").isin(*ids))
        return replace(self, bars_daily=keep(self.bars_daily), corporate_actions=keep(self.corporate_actions))

    def adjusted(self, policy: str, as_of=None, ids: list[str] | DataFrame | None = None, since=None) -> DataFrame:
        """Adjusted bars up to ``as_of``, of some instruments, from ``since`` on; the choices reach the scan."""
        m = self if ids is None else self.only(ids)
        return adjust.adjusted_bars(m.canonical, m.corporate_actions, m.instruments, policy, as_of, since)


def from_driver(spark: SparkSession, sf_dir: str) -> Market:
    """The driver's tables as a market."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    geo = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")  # 25 nations
    key = F.col("s_suppkey")
    scope = F.when(F.col("r_name") == "ASIA", "cn_stocks").otherwise("us_stocks")
    inst = t("supplier").join(F.broadcast(geo), F.col("s_nationkey") == F.col("n_nationkey"))
    inst = inst.select(key.alias("k"), key.cast("string").alias("instrument_id"), scope.alias("primary_market_scope"), F.when(key % 7 == 0, "").otherwise(F.when(scope == "cn_stocks", "cny").otherwise("usd")).alias("currency"), F.when(key % 10 == 0, F.lit("2000-07-15").cast("date")).alias("delisted_date"), F.col("s_name").alias("name"))
    extra = spark.createDataFrame([("MKT", "Market"), *((f"EV_{e}", e) for e in EVENT_TYPES)], "instrument_id string, name string")
    extra = extra.select("instrument_id", F.lit("us_stocks").alias("primary_market_scope"), F.lit("USD").alias("currency"), F.lit(None).cast("date").alias("delisted_date"), "name")
    instruments = inst.drop("k").unionByName(extra)

    line = t("lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("market_date"), "l_returnflag", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_quantity", "l_extendedprice", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), "l_linenumber", "l_discount", "l_tax")
    vwap = rounded(F.sum("l_extendedprice") / F.sum("l_quantity"))
    bars = line.groupBy("l_suppkey", "market_date", "l_returnflag").agg(F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("l_quantity").alias("volume"), vwap.alias("vwap"), F.count(F.lit(1)).alias("trade_count"))
    bars = bars.join(inst.select(F.col("k").alias("l_suppkey"), "primary_market_scope"), "l_suppkey").select(F.when(F.col("primary_market_scope") == "cn_stocks", "baostock").otherwise("polygon").alias("source_id"), F.col("l_suppkey").cast("string").alias("instrument_id"), "market_date", F.col("primary_market_scope").alias("market_scope"), F.col("l_returnflag").alias("symbol_as_traded"), "open", "high", "low", "close", "volume", "vwap", "trade_count")
    index = line.groupBy("market_date").agg(vwap.alias("vwap"), F.max("price").alias("hi"), F.min("price").alias("lo"), F.sum("l_quantity").alias("volume"), F.count(F.lit(1)).alias("trade_count"))
    index = index.select(F.lit("polygon").alias("source_id"), F.lit("MKT").alias("instrument_id"), "market_date", F.lit("us_stocks").alias("market_scope"), F.lit("SPY").alias("symbol_as_traded"), F.col("vwap").alias("open"), F.col("hi").alias("high"), F.col("lo").alias("low"), F.col("vwap").alias("close"), "volume", "vwap", "trade_count")

    ev = t("events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value", "event_id")
    minute = ev.groupBy("event_type", F.date_trunc("minute", "ts").alias("window_start_utc")).agg(F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"), F.count(F.lit(1)).alias("transactions"))
    raw_minutes = minute.select(F.to_date("window_start_utc").alias("market_date"), F.col("event_type").alias("symbol"), "window_start_utc", "open", "high", "low", "close", "volume", "transactions")
    resolved = raw_minutes.filter(F.col("symbol") != UNRESOLVED_EVENT)
    minutes = resolved.select(F.concat(F.lit("EV_"), "symbol").alias("instrument_id"), "market_date", "window_start_utc", "open", "high", "low", "close", "volume", "transactions", F.col("symbol").alias("symbol_as_traded"))
    first_last = lambda f, c: f(c, "window_start_utc")
    daily = minutes.groupBy("instrument_id", "market_date", "symbol_as_traded").agg(first_last(F.min_by, "open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), first_last(F.max_by, "close").alias("close"), F.sum("volume").alias("volume"), F.sum("transactions").alias("trade_count"))
    daily = daily.select(F.lit("polygon").alias("source_id"), "instrument_id", "market_date", F.lit("us_stocks").alias("market_scope"), "symbol_as_traded", "open", "high", "low", "close", "volume", F.lit(None).cast("double").alias("vwap"), "trade_count")

    act = line.withColumn("instrument_id", F.col("l_suppkey").cast("string")).join(instruments.select("instrument_id", F.col("primary_market_scope").alias("market_scope")), "instrument_id")
    null = lambda kind: F.lit(None).cast(kind)
    day = F.col("market_date")

    def action(kind, where, **cols):
        base = {"split_from": null("double"), "split_to": null("double"), "cash_amount": null("double"), "bonus_ratio": null("double"), "conversion_ratio": null("double"), "currency": null("string"), "dividend_type": null("string")} | cols
        return act.filter(where).select(F.lit("polygon").alias("source_id"), F.concat(F.lit(kind[:2]), F.lit("-"), "l_linenumber", F.lit("-"), "seq").alias("source_action_id"), "instrument_id", "market_scope", F.lit(kind).alias("action_type"), day.alias("ex_date"), F.date_sub(day, 10).alias("declaration_date"), *[v.alias(k) for k, v in base.items()])

    cash = F.floor(F.col("price")) / 100
    actions = action("split", "l_linenumber = 7 and l_quantity <= 2", split_from=F.lit(1.0), split_to=F.lit(2.0))
    actions = actions.unionByName(action("cash_dividend", "l_discount = 0.1 and l_tax >= 0.07 and l_returnflag = 'R'", cash_amount=cash, currency=F.when(F.col("l_linenumber") == 3, "CAD").when(F.col("l_linenumber") == 4, "").otherwise(F.when(F.col("market_scope") == "cn_stocks", "CNY").otherwise("USD")), dividend_type=F.lit("CD")))
    actions = actions.unionByName(action("stock_dividend", "l_linenumber = 6 and l_quantity = 50 and l_tax = 0.08", bonus_ratio=F.lit(0.25), conversion_ratio=F.lit(0.125)))

    symbol = F.when(F.col("k") == 1, "QQQ").when(F.col("k") == 2, "IWM").when(F.col("k") == 3, "DIA").otherwise(F.concat(F.lit("S"), "k"))
    change = F.lit("1998-01-01").cast("date")
    span = lambda name, start, end: (name.alias("symbol"), start.cast("date").alias("valid_from"), end.cast("date").alias("valid_to"))
    base = inst.select("k", "instrument_id", F.col("primary_market_scope").alias("market_scope"))
    sym = base.select("instrument_id", "market_scope", *span(symbol, F.lit(None), F.when(F.col("k") % 5 == 0, change)))
    sym = sym.unionByName(base.filter("k % 5 = 0").select("instrument_id", "market_scope", *span(F.concat(F.lit("T"), "k"), change, F.when(F.col("k") % 10 == 0, F.lit("2000-07-15")))))
    sym = sym.unionByName(extra.select("instrument_id", F.col("primary_market_scope").alias("market_scope"), *span(F.when(F.col("instrument_id") == "MKT", "SPY").otherwise(F.col("name")), F.lit(None), F.lit(None))))
    symbols = sym.withColumn("is_primary", F.lit(True))

    dates = line.select("market_date").union(minutes.select("market_date")).distinct()
    calendar = dates.withColumn("calendar_id", F.explode(F.array(F.lit("XNYS"), F.lit("XSHG")))).select("calendar_id", "market_date", (F.dayofmonth("market_date") != 13).alias("is_open"), F.lit(False).alias("is_half_day"))
    exchanges = spark.createDataFrame([("XNYS", "us_stocks", "XNYS"), ("XSHG", "cn_stocks", "XSHG")], "exchange_mic string, market_scope string, calendar_id string")
    return Market(bars.unionByName(index).unionByName(daily), instruments, symbols, actions, calendar, exchanges, minutes, raw_minutes)


#: Event types of the driver's table; minutes of the last have no symbol.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
UNRESOLVED_EVENT = "view"
