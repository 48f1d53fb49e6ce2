"""All facts from one raw zone, written as one generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basalt.operators import facts, facts_cn
from basalt.sources import raw_zone, readers, schemas


def all_facts(spark: SparkSession, raw: str) -> dict[str, DataFrame]:
    """Facts tables of both scopes. A missing dataset gives empty tables."""
    us = lambda name, fields: readers.envelope(spark, f"{raw}/polygon/{name}", fields)
    cn = lambda name, width: readers.frame_records(spark, f"{raw}/baostock/{name}", width)
    fetches = readers.manifests(spark, raw)
    ident = facts.identity(us("reference_tickers", schemas.TICKERS), readers.ticker_events(spark, f"{raw}/polygon/ticker_events"))
    days = facts.trading_days(fetches, readers.holidays(spark, f"{raw}/polygon/market_holidays"))
    actions, lost_actions = facts.corporate_actions(us("splits", schemas.SPLITS), us("dividends", schemas.DIVIDENDS), ident.symbols)
    bars, lost_bars = facts.bars_daily(us("grouped_daily", schemas.GROUPED_DAILY), ident.symbols)
    basics = cn("stock_basic", 6)
    c_ident = facts_cn.identity(basics)
    c_days, odd_days = facts_cn.trading_days(cn("trade_cal", 2), cn("universe", 3))
    c_actions, lost_c_actions = facts_cn.corporate_actions(cn("dividend", 14), c_ident.identifiers)
    c_bars, lost_c_bars = facts_cn.bars_daily(cn("daily_k", 14), c_ident.identifiers)
    return {
        "exchanges": facts.exchanges(us("exchanges", schemas.EXCHANGES)).unionByName(facts_cn.exchanges(spark)),
        "instruments": ident.instruments.unionByName(c_ident.instruments),
        "symbols": ident.symbols.unionByName(c_ident.symbols),
        "instrument_identifiers": ident.identifiers.unionByName(c_ident.identifiers),
        "instrument_events": facts_cn.name_changes(basics, c_ident.identifiers),
        "trading_days": days.unionByName(c_days),
        "corporate_actions": actions.unionByName(c_actions),
        "bars_daily": bars.unionByName(c_bars),
        "unresolved": raw_zone.quarantine(ident.unresolved, lost_actions, lost_bars, c_ident.unresolved, odd_days, lost_c_actions, lost_c_bars),
    }


def build(spark: SparkSession, raw: str, root: str) -> str:
    """Write a new generation of facts; the old one stays readable until the pointer moves."""
    return raw_zone.write_generation(all_facts(spark, raw), root)
