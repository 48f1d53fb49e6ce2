"""Readers and facts builders over payloads made from the driver's tables, each with SQL over the same rows.

A query writes its payloads into the shared folder, reads them back with the
library's readers and gives the facts; the SQL starts from the payloads' rows.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.functions import dates
from basalt.functions.columns import INSTRUMENT_TYPES, rounded
from basalt.operators import facts, facts_cn, verify
from basalt.plans import build
from basalt.plans import payloads as P
from basalt.plans.market import from_driver
from basalt.plans.queries import MARKET_SQL
from basalt.sources import raw_zone, readers, schemas
from basalt.sources.store import shared_folder


def uuid_sql(kind: str, key: str) -> str:
    """The deterministic id of a key, by DuckDB."""
    m = f"md5('basalt:{kind}:' || {key})"
    return f"substr({m}, 1, 8) || '-' || substr({m}, 9, 4) || '-3' || substr({m}, 14, 3) || '-' || substr('89ab', 1 + (strpos('0123456789abcdef', substr({m}, 17, 1)) - 1) % 4, 1) || substr({m}, 18, 3) || '-' || substr({m}, 21, 12)"


# -- payloads, written and read back ---------------------------------------------


def _envelope(spark, sf_dir, name: str, fields: str, key: str = "snap", rename: str = "snapshot_date", path=None) -> DataFrame:
    rows = P.rows(spark, sf_dir, name).withColumnsRenamed({"symbol": "T"} if name == "daily" else {})
    return readers.envelope(spark, P.envelopes(spark, rows, key, rename, path), fields)


def tickers(spark, sf_dir, path=None) -> DataFrame:
    return _envelope(spark, sf_dir, "tickers", schemas.TICKERS, path=path)


def ticker_events(spark, sf_dir, path=None) -> DataFrame:
    e = P.rows(spark, sf_dir, "events").groupBy("figi").agg(F.collect_list(F.struct(F.struct(F.col("symbol").alias("ticker")).alias("ticker_change"), F.lit("ticker_change").alias("type"), F.col("day").alias("date"))).alias("events"))
    pages = e.select(F.struct(F.col("figi").alias("composite_figi"), "events").alias("results"), F.lit("2025-01-10").alias("snap"))
    return readers.ticker_events(spark, P.arrays(spark, pages, path=path))


def holidays(spark, sf_dir, path=None) -> DataFrame:
    return readers.holidays(spark, P.arrays(spark, P.rows(spark, sf_dir, "holidays").withColumnRenamed("day", "date"), path=path))


def daily(spark, sf_dir, path=None) -> DataFrame:
    return _envelope(spark, sf_dir, "daily", schemas.GROUPED_DAILY, "day", "date", path)


def cn(spark, sf_dir, name: str, method: str, width: int, **more) -> DataFrame:
    return readers.frame_records(spark, P.frames(spark, P.rows(spark, sf_dir, name), method, width, **more), width)


def minutes(spark, sf_dir) -> DataFrame:
    """Minute bars by way of daily CSV files."""
    path = shared_folder(spark, "raw")
    m = from_driver(spark, sf_dir).raw_minutes
    ns = (F.unix_micros("window_start_utc") * 1000).alias("window_start")
    m.select(F.col("symbol").alias("ticker"), "volume", "open", "close", "high", "low", ns, "transactions", F.col("market_date").alias("date")).write.partitionBy("date").option("header", True).option("compression", "gzip").csv(path)
    return readers.minute_csv(spark, f"{path}/*/*.csv.gz")


# -- queries -----------------------------------------------------------------------


def _s1(spark, sf_dir):
    t = tickers(spark, sf_dir)
    return t.select(readers.path_part("snapshot_date").alias("snapshot_date"), *[c for c in t.columns if c not in ("file", "market", "locale")])


def _s6(spark, sf_dir):
    return cn(spark, sf_dir, "universe", "query_all_stock", 3, per="field8").select("c1", "c2", "c3", "field8", readers.path_part("snapshot_date").alias("snapshot_date"))


def _s7(spark, sf_dir):
    """Frames of a whole zone, checked in bulk; one kind is cut short."""
    pattern = P.frames(spark, P.rows(spark, sf_dir, "basics"), "query_stock_basic", 6) + "/*/*/*.gz"
    good = readers.frame_checks(spark, pattern)
    cut, path = spark.read.text(pattern, wholetext=True).select(F.substring("value", 1, 400).alias("value")), shared_folder(spark, "raw")
    cut.write.text(path)
    bad = readers.frame_checks(spark, f"{path}/*.txt")
    each = lambda df, name: df.groupBy(F.lit(name).alias("kind"), "method", "problem").agg((F.count(F.lit(1)) > 0).alias("found"))
    return each(good, "whole").unionByName(each(bad, "cut"))


def _s10(spark, sf_dir):
    """A small payload for each nation is landed; one is landed again, some are cleared; the index comes from the sidecars."""
    root = shared_folder(spark, "raw")
    for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect():  # 25 rows
        for _ in range(2 if r.n_nationkey == 3 else 1):
            raw_zone.land(spark, root, f"n/region={r.n_regionkey}/{r.n_nationkey}.json", json.dumps({"name": r.n_name}).encode(), source_id="polygon", dataset="nations", market_date=f"2025-01-{1 + r.n_nationkey:02d}", row_count=int(r.n_nationkey))
    raw_zone.clear(spark, root, "n/region=2/")
    m = readers.manifests(spark, root)
    return m.select("file_path", "source_id", "dataset", "market_date", "row_count", "content_sha256", "http_status")


def _minute_facts(spark, sf_dir):
    """Written by date as facts, twice, and read back."""
    root = shared_folder(spark, "minutes")
    parsed = minutes(spark, sf_dir)
    raw_zone.write_minutes(parsed, root)
    raw_zone.write_minutes(parsed.withColumn("close", F.lit(0.0)), root, force=False)
    return readers.minutes(spark, root)


def _exchanges(spark, sf_dir):
    return facts.exchanges(_envelope(spark, sf_dir, "exchanges", schemas.EXCHANGES))


def _days(spark, sf_dir):
    return facts.trading_days(P.rows(spark, sf_dir, "fetches"), holidays(spark, sf_dir)).select("calendar_id", "market_date", "is_open", "is_half_day")


def _identity(part: str, *cols: str):
    def run(spark, sf_dir):
        return getattr(facts.identity(tickers(spark, sf_dir), ticker_events(spark, sf_dir)), part).select(*cols)

    return run


def _symbols(spark, sf_dir) -> DataFrame:
    return facts.identity(tickers(spark, sf_dir), ticker_events(spark, sf_dir)).symbols


def _actions(which: int, *cols: str):
    def run(spark, sf_dir):
        got = facts.corporate_actions(_envelope(spark, sf_dir, "splits", schemas.SPLITS, "one"), _envelope(spark, sf_dir, "dividends", schemas.DIVIDENDS, "one"), _symbols(spark, sf_dir))
        return got[which].select(*cols)

    return run


def _bars(which: int, *cols: str):
    def run(spark, sf_dir):
        return facts.bars_daily(daily(spark, sf_dir), _symbols(spark, sf_dir))[which].select(*cols)

    return run


def _basics(spark, sf_dir) -> DataFrame:
    return cn(spark, sf_dir, "basics", "query_stock_basic", 6)


def _cn_identity(part: str, *cols: str):
    def run(spark, sf_dir):
        return getattr(facts_cn.identity(_basics(spark, sf_dir)), part).select(*cols)

    return run


def _cn_names(spark, sf_dir):
    raw = _basics(spark, sf_dir)
    return facts_cn.name_changes(raw, facts_cn.identity(raw).identifiers).select("source_event_id", "instrument_id", "event_date", "title", "payload")


def _cn_days(which: int, *cols: str):
    def run(spark, sf_dir):
        got = facts_cn.trading_days(cn(spark, sf_dir, "calendar", "query_trade_dates", 2), cn(spark, sf_dir, "universe", "query_all_stock", 3, per="field8"))
        return got[which].select(*cols)

    return run


def _cn_actions(which: int, *cols: str):
    def run(spark, sf_dir):
        raw = cn(spark, sf_dir, "plans", "query_dividend_data", 14, key="year", rename="year")
        return facts_cn.corporate_actions(raw, facts_cn.identity(_basics(spark, sf_dir)).identifiers)[which].select(*cols)

    return run


def _k_lines(spark, sf_dir) -> DataFrame:
    return cn(spark, sf_dir, "k_lines", "query_history_k_data_plus", 14, key="win", rename="window")


def _cn_bars(which: int, *cols: str):
    def run(spark, sf_dir):
        return facts_cn.bars_daily(_k_lines(spark, sf_dir), facts_cn.identity(_basics(spark, sf_dir)).identifiers)[which].select(*cols)

    return run


def _cn_factors(which: int):
    def run(spark, sf_dir):
        got = facts_cn.vendor_factors(cn(spark, sf_dir, "factors", "query_adjust_factor", 4, key="one"))[which]
        return got.select(*[rounded(c, 9).alias(c) if t == "double" else c for c, t in got.dtypes])

    return run


def _cn_coverage(which: int):
    def run(spark, sf_dir):
        return facts_cn.daily_coverage(_k_lines(spark, sf_dir))[which]

    return run


def _factor_comparison(spark, sf_dir):
    """Our factors of the other scope's plans beside the vendor's."""
    ids = facts_cn.identity(_basics(spark, sf_dir)).identifiers
    raw = cn(spark, sf_dir, "plans", "query_dividend_data", 14, key="year", rename="year")
    actions = facts_cn.corporate_actions(raw, ids)[0]
    ratio = F.when(F.col("action_type") == "stock_dividend", 1 / (1 + F.col("bonus_ratio") + F.col("conversion_ratio"))).otherwise(1 - F.col("cash_amount") / 10)
    ours = actions.select("instrument_id", F.col("ex_date").alias("event_date"), "action_type", ratio.alias("price_factor"))
    theirs = facts_cn.vendor_factors(cn(spark, sf_dir, "factors", "query_adjust_factor", 4, key="one"))[0]
    c = verify.factor_comparison(ours, theirs, ids)
    return c.select("vendor_code", "event_date", "comparison_class", "action_segment", *[rounded(x, 9).alias(x) for x in ("vendor_price_factor", "local_price_factor", "signed_residual")])


def _cn_gaps(spark, sf_dir):
    """Days that no download window of a code covers; a window for each code and quarter with rows."""
    ids = facts_cn.identity(_basics(spark, sf_dir)).identifiers
    w = _k_lines(spark, sf_dir).select(F.col("c2").alias("vendor_code"), F.try_to_date("c1").alias("day")).filter("day is not null")
    w = w.select("vendor_code", F.trunc("day", "quarter").alias("window_start")).distinct().select("vendor_code", "window_start", F.date_add("window_start", 60).alias("window_end"))
    return verify.cn_gaps(ids, w, dt.date(2019, 1, 1), dt.date(2020, 12, 31))


def _quarantine(spark, sf_dir):
    """All that the builders could not resolve, one row for each key, beside rows that were there before."""
    bad = facts.bars_daily(daily(spark, sf_dir), _symbols(spark, sf_dir))[1]
    old = bad.filter("symbol < 'Q3'").withColumn("reason", F.lit("known before"))
    return raw_zone.quarantine(bad, bad, existing=old).groupBy("dataset", "reason").agg(F.count(F.lit(1)).alias("entries"), F.min("symbol").alias("first"), F.max("symbol").alias("last"))


def _build(spark, sf_dir):
    """A whole raw zone, built into a generation of facts that takes the place of an older one: rows of each table."""
    raw, root = shared_folder(spark, "zone"), shared_folder(spark, "facts")
    us, cn_ = f"{raw}/polygon", f"{raw}/baostock"
    tickers(spark, sf_dir, f"{us}/reference_tickers"), ticker_events(spark, sf_dir, f"{us}/ticker_events"), holidays(spark, sf_dir, f"{us}/market_holidays"), daily(spark, sf_dir, f"{us}/grouped_daily")
    for name, folder, fields in (("exchanges", "exchanges", schemas.EXCHANGES), ("splits", "splits", schemas.SPLITS), ("dividends", "dividends", schemas.DIVIDENDS)):
        _envelope(spark, sf_dir, name, fields, "snap" if name == "exchanges" else "one", path=f"{us}/{folder}")
    for name, folder, method, width, more in (("basics", "stock_basic", "query_stock_basic", 6, {}), ("calendar", "trade_cal", "query_trade_dates", 2, {}), ("universe", "universe", "query_all_stock", 3, {"per": "field8"}), ("plans", "dividend", "query_dividend_data", 14, {"key": "year", "rename": "year"}), ("k_lines", "daily_k", "query_history_k_data_plus", 14, {"key": "win", "rename": "window"})):
        cn(spark, sf_dir, name, method, width, path=f"{cn_}/{folder}", **more)
    for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect():  # 25 fetches, by sidecar
        raw_zone.land(spark, raw, f"polygon/notes/{r.n_nationkey}.json", b"{}", source_id="polygon", dataset="grouped_daily", market_date=f"2025-01-{1 + r.n_nationkey:02d}", row_count=int(r.n_nationkey))
    first = raw_zone.write_generation({"exchanges": facts_cn.exchanges(spark)}, root)
    second = build.build(spark, raw, root)
    raw_zone.drop_generations(spark, root, 1)
    if first == second or raw_zone.current_generation(spark, root) != second:
        raise ValueError("the pointer did not move")
    out = None
    for t in ("exchanges", "instruments", "symbols", "instrument_identifiers", "instrument_events", "trading_days", "corporate_actions", "bars_daily", "unresolved"):
        n = raw_zone.read_generation(spark, root, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("item"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def _date_math(spark, sf_dir):
    """Calendar arithmetic as columns: years on, weekdays between."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return o.select("day", *[dates.add_years_col(F.col("day"), n).alias(f"plus_{n}") for n in (1, 4)], F.size(dates.weekdays(F.col("day"), F.date_add("day", 10))).alias("weekdays"))


def _cutoffs(spark, sf_dir):
    """Publication cutoffs and the local minute of each event's time, in both zones and over the change of clocks."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"))
    ts = F.explode(F.array(F.col("ts"), F.col("ts") + F.expr("interval 120 days"))).alias("ts")
    e = e.select(ts).distinct()
    return e.select(
        dates.completed_date(F.col("ts"), "America/New_York").alias("completed"), dates.published_minute_date(F.col("ts")).alias("published"), dates.completed_date(F.col("ts"), "Asia/Shanghai").alias("completed_cn"), dates.local_minute(F.col("ts"), "America/New_York").alias("minute"),
    ).groupBy("completed", "published", "completed_cn").agg(F.count(F.lit(1)).alias("n"), F.sum("minute").cast("long").alias("minutes"))


UNRESOLVED = ("dataset", "market_scope", "symbol", "market_date", "reason", "sample")
INST = ("instrument_id", "instrument_type", "security_form", "is_clean_common_stock", "name", "primary_exchange_mic", "currency", "active", "delisted_date", "first_seen_date")
CN_INST = ("instrument_id", "name", "primary_exchange_mic", "active", "delisted_date", "first_seen_date")
ACTION = ("source_action_id", "instrument_id", "symbol_as_stated", "action_type", "ex_date", "declaration_date", "split_to", "cash_amount", "currency", "dividend_type")
CN_ACTION = ("source_action_id", "instrument_id", "symbol_as_stated", "action_type", "ex_date", "declaration_date", "record_date", "pay_date", "cash_amount", "cash_amount_post_tax", "bonus_ratio", "conversion_ratio")
BAR = ("source_id", "instrument_id", "market_date", "symbol_as_traded", "open", "high", "low", "close", "volume", "trade_count")
QUERIES = {
    "s1_envelope": _s1, "s2_ticker_events": ticker_events, "s3_holidays": lambda s, d: holidays(s, d).select("exchange", "name", "date", "status", readers.path_part("snapshot_date").alias("snapshot_date")), "s5_minute_csv": minutes, "s6_frames": _s6, "s7_frame_checks": _s7, "s10_manifests": _s10,
    "d2_exchanges": _exchanges, "d3_trading_days": _days, "d5_instruments": _identity("instruments", *INST), "d8_symbols": _identity("symbols", "symbol_id", "instrument_id", "symbol", "exchange_mic", "valid_from", "valid_to", "evidence"), "d9_identifiers": _identity("identifiers", "identifier_type", "identifier_value", "valid_from", "instrument_id"), "d8_unresolved": _identity("unresolved", *UNRESOLVED),
    "d10_actions": _actions(0, *ACTION), "d10_unresolved": _actions(1, *UNRESOLVED), "d11_bars": _bars(0, *BAR), "d11_unresolved": _bars(1, *UNRESOLVED), "d21_minute_facts": _minute_facts, "k5_quarantine": _quarantine,
    "d13_cn_exchanges": lambda s, d: facts_cn.exchanges(s), "d14_cn_instruments": _cn_identity("instruments", *CN_INST), "d14_cn_symbols": _cn_identity("symbols", "symbol_id", "instrument_id", "symbol", "exchange_mic", "valid_from", "valid_to"), "d14_cn_unresolved": _cn_identity("unresolved", *UNRESOLVED[:5]), "d15_cn_name_changes": _cn_names,
    "d16_cn_days": _cn_days(0, "market_date", "is_open"), "d16_cn_unresolved": _cn_days(1, *UNRESOLVED), "d17_cn_actions": _cn_actions(0, *CN_ACTION), "d17_cn_unresolved": _cn_actions(1, *UNRESOLVED[:5]), "d18_cn_bars": _cn_bars(0, *BAR[:-1]), "d18_cn_unresolved": _cn_bars(1, *UNRESOLVED[:5]),
    "d19_vendor_factors": _cn_factors(0), "d19_invalid": _cn_factors(1), "d20_coverage": _cn_coverage(0), "d20_invalid": _cn_coverage(1), "d48_factor_comparison": _factor_comparison, "j12_cn_gaps": _cn_gaps, "d12_build": _build, "date_math": _date_math, "date_cutoffs": _cutoffs,
}


# -- the same in SQL ---------------------------------------------------------------

_kind = lambda i: "CASE upper(coalesce(type, '')) " + " ".join(f"WHEN '{r[0]}' THEN '{r[i]}'" for r in INSTRUMENT_TYPES) + " ELSE 'unknown_stock_like' END"
IDENTITY = f"""{P.sql("tickers", "events")}, keyed AS (
  SELECT *, nullif(composite_figi, '') AS figi, TRY_CAST(substr(delisted_utc, 1, 10) AS DATE) AS gone, CAST(snap AS DATE) AS seen, coalesce(active, false) AS live, coalesce(last_updated_utc, '') AS upd,
    coalesce(nullif(composite_figi, ''), 'nofigi:' || ticker || ':' || coalesce(CAST(TRY_CAST(substr(delisted_utc, 1, 10) AS DATE) AS VARCHAR), 'active')) AS key
  FROM tickers_rows WHERE ticker IS NOT NULL
), totals AS (SELECT key, bool_or(live) AS any_live, max(gone) AS max_gone, min(seen) AS first_seen FROM keyed GROUP BY key
), inst AS (
  SELECT *, {uuid_sql("instrument", "key")} AS id FROM keyed JOIN totals USING (key)
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY live DESC, upd DESC, seen DESC NULLS LAST, ticker) = 1
), pairs AS (
  SELECT key, ticker, CASE WHEN NOT bool_or(live) THEN coalesce(max(gone), max(TRY_CAST(substr(upd, 1, 10) AS DATE))) END AS valid_to FROM keyed GROUP BY key, ticker
), chained AS (
  SELECT p.ticker, p.valid_to, i.id, nullif(i.primary_exchange, '') AS mic, lag(p.valid_to) OVER w AS valid_from, row_number() OVER w AS place FROM pairs p JOIN inst i USING (key)
  WINDOW w AS (PARTITION BY p.ticker ORDER BY coalesce(p.valid_to, DATE '9999-12-31'), i.id)
), overlay AS (
  SELECT i.id, nullif(i.primary_exchange, '') AS mic, e.symbol, CAST(e.day AS DATE) AS valid_from, lead(CAST(e.day AS DATE)) OVER (PARTITION BY e.figi ORDER BY e.day) AS valid_to
  FROM (SELECT DISTINCT * FROM events_rows) e JOIN inst i ON i.key = e.figi
), ranges AS (
  SELECT id, mic, ticker AS symbol, valid_from, valid_to, CASE WHEN valid_from IS NULL THEN '{{"basis":"reference_snapshot"}}' ELSE '{{"basis":"reference_snapshot_chained"}}' END AS evidence
  FROM chained c WHERE NOT (valid_from IS NULL AND place > 1) AND NOT EXISTS (SELECT 1 FROM overlay o WHERE o.id = c.id AND o.symbol = c.ticker)
  UNION ALL SELECT id, mic, symbol, valid_from, valid_to, '{{"basis":"ticker_events"}}' FROM overlay
)"""


def _resolved(rows: str, day: str, key: str) -> str:
    """``rows`` with the range of their symbol that holds their day, the latest one."""
    return f"""SELECT r.*, g.id AS instrument_id FROM {rows} r LEFT JOIN ranges g ON g.symbol = r.symbol AND (g.valid_from IS NULL OR r.{day} >= g.valid_from) AND (g.valid_to IS NULL OR r.{day} < g.valid_to)
  QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY g.valid_from DESC NULLS LAST) = 1"""


ACTIONS = f"""{IDENTITY}, {P.sql("splits", "dividends")}, stated AS (
  SELECT id AS source_action_id, ticker AS symbol, 'split' AS action_type, CAST(execution_date AS DATE) AS ex_date, NULL::DATE AS declaration_date, split_to, NULL::DOUBLE AS cash_amount, NULL AS currency, NULL AS dividend_type FROM splits_rows
  UNION SELECT id, ticker, 'cash_dividend', CAST(ex_dividend_date AS DATE), CAST(declaration_date AS DATE), NULL, cash_amount, nullif(upper(currency), ''), nullif(dividend_type, '') FROM dividends_rows WHERE id IS NOT NULL
), done AS ({_resolved("stated", "ex_date", "r.action_type, r.source_action_id")})"""
BARS = f"""{IDENTITY}, {P.sql("daily")}, done AS ({_resolved("daily_rows", "day", "r.symbol, r.day")})"""
_CODE_OK = "regexp_full_match({}, '(sh|sz)\\.[0-9]{{6}}')"
_ok = lambda c: f"coalesce({_CODE_OK.format(c)}, false)"
_d = lambda c: f"TRY_CAST(nullif({c}, '') AS DATE)"
_n = lambda c: f"TRY_CAST(nullif({c}, '') AS DOUBLE)"
CN = f"""{P.sql("basics")}, b AS (SELECT *, {_ok("c1")} AS ok, {_d("c3")} AS ipo, {_d("c4")} AS gone, CAST(snap AS DATE) AS seen FROM basics_rows
), reused AS (SELECT c1 FROM b WHERE ok GROUP BY c1 HAVING count(DISTINCT nullif(c3, '')) > 1
), flagged AS (SELECT *, NOT ok OR c5 <> '1' OR (c3 <> '' AND ipo IS NULL) OR (c4 <> '' AND gone IS NULL) AS bad, CASE WHEN c1 LIKE 'sh.%' THEN 'XSHG' ELSE 'XSHE' END AS mic FROM b
), good AS (
  SELECT *, {uuid_sql("instrument", "'cn:' || mic || ':' || substr(c1, 4, 6)")} AS id FROM flagged WHERE NOT bad AND c1 NOT IN (SELECT c1 FROM reused)
  QUALIFY row_number() OVER (PARTITION BY c1 ORDER BY seen DESC NULLS LAST, c2) = 1
), ids AS (SELECT c1 AS code, id, coalesce(ipo, seen) AS valid_from, gone AS valid_to FROM good)"""
_IN = "(i.valid_from IS NULL OR {0} >= i.valid_from) AND (i.valid_to IS NULL OR {0} < i.valid_to)"
PLANS = f"""{CN}, {P.sql("plans")}, plan AS (
  SELECT c1 AS code, {_d("c4")} AS declaration_date, {_d("c6")} AS record_date, c7, {_d("c7")} AS ex_date, {_d("c8")} AS pay_date, {_n("c10")} AS cash, TRY_CAST(nullif(regexp_extract(c11, '[0-9]+(\\.[0-9]+)?'), '') AS DOUBLE) AS post, {_n("c12")} AS bonus, {_n("c14")} AS conv, {_ok("c1")} AS ok,
    (c10 <> '' AND {_n("c10")} IS NULL) OR (c12 <> '' AND {_n("c12")} IS NULL) OR (c14 <> '' AND {_n("c14")} IS NULL) AS wrong, c10, year FROM plans_rows
), usable AS (SELECT * FROM plan WHERE ex_date IS NOT NULL AND ok AND NOT wrong
), parts AS (
  SELECT code, ex_date, declaration_date, record_date, pay_date, 'cash' AS part, 'cash_dividend' AS action_type, cash, post, NULL::DOUBLE AS bonus, NULL::DOUBLE AS conv FROM usable WHERE cash > 0
  UNION ALL SELECT code, ex_date, declaration_date, record_date, pay_date, 'stock', 'stock_dividend', NULL, NULL, coalesce(bonus, 0), coalesce(conv, 0) FROM usable WHERE coalesce(bonus, 0) + coalesce(conv, 0) > 0
), acts AS (SELECT 'baostock:' || p.code || ':' || p.ex_date || ':' || p.part AS source_action_id, p.*, i.id AS instrument_id FROM parts p LEFT JOIN ids i ON i.code = p.code AND {_IN.format("p.ex_date")})"""
FACTORS = f"""{P.sql("factors")}, f AS (
  SELECT c1 AS vendor_code, c2, {_d("c2")} AS event_date, c4, {_n("c4")} AS cumulative_factor,
    CASE WHEN NOT {_ok("c1")} THEN 'invalid_vendor_code' WHEN {_d("c2")} IS NULL THEN 'invalid_event_date' WHEN {_n("c4")} IS NULL THEN 'invalid_cumulative_factor' WHEN {_n("c4")} <= 0 THEN 'nonpositive_cumulative_factor' END AS reason FROM factors_rows
), increments AS (
  SELECT vendor_code, event_date, cumulative_factor, lag(cumulative_factor) OVER w / cumulative_factor AS factor, CASE WHEN lag(cumulative_factor) OVER w IS NULL THEN 'vendor_baseline' ELSE 'comparable' END AS status
  FROM f WHERE reason IS NULL WINDOW w AS (PARTITION BY vendor_code ORDER BY event_date)
)"""
K = f"""{P.sql("k_lines")}, k AS (
  SELECT c2 AS code, c1, {_d("c1")} AS day, {_n("c3")} AS open, {_n("c4")} AS high, {_n("c5")} AS low, {_n("c6")} AS close, {_n("c8")} AS volume, c12 AS status FROM k_lines_rows
), kept AS (SELECT *, coalesce(day IS NOT NULL AND volume > 0 AND low <= least(open, close) AND high >= greatest(open, close), false) AS valid FROM k QUALIFY row_number() OVER (PARTITION BY code, day ORDER BY c1) = 1
)"""
CN_BARS = f"""{CN}, {K}, placed AS (SELECT kept.*, i.id FROM kept LEFT JOIN ids i ON i.code = kept.code AND {_IN.format("kept.day")} WHERE status = '1' AND valid)"""
_r9 = lambda x: f"floor(({x}) * 1e9 + 0.5) / 1e9"
_bad = lambda dataset, scope, symbol, day, reason, sample=None: f"SELECT '{dataset}' AS dataset, '{scope}' AS market_scope, {symbol} AS symbol, {day} AS market_date, '{reason}' AS reason" + (f", {sample} AS sample" if sample else "")
_num = lambda x: f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) || '.0' ELSE CAST({x} AS VARCHAR) END"
ORACLE_SQL = {
    "s1_envelope": f"WITH {P.sql('tickers')} SELECT snap AS snapshot_date, ticker, name, primary_exchange, type, active, currency_name, cik, composite_figi, share_class_figi, delisted_utc, last_updated_utc FROM tickers_rows",
    "s2_ticker_events": f"WITH {P.sql('events')} SELECT DISTINCT figi AS composite_figi, symbol, CAST(day AS DATE) AS event_date FROM events_rows",
    "s3_holidays": f"WITH {P.sql('holidays')} SELECT exchange, name, day AS date, status, snap AS snapshot_date FROM holidays_rows",
    "s5_minute_csv": f"WITH {MARKET_SQL} SELECT market_date, symbol, start AS window_start_utc, open, high, low, close, volume, transactions FROM raw_minutes",
    "s6_frames": f"WITH {P.sql('universe')} SELECT c1, c2, c3, field8, snap AS snapshot_date FROM universe_rows",
    "s7_frame_checks": "SELECT 'whole' AS kind, 'query_stock_basic' AS method, NULL AS problem, true AS found UNION ALL SELECT 'cut', 'query_stock_basic', 'length', true",
    "s10_manifests": """SELECT 'n/region=' || n_regionkey || '/' || n_nationkey || '.json.gz' AS file_path, 'polygon' AS source_id, 'nations' AS dataset, DATE '2025-01-01' + CAST(n_nationkey AS INT) AS market_date, CAST(n_nationkey AS INT) AS row_count,
      sha256('{"name": "' || n_name || '"}') AS content_sha256, 200 AS http_status FROM nation WHERE n_regionkey <> 2""",
    "d2_exchanges": f"""WITH {P.sql("exchanges")} SELECT mic AS exchange_mic, name, type AS exchange_type, locale || '_' || asset_class AS market_scope, locale || '_equities' AS calendar_id, CASE WHEN locale = 'us' THEN 'America/New_York' ELSE 'UTC' END AS timezone, locale AS country, CASE WHEN locale = 'us' THEN 'USD' END AS currency
      FROM exchanges_rows WHERE mic <> '' QUALIFY row_number() OVER (PARTITION BY mic ORDER BY snap DESC, name) = 1""",
    "d3_trading_days": f"""WITH {P.sql("holidays", "fetches")}, past AS (SELECT market_date, max(row_count) > 0 AS is_open FROM fetches_rows GROUP BY 1),
      future AS (SELECT CAST(day AS DATE) AS market_date, NOT bool_or(status = 'closed') AS is_open, bool_or(status = 'early-close') AS is_half_day FROM holidays_rows WHERE snap = (SELECT max(snap) FROM holidays_rows) GROUP BY 1)
      SELECT 'us_equities' AS calendar_id, market_date, is_open, false AS is_half_day FROM past UNION ALL SELECT 'us_equities', market_date, is_open, is_half_day FROM future WHERE market_date NOT IN (SELECT market_date FROM past)""",
    "d5_instruments": f"""WITH {IDENTITY} SELECT id AS instrument_id, {_kind(1)} AS instrument_type, {_kind(2)} AS security_form, coalesce(type, '') = 'CS' AS is_clean_common_stock, coalesce(name, ticker) AS name, nullif(primary_exchange, '') AS primary_exchange_mic, nullif(upper(currency_name), '') AS currency,
      any_live AS active, CASE WHEN NOT any_live THEN max_gone END AS delisted_date, first_seen AS first_seen_date FROM inst""",
    "d8_symbols": f"WITH {IDENTITY} SELECT {uuid_sql('symbol', chr(39) + 'us_stocks:' + chr(39) + ' || symbol || ' + chr(39) + ':' + chr(39) + ' || id || ' + chr(39) + ':' + chr(39) + ' || coalesce(CAST(valid_from AS VARCHAR), ' + chr(39) + 'open' + chr(39) + ')')} AS symbol_id, id AS instrument_id, symbol, mic AS exchange_mic, valid_from, valid_to, evidence FROM ranges",
    "d9_identifiers": f"""WITH {IDENTITY}, v AS (SELECT i.id, x.seen, unnest([{{'t': 'composite_figi', 'v': x.figi}}, {{'t': 'share_class_figi', 'v': nullif(x.share_class_figi, '')}}, {{'t': 'cik', 'v': nullif(x.cik, '')}}]) AS u FROM keyed x JOIN inst i USING (key))
      SELECT u.t AS identifier_type, u.v AS identifier_value, min(seen) AS valid_from, min(id) AS instrument_id FROM v WHERE u.v IS NOT NULL GROUP BY u.t, u.v HAVING count(DISTINCT id) = 1""",
    "d8_unresolved": f"""WITH {IDENTITY} {_bad("reference_tickers", "us_stocks", "ticker", "(SELECT max(seen) FROM keyed)", "ambiguous", "'{' || '\"instrument_id\":\"' || id || '\"}'")} FROM chained WHERE valid_from IS NULL AND place > 1""",
    "d10_actions": f"WITH {ACTIONS} SELECT source_action_id, instrument_id, symbol AS symbol_as_stated, action_type, ex_date, declaration_date, split_to, cash_amount, currency, dividend_type FROM done WHERE instrument_id IS NOT NULL",
    "d10_unresolved": f"""WITH {ACTIONS} SELECT CASE action_type WHEN 'split' THEN 'splits' ELSE 'dividends' END AS dataset, 'us_stocks' AS market_scope, symbol, min(ex_date) AS market_date, 'no_symbol_match' AS reason, '{{"count":' || count(*) || '}}' AS sample FROM done WHERE instrument_id IS NULL GROUP BY action_type, symbol""",
    "d11_bars": f"WITH {BARS} SELECT 'polygon' AS source_id, instrument_id, day AS market_date, symbol AS symbol_as_traded, o AS open, h AS high, l AS low, c AS close, v AS volume, n AS trade_count FROM done WHERE instrument_id IS NOT NULL",
    "d11_unresolved": f"""WITH {BARS} {_bad("grouped_daily", "us_stocks", "symbol", "day", "no_symbol_match", "'{' || '\"close\":' || " + _num("c") + " || '}'")} FROM done WHERE instrument_id IS NULL""",
    "d21_minute_facts": f"WITH {MARKET_SQL} SELECT market_date, symbol, start AS window_start_utc, open, high, low, close, volume, transactions FROM raw_minutes",
    "k5_quarantine": f"WITH {BARS}, x AS (SELECT DISTINCT symbol, day, CASE WHEN symbol < 'Q3' THEN 'known before' ELSE 'no_symbol_match' END AS reason FROM done WHERE instrument_id IS NULL) SELECT 'grouped_daily' AS dataset, reason, count(*) AS entries, min(symbol) AS first, max(symbol) AS last FROM x GROUP BY reason",
    "d13_cn_exchanges": "SELECT mic AS exchange_mic, name, 'exchange' AS exchange_type, 'cn_stocks' AS market_scope, 'cn_equities' AS calendar_id, 'Asia/Shanghai' AS timezone, 'cn' AS country, 'CNY' AS currency FROM (VALUES ('XSHG', 'Shanghai Stock Exchange'), ('XSHE', 'Shenzhen Stock Exchange')) v(mic, name)",
    "d14_cn_instruments": f"WITH {CN} SELECT id AS instrument_id, coalesce(nullif(c2, ''), substr(c1, 4, 6)) AS name, mic AS primary_exchange_mic, c6 = '1' AND gone IS NULL AS active, gone AS delisted_date, ipo AS first_seen_date FROM good",
    "d14_cn_symbols": f"WITH {CN} SELECT {uuid_sql('symbol', chr(39) + 'cn_stocks:' + chr(39) + ' || substr(c1, 4, 6) || ' + chr(39) + ':' + chr(39) + ' || id || ' + chr(39) + ':' + chr(39) + ' || coalesce(CAST(ipo AS VARCHAR), ' + chr(39) + 'open' + chr(39) + ')')} AS symbol_id, id AS instrument_id, substr(c1, 4, 6) AS symbol, mic AS exchange_mic, ipo AS valid_from, gone AS valid_to FROM good",
    "d14_cn_unresolved": f"WITH {CN} {_bad('stock_basic', 'cn_stocks', 'c1', 'max(seen)', 'code_reuse_suspected')} FROM b WHERE c1 IN (SELECT c1 FROM reused) GROUP BY c1 UNION ALL {_bad('stock_basic', 'cn_stocks', 'c1', 'seen', 'bad_row')} FROM flagged WHERE bad",
    "d15_cn_name_changes": f"""WITH {CN}, h AS (SELECT c1, c2, seen, lag(c2) OVER (PARTITION BY c1 ORDER BY seen) AS old FROM b WHERE ok AND c1 NOT IN (SELECT c1 FROM reused))
      SELECT 'baostock:' || c1 || ':' || seen || ':name_change' AS source_event_id, id AS instrument_id, seen AS event_date, 'Name changed to ' || c2 AS title, '{{"old_name":"' || old || '","new_name":"' || c2 || '"}}' AS payload FROM h JOIN ids ON ids.code = c1 WHERE old <> c2""",
    "d16_cn_days": f"""WITH {P.sql("calendar")}, c AS (SELECT {_d("c1")} AS day, c2 FROM calendar_rows WHERE snap = (SELECT max(snap) FROM calendar_rows)) SELECT day AS market_date, c2 = '1' AS is_open FROM c WHERE day IS NOT NULL AND c2 IN ('0', '1')""",
    "d16_cn_unresolved": f"""WITH {P.sql("calendar", "universe")}, c AS (SELECT c1, {_d("c1")} AS day, c2, CAST(snap AS DATE) AS snap FROM calendar_rows WHERE snap = (SELECT max(snap) FROM calendar_rows)), t AS (SELECT CAST(field8 AS DATE) AS day, bool_or(c2 = '1') AS traded FROM universe_rows GROUP BY 1)
      {_bad("trade_cal", "cn_stocks", "'*'", "snap", "bad_row", "'{' || '\"calendar_date\":\"' || c1 || '\",\"flag\":\"' || c2 || '\"}'")} FROM c WHERE day IS NULL OR c2 NOT IN ('0', '1')
      UNION ALL {_bad("universe", "cn_stocks", "'*'", "t.day", "calendar_trade_status_conflict", "'{' || '\"calendar_open\":' || (c2 = '1') || ',\"any_security_traded\":' || traded || '}'")} FROM t JOIN c ON c.day = t.day WHERE c2 IN ('0', '1') AND (c2 = '1') <> traded""",
    "d17_cn_actions": f"WITH {PLANS} SELECT source_action_id, instrument_id, substr(code, 4, 6) AS symbol_as_stated, action_type, ex_date, declaration_date, record_date, pay_date, cash AS cash_amount, post AS cash_amount_post_tax, bonus AS bonus_ratio, conv AS conversion_ratio FROM acts WHERE instrument_id IS NOT NULL",
    "d17_cn_unresolved": f"WITH {PLANS} {_bad('dividend', 'cn_stocks', 'code', chr(99) + 'oalesce(ex_date, CAST(year || ' + chr(39) + '-01-01' + chr(39) + ' AS DATE))', 'bad_row')} FROM plan WHERE c7 <> '' AND (NOT ok OR ex_date IS NULL OR wrong) UNION ALL {_bad('dividend', 'cn_stocks', 'code', 'ex_date', 'no_symbol_match')} FROM acts WHERE instrument_id IS NULL",
    "d18_cn_bars": f"WITH {CN_BARS} SELECT 'baostock' AS source_id, id AS instrument_id, day AS market_date, substr(code, 4, 6) AS symbol_as_traded, open, high, low, close, volume FROM placed WHERE id IS NOT NULL",
    "d18_cn_unresolved": f"WITH {CN_BARS} {_bad('daily_k', 'cn_stocks', 'code', 'coalesce(day, DATE ' + chr(39) + '2019-01-01' + chr(39) + ')', 'bad_row')} FROM kept WHERE status <> '0' AND NOT (status = '1' AND valid) UNION ALL {_bad('daily_k', 'cn_stocks', 'code', 'day', 'no_symbol_match')} FROM placed WHERE id IS NULL",
    "d19_vendor_factors": f"WITH {FACTORS} SELECT vendor_code, event_date, {_r9('cumulative_factor')} AS cumulative_factor, {_r9('factor')} AS factor, status FROM increments",
    "d19_invalid": f"WITH {FACTORS} SELECT vendor_code, c2 AS event_date_text, c4 AS cumulative_factor_text, reason FROM f WHERE reason IS NOT NULL",
    "d20_coverage": f"WITH {K} SELECT code AS vendor_code, day AS market_date, status = '1' AS is_traded, status = '0' AS is_suspended FROM k WHERE {_ok('code')} AND day IS NOT NULL AND status IN ('0', '1') AND NOT (status = '1' AND coalesce(volume, 0) <= 0)",
    "d20_invalid": f"WITH {K} SELECT code AS vendor_code, c1 AS market_date_text, CASE WHEN NOT {_ok('code')} THEN 'invalid_vendor_code' WHEN day IS NULL THEN 'invalid_market_date' WHEN status NOT IN ('0', '1') THEN 'invalid_trade_status' ELSE 'traded_without_volume' END AS reason FROM k WHERE NOT ({_ok('code')} AND day IS NOT NULL AND status IN ('0', '1') AND NOT (status = '1' AND coalesce(volume, 0) <= 0))",
    "d48_factor_comparison": f"""WITH {PLANS}, {FACTORS}, ours AS (
        SELECT instrument_id, ex_date AS event_date, product(CASE WHEN action_type = 'stock_dividend' THEN 1 / (1 + bonus + conv) ELSE 1 - cash / 10 END) AS lf, bool_or(action_type = 'cash_dividend') AS has_cash, bool_or(action_type = 'stock_dividend') AS has_stock FROM acts WHERE instrument_id IS NOT NULL GROUP BY 1, 2
      ), mine AS (SELECT o.*, i.code FROM ours o LEFT JOIN ids i ON i.id = o.instrument_id AND {_IN.format("o.event_date")}), theirs AS (SELECT v.*, i.id AS vi FROM increments v LEFT JOIN ids i ON i.code = v.vendor_code AND {_IN.format("v.event_date")})
      SELECT coalesce(t.vendor_code, m.code, '(unresolved)') AS vendor_code, coalesce(t.event_date, m.event_date) AS event_date,
        CASE WHEN t.vendor_code IS NULL THEN 'no_vendor_event' WHEN vi IS NULL THEN 'vendor_code_unresolved' WHEN status = 'vendor_baseline' THEN 'vendor_baseline' WHEN m.instrument_id IS NULL THEN 'no_local_factor' ELSE 'comparable' END AS comparison_class,
        CASE WHEN has_cash AND has_stock THEN 'cash_plus_stock' WHEN has_stock THEN 'stock_only' WHEN has_cash THEN 'cash_only' ELSE 'no_local_factor' END AS action_segment, {_r9("factor")} AS vendor_price_factor, {_r9("lf")} AS local_price_factor, {_r9("lf - factor")} AS signed_residual
      FROM theirs t FULL JOIN mine m ON m.instrument_id = t.vi AND m.event_date = t.event_date""",
    "j12_cn_gaps": f"""WITH {CN}, {K}, win AS (SELECT DISTINCT code, CAST(date_trunc('quarter', day) AS DATE) AS a FROM k WHERE day IS NOT NULL), grid AS (SELECT code, CAST(unnest(generate_series(DATE '2019-01-01', DATE '2020-12-31', INTERVAL 1 DAY)) AS DATE) AS day FROM ids)
      SELECT code AS vendor_code, count(*) AS missing_dates, min(day) AS first_missing, max(day) AS last_missing FROM grid g WHERE NOT EXISTS (SELECT 1 FROM win w WHERE w.code = g.code AND g.day BETWEEN w.a AND w.a + 60) GROUP BY code""",
    "date_math": """SELECT DISTINCT d AS day, CASE WHEN month(d) = 2 AND day(d) = 29 THEN make_date(year(d) + 1, 3, 1) ELSE make_date(year(d) + 1, month(d), day(d)) END AS plus_1, CASE WHEN month(d) = 2 AND day(d) = 29 AND NOT (year(d) + 4) % 4 = 0 THEN make_date(year(d) + 4, 3, 1) ELSE make_date(year(d) + 4, month(d), day(d)) END AS plus_4,
      CAST(len(list_filter(generate_series(0, 10), lambda i: isodow(d + CAST(i AS INT)) < 6)) AS INT) AS weekdays FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)""",
    "date_cutoffs": """WITH e AS (SELECT DISTINCT unnest([CAST(ts AS TIMESTAMP), CAST(ts AS TIMESTAMP) + INTERVAL 120 DAY]) AS t FROM events), z AS (SELECT timezone('America/New_York', timezone('UTC', t)) AS ny, timezone('Asia/Shanghai', timezone('UTC', t)) AS sh FROM e)
      SELECT CAST(ny AS DATE) - 1 AS completed, CAST(ny AS DATE) - CASE WHEN hour(ny) >= 6 THEN 1 ELSE 2 END AS published, CAST(sh AS DATE) - 1 AS completed_cn, count(*) AS n, CAST(sum(hour(ny) * 60 + minute(ny)) AS BIGINT) AS minutes FROM z GROUP BY 1, 2, 3""",
}

#: All facts of both scopes, counted; a row that could not be resolved counts once for each key.
_parts = {
    "exchanges": ["d2_exchanges", "d13_cn_exchanges"], "instruments": ["d5_instruments", "d14_cn_instruments"], "symbols": ["d8_symbols", "d14_cn_symbols"], "instrument_events": ["d15_cn_name_changes"], "corporate_actions": ["d10_actions", "d17_cn_actions"], "bars_daily": ["d11_bars", "d18_cn_bars"],
}
_count = lambda item, names: f"SELECT '{item}' AS item, " + " + ".join(f"(SELECT count(*) FROM ({ORACLE_SQL[n]}))" for n in names) + " AS n"
_lost = " UNION ALL ".join(f"SELECT dataset, market_scope, symbol, market_date FROM ({ORACLE_SQL[n]})" for n in ("d8_unresolved", "d10_unresolved", "d11_unresolved", "d14_cn_unresolved", "d16_cn_unresolved", "d17_cn_unresolved", "d18_cn_unresolved"))
_landed = "SELECT DATE '2025-01-01' + CAST(n_nationkey AS INT) AS market_date FROM nation"
_future = f"WITH {P.sql('holidays')} SELECT DISTINCT CAST(day AS DATE) AS market_date FROM holidays_rows WHERE snap = (SELECT max(snap) FROM holidays_rows)"
ORACLE_SQL["d12_build"] = " UNION ALL ".join(
    [
        *(_count(k, v) for k, v in _parts.items()),
        f"SELECT 'instrument_identifiers', (SELECT count(*) FROM ({ORACLE_SQL['d9_identifiers']})) + (SELECT count(*) FROM ({ORACLE_SQL['d14_cn_instruments']}))",
        f"SELECT 'trading_days', (SELECT count(*) FROM ({_landed})) + (SELECT count(*) FROM ({_future}) WHERE market_date NOT IN ({_landed})) + (SELECT count(*) FROM ({ORACLE_SQL['d16_cn_days']}))",
        f"SELECT 'unresolved', count(*) FROM (SELECT DISTINCT * FROM ({_lost}))",
    ]
)
