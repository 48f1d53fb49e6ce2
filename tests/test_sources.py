import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from basalt.functions import dates, text
from basalt.operators import cache, facts, facts_cn
from basalt.sources import frames, raw_zone, readers, schemas

D = dt.date


def put(path, obj):
    path.parent.mkdir(parents=True, exist_ok=True)
    data = obj if isinstance(obj, bytes) else json.dumps(obj).encode()
    path.write_bytes(gzip.compress(data) if path.suffix == ".gz" else data)


def frame(method, fields, rows, at, code="0", field8=""):
    body = [""] * 12
    body[0], body[1], body[2], body[4], body[5], body[6] = code, "success", method, "1", "100", json.dumps({"record": rows})
    body[7], body[at] = field8, ",".join(fields)
    text_ = "\x01".join(body)
    return f"00.9.10\x0112\x01{len(text_):010d}".encode() + text_.encode() + b"\n"


def test_frame_parser():
    good = frame("query_trade_dates", ["calendar_date", "is_trading_day"], [["2025-01-02", "1"]], 9)
    f = frames.parse_frame(good)
    assert f.records == ({"calendar_date": "2025-01-02", "is_trading_day": "1"},) and f.method == "query_trade_dates"
    for bad in (b"short", good[:-5] + b"x\n", good.replace(b"query_trade_dates", b"query_other_thing")):
        with pytest.raises(ValueError):
            frames.parse_frame(bad)
    with pytest.raises(frames.FrameError):
        frames.parse_frame(frame("query_trade_dates", ["a"], [["1", "2"]], 9))


def test_us_identity_and_bars(spark, tmp_path):
    tick = lambda t, figi, active, **k: {"ticker": t, "name": t, "type": "CS", "composite_figi": figi, "active": active, "primary_exchange": "XNYS", "currency_name": "usd", "cik": "1"} | k
    root = tmp_path / "raw"
    put(root / "tickers/snapshot_date=2025-01-10/a.json.gz", {"results": [
        tick("META", "F1", True), tick("FB", "F1", False, last_updated_utc="2022-06-09T00:00:00Z"), tick("FB", "F2", True, type="ETF", cik="2"), tick("ACMpA", "F3", True, cik=None), tick("ACMPA", "", True, cik=""), tick("DUP", "F4", True, cik="9"), tick("DUP", "F5", True, cik="9")]})
    put(root / "events/F1.json.gz", {"results": {"composite_figi": "F1", "events": [{"ticker_change": {"ticker": "FB"}, "type": "x", "date": "2012-05-18"}, {"ticker_change": {"ticker": "META"}, "type": "x", "date": "2022-06-09"}]}})
    i = facts.identity(readers.envelope(spark, f"{root}/tickers/*/*.json.gz", schemas.TICKERS), readers.ticker_events(spark, f"{root}/events/*.json.gz"))
    sym = {(r.symbol, r.valid_from, r.valid_to) for r in i.symbols.collect()}
    assert ("FB", D(2012, 5, 18), D(2022, 6, 9)) in sym and ("META", D(2022, 6, 9), None) in sym and ("FB", D(2022, 6, 9), None) in sym
    assert {s[0] for s in sym} >= {"ACMpA", "ACMPA"} and i.instruments.count() == 6
    assert [(r.symbol, r.reason) for r in i.unresolved.collect()] == [("DUP", "ambiguous")]
    ids = {(r.identifier_type, r.identifier_value) for r in i.identifiers.collect()}
    assert ("cik", "1") in ids and ("cik", "9") not in ids  # company-level ids of several instruments are left out
    assert i.symbols.select("symbol_id").distinct().count() == i.symbols.count()
    put(root / "daily/date=2022-06-08/p.json.gz", {"results": [{"T": "FB", "o": 1, "h": 2, "l": 1, "c": 2, "v": 5}, {"T": "MYST", "c": 3}]})
    put(root / "daily/date=2022-06-10/p.json.gz", {"results": [{"T": "FB", "o": 9, "h": 9, "l": 9, "c": 9, "v": 5}]})
    put(root / "daily/date=2022-06-11/p.json.gz", {"status": "closed"})
    good, bad = facts.bars_daily(readers.envelope(spark, f"{root}/daily/*/*.json.gz", schemas.GROUPED_DAILY), i.symbols)
    kinds = {r.instrument_id: r.instrument_type for r in i.instruments.collect()}
    assert {(r.market_date.day, kinds[r.instrument_id]) for r in good.collect()} == {(8, "common_stock"), (10, "etf")}
    assert [(r.symbol, r.sample) for r in bad.collect()] == [("MYST", '{"close":3.0}')]
    put(root / "splits/a.json.gz", {"results": [{"id": "s1", "ticker": "META", "execution_date": "2023-01-03", "split_from": 1, "split_to": 2}, {"id": "s2", "ticker": "NONE", "execution_date": "2023-01-03", "split_from": 1, "split_to": 2}]})
    acts, lost = facts.corporate_actions(readers.envelope(spark, f"{root}/splits/*.json.gz", schemas.SPLITS), readers.envelope(spark, f"{root}/nothing/*.json.gz", schemas.DIVIDENDS), i.symbols)
    assert [r.source_action_id for r in acts.collect()] == ["s1"] and [(r.symbol, r.sample) for r in lost.collect()] == [("NONE", '{"count":1}')]


def test_minutes_round_trip(spark, tmp_path):
    rows = b"ticker,volume,open,close,high,low,window_start,transactions\nAAA,10,1,2,3,0.5,1735828200000000000,4\nMYST,1,1,1,1,1,1735828260000000000,1\n"
    put(tmp_path / "raw/date=2025-01-02/m.csv.gz", rows)
    parsed = readers.minute_csv(spark, f"{tmp_path}/raw/*/*.csv.gz")
    assert raw_zone.write_minutes(parsed, f"{tmp_path}/min") == 2 and raw_zone.write_minutes(parsed, f"{tmp_path}/min") == 2
    again = parsed.withColumn("close", F.lit(9.0))
    assert raw_zone.write_minutes(again, f"{tmp_path}/min", force=False) == 0  # the date is there
    assert raw_zone.write_minutes(again.withColumn("market_date", F.lit(D(2025, 1, 3))), f"{tmp_path}/min", force=False) == 2
    assert raw_zone.write_minutes(parsed.limit(0), f"{tmp_path}/min") == 0 and readers.minutes(spark, f"{tmp_path}/min").count() == 4
    assert {p.name for p in (tmp_path / "min").iterdir()} == {"market_date=2025-01-02", "market_date=2025-01-03"}
    back = readers.minutes(spark, f"{tmp_path}/min").filter("market_date = date'2025-01-02'")
    assert back.count() == 2 and back.filter("market_date = date'2025-01-02'").count() == 2
    sym = spark.createDataFrame([("us_stocks", "AAA", "I", None, None)], "market_scope string, symbol string, instrument_id string, valid_from date, valid_to date")
    b = facts.bars_minute(back, sym)
    assert [(r.instrument_id, r.close) for r in b.collect()] == [("I", 2.0)]
    assert [(r.symbol, r.minute_bars) for r in facts.unresolved_minutes(back, b).collect()] == [("MYST", 1)]
    assert readers.minutes(spark, f"{tmp_path}/none").count() == 0


def test_minutes_stay_as_they_were_when_rows_are_lost(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameReader

    one = spark.createDataFrame([(D(2025, 1, 2), "A", dt.datetime(2025, 1, 2, 15), 1.0, 1.0, 1.0, 1.0, 1.0, 1)], schemas.MINUTES)
    raw_zone.write_minutes(one, f"{tmp_path}/min")
    read = DataFrameReader.parquet
    with monkeypatch.context() as m:
        m.setattr(DataFrameReader, "parquet", lambda self, path: read(self, path).limit(1))
        with pytest.raises(ValueError, match="1 rows were written, not 2"):
            raw_zone.write_minutes(one.withColumn("close", F.lit(5.0)).union(one), f"{tmp_path}/min")
    assert [r.close for r in readers.minutes(spark, f"{tmp_path}/min").collect()] == [1.0]
    assert not list((tmp_path / "min").glob("_staged*"))


def test_catalog(spark):
    spark.range(1).createOrReplaceTempView("my_view")
    spark.sql("create or replace temporary function my_fn(x int) returns int return x + 1")
    assert {("view", "my_view"), ("function", "my_fn")} <= {tuple(r) for r in readers.catalog(spark).collect()}
    assert readers.catalog(spark).filter("name = 'abs'").count() == 0


def test_calendar(spark, tmp_path):
    put(tmp_path / "h/snapshot_date=2025-01-01/upcoming.json.gz", [{"exchange": "NYSE", "name": "x", "date": "2025-07-03", "status": "early-close", "open": "2025-07-03T13:30:00Z", "close": "2025-07-03T17:00:00Z"}, {"exchange": "NYSE", "date": "2025-07-04", "status": "closed"}, {"exchange": "NYSE", "date": "2025-01-02", "status": "closed"}])
    fetches = spark.createDataFrame([("polygon", "grouped_daily", D(2025, 1, 2), 5), ("polygon", "grouped_daily", D(2025, 1, 1), 0)], "source_id string, dataset string, market_date date, row_count int")
    got = {(r.market_date, r.is_open, r.is_half_day) for r in facts.trading_days(fetches, readers.holidays(spark, f"{tmp_path}/h/*/*.json.gz")).collect()}
    assert got == {(D(2025, 1, 2), True, False), (D(2025, 1, 1), False, False), (D(2025, 7, 3), True, True), (D(2025, 7, 4), False, False)}


def test_cn_facts(spark, tmp_path):
    basic = [["sh.600000", "OLD", "1999-11-10", "", "1", "1"], ["sz.000001", "B", "1991-04-03", "2024-01-05", "1", "0"], ["xx.1", "BAD", "", "", "1", "1"], ["sh.600001", "R1", "1999-01-01", "", "1", "1"], ["sh.600001", "R2", "2001-01-01", "", "1", "1"]]
    put(tmp_path / "basic/snapshot_date=2024-01-01/code=a/x.frame", frame("query_stock_basic", list("abcdef"), basic, 9))
    put(tmp_path / "basic/snapshot_date=2024-02-01/code=a/x.frame", frame("query_stock_basic", list("abcdef"), [["sh.600000", "NEW", "1999-11-10", "", "1", "1"]], 9))
    raw = readers.frame_records(spark, f"{tmp_path}/basic/*/*/*.frame", 6)
    i = facts_cn.identity(raw)
    assert {(r.name, r.active) for r in i.instruments.collect()} == {("NEW", True), ("B", False)}
    assert {(r.symbol, r.reason) for r in raw_zone.quarantine(i.unresolved).collect()} == {("xx.1", "bad_row"), ("sh.600001", "code_reuse_suspected")}
    assert [r.title for r in facts_cn.name_changes(raw, i.identifiers).collect()] == ["Name changed to NEW"]
    k = lambda d, code, o, h, lo, c, v, s="1": [d, code, o, h, lo, c, "", v, "", "", "", s, "", "0"]
    rows = [k("2024-01-02", "sh.600000", "10", "11", "9", "10.5", "100"), k("2024-01-03", "sh.600000", "10", "9", "9", "10", "100"), k("2024-01-04", "sh.600000", "", "", "", "", "0", "0"), k("2024-01-08", "sz.000001", "1", "1", "1", "1", "5")]
    put(tmp_path / "k/code=a/window=2024-01-01_2024-01-31/x.frame", frame("query_history_k_data_plus", list("abcdefghijklmn"), rows, 8))
    bars, bad = facts_cn.bars_daily(readers.frame_records(spark, f"{tmp_path}/k/*/*/*.frame", 14), i.identifiers)
    assert [(r.symbol_as_traded, r.close) for r in bars.collect()] == [("600000", 10.5)]
    assert {(r.symbol, r.reason) for r in bad.collect()} == {("sh.600000", "bad_row"), ("sz.000001", "no_symbol_match")}
    div = ["sh.600000", "", "", "2024-05-01", "", "2024-06-01", "2024-06-02", "2024-06-05", "", "0.5", "0.45-0.5", "0.1", "", "0.2"]
    put(tmp_path / "d/code=a/year=2024/x.frame", frame("query_dividend_data", list("abcdefghijklmn"), [div], 10))
    acts, _ = facts_cn.corporate_actions(readers.frame_records(spark, f"{tmp_path}/d/*/*/*.frame", 14), i.identifiers)
    assert {(r.action_type, r.cash_amount, r.cash_amount_post_tax, r.bonus_ratio, r.conversion_ratio) for r in acts.collect()} == {("cash_dividend", 0.5, 0.45, None, None), ("stock_dividend", None, None, 0.1, 0.2)}
    put(tmp_path / "c/snapshot_date=2024-01-09/x.frame", frame("query_trade_dates", ["a", "b"], [["2024-01-02", "1"], ["2024-01-03", "0"], ["bad", "1"]], 9))
    put(tmp_path / "u/snapshot_date=2024-01-09/x.frame", frame("query_all_stock", ["a", "b", "c"], [["sh.600000", "1", "N"]], 8, field8="2024-01-03"))
    days, odd = facts_cn.trading_days(readers.frame_records(spark, f"{tmp_path}/c/*/*.frame", 2), spark.createDataFrame([("sh.600000", "1", "2024-01-03", "snapshot_date=2024-01-09")], "c1 string, c2 string, field8 string, file string"))
    assert {(r.market_date.day, r.is_open) for r in days.collect()} == {(2, True), (3, False)}
    assert {r.reason for r in odd.collect()} == {"bad_row", "calendar_trade_status_conflict"}
    fac = spark.createDataFrame([("sh.600000", "2024-01-02", "", "2", "f"), ("sh.600000", "2024-06-02", "", "4", "f"), ("sh.600000", "x", "", "4", "f"), ("sh.600000", "2024-07-02", "", "-1", "f")], "c1 string, c2 string, c3 string, c4 string, file string")
    ev, inv = facts_cn.vendor_factors(fac)
    assert {(r.status, r.factor) for r in ev.collect()} == {("vendor_baseline", None), ("comparable", 0.5)} and inv.count() == 2


def test_raw_zone(spark, tmp_path):
    root = str(tmp_path / "raw")
    a = raw_zone.land(spark, root, "x/date=2025-01-02/p.json", b"{}", source_id="polygon", dataset="grouped_daily", market_date="2025-01-02", row_count=0)
    raw_zone.land(spark, root, "y/q.json", b"{}", source_id="s", dataset="d")
    index = readers.manifests(spark, root)
    assert {(r.file_path, r.row_count) for r in index.collect()} == {(a["file_path"], 0), ("y/q.json.gz", None)}
    assert raw_zone.clear(spark, root, "x/") == 1 and readers.manifests(spark, root).count() == 1
    g = str(tmp_path / "facts")
    one = raw_zone.write_generation({"t": spark.range(3)}, g)
    two = raw_zone.write_generation({"t": spark.range(5)}, g)
    assert one != two and raw_zone.read_generation(spark, g, "t").count() == 5
    raw_zone.drop_generations(spark, g, 1)
    assert raw_zone.read_generation(spark, g, "t").count() == 5


def test_upsert_and_quarantine(spark):
    u = "dataset string, market_scope string, symbol string, market_date date, reason string, sample string"
    a = spark.createDataFrame([("d", "s", "A", D(2025, 1, 1), "x", "1")], u)
    b = spark.createDataFrame([("d", "s", "A", D(2025, 1, 1), "y", "2"), ("d", "s", "B", D(2025, 1, 1), "y", "2"), ("d", "s", "B", D(2025, 1, 1), "x", "3")], u)
    assert {(r.symbol, r.reason) for r in raw_zone.quarantine(b, existing=a).collect()} == {("A", "x"), ("B", "x")}
    k = spark.createDataFrame([("p", 1), ("q", 1)], "k string, v int")
    assert {tuple(r) for r in raw_zone.upsert(k, spark.createDataFrame([("q", 2)], "k string, v int"), ["k"]).collect()} == {("p", 1), ("q", 2)}


def test_cache_freshness(spark, tmp_path):
    from tests.markets import flat, market

    m = market(spark, bars=[flat("A", D(2025, 1, 2), "A", 8, 1)], instruments=[("A", "us_stocks", "USD", None)])
    root = str(tmp_path)
    assert cache.refresh(m, root) and not cache.refresh(m, root)
    mark = cache.watermark(m)
    assert cache.read(spark, root, "split", mark).exceptAll(m.adjusted("split")).isEmpty()
    assert not cache.is_fresh(spark, root, cache.watermark(m, "other")) and cache.refresh(m, root, "other")
    old = cache.read(spark, root, "split", cache.watermark(m, "other"))
    assert cache.refresh(m, root, "other", force=True) and old.count() == 1  # readers of the one before are not disturbed
    assert cache.refresh(m, root, "third") and len(list(tmp_path.glob("split-*"))) == 2


def test_text_and_dates():
    assert text.read_only_sql(" select 1 ; ") == "select 1"
    for bad in ("", "select 1; select 2", "delete from x", "with a as (select 1) insert into b select * from a", "select 'drop' "):
        with pytest.raises(ValueError):
            text.read_only_sql(bad)
    assert text.format_table([{"a": 1234, "b": "x"}, {"a": None, "c": True}]) == "a      b  c\n1,234  x\n          true"
    assert dates.add_years(D(2024, 2, 29), 1) == D(2025, 3, 1) and len(dates.weekdays_between(D(2025, 1, 3), D(2025, 1, 6))) == 2
    now = dt.datetime(2025, 1, 3, 9, 0, tzinfo=dt.UTC)
    assert dates.latest_completed_trading_date(now) == D(2025, 1, 2) and dates.latest_published_minute_date(now) == D(2025, 1, 1) and dates.latest_completed_cn_trading_date(now) == D(2025, 1, 2)
    assert text.session_minute("09:31") == 571
    with pytest.raises(ValueError):
        text.session_minute("9:31")


def test_cn_windows_and_coverage(spark):
    p = lambda code, a, b, n: ("baostock", "daily_k", json.dumps({"code": code, "start_date": a, "end_date": b, "frame_count": n}))
    rows = [p("sh.600000", "2024-01-01", "2024-01-31", 2)] * 2 + [p("sh.600000", "2024-02-01", "2024-02-28", 2), p("sh.600000", "2024-03-01", "2024-02-01", 1), p(None, "x", "y", None)]
    good, bad = facts_cn.raw_windows(spark.createDataFrame(rows, "source_id string, dataset string, request_params string"))
    assert [(r.window_start, r.window_end) for r in good.collect()] == [(D(2024, 1, 1), D(2024, 1, 31))]
    assert {r.reason for r in bad.collect()} == {"incomplete_raw_window", "invalid_raw_window", "missing_frame_count"}
    k = lambda code, d, v, s: [d, code, *[""] * 5, v, *[""] * 3, s, "f"]
    names = ", ".join(f"c{i} string" for i in range(1, 13)) + ", file string"
    raw = spark.createDataFrame([k("sh.600000", "2024-01-02", "5", "1"), k("sh.600000", "2024-01-03", "0", "0"), k("sh.600000", "2024-01-04", "0", "1"), k("zz", "2024-01-04", "0", "1"), k("sh.600000", "x", "1", "1"), k("sh.600000", "2024-01-05", "1", "9")], names)
    cov, inv = facts_cn.daily_coverage(raw)
    assert {(r.market_date.day, r.is_traded, r.is_suspended) for r in cov.collect()} == {(2, True, False), (3, False, True)}
    assert {r.reason for r in inv.collect()} == {"traded_without_volume", "invalid_vendor_code", "invalid_market_date", "invalid_trade_status"}
    from basalt.operators import verify

    ids = spark.createDataFrame([("baostock_code", "sh.600000", "I")], "identifier_type string, identifier_value string, instrument_id string")
    gaps = verify.cn_gaps(ids, good, D(2024, 1, 30), D(2024, 2, 2)).first()
    assert (gaps.missing_dates, gaps.first_missing, gaps.last_missing) == (2, D(2024, 2, 1), D(2024, 2, 2))
    sym = spark.createDataFrame([("I", "cn_stocks", None, None)], "instrument_id string, market_scope string, valid_from date, valid_to date")
    cal = spark.createDataFrame([("cn_equities", D(2024, 1, d), True) for d in (2, 3, 8)], "calendar_id string, market_date date, is_open boolean")
    lost = verify.cn_missing_rows(ids, sym, cal, cov, D(2024, 1, 1), D(2024, 1, 31)).first()
    assert (lost.missing_dates, lost.first_missing) == (1, D(2024, 1, 8))


def test_factor_comparison(spark):
    from basalt.operators import verify

    local = spark.createDataFrame([("I", D(2024, 6, 2), "cash_dividend", 0.5), ("I", D(2024, 7, 2), "stock_dividend", 0.9)], "instrument_id string, event_date date, action_type string, price_factor double")
    vendor = spark.createDataFrame([("sh.600000", D(2024, 1, 2), 2.0, None, "vendor_baseline"), ("sh.600000", D(2024, 6, 2), 4.0, 0.51, "comparable"), ("sz.000001", D(2024, 6, 2), 4.0, 0.5, "comparable")], "vendor_code string, event_date date, cumulative_factor double, factor double, status string")
    ids = spark.createDataFrame([("baostock_code", "sh.600000", "I", D(1999, 1, 1), None)], "identifier_type string, identifier_value string, instrument_id string, valid_from date, valid_to date")
    rows = verify.factor_comparison(local, vendor, ids)
    assert {(r.comparison_class, r.action_segment) for r in rows.collect()} == {("vendor_baseline", "no_local_factor"), ("comparable", "cash_only"), ("vendor_code_unresolved", "no_local_factor"), ("no_vendor_event", "stock_only")}
    s = verify.factor_segments(rows).first()
    assert s.events == 1 and s.max_absolute_residual == pytest.approx(0.01)


def test_build_writes_a_generation_even_from_nothing(spark, tmp_path):
    from basalt.plans import build

    root = tmp_path / "raw"
    put(root / "polygon/exchanges/snapshot_date=2025-01-01/exchanges.json.gz", {"results": [{"mic": "XNYS", "name": "NYSE", "type": "exchange", "asset_class": "stocks", "locale": "us"}]})
    g = str(tmp_path / "facts")
    build.build(spark, str(root), g)
    assert {r.exchange_mic for r in raw_zone.read_generation(spark, g, "exchanges").collect()} == {"XNYS", "XSHG", "XSHE"}
    assert raw_zone.read_generation(spark, g, "bars_daily").count() == 0


def test_streaming_minute_bars(spark, tmp_path):
    from basalt.streaming.bars import minute_bars

    ts = lambda m, s: dt.datetime(2025, 1, 2, 9, m, s)
    trades = spark.createDataFrame([("A", ts(30, 1), 5.0, 1.0, 1), ("A", ts(30, 50), 7.0, 2.0, 2), ("A", ts(31, 5), 6.0, 1.0, 3)], "symbol string, ts timestamp, price double, size double, trade_id long")
    trades.write.parquet(f"{tmp_path}/in")
    stream = minute_bars(spark.readStream.schema(trades.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("bars_out").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.window_start_utc.minute, r.open, r.high, r.close, r.volume, r.transactions) for r in spark.sql("select * from bars_out").collect()}
    assert got == {(30, 5.0, 7.0, 7.0, 3.0, 2), (31, 6.0, 6.0, 6.0, 1.0, 1)}
