import datetime as dt
import math

import duckdb
import pytest

from basalt.operators import context, forward, metrics, rank, session, verify
from basalt.plans.catalog import DAILY, SESSION
from basalt.plans.queries import T
from basalt.plans.registry import ORACLE_SQL, QUERIES
from tests.markets import flat, market

D = dt.date


def weekdays(n, start=D(2024, 1, 1)):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(days=1)
    return out


DAYS = weekdays(270)


@pytest.fixture(scope="module")
def m(spark):
    """One instrument with a split, a dividend and two missing days, and the baseline it is built on."""
    base, stock = [100.0], [50.0]
    for i in range(1, 270):
        b = 0.01 * math.sin(2 * math.pi * i / 63)
        base.append(base[-1] * math.exp(b))
        stock.append(stock[-1] * math.exp(1.5 * b + 0.002 * math.cos(4 * math.pi * i / 63)))
    bars = [("SPYID", d, "SPY", c * 0.999, c * 1.01, c * 0.99, c, 1e6) for d, c in zip(DAYS, base, strict=True)]
    bars += [("ST", d, "ST", c * k * 0.998, c * k * 1.02, c * k * 0.97, c * k, 1000.0 + i) for i, (d, c) in enumerate(zip(DAYS, stock, strict=True)) for k in [2.0 if i < 100 else 1.0]]
    bars += [flat("THIN", d, "THIN", 5 + i, 10) for i, d in enumerate(DAYS[:30])]
    return market(
        spark, bars=bars, instruments=[("SPYID", "us_stocks", "USD", None), ("ST", "us_stocks", "USD", None), ("THIN", "us_stocks", "USD", DAYS[40])],
        symbols=[("SPYID", "us_stocks", "SPY", None, None), ("ST", "us_stocks", "ST", None, None), ("THIN", "us_stocks", "THIN", None, DAYS[40])], days=[("US", d) for d in DAYS],
        actions=[("s", "ST", "split", DAYS[100], {"split_from": 1.0, "split_to": 2.0}), ("d", "ST", "cash_dividend", DAYS[200], {"cash_amount": 1.0, "currency": "USD"}), ("f", "ST", "cash_dividend", DAYS[264], {"cash_amount": 1.0, "declaration_date": DAYS[255]}), ("g", "ST", "cash_dividend", DAYS[261], {"cash_amount": 1.0, "declaration_date": DAYS[260]})],
    )


def values(df, i):
    return {r.id: (r.text if r.text is not None else r.value, r.reason) for r in df.filter(f"instrument_id = '{i}'").collect()}


def test_catalog_sizes():
    assert (len(DAILY), len(SESSION)) == (61, 17)


def test_metrics_against_plain_arithmetic(m):
    t = DAYS[259]
    v = values(metrics.metrics_at(m, t, context=context.context_at(m, t)), "ST")
    assert len(v) == 61
    rows = m.adjusted("split_dividend", t, ["ST"]).orderBy("market_date").collect()
    c = [r.close for r in rows][::-1]
    lr = [math.log(c[i] / c[i + 1]) for i in range(252 + 1)]
    std = lambda x: math.sqrt(sum((y - sum(x) / len(x)) ** 2 for y in x) / (len(x) - 1))
    assert v["ret_21d"][0] == pytest.approx(c[0] / c[21] - 1)
    assert v["vol_63d"][0] == pytest.approx(std(lr[:63]) * math.sqrt(252))
    assert v["sma50_vs_sma200"][0] == pytest.approx(sum(c[:50]) / 50 / (sum(c[:200]) / 200) - 1)
    assert v["days_since_split"][0] == 159 and v["days_since_dividend"][0] == 59
    assert v["declared_ex_days"][0] == 5  # the unknown one at 261 is not seen
    x = lr[1:253]
    n, mu = 252, sum(lr[1:253]) / 252
    m2, m4 = sum((y - mu) ** 2 for y in x) / n, sum((y - mu) ** 4 for y in x) / n
    g2 = m4 / m2**2 - 3
    assert v["ret_kurt_252d"][0] == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    assert v["ret_pctile_252d"][0] == pytest.approx((sum(y < lr[0] for y in x) + 0.5 * sum(y == lr[0] for y in x)) / 252)
    assert v["beta_63_spy"][0] == pytest.approx(1.5, abs=0.1) and v["tracking_etf"][0] == "SPY"
    assert v["suspended_days_63d"][0] == 0 and v["active_at_t"][0] == 1


def test_reasons_and_gate(m):
    t = DAYS[29]
    v = values(metrics.metrics_at(m, t), "THIN")
    assert v["ret_21d"][1] is None and v["ret_63d"] == (None, "insufficient_window")
    assert v["days_since_split"] == (None, "no_known_event") and v["clv"] == (None, "undefined_input")
    assert v["suspended_days_63d"] == (None, "insufficient_window")
    metrics.date_gate(m, "THIN", "us_stocks", t)
    with pytest.raises(metrics.DateError) as e:
        metrics.date_gate(m, "THIN", "us_stocks", DAYS[35])
    assert e.value.previous == DAYS[29] and e.value.following is None
    with pytest.raises(ValueError):
        metrics.date_gate(m, "THIN", "cn_stocks", t)


def test_truncation_invariance(m, spark):
    """What is known at T does not change what is computed at T."""
    from dataclasses import replace

    t = DAYS[150]
    cut = replace(m, bars_daily=m.bars_daily.filter(f"market_date <= date'{t}'"), corporate_actions=m.corporate_actions.filter(f"ex_date <= date'{t}' or declaration_date <= date'{t}'"))
    one, two = (sorted(map(tuple, metrics.metrics_at(x, t).collect()), key=str) for x in (m, cut))
    assert one == two


def test_anchor_invariance_of_forward_returns(m):
    t = DAYS[90]
    a = forward.forward_returns(m, t, horizons=[1, 5, 21])
    b = forward.forward_returns(m, t, horizons=[1, 5, 21], anchor=DAYS[260])
    one, two = ({(r.instrument_id, r.horizon): r.ret for r in x.collect()} for x in (a, b))
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], abs=1e-12) for k in one)
    with pytest.raises(ValueError):
        forward.forward_returns(m, t, horizons=[5], anchor=DAYS[91])


def test_forward_from_the_close(m):
    c = {r.market_date: r for r in m.adjusted("split_dividend", DAYS[111], ["ST"]).collect()}
    r = {x.horizon: x for x in forward.forward_returns(m, DAYS[90], horizons=[1, 21, 400], entry="t_close", ids=["ST"]).collect()}
    assert r[21].ret == pytest.approx(c[DAYS[111]].close / c[DAYS[90]].close - 1) and r[21].bars_used == 22
    assert r[21].mae == pytest.approx(min(c[d].low for d in DAYS[91:112]) / c[DAYS[90]].close - 1)
    assert (r[400].reason, r[400].ret) == ("beyond_calendar", None)


def test_delisting_comes_from_identity(m):
    r = {x.horizon: x for x in forward.forward_returns(m, DAYS[28], horizons=[1, 5, 21], entry="t_close", ids=["THIN"]).collect()}
    assert (r[1].delisted, r[1].stale) == (False, False) and (r[5].delisted, r[5].stale) == (False, True) and (r[21].delisted, r[21].stale) == (True, False)
    none = {x.horizon: x.reason for x in forward.forward_returns(m, DAYS[29], horizons=[1], ids=["THIN"]).collect()}
    assert none == {1: "no_entry_bar"}


def test_rank_agrees_with_metrics(m):
    t = DAYS[259]
    page, summary = rank.rank_at(m, "us_stocks", t, sort="ret_z")
    r = {x.instrument_id: x for x in page.collect()}
    v = values(metrics.metrics_at(m, t, context=context.context_at(m, t)), "ST")
    for ours, theirs in (("ret_z", "ret_z_21d"), ("ret_z_vadj", "ret_z_vadj_21d"), ("range_surprise", "range_surprise"), ("resid_z", "resid_z_spy")):
        assert r["ST"][ours] == pytest.approx(v[theirs][0], rel=1e-6)
    assert summary.first().traded_at_t == 2 and {x.rank for x in page.collect()} == {1, 2}
    with pytest.raises(ValueError):
        rank.rank_at(m, "cn_stocks", t, sort="resid_z")


def test_whole_ranking_goes_beyond_a_page(spark, tmp_path):
    """520 suppliers trade on T, which is more than a page holds; the query ranks them all, as its SQL does."""
    c, lines = duckdb.connect(), tmp_path / "lineitem.parquet"
    c.execute(f"""copy (select d * 10000 + s as l_orderkey, s as l_partkey, s as l_suppkey, n::int as l_linenumber, 10::double as l_quantity, (1000 + (s * 37 + d * 53 + n * (11 + s % 7)) % 101)::double as l_extendedprice, 0::double as l_discount,
        0::double as l_tax, 'N' as l_returnflag, 'O' as l_linestatus, timestamp '{T}' - to_days(d::int) as l_shipdate from range(1, 521) a(s), range(24) b(d), range(1, 3) e(n)) to '{lines}' (format parquet)""")
    c.execute(f"copy (select s as s_suppkey, 'S' || s as s_name, 1::int as s_nationkey, 0::double as s_acctbal from range(1, 521) a(s)) to '{tmp_path}/supplier.parquet' (format parquet)")
    for t in ("nation", "region", "events"):
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    for t in ("nation", "region", "events", "supplier", "lineitem"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    columns = ("rank", "instrument_id", "ret_z", "range_surprise", "dollar_adv21")
    got = [tuple(r[x] for x in columns) for r in QUERIES["d41_rank_at"](spark, str(tmp_path)).orderBy("rank").collect()]
    want = c.sql(f"select {', '.join(columns)} from ({ORACLE_SQL['d41_rank_at']}) order by rank").fetchall()
    assert len(want) > 500 and [r[0] for r in got] == list(range(1, len(want) + 1))
    assert got == want


def test_session_and_minute_forward(spark):
    """A split on the day of T: raw minutes, adjusted previous close."""
    day, prev = D(2025, 1, 3), D(2025, 1, 2)
    utc = lambda d, h, mi: dt.datetime(d.year, d.month, d.day, h, mi, tzinfo=dt.UTC)
    bar = lambda d, h, mi, o, c: ("A", d, utc(d, h, mi), float(o), max(o, c) + 0.5, min(o, c) - 0.5, float(c), 100.0, 5, "AAA")
    m = market(
        spark, bars=[flat("A", prev, "AAA", 100, 1000), ("A", day, "AAA", 51, 53, 50, 52, 2000), ("A", D(2025, 1, 6), "AAA", 54, 55, 50, 53, 1000)], instruments=[("A", "us_stocks", "USD", None)],
        symbols=[("A", "us_stocks", "AAA", None, None)], days=[("US", d) for d in (prev, day, D(2025, 1, 6))], actions=[("s", "A", "split", day, {"split_from": 1.0, "split_to": 2.0})],
        minutes=[bar(day, 14, 0, 49, 49), bar(day, 14, 30, 51, 50.5), bar(day, 14, 31, 50.5, 50.6), bar(day, 14, 32, 50.6, 50.8), bar(day, 14, 33, 50.8, 51.5)],
    )
    v = {r.id: (r.value, r.reason) for r in session.session_metrics_at(m, "us_stocks", day, "09:33").collect()}
    assert v["minutes_since_open"][0] == 3 and v["last_price"][0] == 50.8
    assert v["gap_at_open"][0] == pytest.approx(51 / 50 - 1) and v["ret_from_prev_close"][0] == pytest.approx(50.8 / 50 - 1)
    assert v["rvol_pace"] == (None, "insufficient_window")
    with pytest.raises(ValueError):
        session.session_metrics_at(m, "us_stocks", day, "09:30")
    f = {r.horizon: r for r in forward.forward_from_minute(m, "us_stocks", day, "09:31").collect()}
    assert f["to_close"].ret == pytest.approx(52 / 50.5 - 1) and f["next_open"].ret == pytest.approx(54 / 50.5 - 1)
    assert f["1d"].ret == pytest.approx(53 / 50.5 - 1) and f["1d"].bars_used == 4 and f["3d"].reason == "beyond_calendar"
    late = {r.reason for r in forward.forward_from_minute(m, "us_stocks", day, "15:00").collect()}
    assert late == {"no_entry_bar"}


def test_continuity(spark, m):
    fetch = [("polygon", "grouped_daily", D(2025, 1, d), n) for d, n in ((1, 0), (2, 5), (3, 5), (7, 0))] + [("polygon", "minute_aggs", D(2025, 1, 2), 5)]
    f = spark.createDataFrame(fetch, "source_id string, dataset string, market_date date, row_count int")
    bars = spark.createDataFrame([("polygon", "us_stocks", D(2025, 1, 2)), ("baostock", "cn_stocks", D(2025, 1, 3))], "source_id string, market_scope string, market_date date")
    mins = spark.createDataFrame([(D(2025, 1, 7),)], "market_date date")
    got = {(r.problem, r.market_date.day) for r in verify.continuity(f, bars, mins, D(2025, 1, 1), D(2025, 1, 2), D(2025, 1, 7)).collect()}
    assert got == {("missing_raw", 6), ("open_day_missing_facts", 3), ("contradicted_closure", 7), ("intraday_missing_raw", 3), ("intraday_missing_parquet", 2)}
