import datetime as dt

import pytest

from basalt.operators import adjust
from tests.markets import flat, market

J = lambda d: dt.date(2025, 1, d)


@pytest.fixture(scope="module")
def m(spark):
    usd = {"currency": "USD", "dividend_type": "CD"}
    return market(
        spark,
        bars=[flat("A", J(2), "AAA", 100, 1000), flat("A", J(3), "AAA", 51, 2000), flat("A", J(6), "AAA", 52, 2100), flat("B", J(2), "BBB", 10, 100), flat("B", J(2), "BBBW", 11, 900)],
        instruments=[("A", "us_stocks", "USD", None), ("B", "us_stocks", "USD", None)],
        actions=[
            ("s1", "A", "split", J(3), {"split_from": 1.0, "split_to": 2.0}), ("s2", "A", "split", J(3), {"split_from": 1.0, "split_to": 2.0}),
            ("d1", "A", "cash_dividend", J(6), {"cash_amount": 0.5} | usd), ("d8", "A", "cash_dividend", J(6), {"cash_amount": 0.5} | usd), ("d2", "A", "cash_dividend", J(6), {"cash_amount": 0.5, "dividend_type": "SC"}),
            ("d3", "A", "cash_dividend", J(6), {"cash_amount": 5.0, "currency": "CAD"}), ("d5", "A", "cash_dividend", J(2), {"cash_amount": 1.0} | usd),
            ("d6", "B", "cash_dividend", J(3), {"cash_amount": 99.0} | usd), ("d4", "B", "cash_dividend", J(4), {"cash_amount": 7.0, "currency": "CAD"}),
        ],
    )


def closes(df, i="A"):
    return [r.close for r in df.filter(f"instrument_id = '{i}'").orderBy("market_date").collect()]


def test_factors_and_policies(m):
    f = {(r.instrument_id, r.action_type): (r.price_factor, r.volume_factor) for r in m.factors.collect()}
    assert f == {("A", "split"): (0.5, 2.0), ("A", "cash_dividend"): (pytest.approx(1 - 1 / 51), 1.0)}
    assert closes(m.adjusted("none")) == [100, 51, 52]
    assert closes(m.adjusted("split")) == [50, 51, 52]
    k = 1 - 1 / 51
    assert closes(m.adjusted("split_dividend")) == pytest.approx([100 * 0.5 * k, 51 * k, 52])
    assert [r.volume for r in m.adjusted("split").filter("instrument_id = 'A'").orderBy("market_date").collect()] == [2000, 2000, 2100]
    with pytest.raises(ValueError):
        m.adjusted("other")


def test_as_of_truncates_and_anchors(m):
    assert closes(m.adjusted("split_dividend", J(2))) == [100]
    assert closes(m.adjusted("split_dividend", J(3))) == [50, 51]
    assert closes(m.adjusted("split_dividend", J(3), ["A"])) == [50, 51]


def test_canonical_line_and_unadjustable(m):
    b = m.canonical.filter("instrument_id = 'B'").collect()
    assert [(r.symbol_as_traded, r.close) for r in b] == [("BBBW", 11.0)]
    u = adjust.unadjustable_dividends(m.corporate_actions, m.instruments, m.canonical).collect()
    assert {(r.instrument_id, r.ex_date, r.reason) for r in u} == {("A", J(2), "no_prev_close"), ("B", J(3), "cash_exceeds_prev_close"), ("B", J(4), "non_usd_only")}


def test_stock_dividend_sums_distinct_statements(spark):
    s = {"bonus_ratio": 0.2, "conversion_ratio": 0.3}
    m = market(
        spark, bars=[flat("C", J(2), "C", 10, 1000), flat("C", J(3), "C", 6.6, 1500)], instruments=[("C", "cn_stocks", "CNY", None)],
        actions=[("a", "C", "stock_dividend", J(3), s), ("b", "C", "stock_dividend", J(3), s), ("c", "C", "cash_dividend", J(3), {"cash_amount": 0.15, "currency": "CNY"}), ("d", "C", "cash_dividend", J(3), {"cash_amount": 2.0, "currency": "USD"})],
    )
    first = m.adjusted("split").orderBy("market_date").first()
    assert (first.close, first.volume) == (pytest.approx(10 / 1.5), pytest.approx(1500))
    assert m.adjusted("split_dividend").orderBy("market_date").first().cum_price_factor == pytest.approx(0.985 / 1.5)
    u = adjust.dividend_cash(m.corporate_actions, m.instruments).first()
    assert (u.cash_amount, u.currency_mismatch_rows) == (0.15, 1)


def test_event_after_the_last_bar_has_no_effect(spark):
    m = market(spark, bars=[flat("A", J(2), "A", 8, 1), flat("A", J(3), "A", 9, 1)], instruments=[("A", "us_stocks", "USD", None)], actions=[("s", "A", "split", J(7), {"split_from": 1.0, "split_to": 4.0}), ("t", "A", "split", J(3), {"split_from": 1.0, "split_to": 2.0})])
    assert closes(m.adjusted("split")) == [4, 9]


def test_plan_has_one_exchange_by_instrument(m):
    plan = m.adjusted("split", None, ["A"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_one_stream_equals_factor_events(m):
    for policy in adjust.POLICIES:
        for as_of in (None, J(2), J(3), J(6)):
            one = adjust.with_action_factors(m.canonical, m.corporate_actions, m.instruments, policy, as_of)
            two = adjust.with_factors(m.canonical, m.factors, policy, as_of)
            see = lambda d: sorted((r.instrument_id, r.market_date, round(r.cum_price_factor, 12), round(r.cum_volume_factor, 12)) for r in d.collect())
            assert see(one) == see(two)


@pytest.fixture(scope="module")
def random_market(spark):
    """Instruments with gaps, and actions on days with and without bars, before the first bar and after the last."""
    import random

    r = random.Random(3)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    bars, actions = [], []
    for i in "ABCDEFGH":
        bars += [flat(i, day(n), i, r.randint(20, 90), r.randint(1, 900)) for n in range(120) if r.random() < 0.4]
        for k in range(12):
            kind = r.choice(["split", "cash_dividend", "stock_dividend"])
            more = {"split": {"split_from": 1.0, "split_to": 2.0}, "cash_dividend": {"cash_amount": 3.0, "currency": "USD"}, "stock_dividend": {"bonus_ratio": 0.1, "conversion_ratio": 0.2}}[kind]
            actions.append((f"{kind}{i}{k}", i, kind, day(r.randint(-5, 130)), more))
    return market(spark, bars=bars, actions=actions, instruments=[(i, "us_stocks", "USD", None) for i in "ABCDEFGH"])


@pytest.mark.parametrize("policy", ["none", "split", "split_dividend"])
def test_a_lower_bound_changes_no_row_that_is_left(random_market, policy):
    m, upto = random_market, dt.date(2024, 4, 10)
    key = lambda r: (r.instrument_id, r.market_date)
    every = {key(r): r for r in m.adjusted(policy, upto).collect()}
    for since in (dt.date(2024, 1, 1), dt.date(2024, 2, 20), dt.date(2024, 4, 9), dt.date(2024, 4, 11)):
        got = {key(r): r for r in m.adjusted(policy, upto, since=since).collect()}
        assert got.keys() == {k for k in every if k[1] >= since}
        for k, r in got.items():
            assert (r.close, r.volume, r.cum_price_factor) == pytest.approx((every[k].close, every[k].volume, every[k].cum_price_factor), rel=1e-12)


def test_bounds_and_choices_reach_the_scan(spark, random_market, tmp_path):
    """Folders of dates outside the bounds are never read, and instruments are chosen by the files' statistics."""
    from dataclasses import replace

    random_market.bars_daily.write.partitionBy("market_date").parquet(f"file://{tmp_path}/bars")
    stored = spark.read.schema(random_market.bars_daily.schema).parquet(f"file://{tmp_path}/bars")
    m = replace(random_market, bars_daily=stored)
    plan = m.adjusted("split_dividend", dt.date(2024, 4, 10), ["A"], since=dt.date(2024, 2, 20))._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line and "market_date" in line]
    assert scan and all("market_date#" in line.split("PartitionFilters")[1] and "2024-02-20" in line.split("PartitionFilters")[1].split("PushedFilters")[0] for line in scan)
    assert all("EqualTo(instrument_id,A)" in line or "In(instrument_id, [A])" in line for line in scan)
    page = __import__("basalt.operators.rank", fromlist=["scores"]).scores(m, dt.date(2024, 4, 10), "us_stocks")[0]
    assert "PartitionFilters: [isnotnull(market_date" in page._jdf.queryExecution().executedPlan().toString()


def test_bars_are_dealt_once_and_sorted_once_for_the_product(spark, random_market):
    plan = random_market.adjusted("split_dividend")._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Union")]  # what happens to bars and events together
    assert above.count("Exchange") == 0 and above.count("Sort ") == 1
