"""Small hand-made markets."""

import datetime as dt

from basalt.plans.market import Market
from basalt.sources import schemas

D = dt.date


def market(spark, bars=(), actions=(), instruments=(), symbols=(), days=(), minutes=()):
    """bars: (id, day, line, o, h, l, c, v); actions: (action id, id, type, ex, {field: value}); instruments: (id, scope, currency, delisted)."""
    scopes = {i[0]: i[1] for i in instruments}
    source = lambda s: "baostock" if s == "cn_stocks" else "polygon"
    b = [(source(scopes[i]), i, d, scopes[i], line, *map(float, p), None, None) for i, d, line, *p in bars]
    names = [f.strip().split()[0] for f in schemas.ACTIONS.split(",")]
    a = []
    for action_id, i, kind, ex, more in actions:
        row = dict.fromkeys(names) | {"source_id": source(scopes[i]), "source_action_id": action_id, "instrument_id": i, "market_scope": scopes[i], "symbol_as_stated": i, "action_type": kind, "ex_date": ex} | more
        a.append(tuple(row[n] for n in names))
    make = spark.createDataFrame
    inst = make([(i, s, c, x, i) for i, s, c, x in instruments], "instrument_id string, primary_market_scope string, currency string, delisted_date date, name string")
    sym = make([(i, s, n, f, t, True) for i, s, n, f, t in symbols], "instrument_id string, market_scope string, symbol string, valid_from date, valid_to date, is_primary boolean")
    cal = make([(c, d, True, False) for c, d in days], "calendar_id string, market_date date, is_open boolean, is_half_day boolean")
    exchanges = make([("XNYS", "us_stocks", "US"), ("XSHG", "cn_stocks", "CN")], "exchange_mic string, market_scope string, calendar_id string")
    mins = make(list(minutes), "instrument_id string, market_date date, window_start_utc timestamp, open double, high double, low double, close double, volume double, transactions long, symbol_as_traded string")
    return Market(make(b, schemas.BARS_DAILY), inst, sym, make(a, schemas.ACTIONS), cal, exchanges, mins)


def flat(i, d, line, close, volume):
    return (i, d, line, close, close, close, close, volume)
