"""Further queries over the driver's tables: one instrument, other zones and sorts, caches, reads for a client.

As in basalt.plans.queries, each has SQL that computes the same from the same rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from basalt.functions import text
from basalt.functions.columns import rounded
from basalt.operators import adjust, cache, context, forward, metrics, rank, series, session, verify
from basalt.plans import oracle as O
from basalt.plans import queries as Q
from basalt.plans.catalog import DAILY
from basalt.plans.market import from_driver
from basalt.plans.queries import ADJUSTED_COLUMNS, MARKET_SQL, T, adjusted_sql, q
from basalt.sources import readers, schemas
from basalt.sources.store import shared_folder

ONE, EVENT = "1", "EV_click"
CONTEXT_FAMILY = [m for m in DAILY if m.family == "context"]
M = f"WITH {MARKET_SQL}"


def _signed(x):
    return rounded(F.signum(x) * F.ln(1 + F.abs(x)), 4)


def _one(spark, sf_dir):
    a = from_driver(spark, sf_dir).adjusted("split_dividend", ids=[ONE])
    return a.select("instrument_id", "market_date", *[rounded(c).alias(c) for c in ADJUSTED_COLUMNS])


def _metrics_one(spark, sf_dir):
    w = metrics.metrics_at(from_driver(spark, sf_dir), T, ["MKT"]).filter("family <> 'context'")
    return w.select("instrument_id", "id", rounded("value").alias("value"), "bars_available", "reason")


def _context_rows(spark, sf_dir):
    """The context family as metrics, with the adjusted residual score, texts and all reasons."""
    m = from_driver(spark, sf_dir)
    w = metrics.metrics_at(m, T, context=context.context_at(m, T)).filter("family = 'context'")
    return w.select("instrument_id", "id", _signed("value").alias("value"), "text", "bars_available", "reason")


def _minutes_one(spark, sf_dir):
    m = from_driver(spark, sf_dir)
    a = adjust.adjusted_minutes(m.bars_minute, m.factors.unionByName(Q._minute_split(spark)), "split", dt.date(2024, 1, 20), [EVENT])
    return a.select("instrument_id", "window_start_utc", *[rounded(c).alias(c) for c in ("open", "close", "volume")], "cum_price_factor")


def _cached(spark, sf_dir):
    """A snapshot is built, found fresh, and read."""
    m, root = from_driver(spark, sf_dir), shared_folder(spark, "cache")
    if not cache.refresh(m, root) or cache.refresh(m, root):
        raise ValueError("the snapshot was not built once")
    rows = cache.read(spark, root, "split_dividend", cache.watermark(m))
    return rows.select("instrument_id", "market_date", "symbol_as_traded", *[rounded(c).alias(c) for c in ADJUSTED_COLUMNS])


def _gate(spark, sf_dir):
    """The nearest bar dates of a day without one."""
    try:
        metrics.date_gate(from_driver(spark, sf_dir), "MKT", "us_stocks", dt.date(1990, 1, 1))
    except metrics.DateError as e:
        return spark.createDataFrame([(e.t, e.previous, e.following)], "t date, previous date, following date")
    raise ValueError("there is a bar")


def _sorts(spark, sf_dir):
    m, out = from_driver(spark, sf_dir), None
    for s in rank.SORTS:
        page = rank.rank_at(m, "us_stocks", T, sort=s, limit=500)[0].select(F.lit(s).alias("sort"), "rank", "instrument_id", rounded(s, 4).alias("value"), "symbol", "name")
        out = page if out is None else out.unionByName(page)
    return out


def _session_ny(spark, sf_dir):
    s = session.session_metrics_at(from_driver(spark, sf_dir), "us_stocks", Q.DAY, Q.MINUTE)
    return s.select("instrument_id", "id", rounded("value").alias("value"), "bars_available", "reason")


def _forward_ny(spark, sf_dir):
    f = forward.forward_from_minute(from_driver(spark, sf_dir), "us_stocks", Q.DAY, Q.MINUTE)
    return f.select("instrument_id", "horizon", "date", *[rounded(c).alias(c) for c in ("ret", "mae", "mfe")], "delisted", "stale", "bars_used", "reason")


def _one_ticker(spark, sf_dir):
    """Parity by ticker: instruments that traded under several are left out."""
    m = from_driver(spark, sf_dir)
    theirs = m.canonical.select(F.col("symbol_as_traded").alias("symbol"), "market_date", (F.col("close") * 1.001).alias("close"), "volume")
    active = m.instruments.select("instrument_id", F.col("delisted_date").isNull().alias("active"))
    rows = verify.parity(m.adjusted("none"), theirs.filter("symbol not in ('A', 'N', 'R')"), active)
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("days"), F.count_if("close_mismatch").alias("mismatches"), rounded(F.max("close_diff"), 4).alias("max_diff"))


def _summary(spark, sf_dir):
    return verify.continuity_summary(Q._d47(spark, sf_dir))


def _differences(spark, sf_dir):
    """Adjusted closes of two policies, both ways."""
    m = from_driver(spark, sf_dir)
    one = lambda p: m.adjusted(p).select("instrument_id", "market_date", rounded("close").alias("close"))
    return verify.differences(one("none"), one("split")).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("instrument_id").alias("instruments"))


def _contract(spark, sf_dir):
    found = verify.contract(from_driver(spark, sf_dir).bars_daily, spark.createDataFrame([], schemas.BARS_DAILY.replace("volume double", "volume long").replace(", trade_count long", "")))
    return spark.createDataFrame([(x,) for x in found], "difference string")


def _catalog(spark, sf_dir):
    """Own views and functions; those that come with Spark are not listed."""
    spark.read.parquet(f"{sf_dir}/region.parquet").createOrReplaceTempView("listed_view")
    spark.sql("create or replace temporary function listed_function(x int) returns int return x + 1")
    return readers.catalog(spark).filter(F.col("name").isin("listed_view", "listed_function", "abs", "sum"))


def _guarded(spark, sf_dir):
    """A statement through the read-only guard, limited, with whether there was more."""
    spark.read.parquet(f"{sf_dir}/nation.parquet").createOrReplaceTempView("guarded_nation")
    rows, more = text.run_read_only(spark, "select n_nationkey, n_regionkey from guarded_nation order by n_nationkey;", 10)
    return spark.createDataFrame([(r["n_nationkey"], r["n_regionkey"], more) for r in rows], "n_nationkey long, n_regionkey long, more boolean")


def _bars_read(spark, sf_dir):
    b = verify.bars_of(from_driver(spark, sf_dir), "MKT", "split_dividend", Q.AS_OF)
    return b.select("date", *[rounded(c).alias(c) for c in ("open", "close", "volume", "cum_price_factor")], "symbol_as_traded")


def _day_minutes(spark, sf_dir):
    b = verify.day_minutes(from_driver(spark, sf_dir), EVENT, Q.DAY)
    return b.select("time", *[rounded(c).alias(c) for c in ("open", "close", "volume", "cum_price_factor")], "symbol_as_traded")


def _unresolved(spark, sf_dir):
    m = from_driver(spark, sf_dir)
    lost = Q._d23(spark, sf_dir).select(F.lit("minute_aggs").alias("dataset"), F.lit("no_symbol_match").alias("reason"), "market_date")
    return verify.unresolved_summary(lost.unionByName(m.instruments.select(F.lit("instruments").alias("dataset"), F.lit("delisted").alias("reason"), F.col("delisted_date").alias("market_date")).filter("market_date is not null")))


def _detail(spark, sf_dir):
    d = verify.detail(from_driver(spark, sf_dir), ONE)
    return d["reach"].crossJoin(d["actions"].agg(F.count(F.lit(1)).alias("actions"))).crossJoin(d["symbols"].agg(F.max("symbol").alias("symbol")))  # a row each


def _day_list(spark, sf_dir):
    d = verify.minute_day_list(from_driver(spark, sf_dir), EVENT, 10)
    return d.select("market_date", "bars", "first_et", "last_et", rounded("low", 4).alias("low"), rounded("high", 4).alias("high"), "volume")


def _vwap(spark, sf_dir):
    v = series.session_vwap(from_driver(spark, sf_dir).bars_minute)
    return v.select("instrument_id", "window_start_utc", rounded("vwap", 8).alias("vwap"))


def _cap(spark, sf_dir):
    return series.volume_cap(from_driver(spark, sf_dir).canonical).select("instrument_id", rounded("volume_cap", 4).alias("volume_cap"))


QUERIES = {
    "d29_one_instrument": _one, "d31_minutes_of_one": _minutes_one, "d32_cache": _cached, "d34_date_gate": _gate, "d35_metrics_of_one": _metrics_one, "d35_context_family": _context_rows, "d41_rank_sorts": _sorts, "d43_session_new_york": _session_ny, "d44_forward_new_york": _forward_ny,
    "d45_one_ticker": _one_ticker, "d47_summary": _summary, "u2_differences": _differences, "d51_contract": _contract, "f14_guarded_sql": _guarded, "s13_catalog": _catalog, "d50_scopes": lambda s, d: verify.scopes(from_driver(s, d)), "d50_bars": _bars_read, "d50_minute_days": _day_list, "d50_minute_bars": _day_minutes,
    "d50_runs": lambda s, d: verify.recent_runs(Q._runs(s), 2).select("run_id", "job", "status", "seconds", "error"), "d50_unresolved": _unresolved, "d50_detail": _detail, "w14_session_vwap": _vwap, "w14_volume_cap": _cap,
}


def _context_sql() -> str:
    """Value, bars and reason of each metric of the family, from the residuals against SPY and the tracking ETF."""
    figures = {"beta_63_spy": "s.beta", "corr_63_spy": "s.corr", "resid_ret_21_spy": "s.r21", "resid_ret_63_spy": "s.r63", "idio_vol_63_spy": "s.idio", "rel_ret_21": "s.rel21", "rel_ret_63": "s.rel63", "resid_z_spy": "s.z", "resid_z_vadj_spy": "CASE WHEN w.rvol_21d > 0 THEN s.z / sqrt(w.rvol_21d) END", "tracking_corr_63": "t.corr", "tracking_beta_63": "t.beta", "resid_ret_21_tracking": "t.r21", "resid_ret_63_tracking": "t.r63", "idio_vol_63_tracking": "t.idio"}
    rows = []
    for m in CONTEXT_FAMILY:
        x, label = figures.get(m.id, "NULL::DOUBLE"), "CASE WHEN t.corr IS NOT NULL THEN t.symbol END"
        side = "t" if "tracking" in m.id else "s"
        short = f"w.total < {m.min_bars}"
        gone = f"(i.scope = 'cn_stocks' OR {short})"
        empty = f"({label}) IS NULL" if m.id == "tracking_etf" else f"({x}) IS NULL"
        late = {"resid_z_spy": "'insufficient_window'", "resid_z_vadj_spy": "CASE WHEN s.z IS NULL THEN 'insufficient_window' ELSE 'undefined_input' END"}.get(m.id, "'undefined_input'")
        missing = "WHEN s.bars IS NULL THEN 'undefined_input'" if side == "s" else ""
        rows.append(
            f"SELECT w.instrument_id, '{m.id}' AS id, CASE WHEN NOT {gone} THEN {O.q4(O.signed(f'({x})')) if m.id != 'tracking_etf' else 'NULL::DOUBLE'} END AS value, {f'CASE WHEN NOT {gone} THEN {label} END' if m.id == 'tracking_etf' else 'NULL::VARCHAR'} AS text, "
            f"CAST(CASE WHEN {gone} THEN w.total ELSE coalesce({side}.bars, 0) END AS BIGINT) AS bars_available, CASE WHEN i.scope = 'cn_stocks' THEN 'no_market_baseline' WHEN {short} THEN 'insufficient_window' WHEN {empty} THEN CASE WHEN {side}.reason IS NOT NULL THEN {side}.reason {missing} ELSE {late} END END AS reason "
            "FROM w JOIN instruments i USING (instrument_id) LEFT JOIN best t ON t.instrument_id = w.instrument_id LEFT JOIN ok s ON s.instrument_id = w.instrument_id AND s.symbol = 'SPY'"
        )
    pairs = O.PAIRS.split("), lr AS (", 1)[1]  # the adjusted bars are there already
    return f"""{M}, {O.CALC}, {O.METRICS.rstrip()}, lr AS ({pairs}, best AS (
  SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY corr DESC NULLS LAST, CASE WHEN corr IS NULL THEN -bars END, symbol) = 1
) {" UNION ALL ".join(rows)}"""


_click = "CASE WHEN market_date < DATE '2024-01-15' THEN 0.5 ELSE 1.0 END"
_ny = "timezone('America/New_York', timezone('UTC', start))"
_adjusted = ", ".join(f"{q(c)} AS {c}" for c in ADJUSTED_COLUMNS)
ORACLE_SQL = {
    "d29_one_instrument": f"{M}, {adjusted_sql('split_dividend')} SELECT instrument_id, market_date, {_adjusted} FROM adjusted WHERE instrument_id = '{ONE}'",
    "d31_minutes_of_one": f"{M} SELECT instrument_id, start AS window_start_utc, {q(f'open * {_click}')} AS open, {q(f'close * {_click}')} AS close, {q(f'volume / {_click}')} AS volume, {_click} AS cum_price_factor FROM minutes WHERE instrument_id = '{EVENT}' AND market_date <= DATE '2024-01-20'",
    "d32_cache": Q.A20[1],
    "d34_date_gate": f"{M} SELECT DATE '1990-01-01' AS t, max(market_date) FILTER (market_date < DATE '1990-01-01') AS previous, min(market_date) FILTER (market_date > DATE '1990-01-01') AS following FROM canonical WHERE instrument_id = 'MKT'",
    "d35_metrics_of_one": f"SELECT * FROM ({O.ORACLE_SQL['d35_metrics_at']}) WHERE instrument_id = 'MKT'",
    "d35_context_family": _context_sql(),
    "d41_rank_sorts": f"{O.RANK}, lab AS (SELECT instrument_id, min(symbol) AS symbol FROM symbols WHERE (valid_from IS NULL OR valid_from <= DATE '{T}') AND (valid_to IS NULL OR valid_to > DATE '{T}') GROUP BY 1), r AS ("
    + " UNION ALL ".join(f"SELECT '{s}' AS sort, CAST(row_number() OVER (ORDER BY abs({s}) DESC, instrument_id) AS INT) AS rank, instrument_id, {O.q4(s)} AS value FROM sc WHERE {s} IS NOT NULL" for s in rank.SORTS)
    + ") SELECT r.*, lab.symbol, i.name FROM r LEFT JOIN lab USING (instrument_id) LEFT JOIN instruments i USING (instrument_id) WHERE rank <= 500",
    "d43_session_new_york": O.session_sql("NY"),
    "d44_forward_new_york": O.minute_forward_sql("NY"),
    "d45_one_ticker": f"{M}, o AS (SELECT instrument_id, any_value(symbol_as_traded) AS symbol FROM canonical GROUP BY 1 HAVING count(DISTINCT symbol_as_traded) = 1) SELECT symbol, count(*) AS days, count(*) FILTER (abs(c.close - t.close) > greatest(0.01, t.close * 0.0005)) AS mismatches, {O.q4('max(abs(c.close - t.close))')} AS max_diff FROM o JOIN canonical c USING (instrument_id) JOIN (SELECT symbol_as_traded AS symbol, market_date, close * 1.001 AS close FROM canonical WHERE symbol_as_traded NOT IN ('A', 'N', 'R')) t USING (symbol, market_date) GROUP BY 1",
    "d47_summary": f"SELECT problem, count(*) AS days, min(market_date) AS first, max(market_date) AS last FROM ({O.ORACLE_SQL['d47_continuity']}) GROUP BY 1",
    "u2_differences": f"{M}, {adjusted_sql('split')}, a AS (SELECT instrument_id, market_date, {q('rc')} AS close FROM adjusted), b AS (SELECT instrument_id, market_date, {q('close')} AS close FROM adjusted), d AS (SELECT 'first' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'second', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) SELECT side, count(*) AS n, count(DISTINCT instrument_id) AS instruments FROM d GROUP BY 1",
    "d51_contract": "SELECT unnest(['trade_count: bigint / None', 'volume: double / bigint']) AS difference",
    "f14_guarded_sql": "SELECT n_nationkey, n_regionkey, (SELECT count(*) FROM nation) > 10 AS more FROM nation ORDER BY 1 LIMIT 10",
    "s13_catalog": "SELECT * FROM (VALUES ('view', 'listed_view'), ('function', 'listed_function')) v(kind, name)",
    "d50_scopes": f"{M} SELECT DISTINCT market_scope AS scope FROM symbols",
    "d50_bars": f"{M}, {adjusted_sql('split_dividend', Q.AS_OF)} SELECT market_date AS date, {q('open')} AS open, {q('close')} AS close, {q('volume')} AS volume, {q('cum_price_factor')} AS cum_price_factor, symbol_as_traded FROM adjusted WHERE instrument_id = 'MKT'",
    "d50_minute_days": f"{M} SELECT market_date, count(*) AS bars, strftime(min({_ny}), '%H:%M') AS first_et, strftime(max({_ny}), '%H:%M') AS last_et, {O.q4('min(low)')} AS low, {O.q4('max(high)')} AS high, CAST(sum(volume) AS BIGINT) AS volume FROM minutes WHERE instrument_id = '{EVENT}' GROUP BY 1 ORDER BY 1 DESC LIMIT 10",
    "d50_minute_bars": f"{M} SELECT CAST(epoch(start) AS BIGINT) AS time, {q('open')} AS open, {q('close')} AS close, {q('volume')} AS volume, 1.0 AS cum_price_factor, symbol AS symbol_as_traded FROM minutes WHERE instrument_id = '{EVENT}' AND market_date = DATE '{Q.DAY}'",
    "d50_runs": "SELECT * FROM (VALUES ('r3', 'facts', 'running', NULL::INT, NULL::VARCHAR), ('r2', 'minutes', 'failed', 2, 'lost rows')) v(run_id, job, status, seconds, error)",
    "d50_unresolved": f"{M} SELECT 'minute_aggs' AS dataset, 'no_symbol_match' AS reason, count(*) AS entries, min(market_date) AS first_date, max(market_date) AS last_date FROM (SELECT DISTINCT market_date, symbol FROM raw_minutes WHERE symbol = 'view') HAVING count(*) > 0 UNION ALL SELECT 'instruments', 'delisted', count(*), min(delisted_date), max(delisted_date) FROM instruments WHERE delisted_date IS NOT NULL HAVING count(*) > 0",
    "d50_detail": f"{M} SELECT count(*) AS bars, min(market_date) AS first, max(market_date) AS last, count(DISTINCT symbol_as_traded) AS lines, (SELECT count(*) FROM actions WHERE instrument_id = '{ONE}') AS actions, (SELECT max(symbol) FROM symbols WHERE instrument_id = '{ONE}') AS symbol FROM bars WHERE instrument_id = '{ONE}'",
    "w14_session_vwap": f"{M} SELECT instrument_id, start AS window_start_utc, {O.q4('sum((high + low + close) / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0)', 8)} AS vwap FROM minutes WINDOW w AS (PARTITION BY instrument_id, market_date ORDER BY start)",
    "w14_volume_cap": f"{M}, v AS (SELECT instrument_id, list(volume ORDER BY volume) FILTER (volume > 0) AS vs FROM canonical GROUP BY 1) SELECT instrument_id, {O.q4('coalesce(vs[1 + CAST(least(len(vs) - 1, floor(len(vs) * 0.98)) AS INT)], 0) * 1.15')} AS volume_cap FROM v",
}
