"""SQL for DuckDB that gives the rows of each query in basalt.plans.queries."""

from __future__ import annotations

from basalt.functions.columns import INSTRUMENT_TYPES
from basalt.operators.forward import HORIZONS
from basalt.plans import queries as Q
from basalt.plans.catalog import DAILY, NO_EVENT_IDS, SESSION
from basalt.plans.queries import MARKET_SQL, T, adjusted_sql, q

M = f"WITH {MARKET_SQL}"


def q4(x: str, digits: int = 4) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"


def signed(x: str) -> str:
    return f"sign({x}) * ln(1 + abs({x}))"


CALC = f"""
{adjusted_sql("split_dividend", T)}, indexed AS (
  SELECT *, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY instrument_id) AS total, lead(close) OVER w AS pac FROM adjusted
  WHERE instrument_id IN (SELECT instrument_id FROM canonical WHERE market_date = DATE '{T}')
  WINDOW w AS (PARTITION BY instrument_id ORDER BY market_date DESC)
), calc AS (
  SELECT *, close / nullif(pac, 0) - 1 AS r, ln(close / nullif(pac, 0)) AS lr, open / nullif(pac, 0) - 1 AS gap_i, rc * rv AS dv, greatest(high, pac) - least(low, pac) AS tr,
         ln(open / nullif(pac, 0)) AS yz_on, ln(close / open) AS yz_oc, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS yz_rs, (high - low) / nullif(pac, 0) AS rel, power(ln(rh / rl), 2) AS park
  FROM indexed
)"""

_between = lambda a, b: f"FILTER (idx BETWEEN {a} AND {b})"
METRICS = f"""
today AS (SELECT instrument_id, lr AS lr0, r AS r0 FROM calc WHERE idx = 0), a AS (
  SELECT instrument_id, max(total) AS total, max(rc) FILTER (idx = 0) AS c0, max(rh) FILTER (idx = 0) AS h0, max(rl) FILTER (idx = 0) AS l0, max(open) FILTER (idx = 0) AS ao0,
    {", ".join(f"max(close) FILTER (idx = {i}) AS ac{i}" for i in (0, 1, 5, 21, 63, 126, 252))},
    avg(dv) {_between(1, 21)} AS adv, count(dv) {_between(1, 21)} AS adv_n, avg(CASE WHEN abs(gap_i) > 0.02 THEN 1.0 ELSE 0.0 END) {_between(0, 62)} AS gap_freq_63d, median(abs(gap_i)) {_between(0, 62)} AS abs_gap_med_63d,
    avg(close) {_between(0, 19)} AS sma20, avg(close) {_between(0, 49)} AS sma50, avg(close) {_between(0, 199)} AS sma200, max(high) {_between(0, 251)} AS hi, min(low) {_between(0, 251)} AS lo, max(close) {_between(0, 251)} AS top,
    avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) {_between(0, 20)} AS up_days_21d, stddev_samp(lr) {_between(0, 20)} * sqrt(252) AS vol_21d, stddev_samp(lr) {_between(0, 62)} * sqrt(252) AS vol_63d,
    sqrt(avg(park) {_between(0, 20)} / (4 * ln(2))) * sqrt(252) AS parkinson_21d, sqrt(avg(park) {_between(1, 21)} / (4 * ln(2))) AS pp, avg(tr) {_between(0, 13)} AS atr, max(abs(r)) {_between(0, 20)} AS max_abs_ret_21d,
    max(dv) FILTER (idx = 0) AS dv0, avg(dv) {_between(0, 4)} AS dv5, avg(dv) {_between(0, 62)} AS dv63, count(dv) {_between(0, 62)} AS dv63_n, count(dv) {_between(0, 20)} AS dv21_n, min(dv) {_between(0, 20)} AS dv21_min,
    avg(abs(r) / nullif(dv, 0)) {_between(0, 20)} * 1000000 AS amihud, var_samp(yz_on) {_between(0, 20)} AS y1, var_samp(yz_oc) {_between(0, 20)} AS y2, avg(yz_rs) {_between(0, 20)} AS y3, count(yz_on) {_between(0, 20)} AS yn,
    median(rel) {_between(1, 21)} AS rmed, count(rel) {_between(1, 21)} AS rn, max(rel) FILTER (idx = 0) AS rel0, count(*) FILTER (idx BETWEEN 1 AND 252 AND lr < lr0) AS below, count(*) FILTER (idx BETWEEN 1 AND 252 AND lr = lr0) AS same,
    count(lr) {_between(1, 252)} AS n252, kurtosis(lr) {_between(1, 252)} AS kurt, min(market_date) {_between(0, 251)} AS first252, max(r0) AS r0, max(lr0) AS lr0,
    min(idx) FILTER (r IS NOT NULL AND sign(r) <> sign(r0)) AS turn, count(r) AS nr
  FROM calc JOIN today USING (instrument_id) GROUP BY instrument_id
), ev AS (
  SELECT instrument_id, max(ex_date) FILTER (action_type IN ('split', 'stock_dividend') AND ex_date <= DATE '{T}') AS ls, max(ex_date) FILTER (action_type = 'cash_dividend' AND ex_date <= DATE '{T}') AS ld,
         min(ex_date) FILTER (ex_date > DATE '{T}' AND declaration_date <= DATE '{T}') AS nx FROM actions GROUP BY 1
), cal AS (
  SELECT market_scope, market_date FROM days WHERE is_open AND market_date <= DATE '{T}' QUALIFY row_number() OVER (PARTITION BY market_scope ORDER BY market_date DESC) <= 63
), cs AS (
  SELECT a.instrument_id, count(*) AS n, count(*) FILTER (listed) AS listed, count(*) FILTER (listed AND NOT seen) AS missing FROM (
    SELECT i.instrument_id, EXISTS (SELECT 1 FROM symbols s WHERE s.instrument_id = i.instrument_id AND s.market_scope = i.scope AND (s.valid_from IS NULL OR c.market_date >= s.valid_from) AND (s.valid_to IS NULL OR c.market_date < s.valid_to)) AS listed,
           EXISTS (SELECT 1 FROM canonical b WHERE b.instrument_id = i.instrument_id AND b.market_date = c.market_date) AS seen
    FROM instruments i JOIN cal c ON c.market_scope = i.scope) a GROUP BY 1
), dy AS (
  SELECT c.instrument_id, sum(c.cash_amount / b.close) AS v FROM cash c ASOF JOIN canonical b ON c.instrument_id = b.instrument_id AND c.ex_date > b.market_date JOIN a ON a.instrument_id = c.instrument_id
  WHERE c.ex_date BETWEEN a.first252 AND DATE '{T}' AND c.cash_amount > 0 AND b.close > 0 GROUP BY 1
), w AS (
  SELECT a.instrument_id, a.total, coalesce(cs.listed, 0) AS listed_days, c0 AS close_raw, CASE WHEN adv_n = 21 AND adv > 0 THEN log10(adv) END AS dollar_adv21_log10, total AS listed_bars,
    CASE WHEN EXISTS (SELECT 1 FROM symbols s WHERE s.instrument_id = a.instrument_id AND s.market_scope = i.scope AND (s.valid_from IS NULL OR DATE '{T}' >= s.valid_from) AND (s.valid_to IS NULL OR DATE '{T}' < s.valid_to)) THEN 1 ELSE 0 END AS active_at_t,
    {", ".join(f"ac0 / nullif(ac{n}, 0) - 1 AS ret_{n}d" for n in (1, 5, 21, 63, 126, 252))}, ac21 / nullif(ac252, 0) - 1 AS mom_12_1, ao0 / nullif(ac1, 0) - 1 AS gap, gap_freq_63d, abs_gap_med_63d,
    ac0 / nullif(sma20, 0) - 1 AS close_vs_sma20, ac0 / nullif(sma50, 0) - 1 AS close_vs_sma50, ac0 / nullif(sma200, 0) - 1 AS close_vs_sma200, sma50 / nullif(sma200, 0) - 1 AS sma50_vs_sma200, ac0 / nullif(hi, 0) - 1 AS high_252_dist, ac0 / nullif(lo, 0) - 1 AS low_252_dist, ac0 / nullif(top, 0) - 1 AS drawdown_252,
    CASE WHEN sign(r0) <> 0 THEN sign(r0) * coalesce(turn, nr) ELSE 0 END AS up_streak, up_days_21d, vol_21d, vol_63d, vol_21d / nullif(vol_63d, 0) AS vol_ratio_21_63, parkinson_21d, atr / nullif(ac0, 0) AS atr_pct_14, max_abs_ret_21d, (h0 - l0) / nullif(c0, 0) AS range_pct, (2 * c0 - h0 - l0) / nullif(h0 - l0, 0) AS clv,
    CASE WHEN adv_n = 21 AND adv > 0 THEN dv0 / adv END AS rvol_21d, CASE WHEN dv63_n = 63 AND dv63 > 0 THEN dv5 / dv63 END AS volume_trend_5_63, CASE WHEN dv21_n = 21 AND dv21_min > 0 THEN amihud END AS amihud_21d,
    CASE WHEN cs.n = 63 AND cs.listed = 63 THEN cs.missing / 63.0 END AS suspended_days_63d,
    CASE WHEN ls IS NOT NULL THEN (SELECT count(*) FROM adjusted b WHERE b.instrument_id = a.instrument_id AND b.market_date > ls) END AS days_since_split, CASE WHEN ld IS NOT NULL THEN (SELECT count(*) FROM adjusted b WHERE b.instrument_id = a.instrument_id AND b.market_date > ld) END AS days_since_dividend,
    CASE WHEN nx IS NOT NULL THEN (SELECT count(*) FROM days d WHERE d.market_scope = i.scope AND d.is_open AND d.market_date > DATE '{T}' AND d.market_date <= nx) END AS declared_ex_days, dy.v AS div_yield_ttm,
    CASE WHEN yn = 21 THEN sqrt(y1 + (0.34 / (1.34 + 1.1)) * y2 + (1 - 0.34 / (1.34 + 1.1)) * y3) * sqrt(252) END AS yz_vol_21d, CASE WHEN rn = 21 THEN rmed END AS range_med_21d, CASE WHEN rn = 21 AND rmed > 0 THEN rel0 / rmed END AS range_surprise,
    CASE WHEN pp > 0 THEN lr0 / pp END AS ret_z_21d, CASE WHEN pp > 0 AND adv_n = 21 AND adv > 0 AND dv0 > 0 THEN lr0 / pp / sqrt(dv0 / adv) END AS ret_z_vadj_21d, CASE WHEN n252 = 252 THEN (below + 0.5 * same) / 252.0 END AS ret_pctile_252d, CASE WHEN n252 = 252 THEN kurt END AS ret_kurt_252d
  FROM a JOIN instruments i USING (instrument_id) LEFT JOIN ev USING (instrument_id) LEFT JOIN cs USING (instrument_id) LEFT JOIN dy USING (instrument_id)
)"""


def _metric_rows() -> str:
    rows = []
    for m in DAILY:
        if m.family == "context":
            continue
        short = f"total < {m.min_bars}" + (" OR listed_days < 63" if m.id == "suspended_days_63d" else "")
        absent = "no_known_event" if m.id in NO_EVENT_IDS else "undefined_input"
        rows.append(f"SELECT instrument_id, '{m.id}' AS id, CASE WHEN NOT ({short}) THEN {q(m.id)} END AS value, CAST(total AS BIGINT) AS bars_available, CASE WHEN {short} THEN 'insufficient_window' WHEN {m.id} IS NULL THEN '{absent}' END AS reason FROM w")
    return " UNION ALL ".join(rows)


PAIRS = f"""
{adjusted_sql("split_dividend", T)}, lr AS (
  SELECT instrument_id, market_date, ln(close / nullif(lag(close) OVER (PARTITION BY instrument_id ORDER BY market_date), 0)) AS x FROM adjusted
), etf AS (
  SELECT symbol, instrument_id FROM symbols WHERE market_scope = 'us_stocks' AND symbol IN ('SPY', 'QQQ', 'IWM', 'DIA') AND (valid_from IS NULL OR valid_from <= DATE '{T}') AND (valid_to IS NULL OR valid_to > DATE '{T}')
), p AS (
  SELECT s.instrument_id, e.symbol, s.x AS s, b.x AS b, row_number() OVER (PARTITION BY s.instrument_id, e.symbol ORDER BY s.market_date DESC) - 1 AS i
  FROM etf e JOIN lr b ON b.instrument_id = e.instrument_id JOIN lr s ON s.market_date = b.market_date WHERE s.x IS NOT NULL AND b.x IS NOT NULL
), beta AS (
  SELECT instrument_id, symbol, count(*) FILTER (i < 63) AS n, regr_slope(s, b) FILTER (i < 63) AS k, corr(s, b) FILTER (i < 63) AS c, var_samp(s) FILTER (i < 63) AS vs, var_samp(b) FILTER (i < 63) AS vb, regr_slope(s, b) FILTER (i BETWEEN 1 AND 63) AS k1, count(*) FILTER (i <= 63) AS n1
  FROM p GROUP BY 1, 2
), res AS (
  SELECT instrument_id, symbol, any_value(n) + 1 AS bars, CASE WHEN any_value(n) < 63 THEN 'insufficient_window' WHEN NOT (any_value(vs) > 0 AND any_value(vb) > 0) THEN 'undefined_input' END AS reason, any_value(k) AS beta, any_value(c) AS corr,
    exp(sum(s - k * b) FILTER (i < 21)) - 1 AS r21, exp(sum(s - k * b) FILTER (i < 63)) - 1 AS r63, stddev_samp(s - k * b) FILTER (i < 63) * sqrt(252) AS idio,
    (exp(sum(s) FILTER (i < 21)) - 1) - (exp(sum(b) FILTER (i < 21)) - 1) AS rel21, (exp(sum(s) FILTER (i < 63)) - 1) - (exp(sum(b) FILTER (i < 63)) - 1) AS rel63,
    CASE WHEN any_value(n1) = 64 AND stddev_samp(s - k1 * b) FILTER (i BETWEEN 1 AND 63) > 1e-6 * stddev_samp(s) FILTER (i BETWEEN 1 AND 63) THEN max(s - k1 * b) FILTER (i = 0) / stddev_samp(s - k1 * b) FILTER (i BETWEEN 1 AND 63) END AS z
  FROM p JOIN beta USING (instrument_id, symbol) GROUP BY 1, 2
), ok AS (
  SELECT instrument_id, symbol, bars, reason, {", ".join(f"CASE WHEN reason IS NULL THEN {c} END AS {c}" for c in ("beta", "corr", "r21", "r63", "idio", "rel21", "rel63", "z"))} FROM res
)"""
CONTEXT_SQL = f"""{M}, {PAIRS}, best AS (
  SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY corr DESC NULLS LAST, CASE WHEN corr IS NULL THEN -bars END, symbol) = 1
)
SELECT t.instrument_id, CAST(s.bars AS BIGINT) AS spy_bars, s.reason AS spy_reason, CASE WHEN t.corr IS NOT NULL THEN t.symbol END AS tracking_etf, {q4(signed("s.beta"))} AS beta_63_spy, {q4(signed("s.corr"))} AS corr_63_spy, {q4(signed("s.r21"))} AS resid_ret_21_spy, {q4(signed("s.r63"))} AS resid_ret_63_spy,
  {q4(signed("s.idio"))} AS idio_vol_63_spy, {q4(signed("s.rel21"))} AS rel_ret_21, {q4(signed("s.rel63"))} AS rel_ret_63, {q4(signed("t.corr"))} AS tracking_corr_63, {q4(signed("t.beta"))} AS tracking_beta_63, {q4(signed("t.r21"))} AS resid_ret_21_tracking, {q4(signed("t.r63"))} AS resid_ret_63_tracking, {q4(signed("t.idio"))} AS idio_vol_63_tracking, {q4(signed("s.z"))} AS resid_z_spy
FROM best t LEFT JOIN ok s ON s.instrument_id = t.instrument_id AND s.symbol = 'SPY'"""

RANK = f"""{M}, {adjusted_sql("split_dividend")}, base AS (
  SELECT instrument_id, market_date, close / cum_price_factor * (volume / nullif(cum_volume_factor, 0)) AS dv, row_number() OVER w - 1 AS idx, ln(close / nullif(lead(close) OVER w, 0)) AS lr, (high - low) / nullif(lead(close) OVER w, 0) AS rel, power(ln(high / low), 2) AS park
  FROM adjusted JOIN instruments USING (instrument_id) WHERE scope = 'us_stocks' AND market_date <= DATE '{T}' AND market_date > DATE '{T}' - INTERVAL 500 DAYS WINDOW w AS (PARTITION BY instrument_id ORDER BY market_date DESC)
), traded AS (SELECT instrument_id, lr AS lr0 FROM base WHERE idx = 0 AND market_date = DATE '{T}'), a AS (
  SELECT instrument_id, max(lr0) AS lr0, max(dv) FILTER (idx = 0) AS dv0, avg(dv) {_between(1, 21)} AS adv, count(dv) {_between(1, 21)} AS advn, sqrt(avg(park) {_between(1, 21)} / (4 * ln(2))) AS pk, count(park) {_between(1, 21)} AS pkn,
    max(rel) FILTER (idx = 0) AS rel0, median(rel) {_between(1, 21)} AS rm, count(rel) {_between(1, 21)} AS rn, count(lr) {_between(1, 252)} AS n252, count(*) FILTER (idx BETWEEN 1 AND 252 AND lr < lr0) AS below, count(*) FILTER (idx BETWEEN 1 AND 252 AND lr = lr0) AS same
  FROM base JOIN traded USING (instrument_id) GROUP BY 1
), p AS (
  SELECT b.instrument_id, b.lr AS s, m.lr AS m, row_number() OVER (PARTITION BY b.instrument_id ORDER BY b.market_date DESC) - 1 AS i FROM base b JOIN traded USING (instrument_id) JOIN base m ON m.instrument_id = 'MKT' AND m.market_date = b.market_date WHERE b.lr IS NOT NULL AND m.lr IS NOT NULL
), k AS (SELECT instrument_id, regr_slope(s, m) FILTER (i BETWEEN 1 AND 63) AS k1, count(*) FILTER (i BETWEEN 1 AND 63) AS n FROM p GROUP BY 1), z AS (
  SELECT instrument_id, CASE WHEN any_value(n) = 63 AND stddev_samp(s - k1 * m) FILTER (i BETWEEN 1 AND 63) > 1e-7 THEN max(s - k1 * m) FILTER (i = 0) / stddev_samp(s - k1 * m) FILTER (i BETWEEN 1 AND 63) END AS resid_z FROM p JOIN k USING (instrument_id) GROUP BY 1
), sc AS (
  SELECT a.instrument_id, exp(lr0) - 1 AS ret_1d, resid_z, CASE WHEN pkn = 21 AND pk > 0 THEN lr0 / pk END AS ret_z, CASE WHEN pkn = 21 AND pk > 0 AND advn = 21 AND adv > 0 AND dv0 > 0 THEN lr0 / pk / sqrt(dv0 / adv) END AS ret_z_vadj,
    CASE WHEN rn = 21 AND rm > 0 THEN rel0 / rm END AS range_surprise, CASE WHEN advn = 21 AND adv > 0 THEN dv0 / adv END AS rvol_21d, CASE WHEN n252 = 252 THEN (below + 0.5 * same) / 252.0 END AS ret_pctile_252d, CASE WHEN advn = 21 THEN adv END AS dollar_adv21
  FROM a LEFT JOIN z USING (instrument_id)
)"""


def _forward(entry: str) -> str:
    hs = ", ".join(f"({h})" for h in HORIZONS)
    price = "close" if entry == "t_close" else "open"
    entry_date = f"DATE '{Q.FORWARD_T}'" if entry == "t_close" else f"(SELECT min(b.market_date) FROM canonical b WHERE b.instrument_id = i.instrument_id AND b.market_date > DATE '{Q.FORWARD_T}')"
    return f"""{M}, frontier AS (SELECT market_scope, max(market_date) AS f FROM bars GROUP BY 1), ranked AS (
  SELECT d.market_scope, d.market_date, row_number() OVER (PARTITION BY d.market_scope ORDER BY d.market_date) AS horizon FROM days d JOIN frontier USING (market_scope) WHERE is_open AND market_date > DATE '{Q.FORWARD_T}' AND market_date <= f
), anchor AS (SELECT max(market_date) AS d FROM ranked WHERE horizon IN ({", ".join(map(str, HORIZONS))})), {adjusted_sql("split_dividend").replace("SELECT * FROM canonical ", "SELECT * FROM canonical WHERE market_date <= (SELECT d FROM anchor) ")}, i AS (
  SELECT i.*, {entry_date} AS e FROM instruments i WHERE instrument_id IN (SELECT instrument_id FROM canonical WHERE market_date = DATE '{Q.FORWARD_T}')
), g AS (
  SELECT i.instrument_id, h.horizon, r.market_date AS t, i.e, i.delisted_date, (SELECT {price} FROM adjusted x WHERE x.instrument_id = i.instrument_id AND x.market_date = i.e) AS p
  FROM i, (VALUES {hs}) h(horizon) LEFT JOIN ranked r ON r.market_scope = i.scope AND r.horizon = h.horizon
), v AS (
  SELECT g.instrument_id, g.horizon, arg_max(x.close, x.market_date) AS vc, max(x.market_date) AS vd, min(x.low) FILTER (x.market_date > g.e) AS lo, max(x.high) FILTER (x.market_date > g.e) AS hi, count(*) FILTER (x.market_date >= g.e) AS n
  FROM g JOIN adjusted x ON x.instrument_id = g.instrument_id AND x.market_date <= g.t GROUP BY 1, 2
)
SELECT instrument_id, CAST(horizon AS INT) AS horizon, t AS date, CASE WHEN e <= t THEN {q("vc / p - 1")} END AS ret, CASE WHEN e <= t THEN {q("lo / p - 1")} END AS mae, CASE WHEN e <= t THEN {q("hi / p - 1")} END AS mfe,
  coalesce(e <= t AND vd < t AND delisted_date <= t, false) AS delisted, coalesce(e <= t AND vd < t AND NOT coalesce(delisted_date <= t, false), false) AS stale, CAST(CASE WHEN e <= t THEN n ELSE 0 END AS BIGINT) AS bars_used,
  CASE WHEN t IS NULL THEN 'beyond_calendar' WHEN e IS NULL OR e > t THEN 'no_entry_bar' END AS reason
FROM g LEFT JOIN v USING (instrument_id, horizon)"""


AT = 14 * 60
_LOCAL = {"UTC": "start", "NY": "timezone('America/New_York', timezone('UTC', start))"}


def _minutes(zone: str) -> str:
    at = f"hour({_LOCAL[zone]}) * 60 + minute({_LOCAL[zone]})"
    return f"mm AS (SELECT *, {at} AS et, close * volume AS dv FROM minutes WHERE {at} BETWEEN 570 AND 960)"



SESSION_VALUES = {
    "last_price": "last", "cum_dollar_volume": "dv", "minutes_since_open": "n", "session_fraction": "least(1.0, n / 390.0)", "gap_at_open": "fo / nullif(pc, 0) - 1", "session_ret": "last / nullif(fo, 0) - 1", "ret_from_prev_close": "last / nullif(pc, 0) - 1", "vwap_dist": "last / nullif(pv / nullif(v, 0), 0) - 1",
    "session_range_pos": "(last - lo) / nullif(hi - lo, 0)", "session_high_dist": "last / nullif(hi, 0) - 1", "session_low_dist": "last / nullif(lo, 0) - 1", "range_pct_so_far": "(hi - lo) / nullif(pc, 0)", "ret_30m": "last / nullif(c30, 0) - 1", "ret_60m": "last / nullif(c60, 0) - 1",
    "session_vol": "CASE WHEN rn >= 21 THEN vol * sqrt(390 * 252) END", "up_minutes_share": "CASE WHEN rn >= 21 THEN up END", "rvol_pace": "CASE WHEN ps >= 5 THEN dv / nullif(pace, 0) END",
}


def session_sql(zone: str) -> str:
    rows = []
    for m in SESSION:
        short = f"n < {m.min_bars}" + (" OR coalesce(ps, 0) < 5" if m.id == "rvol_pace" else "")
        x = SESSION_VALUES[m.id]
        rows.append(f"SELECT instrument_id, '{m.id}' AS id, CASE WHEN NOT ({short}) THEN {q(x)} END AS value, CAST(n AS BIGINT) AS bars_available, CASE WHEN {short} THEN 'insufficient_window' WHEN ({x}) IS NULL THEN 'undefined_input' END AS reason FROM s")
    return f"""{M}, {adjusted_sql("split_dividend", Q.DAY)}, {_minutes(zone)}, vis AS (
  SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY et DESC) - 1 AS idx, lag(close) OVER (PARTITION BY instrument_id ORDER BY et) AS pv1 FROM mm WHERE market_date = DATE '{Q.DAY}' AND et < {AT}
), a AS (
  SELECT instrument_id, count(*) AS n, arg_max(close, et) AS last, arg_min(open, et) AS fo, max(high) AS hi, min(low) AS lo, sum((high + low + close) / 3 * volume) AS pv, sum(volume) AS v, sum(dv) AS dv, max(close) FILTER (idx = 30) AS c30, max(close) FILTER (idx = 60) AS c60,
    stddev_samp(ln(close / nullif(pv1, 0))) AS vol, avg(CASE WHEN close > pv1 THEN 1.0 ELSE 0.0 END) FILTER (pv1 IS NOT NULL) AS up, count(pv1) AS rn FROM vis GROUP BY 1
), ps AS (
  SELECT instrument_id, count(*) AS ps, avg(d) AS pace FROM (SELECT instrument_id, market_date, sum(dv) AS d FROM mm WHERE market_date < DATE '{Q.DAY}' AND et < {AT} GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY market_date DESC) <= 20) GROUP BY 1
), pc AS (SELECT instrument_id, arg_max(close, market_date) AS pc FROM adjusted WHERE market_date < DATE '{Q.DAY}' GROUP BY 1), s AS (SELECT * FROM a LEFT JOIN ps USING (instrument_id) LEFT JOIN pc USING (instrument_id))
{" UNION ALL ".join(rows)}"""


def minute_forward_sql(zone: str) -> str:
    e = lambda x: q(f"{x} / entry - 1")
    return f"""{M}, {_minutes(zone)}, tgt AS (
  SELECT max(market_date) FILTER (n = 1) AS d1, max(market_date) FILTER (n = 3) AS d3 FROM (SELECT market_date, row_number() OVER (ORDER BY market_date) AS n FROM days WHERE market_scope = 'us_stocks' AND is_open AND market_date > DATE '{Q.DAY}' AND market_date <= (SELECT max(market_date) FROM bars WHERE market_scope = 'us_stocks'))
), e AS (
  SELECT instrument_id, min(et) FILTER (et >= {AT}) AS e FROM mm WHERE market_date = DATE '{Q.DAY}' GROUP BY 1
), x AS (
  SELECT instrument_id, any_value(e) AS e, max(open) FILTER (et = e) AS entry, min(low) FILTER (et > e) AS lo, max(high) FILTER (et > e) AS hi, count(*) FILTER (et >= e) AS n FROM mm JOIN e USING (instrument_id) WHERE market_date = DATE '{Q.DAY}' GROUP BY 1
), d AS (
  SELECT instrument_id, max(close) FILTER (market_date = DATE '{Q.DAY}') AS dc, min(market_date) FILTER (market_date > DATE '{Q.DAY}') AS nd, arg_min(open, market_date) FILTER (market_date > DATE '{Q.DAY}') AS no_,
    {", ".join(f"arg_max(close, market_date) FILTER (market_date <= d{k}) AS v{k}, max(market_date) FILTER (market_date <= d{k}) AS vd{k}, min(low) FILTER (market_date > DATE '{Q.DAY}' AND market_date <= d{k}) AS lo{k}, max(high) FILTER (market_date > DATE '{Q.DAY}' AND market_date <= d{k}) AS hi{k}, count(*) FILTER (market_date > DATE '{Q.DAY}' AND market_date <= d{k}) AS n{k}" for k in (1, 3))}
  FROM canonical, tgt WHERE market_date >= DATE '{Q.DAY}' GROUP BY 1
), j AS (SELECT * FROM x LEFT JOIN d USING (instrument_id), tgt), o AS (
  SELECT instrument_id, e, 'to_close' AS horizon, DATE '{Q.DAY}' AS date, {e("dc")} AS ret, {e("lo")} AS mae, {e("hi")} AS mfe, dc IS NULL AS stale, n AS bars_used FROM j
  UNION ALL SELECT instrument_id, e, 'next_open', nd, {e("no_")}, NULL, NULL, nd IS NULL, CASE WHEN nd IS NULL THEN 0 ELSE 1 END FROM j
  UNION ALL SELECT instrument_id, e, '1d', d1, {e("v1")}, {e("least(lo, lo1)")}, {e("greatest(hi, hi1)")}, vd1 < d1, n + n1 FROM j
  UNION ALL SELECT instrument_id, e, '3d', d3, {e("v3")}, {e("least(lo, lo3)")}, {e("greatest(hi, hi3)")}, vd3 < d3, n + n3 FROM j
)
SELECT instrument_id, horizon, CASE WHEN e IS NOT NULL THEN date END AS date, CASE WHEN e IS NOT NULL THEN ret END AS ret, CASE WHEN e IS NOT NULL THEN mae END AS mae, CASE WHEN e IS NOT NULL THEN mfe END AS mfe, false AS delisted, coalesce(e IS NOT NULL AND stale, false) AS stale, CAST(CASE WHEN e IS NULL THEN 0 ELSE bars_used END AS BIGINT) AS bars_used, CASE WHEN e IS NULL THEN 'no_entry_bar' END AS reason FROM o"""


_case = lambda i: "CASE upper(code) " + " ".join(f"WHEN '{r[0]}' THEN '{r[i]}'" for r in INSTRUMENT_TYPES) + " ELSE 'unknown_stock_like' END"
_uuid = "md5('ns:instrument:k' || s_suppkey)"
COMPARE = f"""cmp AS (
  SELECT d.symbol_as_traded AS symbol, d.market_date, d.close AS daily_close, coalesce(m.ao, m.lc) AS rc, m.ao IS NOT NULL AS auction, d.volume AS dvol, m.mv, m.n, m.mv / nullif(d.volume, 0) AS ratio, abs(coalesce(m.ao, m.lc) - d.close) > greatest(0.01, d.close * 0.001) AS bad, m.mv > coalesce(d.volume, 0) * 1.02 + 100 AS viol
  FROM canonical d JOIN (SELECT instrument_id, market_date, sum(volume) AS mv, max_by(open, start) FILTER (hour(start) * 60 + minute(start) = 960) AS ao, max_by(close, start) FILTER (hour(start) * 60 + minute(start) < 960) AS lc, count(*) AS n FROM minutes GROUP BY 1, 2) m USING (instrument_id, market_date)
)"""
_pct = "100.0 * (1 - count(*) FILTER (bad) / count(*))"
WEEK = "SELECT CAST(d AS DATE) AS market_date FROM (SELECT unnest(generate_series(DATE '2001-10-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS d) WHERE isodow(d) <= 5"

ORACLE_SQL = {
    "d1_deterministic_uuid": f"SELECT s_suppkey, substr({_uuid}, 1, 8) || '-' || substr({_uuid}, 9, 4) || '-3' || substr({_uuid}, 14, 3) || '-' || substr('89ab', 1 + (strpos('0123456789abcdef', substr({_uuid}, 17, 1)) - 1) % 4, 1) || substr({_uuid}, 18, 3) || '-' || substr({_uuid}, 21, 12) AS id FROM supplier",
    "f7_classification": f"SELECT code, {_case(1)} AS instrument_type, {_case(2)} AS security_form, coalesce(upper(code) = 'CS', false) AS is_clean_common_stock, count(*) AS n FROM (SELECT {Q.CODES}[1 + p_partkey % {len(Q.CODES)}] AS code FROM part) GROUP BY ALL",
    "s1_json_parse": "SELECT event_type, count(*) AS n, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1",
    "j2_temporal_join": f"{M}, b AS (SELECT DISTINCT s.symbol, b.market_date FROM bars b JOIN (SELECT DISTINCT instrument_id, symbol FROM symbols) s USING (instrument_id)), r AS (SELECT b.symbol, b.market_date, s.instrument_id AS resolved FROM b LEFT JOIN symbols s ON s.symbol = b.symbol AND (s.valid_from IS NULL OR b.market_date >= s.valid_from) AND (s.valid_to IS NULL OR b.market_date < s.valid_to) QUALIFY row_number() OVER (PARTITION BY b.symbol, b.market_date ORDER BY s.valid_from DESC NULLS LAST) = 1) SELECT symbol, resolved, count(*) AS days FROM r GROUP BY 1, 2",
    "w14_moving_averages": f"{M} SELECT instrument_id, market_date, " + ", ".join(f"CASE WHEN row_number() OVER (PARTITION BY instrument_id ORDER BY market_date) >= {n} THEN {q4(f'avg(close) OVER (PARTITION BY instrument_id ORDER BY market_date ROWS {n - 1} PRECEDING)', 3)} END AS sma{n}" for n in (20, 50, 200)) + " FROM canonical",
    "d22_minute_identity": f"{M} SELECT instrument_id, market_date, count(*) AS minutes, CAST(sum(transactions) AS BIGINT) AS transactions FROM minutes GROUP BY 1, 2",
    "d23_minute_unresolved": f"{M} SELECT market_date, symbol, count(*) AS minute_bars FROM raw_minutes ANTI JOIN (SELECT DISTINCT market_date, symbol FROM minutes) USING (market_date, symbol) GROUP BY 1, 2",
    "d24_canonical_bars": f"{M} SELECT * FROM canonical",
    "d25_dividend_cash": f"{M} SELECT instrument_id, ex_date, expected_currency, {q('cash_amount')} AS cash_amount, currency_mismatch_rows, evidence FROM cash",
    "d26_factor_events": f"{M} SELECT instrument_id, event_date, action_type, {q4('price_factor', 9)} AS price_factor, {q4('volume_factor', 9)} AS volume_factor, evidence FROM factors",
    "d27_unadjustable": f"{M} SELECT c.instrument_id, c.ex_date, {q('b.close')} AS prev_close, CASE WHEN c.cash_amount = 0 AND expected_currency = 'USD' THEN 'non_usd_only' WHEN c.cash_amount = 0 THEN 'currency_mismatch_only' WHEN b.close IS NULL THEN 'no_prev_close' ELSE 'cash_exceeds_prev_close' END AS reason, {q('c.cash_amount')} AS cash_amount, expected_currency, currency_mismatch_rows FROM cash c ASOF LEFT JOIN canonical b ON c.instrument_id = b.instrument_id AND c.ex_date > b.market_date WHERE c.cash_amount = 0 OR b.close IS NULL OR b.close <= c.cash_amount",
    "d28_adjusted_split_dividend": Q.A20[1],
    "d28_adjusted_split": Q.CA[1],
    "d28_adjusted_none": Q._adjusted("none")[1],
    "d28_adjusted_as_of": Q._adjusted("split_dividend", Q.AS_OF)[1],
    "d29_adjusted_for": Q._adjusted("split_dividend", None, "cn_stocks")[1],
    "d30_adjusted_minutes": f"{M} SELECT instrument_id, market_date, start AS window_start_utc, {', '.join(f'{q(f'{c} * f')} AS {c}' for c in ('open', 'high', 'low', 'close'))}, {q('volume / f')} AS volume, transactions, f AS cum_price_factor, 1 / f AS cum_volume_factor FROM (SELECT *, CASE WHEN instrument_id = 'EV_click' AND market_date < DATE '2024-01-15' THEN 0.5 ELSE 1.0 END AS f FROM minutes)",
    "d33_return_series": f"{M}, {adjusted_sql('split_dividend', T)}, r AS (SELECT * FROM adjusted QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY market_date DESC) <= 30) SELECT instrument_id, market_date AS date, {q('close')} AS close, {q('close / lag(close) OVER w - 1')} AS one_day_return, {q('close / first_value(close) OVER (PARTITION BY instrument_id ORDER BY market_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - 1')} AS return_from_start FROM r WINDOW w AS (PARTITION BY instrument_id ORDER BY market_date)",
    "d35_metrics_at": f"{M}, {CALC}, {METRICS} {_metric_rows()}",
    "d39_context_at": CONTEXT_SQL,
    "d41_rank_at": f"{RANK} SELECT CAST(row_number() OVER (ORDER BY abs(ret_z) DESC, instrument_id) AS INT) AS rank, instrument_id, {', '.join(f'{q4(c)} AS {c}' for c in Q.RANK_COLUMNS)} FROM sc WHERE ret_z IS NOT NULL",
    "d41_rank_summary": f"{RANK}, g AS (SELECT *, ret_z IS NOT NULL AS ok, coalesce(dollar_adv21, 0) >= 70000 AS liquid FROM sc) SELECT count(*) AS traded_at_t, count(*) FILTER (ok AND liquid) AS qualifying, count(*) FILTER (ok AND NOT liquid) AS excluded_liquidity, count(*) FILTER (NOT ok) AS excluded_window, {q4('median(abs(ret_z)) FILTER (ok AND liquid)')} AS median_abs_ret_z, {q('avg(CASE WHEN abs(ret_z) > 2 THEN 1.0 ELSE 0.0 END) FILTER (ok AND liquid)')} AS share_abs_ret_z_gt2 FROM g",
    "d42_forward_next_open": _forward("next_open"),
    "d42_forward_t_close": _forward("t_close"),
    "d43_session_metrics": session_sql("UTC"),
    "d44_forward_from_minute": minute_forward_sql("UTC"),
    "d45_parity": f"{M}, {adjusted_sql('split')}, o AS (SELECT * FROM adjusted), p AS (SELECT i.delisted_date IS NULL AS active, abs(o.close - o.rc) AS diff, abs(o.close - o.rc) > greatest(0.01, o.rc * 0.0005) AS bad, abs(o.volume - o.rv) > o.rv * 0.005 + 1 AS vbad FROM o JOIN instruments i USING (instrument_id)) SELECT CASE WHEN grouping(active) = 1 THEN 'all' WHEN active THEN 'active instruments' ELSE 'delisted instruments' END AS segment, count(*) AS bars_compared, count(*) FILTER (bad) AS close_mismatches, {q4(_pct)} AS close_match_pct, {q4('max(diff)')} AS max_close_diff, count(*) FILTER (vbad) AS volume_mismatches FROM p GROUP BY GROUPING SETS ((active), ())",
    "d46_minute_segments": f"{M}, {COMPARE} SELECT CASE WHEN auction THEN 'auction bar' ELSE 'no auction bar' END AS close_source, CASE WHEN n >= 390 THEN 'continuous (>=390 bars)' WHEN n >= 100 THEN 'intermittent (100-389)' ELSE 'sparse (<100 bars)' END AS trading_pattern, count(*) AS instrument_days, count(*) FILTER (bad) AS close_mismatches, {q4(_pct)} AS close_match_pct, {q4('median(ratio)')} AS volume_ratio_median FROM cmp GROUP BY 1, 2",
    "d46_minute_summary": f"{M}, {COMPARE} SELECT count(*) AS instrument_days, count(DISTINCT market_date) AS dates, count(*) FILTER (bad) AS close_mismatches, {q4(_pct)} AS close_match_pct, count(*) FILTER (viol) AS volume_violations, {q4('median(ratio)')} AS volume_ratio_median, {q4('quantile_cont(ratio, 0.1)')} AS volume_ratio_p10 FROM cmp",
    "d47_continuity": f"{M}, wk AS ({WEEK}), x AS (SELECT DISTINCT market_date, day(market_date) AS d FROM days WHERE market_scope = 'us_stocks'), g AS (SELECT market_date, d <> 13 AS open FROM x WHERE d <> 9), f AS (SELECT DISTINCT market_date FROM bars WHERE source_id = 'polygon' AND day(market_date) <> 17), mr AS (SELECT market_date FROM x WHERE d <> 11), mp AS (SELECT DISTINCT market_date FROM minutes), late AS (SELECT wk.market_date FROM wk JOIN g USING (market_date) WHERE open AND wk.market_date >= DATE '2024-01-05') SELECT 'missing_raw' AS problem, market_date FROM wk WHERE market_date NOT IN (SELECT market_date FROM g) UNION ALL SELECT 'open_day_missing_facts', market_date FROM wk JOIN g USING (market_date) WHERE open AND market_date NOT IN (SELECT market_date FROM f) UNION ALL SELECT 'contradicted_closure', market_date FROM wk JOIN g USING (market_date) WHERE NOT open AND market_date IN (SELECT market_date FROM mp) UNION ALL SELECT 'intraday_missing_raw', market_date FROM late WHERE market_date NOT IN (SELECT market_date FROM mr) UNION ALL SELECT 'intraday_missing_parquet', market_date FROM late WHERE market_date IN (SELECT market_date FROM mr) AND market_date NOT IN (SELECT market_date FROM mp)",
    "d49_status": f"{M} SELECT 'bars by scope' AS section, market_scope AS item, CAST(count(*) AS VARCHAR) AS value FROM bars GROUP BY 2 UNION ALL SELECT 'last bar by scope', market_scope, CAST(max(market_date) AS VARCHAR) FROM bars GROUP BY 2 UNION ALL SELECT 'instruments by scope', scope, CAST(count(*) AS VARCHAR) FROM instruments GROUP BY 2 UNION ALL SELECT 'symbols by scope', market_scope, CAST(count(*) AS VARCHAR) FROM symbols GROUP BY 2 UNION ALL SELECT 'actions by type', action_type, CAST(count(*) AS VARCHAR) FROM actions GROUP BY 2 UNION ALL SELECT 'open days by calendar', calendar_id, CAST(count(*) AS VARCHAR) FROM days WHERE is_open GROUP BY 2 UNION ALL SELECT 'minute bars by date', CAST(market_date AS VARCHAR), CAST(count(*) AS VARCHAR) FROM minutes GROUP BY 2 UNION ALL SELECT 'traded instruments', 'all', CAST(count(DISTINCT instrument_id) AS VARCHAR) FROM bars UNION ALL SELECT 'ended symbols by scope', market_scope, CAST(count(*) AS VARCHAR) FROM symbols WHERE valid_to IS NOT NULL GROUP BY 2 UNION ALL SELECT * FROM (VALUES ('computed', 'none', 'no action'), ('computed', 'split', 'split, stock_dividend'), ('computed', 'split_dividend', 'split, stock_dividend, cash_dividend'), ('runs', 'r1', 'facts ok 90'), ('runs', 'r2', 'minutes failed 2'), ('runs', 'r3', 'facts running')) v UNION ALL SELECT 'raw files by dataset', 'grouped_daily', CAST(count(*) AS VARCHAR) FROM days WHERE calendar_id = 'XNYS' UNION ALL SELECT 'raw rows by dataset', 'grouped_daily', CAST(5 * count(*) FILTER (is_open) AS VARCHAR) FROM days WHERE calendar_id = 'XNYS' UNION ALL SELECT 'unresolved', 'minute_aggs: no_symbol_match', CAST(count(*) AS VARCHAR) FROM raw_minutes WHERE symbol = 'view' HAVING count(*) > 0",
    "d50_search": f"{M} SELECT s.instrument_id, s.symbol, CASE WHEN s.valid_to IS NULL THEN 'current' ELSE coalesce(CAST(s.valid_from AS VARCHAR), '…') || ' → ' || CAST(s.valid_to AS VARCHAR) END AS symbol_usage, i.name, s.market_scope FROM symbols s JOIN instruments i USING (instrument_id) WHERE s.market_scope = 'us_stocks' AND (upper(s.symbol) LIKE 'S1%' OR i.name ILIKE '%s1%') ORDER BY upper(s.symbol) = 'S1' DESC, s.valid_to IS NULL DESC, length(s.symbol), s.symbol, s.valid_to DESC NULLS FIRST, s.instrument_id LIMIT 15",
}
