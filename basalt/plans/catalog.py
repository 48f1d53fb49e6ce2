"""The metric catalogs as data: 61 daily metrics at T, 17 session metrics at a minute T."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Metric(NamedTuple):
    id: str
    family: str
    window: str  # bars, "all" or "-"
    min_bars: int
    available_at: str
    basis: str
    unit: str


#: Id, family, window, least bars, available at, basis, unit.
DAILY = (
    Metric("close_raw", "state", "1", 1, "close", "raw", "currency"),
    Metric("dollar_adv21_log10", "state", "21", 22, "close", "dollar", "log10_currency"),
    Metric("listed_bars", "state", "all", 1, "close", "raw", "bars"),
    Metric("active_at_t", "state", "-", 1, "close", "raw", "boolean"),
    Metric("ret_1d", "returns", "1", 2, "close", "adj", "ratio"),
    Metric("ret_5d", "returns", "5", 6, "close", "adj", "ratio"),
    Metric("ret_21d", "returns", "21", 22, "close", "adj", "ratio"),
    Metric("ret_63d", "returns", "63", 64, "close", "adj", "ratio"),
    Metric("ret_126d", "returns", "126", 127, "close", "adj", "ratio"),
    Metric("ret_252d", "returns", "252", 253, "close", "adj", "ratio"),
    Metric("mom_12_1", "returns", "252", 253, "close", "adj", "ratio"),
    Metric("gap", "gap", "1", 2, "open", "adj", "ratio"),
    Metric("gap_freq_63d", "gap", "63", 64, "close", "adj", "share"),
    Metric("abs_gap_med_63d", "gap", "63", 64, "close", "adj", "ratio"),
    Metric("close_vs_sma20", "trend", "20", 20, "close", "adj", "ratio"),
    Metric("close_vs_sma50", "trend", "50", 50, "close", "adj", "ratio"),
    Metric("close_vs_sma200", "trend", "200", 200, "close", "adj", "ratio"),
    Metric("sma50_vs_sma200", "trend", "200", 200, "close", "adj", "ratio"),
    Metric("high_252_dist", "trend", "252", 252, "close", "adj", "ratio"),
    Metric("low_252_dist", "trend", "252", 252, "close", "adj", "ratio"),
    Metric("drawdown_252", "trend", "252", 252, "close", "adj", "ratio"),
    Metric("up_streak", "trend", "all", 2, "close", "adj", "bars"),
    Metric("up_days_21d", "trend", "21", 22, "close", "adj", "share"),
    Metric("vol_21d", "volatility", "21", 22, "close", "adj", "annualized"),
    Metric("vol_63d", "volatility", "63", 64, "close", "adj", "annualized"),
    Metric("vol_ratio_21_63", "volatility", "63", 64, "close", "adj", "ratio"),
    Metric("parkinson_21d", "volatility", "21", 21, "close", "raw", "annualized"),
    Metric("atr_pct_14", "volatility", "14", 15, "close", "adj", "ratio"),
    Metric("max_abs_ret_21d", "volatility", "21", 22, "close", "adj", "ratio"),
    Metric("range_pct", "volatility", "1", 1, "close", "raw", "ratio"),
    Metric("clv", "volatility", "1", 1, "close", "raw", "ratio"),
    Metric("rvol_21d", "volume", "21", 22, "close", "dollar", "ratio"),
    Metric("volume_trend_5_63", "volume", "63", 63, "close", "dollar", "ratio"),
    Metric("amihud_21d", "volume", "21", 22, "close", "dollar", "per_1e6_currency"),
    Metric("suspended_days_63d", "volume", "63", 1, "close", "raw", "share"),
    Metric("days_since_split", "events", "all", 1, "close", "raw", "bars"),
    Metric("days_since_dividend", "events", "all", 1, "close", "raw", "bars"),
    Metric("declared_ex_days", "events", "-", 1, "close", "raw", "open_days"),
    Metric("div_yield_ttm", "events", "252", 253, "close", "raw", "ratio"),
    Metric("beta_63_spy", "context", "63", 64, "close", "adj", "beta"),
    Metric("corr_63_spy", "context", "63", 64, "close", "adj", "correlation"),
    Metric("resid_ret_21_spy", "context", "21", 64, "close", "adj", "ratio"),
    Metric("resid_ret_63_spy", "context", "63", 64, "close", "adj", "ratio"),
    Metric("idio_vol_63_spy", "context", "63", 64, "close", "adj", "annualized"),
    Metric("rel_ret_21", "context", "21", 22, "close", "adj", "ratio"),
    Metric("rel_ret_63", "context", "63", 64, "close", "adj", "ratio"),
    Metric("tracking_etf", "context", "63", 64, "close", "adj", "symbol"),
    Metric("tracking_corr_63", "context", "63", 64, "close", "adj", "correlation"),
    Metric("tracking_beta_63", "context", "63", 64, "close", "adj", "beta"),
    Metric("resid_ret_21_tracking", "context", "21", 64, "close", "adj", "ratio"),
    Metric("resid_ret_63_tracking", "context", "63", 64, "close", "adj", "ratio"),
    Metric("idio_vol_63_tracking", "context", "63", 64, "close", "adj", "annualized"),
    Metric("resid_z_spy", "context", "63", 65, "close", "adj", "sigma"),
    Metric("resid_z_vadj_spy", "context", "63", 65, "close", "adj", "sigma"),
    Metric("yz_vol_21d", "volatility", "21", 22, "close", "adj", "annualized"),
    Metric("range_med_21d", "surprise", "21", 22, "close", "adj", "ratio"),
    Metric("range_surprise", "surprise", "21", 22, "close", "adj", "ratio"),
    Metric("ret_z_21d", "surprise", "21", 22, "close", "adj", "sigma"),
    Metric("ret_z_vadj_21d", "surprise", "21", 22, "close", "dollar", "sigma"),
    Metric("ret_pctile_252d", "surprise", "252", 253, "close", "adj", "share"),
    Metric("ret_kurt_252d", "surprise", "252", 253, "close", "adj", "ratio"),
)
SESSION = (
    Metric("last_price", "session", "1", 1, "minute", "raw", "currency"),
    Metric("cum_dollar_volume", "session", "all", 1, "minute", "dollar", "currency"),
    Metric("minutes_since_open", "session", "all", 1, "minute", "raw", "bars"),
    Metric("session_fraction", "session", "all", 1, "minute", "raw", "share"),
    Metric("gap_at_open", "session", "1", 1, "minute", "adj", "ratio"),
    Metric("session_ret", "session", "all", 1, "minute", "raw", "ratio"),
    Metric("ret_from_prev_close", "session", "all", 1, "minute", "adj", "ratio"),
    Metric("vwap_dist", "session", "all", 1, "minute", "raw", "ratio"),
    Metric("session_range_pos", "session", "all", 1, "minute", "raw", "ratio"),
    Metric("session_high_dist", "session", "all", 1, "minute", "raw", "ratio"),
    Metric("session_low_dist", "session", "all", 1, "minute", "raw", "ratio"),
    Metric("range_pct_so_far", "session", "all", 1, "minute", "adj", "ratio"),
    Metric("ret_30m", "session", "30", 31, "minute", "raw", "ratio"),
    Metric("ret_60m", "session", "60", 61, "minute", "raw", "ratio"),
    Metric("session_vol", "session", "all", 22, "minute", "raw", "annualized"),
    Metric("up_minutes_share", "session", "all", 22, "minute", "raw", "share"),
    Metric("rvol_pace", "session", "all", 1, "minute", "dollar", "ratio"),
)
#: Candidates for the tracking ETF, the market's first.
CONTEXT_ETFS = ("SPY", "QQQ", "IWM", "DIA", "XLK", "XLF", "XLE", "XLV", "XLI", "XLY", "XLP", "XLB", "XLRE", "XLU", "XLC", "SMH", "XBI", "KRE", "XOP")


DAILY_BY_ID = {m.id: m for m in DAILY}
#: Metrics for which an absent value means that nothing is known to have happened or to come.
NO_EVENT_IDS = ("days_since_split", "days_since_dividend", "declared_ex_days")


def long_rows(metrics: tuple[Metric, ...], value, bars, reason) -> Column:
    """Array of structs, one for each metric; the arguments give columns for a metric."""
    return F.array(*[F.struct(F.lit(m.id).alias("id"), F.lit(m.family).alias("family"), *value(m), bars(m).cast("long").alias("bars_available"), reason(m).alias("reason"), F.lit(m.unit).alias("unit")) for m in metrics])
