"""Residuals against a market baseline and against the best-tracking ETF.

All instruments are paired with all candidates in one plan. The candidates'
returns are a bounded table (at most 19 series), so they are broadcast; the
64 latest pairs of each (instrument, candidate) are kept by a window and all
figures come from one aggregation: residual moments are written as moments of
the two return series, so no second pass is needed.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions.columns import first_by, valid_at
from basalt.operators.series import log_returns
from basalt.plans.catalog import CONTEXT_ETFS

PAIRS = 63
BASELINE = "SPY"
#: Most rows of the candidates' returns that are broadcast (some 19 series of 50 years).
MAX_BROADCAST_ROWS = 500_000


def resolve_symbols(market, symbols: tuple[str, ...], t: dt.date, scope: str = "us_stocks") -> DataFrame:
    """symbol, instrument_id of the symbols valid on T: the primary one, then the one that began last."""
    s = market.symbols.filter((F.col("market_scope") == scope) & F.col("symbol").isin(*symbols) & valid_at(F.lit(t), "valid_from", "valid_to"))
    return first_by(s, ["symbol"], F.desc("is_primary"), F.desc_nulls_first("valid_from")).select("symbol", "instrument_id")


def residuals(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Figures of each key from its pairs (market_date, s, b), the 64 latest of them.

    bars, reason, beta, corr, resid_ret_21, resid_ret_63, idio_vol, rel_ret_21, rel_ret_63, resid_z.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("market_date"))
    p = pairs.withColumn("i", F.row_number().over(w) - 1).filter(F.col("i") <= PAIRS)
    now, before = F.col("i") < PAIRS, F.col("i") >= 1
    part = lambda c, where: F.when(where, F.col(c))
    a = p.groupBy(*keys).agg(
        F.count_if(now).alias("n"), F.count(F.lit(1)).alias("n_all"),
        F.var_samp(part("s", now)).alias("vs"), F.var_samp(part("b", now)).alias("vb"), F.covar_samp(part("s", now), part("b", now)).alias("c"),
        F.sum(part("s", F.col("i") < 21)).alias("s21"), F.sum(part("b", F.col("i") < 21)).alias("b21"), F.sum(part("s", now)).alias("s63"), F.sum(part("b", now)).alias("b63"),
        F.var_samp(part("s", before)).alias("pvs"), F.var_samp(part("b", before)).alias("pvb"), F.covar_samp(part("s", before), part("b", before)).alias("pc"),
        F.max(part("s", F.col("i") == 0)).alias("s0"), F.max(part("b", F.col("i") == 0)).alias("b0"),
    )
    full = F.col("n") >= PAIRS
    ok = full & (F.col("vb") > 0) & (F.col("vs") > 0)
    beta, pbeta = F.try_divide("c", "vb"), F.try_divide("pc", "pvb")
    sigma2 = lambda v, b, x, k: F.greatest(F.col(v) + k * k * F.col(b) - 2 * k * F.col(x), F.lit(0.0))
    before2 = sigma2("pvs", "pvb", "pc", pbeta)
    # a variance that is nothing but rounding is none
    z = F.when((F.col("n_all") == PAIRS + 1) & (F.col("pvb") > 0) & (before2 > 1e-12 * F.col("pvs")), (F.col("s0") - pbeta * F.col("b0")) / F.sqrt(before2))
    grow = lambda c: F.exp(c) - 1
    figures = {
        "beta": beta, "corr": F.col("c") / F.sqrt(F.col("vb") * F.col("vs")),
        "resid_ret_21": grow(F.col("s21") - beta * F.col("b21")), "resid_ret_63": grow(F.col("s63") - beta * F.col("b63")), "idio_vol": F.sqrt(sigma2("vs", "vb", "c", beta)) * math.sqrt(252),
        "rel_ret_21": grow(F.col("s21")) - grow(F.col("b21")), "rel_ret_63": grow(F.col("s63")) - grow(F.col("b63")), "resid_z": z,
    }
    reason = F.when(~full, "insufficient_window").when(~ok, "undefined_input")
    return a.select(*keys, (F.col("n") + 1).alias("bars"), reason.alias("reason"), *[F.when(ok, v).alias(k) for k, v in figures.items()])


def pair_returns(stocks: DataFrame, baselines: DataFrame) -> DataFrame:
    """Returns of each instrument beside those of each baseline (symbol, market_date, b) on the same date."""
    small = baselines if baselines.limit(MAX_BROADCAST_ROWS + 1).count() > MAX_BROADCAST_ROWS else F.broadcast(baselines)
    return stocks.select("instrument_id", "market_date", F.col("lr").alias("s")).join(small, "market_date")


def context_at(market, t: dt.date, candidates: tuple[str, ...] = CONTEXT_ETFS, ids: list[str] | None = None) -> DataFrame:
    """A row for each instrument: the context metrics, bars and reasons for the baseline and the tracking ETF."""
    lr = log_returns(market.adjusted("split_dividend", t))
    etfs = resolve_symbols(market, candidates, t).withColumnRenamed("instrument_id", "etf_id")
    base = lr.withColumnRenamed("instrument_id", "etf_id").join(F.broadcast(etfs), "etf_id").select("symbol", "market_date", F.col("lr").alias("b"))  # at most 19 rows
    stocks = lr if ids is None else lr.filter(F.col("instrument_id").isin(*ids))
    r = residuals(pair_returns(stocks, base), ["instrument_id", "symbol"])
    # one aggregation gives the baseline's figures and those of the best candidate: the most correlated, else the one with most bars
    named = lambda cols: F.struct(*[F.col(c).alias(n) for c, n in cols.items()])
    spy = named({"bars": "spy_bars", "reason": "spy_reason", "beta": "beta_63_spy", "corr": "corr_63_spy", "resid_ret_21": "resid_ret_21_spy", "resid_ret_63": "resid_ret_63_spy", "idio_vol": "idio_vol_63_spy", "rel_ret_21": "rel_ret_21", "rel_ret_63": "rel_ret_63", "resid_z": "resid_z_spy"})
    track = named({"bars": "tracking_bars", "reason": "tracking_reason", "symbol": "tracking_etf", "corr": "tracking_corr_63", "beta": "tracking_beta_63", "resid_ret_21": "resid_ret_21_tracking", "resid_ret_63": "resid_ret_63_tracking", "idio_vol": "idio_vol_63_tracking"})
    none = F.col("corr").isNull()
    order = F.struct(none.alias("none"), (-F.col("corr")).alias("corr"), F.when(none, -F.col("bars")).alias("bars"), "symbol")
    both = r.groupBy("instrument_id").agg(F.min_by(track, order).alias("t"), F.max_by(spy, F.when(F.col("symbol") == BASELINE, 1)).alias("s")).select("instrument_id", "t.*", "s.*")
    return both.withColumn("tracking_etf", F.when(F.col("tracking_corr_63").isNotNull(), F.col("tracking_etf")))
