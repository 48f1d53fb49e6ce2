"""Cross-section of one day, ordered by surprise."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions.columns import ratio, safe_ln, valid_at, when_idx
from basalt.functions.text import clamp, one_of
from basalt.operators.context import BASELINE, pair_returns, residuals, resolve_symbols

SORTS = ("resid_z", "ret_z", "ret_z_vadj", "range_surprise")
LOOKBACK_DAYS = 500
LIMIT, MOST = 50, 500


def scores(market, t: dt.date, scope: str, snapshot: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """Scores of every instrument of the scope that traded on T, and whether there is a baseline.

    ``snapshot``: adjusted bars to read instead of computing them; consecutive
    ratios do not depend on its anchor.
    """
    since = t - dt.timedelta(days=LOOKBACK_DAYS - 1)
    bars = snapshot if snapshot is not None else market.adjusted("split_dividend", t, since=since)
    ids = market.instruments.filter(F.col("primary_market_scope") == scope).select("instrument_id")
    day = F.col("market_date")
    bars = bars.filter((day <= F.lit(t)) & (day >= F.lit(since))).join(ids, "instrument_id", "left_semi")
    w = Window.partitionBy("instrument_id").orderBy(F.desc("market_date"))
    prev = F.lead("close").over(w)
    base = bars.select(
        "instrument_id", "market_date", (F.row_number().over(w) - 1).alias("idx"), F.max("market_date").over(Window.partitionBy("instrument_id")).alias("last"),
        (F.col("close") / F.col("cum_price_factor") * ratio("volume", "cum_volume_factor")).alias("dv"), safe_ln(ratio("close", prev)).alias("lr"), ratio(F.col("high") - F.col("low"), prev).alias("rel_range"), F.pow(safe_ln(ratio("high", "low")), F.lit(2.0)).alias("park"),
    )
    spy = resolve_symbols(market, (BASELINE,), t, scope).select("instrument_id").first()
    traded = base.filter(F.col("last") == F.lit(t))
    traded = traded.withColumn("lr0", F.first("lr").over(Window.partitionBy("instrument_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    n = lambda c: F.count(when_idx(c, 1, 21))
    a = traded.groupBy("instrument_id").agg(
        F.max("lr0").alias("lr0"), F.max(when_idx("dv", 0)).alias("dv0"), F.avg(when_idx("dv", 1, 21)).alias("adv"), n("dv").alias("adv_n"), F.sqrt(F.avg(when_idx("park", 1, 21)) / (4 * math.log(2))).alias("park"), n("park").alias("park_n"),
        F.max(when_idx("rel_range", 0)).alias("range0"), F.median(when_idx("rel_range", 1, 21)).alias("range_med"), n("rel_range").alias("range_n"), F.count(when_idx("lr", 1, 252)).alias("n252"),
        F.count_if(F.col("idx").between(1, 252) & (F.col("lr") < F.col("lr0"))).alias("below"), F.count_if(F.col("idx").between(1, 252) & (F.col("lr") == F.col("lr0"))).alias("equal"),
    )
    if spy is not None:
        baseline = base.filter((F.col("instrument_id") == spy[0]) & F.col("lr").isNotNull()).select(F.lit(BASELINE).alias("symbol"), "market_date", F.col("lr").alias("b"))
        a = a.join(residuals(pair_returns(traded.filter("lr is not null"), baseline), ["instrument_id"]).select("instrument_id", "resid_z"), "instrument_id", "left")
    else:
        a = a.withColumn("resid_z", F.lit(None).cast("double"))
    adv = (F.col("adv_n") == 21) & (F.col("adv") > 0)
    z = F.when((F.col("park_n") == 21) & (F.col("park") > 0), F.col("lr0") / F.col("park"))
    out = a.select(
        "instrument_id", (F.exp("lr0") - 1).alias("ret_1d"), "resid_z", z.alias("ret_z"), F.when(adv & (F.col("dv0") > 0), z / F.sqrt(F.col("dv0") / F.col("adv"))).alias("ret_z_vadj"),
        F.when((F.col("range_n") == 21) & (F.col("range_med") > 0), F.col("range0") / F.col("range_med")).alias("range_surprise"), F.when(adv, F.col("dv0") / F.col("adv")).alias("rvol_21d"),
        F.when(F.col("n252") == 252, (F.col("below") + 0.5 * F.col("equal")) / 252.0).alias("ret_pctile_252d"), F.when(F.col("adv_n") == 21, F.col("adv")).alias("dollar_adv21"),
    )
    return out, spy is not None


def rank_at(market, scope: str, t: dt.date | None = None, sort: str | None = None, min_dollar_adv: float = 0, limit: int | None = None, snapshot: DataFrame | None = None, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """The ranked page (rank, instrument_id, scores, symbol, name) and a row of counts and gauges of the universe.

    The page comes from a top-k, not from a sorted list on one machine; ``whole``
    ranks every instrument that qualifies, whatever ``limit`` says, and numbers
    them in one task, a row for each instrument that traded on T. Each of the
    two is a plan of its own: who needs both may persist :func:`scores`.
    """
    if t is None:
        t = market.bars_daily.filter(F.col("market_scope") == scope).agg(F.max("market_date")).first()[0]
        if t is None:
            raise ValueError(f"no bars in {scope}")
    s, baseline = scores(market, t, scope, snapshot)
    sort = one_of(sort or ("resid_z" if baseline else "ret_z"), SORTS, "sort")
    if sort == "resid_z" and not baseline:
        raise ValueError(f"no market baseline in {scope}: sort by ret_z")
    s = s.withColumns({"has_sort": F.col(sort).isNotNull(), "liquid": F.coalesce("dollar_adv21", F.lit(0.0)) >= min_dollar_adv})
    good, k = F.col("has_sort") & F.col("liquid"), clamp(limit, LIMIT, 1, MOST)
    order, page = [F.desc(F.abs(sort)), F.col("instrument_id")], s.filter(good)
    page = page if whole else page.orderBy(*order).limit(k)
    page = page.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("has_sort", "liquid")
    valid = valid_at(F.lit(t), "valid_from", "valid_to")
    label = market.symbols.filter(valid).groupBy("instrument_id").agg(F.min("symbol").alias("symbol"))
    page = page.join(label, "instrument_id", "left").join(market.instruments.select("instrument_id", "name"), "instrument_id", "left")
    z = F.abs("ret_z")
    summary = s.agg(
        F.count(F.lit(1)).alias("traded_at_t"), F.count_if(good).alias("qualifying"), F.count_if(F.col("has_sort") & ~F.col("liquid")).alias("excluded_liquidity"), F.count_if(~F.col("has_sort")).alias("excluded_window"),
        F.median(F.when(good, z)).alias("median_abs_ret_z"), F.avg(F.when(good & z.isNotNull(), F.when(z > 2, 1.0).otherwise(0.0))).alias("share_abs_ret_z_gt2"),
    )
    return page, summary
