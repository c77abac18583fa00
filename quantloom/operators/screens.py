"""Screens over all symbols: scores of several factors, price levels, divergences, squeezes, carry and ranked signals.

Every screen reads the same features, which one aggregate takes from each symbol's last bars: no window, no list, and any number of screens for one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BARS = 168


def features(p: DataFrame, funding: DataFrame, bars: int = BARS) -> DataFrame:
    """One row a symbol from p (symbol, open_time, close, volume, back, n: bars back from the newest, and their number) and funding (symbol, funding_rate): n and closes
    of the last ``bars`` bars, by how far back they are."""
    near = p.where(F.col("back") < bars)
    within = lambda first, last, x: F.when(F.col("back").between(first, last - 1), x)
    close, volume = F.col("close"), F.col("volume")
    inside = F.col("back") < F.least("n", F.lit(bars)) - 1  # all but the first have a bar before them
    at = lambda back: F.max(F.when(F.col("back") == back, close))
    f = near.groupBy("symbol").agg(
        F.count("*").alias("n"), at(0).alias("price"), at(9).alias("price_10"), at(13).alias("price_14"), at(19).alias("price_20"),
        F.avg(within(0, 20, close)).alias("ma20"), F.stddev_pop(within(0, 20, close)).alias("sd20"), F.avg(within(0, 50, close)).alias("ma50"),
        F.min(within(0, 50, close)).alias("support"), F.max(within(0, 50, close)).alias("resistance"), F.max(close).alias("high"),
        F.max(within(0, 10, close)).alias("high_10"), F.max(within(10, 20, close)).alias("high_20"), F.avg(within(0, 5, volume)).alias("volume_5"), F.avg(within(0, 20, volume)).alias("volume_20"),
        F.avg(within(0, 10, volume)).alias("volume_recent"), F.avg(within(10, 20, volume)).alias("volume_before"),
        F.avg(F.when(inside & (F.col("back") < 14), F.abs(F.col("step")))).alias("atr14"), F.coalesce(F.stddev_pop(F.when(inside, F.col("r"))), F.lit(0.0)).alias("hourly_vol"),
    )
    f = f.withColumns({"daily_vol": F.col("hourly_vol") * 24**0.5, "annual_vol": F.col("hourly_vol") * (24 * 365) ** 0.5})
    return f.join(funding.select("symbol", "funding_rate"), "symbol", "left")


def _percent(now: Column, before: Column) -> Column:
    return F.try_divide(now - before, before) * 100


def _score(x: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), x)), 1)


def multi_factor_scores(f: DataFrame) -> DataFrame:
    """(symbol, trend, momentum, flow, sentiment, volatility, value, composite, signal): six scores of 0 to 100, 50 where there are too few bars."""
    enough = lambda n, x: F.when(F.col("n") >= n, x).otherwise(50.0)
    rate = F.coalesce("funding_rate", F.lit(0.0))
    ratio = F.when(F.col("volume_20") > 0, F.col("volume_5") / F.col("volume_20")).otherwise(1.0)
    scores = {
        "trend": enough(50, 50 + _percent(F.col("price"), F.col("ma50")) * 5), "momentum": enough(14, 50 + _percent(F.col("price"), F.col("price_14")) * 3), "flow": enough(20, ratio * 50),
        "sentiment": 50 + rate * 5000, "volatility": 100 - F.col("annual_vol") * 30, "value": 50 - _percent(F.col("price"), F.col("high")) * 2,
    }
    out = f.select("symbol", *(_score(x).alias(n) for n, x in scores.items()))
    mean = F.round(sum((F.col(n) for n in scores), F.lit(0.0)) / len(scores), 1)
    c = F.col("composite")
    signal = F.when(c > 75, "strong_buy").when(c > 60, "buy").when(c > 40, "neutral").when(c > 25, "sell").otherwise("strong_sell")
    return out.withColumn("composite", mean).withColumn("signal", signal)


def entry_exit(f: DataFrame) -> DataFrame:
    """Price levels at which to enter, to take profit and to stop, from bands, true range and extremes; symbols with fewer than 20 bars are left out."""
    price, ma, sd, atr = (F.col(c) for c in ("price", "ma20", "sd20", "atr14"))
    return f.where("n >= 20").select(
        "symbol", price.alias("current_price"), (ma - 2 * sd).alias("aggressive_long"), (ma - sd).alias("conservative_long"), "support", (price + 2 * atr).alias("take_profit_1"), (ma + 2 * sd).alias("take_profit_2"), "resistance",
        (price - 1.5 * atr).alias("stop_tight"), (price - 2.5 * atr).alias("stop_normal"), (ma - 2 * sd - atr).alias("stop_wide"), "ma20", "atr14",
    )


def divergences(f: DataFrame) -> DataFrame:
    """(symbol, type, price_change_20h, funding_rate, severity): highs that volume does not follow, or a price against its funding, which counts before volume."""
    change = _percent(F.col("price"), F.col("price_20"))
    rate, recent, before = F.col("funding_rate"), F.col("volume_recent"), F.col("volume_before")
    kind = (
        F.when((rate > 0.001) & (change < -2), "bearish_funding").when((rate < -0.001) & (change > 2), "bullish_funding")
        .when((F.col("high_10") > F.col("high_20")) & (recent < before * 0.8), "bearish_volume").when((F.col("high_10") < F.col("high_20")) & (recent > before * 1.2), "bullish_volume")
    )
    found = f.where("n >= 20").select("symbol", kind.alias("type"), change.alias("price_change_20h"), "funding_rate").where("type IS NOT NULL")
    return found.withColumn("severity", F.when(F.abs("price_change_20h") > 5, "high").otherwise("medium"))


def squeezes(f: DataFrame, width: float = 5.0, momentum: float = 3.0) -> DataFrame:
    """(symbol, type, momentum_10h, bb_width_pct, funding_rate, severity): narrow bands, and a price that moves against those who pay the funding."""
    move, rate = _percent(F.col("price"), F.col("price_10")), F.col("funding_rate")
    bands = F.when(F.col("ma20") > 0, F.col("sd20") * 4 / F.col("ma20") * 100).otherwise(0.0)
    rows = f.where("n >= 20").select("symbol", F.coalesce(move, F.lit(0.0)).alias("momentum_10h"), bands.alias("bb_width_pct"), "funding_rate")
    tight, m = F.col("bb_width_pct") < width, F.col("momentum_10h")
    kind = F.when((rate < -0.0005) & (m > momentum) & tight, "short_squeeze").when((rate > 0.0005) & (m < -momentum) & tight, "long_squeeze")
    return rows.withColumn("type", kind).where("type IS NOT NULL").withColumn("severity", F.when(F.abs("momentum_10h") > 5, "high").otherwise("medium"))


def portfolio_signals(f: DataFrame) -> DataFrame:
    """(symbol, trend_score, momentum_10h, funding_rate, composite_signal, direction) of symbols with 20 bars; ranked by the signal, the ends are the candidates of either side."""
    trend, move = _percent(F.col("price"), F.col("ma20")), F.coalesce(_percent(F.col("price"), F.col("price_10")), F.lit(0.0))
    rows = f.where("n >= 20").select("symbol", trend.alias("trend_score"), move.alias("momentum_10h"), "funding_rate")
    whole = 0.4 * F.col("trend_score") + 0.4 * F.col("momentum_10h") + F.coalesce("funding_rate", F.lit(0.0)) * 400
    return rows.withColumn("composite_signal", whole).withColumn("direction", F.when(F.col("composite_signal") > 0, "long").otherwise("short"))


def strategy_by_regime(f: DataFrame) -> DataFrame:
    """(symbol, regime, vol_regime, position_sizing): by how far the price is from its mean of 50 bars, and by its volatility; unknown with fewer bars."""
    away, vol = _percent(F.col("price"), F.col("ma50")), F.col("annual_vol")
    regime = F.when(F.col("n") < 50, "unknown").when(away > 10, "euphoria").when(away > 3, "trending_up").when(away < -10, "panic").when(away < -3, "trending_down").otherwise("ranging")
    return f.select(
        "symbol", regime.alias("regime"), F.when(vol > 1, "high").when(vol > 0.5, "medium").otherwise("low").alias("vol_regime"),
        F.when(vol > 1.5, "reduce").when(vol > 0.5, "normal").otherwise("increase").alias("position_sizing"),
    )


def funding_carry(f: DataFrame, least: float = 0.0005) -> DataFrame:
    """(symbol, funding_rate, annualized_yield, direction, risk) of rates of at least ``least`` on either side, paid three times a day."""
    rate = F.col("funding_rate")
    return f.where(F.abs(rate) >= least).select(
        "symbol", "funding_rate", (rate * 3 * 365).alias("annualized_yield"), F.when(rate > 0, "short_perp_long_spot").otherwise("long_perp_short_spot").alias("direction"),
        F.when(F.abs(rate) < 0.001, "low").when(F.abs(rate) < 0.003, "medium").otherwise("high").alias("risk"),
    )
