"""Regimes, alerts and signals of series, from one windowed panel of each symbol.

A panel row is one bar: (symbol, open_time, i, back, n, ...); ``back`` is 0 for the newest of n
rows. Everything here is a conditional aggregate by symbol, which Spark combines map-side and plans on
the partitioning that the panel's window has made, so it adds no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def panel(bars: DataFrame) -> DataFrame:
    """bars with i, back, n, the log return r (0 for the first), the place s of the close between low and high (-1 to 1),
    and the running sum c of returns."""
    w = W.partitionBy("symbol").orderBy("open_time")
    r = F.coalesce(F.ln(F.col("close") / F.lag("close").over(w)), F.lit(0.0))
    s = F.coalesce(F.try_divide(2 * F.col("close") - F.col("high") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    out = bars.withColumns({"i": F.row_number().over(w), "n": F.count("*").over(W.partitionBy("symbol")), "r": r, "s": s})
    return out.withColumns({"back": F.col("n") - F.col("i"), "c": F.sum("r").over(w)})


def _when(c: Column, x: str | Column) -> Column:
    return F.when(c, F.col(x) if isinstance(x, str) else x)


def _between(first: int, last: int) -> Column:
    return F.col("back").between(first, last)


def _last(x: str) -> Column:
    return F.max(_when(F.col("back") == 0, x))


def clipped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


# Regimes -----------------------------------------------------------------------------------


def regimes(p: DataFrame, strength: DataFrame, crisis: float = -0.15, trending: float = 25.0) -> DataFrame:
    """(symbol, price_regime, confidence, volatility_regime, momentum_regime): from the deepest fall of summed returns, the last 20 returns'
    volatility, and strength (symbol, adx, rsi), which the indicator engine gives of a symbol's last bar; 0 and 50 where it gives none."""
    peak = F.max("c").over(W.partitionBy("symbol").orderBy("open_time"))
    p = p.withColumn("dd", F.col("c") - F.greatest(F.lit(0.0), peak))
    f = p.groupBy("symbol").agg(F.sum("r").alias("total"), F.min("dd").alias("dd"), F.stddev_samp(_when(F.col("back") < 20, "r")).alias("vol"))
    f = f.join(strength.select("symbol", "adx", "rsi"), "symbol", "left").fillna({"adx": 0.0, "rsi": 50.0})
    f = f.withColumn("year", F.coalesce(F.col("vol"), F.lit(0.0)) * F.sqrt(F.lit(365.0)))
    in_crisis, in_trend = F.col("dd") <= crisis, F.col("adx") >= trending
    return f.select(
        "symbol",
        F.when(in_crisis, "crisis").when(in_trend & (F.col("total") > 0), "trending_up").when(in_trend, "trending_down").otherwise("ranging").alias("price_regime"),
        F.when(in_crisis, F.least(F.lit(1.0), F.abs("dd") / 0.3)).when(in_trend, F.least(F.lit(1.0), F.col("adx") / 50)).otherwise(F.greatest(F.lit(0.3), 1 - F.col("adx") / trending)).alias("confidence"),
        F.when(F.col("year") < 0.3, "low").when(F.col("year") < 0.6, "normal").when(F.col("year") < 1.0, "high").otherwise("extreme").alias("volatility_regime"),
        F.when(F.col("rsi") >= 70, "strong_up").when(F.col("rsi") >= 55, "weak_up").when(F.col("rsi") >= 45, "neutral").when(F.col("rsi") >= 30, "weak_down").otherwise("strong_down").alias("momentum_regime"),
    )


def correlation_labels(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, corr) with the pair's label, and the label of all pairs' mean beside it."""
    size = F.abs("corr")
    mean = pairs.agg(F.avg("corr").alias("mean"))  # one row
    market = F.when(F.col("mean").isNull(), "unknown").when(F.col("mean") > 0.7, "high_correlation").when(F.col("mean") > 0.4, "moderate_correlation").when(F.col("mean") > 0.1, "low_correlation").otherwise("decorrelated")
    own = F.when(size >= 0.7, "high_corr").when(size >= 0.4, "moderate_corr").otherwise("decorrelated")
    return pairs.join(F.broadcast(mean), F.lit(True)).select("a", "b", "corr", own.alias("label"), market.alias("market"))


# Alerts ------------------------------------------------------------------------------------


def alerts(p: DataFrame, extreme: float = 0.001, broken: float = 0.4) -> DataFrame:
    """(symbol, rate_severity, rate_score, rate_z, break_severity, break_score): the newest rate r against fixed
    limits, and the mean of the last five correlations s against that of all before. No severity, no score."""
    prior = F.col("back") > 0
    f = p.groupBy("symbol").agg(
        F.count("*").alias("n"), _last("r").alias("x"), F.avg(_when(prior, "r")).alias("mean"), F.stddev_samp(_when(prior, "r")).alias("sd"),
        F.avg(_when(F.col("back") < 5, "s")).alias("recent"), F.avg(_when(F.col("back") >= 5, "s")).alias("before"),
    )
    size, sd = F.abs("x"), F.when(F.coalesce("sd", F.lit(0.0)) == 0, 1e-4).otherwise(F.col("sd"))
    change = F.abs(F.col("recent") - F.coalesce("before", "recent"))
    rated = (F.col("n") >= 10) & (size >= extreme)
    moved = (F.col("n") >= 5) & (change >= broken)
    critical = size >= 3 * extreme
    return f.select(
        "symbol", F.when(rated, F.when(critical, "critical").otherwise("warning")).alias("rate_severity"),
        F.when(rated, F.least(F.when(critical, 1.0).otherwise(0.5), size / (5 * extreme))).alias("rate_score"), F.when(rated, (F.col("x") - F.col("mean")) / sd).alias("rate_z"),
        F.when(moved, F.when(change >= 0.6, "critical").otherwise("warning")).alias("break_severity"), F.when(moved, F.least(F.lit(1.0), change / 0.8)).alias("break_score"),
    )


def opposites(p: DataFrame) -> DataFrame:
    """(open_time, a, b, gap): unordered pairs of one bar's signals whose directions, the signs of r, are opposite."""
    side = p.where("r != 0").select("open_time", "symbol", "r")
    a, b = (side.select("open_time", F.col("symbol").alias(x), F.col("r").alias("r" + x)) for x in "ab")
    both = a.join(b, "open_time").where((F.col("a") < F.col("b")) & (F.signum("ra") != F.signum("rb")))
    return both.select("open_time", "a", "b", F.abs(F.col("ra") - F.col("rb")).alias("gap"))


# Sentiment against returns -------------------------------------------------------------------


def sentiment_signals(p: DataFrame) -> DataFrame:
    """(symbol, z, reversal, reversal_strength, momentum, momentum_strength, divergence, divergence_strength); a
    direction is null where there is no signal."""
    prior = F.col("back") > 0
    f = p.groupBy("symbol").agg(
        F.count("*").alias("n"), _last("s").alias("x"), F.avg(_when(prior, "s")).alias("mean"), F.stddev_samp(_when(prior, "s")).alias("sd"),
        F.avg(_when(_between(0, 4), "s")).alias("s5"), F.avg(_when(_between(5, 9), "s")).alias("s10"), F.sum(_when(_between(0, 4), "r")).alias("r5"), F.sum(_when(_between(5, 9), "r")).alias("r10"),
    )
    f = f.withColumn("z", (F.col("x") - F.col("mean")) / F.when(F.coalesce("sd", F.lit(0.0)) == 0, 0.1).otherwise(F.col("sd"))).withColumn("d", F.col("s5") - F.col("s10"))
    enough, ten = F.col("n") >= 20, F.col("n") >= 10
    reversal = F.when(enough & ((F.col("x") >= 0.7) | (F.col("z") >= 2)), "bearish").when(enough & ((F.col("x") <= -0.7) | (F.col("z") <= -2)), "bullish")
    momentum = F.when(ten & (F.col("d") > 0.1) & (F.col("r5") > 0.02) & (F.col("r10") > 0), "bullish").when(ten & (F.col("d") < -0.1) & (F.col("r5") < -0.02) & (F.col("r10") < 0), "bearish")
    divergence = F.when(ten & (F.col("r5") > 0.03) & (F.col("d") < -0.15), "bearish").when(ten & (F.col("r5") < -0.03) & (F.col("d") > 0.15), "bullish")
    f = f.withColumns({"reversal": reversal, "momentum": momentum, "divergence": divergence})
    twice = F.least(F.lit(1.0), 2 * F.abs("d"))
    return f.select(
        "symbol", "z", "reversal", F.when(F.col("reversal").isNotNull(), F.least(F.lit(1.0), F.abs("z") / 3)).alias("reversal_strength"),
        "momentum", F.when(F.col("momentum").isNotNull(), twice).alias("momentum_strength"), "divergence", F.when(F.col("divergence").isNotNull(), twice).alias("divergence_strength"),
    )


def lagged_correlations(p: DataFrame, most: int = 12) -> DataFrame:
    """(symbol, lag, corr) of s with r ``lag`` bars later, over all of -most to most; 0 for fewer than ten
    pairs. The shifts are windows on the panel's own partitioning, so no row is repeated."""
    w = W.partitionBy("symbol").orderBy("open_time")
    lags = range(-most, most + 1)
    shifted = p.select("symbol", "s", *(F.lead("r", k).over(w).alias(f"r{k + most}") if k >= 0 else F.lag("r", -k).over(w).alias(f"r{k + most}") for k in lags))
    one = lambda k: F.when(F.count(f"r{k + most}") >= 10, F.round(F.coalesce(F.nanvl(F.corr("s", f"r{k + most}"), F.lit(0.0)), F.lit(0.0)), 4)).otherwise(0.0)
    by = shifted.groupBy("symbol").agg(F.array(*(F.struct(F.lit(k).alias("lag"), one(k).alias("corr")) for k in lags)).alias("all"))
    return by.select("symbol", F.explode("all").alias("x")).select("symbol", "x.lag", "x.corr")


def lead(correlations: DataFrame, n: DataFrame) -> DataFrame:
    """(symbol, optimal_lag, direction, f_statistic, p_value, significant) from the strongest of lagged correlations;
    the first of equally strong ones."""
    best = correlations.groupBy("symbol").agg(F.max_by(F.struct("lag", "corr"), F.struct(F.abs("corr"), -F.col("lag"))).alias("x"))
    best = best.join(n, "symbol").select("symbol", "n", F.when(F.col("x.corr") == 0, 0).otherwise(F.col("x.lag")).alias("lag"), F.col("x.corr").alias("corr"))
    size = F.abs("corr")
    direction = F.when((F.col("lag") > 0) & (size > 0.2), "sentiment_leads_price").when((F.col("lag") < 0) & (size > 0.2), "price_leads_sentiment").when(size > 0.3, "bidirectional").otherwise("none")
    enough = F.col("n") >= 30
    square = F.col("corr") * F.col("corr")
    return best.select(
        "symbol", F.when(enough, F.col("lag")).otherwise(0).alias("optimal_lag"), F.when(enough, direction).otherwise("none").alias("direction"),
        F.when(enough & (square < 1), square / (1 - square) * (F.col("n") - 2)).otherwise(0.0).alias("f_statistic"),
        F.when(enough, F.greatest(F.lit(0.001), 1 - 2 * size)).otherwise(1.0).alias("p_value"), (enough & (size > 0.2) & (F.col("lag") != 0)).alias("significant"),
    )


# Venues and flow -----------------------------------------------------------------------------


def venue_statistics(closes: DataFrame, opportunity_bps: float = 5.0, window_minutes: int = 60) -> DataFrame:
    """(symbol, a, b, hours, avg_spread_bps, duration_seconds, frequency_per_hour, correlation, efficiency) of each pair of venues, from
    closes (symbol, venue, open_time, close); pairs with fewer than two common bars are left out."""
    a, b = (closes.select("symbol", "open_time", F.col("venue").alias(x), F.col("close").alias("c" + x)) for x in "ab")
    mid = (F.col("ca") + F.col("cb")) / 2
    both = a.join(b, ["symbol", "open_time"]).where("a < b").withColumn("bps", F.when(mid > 0, F.abs(F.col("ca") - F.col("cb")) / mid * 10_000).otherwise(0.0))
    open_ = F.col("bps") > opportunity_bps
    f = both.groupBy("symbol", "a", "b").agg(
        F.count("*").alias("hours"), F.avg("bps").alias("avg_spread_bps"), (F.unix_seconds(F.max("open_time").cast("timestamp")) - F.unix_seconds(F.min("open_time").cast("timestamp"))).alias("duration_seconds"),
        F.corr("ca", "cb").alias("r"), F.count_if(open_).alias("k"), F.avg(_when(open_, "bps")).alias("m"), F.max(_when(open_, "bps")).alias("top"),
    ).where("hours >= 2")
    loss = F.least(5.0 * F.col("k"), F.lit(50.0)) + F.least(F.col("m"), F.lit(30.0)) + F.least(F.greatest(F.col("top") - 50, F.lit(0.0)) / 2, F.lit(20.0))
    r = F.when(F.col("hours") >= 5, F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    often = (F.col("hours") / (window_minutes / 60)).alias("frequency_per_hour")
    return f.select("symbol", "a", "b", "hours", "avg_spread_bps", "duration_seconds", often, r.alias("correlation"), F.when(F.col("k") == 0, 100.0).otherwise(clipped(100 - loss, 0, 100)).alias("efficiency"))


def flow_states(hours: DataFrame) -> DataFrame:
    """(symbol, accumulation, distribution, imbalance, imbalance_percentile) from hours (symbol, open_time, buy, sell): the
    signs of the mean net flow and of the slope of its running sum, and the last hour's imbalance among all before it."""
    w = W.partitionBy("symbol").orderBy("open_time")
    h = hours.withColumns({"net": F.col("buy") - F.col("sell"), "i": F.row_number().over(w).cast("double"), "n": F.count("*").over(W.partitionBy("symbol"))})
    h = h.withColumns({"cvd": F.sum("net").over(w), "v": F.coalesce(F.try_divide(F.abs("net"), F.col("buy") + F.col("sell")), F.lit(0.0))})
    newest = h.where("i = n").select("symbol", F.col("v").alias("x"))
    f = h.join(newest, "symbol").groupBy("symbol").agg(
        F.avg("net").alias("flow"), F.regr_slope("cvd", "i").alias("slope"), F.first("x").alias("x"), F.first("n").alias("n"), F.count_if((F.col("i") < F.col("n")) & (F.col("v") <= F.col("x"))).alias("below")
    )
    state = lambda sign: F.coalesce((sign * F.col("flow") > 0) & (sign * F.col("slope") > 0), F.lit(False)).cast("int")
    return f.select("symbol", state(1).alias("accumulation"), state(-1).alias("distribution"), F.col("x").alias("imbalance"), F.coalesce(F.try_divide(100.0 * F.col("below"), F.col("n") - 1), F.lit(50.0)).alias("imbalance_percentile"))


def cascade_chain(clusters: DataFrame, initial: float) -> DataFrame:
    """(symbol, direction, total_usd): what liquidations of ``initial`` set off in clusters (distance_pct, total_size_usd), nearest
    first; the chain ends at the first that gives less than 1 % of its size. A side's clusters are its price bins, a fixed number."""
    near = F.array_sort(F.collect_list(_when((F.col("total_size_usd") > 0) & (F.col("distance_pct") > 0), F.struct("distance_pct", "total_size_usd"))))
    start = F.struct(F.lit(float(initial)).alias("total"), F.lit(float(initial)).alias("impact"), F.lit(False).alias("over"))

    def step(a: Column, x: Column) -> Column:
        got = F.exp(-x["distance_pct"] / 2) * F.least(a["impact"], x["total_size_usd"])
        ends = a["over"] | (got < 0.01 * x["total_size_usd"])
        return F.when(ends, F.struct(a["total"].alias("total"), a["impact"].alias("impact"), F.lit(True).alias("over"))).otherwise(
            F.struct((a["total"] + got).alias("total"), (got / 2).alias("impact"), F.lit(False).alias("over"))
        )

    return clusters.groupBy("symbol", "direction").agg(near.alias("near")).select("symbol", "direction", F.aggregate("near", start, step)["total"].alias("total_usd"))


def settlement_cycle(rates: DataFrame) -> DataFrame:
    """(symbol, settlement_hour, samples, avg_rate, std_rate, positive_share) of rates (symbol, ts, rate) by the nearest of
    0, 8 and 16 o'clock, the earlier of two; every symbol has all three hours."""
    near = F.array_min(F.transform(F.array(*(F.lit(h) for h in (0, 8, 16))), lambda h: F.struct(F.abs(h - F.hour("ts")), h.alias("h"))))["h"]
    by = rates.groupBy("symbol", near.alias("settlement_hour")).agg(F.count("*").alias("samples"), F.avg("rate").alias("m"), F.stddev_samp("rate").alias("sd"), F.avg(F.when(F.col("rate") > 0, 1.0).otherwise(0.0)).alias("up"))
    hours = rates.select("symbol").distinct().withColumn("settlement_hour", F.explode(F.array(*(F.lit(h) for h in (0, 8, 16)))))
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return hours.join(by, ["symbol", "settlement_hour"], "left").select("symbol", "settlement_hour", F.coalesce("samples", F.lit(0)).alias("samples"), zero("m", "avg_rate"), zero("sd", "std_rate"), zero("up", "positive_share"))


# Supply, portfolio and risk --------------------------------------------------------------------


def supply_pulse(hours: DataFrame, p: DataFrame) -> DataFrame:
    """(symbol, net_mint, smoothed, correlation): minted (buy) less burned (sell) over both in the last 24 hours before the symbol's newest bar, the changes smoothed with weight
    2 / (n + 1), and the pulse's correlation with returns of the same hours. hours (symbol, open_time, buy, sell)."""
    both = hours.join(p.select("symbol", "open_time", "r", "i", "back", "n"), ["symbol", "open_time"])
    net, gross = F.col("buy") - F.col("sell"), F.col("buy") + F.col("sell")
    alpha = 2.0 / (F.col("n") + 1)
    weight = F.when(F.col("i") == 1, F.pow(1 - alpha, F.col("n") - 1)).otherwise(alpha * F.pow(1 - alpha, "back"))
    newest = F.max("open_time").over(W.partitionBy("symbol"))
    both = both.withColumn("day", F.col("open_time") > newest - F.expr("INTERVAL 24 HOURS"))
    f = both.groupBy("symbol").agg(
        F.try_divide(F.sum(F.when(F.col("day"), net)), F.sum(F.when(F.col("day"), gross))).alias("net_mint"), F.sum(net * weight).alias("smoothed"), F.corr(F.coalesce(F.try_divide(net, gross), F.lit(0.0)), F.col("r")).alias("c")
    )
    return f.select("symbol", F.coalesce("net_mint", F.lit(0.0)).alias("net_mint"), "smoothed", F.coalesce(F.nanvl("c", F.lit(0.0)), F.lit(0.0)).alias("correlation"))


def dominant_venue(flows: DataFrame) -> DataFrame:
    """(symbol, venue, flow) of the venue with the largest flow; ties to the first name."""
    by = flows.groupBy("symbol", "venue").agg(F.sum("flow").alias("flow"))
    return by.groupBy("symbol").agg(F.min_by("venue", F.struct(-F.col("flow"), F.col("venue"))).alias("venue"), F.max("flow").alias("flow"))


def sectors(p: DataFrame, hours: int = 168) -> DataFrame:
    """(symbol, sector_return, volatility, momentum, phase) of the last week."""
    f = p.where(F.col("back") < hours).groupBy("symbol").agg(F.sum("r").alias("sector_return"), F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("volatility"))
    f = f.withColumn("momentum", F.when(F.col("volatility") > 0, F.col("sector_return") / F.col("volatility")).otherwise(0.0))
    up, m = F.col("sector_return") > 0, F.col("momentum")
    return f.withColumn("phase", F.when(up & (m > 0.5), "leading").when(up, "weakening").when(m > -0.5, "improving").otherwise("lagging"))


def diversification(p: DataFrame) -> DataFrame:
    """(ratio): the mean volatility of symbols in equal weights over that of their mean return; 0 if it has none."""
    own = p.groupBy("symbol").agg(F.stddev_samp("r").alias("v")).agg(F.avg("v").alias("v"))
    together = p.groupBy("open_time").agg(F.sum("r").alias("r"), F.first("k").alias("k")).agg(F.stddev_samp(F.col("r") / F.col("k")).alias("w"))
    return own.join(together, F.lit(True)).select(F.coalesce(F.try_divide("v", "w"), F.lit(0.0)).alias("ratio"))  # one row each


def depeg_probability(price: Column, volatility: Column, peg: float = 1.0) -> Column:
    """The two-sided tail of a deviation, by a polynomial for the normal one."""
    # Coefficients of the polynomial, from the constant up.
    coefficients = (0.3193815, -0.3565638, 1.781478, -1.821256, 1.330274)
    z = F.abs(price - peg) / peg / volatility
    t = 1 / (1 + 0.2316419 * z)
    poly = sum((c * F.pow(t, F.lit(k + 1.0)) for k, c in enumerate(coefficients)), F.lit(0.0))
    return F.when((volatility <= 0) | (price == peg), 0.0).otherwise(clipped(2 * 0.3989422804 * F.exp(-z * z / 2) * poly, 0, 1))


def systemic_risk(metrics: DataFrame) -> DataFrame:
    """(score) of metrics (covar_95, conditional_correlation, tail_beta), each against its extreme; 0 to 100."""
    part = lambda c, most: F.avg(F.least(F.abs(F.coalesce(c, F.lit(0.0))) / most, F.lit(1.0)))
    score = 100 * (0.4 * part("covar_95", 0.1) + 0.3 * part("conditional_correlation", 1.0) + 0.3 * part("tail_beta", 3.0))
    return metrics.agg(F.coalesce(clipped(score, 0, 100), F.lit(0.0)).alias("score"))


def predictive_power(p: DataFrame, lags: int = 5, sigma: float = 2.0) -> DataFrame:
    """(symbol, lag, r2, triggered): how much of r ``lag`` bars later s explains, and whether the newest s is an outlier."""
    w = W.partitionBy("symbol").orderBy("open_time")
    prior = F.col("back") > 0
    shifted = p.select("symbol", "s", "back", *(F.lead("r", k).over(w).alias(f"r{k}") for k in range(1, lags + 1)))
    r2 = lambda k: F.when(F.count(f"r{k}") >= 10, clipped(F.coalesce(F.nanvl(F.regr_r2(f"r{k}", "s"), F.lit(0.0)), F.lit(0.0)), 0, 1)).otherwise(0.0)
    f = shifted.groupBy("symbol").agg(
        F.array(*(F.struct(F.lit(k).alias("lag"), r2(k).alias("r2")) for k in range(1, lags + 1))).alias("all"), F.count("*").alias("n"), _last("s").alias("x"), F.avg(_when(prior, "s")).alias("m"), F.stddev_samp(_when(prior, "s")).alias("sd")
    )
    hit = (F.col("n") >= 10) & (F.col("sd") > 0) & (F.abs(F.col("x") - F.col("m")) / F.col("sd") >= sigma)
    return f.select("symbol", F.explode("all").alias("a"), F.coalesce(hit, F.lit(False)).alias("triggered")).select("symbol", "a.lag", "a.r2", "triggered")


# Screens -----------------------------------------------------------------------------------


def risk_level(year: Column) -> tuple[Column, Column]:
    """Score of 0 to 100 and label of a yearly volatility."""
    line = lambda base, low, width: F.round(base + (year - low) / width * 25, 1)
    score = F.when(year < 0.5, line(0, 0.0, 0.5)).when(year < 1, line(25, 0.5, 0.5)).when(year < 2, line(50, 1.0, 1.0)).otherwise(F.least(F.lit(100.0), line(75, 2.0, 2.0)))
    return score, F.when(year < 0.5, "low").when(year < 1, "medium").when(year < 2, "high").otherwise("extreme")


def series_summary(p: DataFrame) -> DataFrame:
    """(symbol, daily_vol, annual_vol, risk_score, risk_label, percentile, z, slope, trend, divergence, divergence_strength): the newest
    close among all closes, and the trends of closes and volumes by their highest values in both halves."""
    newest = p.where("back = 0").select("symbol", F.col("close").alias("x"))
    first, last = F.col("i") <= F.floor(F.col("n") / 2), F.col("i") > F.floor(F.col("n") / 2)
    f = p.join(newest, "symbol").groupBy("symbol").agg(
        F.count("*").alias("n"), F.first("x").alias("x"), F.coalesce(F.stddev_pop(_when(F.col("i") > 1, "r")), F.lit(0.0)).alias("hour"), F.avg("close").alias("m"), F.stddev_pop("close").alias("sd"),
        F.count_if(F.col("close") < F.col("x")).alias("below"), F.count_if(F.col("close") == F.col("x")).alias("equal"), F.regr_slope("close", F.col("i").cast("double")).alias("slope"),
        (F.max(_when(last, "close")) - F.max(_when(first, "close"))).alias("a"), (F.max(_when(last, "volume")) - F.max(_when(first, "volume"))).alias("b"),
    )
    f = f.withColumns({"daily_vol": F.col("hour") * F.sqrt(F.lit(24.0)), "slope": F.coalesce("slope", F.lit(0.0))}).withColumn("annual_vol", F.col("daily_vol") * F.sqrt(F.lit(365.0)))
    score, label = risk_level(F.col("annual_vol"))
    enough = F.col("n") >= 4
    kind = F.when(~enough, "insufficient_data").when((F.col("a") > 0) & (F.col("b") < 0), "bearish").when((F.col("a") < 0) & (F.col("b") > 0), "bullish").otherwise("none")
    return f.select(
        "symbol", "daily_vol", "annual_vol", score.alias("risk_score"), label.alias("risk_label"), (100 * (F.col("below") + 0.5 * F.col("equal")) / F.col("n")).alias("percentile"),
        F.coalesce(F.try_divide(F.col("x") - F.col("m"), "sd"), F.lit(0.0)).alias("z"), "slope",
        F.when((F.col("n") >= 3) & (F.col("slope") > 0.005), "improving").when((F.col("n") >= 3) & (F.col("slope") < -0.005), "declining").otherwise("stable").alias("trend"),
        kind.alias("divergence"), F.when(enough, F.abs(F.col("a") - F.col("b")) / (F.abs("a") + F.abs("b") + 1e-9)).otherwise(0.0).alias("divergence_strength"),
    )


def rankings(p: DataFrame, hours: int = 24) -> DataFrame:
    """(symbol, change, volume, volatility, mover_rank, volume_rank, risk_rank): the last day's change and volume and the last week's volatility;
    ranks over one row for each symbol, which are put in order in one task."""
    day, week = F.col("back") < hours, F.col("back") < 168
    f = p.groupBy("symbol").agg(F.sum(_when(day, "r")).alias("change"), F.sum(_when(day, "volume")).alias("volume"), F.coalesce(F.stddev_pop(_when(week, "r")), F.lit(0.0)).alias("volatility"))
    rank = lambda c: F.row_number().over(W.orderBy(c.desc(), F.col("symbol")))
    return f.withColumns({"mover_rank": rank(F.abs("change")), "volume_rank": rank(F.col("volume")), "risk_rank": rank(F.col("volatility"))})


def gaps(p: DataFrame, least_pct: float = 1.0) -> DataFrame:
    """(symbol, open_time, gap_pct, direction) of bars that open at least so far from the close before."""
    w = W.partitionBy("symbol").orderBy("open_time")
    gap = p.select("symbol", "open_time", ((F.try_divide("open", F.lag("close").over(w)) - 1) * 100).alias("gap_pct"))
    return gap.where(F.abs("gap_pct") >= least_pct).withColumn("direction", F.when(F.col("gap_pct") > 0, "up").otherwise("down"))


def liquidity_by_time(p: DataFrame) -> DataFrame:
    """(symbol, hour, weekday, bars, volume, range_pct): means by hour of the day, by day of the week (0: Monday) and over all; -1 stands for all."""
    rows = p.select("symbol", F.hour("open_time").alias("hour"), F.weekday("open_time").alias("weekday"), "volume", F.try_divide(F.col("high") - F.col("low"), "low").alias("range"))
    sets = rows.groupingSets([["symbol", "hour"], ["symbol", "weekday"], ["symbol"]], "symbol", "hour", "weekday")
    means = sets.agg(F.count("*").alias("bars"), F.avg("volume").alias("volume"), (100 * F.avg("range")).alias("range_pct"))
    return means.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("hour", "weekday")})


def large_trades(flow: DataFrame, percentile: float = 95.0) -> DataFrame:
    """(symbol, venue, open_time, largest_trade, avg_trade, trade_count, net_taker, threshold) of the bars of flow whose largest trade reaches the one at place
    int(n * percentile / 100) of the venue's bars, in order. Ranks come from a window, so a venue's bars spill rather than fill a task's memory."""
    rows = flow.select(
        "symbol", "venue", "open_time", F.coalesce("largest", F.lit(0.0)).alias("largest_trade"), ((F.col("buy_notional") + F.col("sell_notional")) / F.col("trades")).alias("avg_trade"),
        F.col("trades").alias("trade_count"), "net_taker",
    )
    w = W.partitionBy("symbol", "venue")
    ranked = rows.withColumns({"k": F.row_number().over(w.orderBy("largest_trade", "open_time")) - 1, "n": F.count("*").over(w)})
    at = F.col("k") == F.floor(F.col("n") * percentile / 100)
    marked = ranked.withColumn("threshold", F.max(F.when(at, F.col("largest_trade"))).over(w))
    return marked.where("largest_trade >= threshold").drop("k", "n")


def reversion_candidates(p: DataFrame, window: int = 50, threshold: float = 2.0) -> DataFrame:
    """(symbol, open_time, back, zscore, current_price, mean_price, deviation_pct, direction) of every bar whose close is that many deviations off the mean of the
    ``window`` closes up to it; the mean is what a reversion would reach. The symbols that are candidates now are the rows with back 0. Bars with fewer before them are left out."""
    w = W.partitionBy("symbol").orderBy("open_time").rowsBetween(1 - window, 0)
    near = p.withColumns({"held": F.count("*").over(w), "mean_price": F.avg("close").over(w), "sd": F.stddev_pop("close").over(w)}).where(F.col("held") == window)
    z = F.coalesce(F.try_divide(F.col("close") - F.col("mean_price"), "sd"), F.lit(0.0))
    found = near.withColumn("zscore", z).where(F.abs("zscore") >= threshold)
    return found.select(
        "symbol", "open_time", "back", "zscore", F.col("close").alias("current_price"), "mean_price", ((F.col("close") - F.col("mean_price")) / F.col("mean_price") * 100).alias("deviation_pct"),
        F.when(F.col("zscore") < 0, "oversold").otherwise("overbought").alias("direction"),
    )
