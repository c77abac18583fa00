"""Several series at once: correlation, lead and lag, tails, portfolios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def safe_corr(a: str, b: str) -> Column:
    """Pearson correlation, 0 where a side is constant; covariance and deviations partially aggregate."""
    return F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0))


def log_returns(bars: DataFrame) -> DataFrame:
    """(symbol, open_time, r): the log return of each bar but a series' first."""
    w = W.partitionBy("symbol", "timeframe").orderBy("open_time")
    return bars.withColumn("r", F.ln(F.try_divide("close", F.lag("close").over(w)))).where("r is not null").select("symbol", "open_time", "r")


def correlation_matrix(df: DataFrame, key: str = "symbol", on: str = "open_time", value: str = "close") -> DataFrame:
    """(a, b, corr, n) of all ordered pairs of series on their common times. The join is on
    time, so it grows with the square of the number of series, which is the size of the answer, not with that of a series."""
    left = df.select(F.col(key).alias("a"), on, F.col(value).alias("x"))
    right = df.select(F.col(key).alias("b"), on, F.col(value).alias("y"))
    pairs = left.join(right, on).groupBy("a", "b").agg(safe_corr("x", "y").alias("corr"), F.count("*").alias("n"))
    return pairs.withColumn("corr", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "corr")))


def lead_lag(signal: DataFrame, price: DataFrame, on: str = "i", most: int = 24, least: int = 5) -> DataFrame:
    """(symbol, lag, corr, n): correlation of a signal with a price ``lag`` rows later; signal (symbol, i, x), price (symbol, i, y)."""
    moved = signal.withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn(on, F.col(on) + F.col("lag"))
    return moved.join(price, ["symbol", on]).groupBy("symbol", "lag").agg(safe_corr("x", "y").alias("corr"), F.count("*").alias("n")).where(F.col("n") >= least)


def best_lag(lags: DataFrame) -> DataFrame:
    """Of each symbol the lag of the largest absolute correlation, the smallest of equals."""
    best = F.max_by(F.struct("lag", "corr"), F.struct(F.abs("corr"), -F.col("lag"))).alias("b")
    return lags.groupBy("symbol").agg(best).select("symbol", "b.*")


def granger(series: DataFrame) -> DataFrame:
    """(symbol, n, f, p, significant, r2_own, r2_both): does x of the row before tell more about y than y's own past?
    series (symbol, i, x, y). Both regressions follow from sums that one pass gathers."""
    w = W.partitionBy("symbol").orderBy("i")
    rows = series.select("symbol", "y", F.lag("y").over(w).alias("p"), F.lag("x").over(w).alias("q")).where("p is not null")
    m = rows.groupBy("symbol").agg(
        F.count("*").alias("n"), F.var_pop("y").alias("yy"), F.var_pop("p").alias("pp"), F.var_pop("q").alias("qq"),
        F.covar_pop("p", "q").alias("pq"), F.covar_pop("p", "y").alias("py"), F.covar_pop("q", "y").alias("qy"),
    )
    det = F.col("pp") * F.col("qq") - F.col("pq") * F.col("pq")
    own = F.try_divide(F.col("py") * F.col("py"), "pp")
    both = F.when(F.abs(det) < 1e-12, own).otherwise((F.col("qq") * F.col("py") * F.col("py") - 2 * F.col("pq") * F.col("py") * F.col("qy") + F.col("pp") * F.col("qy") * F.col("qy")) / det)
    m = m.withColumns({"rss_own": F.col("n") * (F.col("yy") - own), "rss_both": F.col("n") * (F.col("yy") - both)})
    m = m.withColumn("f", F.coalesce(F.try_divide(F.col("rss_own") - F.col("rss_both"), F.col("rss_both") / (F.col("n") - 3)), F.lit(0.0)))
    m = m.withColumn("p", f_tail(F.col("f"), F.lit(1.0), F.col("n") - 3))
    return m.select("symbol", "n", "f", "p", (F.col("p") < 0.05).alias("significant"), F.try_divide(own, "yy").alias("r2_own"), F.try_divide(both, "yy").alias("r2_both"))


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0."""
    t = 1 / (1 + 0.2316419 * z)
    # Coefficients of the polynomial approximation.
    poly = F.lit(1.330274)
    for c in (-1.821256, 1.781478, -0.3565638, 0.3193815):
        poly = F.lit(c) + t * poly
    return 0.3989422804 * F.exp(-z * z / 2) * t * poly


def f_tail(f: Column, d1: Column, d2: Column) -> Column:
    """How likely a larger F is, by a cube-root normal approximation of the scaled statistic f * d1 / d2, to four digits: 1 where the
    statistic is not above what that expects, and without degrees of freedom."""
    scaled = F.pow(F.greatest(f, F.lit(0.0)) * d1 / d2, 1 / 3)
    spread = 2 / (9 * d2) + scaled * scaled * 2 / (9 * d1)
    z = (scaled - (1 - 2 / (9 * d2))) / F.sqrt(spread)
    none = (f <= 0) | (d1 <= 0) | (d2 <= 0)
    return F.when(none, 1.0).when(z <= 0, 1.0).otherwise(F.round(F.least(F.lit(1.0), normal_tail(F.abs(z))), 4))


def order_statistic(x: str, q: float, least: int = 0) -> Column:
    """The value at place int(q * n) of the sorted values, not interpolated."""
    values = F.sort_array(F.collect_list(x))
    return values[F.greatest(F.lit(least), F.least((F.size(values) * q).cast("int"), F.size(values) - 1))]


def tail_measures(pairs: DataFrame, key: list[str]) -> DataFrame:
    """CoVaR, tail beta and stress correlation of asset returns ra against market returns rm, by key."""
    # Thresholds in one pass; a join on the key brings them back.
    t = pairs.groupBy(*key).agg(
        F.count("*").alias("n"), order_statistic("rm", 0.05).alias("var_m"), order_statistic("rm", 0.05, 1).alias("tail_m"),
        (F.avg("ra") - 2 * F.stddev_samp("ra")).alias("stress_a"),
    )
    rows = pairs.join(t, key)
    tail, stress, below = F.col("rm") <= F.col("tail_m"), F.col("ra") <= F.col("stress_a"), F.col("rm") <= F.col("var_m")
    only = lambda c, x: F.when(c, F.col(x))
    agg = rows.groupBy(*key).agg(
        F.first("n").alias("n"), F.count_if(tail).alias("n_tail"), F.count_if(stress).alias("n_stress"),
        F.try_divide(F.covar_samp(only(tail, "ra"), only(tail, "rm")), F.var_samp(only(tail, "rm"))).alias("beta"),
        F.try_divide(F.covar_samp(only(stress, "ra"), only(stress, "rm")), F.stddev_samp(only(stress, "ra")) * F.stddev_samp(only(stress, "rm"))).alias("c"),
        F.sort_array(F.collect_list(only(below, "ra"))).alias("worst"),
    )
    return agg.select(
        *key, "n",
        F.when(F.col("n") >= 20, F.col("worst")[F.least((F.size("worst") * 0.05).cast("int"), F.size("worst") - 1)]).otherwise(0.0).alias("covar_95"),
        F.when((F.col("n") >= 20) & (F.col("n_tail") >= 5), F.coalesce("beta", F.lit(0.0))).otherwise(0.0).alias("tail_beta"),
        F.when((F.col("n") >= 10) & (F.col("n_stress") >= 5), F.coalesce("c", F.lit(0.0))).otherwise(0.0).alias("conditional_correlation"),
    )


def portfolio(weights: DataFrame, covariance: DataFrame) -> DataFrame:
    """(symbol, weight, risk_contribution, portfolio_vol, annualized_vol, var_95, var_99) from
    weights (symbol, weight) and covariance (a, b, cov)."""
    row = (
        covariance.join(weights.select(F.col("symbol").alias("b"), F.col("weight").alias("wb")), "b")
        .groupBy("a").agg(F.sum(F.col("cov") * F.col("wb")).alias("cov_w"))
        .join(weights.withColumnRenamed("symbol", "a"), "a")
    )
    vol = F.sqrt(F.greatest(F.sum(F.col("weight") * F.col("cov_w")).over(W.partitionBy(F.lit(1))), F.lit(0.0)))
    return row.withColumn("portfolio_vol", vol).select(
        F.col("a").alias("symbol"), "weight", F.coalesce(F.try_divide(F.col("weight") * F.col("cov_w"), "portfolio_vol"), F.lit(0.0)).alias("risk_contribution"), "portfolio_vol",
        (F.col("portfolio_vol") * F.sqrt(F.lit(365.0))).alias("annualized_vol"), (1.645 * F.col("portfolio_vol")).alias("var_95"), (2.326 * F.col("portfolio_vol")).alias("var_99"),
    )


def concentration(weights: DataFrame) -> DataFrame:
    hhi = F.sum(F.col("weight") * F.col("weight"))
    return weights.agg(hhi.alias("hhi"), F.coalesce(F.try_divide(F.lit(1.0), hhi), F.lit(0.0)).alias("effective_n"), F.max("weight").alias("max_weight"))
