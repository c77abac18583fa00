"""Positions, portfolio statistics and bootstrap inference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def directional_signal(momentum: str, macro: str, alternative: str) -> str:
    """Majority of the signs of three tilts, as SQL text."""
    total = " + ".join(f"sign(coalesce({x}, 0))" for x in (momentum, macro, alternative))
    return f"sign({total})"


def daily_pnl(panel: DataFrame, cost_bps: float = 10.0) -> DataFrame:
    """(day, pnl, turnover): equal-weight mean over assets of yesterday's position times today's
    return, less the cost of changing it. panel (asset, day, ret, position)."""
    w = W.partitionBy("asset").orderBy("day")
    held = F.coalesce(F.lag("position").over(w), F.lit(0.0))
    rows = panel.withColumn("held", held).withColumn("turn", F.abs(F.col("held") - F.coalesce(F.lag("held", 1).over(w), F.lit(0.0))))
    return rows.groupBy("day").agg(F.avg(F.col("held") * F.col("ret") - F.col("turn") * cost_bps / 10_000).alias("pnl"), F.avg("turn").alias("turnover"))


def portfolio_stats(daily: DataFrame, risk_aversion: float = 5.0) -> DataFrame:
    """Sharpe ratio, certainty equivalent, worst drawdown and mean turnover of daily (day, pnl, turnover)."""
    one = W.orderBy("day")
    wealth = daily.withColumn("log_wealth", F.sum(F.ln(1 + F.col("pnl"))).over(one.rowsBetween(W.unboundedPreceding, 0)))
    wealth = wealth.withColumn("peak", F.greatest(F.lit(0.0), F.max("log_wealth").over(one.rowsBetween(W.unboundedPreceding, 0))))
    return wealth.agg(
        F.count("*").alias("days"), (F.coalesce(F.try_divide(F.avg("pnl"), F.stddev_samp("pnl")), F.lit(0.0)) * F.sqrt(F.lit(365.0))).alias("sharpe"),
        ((F.avg("pnl") - risk_aversion / 2 * F.var_samp("pnl")) * 365).alias("certainty_equivalent"),
        F.min(F.exp(F.col("log_wealth") - F.col("peak")) - 1).alias("max_drawdown"), F.avg("turnover").alias("turnover"),
    )


def block_indices(n: int, block: int, rng: np.random.Generator, stationary: bool = False) -> np.ndarray:
    """A resample of n places in blocks that wrap around; stationary blocks have random lengths of that mean."""
    if not stationary:
        starts = rng.integers(0, n, -(-n // block))
        return ((starts[:, None] + np.arange(block)) % n).ravel()[:n]
    fresh = rng.random(n) < 1 / block
    fresh[0] = True
    starts, run = rng.integers(0, n, n), np.arange(n)
    since = np.maximum.accumulate(np.where(fresh, run, 0))
    return (starts[since] + run - since) % n


def bootstrap_difference(daily: DataFrame, draws: int = 999, block: int = 5, seed: int = 7, stationary: bool = False) -> DataFrame:
    """(delta, p_value, low, high, days): is the mean of a above that of b? daily (day, a, b).

    The draws are dealt over the cluster; the daily curve they all resample has one row a
    day and goes to each task. Every draw has its own seed, so results do not depend on the
    tasks. Fewer than 20 days give NULL.
    """
    spark = daily.sparkSession
    curve = daily.orderBy("day").select("a", "b").toPandas().to_numpy()  # one row a day: 40 years are 15,000
    sent = spark.sparkContext.broadcast(curve[:, 0] - curve[:, 1] if len(curve) else np.zeros(0))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gap = sent.value
        for ids in batches:
            means = [gap[block_indices(len(gap), block, np.random.default_rng([seed, int(i)]), stationary)].mean() if len(gap) >= 20 else np.nan for i in ids["id"]]
            yield pd.DataFrame({"mean": means})

    delta = float(sent.value.mean()) if len(sent.value) >= 20 else None
    means = spark.range(draws).mapInPandas(draw, "mean double").where(~F.isnan("mean"))
    beyond = F.abs(F.col("mean") - F.lit(delta)) >= F.abs(F.lit(delta))
    return means.agg(
        F.lit(delta).alias("delta"), ((F.count_if(beyond) + 1) / (F.count("*") + 1)).alias("p_value"),
        F.expr("percentile(mean, 0.025D)").alias("low"), F.expr("percentile(mean, 0.975D)").alias("high"),
    ).select("delta", F.when(F.lit(delta is not None), F.col("p_value")).alias("p_value"), "low", "high", F.lit(len(sent.value)).alias("days"))


def event_study(panel: DataFrame, reach: int = 3) -> DataFrame:
    """(offset, mean_ret, n): mean return at each offset around event days. panel (asset, i, ret, event)."""
    events = panel.where("event").select("asset", F.col("i").alias("at"))
    around = events.withColumn("offset", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("i", F.col("at") + F.col("offset"))
    return around.join(panel.select("asset", "i", "ret"), ["asset", "i"]).groupBy("offset").agg(F.avg("ret").alias("mean_ret"), F.count("*").alias("n"))


def drop_one(panel: DataFrame, key: str, value: str) -> DataFrame:
    """(left_out, mean): the mean over all but one group at a time, from each group's sums."""
    sums = panel.groupBy(key).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    every = W.partitionBy(F.lit(1))
    rest = F.try_divide(F.sum("s").over(every) - F.col("s"), F.sum("n").over(every) - F.col("n"))
    return sums.select(F.col(key).alias("left_out"), rest.alias("mean"))
