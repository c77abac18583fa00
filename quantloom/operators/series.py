"""Statistics of single series: memory, volatility, surprises, drawdowns and changes.

Every operator is a window over the series' own order or an aggregate with partial sums; no
series is ever collected into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .temporal import as_of


def autocorrelation(series: DataFrame, most: int) -> DataFrame:
    """(symbol, lag, ac, n) of series (symbol, i, v) at lags 1 to ``most``: mean product of deviations of
    rows ``lag`` apart over the population variance, within -1 and 1; 0 for a constant series."""
    series = series.select("symbol", "i", "v")
    moments = series.groupBy("symbol").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("var"), F.count("*").alias("n"))
    centred = series.join(moments, "symbol").select("symbol", "i", (F.col("v") - F.col("mean")).alias("d"), "var", "n")
    earlier = centred.select("symbol", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("lag"), "i", F.col("d").alias("e"), "var", "n").withColumn("i", F.col("i") + F.col("lag"))
    ac = F.coalesce(F.try_divide(F.avg(F.col("d") * F.col("e")), F.first("var")), F.lit(0.0))
    pairs = earlier.join(centred.select("symbol", "i", "d"), ["symbol", "i"]).groupBy("symbol", "lag").agg(ac.alias("ac"), F.first("n").alias("n"))
    return pairs.withColumn("ac", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "ac")))


def half_life(series: DataFrame, most: int) -> DataFrame:
    """(symbol, half_life): the lag, between lags by a straight line, at which autocorrelation falls to
    one half; half the number of rows if it does not within ``most`` lags."""
    w = W.partitionBy("symbol").orderBy("lag")
    ac = autocorrelation(series, most).withColumn("before", F.coalesce(F.lag("ac").over(w), F.lit(1.0)))
    at = F.col("lag") - 1 + F.coalesce(F.try_divide(F.col("before") - 0.5, F.col("before") - F.col("ac")), F.lit(1.0))
    return ac.groupBy("symbol").agg(F.coalesce(F.min_by(at, F.when(F.col("ac") <= 0.5, F.col("lag"))), F.floor(F.first("n") / 2).cast("double")).alias("half_life"))


def numbered(df: DataFrame, on: str, value: str) -> DataFrame:
    """(symbol, i, back, n, v): rows of each series with their number, counted from its start and its end."""
    w = W.partitionBy("symbol").orderBy(on)
    rows = df.where(F.col(value).isNotNull()).select("symbol", F.row_number().over(w).cast("long").alias("i"), F.col(value).alias("v"), F.count("*").over(W.partitionBy("symbol")).alias("n"))
    return rows.withColumn("back", F.col("n") - F.col("i"))


def volatility_forecast(returns: DataFrame, window: int = 30, decay: float = 0.94, seed: int = 10) -> DataFrame:
    """(symbol, realized, ewma) of numbered returns, annualised: deviation of the last ``window``, and the
    exponentially weighted variance from the mean square of the first ``seed``. The recursion is
    a weighted sum, so it needs no ordered fold. Too few rows give 0."""
    square = F.col("v") * F.col("v")
    weight = F.when(F.col("i") <= seed, F.pow(F.lit(decay), F.col("n") - seed) / seed).otherwise((1 - decay) * F.pow(F.lit(decay), F.col("back")))
    sums = returns.groupBy("symbol").agg(F.first("n").alias("n"), F.stddev_samp(F.when(F.col("back") < window, F.col("v"))).alias("s"), F.sum(weight * square).alias("var"))
    year = F.sqrt(F.lit(365.0))
    return sums.select("symbol", F.when(F.col("n") >= window, F.col("s") * year).otherwise(0.0).alias("realized"), F.when(F.col("n") >= seed, F.sqrt("var") * year).otherwise(0.0).alias("ewma"))


def rate_model(rates: DataFrame) -> DataFrame:
    """(symbol, next, z, percentile, cumulative, reversion) of numbered rates: the next rate from
    the mean of all and of the last three, the last one's place among those before it, and the sum of the last 21."""
    last, prior = F.col("back") == 0, F.col("back") > 0
    newest = rates.where(last).select("symbol", F.col("v").alias("x"))
    sums = rates.join(newest, "symbol").groupBy("symbol").agg(
        F.first("n").alias("n"), F.first("x").alias("x"), F.avg("v").alias("mean"), F.avg(F.when(F.col("back") < 3, F.col("v"))).alias("recent"), F.avg(F.when(prior, F.col("v"))).alias("before"),
        F.stddev_samp(F.when(prior, F.col("v"))).alias("s"), F.count_if(prior & (F.col("v") <= F.col("x"))).alias("below"), F.sum(F.when(F.col("back") < 21, F.col("v"))).alias("cumulative"),
    )
    spread = F.when(F.coalesce("s", F.lit(0.0)) == 0, F.lit(1e-4)).otherwise(F.col("s"))
    sums = sums.withColumn("z", F.when(F.col("n") < 10, 0.0).otherwise((F.col("x") - F.col("before")) / spread))
    return sums.select(
        "symbol", F.when(F.col("n") < 10, F.col("x")).otherwise(0.3 * F.col("mean") + 0.7 * F.col("recent")).alias("next"), "z",
        F.when(F.col("n") < 10, 50.0).otherwise(100.0 * F.col("below") / (F.col("n") - 1)).alias("percentile"), "cumulative", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.col("z") / 4)).alias("reversion"),
    )


def surprise(series: DataFrame) -> DataFrame:
    """(symbol, surprise): deviations of the newest value from the mean of those before it; 0 where they are constant."""
    prior = F.when(F.col("back") > 0, F.col("v"))
    gap = F.max(F.when(F.col("back") == 0, F.col("v"))) - F.avg(prior)
    return series.groupBy("symbol").agg(F.coalesce(F.try_divide(gap, F.stddev_pop(prior)), F.lit(0.0)).alias("surprise"))


def max_drawdown(returns: DataFrame) -> DataFrame:
    """(symbol, drawdown): the deepest fall of the running sum of numbered returns below its peak so far, 0 included."""
    w = W.partitionBy("symbol").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    path = returns.withColumn("sum", F.sum("v").over(w)).withColumn("peak", F.greatest(F.lit(0.0), F.max("sum").over(w)))
    return path.groupBy("symbol").agg(F.min(F.col("sum") - F.col("peak")).alias("drawdown"))


def relative_strength(bars: DataFrame, benchmark: str) -> DataFrame:
    """(symbol, r1d, r3d, r7d, rs_7d, momentum, rank): returns over 24, 72 and 168 hourly closes, the last
    one's bar included, against those of the benchmark."""
    back = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("open_time")))
    recent = bars.withColumn("k", back).where("k <= 168")
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("close")))
    change = lambda k: F.try_divide(at(1), at(k)) - 1
    r = recent.groupBy("symbol").agg(change(24).alias("r1d"), change(72).alias("r3d"), change(168).alias("r7d"))
    base = r.where(F.col("symbol") == benchmark).select(F.col("r3d").alias("b3"), F.col("r7d").alias("b7"))
    # The benchmark is one row.
    out = r.where(F.col("symbol") != benchmark).join(F.broadcast(base)).withColumns({"rs_3d": F.try_divide("r3d", "b3"), "rs_7d": F.try_divide("r7d", "b7")})
    place = F.row_number().over(W.orderBy(F.desc_nulls_last("rs_7d"), "symbol"))  # one row for each symbol
    momentum = F.when(F.col("rs_7d") > F.col("rs_3d"), "rising").otherwise("falling")
    return out.select("symbol", "r1d", "r3d", "r7d", "rs_7d", momentum.alias("momentum"), place.alias("rank"))


def changes_since(series: DataFrame, seconds: list[int]) -> DataFrame:
    """series (symbol, ts, id, v) with ``change_<s>``: v less the latest value at or before ``s``
    seconds earlier; NULL if there is none."""
    out = series
    for s in seconds:
        moved = out.withColumnRenamed("ts", "now").withColumn("ts", F.col("now") - F.expr(f"INTERVAL {s} SECONDS"))
        past = series.select("symbol", "ts", F.col("v").alias("past"), F.col("id").alias("past_id"))
        found = as_of(moved, past, ["symbol"], "ts", ["past"], tiebreak="past_id").drop("ts", "gap_seconds").withColumnRenamed("now", "ts")
        out = found.withColumn(f"change_{s}", F.col("v") - F.col("past")).drop("past")
    return out


def liquidation_bars(events: DataFrame, width: str = "5 minutes") -> DataFrame:
    """(symbol, open_time, long_usd, short_usd, longs, shorts, largest) of events (symbol, ts, side, usd)."""
    usd = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("usd"))), F.lit(0.0))
    bars = events.groupBy("symbol", F.window(F.col("ts").cast("timestamp"), width).alias("w")).agg(
        usd("long").alias("long_usd"), usd("short").alias("short_usd"), F.count_if(F.col("side") == "long").alias("longs"), F.count_if(F.col("side") == "short").alias("shorts"), F.max("usd").alias("largest"),
    )
    return bars.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("open_time"), "long_usd", "short_usd", "longs", "shorts", "largest")


def crowding(signals: DataFrame) -> tuple[Column, Column]:
    """Aggregates over signals (name, strength): percent of signals on the majority's side, and the
    strongest signal of the other side."""
    up, down = F.count_if(F.col("strength") > 0), F.count_if(F.col("strength") < 0)
    score = F.coalesce(F.try_divide(100.0 * F.greatest(up, down), F.count("*")), F.lit(0.0))
    strongest = lambda c: F.max_by(F.when(c, F.col("name")), F.when(c, F.struct(F.abs("strength"), F.col("name"))))
    return score, F.when(up >= down, strongest(F.col("strength") < 0)).otherwise(strongest(F.col("strength") > 0))


def null_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, null_ratio, level) of each column: over 0.5 warns, over 0.8 is critical."""
    ratios = df.agg(*(F.coalesce(F.avg(F.col(c).isNull().cast("double")), F.lit(0.0)).alias(c) for c in columns))
    out = ratios.unpivot([], columns, "column", "null_ratio")
    return out.withColumn("level", F.when(F.col("null_ratio") > 0.8, "critical").when(F.col("null_ratio") > 0.5, "warning").otherwise("ok"))
