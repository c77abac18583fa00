"""Bars: tumbling aggregation, merging over venues, roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIMEFRAMES = {"minute": "1m", "hour": "1h", "day": "1d"}


def micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970; of a time without a zone, by its own clock, whatever the session's zone."""
    if dict(df.dtypes)[ts] == "timestamp":
        return F.unix_micros(ts)
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts))


def tumble(trades: DataFrame, unit: str = "hour", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """OHLCV bars of trades (symbol, ts, event_id, price, amount). Ties in time are ordered by
    event_id. One partial aggregate before the only exchange; no sort: time and id are one
    number, since an aggregate that keeps a struct would not be a hash aggregate."""
    when = (micros(trades, "ts").cast("decimal(18,0)") * F.lit(str(10**19)).cast("decimal(20,0)") + F.col("event_id")).cast("decimal(38,0)")
    return (
        trades.groupBy(*keys, F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("open_time"))
        .agg(
            F.min_by("price", when).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", when).alias("close"), F.sum("amount").alias("volume"),
        )
        .select(*keys, F.lit(TIMEFRAMES[unit]).alias("timeframe"), "open_time", "open", "high", "low", "close", "volume")
    )


def roll_up(bars: DataFrame, unit: str = "day") -> DataFrame:
    """Coarser bars from finer ones."""
    return (
        bars.groupBy("symbol", F.date_trunc(unit, "open_time").cast("timestamp_ntz").alias("bucket"))
        .agg(
            F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", "open_time").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("bars"),
        )
    )


def merge_venues(bars: DataFrame) -> DataFrame:
    """One bar from those of several venues: open and close weighted by volume (equally if
    there is none), and which venues there are. Rows with a missing price or volume are left out."""
    weight = F.greatest(F.col("volume"), F.lit(0.0))
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * weight), F.sum(weight)), F.avg(c)).alias(c)
    return (
        bars.dropna(subset=["open", "high", "low", "close", "volume"])
        .groupBy("symbol", "timeframe", "open_time")
        .agg(
            mean("open"), F.max("high").alias("high"), F.min("low").alias("low"), mean("close"), F.sum("volume").alias("volume"),
            F.count_distinct("venue").alias("exchange_count"), F.array_join(F.array_sort(F.collect_set("venue")), ",").alias("source_exchanges"),
        )
    )


def trade_flow(trades: DataFrame, unit: str = "hour") -> DataFrame:
    """Bars of taker flow: counts and notional by side; trades without side or notional count as invalid."""
    notional = F.when(F.col("price") * F.col("amount") >= 0, F.col("price") * F.col("amount"))
    buy, sell = ((F.col("side") == s) & notional.isNotNull() for s in ("buy", "sell"))
    sums = lambda c: F.coalesce(F.sum(F.when(c, notional)), F.lit(0.0))
    return (
        trades.groupBy("symbol", "venue", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("open_time"))
        .agg(
            F.count_if(buy | sell).alias("trades"), F.count_if(~F.coalesce(buy | sell, F.lit(False))).alias("invalid"), sums(buy).alias("buy_notional"), sums(sell).alias("sell_notional"),
            (sums(buy) - sums(sell)).alias("net_taker"), F.max(F.when(buy | sell, notional)).alias("largest"),
        )
        .where("trades > 0")
        .withColumn("aggressive_buy_share", F.try_divide("buy_notional", F.col("buy_notional") + F.col("sell_notional")))
    )
