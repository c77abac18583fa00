"""Trade flow, order books, arbitrage and liquidations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def vpin(trades: DataFrame, bucket: float = 50.0) -> DataFrame:
    """(symbol, vpin, buckets): mean imbalance of full volume buckets, 0 without any. A trade that crosses a
    bucket's edge is split; the unfinished last bucket is dropped. trades (symbol, ts, event_id, amount, side)."""
    w = W.partitionBy("symbol").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    spans = trades.where("amount > 0").withColumn("to", F.sum("amount").over(w)).withColumn("from", F.col("to") - F.col("amount"))
    first, last = F.floor(F.col("from") / bucket), F.ceil(F.col("to") / bucket) - 1
    parts = spans.withColumn("bucket", F.explode(F.sequence(first, F.greatest(first, last))))
    part = F.least("to", (F.col("bucket") + 1) * bucket) - F.greatest("from", F.col("bucket") * bucket)
    signed = F.when(F.col("side") == "buy", part).otherwise(-part)
    gap = F.when(F.sum(part) >= bucket - 1e-9, F.abs(F.sum(signed)))
    return parts.groupBy("symbol", "bucket").agg(gap.alias("gap")).groupBy("symbol").agg(F.coalesce(F.avg("gap") / bucket, F.lit(0.0)).alias("vpin"), F.count("gap").alias("buckets"))


def classify_flow(trades: DataFrame) -> DataFrame:
    """Trades of at least twice the mean size are informed; their share of the volume, and that of the
    others; a direction needs a 1.2 times larger side. Without volume all is retail."""
    mean = trades.groupBy("symbol").agg(F.avg("amount").alias("mean"))
    informed = F.col("amount") >= 2 * F.col("mean")
    side = lambda s: F.coalesce(F.sum(F.when(informed & (F.col("side") == s), F.col("amount"))), F.lit(0.0))
    return (
        trades.join(mean, "symbol").groupBy("symbol").agg(F.count("*").alias("trades"), F.count_if(informed).alias("informed"), side("buy").alias("buy"), side("sell").alias("sell"), F.sum("amount").alias("total"))
        .withColumn("informed_ratio", F.coalesce(F.try_divide(F.col("buy") + F.col("sell"), "total"), F.lit(0.0))).withColumn("retail_ratio", 1 - F.col("informed_ratio"))
        .withColumn("direction", F.when(F.col("buy") > 1.2 * F.col("sell"), "buy").when(F.col("sell") > 1.2 * F.col("buy"), "sell").otherwise("neutral")).drop("total")
    )


def spread_bps(a: Column, b: Column) -> Column:
    mid = (a + b) / 2
    return F.when(mid > 0, F.abs(a - b) / mid * 10_000).otherwise(0.0)


def arbitrage(prices: DataFrame, least_bps: float = 5.0, fee_bps: float = 1.0, volume: float = 10_000.0) -> DataFrame:
    """Pairs of venues whose prices (symbol, venue, price) differ: where to buy and sell, and the
    profit after both fees. One row for each venue and symbol is expected, so pairs are few."""
    a, b = (prices.where("price > 0").select("symbol", F.col("venue").alias(f"venue_{x}"), F.col("price").alias(f"price_{x}")) for x in "ab")
    pairs = a.join(b, "symbol").where("venue_a < venue_b").withColumn("bps", spread_bps(F.col("price_a"), F.col("price_b"))).where(F.col("bps") >= least_bps)
    cheaper = F.col("price_a") < F.col("price_b")
    return pairs.select(
        "symbol", "venue_a", "venue_b", "bps", F.when(cheaper, F.col("venue_a")).otherwise(F.col("venue_b")).alias("buy"), F.when(cheaper, F.col("venue_b")).otherwise(F.col("venue_a")).alias("sell"),
        F.greatest(F.lit(0.0), volume * (F.col("bps") - 2 * fee_bps) / 10_000).alias("profit"),
    )


def book_metrics(books: DataFrame) -> DataFrame:
    """Best prices, spread, depth and imbalance of books whose sides are arrays of (price, amount), best first."""
    total = lambda side: F.aggregate(side, F.lit(0.0), lambda s, x: s + x["price"] * x["amount"])
    bid, ask = F.col("bids")[0]["price"], F.col("asks")[0]["price"]
    out = books.withColumns({"best_bid": bid, "best_ask": ask, "bid_depth": total("bids"), "ask_depth": total("asks")})
    out = out.withColumn("mid", (F.col("best_bid") + F.col("best_ask")) / 2)
    return out.withColumns({
        "spread_bps": F.try_divide(F.col("best_ask") - F.col("best_bid"), "mid") * 10_000,
        "imbalance": F.coalesce(F.try_divide(F.col("bid_depth") - F.col("ask_depth"), F.col("bid_depth") + F.col("ask_depth")), F.lit(0.0)),
    })


def slippage_bps(levels: Column, order: float) -> Column:
    """Cost over the first level's price of an order walked through levels (price, usd); 999 if none fills it."""
    start = F.struct(F.lit(0.0).alias("filled"), F.lit(0.0).alias("cost"))

    def step(s, x):
        take = F.greatest(F.lit(0.0), F.least(F.lit(order) - s["filled"], x["usd"]))
        return F.struct((s["filled"] + take).alias("filled"), (s["cost"] + take * x["price"]).alias("cost"))

    base = levels[0]["price"]
    walked = lambda s: F.when(s["filled"] > 0, F.abs(s["cost"] / s["filled"] - base) / base * 10_000).otherwise(999.0)
    return F.when((F.size(levels) == 0) | levels.isNull(), 0.0).otherwise(F.aggregate(levels, start, step, walked))


def depth_within(levels: Column, mid: Column, share: float) -> Column:
    """Amount of the levels within a share of the mid price."""
    return F.aggregate(F.filter(levels, lambda x: F.abs(x["price"] - mid) <= share * mid), F.lit(0.0), lambda s, x: s + x["amount"])


def liquidation_clusters(positions: DataFrame, price: Column, bins: int = 20) -> DataFrame:
    """Positions (symbol, direction, liquidation_price, size_usd, leverage) by equal price bins of
    each side. Bins are open above, so the highest price falls in none; a single price is one cluster."""
    side = W.partitionBy("symbol", "direction")
    p = positions.where("liquidation_price > 0").withColumns({"lo": F.min("liquidation_price").over(side), "hi": F.max("liquidation_price").over(side)})
    width = (F.col("hi") - F.col("lo")) / bins
    flat = F.col("hi") == F.col("lo")
    p = p.withColumn("bin", F.when(flat, 0).otherwise(F.floor(F.try_divide(F.col("liquidation_price") - F.col("lo"), width))).cast("int")).where(F.col("bin") < bins)
    level = F.when(F.first("hi") == F.first("lo"), F.first("lo")).otherwise(F.first("lo") + (F.col("bin") + 0.5) * (F.first("hi") - F.first("lo")) / bins)
    out = p.groupBy("symbol", "direction", "bin").agg(level.alias("price_level"), F.sum("size_usd").alias("total_size_usd"), F.avg("leverage").alias("leverage_avg"), F.count("*").alias("positions"))
    return out.withColumn("distance_pct", F.abs(F.col("price_level") - price) / price * 100)


def liquidation_heatmap(positions: DataFrame, price: float, range_pct: float = 10.0, bins: int = 20) -> DataFrame:
    """Long and short size in every bin around a price, empty bins too."""
    low, width = price * (1 - range_pct / 100), price * 2 * range_pct / 100 / bins
    grid = positions.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    size = lambda s: F.coalesce(F.sum(F.when((F.col("direction") == "long") == s, F.col("size_usd"))), F.lit(0.0))
    placed = positions.where("liquidation_price > 0").withColumn("bin", F.floor((F.col("liquidation_price") - low) / width).cast("int"))
    sums = placed.where(F.col("bin").between(0, bins - 1)).groupBy("bin").agg(size(True).alias("long_usd"), size(False).alias("short_usd"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return grid.join(sums, "bin", "left").select(
        "bin", (low + F.col("bin") * width).alias("price_from"), zero("long_usd").alias("long_usd"), zero("short_usd").alias("short_usd"), (zero("long_usd") - zero("short_usd")).alias("net_pressure")
    )


def volume_profile(bars: DataFrame, bins: int = 20, share: float = 0.7) -> DataFrame:
    """Volume by price bin of each symbol, its busiest bin, and the bins that hold ``share`` of the volume, busiest first."""
    ends = bars.groupBy("symbol").agg(F.min("low").alias("lo"), F.max("high").alias("hi"))
    binned = bars.join(ends, "symbol").withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(F.col("close") - F.col("lo"), (F.col("hi") - F.col("lo")) / bins), F.lit(0.0)))).cast("int"))
    sums = binned.groupBy("symbol", "bin").agg(F.sum("volume").alias("volume"))
    busiest = W.partitionBy("symbol").orderBy(F.desc("volume"), "bin")
    total = F.sum("volume").over(W.partitionBy("symbol"))
    before = F.coalesce(F.sum("volume").over(busiest.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return sums.select("symbol", "bin", "volume", (F.row_number().over(busiest) == 1).alias("is_poc"), (before < share * total).alias("in_value_area"))
