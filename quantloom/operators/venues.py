"""Pairs of venues: price gaps net of fees and slippage, quality flags, labels and scores.

align() puts a venue's book, fees, funding and the symbol's indicators beside each of its tickers. compare_venues()
takes what venues show of a symbol at ``as_of``: (symbol, venue, as_of) and any of OPTIONAL; what is not there counts as null.
Snapshots meet by an equi-join on symbol and time, so a pair costs one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .temporal import as_of as nearest_row
from .temporal import latest

_NUMBERS = """bid ask last mid spread_bps book_bid book_ask book_mid book_spread_bps bid_depth ask_depth depth_imbalance quote_volume funding mark index taker_fee maker_fee
rsi macd_hist atr_pct volatility adx zscore""".split()
OPTIONAL = {**dict.fromkeys(_NUMBERS, "double"), **dict.fromkeys(("ticker_ts", "book_ts", "funding_ts", "context_ts"), "timestamp_ntz")}


@dataclass(frozen=True)
class Limits:
    """Ages and windows in seconds, amounts in quote currency, distances in basis points."""

    ticker_age: int = 30
    book_age: int = 15
    funding_age: int = 21_600
    context_age: int = 21_600
    window: int = 5
    funding_window: int = 1800
    funding: bool = False
    context: bool = True
    fee: float = 0.001
    notional: float = 10_000.0
    least_net: float = 2.0
    divergence: float = 15.0
    anomaly: float = 35.0
    funding_divergence: float = 5.0
    buffer: float = 1.25
    thin: float = 0.75
    slippage: float = 25.0
    trend: float = 25.0
    atr_pct: float = 2.5
    zscore: float = 2.0


_BLOCKING = ("missing_ticker", "stale_ticker", "missing_orderbook", "stale_orderbook", "missing_bid_ask", "cross_exchange_ticker_gap")


def mean(*xs: Column) -> Column:
    """Of those that are there."""
    there = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in xs), F.lit(0))
    return sum((F.coalesce(x, F.lit(0.0)) for x in xs), F.lit(0.0)) / F.nullif(there, F.lit(0))


def bps(difference: Column, base: Column) -> Column:
    return F.when(base != 0, difference / base * 10_000)


def within(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def seconds(later: Column, earlier: Column) -> Column:
    """With its fraction: half a second past a limit is past it."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / 1e6


def flags(limits: Limits) -> Column:
    """Names of what is missing, stale or too far apart, in a fixed order."""
    found: list[Column] = []

    def add(name: str, test: Column) -> None:
        found.append(F.when(test, F.lit(name)))

    def age(name: str, column: str, most: int, side: str) -> None:
        when = F.col(f"{column}_{side}")
        add(f"missing_{name}_{side}", when.isNull())
        add(f"stale_{name}_{side}", seconds(F.col("as_of"), when) > most)

    def gap(name: str, column: str, most: int) -> None:
        add(f"cross_exchange_{name}_gap", F.abs(seconds(F.col(f"{column}_a"), F.col(f"{column}_b"))) > most)

    for name, column, most in (("ticker", "ticker_ts", limits.ticker_age), ("orderbook", "book_ts", limits.book_age)):
        for side in "ab":
            age(name, column, most, side)
    for side in "ab":
        add(f"missing_bid_ask_{side}", F.col(f"bid_{side}").isNull() | F.col(f"ask_{side}").isNull())
    gap("ticker", "ticker_ts", limits.window)
    gap("orderbook", "book_ts", limits.window)
    if limits.funding:
        for side in "ab":
            age("funding", "funding_ts", limits.funding_age, side)
        gap("funding", "funding_ts", limits.funding_window)
    if limits.context:
        add("missing_indicator_context", F.col("context_ts").isNull())
        add("stale_indicator_context", F.col("context_age") > limits.context_age)
    return F.array_compact(F.array(*found))


def slippage(sell: Column, buy: Column, spread: Column, limits: Limits) -> tuple[Column, Column]:
    """Expected slippage of the wanted notional through two books, and how often the thinner one holds it. A book that is not
    there holds nothing; without both there is no estimate."""
    multiple = F.least(sell, buy) / limits.notional
    pressure = lambda depth: F.greatest(limits.notional / F.greatest(F.coalesce(depth, F.lit(0.0)), F.lit(1e-9)) - 1, F.lit(0.0)) * 10
    short = F.when(multiple < limits.buffer, (limits.buffer - multiple) / max(limits.buffer, 0.1) * 8).otherwise(0.0)
    cost = F.coalesce(spread, F.lit(0.0)) * 0.15 + pressure(sell) + pressure(buy) + short
    return F.when(multiple.isNotNull(), within(cost, 0, 100)), multiple


def market_regime(limits: Limits) -> Column:
    strong = F.col("adx") >= limits.trend
    any_context = F.coalesce("rsi", "macd_hist", "atr_pct", "volatility", "adx", "zscore").isNotNull()
    return (
        F.when(strong & (F.col("macd_hist") > 0) & (F.col("rsi") >= 55), "trend_up").when(strong & (F.col("macd_hist") < 0) & (F.col("rsi") <= 45), "trend_down")
        .when(F.col("atr_pct") >= limits.atr_pct, "high_volatility").when(F.abs("zscore") >= limits.zscore, "stretched").when(F.col("volatility") >= 0.03, "high_volatility")
        .when(any_context, "range").otherwise("unknown")
    )


def funding_regime(limits: Limits) -> Column:
    if not limits.funding:
        return F.lit("not_applicable")
    far, total = F.abs("funding_diff_bps") >= limits.funding_divergence, F.col("funding_a") + F.col("funding_b")
    return (
        F.when(total.isNull(), "unknown").when(far & (F.col("funding_a") * F.col("funding_b") < 0), "funding_direction_conflict").when(far, "funding_divergence")
        .when(total > 0, "long_crowded").when(total < 0, "short_crowded").otherwise("neutral")
    )


def align(tickers: DataFrame, books: DataFrame, funding: DataFrame, fees: DataFrame, context: DataFrame, limits: Limits = Limits(), tiebreak: str = "id") -> DataFrame:  # noqa: B008
    """Each ticker (symbol, venue, ts, tiebreak, others) with the book (ts, others) and the funding (ts, others) of its venue that are nearest in time, within
    ``window`` and ``funding_window``, the venue's newest fees (updated_at, others), and the symbol's last context (ts, others) that is not
    later and no older than ``context_age``. Their times become ticker_ts, book_ts, funding_ts and context_ts; gaps are in milliseconds."""
    out = tickers.where("symbol IS NOT NULL AND venue IS NOT NULL AND ts IS NOT NULL")

    def beside(out: DataFrame, rows: DataFrame, name: str, keys: list[str], direction: str, most: float) -> DataFrame:
        there = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in (*keys, "ts"))).withColumn(f"{name}_ts", F.col("ts"))
        values = [c for c in there.columns if c not in (*keys, "ts", tiebreak)]
        found = nearest_row(out, there, keys, "ts", values, tiebreak=tiebreak, direction=direction, tolerance=most)
        return found.withColumn(f"{name}_gap_ms", F.abs("gap_seconds") * 1000).drop("gap_seconds")

    out = beside(out, books, "book", ["symbol", "venue"], "nearest", limits.window)
    out = beside(out, funding, "funding", ["symbol", "venue"], "nearest", limits.funding_window)
    newest = latest(fees, ["symbol", "venue"], "updated_at", tiebreak).drop("updated_at", tiebreak)
    out = out.join(newest, ["symbol", "venue"], "left")
    return beside(out, context, "context", ["symbol"], "backward", limits.context_age).withColumnRenamed("ts", "ticker_ts")


def _side(snapshots: DataFrame, limits: Limits) -> DataFrame:
    """A snapshot with what follows from it alone."""
    missing = {c: F.lit(None).cast(kind) for c, kind in OPTIONAL.items() if c not in snapshots.columns}
    s = snapshots.withColumns(missing) if missing else snapshots
    s = s.withColumns({"bid": F.coalesce("bid", "book_bid"), "ask": F.coalesce("ask", "book_ask")})
    own = (F.col("bid") + F.col("ask")) / 2
    s = s.withColumns({
        "mid": F.coalesce("mid", "book_mid", own), "spread_bps": F.coalesce(F.col("spread_bps"), F.col("book_spread_bps"), bps(F.col("ask") - F.col("bid"), own)),
        "fee": F.coalesce("taker_fee", "maker_fee", F.lit(limits.fee)),
        "fee_source": F.when(F.col("taker_fee").isNotNull(), "taker_fee").when(F.col("maker_fee").isNotNull(), "maker_fee_fallback").otherwise("config_default"),
        "depth": F.when(F.col("bid_depth").isNotNull() | F.col("ask_depth").isNotNull(), F.coalesce("bid_depth", F.lit(0.0)) + F.coalesce("ask_depth", F.lit(0.0))),
    })
    return s.withColumns({"buy_at": F.coalesce("ask", "mid", "last"), "sell_at": F.coalesce("bid", "mid", "last")})


_CONTEXT = ("context_ts", "rsi", "macd_hist", "atr_pct", "volatility", "adx", "zscore")


def _pairs(snapshots: DataFrame, limits: Limits) -> DataFrame:
    """Differences, gaps, spreads and flags of each pair."""
    once = _side(snapshots, limits).dropDuplicates(["symbol", "as_of", "venue"])
    names = [c for c in once.columns if c not in ("symbol", "as_of")]
    a, b = (once.select("symbol", "as_of", *(F.col(c).alias(f"{c}_{x}") for c in names)) for x in "ab")
    p = a.join(b, ["symbol", "as_of"]).where("venue_a < venue_b")
    p = p.withColumns({c: F.coalesce(f"{c}_a", f"{c}_b") for c in _CONTEXT}).withColumn("context_age", seconds(F.col("as_of"), F.col("context_ts")))
    both = lambda c: (F.col(f"{c}_a"), F.col(f"{c}_b"))
    diff = lambda c: both(c)[0] - both(c)[1]
    relative = lambda c: bps(diff(c), mean(*both(c)))
    ratio = lambda c: F.when(both(c)[1] != 0, both(c)[0] / both(c)[1])
    gap = lambda c: F.abs(seconds(*both(c))) * 1000
    base = mean(*both("mid"), *both("last"))
    cheaper = F.col("buy_at_b").isNull() | (F.col("buy_at_a") <= F.col("buy_at_b"))
    dearer = F.col("sell_at_b").isNull() | (F.col("sell_at_a") >= F.col("sell_at_b"))
    best = lambda first, price: F.when(F.coalesce(*both(price)).isNotNull(), F.when(F.coalesce(first, F.lit(False)), F.col("venue_a")).otherwise(F.col("venue_b")))
    return p.withColumns({
        "base": base, "last_diff_abs": diff("last"), "last_diff_bps": relative("last"), "mid_diff_abs": diff("mid"), "mid_diff_bps": relative("mid"), "bid_diff_bps": relative("bid"), "ask_diff_bps": relative("ask"),
        "funding_diff_abs": diff("funding"), "funding_diff_bps": diff("funding") * 10_000, "mark_diff_bps": relative("mark"), "index_diff_bps": relative("index"),
        "fee_bps": (F.col("fee_a") + F.col("fee_b")) * 10_000, "quote_volume_ratio": ratio("quote_volume"), "bid_depth_ratio": ratio("bid_depth"), "ask_depth_ratio": ratio("ask_depth"), "total_depth_ratio": ratio("depth"),
        "spread_bps_gap": diff("spread_bps"), "depth_imbalance_gap": diff("depth_imbalance"), "ticker_gap_ms": gap("ticker_ts"), "funding_gap_ms": gap("funding_ts"),
        "best_buy": best(cheaper, "buy_at"), "best_sell": best(dearer, "sell_at"), "flags": flags(limits), "spread": mean(*both("spread_bps")),
    }).withColumns({"gross_ab": bps(F.col("bid_a") - F.col("ask_b"), F.col("base")), "gross_ba": bps(F.col("bid_b") - F.col("ask_a"), F.col("base"))})


def compare_venues(snapshots: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """One row for each symbol, time and unordered pair of venues a < b; of a venue's repeated snapshots any one counts. Without
    two venues a symbol has no row."""
    p = _pairs(snapshots, limits)
    for x, y in ("ab", "ba"):
        cost, multiple = slippage(F.col(f"bid_depth_{x}"), F.col(f"ask_depth_{y}"), F.col("spread"), limits)
        p = p.withColumns({f"slip_{x}{y}": cost, f"multiple_{x}{y}": multiple})
        p = p.withColumn(f"net_{x}{y}", F.col(f"gross_{x}{y}") - F.col("fee_bps") - F.coalesce(f"slip_{x}{y}", F.lit(0.0)))
    ab, ba = F.col("net_ab"), F.col("net_ba")
    p = p.withColumn("first", F.coalesce(ab.isNotNull() & (ba.isNull() | (ab >= ba)), F.lit(False)))
    first = F.col("first")
    pick = lambda c: F.when(first, F.col(f"{c}_ab")).when(ba.isNotNull(), F.col(f"{c}_ba"))
    sells = lambda x, y: F.concat(F.lit("sell_"), F.col(f"venue_{x}"), F.lit("_buy_"), F.col(f"venue_{y}"))
    p = p.withColumns({
        "net": F.greatest(ab, ba), "gross": F.greatest("gross_ab", "gross_ba"), "slip": pick("slip"), "multiple": pick("multiple"),
        "opportunity": F.when(first & (ab > 0), sells("a", "b")).when(~first & (ba > 0), sells("b", "a")).otherwise("none"),
        "blocked": F.exists("flags", lambda f: f.rlike(f"^({'|'.join(_BLOCKING)})")), "gap": F.coalesce(F.abs("mid_diff_bps"), F.lit(0.0)),
    })
    yes = lambda c: F.coalesce(c, F.lit(False))
    actionable = yes((F.col("opportunity") != "none") & (F.col("net") >= limits.least_net) & (F.col("multiple") >= limits.buffer) & (F.col("slip") <= limits.slippage) & ~F.col("blocked"))
    p = p.withColumn("actionable", actionable)
    thin = (F.col("gross") > 0) & (F.coalesce("multiple", F.lit(0.0)) < limits.buffer)
    gap, count, net, multiple = F.col("gap"), F.size("flags"), F.col("net"), F.col("multiple")
    label = (
        F.when(F.col("blocked"), "data_quality_warning").when(F.col("actionable"), "tradable_spread").when(yes(thin), "liquidity_warning").when(gap >= limits.divergence, "price_divergence")
        .when(yes((net > 0) & (multiple >= limits.thin)), "price_divergence").otherwise("normal")
    )
    p = p.withColumn("label", label)
    strength = (
        F.when(F.col("label") == "tradable_spread", within(55 + F.greatest("net", F.lit(0.0)) / max(limits.least_net, 0.5) * 8, 55, 100))
        .when(F.col("label") == "liquidity_warning", within(35 + 1.2 * F.greatest(F.coalesce("gross", F.lit(0.0)), F.lit(0.0)), 35, 95))
        .when(F.col("label") == "price_divergence", within(gap / max(limits.divergence, 1.0) * 60, 20, 100)).when(F.col("label") == "data_quality_warning", within(20.0 + count * 12, 20, 100)).otherwise(within(gap, 0, 25))
    )
    anomaly = F.least(gap / max(limits.anomaly, 1.0) * 55, F.lit(55.0)) + F.least(count * 6.0, F.lit(30.0)) + F.when(yes(F.col("context_age") > limits.context_age), 5.0).otherwise(0.0)
    if limits.funding:
        far = F.abs("funding_diff_bps") / max(limits.funding_divergence, 1.0) * 20
        anomaly += F.when(far.isNotNull(), F.least(far, F.lit(20.0))).otherwise(0.0)
    anomaly += F.when(yes(multiple < 1), F.least((1 - multiple) * 15, F.lit(15.0))).otherwise(0.0)
    profit = F.when(net.isNotNull(), within((net + limits.least_net) / max(8 * limits.least_net, 1.0), 0, 1)).otherwise(0.0)
    liquidity = F.when(multiple.isNotNull(), within(multiple / max(limits.buffer, 0.1), 0, 1)).otherwise(0.0)
    preference = 100 * (0.4 * profit + 0.3 * liquidity + 0.15 * (1 - within(F.coalesce("spread", F.lit(0.0)) / 20, 0, 1)) + F.when(F.col("blocked"), 0.0).otherwise(0.15))
    fresh = [yes(F.col("context_age") <= limits.context_age)] * limits.context + [yes(seconds(F.col("as_of"), F.col(f"funding_ts_{x}")) <= limits.funding_age) for x in "ab" if limits.funding]
    complete = F.round(sum((f.cast("double") for f in fresh), F.lit(0.0)) / len(fresh) * 100, 4) if fresh else F.lit(100.0)
    return p.select(
        "symbol", "as_of", F.col("venue_a").alias("a"), F.col("venue_b").alias("b"), F.coalesce(F.greatest("ticker_ts_a", "ticker_ts_b"), "as_of").alias("compared_at"),
        F.when(count > 0, F.array_join("flags", "|")).otherwise("ok").alias("flags"), "last_diff_abs", "last_diff_bps", "mid_diff_abs", "mid_diff_bps", "bid_diff_bps", "ask_diff_bps", "funding_diff_abs", "funding_diff_bps",
        "mark_diff_bps", "index_diff_bps", "gross_ab", "gross_ba", "fee_bps", "fee_source_a", "fee_source_b", "slip_ab", "slip_ba", "slip", "net_ab", "net_ba", "net", "multiple", "quote_volume_ratio", "bid_depth_ratio",
        "ask_depth_ratio", "total_depth_ratio", "spread_bps_gap", "depth_imbalance_gap", "ticker_gap_ms", "funding_gap_ms", "context_age", "best_buy", "best_sell", "opportunity", "actionable", "label", strength.alias("strength"),
        within(anomaly, 0, 100).alias("anomaly"), within(preference, 0, 100).alias("preference"), complete.alias("completeness"), market_regime(limits).alias("market_regime"), funding_regime(limits).alias("funding_regime"),
    )


def range_bps(rows: DataFrame, keys: list[str], price: str) -> DataFrame:
    """(keys, range_bps): how far a price's largest and smallest value are apart, over their mean; 0 for one value, null for none and
    for a mean of 0."""
    return rows.groupBy(*keys).agg(bps(F.max(price) - F.min(price), F.avg(price)).alias("range_bps"))


def newest_by_priority(rows: DataFrame, keys: list[str], priority: Column, order: str) -> DataFrame:
    """One row of each key: of the best (smallest) priority, then the newest, then the first of all columns in order."""
    w = W.partitionBy(*keys).orderBy(priority, F.desc(order), *[c for c in rows.columns if c not in keys and c != order])
    return rows.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")
