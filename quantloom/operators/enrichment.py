"""Bars with the context that several sources gave of their symbol by the time a bar closed.

A source is a table of snapshots by venue. All sources meet the bars in one window: the moments asked for
are dealt to each known venue of each source, and every series of (symbol, source, venue) carries its last snapshot
forward. What is too old counts as seen but not as fresh. A fold over the venues then gives each
moment one row, by a partial aggregate; bars themselves travel once, narrow keys do the rest.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.timeframes import close_time


@dataclass(frozen=True)
class Source:
    """Snapshots (symbol, exchange, timestamp and features). ``folds`` names the columns that a moment gets: how
    they are made (count, mean, sum, std, range_bps) and of which feature. Snapshots older than ``max_age`` seconds are stale; 0: never."""

    name: str
    rows: DataFrame
    max_age: float
    folds: dict[str, tuple[str, str]]
    #: of equal times the largest counts last; else the snapshot with the largest features
    tiebreak: str | None = None
    features: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "features", tuple(dict.fromkeys(f for _, f in self.folds.values())))


def _number(name: str) -> Column:
    value = F.col(name).try_cast("double")
    return F.when(~F.isnan(value), value)


def last_by_venue(moments: DataFrame, sources: list[Source]) -> DataFrame:
    """(symbol, at, source, exchange, seen, and a column source__feature of each): of every moment (symbol, at) the last
    snapshot of each venue that its source ever has for the symbol; seen is null before the first."""
    tables, known = [], []
    for s in sources:
        there = s.rows.where("symbol IS NOT NULL AND exchange IS NOT NULL AND timestamp IS NOT NULL")
        values = [_number(f).alias(f"{s.name}__{f}") for f in s.features]
        tie = F.col(s.tiebreak).cast("long") if s.tiebreak else F.lit(None).cast("long")
        tables.append(there.select("symbol", "exchange", F.lit(s.name).alias("source"), F.col("timestamp").alias("at"), F.col("timestamp").alias("seen"), tie.alias("_tie"), F.lit(0).alias("_side"), *values))
        known.append(there.select("symbol", F.lit(s.name).alias("source"), "exchange").distinct())
    asked = moments.select("symbol", "at").distinct().join(reduce(DataFrame.unionByName, known), "symbol").withColumn("_side", F.lit(1))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*tables, asked])
    features = [f"{s.name}__{f}" for s in sources for f in s.features]
    w = W.partitionBy("symbol", "source", "exchange").orderBy("at", "_side", "_tie", *features).rowsBetween(W.unboundedPreceding, W.currentRow)
    last = F.last(F.when(F.col("_side") == 0, F.struct("seen", *features)), ignorenulls=True).over(w)
    found = union.withColumn("_last", last).where("_side = 1")
    return found.select("symbol", "at", "source", "exchange", "_last.seen", *(f"_last.{f}" for f in features))


def _fold(how: str, x: Column) -> Column:
    if how == "count":
        return F.count(x)
    if how == "mean":
        return F.avg(x)
    if how == "sum":
        return F.sum(x)
    if how == "std":
        return F.stddev_pop(x)
    if how == "range_bps":
        return (F.max(x) - F.min(x)) / F.nullif(F.avg(x), F.lit(0.0)) * 10_000
    raise ValueError(f"no fold {how}")


def seconds_between(later: Column, earlier: Column) -> Column:
    """With its fraction."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / 1e6


def source_status(known: Column, raw: Column, fresh: Column) -> Column:
    """ready: all known venues are fresh; partial: some; stale_only: none, but some are known by then; else missing."""
    return F.when((fresh > 0) & (fresh == raw) & (raw >= known), "ready").when(fresh > 0, "partial").when(raw > 0, "stale_only").otherwise("missing")


def enrich(bars: DataFrame, sources: list[Source], thin: tuple[str, ...] = ("ticker", "orderbook")) -> DataFrame:
    """bars (symbol, timeframe, open_time, others) with the sources' folds at each bar's close, and what is known of their quality.

    Of each source: ``_context_status``, the venues known (at any time), raw (seen by then), fresh, stale and missing, and the fresh share of
    the known, to four digits. Of all: ``market_context_quality_flag`` is thin where a source in ``thin`` is missing or stale, ok
    where all are ready, else partial; the flags name what is not ready. A fold over no fresh venue is null; counts are null
    too where the source never had the symbol. Bars keep their number, their columns and repeated rows.
    """
    keyed = bars.withColumn("_at", close_time(F.col("open_time"), F.col("timeframe")))
    found = last_by_venue(keyed.select("symbol", F.col("_at").alias("at")), sources)
    aggregates = []
    for s in sources:
        own, age = F.col("source") == s.name, seconds_between(F.col("at"), F.col("seen"))
        fresh = age.isNotNull() & (age <= s.max_age) if s.max_age > 0 else age.isNotNull()
        aggregates += [F.count_if(own).alias(f"_{s.name}_known"), F.count_if(own & age.isNotNull()).alias(f"_{s.name}_raw"), F.count_if(own & fresh).alias(f"_{s.name}_fresh")]
        for name, (how, feature) in s.folds.items():
            value = _fold(how, F.when(own & fresh, F.col(f"{s.name}__{feature}")))
            aggregates.append((F.when(F.count_if(own) > 0, value) if how == "count" else value).alias(name))
    moments = found.groupBy(F.col("symbol").alias("_symbol"), F.col("at").alias("_moment")).agg(*aggregates)
    out = keyed.join(moments, (F.col("symbol") == F.col("_symbol")) & (F.col("_at") == F.col("_moment")), "left").drop("_symbol", "_moment", "_at")
    for s in sources:
        known, raw, fresh = (F.coalesce(f"_{s.name}_{x}", F.lit(0)) for x in ("known", "raw", "fresh"))
        out = out.withColumns({
            f"{s.name}_context_status": source_status(known, raw, fresh), f"{s.name}_context_known_exchange_count": known, f"{s.name}_context_raw_exchange_count": raw,
            f"{s.name}_context_fresh_exchange_count": fresh, f"{s.name}_context_stale_exchange_count": raw - fresh, f"{s.name}_context_missing_exchange_count": known - raw,
            f"{s.name}_context_fresh_exchange_ratio": F.bround(fresh / F.nullif(known, F.lit(0)), 4),
        }).drop(f"_{s.name}_known", f"_{s.name}_raw", f"_{s.name}_fresh")
    return _quality(out, [s.name for s in sources], thin)


def _quality(rows: DataFrame, names: list[str], thin: tuple[str, ...]) -> DataFrame:
    status = {n: F.col(f"{n}_context_status") for n in names}
    flags = F.array_compact(F.array(*(F.when(c != "ready", F.concat(F.lit(f"{n}_context_"), c)) for n, c in status.items())))
    weak = reduce(lambda a, b: a | b, [c.isin("missing", "stale_only") for n, c in status.items() if n in thin], F.lit(False))
    number = lambda x: sum(((c == x).cast("long") for c in status.values()), F.lit(0).cast("long"))
    return rows.withColumns({
        "market_context_quality_flag": F.when(weak, "thin").when(F.size(flags) > 0, "partial").otherwise("ok"),
        "market_context_quality_flags": F.when(F.size(flags) > 0, F.array_join(flags, "|")).otherwise("ok"),
        **{f"market_context_{x}_source_count": number(x) for x in ("ready", "partial", "stale_only", "missing")},
    })


def market_sources(tickers: DataFrame, funding: DataFrame, books: DataFrame, ages: tuple[float, float, float] = (15, 2_700, 15), tiebreak: str | None = None) -> list[Source]:
    """The three sources of a market's context, with the columns that bars get from them."""
    basis = (F.col("mark_price").try_cast("double") - F.col("index_price").try_cast("double")) / F.nullif(F.col("index_price").try_cast("double"), F.lit(0.0)) * 10_000
    of_tickers = {
        "ticker_exchange_count": ("count", "last_price"), "ticker_last_price_mean": ("mean", "last_price"), "ticker_mid_price_mean": ("mean", "mid_price"),
        "ticker_spread_bps_mean": ("mean", "spread_bps"), "ticker_quote_volume_24h_sum": ("sum", "quote_volume_24h"), "ticker_quote_volume_24h_mean": ("mean", "quote_volume_24h"),
        "ticker_change_24h_mean": ("mean", "change_24h"), "ticker_vwap_24h_mean": ("mean", "vwap_24h"), "cross_exchange_last_price_std": ("std", "last_price"), "cross_exchange_last_price_range_bps": ("range_bps", "last_price"),
    }
    of_funding = {"funding_exchange_count": ("count", "funding_rate"), "funding_rate_mean": ("mean", "funding_rate"), "funding_rate_std": ("std", "funding_rate"), "funding_basis_bps_mean": ("mean", "funding_basis_bps")}
    of_books = {
        "orderbook_exchange_count": ("count", "mid_price"), "orderbook_mid_price_mean": ("mean", "mid_price"), "orderbook_spread_bps_mean": ("mean", "spread_bps"), "orderbook_bid_depth_notional_sum": ("sum", "bid_depth_notional"),
        "orderbook_ask_depth_notional_sum": ("sum", "ask_depth_notional"), "orderbook_depth_imbalance_mean": ("mean", "depth_imbalance"),
    }
    return [
        Source("ticker", tickers, ages[0], of_tickers, tiebreak), Source("funding", funding.withColumn("funding_basis_bps", basis), ages[1], of_funding, tiebreak), Source("orderbook", books, ages[2], of_books, tiebreak),
    ]


def enrich_bars(bars: DataFrame, tickers: DataFrame, funding: DataFrame, books: DataFrame, ages: tuple[float, float, float] = (15, 2_700, 15), tiebreak: str | None = None) -> DataFrame:
    """enrich() by tickers, funding rates and order books, with the depth of both sides together."""
    out = enrich(bars, market_sources(tickers, funding, books, ages, tiebreak))
    return out.withColumn("orderbook_total_depth_notional", F.col("orderbook_bid_depth_notional_sum") + F.col("orderbook_ask_depth_notional_sum"))
