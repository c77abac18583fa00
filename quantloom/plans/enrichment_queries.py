"""Bars enriched by sources and venues, with SQL by as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrichment
from ..sources.adapters import BARS_SQL, TRADES_SQL, hourly_bars, trades

#: seconds until the given tables' sparse tickers, funding rates and books are stale
AGES = (10_800, 43_200, 7_200)

_ONCE = f"(SELECT * FROM ({TRADES_SQL}) t QUALIFY row_number() OVER (PARTITION BY symbol, venue, ts, side ORDER BY event_id DESC) = 1)"
TICKERS_SQL = f"""SELECT symbol, venue, ts, price AS last_price, CASE WHEN event_id % 4 = 0 THEN price * 1.01 END AS mid_price, amount AS spread_bps, price * amount AS quote_volume_24h,
 price / 100 - 1 AS change_24h, price * 0.99 AS vwap_24h FROM {_ONCE} o WHERE side = 'buy'"""
FUNDING_SQL = f"SELECT symbol, venue, ts, amount / 1000 AS funding_rate, CASE WHEN event_id % 4 > 0 THEN (price - amount) / amount * 10000 END AS funding_basis_bps FROM {_ONCE} o"
BOOKS_SQL = f"""SELECT symbol, venue, ts, price AS mid_price, amount AS spread_bps, CASE WHEN event_id % 5 > 0 THEN price * amount END AS bid_depth_notional, price * amount * 0.8 AS ask_depth_notional,
 amount / 100 AS depth_imbalance FROM {_ONCE} o WHERE side = 'sell' AND venue <> 'v2'"""


def _source_sql(name: str, rows: str, age: int, folds: str) -> str:
    """One row for each bar: the venues known, seen and fresh, and the folds over the fresh ones."""
    return f"""{name}_rows AS ({rows}), {name} AS (SELECT symbol, open_time, count(*) AS {name}_known, count(seen) AS {name}_raw, count(*) FILTER (fresh) AS {name}_fresh, {folds} FROM (
 SELECT *, coalesce(epoch_us(closed - seen) <= {age} * 1000000::BIGINT, false) AS fresh FROM (SELECT b.symbol, b.open_time, b.closed, r.ts AS seen, r.* EXCLUDE (symbol, venue, ts)
 FROM (SELECT bars.*, k.venue FROM bars JOIN (SELECT DISTINCT symbol, venue FROM {name}_rows) k USING (symbol)) b ASOF LEFT JOIN {name}_rows r ON r.symbol = b.symbol AND r.venue = b.venue AND r.ts <= b.closed)) GROUP BY ALL)"""


def _over(how: str, x: str) -> str:
    return f"{how}({x}) FILTER (fresh)"


_TICKER = f"""{_over('count', 'last_price')} AS ticker_exchange_count, {_over('avg', 'last_price')} AS ticker_last_price_mean, {_over('avg', 'mid_price')} AS ticker_mid_price_mean, {_over('avg', 'spread_bps')} AS ticker_spread_bps_mean,
 {_over('sum', 'quote_volume_24h')} AS ticker_quote_volume_24h_sum, {_over('avg', 'quote_volume_24h')} AS ticker_quote_volume_24h_mean, {_over('avg', 'change_24h')} AS ticker_change_24h_mean, {_over('avg', 'vwap_24h')} AS ticker_vwap_24h_mean,
 {_over('stddev_pop', 'last_price')} AS cross_exchange_last_price_std, ({_over('max', 'last_price')} - {_over('min', 'last_price')}) / nullif({_over('avg', 'last_price')}, 0) * 10000 AS cross_exchange_last_price_range_bps"""
_FUNDING = f"{_over('count', 'funding_rate')} AS funding_exchange_count, {_over('avg', 'funding_rate')} AS funding_rate_mean, {_over('stddev_pop', 'funding_rate')} AS funding_rate_std, {_over('avg', 'funding_basis_bps')} AS funding_basis_bps_mean"
_BOOK = f"""{_over('count', 'mid_price')} AS orderbook_exchange_count, {_over('avg', 'mid_price')} AS orderbook_mid_price_mean, {_over('avg', 'spread_bps')} AS orderbook_spread_bps_mean, {_over('sum', 'bid_depth_notional')} AS orderbook_bid_depth_notional_sum,
 {_over('sum', 'ask_depth_notional')} AS orderbook_ask_depth_notional_sum, {_over('avg', 'depth_imbalance')} AS orderbook_depth_imbalance_mean"""
_JOINED = f"""WITH bars AS (SELECT symbol, open_time, open_time + INTERVAL 1 HOUR AS closed FROM (SELECT symbol, open_time::TIMESTAMP AS open_time FROM ({BARS_SQL}) b)),
 {_source_sql('ticker', TICKERS_SQL, AGES[0], _TICKER)}, {_source_sql('funding', FUNDING_SQL, AGES[1], _FUNDING)}, {_source_sql('orderbook', BOOKS_SQL, AGES[2], _BOOK)},
 j AS (SELECT * FROM bars LEFT JOIN ticker USING (symbol, open_time) LEFT JOIN funding USING (symbol, open_time) LEFT JOIN orderbook USING (symbol, open_time))"""
CONTEXT = """ticker_exchange_count ticker_last_price_mean ticker_mid_price_mean ticker_spread_bps_mean ticker_quote_volume_24h_sum ticker_quote_volume_24h_mean ticker_change_24h_mean ticker_vwap_24h_mean
cross_exchange_last_price_std cross_exchange_last_price_range_bps funding_exchange_count funding_rate_mean funding_rate_std funding_basis_bps_mean orderbook_exchange_count orderbook_mid_price_mean orderbook_spread_bps_mean
orderbook_bid_depth_notional_sum orderbook_ask_depth_notional_sum orderbook_depth_imbalance_mean""".split()
_ROUNDED = " ".join(f"{c}:4" if "bps" in c or "notional" in c or "volume" in c else c for c in [*CONTEXT, "orderbook_total_depth_notional"] if not c.endswith("count"))


def _quality_sql(name: str) -> str:
    known, raw, fresh = (f"coalesce({name}_{x}, 0)" for x in ("known", "raw", "fresh"))
    return f"""CASE WHEN {fresh} = {known} AND {known} > 0 THEN 'ready' WHEN {fresh} > 0 THEN 'partial' WHEN {raw} > 0 THEN 'stale_only' ELSE 'missing' END AS {name}_context_status, {known} AS {name}_context_known_exchange_count,
 {raw} AS {name}_context_raw_exchange_count, {fresh} AS {name}_context_fresh_exchange_count, {raw} - {fresh} AS {name}_context_stale_exchange_count, {known} - {raw} AS {name}_context_missing_exchange_count,
 round_even({fresh} / nullif({known}, 0), 4) AS {name}_context_fresh_exchange_ratio"""


def _counted(state: str) -> str:
    return " + ".join(f"({n}_context_status = '{state}')::BIGINT" for n in ("ticker", "funding", "orderbook")) + f" AS market_context_{state}_source_count"


def _enriched(spark, d):
    t = trades(spark, d).withColumns({"exchange": F.col("venue"), "timestamp": F.col("ts")})
    p, a, k = F.col("price"), F.col("amount"), F.col("event_id")
    tickers = t.where(F.col("side") == "buy").withColumns({
        "last_price": p, "mid_price": F.when(k % 4 == 0, p * 1.01), "spread_bps": a, "quote_volume_24h": p * a, "change_24h": p / 100 - 1, "vwap_24h": p * 0.99,
    })
    funding = t.withColumns({"funding_rate": a / 1000, "mark_price": F.when(k % 4 > 0, p), "index_price": a})
    books = t.where((F.col("side") == "sell") & (F.col("venue") != "v2")).withColumns({
        "mid_price": p, "spread_bps": a, "bid_depth_notional": F.when(k % 5 > 0, p * a), "ask_depth_notional": p * a * 0.8, "depth_imbalance": a / 100,
    })
    bars = hourly_bars(spark, d).select("symbol", "timeframe", F.col("open_time").cast("timestamp_ntz").alias("open_time"))
    return enrichment.enrich_bars(bars, tickers, funding, books, AGES, "event_id").drop("timeframe")


def register(query) -> None:
    @query(f"{_JOINED} SELECT symbol, open_time, {', '.join(CONTEXT)}, orderbook_bid_depth_notional_sum + orderbook_ask_depth_notional_sum AS orderbook_total_depth_notional FROM j", _ROUNDED)
    def enriched_bars(spark, d):
        return _enriched(spark, d).select("symbol", "open_time", *CONTEXT, "orderbook_total_depth_notional")

    @query(f"""{_JOINED}, q AS (SELECT symbol, open_time, {', '.join(map(_quality_sql, ('ticker', 'funding', 'orderbook')))} FROM j)
 SELECT *, CASE WHEN ticker_context_status IN ('missing', 'stale_only') OR orderbook_context_status IN ('missing', 'stale_only') THEN 'thin' WHEN funding_context_status = 'ready' AND ticker_context_status = 'ready' AND orderbook_context_status = 'ready' THEN 'ok' ELSE 'partial' END AS market_context_quality_flag,
 coalesce(nullif(concat_ws('|', CASE WHEN ticker_context_status <> 'ready' THEN 'ticker_context_' || ticker_context_status END, CASE WHEN funding_context_status <> 'ready' THEN 'funding_context_' || funding_context_status END,
  CASE WHEN orderbook_context_status <> 'ready' THEN 'orderbook_context_' || orderbook_context_status END), ''), 'ok') AS market_context_quality_flags, {', '.join(map(_counted, ('ready', 'partial', 'stale_only', 'missing')))} FROM q""")
    def enrichment_freshness(spark, d):
        found = _enriched(spark, d)
        return found.select("symbol", "open_time", *(c for c in found.columns if "_context_" in c))
