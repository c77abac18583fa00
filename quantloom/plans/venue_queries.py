"""Venue pairs, enrichment and relational forms, with SQL written apart."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import venues
from ..sources.adapters import BARS_SQL, QUOTES_SQL, TRADES_SQL, hourly_bars, load, quotes, trades

#: limits under which the hourly snapshots of the given tables are fresh, stale or missing
LIMITS = venues.Limits(ticker_age=1800, book_age=1500, window=1200, funding_window=1500, funding=True, notional=3000.0, divergence=2000.0, anomaly=4000.0, slippage=60.0, atr_pct=150.0)
VALUES = "click error purchase signup view".split()

SNAPSHOTS = f"""(WITH t AS (SELECT symbol, venue, date_trunc('hour', ts)::TIMESTAMP AS hour, max(ts) AS seen, count(*) AS n, arg_max(price, struct_pack(a := ts, b := event_id)) AS close, sum(amount) AS amount,
   sum(CASE side WHEN 'buy' THEN amount ELSE -amount END) AS net FROM ({TRADES_SQL}) q GROUP BY ALL),
 c AS (SELECT symbol, open_time, close, high, low, close - lag(close) OVER (PARTITION BY symbol ORDER BY open_time) AS step FROM ({BARS_SQL}) q)
 SELECT t.symbol, venue, hour + INTERVAL 1 HOUR AS as_of, seen AS ticker_ts, CASE WHEN n > 1 THEN seen END AS book_ts, CASE WHEN amount > 40 THEN seen END AS funding_ts, t.close * 0.999 AS bid, CASE WHEN amount < 190 THEN t.close * 1.001 END AS ask, t.close AS last,
  CASE WHEN n > 1 THEN amount * t.close END AS bid_depth, CASE WHEN n > 1 AND amount < 120 THEN amount * t.close * 0.8 END AS ask_depth, CASE WHEN amount > 60 THEN t.close * (1 + net / amount / 500) END AS mark, amount * t.close * 24 AS quote_volume, CASE WHEN amount > 40 THEN net / amount / 1000 END AS funding, CASE WHEN venue = 'v0' THEN 0.0005 END AS taker_fee, CASE WHEN venue < 'v2' THEN 0.0008 END AS maker_fee,
  c.open_time AS context_ts, 50 + 50 * step / (high + low) AS rsi, step AS macd_hist, (high - low) / c.close * 100 AS atr_pct, (high - low) / (high + low) / 20 AS volatility, abs(step) / (high + low) * 100 AS adx, step / (high - low + 1) AS zscore
 FROM t LEFT JOIN c ON c.symbol = t.symbol AND c.open_time = t.hour)"""

def _flag(kind: str, when: str, most: int, side: str) -> str:
    return f"CASE WHEN {when} IS NULL THEN 'missing_{kind}_{side}' WHEN as_of - {when} > INTERVAL {most} SECONDS THEN 'stale_{kind}_{side}' END"


def _relative(x: str) -> str:
    return f"({x}_a - {x}_b) / nullif(({x}_a + {x}_b) / 2, 0) * 10000"


_SIDES = "ticker_ts book_ts funding_ts bid ask last bid_depth ask_depth mark quote_volume funding mid".split()
COMPARED = f"""WITH s AS (SELECT *, (bid + ask) / 2 AS mid, coalesce(taker_fee, maker_fee, 0.001) AS fee, CASE WHEN taker_fee IS NOT NULL THEN 'taker_fee' WHEN maker_fee IS NOT NULL THEN 'maker_fee_fallback' ELSE 'config_default' END AS fee_source FROM {SNAPSHOTS} q),
 p AS (SELECT x.symbol, x.as_of, x.venue AS a, y.venue AS b, {', '.join(f'x.{c} AS {c}_a, y.{c} AS {c}_b' for c in _SIDES)}, x.fee_source AS fee_source_a, y.fee_source AS fee_source_b, (x.fee + y.fee) * 10000 AS fee_bps,
   x.context_ts AS ct, x.rsi, x.macd_hist, x.atr_pct, x.volatility, x.adx, x.zscore FROM s x JOIN s y ON x.symbol = y.symbol AND x.as_of = y.as_of AND x.venue < y.venue),
 q AS (SELECT *, list_avg([u for u in [mid_a, mid_b, last_a, last_b] if u IS NOT NULL]) AS base, list_avg([u for u in [(ask_a - bid_a) / mid_a * 10000, (ask_b - bid_b) / mid_b * 10000] if u IS NOT NULL]) AS spread,
   abs(epoch_us(ticker_ts_a) - epoch_us(ticker_ts_b)) / 1000 AS ticker_gap_ms, abs(epoch_us(funding_ts_a) - epoch_us(funding_ts_b)) / 1000 AS funding_gap_ms, epoch_us(as_of - ct) / 1000000 AS context_age,
   list_filter([{_flag('ticker', 'ticker_ts_a', 1800, 'a')}, {_flag('ticker', 'ticker_ts_b', 1800, 'b')}, {_flag('orderbook', 'book_ts_a', 1500, 'a')}, {_flag('orderbook', 'book_ts_b', 1500, 'b')},
    CASE WHEN bid_a + ask_a IS NULL THEN 'missing_bid_ask_a' END, CASE WHEN bid_b + ask_b IS NULL THEN 'missing_bid_ask_b' END, CASE WHEN greatest(ticker_ts_a, ticker_ts_b) - least(ticker_ts_a, ticker_ts_b) > INTERVAL 20 MINUTES THEN 'cross_exchange_ticker_gap' END,
    CASE WHEN abs(epoch_us(book_ts_a) - epoch_us(book_ts_b)) > 1200000000 THEN 'cross_exchange_orderbook_gap' END, {_flag('funding', 'funding_ts_a', 21600, 'a')}, {_flag('funding', 'funding_ts_b', 21600, 'b')},
    CASE WHEN abs(epoch_us(funding_ts_a) - epoch_us(funding_ts_b)) > 1500000000 THEN 'cross_exchange_funding_gap' END, CASE WHEN ct IS NULL THEN 'missing_indicator_context' WHEN as_of - ct > INTERVAL 6 HOURS THEN 'stale_indicator_context' END], lambda f: f IS NOT NULL) AS fl,
   (funding_a - funding_b) * 10000 AS funding_diff_bps FROM p),
 r AS (SELECT *, (bid_a - ask_b) / base * 10000 AS gross_ab, (bid_b - ask_a) / base * 10000 AS gross_ba, least(bid_depth_a, ask_depth_b) / 3000 AS xab, least(bid_depth_b, ask_depth_a) / 3000 AS xba, regexp_matches(array_to_string(fl, ','), '(missing|stale)_(ticker|orderbook)|missing_bid_ask|ticker_gap') AS blocked FROM q),
 u AS (SELECT *, CASE WHEN bid_depth_a IS NULL OR ask_depth_b IS NULL THEN CASE WHEN xab IS NOT NULL THEN 100 END ELSE least(100, coalesce(spread, 0) * 0.15 + 10 * greatest(0, 3000 / bid_depth_a - 1) + 10 * greatest(0, 3000 / ask_depth_b - 1) + 8 * greatest(0, 1.25 - xab) / 1.25) END AS slip_ab,
   CASE WHEN bid_depth_b IS NULL OR ask_depth_a IS NULL THEN CASE WHEN xba IS NOT NULL THEN 100 END ELSE least(100, coalesce(spread, 0) * 0.15 + 10 * greatest(0, 3000 / bid_depth_b - 1) + 10 * greatest(0, 3000 / ask_depth_a - 1) + 8 * greatest(0, 1.25 - xba) / 1.25) END AS slip_ba FROM r),
 v AS (SELECT *, gross_ab - fee_bps - coalesce(slip_ab, 0) AS net_ab, gross_ba - fee_bps - coalesce(slip_ba, 0) AS net_ba FROM u),
 w AS (SELECT *, greatest(net_ab, net_ba) AS net, greatest(gross_ab, gross_ba) AS gross, CASE WHEN net_ab >= net_ba OR (net_ba IS NULL AND net_ab IS NOT NULL) THEN xab WHEN net_ba IS NOT NULL THEN xba END AS multiple, CASE WHEN net_ab >= net_ba OR (net_ba IS NULL AND net_ab IS NOT NULL) THEN slip_ab WHEN net_ba IS NOT NULL THEN slip_ba END AS slip,
   CASE WHEN net_ab > 0 AND (net_ba IS NULL OR net_ab >= net_ba) THEN 'sell_' || a || '_buy_' || b WHEN net_ba > 0 AND (net_ab IS NULL OR net_ba > net_ab) THEN 'sell_' || b || '_buy_' || a ELSE 'none' END AS opportunity FROM v),
 z AS (SELECT *, coalesce(opportunity <> 'none' AND net >= 2 AND multiple >= 1.25 AND slip <= 60 AND NOT blocked, false) AS actionable, {_relative('mid')} AS mid_diff_bps FROM w),
 l AS (SELECT *, coalesce(abs(mid_diff_bps), 0) AS gap, CASE WHEN blocked THEN 'data_quality_warning' WHEN actionable THEN 'tradable_spread' WHEN gross > 0 AND coalesce(multiple, 0) < 1.25 THEN 'liquidity_warning' WHEN coalesce(abs(mid_diff_bps), 0) >= 2000 OR (net > 0 AND multiple >= 0.75) THEN 'price_divergence' ELSE 'normal' END AS label FROM z)
 SELECT symbol, as_of, a, b, coalesce(greatest(ticker_ts_a, ticker_ts_b), as_of) AS compared_at, CASE WHEN len(fl) = 0 THEN 'ok' ELSE array_to_string(fl, '|') END AS flags, last_a - last_b AS last_diff_abs, {_relative('last')} AS last_diff_bps, mid_a - mid_b AS mid_diff_abs, mid_diff_bps,
  {_relative('bid')} AS bid_diff_bps, {_relative('ask')} AS ask_diff_bps, funding_a - funding_b AS funding_diff_abs, funding_diff_bps, {_relative('mark')} AS mark_diff_bps, gross_ab, gross_ba, fee_bps, fee_source_a, fee_source_b, slip_ab, slip_ba, slip, net_ab, net_ba, net, multiple,
  quote_volume_a / nullif(quote_volume_b, 0) AS quote_volume_ratio, bid_depth_a / nullif(bid_depth_b, 0) AS bid_depth_ratio, ask_depth_a / nullif(ask_depth_b, 0) AS ask_depth_ratio,
  (bid_depth_a + coalesce(ask_depth_a, 0)) / nullif(bid_depth_b + coalesce(ask_depth_b, 0), 0) AS total_depth_ratio, (ask_a - bid_a) / mid_a * 10000 - (ask_b - bid_b) / mid_b * 10000 AS spread_bps_gap, ticker_gap_ms, funding_gap_ms, context_age,
  CASE WHEN coalesce(ask_a, last_a) <= coalesce(ask_b, last_b) THEN a ELSE b END AS best_buy, CASE WHEN bid_a >= bid_b THEN a ELSE b END AS best_sell, opportunity, actionable, label,
  CASE label WHEN 'tradable_spread' THEN least(100, 55 + 4 * net) WHEN 'liquidity_warning' THEN least(95, 35 + 1.2 * gross) WHEN 'price_divergence' THEN least(100, greatest(20, gap * 0.03)) WHEN 'data_quality_warning' THEN least(100, 20 + 12 * len(fl)) ELSE least(25, gap) END AS strength,
  least(100, least(55, gap * 55 / 4000) + CASE WHEN funding_diff_bps IS NULL THEN 0 ELSE least(20, abs(funding_diff_bps) * 4) END + CASE WHEN multiple < 1 THEN least(15, 15 - 15 * multiple) ELSE 0 END + least(30, 6 * len(fl))) AS anomaly,
  100 * (0.4 * CASE WHEN net IS NULL THEN 0 ELSE greatest(0, least(1, (net + 2) / 16)) END + 0.3 * CASE WHEN multiple IS NULL THEN 0 ELSE least(1, multiple / 1.25) END + 0.15 * (1 - least(1, coalesce(spread, 0) / 20)) + CASE WHEN blocked THEN 0 ELSE 0.15 END) AS preference,
  round(((ct IS NOT NULL)::INT + (funding_ts_a IS NOT NULL)::INT + (funding_ts_b IS NOT NULL)::INT) / 3 * 100, 4) AS completeness,
  CASE WHEN adx >= 25 AND macd_hist > 0 AND rsi >= 55 THEN 'trend_up' WHEN adx >= 25 AND macd_hist < 0 AND rsi <= 45 THEN 'trend_down' WHEN atr_pct >= 150 THEN 'high_volatility' WHEN abs(zscore) >= 2 THEN 'stretched' WHEN volatility >= 0.03 THEN 'high_volatility' ELSE 'range' END AS market_regime,
  CASE WHEN funding_a + funding_b IS NULL THEN 'unknown' WHEN abs(funding_diff_bps) >= 5 THEN CASE WHEN funding_a * funding_b < 0 THEN 'funding_direction_conflict' ELSE 'funding_divergence' END WHEN funding_a + funding_b > 0 THEN 'long_crowded' WHEN funding_a + funding_b < 0 THEN 'short_crowded' ELSE 'neutral' END AS funding_regime FROM l"""
COMPARED_NUMBERS = """last_diff_abs last_diff_bps:4 mid_diff_abs mid_diff_bps:4 bid_diff_bps:4 ask_diff_bps:4 funding_diff_abs:9 funding_diff_bps mark_diff_bps:4 gross_ab:4 gross_ba:4 fee_bps slip_ab slip_ba slip net_ab:4 net_ba:4 net:4 multiple
quote_volume_ratio bid_depth_ratio ask_depth_ratio total_depth_ratio spread_bps_gap ticker_gap_ms:3 funding_gap_ms:3 context_age strength anomaly preference completeness"""


SLIDING_SQL = f"""SELECT symbol, count(*) AS windows, max(volume) AS most, sum(trades)::BIGINT AS counted FROM (SELECT symbol, w, sum(amount) AS volume, count(*) AS trades FROM (SELECT symbol, amount, unnest(range(0, 12)) AS k, time_bucket(INTERVAL 5 MINUTES, ts) - k * INTERVAL 5 MINUTES AS w FROM ({TRADES_SQL}) t) GROUP BY ALL) GROUP BY symbol"""


def snapshots(spark, d):
    """Hourly snapshots of each venue, with parts missing where an hour has few trades."""
    t = trades(spark, d)
    bought = F.when(F.col("side") == "buy", F.col("amount")).otherwise(-F.col("amount"))
    by = t.groupBy("symbol", "venue", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(
        F.max("ts").alias("seen"), F.count("*").alias("n"), F.max_by("price", F.struct("ts", "event_id")).alias("close"), F.sum("amount").alias("amount"), F.sum(bought).alias("net")
    )
    step = F.col("close") - F.lag("close").over(W.partitionBy("symbol").orderBy("open_time"))
    c = hourly_bars(spark, d).select("symbol", F.col("open_time").alias("hour"), F.col("close").alias("whole"), "high", "low", step.alias("step"))
    some = lambda x, test: F.when(test, x)
    deep, paid, both = F.col("n") > 1, F.col("amount") > 40, F.col("high") + F.col("low")
    return by.join(c, ["symbol", "hour"], "left").select(
        "symbol", "venue", (F.col("hour") + F.expr("INTERVAL 1 HOUR")).alias("as_of"), F.col("seen").alias("ticker_ts"), some(F.col("seen"), deep).alias("book_ts"), some(F.col("seen"), paid).alias("funding_ts"),
        (F.col("close") * 0.999).alias("bid"), some(F.col("close") * 1.001, F.col("amount") < 190).alias("ask"), F.col("close").alias("last"), some(F.col("amount") * F.col("close"), deep).alias("bid_depth"),
        some(F.col("amount") * F.col("close") * 0.8, deep & (F.col("amount") < 120)).alias("ask_depth"), some(F.col("close") * (1 + F.col("net") / F.col("amount") / 500), F.col("amount") > 60).alias("mark"), (F.col("amount") * F.col("close") * 24).alias("quote_volume"), some(F.col("net") / F.col("amount") / 1000, paid).alias("funding"), some(F.lit(0.0005), F.col("venue") == "v0").alias("taker_fee"),
        some(F.lit(0.0008), F.col("venue") < "v2").alias("maker_fee"), F.when(F.col("whole").isNotNull(), F.col("hour")).alias("context_ts"), (50 + 50 * F.col("step") / both).alias("rsi"), F.col("step").alias("macd_hist"),
        ((F.col("high") - F.col("low")) / F.col("whole") * 100).alias("atr_pct"), ((F.col("high") - F.col("low")) / both / 20).alias("volatility"), (F.abs("step") / both * 100).alias("adx"), (F.col("step") / (F.col("high") - F.col("low") + 1)).alias("zscore"),
    )


def _near_sql(name: str, rows: str, most: int) -> str:
    """The nearest row in time of the same venue, the earlier of two equally near, of equal times the one with the largest id."""
    return f"""{name}_rows AS (SELECT symbol, venue, ts, max(id) AS id FROM ({rows}) q GROUP BY ALL), {name} AS (SELECT t.id, CASE WHEN e.ts IS NULL OR t.ts - l.ts <= e.ts - t.ts THEN l.ts ELSE e.ts END AS ts, CASE WHEN e.ts IS NULL OR t.ts - l.ts <= e.ts - t.ts THEN l.id ELSE e.id END AS of
 FROM t ASOF LEFT JOIN {name}_rows l ON l.symbol = t.symbol AND l.venue = t.venue AND l.ts <= t.ts ASOF LEFT JOIN {name}_rows e ON e.symbol = t.symbol AND e.venue = t.venue AND e.ts >= t.ts), {name}_near AS (SELECT id, ts AS {name}_ts, of AS {name}_id, abs(epoch_us(t2) - epoch_us(ts)) / 1000 AS {name}_gap_ms
 FROM (SELECT {name}.*, t.ts AS t2 FROM {name} JOIN t USING (id)) WHERE abs(epoch_us(t2) - epoch_us(ts)) <= {most} * 1000000::BIGINT)"""


#: hours apart that the given tables' sparse rows may be
ALIGN = venues.Limits(window=7_200, funding_window=43_200, context_age=5_400)
ALIGNED = f"""WITH a AS ({TRADES_SQL}), t AS (SELECT symbol, venue, ts, event_id AS id FROM a WHERE side = 'buy'), {_near_sql('book', "SELECT symbol, venue, ts, event_id AS id FROM a WHERE side = 'sell'", 7200)}, {_near_sql('funding', 'SELECT symbol, venue, ts, event_id AS id FROM a WHERE amount > 80', 43200)},
 fees AS (SELECT symbol, venue, arg_max(event_id % 10, struct_pack(a := ts, b := event_id)) / 10000 AS taker_fee FROM a GROUP BY ALL), c AS (SELECT symbol, open_time::TIMESTAMP AS at, close AS rsi FROM ({BARS_SQL}) b)
 SELECT t.symbol, t.venue, t.ts AS ticker_ts, t.id, coalesce(book_id, -1) AS book_id, book_gap_ms, coalesce(funding_id, -1) AS funding_id, funding_gap_ms, taker_fee, CASE WHEN t.ts - c.at <= INTERVAL 90 MINUTES THEN epoch_us(t.ts - c.at) / 1000 END AS context_gap_ms,
  CASE WHEN t.ts - c.at <= INTERVAL 90 MINUTES THEN rsi END AS rsi FROM t LEFT JOIN book_near USING (id) LEFT JOIN funding_near USING (id) LEFT JOIN fees ON fees.symbol = t.symbol AND fees.venue = t.venue ASOF LEFT JOIN c ON c.symbol = t.symbol AND c.at <= t.ts"""


def _aligned(spark, d):
    t = trades(spark, d).withColumn("id", F.col("event_id"))
    part = lambda test, *more: t.where(test).select("symbol", "venue", "ts", "id", *more)
    fees = t.select("symbol", "venue", F.col("ts").alias("updated_at"), "id", (F.col("id") % 10 / 10_000).alias("taker_fee"))
    context = hourly_bars(spark, d).select("symbol", F.col("open_time").cast("timestamp_ntz").alias("ts"), F.lit(0).alias("id"), F.col("close").alias("rsi"))
    return venues.align(part("side = 'buy'"), part("side = 'sell'", F.col("id").alias("book_id")), part("amount > 80", F.col("id").alias("funding_id")), fees, context, ALIGN).drop("book_ts", "funding_ts", "context_ts").na.fill(-1, ["book_id", "funding_id"])


def register(query) -> None:
    @query(COMPARED, COMPARED_NUMBERS)
    def venue_pairs(spark, d):
        return venues.compare_venues(snapshots(spark, d), LIMITS).drop("index_diff_bps", "depth_imbalance_gap")

    @query(ALIGNED, "book_gap_ms:3 funding_gap_ms:3 context_gap_ms:3")
    def aligned_venues(spark, d):
        return _aligned(spark, d)

    @query(f"SELECT symbol, as_of, (max(last) - min(last)) * 10000 / nullif(avg(last), 0) AS range_bps FROM {SNAPSHOTS} s GROUP BY symbol, as_of", "range_bps")
    def venue_price_ranges(spark, d):
        return venues.range_bps(snapshots(spark, d), ["symbol", "as_of"], "last")

    @query(f"SELECT symbol, ts, venue, price, size, id FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY CASE venue WHEN 'NO' THEN 0 WHEN 'NF' THEN 1 ELSE 2 END, id DESC, price, size, venue) AS k FROM ({QUOTES_SQL}) q) WHERE k = 1")
    def quotes_by_priority(spark, d):
        place = F.when(F.col("venue") == "NO", 0).when(F.col("venue") == "NF", 1).otherwise(2)
        return venues.newest_by_priority(quotes(spark, d), ["symbol", "ts"], place, "id").select("symbol", "ts", "venue", "price", "size", "id")

    @query(f"""SELECT date_trunc('day', open_time)::TIMESTAMP AS day, {', '.join(f"coalesce(sum(volume) FILTER (symbol = '{v}'), 0) AS {v}" for v in VALUES)} FROM ({BARS_SQL}) b GROUP BY 1""", " ".join(VALUES))
    def pivot_daily_volume(spark, d):
        """The symbols are named, so no pass over the data finds them."""
        return hourly_bars(spark, d).groupBy(F.date_trunc("day", "open_time").cast("timestamp_ntz").alias("day")).pivot("symbol", VALUES).agg(F.sum("volume")).na.fill(0.0, VALUES)

    @query(f"""WITH v AS (SELECT DISTINCT symbol, venue, date_trunc('hour', ts)::TIMESTAMP AS hour FROM ({TRADES_SQL}) t), x AS (SELECT symbol, hour FROM v WHERE venue = 'v0'), y AS (SELECT symbol, hour FROM v WHERE venue = 'v1')
 SELECT 'any' AS kind, count(*) AS n FROM (SELECT * FROM x UNION SELECT * FROM y) UNION ALL SELECT 'both', count(*) FROM (SELECT * FROM x INTERSECT SELECT * FROM y) UNION ALL SELECT 'first_only', count(*) FROM (SELECT * FROM x EXCEPT SELECT * FROM y)""")
    def set_operations(spark, d):
        v = trades(spark, d).select("symbol", "venue", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
        x, y = (v.where(F.col("venue") == k).select("symbol", "hour") for k in ("v0", "v1"))
        count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        return count(x.union(y).distinct(), "any").unionByName(count(x.intersect(y), "both")).unionByName(count(x.subtract(y), "first_only"))

    @query(f"SELECT symbol, event_id, sum(amount) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS volume_6h FROM ({TRADES_SQL}) t", "volume_6h")
    def volume_by_time_range(spark, d):
        return trades(spark, d).selectExpr("symbol", "event_id", "sum(amount) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS volume_6h")

    @query(f"SELECT id, md5(symbol || '|' || venue) AS key_md5, sha256(venue || '|' || id) AS key_sha FROM ({QUOTES_SQL}) q")
    def hashed_keys(spark, d):
        return quotes(spark, d).select("id", F.md5(F.concat_ws("|", F.col("symbol").cast("string"), "venue")).alias("key_md5"), F.sha2(F.concat_ws("|", "venue", F.col("id").cast("string")), 256).alias("key_sha"))

    @query(f"SELECT symbol, count(DISTINCT venue) AS venues, max(CASE venue WHEN 'v1' THEN n ELSE 0 END) AS of_v1, sum(n)::BIGINT AS trades FROM (SELECT symbol, venue, count(*) AS n FROM ({TRADES_SQL}) t GROUP BY ALL) GROUP BY symbol")
    def venue_maps(spark, d):
        by = trades(spark, d).groupBy("symbol", "venue").agg(F.count("*").alias("n")).groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("venue", "n"))).alias("m"))
        total = F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda a, x: a + x)
        return by.select("symbol", F.size("m").cast("bigint").alias("venues"), F.coalesce(F.try_element_at("m", F.lit("v1")), F.lit(0)).alias("of_v1"), total.alias("trades"))

    @query("SELECT o_orderkey, o_totalprice FROM orders WHERE substr(md5(o_orderkey::VARCHAR), 1, 2) < '1a'")
    def sampled_orders(spark, d):
        """A tenth of the orders, the same on every run: by a hash of the key, not by chance."""
        return load(spark, d, "orders").where(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 2) < "1a").select("o_orderkey", "o_totalprice")

    @query("SELECT o_orderkey, o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity >= 49)")
    def orders_with_large_lines(spark, d):
        large = load(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
        return load(spark, d, "orders").join(large, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")

    @query("""SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="[^"]*"'))::INT AS links, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages""")
    def page_fields(spark, d):
        p = load(spark, d, "pages")
        return p.select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit('<a href="[^"]*"')).alias("links"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))

    @query("""SELECT user_id, count(*) AS sessions, max(n) AS longest, sum(n)::BIGINT AS events FROM (SELECT user_id, k, count(*) AS n FROM (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (
 SELECT user_id, ts, event_id, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTES)::INT, 0) AS fresh FROM events)) GROUP BY ALL) GROUP BY user_id""")
    def user_sessions(spark, d):
        from ..streaming.jobs import sessions

        s = sessions(load(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")))
        return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("events").alias("longest"), F.sum("events").alias("events"))

    @query(SLIDING_SQL, "most")
    def sliding_volume(spark, d):
        from ..streaming.jobs import sliding_sums

        s = sliding_sums(trades(spark, d).withColumn("ts", F.col("ts").cast("timestamp")))
        return s.groupBy("symbol").agg(F.count("*").alias("windows"), F.max("volume").alias("most"), F.sum("trades").alias("counted"))
