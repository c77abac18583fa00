"""Queries over signals, venues, risk and screens; their SQL is written apart from the operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import bars, signals
from ..operators.recursive import recursive
from ..operators.temporal import latest
from ..sources.adapters import BARS_SQL, QUOTES_SQL, TRADES_SQL, hourly_bars, load, trades
from . import smoothed_sql

P = f"""(SELECT *, n - i AS back, sum(r) OVER (PARTITION BY symbol ORDER BY i) AS c FROM (
 SELECT symbol, open_time, open, high, low, close, volume, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol) AS n, coalesce(ln(close / lag(close) OVER w), 0) AS r,
  CASE WHEN high > low THEN (2 * close - high - low) / (high - low) ELSE 0 END AS s FROM ({BARS_SQL}) b WINDOW w AS (PARTITION BY symbol ORDER BY open_time)))"""
HOURS = f"""(SELECT symbol, date_trunc('hour', ts)::TIMESTAMP AS open_time, sum(CASE side WHEN 'buy' THEN amount ELSE 0 END) AS buy, sum(CASE side WHEN 'sell' THEN amount ELSE 0 END) AS sell FROM ({TRADES_SQL}) t GROUP BY ALL)"""
VENUE_CLOSES = f"""(SELECT symbol, venue, date_trunc('hour', ts)::TIMESTAMP AS open_time, arg_max(price, struct_pack(a := ts, b := event_id)) AS close FROM ({TRADES_SQL}) t GROUP BY ALL)"""


def register(query, contagion_sql: str, contagion, clusters_sql: str, clusters) -> None:
    """Registers every query of this module; the arguments after the decorator are queries that some of these read."""

    def panel(spark, d):
        return signals.panel(hourly_bars(spark, d))

    def hours(spark, d):
        side = lambda x: F.sum(F.when(F.col("side") == x, F.col("amount")).otherwise(0.0)).alias(x)
        return trades(spark, d).groupBy("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("open_time")).agg(side("buy"), side("sell"))

    @query(f"""WITH d AS (SELECT symbol, min(c - greatest(0, top)) AS dd FROM (SELECT symbol, c, max(c) OVER (PARTITION BY symbol ORDER BY i) AS top FROM {P}) GROUP BY symbol),
 f AS (SELECT symbol, sum(r) AS total, coalesce(stddev_samp(r) FILTER (back < 20), 0) * sqrt(365) AS year FROM {P} GROUP BY symbol), e AS (SELECT symbol, coalesce(arg_max_null(adx_14, open_time), 0) AS adx, coalesce(arg_max_null(rsi_14, open_time), 50) AS rsi FROM ({smoothed_sql.sql(BARS_SQL)}) x GROUP BY symbol),
 g AS (SELECT * FROM f JOIN d USING (symbol) JOIN e USING (symbol))
 SELECT symbol, CASE WHEN dd <= -0.15 THEN 'crisis' WHEN adx < 25 THEN 'ranging' WHEN total > 0 THEN 'trending_up' ELSE 'trending_down' END AS price_regime,
  CASE WHEN dd <= -0.15 THEN least(1, -dd / 0.3) WHEN adx < 25 THEN greatest(0.3, 1 - adx / 25) ELSE least(1, adx / 50) END AS confidence,
  CASE WHEN year >= 1 THEN 'extreme' WHEN year >= 0.6 THEN 'high' WHEN year >= 0.3 THEN 'normal' ELSE 'low' END AS volatility_regime,
  CASE WHEN rsi < 30 THEN 'strong_down' WHEN rsi < 45 THEN 'weak_down' WHEN rsi < 55 THEN 'neutral' WHEN rsi < 70 THEN 'weak_up' ELSE 'strong_up' END AS momentum_regime FROM g""", "confidence")  # fmt: skip
    def regime_classification(spark, d):
        """With the trend and momentum strength that the indicator engine has for each symbol's last bar."""
        last = latest(recursive(hourly_bars(spark, d)).select("symbol", "open_time", F.col("adx_14").alias("adx"), F.col("rsi_14").alias("rsi")), ["symbol"], "open_time")
        return signals.regimes(panel(spark, d), last)

    @query(f"""WITH c AS (SELECT a.symbol AS a, b.symbol AS b, corr(a.close, b.close) AS corr FROM {P} a JOIN {P} b ON a.open_time = b.open_time WHERE a.symbol < b.symbol GROUP BY ALL)
 SELECT a, b, corr, CASE WHEN abs(corr) < 0.4 THEN 'decorrelated' WHEN abs(corr) < 0.7 THEN 'moderate_corr' ELSE 'high_corr' END AS label,
  CASE WHEN m > 0.7 THEN 'high_correlation' WHEN m > 0.4 THEN 'moderate_correlation' WHEN m > 0.1 THEN 'low_correlation' ELSE 'decorrelated' END AS market FROM c, (SELECT avg(corr) AS m FROM c)""", "corr")  # fmt: skip
    def correlation_regimes(spark, d):
        """Closes of the same hour; an hour that one symbol lacks says nothing of the pair."""
        p = panel(spark, d)
        a, b = (p.select("open_time", F.col("symbol").alias(x), F.col("close").alias("c" + x)) for x in "ab")
        return signals.correlation_labels(a.join(b, "open_time").where("a < b").groupBy("a", "b").agg(F.corr("ca", "cb").alias("corr")))

    @query(f"""WITH f AS (SELECT symbol, count(*) AS n, sum(r) FILTER (back = 0) AS x, avg(r) FILTER (back > 0) AS m, stddev_samp(r) FILTER (back > 0) AS sd, avg(s) FILTER (back <= 4) AS recent, avg(s) FILTER (back > 4) AS earlier FROM {P} GROUP BY symbol),
 g AS (SELECT *, abs(recent - coalesce(earlier, recent)) AS moved FROM f)
 SELECT symbol, CASE WHEN n < 10 OR abs(x) < 0.001 THEN NULL WHEN abs(x) < 0.003 THEN 'warning' ELSE 'critical' END AS rate_severity, CASE WHEN n < 10 OR abs(x) < 0.001 THEN NULL WHEN abs(x) < 0.003 THEN least(0.5, abs(x) / 0.005) ELSE least(1, abs(x) / 0.005) END AS rate_score,
  CASE WHEN n >= 10 AND abs(x) >= 0.001 THEN (x - m) / CASE WHEN sd > 0 THEN sd ELSE 0.0001 END END AS rate_z, CASE WHEN moved >= 0.6 THEN 'critical' WHEN moved >= 0.4 THEN 'warning' END AS break_severity, CASE WHEN moved >= 0.4 THEN least(1, moved / 0.8) END AS break_score FROM g""",
        "rate_score rate_z break_score")
    def series_alerts(spark, d):
        return signals.alerts(panel(spark, d))

    @query(f"SELECT x.open_time, x.symbol AS a, y.symbol AS b, abs(x.r - y.r) AS gap FROM {P} x JOIN {P} y USING (open_time) WHERE x.symbol < y.symbol AND x.r * y.r < 0", "gap")
    def opposite_signals(spark, d):
        return signals.opposites(panel(spark, d))

    @query(f"""WITH f AS (SELECT symbol, count(*) AS n, sum(s) FILTER (back = 0) AS x, avg(s) FILTER (back > 0) AS m, stddev_samp(s) FILTER (back > 0) AS sd, avg(s) FILTER (back < 5) - avg(s) FILTER (back >= 5 AND back < 10) AS d,
   sum(r) FILTER (back < 5) AS near, sum(r) FILTER (back >= 5 AND back < 10) AS far FROM {P} GROUP BY symbol), g AS (SELECT *, (x - m) / CASE WHEN sd > 0 THEN sd ELSE 0.1 END AS z FROM f),
 h AS (SELECT symbol, z, d, CASE WHEN n < 20 THEN NULL WHEN x >= 0.7 OR z >= 2 THEN 'bearish' WHEN x <= -0.7 OR z <= -2 THEN 'bullish' END AS reversal,
   CASE WHEN n < 10 THEN NULL WHEN d > 0.1 AND near > 0.02 AND far > 0 THEN 'bullish' WHEN d < -0.1 AND near < -0.02 AND far < 0 THEN 'bearish' END AS momentum,
   CASE WHEN n < 10 THEN NULL WHEN near > 0.03 AND d < -0.15 THEN 'bearish' WHEN near < -0.03 AND d > 0.15 THEN 'bullish' END AS divergence FROM g)
 SELECT symbol, z, reversal, CASE WHEN reversal <> '' THEN least(1, abs(z) / 3) END AS reversal_strength, momentum, CASE WHEN momentum <> '' THEN least(1, 2 * abs(d)) END AS momentum_strength, divergence, CASE WHEN divergence <> '' THEN least(1, 2 * abs(d)) END AS divergence_strength FROM h""",
        "z reversal_strength momentum_strength divergence_strength")
    def sentiment_signals(spark, d):
        return signals.sentiment_signals(panel(spark, d))

    lagged = f"""(SELECT a.symbol, l.lag, CASE WHEN count(*) >= 10 THEN round(coalesce(corr(a.s, b.r), 0), 4) ELSE 0 END AS corr, any_value(a.n) AS n FROM {P} a, (SELECT unnest(range(-12, 13)) AS lag) l, {P} b WHERE a.symbol = b.symbol AND b.i = a.i + l.lag GROUP BY ALL)"""

    @query(f"SELECT symbol, lag::INT AS lag, corr FROM {lagged}", "corr:4")
    def sentiment_lag_correlations(spark, d):
        return signals.lagged_correlations(panel(spark, d))

    @query(f"""WITH b AS (SELECT symbol, n, CASE WHEN corr = 0 THEN 0 ELSE lag END AS lag, corr FROM {lagged} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY abs(corr) DESC, lag) = 1)
 SELECT symbol, (CASE WHEN n >= 30 THEN lag ELSE 0 END)::INT AS optimal_lag, CASE WHEN n < 30 THEN 'none' WHEN lag > 0 AND abs(corr) > 0.2 THEN 'sentiment_leads_price' WHEN lag < 0 AND abs(corr) > 0.2 THEN 'price_leads_sentiment' WHEN abs(corr) > 0.3 THEN 'bidirectional' ELSE 'none' END AS direction,
  CASE WHEN n >= 30 AND abs(corr) < 1 THEN corr * corr / (1 - corr * corr) * (n - 2) ELSE 0 END AS f_statistic, CASE WHEN n >= 30 THEN greatest(0.001, 1 - 2 * abs(corr)) ELSE 1 END AS p_value, n >= 30 AND abs(corr) > 0.2 AND lag <> 0 AS significant FROM b""", "f_statistic:4 p_value:4")  # fmt: skip
    def sentiment_lead(spark, d):
        p = panel(spark, d)
        return signals.lead(signals.lagged_correlations(p), p.groupBy("symbol").agg(F.count("*").alias("n")))

    @query(f"""WITH x AS (SELECT a.symbol, a.venue AS a, b.venue AS b, open_time, a.close AS ca, b.close AS cb, abs(a.close - b.close) / ((a.close + b.close) / 2) * 10000 AS bps FROM {VENUE_CLOSES} a JOIN {VENUE_CLOSES} b USING (symbol, open_time) WHERE a.venue < b.venue)
 SELECT symbol, a, b, count(*) AS hours, avg(bps) AS avg_spread_bps, (epoch(max(open_time)) - epoch(min(open_time)))::BIGINT AS duration_seconds, count(*)::DOUBLE AS frequency_per_hour, CASE WHEN count(*) >= 5 THEN coalesce(corr(ca, cb), 0) ELSE 0 END AS correlation,
  CASE WHEN count(*) FILTER (bps > 5) = 0 THEN 100 ELSE greatest(0, 100 - least(50, 5 * count(*) FILTER (bps > 5)) - least(30, avg(bps) FILTER (bps > 5)) - least(20, greatest(0, max(bps) - 50) / 10 * 5)) END AS efficiency FROM x GROUP BY symbol, a, b HAVING count(*) >= 2""",
        "avg_spread_bps correlation efficiency")
    def venue_statistics(spark, d):
        return signals.venue_statistics(bars.tumble(trades(spark, d), "hour", ("symbol", "venue")))

    @query(f"""WITH h AS (SELECT *, abs(buy - sell) / nullif(buy + sell, 0) AS v, sum(buy - sell) OVER w AS cvd, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol) AS n FROM {HOURS} WINDOW w AS (PARTITION BY symbol ORDER BY open_time)),
 l AS (SELECT symbol, v AS x FROM h WHERE i = n)
 SELECT symbol, (avg(buy - sell) > 0 AND regr_slope(cvd, i) > 0)::INT AS accumulation, (avg(buy - sell) < 0 AND regr_slope(cvd, i) < 0)::INT AS distribution, any_value(x) AS imbalance, 100.0 * count(*) FILTER (v <= x AND i < n) / (any_value(n) - 1) AS imbalance_percentile FROM h JOIN l USING (symbol) GROUP BY symbol""",
        "imbalance imbalance_percentile")
    def flow_states(spark, d):
        return signals.flow_states(hours(spark, d))

    @query(f"""WITH RECURSIVE c AS (SELECT symbol, direction, distance_pct AS x, total_size_usd AS size, row_number() OVER (PARTITION BY symbol, direction ORDER BY distance_pct, total_size_usd) AS k FROM ({clusters_sql}) q WHERE total_size_usd > 0 AND distance_pct > 0),
 r AS (SELECT DISTINCT symbol, direction, 0::BIGINT AS k, 100000.0::DOUBLE AS total, 100000.0::DOUBLE AS impact FROM c UNION ALL
  SELECT c.symbol, c.direction, c.k, r.total + exp(-c.x / 2) * least(r.impact, c.size), exp(-c.x / 2) * least(r.impact, c.size) / 2 FROM r JOIN c ON c.symbol = r.symbol AND c.direction = r.direction AND c.k = r.k + 1 WHERE exp(-c.x / 2) * least(r.impact, c.size) >= 0.01 * c.size)
 SELECT symbol, direction, max(total) AS total_usd FROM r GROUP BY ALL""", "total_usd:2")  # fmt: skip
    def cascade_chain(spark, d):
        return signals.cascade_chain(clusters(spark, d), 100_000.0)

    @query(f"""WITH x AS (SELECT symbol, CASE WHEN hour(open_time) <= 4 THEN 0 WHEN hour(open_time) <= 12 THEN 8 ELSE 16 END AS settlement_hour, r FROM {P})
 SELECT s.symbol, g.h::INT AS settlement_hour, count(x.r) AS samples, coalesce(avg(r), 0) AS avg_rate, coalesce(stddev_samp(r), 0) AS std_rate, coalesce(avg((r > 0)::INT), 0) AS positive_share FROM (SELECT DISTINCT symbol FROM x) s CROSS JOIN (SELECT unnest([0, 8, 16]) AS h) g
 LEFT JOIN x ON x.symbol = s.symbol AND x.settlement_hour = g.h GROUP BY ALL""", "avg_rate std_rate positive_share")  # fmt: skip
    def settlement_cycle(spark, d):
        return signals.settlement_cycle(panel(spark, d).select("symbol", F.col("open_time").alias("ts"), F.col("r").alias("rate")))

    @query(f"""WITH x AS (SELECT h.symbol, buy - sell AS net, buy + sell AS gross, r, i, back, n, 2.0::DOUBLE / (n + 1) AS a, max(open_time) OVER (PARTITION BY symbol) - open_time < INTERVAL 24 HOURS AS day FROM {HOURS} h JOIN {P} p USING (symbol, open_time))
 SELECT symbol, coalesce(sum(net) FILTER (day) / nullif(sum(gross) FILTER (day), 0), 0) AS net_mint, sum(net * CASE WHEN i = 1 THEN pow(1 - a, n - 1) ELSE a * pow(1 - a, back) END) AS smoothed, coalesce(corr(coalesce(net / nullif(gross, 0), 0), r), 0) AS correlation FROM x GROUP BY symbol""", "net_mint smoothed correlation")  # fmt: skip
    def supply_pulse(spark, d):
        return signals.supply_pulse(hours(spark, d), panel(spark, d))

    @query(f"SELECT symbol, venue, flow FROM (SELECT symbol, venue, sum(CASE side WHEN 'buy' THEN amount ELSE -amount END) AS flow FROM ({TRADES_SQL}) t GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY flow DESC, venue) = 1", "flow")
    def dominant_venue(spark, d):
        return signals.dominant_venue(trades(spark, d).select("symbol", "venue", F.when(F.col("side") == "buy", F.col("amount")).otherwise(-F.col("amount")).alias("flow")))

    @query(f"""SELECT symbol, ret AS sector_return, vol AS volatility, m AS momentum, CASE WHEN ret > 0 AND m > 0.5 THEN 'leading' WHEN ret > 0 THEN 'weakening' WHEN m > -0.5 THEN 'improving' ELSE 'lagging' END AS phase FROM (
 SELECT symbol, ret, vol, CASE WHEN vol > 0 THEN ret / vol ELSE 0 END AS m FROM (SELECT symbol, sum(r) AS ret, coalesce(stddev_samp(r), 0) AS vol FROM {P} WHERE back < 168 GROUP BY symbol))""", "sector_return volatility momentum")  # fmt: skip
    def sector_rotation(spark, d):
        return signals.sectors(panel(spark, d))

    @query(f"""SELECT coalesce((SELECT avg(v) FROM (SELECT stddev_samp(r) AS v FROM {P} GROUP BY symbol)) / nullif((SELECT stddev_samp(m) FROM (SELECT sum(r) / (SELECT count(DISTINCT symbol) FROM {P}) AS m FROM {P} GROUP BY open_time)), 0), 0) AS ratio""", "ratio")
    def diversification_ratio(spark, d):
        p = panel(spark, d)
        return signals.diversification(p.join(F.broadcast(p.agg(F.count_distinct("symbol").alias("k"))), F.lit(True)))

    @query(f"""WITH x AS (SELECT symbol, close / avg(close) OVER (PARTITION BY symbol) AS price, open_time, 0.05 + abs(s) / 2 AS v FROM {P}), z AS (SELECT *, abs(price - 1) / v AS z FROM x), t AS (SELECT *, 1 / (1 + 0.2316419 * z) AS t FROM z)
 SELECT symbol, open_time, CASE WHEN price = 1 THEN 0 ELSE greatest(0, least(1, 2 * 0.3989422804 * exp(-z * z / 2) * (0.3193815 * t - 0.3565638 * t * t + 1.781478 * t * t * t - 1.821256 * t * t * t * t + 1.330274 * t * t * t * t * t))) END AS probability FROM t""", "probability")  # fmt: skip
    def depeg_probability(spark, d):
        p = panel(spark, d).withColumn("price", F.col("close") / F.avg("close").over(W.partitionBy("symbol")))
        return p.select("symbol", "open_time", signals.depeg_probability(F.col("price"), 0.05 + F.abs("s") / 2).alias("probability"))

    @query(f"""SELECT greatest(0, least(100, 40 * avg(least(1, abs(covar_95) / 0.1)) + 30 * avg(least(1, abs(conditional_correlation))) + 30 * avg(least(1, abs(tail_beta) / 3)))) AS score FROM ({contagion_sql}) q""", "score")
    def systemic_risk(spark, d):
        return signals.systemic_risk(contagion(spark, d))

    @query(f"""WITH t AS (SELECT symbol, count(*) >= 10 AND abs(sum(s) FILTER (back = 0) - avg(s) FILTER (back > 0)) >= 2 * stddev_samp(s) FILTER (back > 0) AND stddev_samp(s) FILTER (back > 0) > 0 AS triggered FROM {P} GROUP BY symbol)
 SELECT a.symbol, l.lag::INT AS lag, CASE WHEN count(*) >= 10 THEN coalesce(pow(corr(a.s, b.r), 2), 0) ELSE 0 END AS r2, any_value(triggered) AS triggered FROM {P} a JOIN t USING (symbol), (SELECT unnest(range(1, 6)) AS lag) l, {P} b WHERE b.symbol = a.symbol AND b.i = a.i + l.lag GROUP BY ALL""", "r2")  # fmt: skip
    def predictive_power(spark, d):
        return signals.predictive_power(panel(spark, d))

    @query(f"""WITH f AS (SELECT p.symbol, count(*) AS n, any_value(x) AS x, stddev_pop(r) FILTER (i > 1) * sqrt(24) AS daily_vol, avg(close) AS m, stddev_pop(close) AS sd, avg(CASE WHEN close < x THEN 1.0 WHEN close = x THEN 0.5 ELSE 0 END) AS place, regr_slope(close, i) AS slope,
   max(close) FILTER (i > n // 2) - max(close) FILTER (i <= n // 2) AS a, max(volume) FILTER (i > n // 2) - max(volume) FILTER (i <= n // 2) AS b FROM {P} p JOIN (SELECT symbol, close AS x FROM {P} WHERE back = 0) l USING (symbol) GROUP BY p.symbol), g AS (SELECT *, daily_vol * sqrt(365) AS y FROM f)
 SELECT symbol, daily_vol, y AS annual_vol, CASE WHEN y < 0.5 THEN round(y * 50, 1) WHEN y < 1 THEN round(25 + (y - 0.5) * 50, 1) WHEN y < 2 THEN round(50 + (y - 1) * 25, 1) ELSE least(100, round(75 + (y - 2) * 12.5, 1)) END AS risk_score,
  CASE WHEN y < 0.5 THEN 'low' WHEN y < 1 THEN 'medium' WHEN y < 2 THEN 'high' ELSE 'extreme' END AS risk_label, 100 * place AS percentile, (x - m) / sd AS z, slope, CASE WHEN slope > 0.005 THEN 'improving' WHEN slope < -0.005 THEN 'declining' ELSE 'stable' END AS trend,
  CASE WHEN a > 0 AND b < 0 THEN 'bearish' WHEN a < 0 AND b > 0 THEN 'bullish' ELSE 'none' END AS divergence, abs(a - b) / (abs(a) + abs(b) + 1e-9) AS divergence_strength FROM g""", "daily_vol annual_vol percentile z slope divergence_strength")  # fmt: skip
    def series_summary(spark, d):
        return signals.series_summary(panel(spark, d))

    @query(f"""SELECT *, row_number() OVER (ORDER BY abs(change) DESC, symbol)::INT AS mover_rank, row_number() OVER (ORDER BY volume DESC, symbol)::INT AS volume_rank, row_number() OVER (ORDER BY volatility DESC, symbol)::INT AS risk_rank FROM (
 SELECT symbol, sum(r) FILTER (back < 24) AS change, sum(volume) FILTER (back < 24) AS volume, stddev_pop(r) FILTER (back < 168) AS volatility FROM {P} GROUP BY symbol)""", "change volume volatility")  # fmt: skip
    def symbol_rankings(spark, d):
        return signals.rankings(panel(spark, d))

    @query(f"""SELECT symbol, open_time, g AS gap_pct, CASE WHEN g > 0 THEN 'up' ELSE 'down' END AS direction FROM (SELECT symbol, open_time, (open - lag(close) OVER (PARTITION BY symbol ORDER BY open_time)) / lag(close) OVER (PARTITION BY symbol ORDER BY open_time) * 100 AS g FROM ({BARS_SQL}) b) WHERE abs(g) >= 1""", "gap_pct")
    def price_gaps(spark, d):
        return signals.gaps(panel(spark, d))

    @query(f"""WITH x AS (SELECT symbol, hour(open_time)::INT AS hour, (isodow(open_time) - 1)::INT AS weekday, volume, (high - low) / low * 100 AS rng FROM ({BARS_SQL}) b)
 SELECT symbol, hour, -1 AS weekday, count(*) AS bars, avg(volume) AS volume, avg(rng) AS range_pct FROM x GROUP BY symbol, hour UNION ALL SELECT symbol, -1, weekday, count(*), avg(volume), avg(rng) FROM x GROUP BY symbol, weekday
 UNION ALL SELECT symbol, -1, -1, count(*), avg(volume), avg(rng) FROM x GROUP BY symbol""", "volume range_pct")  # fmt: skip
    def liquidity_by_time(spark, d):
        return signals.liquidity_by_time(panel(spark, d))

    @query(f"""WITH x AS (SELECT symbol, venue, date_trunc('hour', ts)::TIMESTAMP AS open_time, max(price * amount) AS largest_trade, avg(price * amount) AS avg_trade, count(*) AS trade_count, sum(CASE side WHEN 'buy' THEN price * amount ELSE -price * amount END) AS net_taker FROM ({TRADES_SQL}) t GROUP BY ALL),
 l AS (SELECT symbol, venue, list_sort(list(largest_trade)) AS v FROM x GROUP BY ALL) SELECT x.*, v[len(v) * 95 // 100 + 1] AS threshold FROM x JOIN l USING (symbol, venue) WHERE largest_trade >= v[len(v) * 95 // 100 + 1]""", "largest_trade avg_trade net_taker threshold")  # fmt: skip
    def large_trades(spark, d):
        return signals.large_trades(bars.trade_flow(trades(spark, d)))

    @query(f"""SELECT symbol, open_time, back, zscore, current_price, mean_price, (current_price / mean_price - 1) * 100 AS deviation_pct, CASE WHEN zscore > 0 THEN 'overbought' ELSE 'oversold' END AS direction FROM (SELECT symbol, open_time, back, close AS current_price, avg(close) OVER w AS mean_price,
 (close - avg(close) OVER w) / nullif(stddev_pop(close) OVER w, 0) AS zscore, count(*) OVER w AS held FROM {P} WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) WHERE held = 50 AND abs(zscore) >= 1""", "zscore mean_price deviation_pct")  # fmt: skip
    def reversion_candidates(spark, d):
        """Every bar, with a lower threshold than the usual 2, at which few of the given tables' symbols are candidates now."""
        return signals.reversion_candidates(panel(spark, d), threshold=1.0)

    numbers = "l_orderkey, l_linenumber, l_discount * 10 AS u, l_tax * 12.5 AS v, l_quantity * 2 AS h, l_discount * 20 - 1 AS s, l_tax * 25 - 1 AS r"

    @query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN v > 0 THEN u / v ELSE 0 END AS holder_ratio, s - r AS rate_spread, CASE WHEN h > 0 THEN s / h ELSE 0 END AS staking_impact, CASE WHEN u > 0 THEN h / u ELSE 0 END AS hash_price_ratio, abs(s - r) > 0.1 AS jumped,
  CASE WHEN s * r >= 0 OR (abs(s) < 0.01 AND abs(r) < 0.01) THEN 'none' WHEN s > 0 THEN 'bullish_divergence' ELSE 'bearish_divergence' END AS divergence, CASE WHEN s * r >= 0 OR (abs(s) < 0.01 AND abs(r) < 0.01) THEN 0 ELSE least(1, abs(s - r) / greatest(abs(s), abs(r), 0.01) / 2) END AS strength,
  CASE WHEN h < 60 THEN 0 ELSE greatest(0, least(1, (h - 60) / 160 + v / 2)) END AS reversal FROM (SELECT {numbers} FROM lineitem) x""", "holder_ratio:8 rate_spread:8 staking_impact:8 hash_price_ratio:8 strength:8 reversal:8")  # fmt: skip
    def scores_ratios(spark, d):
        """Ratios, differences and jumps; reversal blends the base of an extreme score with the share v of past reversals."""
        x = load(spark, d, "lineitem").selectExpr(*numbers.split(", "))
        ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
        apart = (F.signum("s") * F.signum("r") < 0) & ((F.abs("s") >= 0.01) | (F.abs("r") >= 0.01))
        kind = F.when(~apart, "none").when(F.col("s") > 0, "bullish_divergence").otherwise("bearish_divergence")
        strength = F.when(apart, F.least(F.lit(1.0), F.abs(F.col("s") - F.col("r")) / F.greatest(F.abs("s"), F.abs("r"), F.lit(0.01)) / 2)).otherwise(0.0)
        base = (F.col("h") - 60) / 40 * 0.5
        return x.select(
            "l_orderkey", "l_linenumber", ratio("u", "v").alias("holder_ratio"), (F.col("s") - F.col("r")).alias("rate_spread"), ratio("s", "h").alias("staking_impact"), ratio("h", "u").alias("hash_price_ratio"),
            (F.abs(F.col("s") - F.col("r")) > 0.1).alias("jumped"), kind.alias("divergence"), strength.alias("strength"), F.when(F.col("h") < 60, 0.0).otherwise(signals.clipped(base * 0.5 + F.col("v") * 0.5, 0, 1)).alias("reversal"),
        )

    @query(f"""WITH b AS (SELECT symbol, ts, venue, price, size, id FROM ({QUOTES_SQL}) q) SELECT symbol, coalesce(avg(z_price), avg(z_size)) * (count(z_price) > 0)::INT AS z_of_price, (coalesce(avg(z_price), 0) * (count(z_price) > 0)::INT + coalesce(avg(z_size), 0) * (count(z_size) > 0)::INT) / nullif((count(z_price) > 0)::INT + (count(z_size) > 0)::INT, 0) AS composite FROM (
 SELECT symbol, (price - avg(price) OVER w) / nullif(stddev_pop(price) OVER w, 0) AS z_price, (size - avg(size) OVER w) / nullif(stddev_pop(size) OVER w, 0) AS z_size, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, id DESC) AS k FROM b WINDOW w AS (PARTITION BY symbol)) WHERE k <= 5 GROUP BY symbol""", "z_of_price composite")  # fmt: skip
    def feature_composite(spark, d):
        """The mean of a symbol's component scores, without those that are missing, over its five newest quotes."""
        from ..sources.adapters import quotes

        own = W.partitionBy("symbol")
        z = lambda c: F.try_divide(F.col(c) - F.avg(c).over(own), F.stddev_pop(c).over(own))
        q = quotes(spark, d).select("symbol", z("price").alias("zp"), z("size").alias("zs"), F.row_number().over(own.orderBy(F.desc("ts"), F.desc("id"))).alias("k")).where("k <= 5")
        f = q.groupBy("symbol").agg(F.avg("zp").alias("z_of_price"), F.avg("zs").alias("z_of_size"))
        there = F.filter(F.array("z_of_price", "z_of_size"), lambda x: x.isNotNull())
        return f.select("symbol", "z_of_price", F.try_divide(F.aggregate(there, F.lit(0.0), lambda a, x: a + x), F.size(there)).alias("composite"))


