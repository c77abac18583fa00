"""Screens on the given tables, with SQL over lists of each symbol's last closes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import screens
from ..sources.adapters import BARS_SQL, TRADES_SQL, hourly_bars, trades

_RATE = f"(SELECT symbol, arg_max(rate, hour) AS f FROM (SELECT symbol, date_trunc('hour', ts) AS hour, sum(CASE side WHEN 'buy' THEN amount ELSE -amount END) / sum(amount) / 500 AS rate FROM ({TRADES_SQL}) t GROUP BY ALL) GROUP BY symbol)"
#: p and v: closes and volumes of the last 168 bars, newest first; f: the newest hour's imbalance as a funding rate
_LISTS = f"""l AS (SELECT symbol, list(close ORDER BY open_time DESC)[:168] AS p, list(volume ORDER BY open_time DESC)[:168] AS v FROM ({BARS_SQL}) b GROUP BY symbol),
 s AS (SELECT symbol, p, v, f, len(p) AS n, list_avg(p[:20]) AS ma, list_stddev_pop(p[:20]) AS sd, list_avg(p[:50]) AS ma50, list_avg(list_transform(range(1, least(len(p) - 1, 14) + 1), lambda i: abs(p[i] - p[i + 1]))) AS atr,
  coalesce(list_stddev_pop(list_transform(range(1, len(p)), lambda i: ln(p[i] / p[i + 1]))), 0) * sqrt(8760) AS vol FROM l LEFT JOIN {_RATE} r USING (symbol))"""
_CLIP = "round(greatest(0, least(100, {})), 1)"


def _features(spark, d):
    w = W.partitionBy("symbol").orderBy("open_time")
    step = F.col("close") - F.lag("close").over(w)
    bars = hourly_bars(spark, d).withColumns({"step": step, "r": F.ln(F.col("close") / F.lag("close").over(w)), "back": F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("open_time"))) - 1, "n": F.count("*").over(W.partitionBy("symbol"))})
    t = trades(spark, d)
    signed = F.sum(F.when(F.col("side") == "buy", F.col("amount")).otherwise(-F.col("amount")))
    rates = t.groupBy("symbol", F.date_trunc("hour", "ts").alias("hour")).agg((signed / F.sum("amount") / 500).alias("rate")).groupBy("symbol").agg(F.max_by("rate", "hour").alias("funding_rate"))
    return screens.features(bars, rates)


def register(query) -> None:
    @query(f"""WITH {_LISTS}, x AS (SELECT symbol, CASE WHEN n >= 50 THEN {_CLIP.format('50 + (p[1] / ma50 - 1) * 500')} ELSE 50 END AS trend, CASE WHEN n >= 14 THEN {_CLIP.format('50 + (p[1] / p[14] - 1) * 300')} ELSE 50 END AS momentum,
 CASE WHEN n >= 20 THEN {_CLIP.format('list_avg(v[:5]) / list_avg(v[:20]) * 50')} ELSE 50 END AS flow, {_CLIP.format('50 + coalesce(f, 0) * 5000')} AS sentiment, {_CLIP.format('100 - vol * 30')} AS volatility, {_CLIP.format('50 - (p[1] / list_max(p) - 1) * 200')} AS value FROM s),
 c AS (SELECT *, round((trend + momentum + flow + sentiment + volatility + value) / 6, 1) AS composite FROM x) SELECT *, CASE WHEN composite > 75 THEN 'strong_buy' WHEN composite > 60 THEN 'buy' WHEN composite > 40 THEN 'neutral' WHEN composite > 25 THEN 'sell' ELSE 'strong_sell' END AS signal FROM c""",
        "trend momentum flow sentiment volatility value composite")
    def multi_factor_scores(spark, d):
        return screens.multi_factor_scores(_features(spark, d))

    @query(f"""WITH {_LISTS} SELECT symbol, p[1] AS current_price, ma - 2 * sd AS aggressive_long, ma - sd AS conservative_long, list_min(p[:50]) AS support, p[1] + 2 * atr AS take_profit_1, ma + 2 * sd AS take_profit_2, list_max(p[:50]) AS resistance,
 p[1] - 1.5 * atr AS stop_tight, p[1] - 2.5 * atr AS stop_normal, ma - 2 * sd - atr AS stop_wide, ma AS ma20, atr AS atr14 FROM s WHERE n >= 20""", "current_price aggressive_long conservative_long support take_profit_1 take_profit_2 resistance stop_tight stop_normal stop_wide ma20 atr14")  # fmt: skip
    def entry_exit_levels(spark, d):
        return screens.entry_exit(_features(spark, d))

    @query(f"""WITH {_LISTS}, x AS (SELECT symbol, (p[1] / p[20] - 1) * 100 AS c, f, list_max(p[:10]) AS h1, list_max(p[11:20]) AS h2, list_avg(v[:10]) AS v1, list_avg(v[11:20]) AS v2 FROM s WHERE n >= 20)
 SELECT symbol, CASE WHEN f > 0.001 AND c < -2 THEN 'bearish_funding' WHEN f < -0.001 AND c > 2 THEN 'bullish_funding' WHEN h1 > h2 AND v1 < 0.8 * v2 THEN 'bearish_volume' WHEN h1 < h2 AND v1 > 1.2 * v2 THEN 'bullish_volume' END AS type, c AS price_change_20h, f AS funding_rate,
  CASE WHEN abs(c) > 5 THEN 'high' ELSE 'medium' END AS severity FROM x WHERE type IS NOT NULL""", "price_change_20h funding_rate")  # fmt: skip
    def divergence_scan(spark, d):
        return screens.divergences(_features(spark, d))

    @query(f"""WITH {_LISTS}, x AS (SELECT symbol, (p[1] / p[10] - 1) * 100 AS m, 400 * sd / ma AS w, f FROM s WHERE n >= 20) SELECT symbol, CASE WHEN f < 0 THEN 'short_squeeze' ELSE 'long_squeeze' END AS type, m AS momentum_10h, w AS bb_width_pct, f AS funding_rate,
 CASE WHEN abs(m) > 5 THEN 'high' ELSE 'medium' END AS severity FROM x WHERE w < 500 AND (f < -0.0005 AND m > 1 OR f > 0.0005 AND m < -1)""", "momentum_10h bb_width_pct funding_rate")  # fmt: skip
    def squeeze_scan(spark, d):
        """With wide bands allowed, as the given prices have them."""
        return screens.squeezes(_features(spark, d), 500.0, 1.0)

    @query(f"""WITH {_LISTS}, x AS (SELECT symbol, (p[1] / ma - 1) * 100 AS t, (p[1] / p[10] - 1) * 100 AS m, f FROM s WHERE n >= 20), y AS (SELECT *, (t + m + 1000 * coalesce(f, 0)) * 0.4 AS c FROM x)
 SELECT symbol, c AS composite_signal, CASE WHEN c > 0 THEN 'long' ELSE 'short' END AS direction, t AS trend_score, m AS momentum_10h, f AS funding_rate FROM y""", "composite_signal trend_score momentum_10h funding_rate")  # fmt: skip
    def portfolio_signals(spark, d):
        return screens.portfolio_signals(_features(spark, d))

    @query(f"""WITH {_LISTS} SELECT symbol, CASE WHEN n < 50 THEN 'unknown' WHEN p[1] > 1.1 * ma50 THEN 'euphoria' WHEN p[1] > 1.03 * ma50 THEN 'trending_up' WHEN p[1] < 0.9 * ma50 THEN 'panic' WHEN p[1] < 0.97 * ma50 THEN 'trending_down' ELSE 'ranging' END AS regime,
 CASE WHEN vol > 1 THEN 'high' WHEN vol > 0.5 THEN 'medium' ELSE 'low' END AS vol_regime, CASE WHEN vol > 1.5 THEN 'reduce' WHEN vol > 0.5 THEN 'normal' ELSE 'increase' END AS position_sizing FROM s""")  # fmt: skip
    def strategy_by_regime(spark, d):
        return screens.strategy_by_regime(_features(spark, d))

    @query(f"""WITH {_LISTS} SELECT symbol, f AS funding_rate, f * 1095 AS annualized_yield, CASE WHEN f > 0 THEN 'short_perp_long_spot' ELSE 'long_perp_short_spot' END AS direction, CASE WHEN abs(f) < 0.001 THEN 'low' WHEN abs(f) < 0.003 THEN 'medium' ELSE 'high' END AS risk FROM s WHERE abs(f) >= 0.0001""", "funding_rate annualized_yield")
    def funding_carry(spark, d):
        return screens.funding_carry(_features(spark, d), 0.0001)
