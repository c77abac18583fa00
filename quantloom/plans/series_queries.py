"""Queries over single series, with their SQL; the catalog imports this module."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import cross, series
from ..sources.adapters import BARS_SQL, QUOTES_SQL, TRADES_SQL, hourly_bars, load, quotes, trades

RETURNS = f"(SELECT symbol, open_time, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY open_time)) AS r FROM ({BARS_SQL}) b)"


def _numbered_sql(source: str, value: str) -> str:
    return f"""(SELECT symbol, i, v, n, n - i AS back FROM (SELECT symbol, {value} AS v, row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS i,
 count(*) OVER (PARTITION BY symbol) AS n FROM {source} s WHERE {value} IS NOT NULL))"""


CLOSES, NUMBERED_RETURNS = _numbered_sql(f"({BARS_SQL})", "close"), _numbered_sql(RETURNS, "r")
AC = f"""(SELECT symbol, lag, greatest(-1, least(1, coalesce(avg(d * e) / nullif(any_value(var), 0), 0))) AS ac, any_value(n) AS n FROM (
 SELECT a.symbol, g.lag, b.v - m.mean AS d, a.v - m.mean AS e, m.var, m.n FROM {CLOSES} a, (SELECT unnest(range(1, 25)) AS lag) g, {CLOSES} b,
 (SELECT symbol, avg(v) AS mean, var_pop(v) AS var, count(*) AS n FROM {CLOSES} GROUP BY symbol) m WHERE b.symbol = a.symbol AND b.i = a.i + g.lag AND m.symbol = a.symbol) GROUP BY symbol, lag)"""


def register(query) -> None:
    """Registers every query of this module with the catalog's decorator."""

    def closes(spark, d):
        return series.numbered(hourly_bars(spark, d), "open_time", "close")

    def returns(spark, d):
        return series.numbered(cross.log_returns(hourly_bars(spark, d)), "open_time", "r")

    @query(f"SELECT symbol, lag::INT AS lag, ac, n FROM {AC}", "ac")
    def autocorrelation_by_lag(spark, d):
        return series.autocorrelation(closes(spark, d), 24)

    @query(f"""SELECT symbol, coalesce(arg_min(lag - 1 + coalesce((before - 0.5) / nullif(before - ac, 0), 1.0), lag) FILTER (ac <= 0.5), floor(any_value(n) / 2)::DOUBLE) AS half_life
 FROM (SELECT *, coalesce(lag(ac) OVER (PARTITION BY symbol ORDER BY lag), 1.0) AS before FROM {AC}) GROUP BY symbol""", "half_life")  # fmt: skip
    def signal_half_life(spark, d):
        return series.half_life(closes(spark, d), 24)

    @query(f"""SELECT symbol, CASE WHEN any_value(n) >= 30 THEN stddev_samp(v) FILTER (back < 30) * sqrt(365) ELSE 0 END AS realized, CASE WHEN any_value(n) >= 10 THEN sqrt(
 pow(0.94, any_value(n) - 10) * avg(v * v) FILTER (i <= 10) + coalesce(sum(0.06 * pow(0.94, back) * v * v) FILTER (i > 10), 0)) * sqrt(365) ELSE 0 END AS ewma FROM {NUMBERED_RETURNS} GROUP BY symbol""", "realized ewma")  # fmt: skip
    def volatility_forecast(spark, d):
        return series.volatility_forecast(returns(spark, d))

    @query(f"""WITH s AS (SELECT r.symbol, any_value(n) AS n, any_value(x) AS x, avg(v) AS mean, avg(v) FILTER (back < 3) AS recent, avg(v) FILTER (back > 0) AS before, stddev_samp(v) FILTER (back > 0) AS s,
   count(*) FILTER (back > 0 AND v <= x) AS below, sum(v) FILTER (back < 21) AS cumulative FROM {NUMBERED_RETURNS} r JOIN (SELECT symbol, v AS x FROM {NUMBERED_RETURNS} WHERE back = 0) l USING (symbol) GROUP BY r.symbol),
 z AS (SELECT *, CASE WHEN n < 10 THEN 0 ELSE (x - before) / CASE WHEN coalesce(s, 0) = 0 THEN 0.0001 ELSE s END END AS z FROM s)
 SELECT symbol, CASE WHEN n < 10 THEN x ELSE 0.3 * mean + 0.7 * recent END AS next, z, CASE WHEN n >= 10 THEN 100.0 * below / (n - 1) ELSE 50 END AS percentile, cumulative, greatest(-1, least(1, -z / 4)) AS reversion FROM z""",
        "next z percentile cumulative reversion")
    def rate_model(spark, d):
        return series.rate_model(returns(spark, d))

    @query(f"SELECT symbol, coalesce((max(v) FILTER (back = 0) - avg(v) FILTER (back > 0)) / nullif(stddev_pop(v) FILTER (back > 0), 0), 0) AS surprise FROM {CLOSES} GROUP BY symbol", "surprise")
    def signal_surprise(spark, d):
        return series.surprise(closes(spark, d))

    @query(f"""SELECT symbol, min(s - greatest(0, peak)) AS drawdown FROM (SELECT symbol, s, max(s) OVER (PARTITION BY symbol ORDER BY i) AS peak FROM (
 SELECT symbol, i, sum(v) OVER (PARTITION BY symbol ORDER BY i) AS s FROM {NUMBERED_RETURNS})) GROUP BY symbol""", "drawdown")  # fmt: skip
    def max_drawdown(spark, d):
        return series.max_drawdown(returns(spark, d))

    @query(f"""WITH k AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS k FROM ({BARS_SQL}) b),
 r AS (SELECT symbol, max(close) FILTER (k = 1) / nullif(max(close) FILTER (k = 24), 0) - 1 AS r1d, max(close) FILTER (k = 1) / nullif(max(close) FILTER (k = 72), 0) - 1 AS r3d,
   max(close) FILTER (k = 1) / nullif(max(close) FILTER (k = 168), 0) - 1 AS r7d FROM k GROUP BY symbol),
 s AS (SELECT r.*, r.r7d / nullif(b.r7d, 0) AS rs_7d, r.r3d / nullif(b.r3d, 0) AS rs_3d FROM r, r b WHERE b.symbol = 'click' AND r.symbol <> 'click')
 SELECT symbol, r1d, r3d, r7d, rs_7d, CASE WHEN rs_7d > rs_3d THEN 'rising' ELSE 'falling' END AS momentum, row_number() OVER (ORDER BY rs_7d DESC NULLS LAST, symbol) AS rank FROM s""", "r1d r3d r7d rs_7d")  # fmt: skip
    def relative_strength(spark, d):
        return series.relative_strength(hourly_bars(spark, d), "click")

    past = f"(SELECT symbol, ts, arg_max(price, id) AS past FROM ({QUOTES_SQL}) GROUP BY symbol, ts)"
    asof = "ASOF LEFT JOIN {p} {a} ON q.symbol = {a}.symbol AND q.ts - INTERVAL {s} SECOND >= {a}.ts"

    @query(f"""SELECT q.symbol, q.ts, q.id, q.price AS v, q.price - a.past AS change_86400, q.price - b.past AS change_604800 FROM ({QUOTES_SQL}) q {asof.format(p=past, a='a', s=86400)} {asof.format(p=past, a='b', s=604800)}""",
        "change_86400 change_604800")
    def changes_since(spark, d):
        return series.changes_since(quotes(spark, d).select("symbol", "ts", "id", F.col("price").alias("v")), [86_400, 604_800])

    @query(f"""SELECT symbol, time_bucket(INTERVAL 5 MINUTE, ts)::TIMESTAMP AS open_time, coalesce(sum(price * amount) FILTER (side = 'buy'), 0) AS long_usd, coalesce(sum(price * amount) FILTER (side = 'sell'), 0) AS short_usd,
 count(*) FILTER (side = 'buy') AS longs, count(*) FILTER (side = 'sell') AS shorts, max(price * amount) AS largest FROM ({TRADES_SQL}) t GROUP BY ALL""", "long_usd short_usd largest")  # fmt: skip
    def liquidation_bars(spark, d):
        side = F.when(F.col("side") == "buy", "long").otherwise("short").alias("side")
        return series.liquidation_bars(trades(spark, d).select("symbol", "ts", side, (F.col("price") * F.col("amount")).alias("usd")))

    @query(f"""WITH s AS (SELECT hour(open_time) AS hour, symbol AS name, close - open AS strength FROM ({BARS_SQL}) b), g AS (
 SELECT hour::INT AS hour, count(*) FILTER (strength > 0) AS up, count(*) FILTER (strength < 0) AS down, count(*) AS n, arg_max(name, struct_pack(a := -strength, b := name)) FILTER (strength < 0) AS lowest,
  arg_max(name, struct_pack(a := strength, b := name)) FILTER (strength > 0) AS highest FROM s GROUP BY hour)
 SELECT hour, 100.0 * greatest(up, down) / n AS crowding, CASE WHEN up >= down THEN lowest ELSE highest END AS contrarian FROM g""", "crowding")  # fmt: skip
    def crowding_by_hour(spark, d):
        signals = hourly_bars(spark, d).select(F.hour("open_time").alias("hour"), F.col("symbol").alias("name"), (F.col("close") - F.col("open")).alias("strength"))
        score, contrarian = series.crowding(signals)
        return signals.groupBy("hour").agg(score.alias("crowding"), contrarian.alias("contrarian"))

    @query(f"""SELECT symbol, month(open_time)::INT AS month, count(*) AS n, avg((close - open) / nullif(open, 0)) AS mean_return, coalesce(stddev_samp((close - open) / nullif(open, 0)), 0) AS std_return FROM ({BARS_SQL}) b GROUP BY ALL""", "mean_return std_return")
    def seasonality_monthly(spark, d):
        r = F.try_divide(F.col("close") - F.col("open"), "open")
        return hourly_bars(spark, d).groupBy("symbol", F.month("open_time").alias("month")).agg(F.count("*").alias("n"), F.avg(r).alias("mean_return"), F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("std_return"))

    @query(f"""SELECT symbol, open_time, volume, ratio, CASE WHEN ratio >= 6 THEN 'critical' ELSE 'warning' END AS level FROM (SELECT symbol, open_time, volume, volume / nullif(avg(volume) OVER w, 0) AS ratio, count(*) OVER w AS n FROM ({BARS_SQL}) b
 WINDOW w AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE n >= 19 AND ratio >= 3""", "volume ratio")  # fmt: skip
    def volume_anomalies(spark, d):
        w = W.partitionBy("symbol").orderBy("open_time").rowsBetween(W.unboundedPreceding, -1)
        b = hourly_bars(spark, d).select("symbol", "open_time", "volume", F.try_divide("volume", F.avg("volume").over(w)).alias("ratio"), F.count("*").over(w).alias("n"))
        return b.where("n >= 19 and ratio >= 3").select("symbol", "open_time", "volume", "ratio", F.when(F.col("ratio") >= 6, "critical").otherwise("warning").alias("level"))

    @query("""SELECT * FROM (UNPIVOT (SELECT avg((text IS NULL)::INT::DOUBLE) AS text, avg((lang IS NULL)::INT::DOUBLE) AS lang, avg((source IS NULL)::INT::DOUBLE) AS source FROM documents) ON text, lang, source INTO NAME "column" VALUE null_ratio) u,
 LATERAL (SELECT CASE WHEN null_ratio > 0.8 THEN 'critical' WHEN null_ratio > 0.5 THEN 'warning' ELSE 'ok' END AS level)""", "null_ratio")  # fmt: skip
    def null_report(spark, d):
        return series.null_report(load(spark, d, "documents"), ["text", "lang", "source"])
