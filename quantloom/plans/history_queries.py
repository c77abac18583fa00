"""Stitched histories on the given tables, with recursive SQL written apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stitching
from ..sources.adapters import QUOTES_SQL, quotes

_SEGMENTS = f"""d AS (SELECT symbol, ts AS day, max(price) AS price, date_diff('day', ts::DATE, (SELECT max(ts)::DATE FROM ({QUOTES_SQL}) z)) AS back FROM ({QUOTES_SQL}) q GROUP BY ALL),
 s AS (SELECT symbol, day, k AS segment, CASE WHEN symbol % 10 = 3 AND k = 4 THEN 0 ELSE price / (1 + k % 5) END AS value FROM (SELECT *, unnest([back // 75, back // 75 - 1]) AS k FROM d) WHERE k >= 0 AND back < 75 * k + 90)"""
_SCALES = f"""WITH RECURSIVE {_SEGMENTS}, n AS (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY segment) AS k FROM s),
 r AS (SELECT y.symbol, y.segment, y.k, count(x.value) AS overlap, coalesce(median(x.value / nullif(y.value, 0)) FILTER (x.value > 0 AND y.value > 0), CASE WHEN max(x.value) > 0 AND max(y.value) FILTER (x.value IS NOT NULL) > 0 THEN max(x.value) / max(y.value) FILTER (x.value IS NOT NULL) END) AS ratio
  FROM n y LEFT JOIN n x ON x.symbol = y.symbol AND x.k = y.k - 1 AND x.day = y.day GROUP BY ALL),
 c AS (SELECT symbol, segment, k, overlap, ratio, 1.0::DOUBLE AS scale FROM r WHERE k = 1 UNION ALL SELECT r.symbol, r.segment, r.k, r.overlap, r.ratio, CASE WHEN r.ratio IS NULL THEN 1 ELSE c.scale * r.ratio END FROM c JOIN r ON r.symbol = c.symbol AND r.k = c.k + 1)"""
_STITCHED = f"{_SCALES}, t AS (SELECT symbol, day, arg_min(value, segment) AS value, min(segment) AS segment FROM s GROUP BY ALL), h AS (SELECT symbol, day, value * scale AS value, segment, scale AS rescale_factor, overlap FROM t JOIN c USING (symbol, segment))"


def segments(spark, d):
    """Each symbol's highest price a day in segments of 90 days, back from the newest day, that share 15 days and have a scale each; some are all 0."""
    q = quotes(spark, d)
    newest = q.agg(F.max("ts").alias("newest"))
    days = q.groupBy("symbol", F.col("ts").alias("day")).agg(F.max("price").alias("price")).join(F.broadcast(newest)).withColumn("back", F.datediff("newest", "day"))
    k = F.floor(F.col("back") / 75)
    rows = days.withColumn("segment", F.explode(F.array(k, k - 1))).where((F.col("segment") >= 0) & (F.col("back") < 75 * F.col("segment") + 90))
    value = F.when((F.col("symbol") % 10 == 3) & (F.col("segment") == 4), 0.0).otherwise(F.col("price") / (1 + F.col("segment") % 5))
    return rows.select("symbol", "day", "segment", value.alias("value"))


def register(query) -> None:
    @query(f"{_SCALES} SELECT symbol, segment, ratio, overlap, scale FROM c", "ratio scale")
    def segment_scales(spark, d):
        return stitching.segment_scales(segments(spark, d), ["symbol"])

    @query(f"{_STITCHED} SELECT * FROM h", "value:5 rescale_factor")
    def stitched_history(spark, d):
        return stitching.stitch(segments(spark, d), ["symbol"])

    @query(f"""{_STITCHED} SELECT symbol, day, baseline_n, baseline_mean, (value - baseline_mean) / greatest(abs(baseline_mean), 1) AS shock FROM (SELECT *, count(value) OVER w AS baseline_n, avg(value) OVER w AS baseline_mean FROM h
 WINDOW w AS (PARTITION BY symbol ORDER BY day RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 SECOND PRECEDING)) WHERE baseline_n >= 2""", "baseline_mean:5 shock")
    def attention_shocks(spark, d):
        return stitching.attention_shocks(stitching.stitch(segments(spark, d), ["symbol"]), ["symbol"]).select("symbol", "day", "baseline_n", "baseline_mean", "shock")
