"""Streams over all events, read to their end into tables, with SQL over the events as they lie."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.adapters import TRADES_SQL
from ..streaming import jobs
from . import venue_queries

_CALLS = "SELECT event_type AS key, date_diff('hour', TIMESTAMP '2000-01-01', ts) AS call, 1 / (value + 0.5) AS value FROM events"
_SESSIONS = """SELECT user_id, count(*) AS sessions, max(n) AS longest, sum(n)::BIGINT AS events FROM (SELECT user_id, k, count(*) AS n FROM (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (
 SELECT user_id, ts, event_id, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTES)::INT, 0) AS fresh FROM events)) GROUP BY ALL) GROUP BY user_id"""


def events(spark, d):
    """The events as a stream; times are those of UTC."""
    ship(spark)
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    source = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")  # a pattern may match a file or a folder
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    return source.withColumn("ts", F.timestamp_micros(micros))


def _clock(ts):
    """A time with its zone left out, by the clock of UTC, whatever the session's zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), F.lit("1970-01-01").cast("timestamp_ntz"))


def _trades(spark, d):
    e = events(spark, d)
    return e.select(F.col("event_type").alias("symbol"), "ts", "event_id", (F.col("value") + 1).alias("price"), (F.get_json_object("props", "$.k").cast("double") + 1).alias("amount"))


def register(query) -> None:
    @query(f"""SELECT symbol, time_bucket(INTERVAL 5 MINUTE, ts)::TIMESTAMP AS open_time, arg_min(price, struct_pack(a := ts, b := event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, struct_pack(a := ts, b := event_id)) AS close,
 sum(amount) AS volume, count(*) AS trades FROM ({TRADES_SQL}) t GROUP BY ALL""", "open high low close volume")
    def stream_bars(spark, d):
        """Five-minute bars: each batch hands on the windows that it changed, and the newest version of a window counts."""
        bars = jobs.run_to_end(jobs.tumbling_bars(_trades(spark, d)), "update", ["symbol", "open_time"])
        return bars.withColumn("open_time", _clock("open_time"))

    @query(_SESSIONS)
    def stream_sessions(spark, d):
        """Sessions with half an hour's gap, which a later batch may lengthen or join."""
        s = jobs.run_to_end(jobs.sessions(events(spark, d).select("user_id", "ts")), "complete")
        return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("events").alias("longest"), F.sum("events").alias("events"))

    @query(venue_queries.SLIDING_SQL, "most")
    def stream_sliding(spark, d):
        """Hourly sums every five minutes."""
        s = jobs.run_to_end(jobs.sliding_sums(_trades(spark, d)).select("symbol", F.col("w.start").alias("start"), "volume", "trades"), "update", ["symbol", "start"])
        return s.groupBy("symbol").agg(F.count("*").alias("windows"), F.max("volume").alias("most"), F.sum("trades").alias("counted"))

    @query(f"""WITH RECURSIVE e AS ({_CALLS}), m AS (SELECT *, count(*) OVER w AS n, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS sd FROM e WINDOW w AS (PARTITION BY key ORDER BY call RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 c AS (SELECT key, call, count(*)::DOUBLE AS n, row_number() OVER (PARTITION BY key ORDER BY call) AS i FROM e GROUP BY key, call), r AS (SELECT key, call, i, n, NULL::DOUBLE AS before, n AS rate FROM c WHERE i = 1
  UNION ALL SELECT c.key, c.call, c.i, c.n, r.rate, 0.9 * r.rate + 0.1 * c.n FROM r JOIN c ON c.key = r.key AND c.i = r.i + 1)
 SELECT key, call, 'zscore' AS kind, CASE WHEN abs(value - mean) / sd >= 4.5 THEN 'critical' ELSE 'warning' END AS severity, value, abs(value - mean) / sd AS score FROM m WHERE n > 10 AND sd > 0 AND abs(value - mean) / sd >= 3
 UNION ALL SELECT key, call, 'volume_drop', 'critical', n, before FROM r WHERE n < 0.2 * before""", "value score")
    def stream_anomalies(spark, d):
        """Values far from all those of the hours before, and hours with far fewer values; moments are kept in the stream's state."""
        hour = F.floor(F.unix_seconds("ts") / 3600) - 262_968  # hours of 1970 to 1999
        values = events(spark, d).select(F.col("event_type").alias("key"), hour.cast("long").alias("call"), F.col("event_id").alias("at"), (1 / (F.col("value") + 0.5)).alias("value"))
        return jobs.run_to_end(jobs.anomalies(values), "append")

    @query(f"""WITH s AS {venue_queries.SNAPSHOTS} SELECT symbol, venue, name AS column, nulls, total, CASE WHEN nulls > 0.8 * total THEN 'critical' ELSE 'warning' END AS severity FROM (
 SELECT symbol, venue, count(*) AS total, unnest(['ask', 'bid_depth', 'ask_depth', 'funding', 'mark', 'taker_fee', 'maker_fee', 'rsi']) AS name,
  unnest([count(*) - count(ask), count(*) - count(bid_depth), count(*) - count(ask_depth), count(*) - count(funding), count(*) - count(mark), count(*) - count(taker_fee), count(*) - count(maker_fee), count(*) - count(rsi)]) AS nulls FROM s GROUP BY symbol, venue) WHERE nulls > 0.5 * total""")
    def null_spikes(spark, d):
        return jobs.null_spikes(venue_queries.snapshots(spark, d), ["symbol", "venue"], "ask bid_depth ask_depth funding mark taker_fee maker_fee rsi".split())
