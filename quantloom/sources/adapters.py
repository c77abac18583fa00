
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, venue, ts, event_id, price, amount, side) from events."""
    return load(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.concat(F.lit("v"), F.col("user_id") % 3).alias("venue"), "ts", "event_id", (F.col("value") + 1).alias("price"),
        (F.get_json_object("props", "$.k").cast("double") + 1).alias("amount"), F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"),
    )


TRADES_SQL = """SELECT event_type AS symbol, 'v' || (user_id % 3) AS venue, ts, event_id, value + 1 AS price,
 (props->>'$.k')::DOUBLE + 1 AS amount, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side FROM events"""


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, timeframe, open_time, open, high, low, close, volume) by hour."""
    from ..operators.bars import tumble

    return tumble(trades(spark, sf_dir), "hour")


BARS_SQL = f"""SELECT symbol, '1h' AS timeframe, date_trunc('hour', ts) AS open_time, arg_min(price, struct_pack(a := ts, b := event_id)) AS open, max(price) AS high, min(price) AS low,
 arg_max(price, struct_pack(a := ts, b := event_id)) AS close, sum(amount) AS volume FROM ({TRADES_SQL}) t GROUP BY symbol, date_trunc('hour', ts)"""


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, venue, ts, price, size, id) from lineitem: 50 symbols, six venues."""
    return load(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 50).alias("symbol"), F.concat("l_returnflag", "l_linestatus").alias("venue"), F.col("l_shipdate").alias("ts"),
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("size"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
    )


QUOTES_SQL = "SELECT l_partkey % 50 AS symbol, l_returnflag || l_linestatus AS venue, l_shipdate AS ts, l_extendedprice AS price, l_quantity AS size, l_orderkey * 8 + l_linenumber AS id FROM lineitem"
