"""Labels of notices, case by case."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions import notices


def test_regulation(spark):
    rows = [
        ("SEC charged a fund", None, "enforcement", "low", "US", ""), ("Spot ETF for Bitcoin", "delay in Japan", "etf_decision", "medium", "JP", "BTC"), ("A new law", "in China bans all", "legislation", "high", "CN", ""),
        ("Ripple and ETH", "a permit in the UK ", "license", "low", "UK", "ETH,XRP"), (None, None, "general", "low", "global", ""),
    ]
    df = spark.createDataFrame(rows, "title string, body string, a string, b string, c string, d string").withColumn("w", notices.whole(F.col("title"), F.col("body")))
    df = df.withColumns({"t": F.lower("w"), "u": F.upper("w")})
    got = df.select(*(F.expr(x).alias(n) for n, x in notices.regulation("t").items()), notices.affected_assets(F.col("u")).alias("assets"), "a", "b", "c", "d").collect()
    assert [(r.event_type, r.severity, r.jurisdiction, r.assets) for r in got] == [(r.a, r.b, r.c, r.d) for r in got]


def test_announcements(spark):
    rows = [("Exchange Will Delist ABC and XYZ", "listing", "high", ["ABC", "XYZ"]), ("Suspend THE WETH token", "delisting", "high", ["WETH"]), ("Wallet work for USDT_X", "maintenance", "medium", []), ("Ähnlich ÉTH x", "other", "low", [])]
    df = spark.createDataFrame(rows, "title string, c string, s string, k array<string>").withColumn("t", F.lower("title"))
    got = df.select(*(F.expr(x).alias(n) for n, x in notices.announcement("t").items()), notices.tokens(F.col("title")).alias("tokens"), "c", "s", "k").collect()
    assert [(r.category, r.severity, r.tokens) for r in got] == [(r.c, r.s, r.k) for r in got]
