"""Enrichment of bars by several sources: stated cases, and a plain loop over venues."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions.timeframes import close_time, timeframe_seconds
from quantloom.operators import enrichment

NOON = datetime(2026, 5, 6, 12)
TICKER = "symbol string, exchange string, last_price double, mid_price double, spread_bps double, quote_volume_24h double, change_24h double, vwap_24h double, timestamp timestamp_ntz"
FUNDING = "symbol string, exchange string, funding_rate double, mark_price double, index_price double, timestamp timestamp_ntz"
BOOK = "symbol string, exchange string, mid_price double, spread_bps double, bid_depth_notional double, ask_depth_notional double, depth_imbalance double, timestamp timestamp_ntz"
A_TICKER = ("BTC/USDT", "binance", 100.1, 100.0, 2.0, 1e6, 0.01, 99.8)


def at(**kw):
    return NOON + timedelta(**kw)


@pytest.fixture
def enriched(spark):
    def run(minutes, tickers=(), funding=(), books=()):
        bars = spark.createDataFrame([("BTC/USDT", "1m", at(minutes=m), 100.0) for m in minutes], "symbol string, timeframe string, open_time timestamp_ntz, close double")
        made = [spark.createDataFrame(list(r), s) for r, s in ((tickers, TICKER), (funding, FUNDING), (books, BOOK))]
        return enrichment.enrich_bars(bars, *made).orderBy("open_time").collect()

    return run


def test_stale_tickers_and_books_are_not_carried_forward(enriched):
    first, second = enriched([0, 10], [(*A_TICKER, at(seconds=50))], books=[("BTC/USDT", "binance", 100.0, 1.5, 50_000.0, 48_000.0, 0.02, at(seconds=52))])
    assert (first.ticker_exchange_count, first.orderbook_exchange_count, first.ticker_last_price_mean, first.orderbook_total_depth_notional) == (1, 1, 100.1, 98_000.0)
    assert (second.ticker_exchange_count, second.orderbook_exchange_count, second.ticker_last_price_mean, second.orderbook_total_depth_notional) == (0, 0, None, None)
    assert [first.ticker_context_status, second.ticker_context_status, first.orderbook_context_status, second.orderbook_context_status] == ["ready", "stale_only"] * 2
    assert second.market_context_quality_flag == "thin"
    assert second.market_context_quality_flags == "ticker_context_stale_only|funding_context_missing|orderbook_context_stale_only"


def test_recent_funding_stays_and_stale_funding_goes(enriched):
    rows = enriched([0, 40, 60], funding=[("BTC/USDT", "binance", 0.0001, 100.2, 100.0, at(seconds=30))])
    assert [r.funding_exchange_count for r in rows] == [1, 1, 0]
    assert rows[0].funding_rate_mean == 0.0001 and rows[1].funding_basis_bps_mean == pytest.approx(20) and rows[2].funding_rate_mean is rows[2].funding_basis_bps_mean is None
    assert [r.funding_context_status for r in rows] == ["ready", "ready", "stale_only"]
    assert all(r.ticker_exchange_count is None and r.ticker_context_fresh_exchange_ratio is None for r in rows)


def test_partial_and_missing_sources_are_named(enriched):
    (r,) = enriched([0], [(*A_TICKER, at(seconds=50)), ("BTC/USDT", "okx", 100.2, 100.1, 2.5, 9e5, 0.015, 99.9, at(minutes=-1))])
    assert (r.ticker_context_status, r.ticker_context_known_exchange_count, r.ticker_context_raw_exchange_count, r.ticker_context_fresh_exchange_count) == ("partial", 2, 2, 1)
    assert (r.ticker_context_stale_exchange_count, r.ticker_context_missing_exchange_count, r.ticker_context_fresh_exchange_ratio) == (1, 0, 0.5)
    assert (r.funding_context_status, r.orderbook_context_status, r.market_context_quality_flag) == ("missing", "missing", "thin")
    assert r.market_context_quality_flags == "ticker_context_partial|funding_context_missing|orderbook_context_missing"
    assert (r.market_context_ready_source_count, r.market_context_partial_source_count, r.market_context_stale_only_source_count, r.market_context_missing_source_count) == (0, 1, 0, 2)


def test_one_venue_has_no_range_and_no_deviation(enriched):
    (r,) = enriched([0], [(*A_TICKER, at(seconds=50))])
    assert r.cross_exchange_last_price_range_bps == r.cross_exchange_last_price_std == 0.0


def test_ages_have_fractions(enriched):
    (r,) = enriched([0], [(*A_TICKER, at(seconds=44, microseconds=999_999))])
    assert r.ticker_context_status == "stale_only"
    (r,) = enriched([0], [(*A_TICKER, at(seconds=45))])
    assert r.ticker_context_status == "ready"


def test_against_a_loop_over_venues(spark):
    rng = np.random.default_rng(11)
    bars = pd.DataFrame([(s, "1h", NOON + timedelta(hours=int(h)), int(k)) for s in "ABC" for k, h in enumerate(rng.integers(0, 60, 40))], columns=["symbol", "timeframe", "open_time", "k"])
    snaps = pd.DataFrame({
        "symbol": rng.choice(list("AB"), 400), "exchange": rng.choice(["x", "y", "z", None], 400), "timestamp": [NOON + timedelta(seconds=int(s)) for s in rng.integers(0, 220_000, 400)],
        "price": np.where(rng.random(400) < 0.2, np.nan, rng.random(400)), "size": rng.random(400),
    }).drop_duplicates(["symbol", "exchange", "timestamp"])
    folds = {"n": ("count", "price"), "m": ("mean", "price"), "t": ("sum", "size"), "sd": ("std", "price"), "bps": ("range_bps", "price")}
    rows = [(r.symbol, None if pd.isna(r.exchange) else r.exchange, r.timestamp.to_pydatetime(), float(r.price), float(r.amount)) for r in snaps.rename(columns={"size": "amount"}).itertuples()]
    frame = spark.createDataFrame(rows, "symbol string, exchange string, timestamp timestamp_ntz, price double, size double")
    found = enrichment.enrich(spark.createDataFrame([(r.symbol, r.timeframe, r.open_time.to_pydatetime(), r.k) for r in bars.itertuples()], "symbol string, timeframe string, open_time timestamp_ntz, k int"), [enrichment.Source("s", frame, 7200, folds)], thin=())
    got = found.toPandas().sort_values(["symbol", "k"]).reset_index(drop=True)
    assert len(got) == len(bars)
    for r in got.itertuples():
        closed = r.open_time + pd.Timedelta(hours=1)
        own = snaps[(snaps.symbol == r.symbol) & snaps.exchange.notna()]
        known = own.exchange.nunique()
        seen = own[own.timestamp <= closed].sort_values("timestamp").groupby("exchange").last(skipna=False) if len(own) else own
        fresh = seen[(closed - seen.timestamp).dt.total_seconds() <= 7200] if len(own) else own
        price = fresh.price.dropna()
        assert (r.s_context_known_exchange_count, r.s_context_raw_exchange_count, r.s_context_fresh_exchange_count) == (known, len(seen), len(fresh))
        want = {"m": price.mean(), "t": fresh["size"].sum(min_count=1), "sd": price.std(ddof=0), "bps": (price.max() - price.min()) / price.mean() * 1e4}
        for name, value in want.items():
            assert getattr(r, name) == pytest.approx(value, nan_ok=True)
        assert (pd.isna(r.n) and not known) or r.n == len(price)
        assert r.s_context_status == ("missing" if not len(seen) else "stale_only" if not len(fresh) else "ready" if len(fresh) == known else "partial")


def test_timeframes(spark):
    df = spark.createDataFrame([("15m",), ("4h",), ("1d",), ("2w",), (None,)], "t string").withColumn("o", F.lit(NOON).cast("timestamp_ntz"))
    got = df.select(timeframe_seconds(F.col("t")).alias("s"), timeframe_seconds(F.col("t"), 3).alias("s3"), close_time(F.col("o"), F.col("t")).alias("c")).collect()
    assert [r.s for r in got] == [900, 14_400, 86_400, 1_209_600, None] and got[0].s3 == 2_700
    assert got[1].c == at(hours=4) and got[4].c is None
    for bad in ("h", "10", "5x", "1h "):
        with pytest.raises(Exception, match="not a timeframe"):
            spark.createDataFrame([(bad,)], "t string").select(timeframe_seconds(F.col("t"))).collect()
