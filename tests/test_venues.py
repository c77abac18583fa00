"""Alignment and comparison of venues: stated cases at the limits."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from quantloom.operators import venues

NOON = datetime(2026, 5, 6, 12)
SIDES = {"a": ("binance", 101.1, 101.0, 101.2, 50_000.0, 45_000.0), "b": ("okx", 99.9, 99.8, 100.0, 60_000.0, 58_000.0)}
LIMITS = venues.Limits(ticker_age=60, book_age=60, notional=1000.0, context=False)


def at(**kw):
    return NOON + timedelta(**kw)


@pytest.fixture
def compared(spark):
    """The one row of two venues; ``changes`` replaces values of a side."""

    def run(limits=LIMITS, **changes):
        rows = []
        for side, (venue, last, bid, ask, deep, shallow) in SIDES.items():
            row = {
                "symbol": "BTC/USDT", "venue": venue, "as_of": at(seconds=5), "ticker_ts": at(seconds=side == "b"), "book_ts": at(seconds=side == "b"), "funding_ts": None, "bid": bid, "ask": ask, "last": last,
                "bid_depth": deep, "ask_depth": shallow, "funding": None, "taker_fee": 0.001, "maker_fee": 0.0008, "context_ts": None, "adx": None, "macd_hist": None, "rsi": None, "mark": None,
            }
            rows.append(tuple((row | changes.get(side, {})).values()))
        kinds = [k for k in row]
        schema = ", ".join(f"{k} {'string' if k in ('symbol', 'venue') else 'timestamp_ntz' if k.endswith('_ts') or k == 'as_of' else 'double'}" for k in kinds)
        return venues.compare_venues(spark.createDataFrame(rows, schema), limits).collect()

    return run


def test_a_tradable_spread(compared):
    (r,) = compared()
    assert (r.a, r.b, r.best_buy, r.best_sell, r.label, r.actionable, r.opportunity) == ("binance", "okx", "okx", "binance", "tradable_spread", True, "sell_binance_buy_okx")
    assert r.net > 60 and r.flags == "ok" and (r.fee_source_a, r.fee_source_b) == ("taker_fee", "taker_fee") and r.compared_at == at(seconds=1)
    assert r.ticker_gap_ms == 1000 and r.bid_depth_ratio == pytest.approx(5 / 6) and r.total_depth_ratio == pytest.approx(95 / 118) and r.last_diff_abs == pytest.approx(1.2)


def test_a_missing_book_is_a_warning(compared):
    (r,) = compared(a={"book_ts": None, "bid_depth": None, "ask_depth": None})
    assert r.label == "data_quality_warning" and not r.actionable and "missing_orderbook_a" in r.flags.split("|")


def test_ages_and_gaps_have_fractions(compared):
    age = lambda **kw: compared(a={"ticker_ts": at(seconds=5) - timedelta(**kw)})[0].flags
    assert "stale_ticker_a" not in age(seconds=60) and "stale_ticker_a" in age(seconds=60, microseconds=500_000)
    assert "cross_exchange_ticker_gap" not in compared(a={"ticker_ts": at(seconds=-4)})[0].flags
    assert "cross_exchange_ticker_gap" in compared(a={"ticker_ts": at(seconds=-4, microseconds=-1)})[0].flags


def test_a_book_of_one_side(compared):
    (r,) = compared(b={"ask_depth": None})
    assert r.slip_ab == 100.0 and r.multiple == 50.0 and r.net_ab == pytest.approx(r.gross_ab - r.fee_bps - 100)
    (r,) = compared(a={"bid_depth": None}, b={"ask_depth": None})
    assert r.slip_ab is None and r.net_ab == pytest.approx(r.gross_ab - r.fee_bps) and r.label == "liquidity_warning"


def test_fees_fall_back(compared):
    (r,) = compared(a={"taker_fee": None}, b={"taker_fee": None, "maker_fee": None})
    assert (r.fee_source_a, r.fee_source_b) == ("maker_fee_fallback", "config_default") and r.fee_bps == pytest.approx(18)


def test_prices_fall_back(compared):
    (r,) = compared(a={"bid": None, "ask": None, "mark": 101.0}, b={"mark": 100.0})
    assert "missing_bid_ask_a" in r.flags and r.gross_ab is None and r.best_buy == "okx" and r.best_sell == "binance" and r.mid_diff_bps is None and r.mark_diff_bps == pytest.approx(1e4 / 100.5)
    assert compared(a={"venue": "okx"}) == []


def test_context_and_funding(compared):
    limits = venues.Limits(ticker_age=60, book_age=60, notional=1000.0, funding=True)
    trend = {"context_ts": at(hours=-1), "adx": 29.0, "macd_hist": 0.35, "rsi": 61.0}
    (r,) = compared(limits, a={**trend, "funding": 0.0006, "funding_ts": at()}, b={"funding": -0.0004, "funding_ts": at(seconds=2)})
    assert (r.market_regime, r.funding_regime, r.completeness, r.funding_gap_ms) == ("trend_up", "funding_direction_conflict", 100.0, 2000.0)
    (r,) = compared(limits, a={**trend, "funding": 0.0006, "funding_ts": at()})
    assert (r.funding_regime, r.completeness) == ("unknown", 66.6667) and r.flags == "missing_funding_b"


def test_alignment(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, f"symbol string, {schema}")
    tickers = frame([("S", "x", at(), 1, 10.0), ("S", "x", at(seconds=20), 2, 11.0), ("S", "y", at(), 3, 12.0), (None, "y", at(), 4, 1.0), ("S", "y", None, 5, 1.0)], "venue string, ts timestamp_ntz, id long, last double")
    books = frame([("S", "x", at(seconds=-3), 1, 1.0), ("S", "x", at(seconds=3), 2, 2.0), ("S", "x", at(seconds=26), 3, 3.0), ("S", "y", at(seconds=5), 4, 4.0)], "venue string, ts timestamp_ntz, id long, bid_depth double")
    funding = frame([("S", "x", at(seconds=-1800), 1, 0.1), ("S", "y", at(seconds=1801), 2, 0.2)], "venue string, ts timestamp_ntz, id long, funding double")
    fees = frame([("S", "x", at(days=-2), 1, 0.5), ("S", "x", at(days=-1), 2, 0.6)], "venue string, updated_at timestamp_ntz, id long, taker_fee double")
    context = frame([("S", at(hours=-6), 1, 40.0), ("S", at(seconds=1), 2, 60.0)], "ts timestamp_ntz, id long, rsi double")
    got = {r.id: r for r in venues.align(tickers, books, funding, fees, context).collect()}
    assert sorted(got) == [1, 2, 3]
    assert [(r.book_ts, r.bid_depth, r.book_gap_ms) for _, r in sorted(got.items())] == [(at(seconds=-3), 1.0, 3000.0), (None, None, None), (at(seconds=5), 4.0, 5000.0)]
    assert [(r.funding, r.taker_fee) for _, r in sorted(got.items())] == [(0.1, 0.6), (None, 0.6), (None, None)]
    assert [(r.rsi, r.context_ts) for _, r in sorted(got.items())] == [(40.0, at(hours=-6)), (60.0, at(seconds=1)), (40.0, at(hours=-6))]
