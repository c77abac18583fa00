"""Screens of symbols with few bars, and one against a plain loop."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.operators import screens


@pytest.fixture(scope="module")
def scanned(spark):
    rng = np.random.default_rng(4)
    series = {"LONG": np.exp(np.cumsum(rng.normal(0, 0.02, 200))) * 100, "MID": np.exp(np.cumsum(rng.normal(0, 0.001, 30))) * 10, "FEW": np.array([5.0, 6.0, 5.5])}
    rows = [(s, datetime(2026, 1, 1) + timedelta(hours=i), float(v), float(i % 7 + 1)) for s, x in series.items() for i, v in enumerate(x)]
    w = W.partitionBy("symbol").orderBy("open_time")
    df = spark.createDataFrame(rows, "symbol string, open_time timestamp_ntz, close double, volume double").withColumns({
        "step": F.col("close") - F.lag("close").over(w), "r": F.ln(F.col("close") / F.lag("close").over(w)),
        "back": F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("open_time"))) - 1, "n": F.count("*").over(W.partitionBy("symbol")),
    })
    return series, screens.features(df, spark.createDataFrame([("LONG", 0.002)], "symbol string, funding_rate double"))


def test_features(scanned):
    series, f = scanned
    for r in f.collect():
        p = series[r.symbol][-168:]
        assert (r.n, r.price, r.high) == (len(p), p[-1], p.max()) and r.ma20 == pytest.approx(p[-20:].mean()) and r.support == p[-50:].min()
        steps = np.abs(np.diff(p))[-14:]
        assert r.atr14 == pytest.approx(steps.mean()) and r.hourly_vol == pytest.approx(np.diff(np.log(p)).std()) and r.annual_vol == pytest.approx(r.hourly_vol * 8760**0.5)


def test_few_bars(scanned):
    _, f = scanned
    got = {r.symbol: r for r in screens.multi_factor_scores(f).collect()}
    assert (got["FEW"].trend, got["FEW"].momentum, got["FEW"].flow, got["FEW"].sentiment) == (50.0, 50.0, 50.0, 50.0) and got["LONG"].sentiment == 60.0 and got["MID"].trend == 50.0
    assert {r.symbol for r in screens.entry_exit(f).collect()} == {r.symbol for r in screens.portfolio_signals(f).collect()} == {"LONG", "MID"}
    assert {r.symbol: r.regime for r in screens.strategy_by_regime(f).collect()}["FEW"] == "unknown"
    (carry,) = screens.funding_carry(f).collect()
    assert (carry.symbol, carry.direction, carry.risk) == ("LONG", "short_perp_long_spot", "medium") and carry.annualized_yield == pytest.approx(2.19)
