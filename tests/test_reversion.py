"""Candidates of reversion over all bars against a plain loop."""

from __future__ import annotations

import datetime as dt

import numpy as np

from quantloom.operators import signals


def test_every_bar_is_judged(spark):
    rng = np.random.default_rng(3)
    closes = {"a": 100 + rng.normal(size=70).cumsum(), "b": 50 + rng.normal(size=12), "c": np.full(60, 7.0)}
    at = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)
    rows = [(s, at(i), float(c), float(c), float(c), float(c), 1.0) for s, v in closes.items() for i, c in enumerate(v)]
    bars = spark.createDataFrame(rows, "symbol string, open_time timestamp_ntz, open double, high double, low double, close double, volume double")
    want = {}
    for s, v in closes.items():
        for i in range(9, len(v)):
            near = v[i - 9 : i + 1]
            z = (v[i] - near.mean()) / near.std() if near.std() else 0.0
            if abs(z) >= 1.5:
                want[s, at(i)] = (len(v) - 1 - i, z, v[i], near.mean(), "oversold" if z < 0 else "overbought")
    got = {(r.symbol, r.open_time): (r.back, r.zscore, r.current_price, r.mean_price, r.direction) for r in signals.reversion_candidates(signals.panel(bars), 10, 1.5).collect()}
    assert got.keys() == want.keys() and len({k[0] for k in want}) == 2 and len(want) > 5
    for k, (back, z, price, mean, direction) in want.items():
        assert got[k][0] == back and got[k][4] == direction and np.allclose(got[k][1:4], (z, price, mean))
