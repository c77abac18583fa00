"""Indicators against pandas and against plain loops."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from quantloom.operators import recursive
from quantloom.plans import indicators


def make_bars(n: int = 150, seed: int = 1, symbol: str = "a") -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    open_ = close * np.exp(rng.normal(0, 0.01, n))
    high, low = np.maximum(open_, close) * (1 + rng.random(n) * 0.01), np.minimum(open_, close) * (1 - rng.random(n) * 0.01)
    return pd.DataFrame({"symbol": symbol, "timeframe": "1h", "open_time": pd.date_range("2024-01-01", periods=n, freq="h"), "open": open_, "high": high, "low": low, "close": close, "volume": rng.integers(1, 100, n).astype(float)})


def window(spark, bars: pd.DataFrame, *columns: str) -> pd.DataFrame:
    df = spark.createDataFrame(bars).withColumn("open_time", __import__("pyspark.sql.functions", fromlist=["x"]).col("open_time").cast("timestamp_ntz"))
    return indicators.window_indicators(df).select("open_time", *columns).toPandas().sort_values("open_time").reset_index(drop=True)


def same(got, want):
    np.testing.assert_allclose(np.asarray(got, float), np.asarray(want, float), rtol=1e-8, atol=1e-9)


def test_against_pandas(spark):
    b = make_bars()
    c, v = b.close, b.volume
    r, dv = c.pct_change(), v.pct_change()
    names = "sma_20 bb_upper volatility_20 return_skew_20 return_kurtosis_20 return_iqr_20 tail_ratio_20 mad_return_20 return_autocorr_20 volume_price_correlation_20 linear_reg_r2_20 aroon_up_25 hma_21 obv nvi price_percent_rank_20 positive_return_ratio_20 cci_20 cfo_20 vwma_20".split()
    got = window(spark, b, *names)
    roll = c.rolling(20)
    typical = (b.high + b.low + c) / 3
    wma = lambda s, n: s.rolling(n).apply(lambda x: np.dot(x, np.arange(1, n + 1)) / (n * (n + 1) / 2), raw=True)
    nvi = 1000 * np.cumprod(np.where(v < v.shift(1), 1 + r.fillna(0), 1.0))
    fit = lambda y: np.polyval(np.polyfit(np.arange(20), y, 1), 20)
    want = {
        "sma_20": roll.mean(), "bb_upper": roll.mean() + 2 * roll.std(ddof=0), "volatility_20": r.rolling(20).std(ddof=0), "return_skew_20": r.rolling(20).skew(), "return_kurtosis_20": r.rolling(20).kurt(),
        "return_iqr_20": r.rolling(20).quantile(0.75) - r.rolling(20).quantile(0.25), "tail_ratio_20": r.rolling(20).quantile(0.95) / r.rolling(20).quantile(0.05).abs(),
        "mad_return_20": r.rolling(20).apply(lambda x: np.median(np.abs(x - np.median(x))), raw=True), "return_autocorr_20": r.rolling(20).apply(lambda x: np.corrcoef(x[1:], x[:-1])[0, 1], raw=True),
        "volume_price_correlation_20": r.rolling(20).corr(dv), "linear_reg_r2_20": roll.apply(lambda y: np.corrcoef(np.arange(20), y)[0, 1] ** 2, raw=True),
        "aroon_up_25": b.high.rolling(25).apply(lambda x: (x.argmax() + 1) / 25 * 100, raw=True), "hma_21": wma(2 * wma(c, 10) - wma(c, 21), 4), "obv": (np.sign(c.diff()).fillna(0) * v).cumsum(), "nvi": nvi,
        "price_percent_rank_20": roll.apply(lambda x: (x <= x[-1]).mean() * 100, raw=True), "positive_return_ratio_20": r.gt(0).rolling(20).mean(),
        "cci_20": (typical - typical.rolling(20).mean()) / (0.015 * typical.rolling(20).apply(lambda x: np.abs(x - x.mean()).mean(), raw=True)),
        "cfo_20": 100 * (c - roll.apply(fit, raw=True)) / c, "vwma_20": (c * v).rolling(20).sum() / v.rolling(20).sum(),
    }
    for name in names:
        same(got[name], want[name])


def test_every_window_column(spark):
    """All columns of all groups; only small differences of floating-point sums are let through."""
    import window_formulas

    names = [n for g in indicators.GROUPS for n in indicators.names(g)]
    for seed in (3, 4):
        b = make_bars(180, seed)
        want = window_formulas.all_columns(b)
        assert sorted(want) == sorted(names) and len(names) == 138
        got = window(spark, b, *names)
        wrong = {}
        for name in names:
            x, y = np.asarray(got[name], float), np.asarray(want[name], float)
            if not np.allclose(x, y, rtol=1e-7, atol=1e-8, equal_nan=True):
                at = np.flatnonzero(~np.isclose(x, y, rtol=1e-7, atol=1e-8, equal_nan=True))
                wrong[name] = (len(at), int(at[0]), x[at[0]], y[at[0]])
        assert not wrong, wrong


def test_constant_and_short_series(spark):
    flat = make_bars(30)
    for c in ("open", "high", "low", "close"):
        flat[c] = 5.0
    got = window(spark, flat, "price_zscore_20", "return_skew_20", "bb_percent_b", "volume_price_correlation_20", "sma_20", "cci_20")
    assert got[["price_zscore_20", "return_skew_20", "bb_percent_b", "volume_price_correlation_20", "cci_20"]].isna().all().all()
    assert got.sma_20.notna().sum() == 11
    assert window(spark, make_bars(3), "sma_20").sma_20.isna().all()
    for n in (1, 3, 60):
        out = recursive.recursive_indicators(make_bars(n))
        assert len(out) == n and list(out.columns[3:]) == recursive.COLUMNS


def plain_supertrend(h, l, c, a, k):
    """Bands as two lists, one bar after the other."""
    up, lo, side, line = [], [], None, []
    for i in range(len(c)):
        m = (h[i] + l[i]) / 2
        u, d = m + k * a[i], m - k * a[i]
        if i and not np.isnan(up[-1]):
            u = u if u < up[-1] or c[i - 1] > up[-1] else up[-1]
            d = d if d > lo[-1] or c[i - 1] < lo[-1] else lo[-1]
        if np.isnan(a[i]):
            line.append(np.nan)
        else:
            if side is None:
                side = 1 if c[i] >= m else -1
            elif c[i] > up[-1]:
                side = 1
            elif c[i] < lo[-1]:
                side = -1
            line.append(d if side > 0 else u)
        up.append(u)
        lo.append(d)
    return line


def test_state_machines():
    b = make_bars(300, 3)
    out = recursive.recursive_indicators(b)
    h, l, c = (b[x].to_numpy() for x in ("high", "low", "close"))
    before = np.append(np.nan, c[:-1])
    tr = pd.Series(np.maximum(np.maximum(h - l, np.abs(h - before)), np.abs(l - before)))
    atr = tr.ewm(alpha=0.1, adjust=False, min_periods=10).mean().to_numpy()
    same(out.supertrend_10_3, plain_supertrend(h, l, c, atr, 3.0))
    # Parabolic stop: below the lows while rising, above the highs while falling.
    rising = out.psar_trend > 0
    assert (out.psar[rising] <= l[rising] + 1e-9).all() or (out.psar[rising & rising.shift(1, fill_value=False)] <= l[rising & rising.shift(1, fill_value=False)] + 1e-9).all()
    k, prev = [np.nan] * 10, None
    for i in range(10, len(c)):
        if prev is None:
            prev = c[i]
        else:
            path = sum(abs(c[j] - c[j - 1]) for j in range(i - 9, i + 1))
            e = abs(c[i] - c[i - 10]) / path
            prev += (e * (2 / 3 - 2 / 31) + 2 / 31) ** 2 * (c[i] - prev)
        k.append(prev)
    same(out.kama_10_2_30, k)
    cm, trend, force = 0.0, 1.0, []
    s, w = h + l + c, h - l
    for i in range(len(c)):
        now = trend if i == 0 or s[i] == s[i - 1] else float(np.sign(s[i] - s[i - 1]))
        cm = w[0] if i == 0 else (cm + w[i] if now == trend else w[i - 1] + w[i])
        trend = now
        force.append(b.volume[i] * trend * abs(2 * w[i] / cm - 1) * 100)
    f = pd.Series(force)
    same(out.kvo_line, f.ewm(span=34, adjust=False).mean() - f.ewm(span=55, adjust=False).mean())
    for i in range(60, 300, 17):
        seg = c[i - 50 : i]
        r = [np.corrcoef(seg[p:], seg[:-p])[0, 1] for p in range(5, 25)]
        assert out.ehlers_dominant_cycle_period[i] == 5 + int(np.argmax(r))


def test_grouped_map_keeps_series_apart(spark):
    both = pd.concat([make_bars(80, 1, "a"), make_bars(70, 2, "b")])
    df = spark.createDataFrame(both).selectExpr("symbol", "timeframe", "cast(open_time as timestamp_ntz) open_time", "open", "high", "low", "close", "volume")
    got = recursive.recursive(df).toPandas()
    alone = recursive.recursive_indicators(make_bars(70, 2, "b"))
    same(got[got.symbol == "b"].sort_values("open_time").ema_20, alone.ema_20)
    assert len(got) == 150


@pytest.mark.parametrize("n", [0])
def test_empty(spark, n):
    df = spark.createDataFrame([], "symbol string, timeframe string, open_time timestamp_ntz, open double, high double, low double, close double, volume double")
    assert indicators.window_indicators(df).select("sma_20").count() == 0
    assert recursive.recursive(df).count() == 0
