"""Indicators that are recursions over a series: exponential averages and state machines.

One grouped map for all of them, so a series is shuffled and sorted once. Window indicators
are in plans/indicators.py and stay in the JVM.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

COLUMNS = """ema_7 ema_20 ema_50 ema_100 macd_line macd_signal macd_hist dema_20 tema_20 zlema_20 ppo_line ppo_signal ppo_hist macd_hist_zscore_20
price_to_ema_20 price_to_ema_50 ema_20_slope_5 rsi_14 rsi_28 rmi_14_5 stoch_rsi_k_14 stoch_rsi_d_14 stoch_k stoch_d stoch_j stochastic_momentum_index_14_3
stochastic_momentum_signal_14_3 atr_14 atr_pct_14 chaikin_volatility_10 keltner_middle_20 keltner_upper_20 keltner_lower_20 keltner_width_20 squeeze_on_20
squeeze_off_20 plus_di_14 minus_di_14 adx_14 adxr_14 dmi_oscillator_14 tsi_line tsi_signal trix_30 stc_10_23_50 chaikin_oscillator force_index_13 mass_index_25
bull_power_13 bear_power_13 pvo_line pvo_signal pvo_hist kvo_line kvo_signal atr_percent_rank_20 supertrend_10_3 supertrend_direction_10_3 psar psar_trend
kama_10_2_30 fisher_transform_9 fisher_trigger_9 ehlers_fisher_transform_13 ehlers_instantaneous_trendline ehlers_cyber_cycle ehlers_dominant_cycle_period
adaptive_rsi_14 fractal_dimension_20 hurst_exponent_20 entropy_20 volume_weighted_rsi_14 ema_cross_7_20 ema_cross_20_50 macd_cross_signal price_above_ema_count
ma_alignment_score trend_consistency_20""".split()
SCHEMA = "symbol string, timeframe string, open_time timestamp_ntz, " + ", ".join(f"{c} double" for c in COLUMNS)


def span(x: pd.Series, n: int, least: int = 0) -> pd.Series:
    return x.ewm(span=n, adjust=False, min_periods=least).mean()


def wilder(x: pd.Series, n: int) -> pd.Series:
    return x.ewm(alpha=1 / n, adjust=False, min_periods=n).mean()


def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return a / b.where(b != 0)


def strength(up: pd.Series, down: pd.Series, n: int) -> pd.Series:
    """100 - 100 / (1 + smoothed gains over smoothed losses)."""
    return 100 - 100 / (1 + ratio(wilder(up, n), wilder(down, n)))


def crossing(a: pd.Series, b: pd.Series) -> pd.Series:
    before = (a - b).shift(1)
    return ((a > b) & (before <= 0)).astype(float) - ((a < b) & (before >= 0)).astype(float)


def place_in_range(x: pd.Series, n: int) -> pd.Series:
    low, high = x.rolling(n).min(), x.rolling(n).max()
    return 100 * ratio(x - low, high - low)


def frames(x: np.ndarray, n: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, n) if len(x) >= n else np.zeros((0, n))


def behind(values: np.ndarray, length: int) -> np.ndarray:
    """values at the end of a series of that length, NaN before."""
    return np.concatenate([np.full(length - len(values), np.nan), values])


def super_trend(high: np.ndarray, low: np.ndarray, close: np.ndarray, atr: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """The band that follows the price, and on which side it is: each band moves only
    towards the price until a close beyond the other side's band turns the trend."""
    n = len(close)
    middle = (high + low) / 2
    line, side = np.full(n, np.nan), np.full(n, np.nan)
    known = np.flatnonzero(~np.isnan(atr))
    if not len(known):
        return line, side
    upper, lower = middle + factor * atr, middle - factor * atr
    for i in range(known[0] + 1, n):
        if upper[i] >= upper[i - 1] and close[i - 1] <= upper[i - 1]:
            upper[i] = upper[i - 1]
        if lower[i] <= lower[i - 1] and close[i - 1] >= lower[i - 1]:
            lower[i] = lower[i - 1]
    now = 1.0 if close[known[0]] >= middle[known[0]] else -1.0
    for i in range(known[0], n):
        if i > known[0]:
            if close[i] > upper[i - 1]:
                now = 1.0
            elif close[i] < lower[i - 1]:
                now = -1.0
            elif now > 0:
                lower[i] = max(lower[i], lower[i - 1])
            else:
                upper[i] = min(upper[i], upper[i - 1])
        side[i], line[i] = now, lower[i] if now > 0 else upper[i]
    return line, side


def parabolic(high: np.ndarray, low: np.ndarray, close: np.ndarray, step: float = 0.02, most: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """Stop and reverse: the stop nears the extreme by a share that grows with each new extreme.
    A falling trend is a rising one of the negated prices."""
    n = len(close)
    stop, trend = np.full(n, np.nan), np.full(n, np.nan)
    if not n:
        return stop, trend
    way = -1.0 if n > 1 and close[1] < close[0] else 1.0
    near, far = (low, high) if way > 0 else (-high, -low)  # the sides of the bars, seen along the trend
    value, extreme, share = near[0], far[0], step
    stop[0], trend[0] = way * value, way
    for i in range(1, n):
        value = min(value + share * (extreme - value), near[max(0, i - 2) : i].min())
        if near[i] < value:
            way, near, far = -way, -far, -near
            value, extreme, share = -extreme, far[i], step
        elif far[i] > extreme:
            extreme, share = far[i], min(share + step, most)
        stop[i], trend[i] = way * value, way
    return stop, trend


def adaptive_average(close: np.ndarray, n: int = 10, fast: int = 2, slow: int = 30) -> np.ndarray:
    out = np.full(len(close), np.nan)
    if len(close) <= n:
        return out
    path = pd.Series(np.abs(np.diff(close, prepend=close[0]))).rolling(n).sum().to_numpy()
    move = np.abs(close[n:] - close[:-n])
    share = np.divide(move, path[n:], out=np.zeros_like(move), where=path[n:] != 0)
    quick, lazy = 2 / (fast + 1), 2 / (slow + 1)
    weight = (share * (quick - lazy) + lazy) ** 2
    out[n] = now = close[n]
    for i in range(n + 1, len(close)):
        now += weight[i - n] * (close[i] - now)
        out[i] = now
    return out


def fisher(price: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(price), np.nan)
    smooth = last = 0.0
    for i, w in enumerate(frames(price, n), n - 1):
        low, high = w.min(), w.max()
        if high == low:
            smooth = last = 0.0
            continue
        smooth = float(np.clip(0.33 * (2 * (price[i] - low) / (high - low) - 1) + 0.67 * smooth, -0.999, 0.999))
        last = out[i] = 0.5 * np.log((1 + smooth) / (1 - smooth)) + 0.5 * last
    return out


def smoother(close: np.ndarray, period: int = 10) -> np.ndarray:
    """Two-pole low-pass filter."""
    if len(close) < 7:
        return np.full(len(close), np.nan)
    decay = np.exp(-np.sqrt(2) * np.pi / period)
    c2, c3 = 2 * decay * np.cos(np.sqrt(2) * np.pi / period), -decay * decay
    out = close.copy()
    for i in range(2, len(close)):
        out[i] = (1 - c2 - c3) * (close[i] + close[i - 1]) / 2 + c2 * out[i - 1] + c3 * out[i - 2]
    return out


def cyber_cycle(close: np.ndarray, alpha: float = 0.07) -> np.ndarray:
    out = np.zeros(len(close))
    if len(close) < 7:
        return out
    smooth = np.zeros(len(close))
    smooth[2:] = (close[2:] + 2 * close[1:-1] + close[:-2]) / 4
    for i in range(6, len(close)):
        out[i] = (1 - alpha / 2) ** 2 * (smooth[i] - 2 * smooth[i - 1] + smooth[i - 2]) + 2 * (1 - alpha) * out[i - 1] - (1 - alpha) ** 2 * out[i - 2]
    return out


def dominant_cycle(close: np.ndarray, window: int = 50, first: int = 5, last: int = 24) -> np.ndarray:
    """The lag whose autocorrelation over the bars before this one is largest; the smallest of equals."""
    w = frames(close, window)[:-1]
    best, period = np.full(len(w), -1.0), np.full(len(w), 10.0)
    for lag in range(first, last + 1):
        a, b = w[:, lag:], w[:, :-lag]
        a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
        with np.errstate(all="ignore"):
            r = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
        better = r > best
        best[better], period[better] = r[better], lag
    period[w.std(1) == 0] = np.nan
    return behind(period, len(close)) if len(close) > window else np.full(len(close), np.nan)


def fractal_dimension(w: np.ndarray) -> np.ndarray:
    fine = np.abs(np.diff(w, axis=1)).sum(1)
    coarse = np.abs(w[:, 2::2] - w[:, :-2:2]).sum(1)
    with np.errstate(all="ignore"):
        out = 1 + np.log2(fine / coarse)
    out[(fine == 0) | (coarse == 0)] = 1.5
    out[w.max(1) == w.min(1)] = 1.0
    return out


def hurst(w: np.ndarray) -> np.ndarray:
    """Rescaled range of the returns inside a frame."""
    with np.errstate(all="ignore"):
        returns = np.diff(w, axis=1) / w[:, :-1]
        sums = np.cumsum(returns - returns.mean(1, keepdims=True), axis=1)
        spread, deviation = sums.max(1) - sums.min(1), returns.std(1, ddof=1)
        out = np.log(spread / deviation) / np.log(returns.shape[1])
    out[(spread == 0) | (deviation == 0)] = 0.5
    return out


def entropy(w: np.ndarray, bins: int = 5) -> np.ndarray:
    """Bits of the histogram of each frame, in equal bins from its minimum to its maximum; none where a value is missing."""
    out = np.full(len(w), np.nan)
    for i, x in enumerate(w):
        if not np.isnan(x).any():
            p = np.histogram(x, bins)[0] / len(x)
            out[i] = -(p[p > 0] * np.log2(p[p > 0])).sum()
    return out


def volume_force(high: pd.Series, low: pd.Series, close: pd.Series, volume: pd.Series) -> pd.Series:
    """Signed volume, weighted by the bar's share of the range summed since the trend turned."""
    turn = np.sign((high + low + close).diff()).replace(0, np.nan)
    trend = turn.where(turn.notna(), np.nan).ffill().fillna(1.0)
    width = high - low
    new = trend.ne(trend.shift(1)).cumsum()
    summed = width.groupby(new).cumsum() + width.shift(1).groupby(new).transform("first").where(new > 1, 0.0)
    return volume * trend * (2 * ratio(width, summed) - 1).abs() * 100


def recursive_indicators(bars: pd.DataFrame) -> pd.DataFrame:
    """COLUMNS for the bars of one series."""
    f = bars.sort_values("open_time", kind="stable").reset_index(drop=True)
    o, h, l, c, v = (f[x].astype(float) for x in ("open", "high", "low", "close", "volume"))
    out: dict[str, pd.Series | np.ndarray] = {}
    ema = {n: span(c, n) for n in (7, 12, 13, 20, 26, 50, 100)}
    for n in (7, 20, 50, 100):
        out[f"ema_{n}"] = ema[n]
    twice = span(ema[20], 20)
    out["dema_20"], out["tema_20"] = 2 * ema[20] - twice, 3 * ema[20] - 3 * twice + span(twice, 20)
    out["zlema_20"] = span(2 * c - c.shift(9), 20)
    for name, line in (("macd", ema[12] - ema[26]), ("ppo", 100 * ratio(ema[12] - ema[26], ema[26])), ("pvo", 100 * ratio(span(v, 12) - span(v, 26), span(v, 26)))):
        signal = span(line, 9)
        out[f"{name}_line"], out[f"{name}_signal"], out[f"{name}_hist"] = line, signal, line - signal
    hist = out["macd_hist"]
    out["macd_hist_zscore_20"] = ratio(hist - hist.rolling(20).mean(), hist.rolling(20).std(ddof=0))
    out["price_to_ema_20"], out["price_to_ema_50"] = ratio(c, ema[20]) - 1, ratio(c, ema[50]) - 1
    out["ema_20_slope_5"] = 100 * (ratio(ema[20], ema[20].shift(5)) - 1)
    delta, move = c.diff(), c.diff(5)
    gain, loss = delta.clip(lower=0), -delta.clip(upper=0)
    out["rsi_14"], out["rsi_28"], out["rmi_14_5"] = strength(gain, loss, 14), strength(gain, loss, 28), strength(move.clip(lower=0), -move.clip(upper=0), 14)
    out["stoch_rsi_k_14"] = place_in_range(out["rsi_14"], 14).rolling(3).mean()
    out["stoch_rsi_d_14"] = out["stoch_rsi_k_14"].rolling(3).mean()
    low9, high9 = l.rolling(9).min(), h.rolling(9).max()
    third = lambda x: x.ewm(alpha=1 / 3, adjust=False).mean()
    out["stoch_k"] = third(100 * ratio(c - low9, high9 - low9))
    out["stoch_d"] = third(out["stoch_k"])
    out["stoch_j"] = 3 * out["stoch_k"] - 2 * out["stoch_d"]
    low14, high14 = l.rolling(14).min(), h.rolling(14).max()
    out["stochastic_momentum_index_14_3"] = 100 * ratio(span(span(c - (high14 + low14) / 2, 3), 3), 0.5 * span(span(high14 - low14, 3), 3))
    out["stochastic_momentum_signal_14_3"] = span(out["stochastic_momentum_index_14_3"], 3)
    width, before = h - l, c.shift(1)
    reach = pd.Series(np.maximum(np.maximum(width, (h - before).abs()), (l - before).abs())).where(before.notna())
    atr = wilder(reach, 14)
    out["atr_14"], out["atr_pct_14"] = atr, ratio(atr, c)
    wide = span(width, 10, 10)
    out["chaikin_volatility_10"] = 100 * (ratio(wide, wide.shift(10)) - 1)
    upper, lower = ema[20] + 2 * atr, ema[20] - 2 * atr
    out["keltner_middle_20"], out["keltner_upper_20"], out["keltner_lower_20"], out["keltner_width_20"] = ema[20], upper, lower, ratio(upper - lower, ema[20])
    middle, deviation = c.rolling(20).mean(), 2 * c.rolling(20).std(ddof=0)
    known = middle.notna() & upper.notna()
    out["squeeze_on_20"] = ((middle - deviation > lower) & (middle + deviation < upper)).astype(float).where(known)
    out["squeeze_off_20"] = ((middle - deviation < lower) & (middle + deviation > upper)).astype(float).where(known)
    up, down = h.diff(), -l.diff()
    plus, minus = (100 * ratio(wilder(x.where((x > y) & (x > 0), 0.0), 14), atr) for x, y in ((up, down), (down, up)))
    adx = wilder(100 * ratio((plus - minus).abs(), plus + minus), 14)
    out["plus_di_14"], out["minus_di_14"], out["dmi_oscillator_14"], out["adx_14"], out["adxr_14"] = plus, minus, plus - minus, adx, (adx + adx.shift(14)) / 2
    out["tsi_line"] = 100 * ratio(span(span(delta, 25), 13), span(span(delta.abs(), 25), 13))
    out["tsi_signal"] = span(out["tsi_line"], 7)
    thrice = span(span(span(c, 30), 30), 30)
    out["trix_30"] = 100 * (ratio(thrice, thrice.shift(1)) - 1)
    cycle = span(place_in_range(span(c, 23) - span(c, 50), 10), 3)
    out["stc_10_23_50"] = span(place_in_range(cycle, 10), 3)
    adl = (ratio((c - l) - (h - c), width) * v).cumsum()
    out["chaikin_oscillator"] = span(adl, 3) - span(adl, 10)
    out["force_index_13"] = span(delta * v, 13)
    once = span(width, 9, 9)
    out["mass_index_25"] = ratio(once, span(once, 9, 9)).rolling(25).sum()
    out["bull_power_13"], out["bear_power_13"] = h - ema[13], l - ema[13]
    force = volume_force(h, l, c, v)
    out["kvo_line"] = span(force, 34) - span(force, 55)
    out["kvo_signal"] = span(out["kvo_line"], 13)
    ranked = frames(atr.to_numpy(), 20)
    share = 100.0 * (ranked <= ranked[:, -1:]).sum(1) / 20
    out["atr_percent_rank_20"] = behind(np.where(np.isnan(ranked).any(1), np.nan, share), len(f))
    out["supertrend_10_3"], out["supertrend_direction_10_3"] = super_trend(*(x.to_numpy() for x in (h, l, c, wilder(reach, 10))), 3.0)
    out["psar"], out["psar_trend"] = parabolic(h.to_numpy(), l.to_numpy(), c.to_numpy())
    close, half = c.to_numpy(), ((h + l) / 2).to_numpy()
    out["kama_10_2_30"] = adaptive_average(close)
    out["fisher_transform_9"] = fisher(half, 9)
    out["fisher_trigger_9"] = pd.Series(out["fisher_transform_9"]).shift(1)
    out["ehlers_fisher_transform_13"] = fisher(half, 13)
    out["ehlers_instantaneous_trendline"], out["ehlers_cyber_cycle"], out["ehlers_dominant_cycle_period"] = smoother(close), cyber_cycle(close), dominant_cycle(close)
    efficiency = ratio(c.diff(10).abs(), delta.abs().rolling(10).sum())
    out["adaptive_rsi_14"] = out["rsi_14"] * efficiency + 50 * (1 - efficiency)
    w = frames(close, 20)
    out["fractal_dimension_20"], out["hurst_exponent_20"] = behind(fractal_dimension(w), len(f)), behind(hurst(w), len(f))
    out["entropy_20"] = behind(entropy(frames(c.pct_change(fill_method=None).to_numpy(), 20)), len(f))
    weight = ratio(v, v.rolling(14).mean())
    out["volume_weighted_rsi_14"] = strength(gain * weight, loss * weight, 14)
    out["ema_cross_7_20"], out["ema_cross_20_50"], out["macd_cross_signal"] = crossing(ema[7], ema[20]), crossing(ema[20], ema[50]), crossing(out["macd_line"], out["macd_signal"])
    out["price_above_ema_count"] = sum((c > ema[n]).astype(float) for n in (7, 20, 50, 100))
    out["ma_alignment_score"] = (np.sign(ema[7] - ema[20]) + np.sign(ema[20] - ema[50]) + np.sign(ema[50] - ema[100])) / 3
    out["trend_consistency_20"] = (c > ema[20]).astype(float).rolling(20).mean()
    return pd.concat([f[["symbol", "timeframe", "open_time"]], pd.DataFrame({k: out[k] for k in COLUMNS})], axis=1)


def recursive(bars: DataFrame) -> DataFrame:
    """COLUMNS of every bar. A series must fit in one task: a year of one-minute bars is 40 MB."""
    return bars.select("symbol", "timeframe", "open_time", "open", "high", "low", "close", "volume").groupBy("symbol", "timeframe").applyInPandas(recursive_indicators, SCHEMA)
