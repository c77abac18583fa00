
from __future__ import annotations

import numpy as np
import pandas as pd


def nz(x: pd.Series) -> pd.Series:
    return x.where(x != 0)


def wma(x: pd.Series, n: int) -> pd.Series:
    weights = np.arange(1, n + 1)
    return x.rolling(n).apply(lambda v: np.dot(v, weights) / weights.sum(), raw=True)


def slope(x: pd.Series, n: int) -> pd.Series:
    return x.rolling(n).apply(lambda v: np.polyfit(np.arange(n), v, 1)[0], raw=True)


def ends(x: pd.Series, n: int, at: int) -> pd.Series:
    """The fitted line's value ``at`` places from the window's first."""
    return x.rolling(n).apply(lambda v: np.polyval(np.polyfit(np.arange(n), v, 1), at), raw=True)


def rank(x: pd.Series, n: int = 20) -> pd.Series:
    return x.rolling(n).apply(lambda v: 100 * np.mean(v <= v[-1]), raw=True)


def lag1(x: pd.Series, n: int = 20) -> pd.Series:
    return x.rolling(n).apply(lambda v: np.corrcoef(v[1:], v[:-1])[0, 1], raw=True)


def side(up: pd.Series, down: pd.Series) -> pd.Series:
    return up.astype(float) - down.astype(float)


def all_columns(b: pd.DataFrame) -> dict[str, pd.Series]:
    o, h, lo, c, v = (b[x] for x in ("open", "high", "low", "close", "volume"))
    pc, ph, pl, pv = c.shift(1), h.shift(1), lo.shift(1), v.shift(1)
    rng, body, typical, mid = h - lo, c - o, (h + lo + c) / 3, (h + lo) / 2
    upper, lower = h - np.maximum(o, c), np.minimum(o, c) - lo
    r1, r5, r20 = (c.pct_change(k) for k in (1, 5, 20))
    lr, dv = np.log(c / pc), v.pct_change()
    tr = pd.Series(np.maximum.reduce([rng, (h - pc).abs(), (lo - pc).abs()]), c.index).where(pc.notna())
    delta = c.diff()
    gain, loss = delta.clip(lower=0), (-delta).clip(lower=0)
    sma = {n: c.rolling(n).mean() for n in (5, 10, 14, 20, 60, 120)}
    sd = c.rolling(20).std(ddof=0)
    vm, vs = v.rolling(20).mean(), nz(v.rolling(20).sum())
    hi, low = (lambda n: h.rolling(n).max()), (lambda n: lo.rolling(n).min())
    trs, roc = tr.rolling(14).sum(), (lambda k: 100 * c.pct_change(k))
    up_sd, down_sd = gain.rolling(14).std(ddof=0), loss.rolling(14).std(ddof=0)
    rs = np.log(h / c) * np.log(h / o) + np.log(lo / c) * np.log(lo / o)
    gk = 0.5 * np.log(h / lo) ** 2 - (2 * np.log(2) - 1) * np.log(c / o) ** 2
    share = ((c - lo) - (h - c)) / nz(rng)
    mfv = share * v
    adl, obv = mfv.cumsum(), (np.sign(delta).fillna(0) * v).cumsum()
    vol = r1.rolling(20).std(ddof=0)
    mean = r1.rolling(20).mean()
    down, upside = ((r1.clip(upper=0).fillna(0) ** 2).rolling(20).mean() ** 0.5), ((r1.clip(lower=0).fillna(0) ** 2).rolling(20).mean() ** 0.5)
    drawdown = c / c.rolling(20).max() - 1
    awesome = mid.rolling(5).mean() - mid.rolling(34).mean()
    money = typical * v
    step = typical.diff()
    mf_up, mf_down = money.where(step > 0, 0.0).rolling(14).sum(), money.where(step < 0, 0.0).rolling(14).sum()
    demax, demin = (h - ph).clip(lower=0).rolling(14).sum(), (pl - lo).clip(lower=0).rolling(14).sum()
    g14, l14 = gain.rolling(14).sum(), loss.rolling(14).sum()
    low_, high_ = np.minimum(lo, pc).where(pc.notna()), np.maximum(h, pc).where(pc.notna())
    bp = {n: (c - low_).rolling(n).sum() / (high_ - low_).rolling(n).sum() for n in (7, 14, 28)}
    smooth = lambda x: (x + 2 * x.shift(1) + 2 * x.shift(2) + x.shift(3)) / 6
    rvi = smooth(body).rolling(10).mean() / nz(smooth(rng).rolling(10).mean())
    kst = roc(10).rolling(10).mean() + 2 * roc(15).rolling(10).mean() + 3 * roc(20).rolling(10).mean() + 4 * roc(30).rolling(15).mean()
    coppock = wma(roc(11) + roc(14), 10)
    tenkan, kijun, b52 = (hi(9) + low(9)) / 2, (hi(26) + low(26)) / 2, (hi(52) + low(52)) / 2
    a26 = (tenkan + kijun) / 2
    cloud_low = pd.Series(np.minimum(a26, b52), c.index)
    vwap, vwma = money.rolling(20).sum() / vs, (c * v).rolling(20).sum() / vs
    dhi, dlo = hi(20), low(20)
    pivot = (ph + pl + pc) / 3
    q = lambda p: r1.rolling(20).quantile(p)
    fit = ends(c, 20, 19)
    gap, inner = np.log(o / pc), np.log(c / o)
    k = 0.34 / (1.34 + 21 / 19)
    m1, m2 = body.shift(1), body.shift(2)
    small = m1.abs() < 0.3 * nz(rng.shift(1))
    cross = side((sma[10] > sma[60]) & (sma[10].shift(1) <= sma[60].shift(1)), (sma[10] < sma[60]) & (sma[10].shift(1) >= sma[60].shift(1)))
    aroon_up, aroon_down = h.rolling(25).apply(lambda x: 4 * (x.argmax() + 1), raw=True), lo.rolling(25).apply(lambda x: 4 * (x.argmin() + 1), raw=True)
    straight, path = np.sqrt(c.diff(10) ** 2 + 100), np.sqrt(delta**2 + 1).rolling(10).sum()
    return {
        "sma_5": sma[5], "sma_10": sma[10], "sma_20": sma[20], "sma_60": sma[60], "sma_120": sma[120], "hma_21": wma(2 * wma(c, 10) - wma(c, 21), 4), "price_to_sma_20": c / sma[20] - 1, "price_to_sma_60": c / sma[60] - 1,
        "sma_20_slope_5": 100 * sma[20].pct_change(5), "vhf_28": (c.rolling(28).max() - c.rolling(28).min()) / nz(delta.abs().rolling(28).sum()), "linear_reg_slope_20": 100 * slope(c, 20) / sma[20],
        "linear_reg_r2_20": c.rolling(20).apply(lambda x: np.corrcoef(np.arange(20), x)[0, 1] ** 2, raw=True), "regression_distance_20": (c - fit) / fit,
        "ichimoku_tenkan_9": tenkan, "ichimoku_kijun_26": kijun, "ichimoku_senkou_a": a26, "ichimoku_senkou_b_52": b52, "ichimoku_cloud_width": (a26 - b52).abs() / c, "ichimoku_cloud_position": (c - cloud_low) / nz((a26 - b52).abs()),
        "price_to_kijun_26": c / kijun - 1, "aroon_up_25": aroon_up, "aroon_down_25": aroon_down, "aroon_osc_25": aroon_up - aroon_down, "vortex_plus_14": (h - pl).abs().rolling(14).sum() / trs, "vortex_minus_14": (lo - ph).abs().rolling(14).sum() / trs,
        "efficiency_ratio_10": c.diff(10).abs() / nz(delta.abs().rolling(10).sum()), "sma_cross_10_60": cross,
        "ichimoku_signal": side((c > a26) & (c > b52), (c < a26) & (c < b52)) + side(tenkan > kijun, tenkan < kijun),
        "roc_12": roc(12), "momentum_10": c.diff(10), "cfo_20": 100 * (c - ends(c, 20, 20)) / c, "awesome_oscillator_5_34": awesome, "accelerator_oscillator_5_34": awesome - awesome.rolling(5).mean(), "pfe_10": np.sign(c.diff(10)) * 100 * straight / path,
        "cci_20": (typical - typical.rolling(20).mean()) / (0.015 * typical.rolling(20).apply(lambda x: np.abs(x - x.mean()).mean(), raw=True)), "mfi_14": 100 - 100 / (1 + mf_up / nz(mf_down)), "williams_r_14": -100 * (hi(14) - c) / nz(hi(14) - low(14)),
        "ultimate_osc": 100 * (4 * bp[7] + 2 * bp[14] + bp[28]) / 7, "cmo_14": 100 * (g14 - l14) / nz(g14 + l14), "dpo_20": c.shift(11) - sma[20], "coppock_curve_11_14_10": coppock, "coppock_signal_10": coppock.rolling(10).mean(),
        "kst_line": kst, "kst_signal": kst.rolling(9).mean(), "qstick_10": body.rolling(10).mean(), "demarker_14": demax / nz(demax + demin), "rvi_10": rvi, "rvi_signal_4": smooth(rvi),
        "bb_middle": sma[20], "bb_upper": sma[20] + 2 * sd, "bb_lower": sma[20] - 2 * sd, "bb_width": 4 * sd / sma[20], "bb_percent_b": (c - sma[20] + 2 * sd) / nz(4 * sd), "true_range_pct": tr / pc, "normalized_range_14": (hi(14) - low(14)) / sma[14],
        "historical_volatility_20": lr.rolling(20).std(ddof=0) * np.sqrt(20), "relative_volatility_index_14": 100 * up_sd / nz(up_sd + down_sd), "choppiness_index_14": 100 * np.log10(trs / (hi(14) - low(14))) / np.log10(14),
        "parkinson_volatility_20": (np.log(h / lo) ** 2 / (4 * np.log(2))).rolling(20).mean() ** 0.5, "garman_klass_volatility_20": gk.rolling(20).mean().clip(lower=0) ** 0.5, "rogers_satchell_volatility_20": rs.rolling(20).mean().clip(lower=0) ** 0.5,
        "donchian_high_20": dhi, "donchian_low_20": dlo, "donchian_mid_20": (dhi + dlo) / 2, "donchian_width_20": (dhi - dlo) / ((dhi + dlo) / 2), "donchian_position_20": (c - dlo) / nz(dhi - dlo), "rolling_drawdown_20": drawdown,
        "ulcer_index_14": ((100 * (c / c.rolling(14).max() - 1)) ** 2).rolling(14).mean() ** 0.5,
        "obv": obv, "obv_slope_20": slope(obv, 20) / vm, "vwma_20": vwma, "price_to_vwma_20": c / vwma - 1, "rolling_vwap_20": vwap, "rolling_vwap_deviation_20": (c - vwap) / vwap, "cmf_20": mfv.rolling(20).sum() / vs, "adl": adl, "adl_slope_20": slope(adl, 20) / vm,
        "volume_ratio_20": v / vm, "volume_zscore_20": (v - vm) / nz(v.rolling(20).std(ddof=0)), "volume_price_correlation_20": r1.rolling(20).corr(dv), "price_volume_trend": (r1.fillna(0) * v).cumsum(),
        "ease_of_movement_14": (mid.diff() * rng / v).rolling(14).mean(), "volume_oscillator_5_20": 100 * (v.rolling(5).mean() - vm) / vm,
        "return_1": r1, "return_5": r5, "return_20": r20, "volatility_20": vol, "downside_deviation_20": down, "upside_deviation_20": upside, "sharpe_like_20": mean / nz(vol), "sortino_like_20": mean / nz(down), "calmar_like_20": r20 / nz(drawdown.rolling(20).min().abs()),
        "gain_to_pain_ratio_20": r1.rolling(20).apply(lambda x: x[x > 0].sum() / abs(x[x < 0].sum()), raw=True), "median_return_20": r1.rolling(20).median(), "mad_return_20": r1.rolling(20).apply(lambda x: np.median(np.abs(x - np.median(x))), raw=True),
        "return_iqr_20": q(0.75) - q(0.25), "tail_ratio_20": q(0.95) / q(0.05).abs(), "positive_return_ratio_20": r1.gt(0).rolling(20).mean(), "return_autocorr_20": lag1(r1), "volume_autocorr_20": lag1(dv),
        "return_skew_20": r1.rolling(20).skew(), "return_kurtosis_20": r1.rolling(20).kurt(), "price_zscore_20": (c - sma[20]) / nz(sd), "price_percent_rank_20": rank(c), "volume_percent_rank_20": rank(v), "range_percent_rank_20": rank(rng / c),
        "balance_of_power": body / nz(rng), "candle_body_pct": body / o, "upper_shadow_pct": upper / nz(rng), "lower_shadow_pct": lower / nz(rng), "body_to_range_ratio": body.abs() / nz(rng), "close_location_value": share, "intrabar_trend_efficiency": body / nz(tr),
        "pivot_classic": pivot, "pivot_r1": 2 * pivot - pl, "pivot_s1": 2 * pivot - ph, "pivot_r2": pivot + ph - pl, "pivot_s2": pivot - ph + pl, "distance_to_pivot_pct": c / pivot - 1,
        "pattern_doji": (body.abs() / nz(rng) < 0.1).astype(float), "pattern_hammer": ((lower > 2 * body.abs()) & (upper < body.abs()) & (rng > 0)).astype(float),
        "pattern_engulfing": side((body > 0) & (m1 < 0) & (body.abs() > m1.abs()), (body < 0) & (m1 > 0) & (body.abs() > m1.abs())),
        "pattern_morning_evening_star": side((m2 < 0) & small & (body > 0) & (c > c.shift(2)), (m2 > 0) & small & (body < 0) & (c < c.shift(2))),
        "pattern_three_soldiers_crows": side((body > 0) & (m1 > 0) & (m2 > 0) & (c > pc) & (pc > c.shift(2)), (body < 0) & (m1 < 0) & (m2 < 0) & (c < pc) & (pc < c.shift(2))),
        "pattern_pin_bar": side((lower > 2.5 * body.abs()) & (upper < body.abs()), (upper > 2.5 * body.abs()) & (lower < body.abs())), "pattern_inside_bar": ((h < ph) & (lo > pl)).astype(float), "pattern_outside_bar": ((h > ph) & (lo < pl)).astype(float),
        "nvi": 1000 * (1 + r1.where(v < pv, 0.0).fillna(0)).cumprod(), "pvi": 1000 * (1 + r1.where(v > pv, 0.0).fillna(0)).cumprod(),
        "realized_volatility_10": (lr**2).rolling(10).sum() ** 0.5, "yang_zhang_volatility_20": (gap.rolling(20).var() + k * inner.rolling(20).var() + (1 - k) * rs.rolling(20).mean()).clip(lower=0) ** 0.5,
        "intraday_intensity_20": ((2 * c - h - lo) / nz(rng) * v).rolling(20).sum() / vs, "relative_volume_5": v / v.rolling(5).mean(), "tick_intensity": r1.abs() / (v / vm), "amihud_illiquidity_20": (r1.abs() / (v * c)).rolling(20).mean(),
        "kyle_lambda_20": r1.rolling(20).corr(np.sign(delta) * v / vm), "return_dispersion_20": np.log(h / lo).rolling(20).std(ddof=0), "overnight_gap_pct": (o - pc) / pc,
    }
