"""Technical indicators that are windows over bars, in layers of formulas.

Every layer is one projection over the one before; all frames share the bars' partition and
order, so the plan has one exchange and one sort for all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.dialect import SPARK, Dialect, cumulative, div, full, keep_null, lag, over, roll, rolling_corr

BAR = ("symbol", "timeframe", "open_time", "open", "high", "low", "close", "volume")
KEY = ("symbol", "timeframe", "open_time")


def _sign(x: str) -> str:
    return f"CASE WHEN ({x}) > 0 THEN 1.0 WHEN ({x}) < 0 THEN -1.0 WHEN ({x}) = 0 THEN 0.0 END"


def _flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1.0 ELSE 0.0 END"


def _two_way(up: str, down: str) -> str:
    return f"CASE WHEN {up} THEN 1.0 WHEN {down} THEN -1.0 ELSE 0.0 END"


def _weighted(x: str, n: int) -> str:
    """Linear weights, the newest the heaviest."""
    terms = " + ".join(f"{n - k} * ({lag(x, k) if k else x})" for k in range(n))
    return f"(({terms}) / {n * (n + 1) / 2})"


def _regression(fn: str, y: str, n: int) -> str:
    return full(y, n, f"{fn}({y}, bar_no) {over(n)}")


def layers(d: Dialect = SPARK) -> list[dict[str, str]]:
    order = "OVER (PARTITION BY symbol, timeframe ORDER BY open_time)"
    first = {
        "bar_no": f"cast(row_number() {order} as double)",
        "prev_close": lag("close"), "prev_high": lag("high"), "prev_low": lag("low"), "prev_volume": lag("volume"),
        "typical": "(high + low + close) / 3", "middle": "(high + low) / 2", "width": "high - low", "body": "close - open",
        "upper_shadow": "high - greatest(open, close)", "lower_shadow": "least(open, close) - low",
        **{f"close_{k}": lag("close", k) for k in (2, 5, 9, 10, 11, 12, 14, 15, 20, 30)},
    }
    second = {
        "delta": "close - prev_close", "body_abs": "abs(body)", "prev_body": lag("body"), "body_2": lag("body", 2), "prev_width": lag("width"),
        "true_range": keep_null("prev_close", "greatest(width, abs(high - prev_close), abs(low - prev_close))"),
        "return_1": div("close", "prev_close") + " - 1", "return_5": div("close", "close_5") + " - 1", "return_20": div("close", "close_20") + " - 1",
        **{f"roc_raw_{k}": "100 * (" + div("close", f"close_{k}") + " - 1)" for k in (10, 11, 12, 14, 15, 20, 30)},
        "log_return": f"ln({div('close', 'prev_close')})", "log_hl": f"ln({div('high', 'low')})", "log_co": f"ln({div('close', 'open')})",
        "log_oc": f"ln({div('open', 'prev_close')})",
        "rs_part": f"ln({div('high', 'close')}) * ln({div('high', 'open')}) + ln({div('low', 'close')}) * ln({div('low', 'open')})",
        "volume_change": div("volume", "prev_volume") + " - 1",
        "flow_share": div("(close - low) - (high - close)", "width"), "money": "typical * volume", "typical_change": f"typical - {lag('typical')}",
        "middle_move": f"middle - {lag('middle')}", "move_10": "close - close_10",
        "max_close_20": roll("max", "close", 20), "max_close_14": roll("max", "close", 14),
    }
    third = {
        "gain": keep_null("delta", "greatest(delta, 0.0)"), "loss": keep_null("delta", "greatest(-delta, 0.0)"), "prev_body_abs": lag("body_abs"),
        "abs_delta": "abs(delta)", "flow_volume": "flow_share * volume", "signed_volume": f"coalesce({_sign('delta')}, 0.0) * volume",
        "sign_volume": f"({_sign('delta')}) * volume",
        "downside": "CASE WHEN return_1 < 0 THEN return_1 * return_1 ELSE 0.0 END", "upside": "CASE WHEN return_1 > 0 THEN return_1 * return_1 ELSE 0.0 END",
        "flow_up": "CASE WHEN typical_change > 0 THEN money ELSE 0.0 END", "flow_down": "CASE WHEN typical_change < 0 THEN abs(money) ELSE 0.0 END",
        "demand": keep_null("prev_high", "greatest(high - prev_high, 0.0)"), "supply": keep_null("prev_low", "greatest(prev_low - low, 0.0)"),
        "true_low": keep_null("prev_close", "least(low, prev_close)"), "true_high": keep_null("prev_close", "greatest(high, prev_close)"),
        "ease": div("middle_move * width", "volume"), "gk_part": "0.5 * log_hl * log_hl - (2 * ln(2) - 1) * log_co * log_co",
        "path": "sqrt(delta * delta + 1)", "width_pct": div("width", "close"), "drawdown": div("close", "max_close_20") + " - 1",
        "drawdown_14": "100 * (" + div("close", "max_close_14") + " - 1)", "illiquid": div("abs(return_1)", "volume * close"),
        "rvi_top": f"(body + 2 * prev_body + 2 * body_2 + {lag('body', 3)}) / 6", "rvi_bottom": f"(width + 2 * prev_width + 2 * {lag('width', 2)} + {lag('width', 3)}) / 6",
        "lag_return": lag("return_1"), "lag_volume_change": lag("volume_change"), "roc_pair": "roc_raw_11 + roc_raw_14",
        "wma_10": _weighted("close", 10), "wma_21": _weighted("close", 21),
        "intensity": div("2 * close - high - low", "high - low") + " * volume",
        "pvt_step": "coalesce(return_1, 0.0) * volume",
        "nvi_step": "CASE WHEN volume < prev_volume THEN ln(1 + coalesce(return_1, 0.0)) ELSE 0.0 END", "pvi_step": "CASE WHEN volume > prev_volume THEN ln(1 + coalesce(return_1, 0.0)) ELSE 0.0 END",
    }
    rolled = {
        **{f"sma_{n}": roll("avg", "close", n) for n in (5, 10, 14, 20, 60, 120)}, "std_20": roll("stddev_pop", "close", 20),
        **{f"high_{n}": roll("max", "high", n) for n in (9, 14, 20, 25, 26, 52)}, **{f"low_{n}": roll("min", "low", n) for n in (9, 14, 20, 25, 26, 52)},
        "max_close_28": roll("max", "close", 28), "min_close_28": roll("min", "close", 28), "path_28": roll("sum", "abs_delta", 28), "path_10": roll("sum", "abs_delta", 10),
        **{f"volume_{n}": roll("avg", "volume", n) for n in (5, 14, 20)}, "volume_sum_20": roll("sum", "volume", 20), "volume_std_20": roll("stddev_pop", "volume", 20),
        "volatility_20": roll("stddev_pop", "return_1", 20), "mean_return_20": roll("avg", "return_1", 20), "log_std_20": roll("stddev_pop", "log_return", 20),
        "tr_sum_14": roll("sum", "true_range", 14), "up_std_14": roll("stddev_pop", "gain", 14), "down_std_14": roll("stddev_pop", "loss", 14),
        "vp_sum": roll("sum", f"abs(high - {'prev_low'})", 14), "vm_sum": roll("sum", "abs(low - prev_high)", 14),
        "typical_20": roll("avg", "typical", 20), "flow_up_14": roll("sum", "flow_up", 14), "flow_down_14": roll("sum", "flow_down", 14),
        "demand_14": roll("sum", "demand", 14), "supply_14": roll("sum", "supply", 14), "gain_14": roll("sum", "gain", 14), "loss_14": roll("sum", "loss", 14),
        "price_volume_20": roll("sum", "close * volume", 20), "money_20": roll("sum", "money", 20), "flow_20": roll("sum", "flow_volume", 20), "intensity_sum": roll("sum", "intensity", 20),
        "obv": cumulative("signed_volume"), "adl": cumulative("flow_volume"), "price_volume_trend": cumulative("pvt_step"),
        "nvi": f"1000 * exp({cumulative('nvi_step')})", "pvi": f"1000 * exp({cumulative('pvi_step')})",
        "awesome": f"({roll('avg', 'middle', 5)}) - ({roll('avg', 'middle', 34)})", "path_sum_10": roll("sum", "path", 10),
        "downside_20": roll("avg", "downside", 20), "upside_20": roll("avg", "upside", 20),
        **{f"bp_{n}": roll("sum", "close - true_low", n) for n in (7, 14, 28)}, **{f"ut_{n}": roll("sum", "true_high - true_low", n) for n in (7, 14, 28)},
        "rvi_top_10": roll("avg", "rvi_top", 10), "rvi_bottom_10": roll("avg", "rvi_bottom", 10), "worst_20": roll("min", "drawdown", 20),
        "kst_10": roll("avg", "roc_raw_10", 10), "kst_15": roll("avg", "roc_raw_15", 10), "kst_20": roll("avg", "roc_raw_20", 10), "kst_30": roll("avg", "roc_raw_30", 15),
        "slope_20": _regression("regr_slope", "close", 20), "intercept_20": _regression("regr_intercept", "close", 20), "coppock_curve_11_14_10": _weighted("roc_pair", 10),
        "hull_input": "2 * wma_10 - wma_21", "rs_mean_20": roll("avg", "rs_part", 20), "oc_var": roll("var_samp", "log_oc", 20), "co_var": roll("var_samp", "log_co", 20),
        "illiquid_20": roll("avg", "illiquid", 20), "median_20": d.quantile("return_1", 0.5, 20), "p05": d.quantile("return_1", 0.05, 20), "p95": d.quantile("return_1", 0.95, 20),
        "p25": d.quantile("return_1", 0.25, 20), "p75": d.quantile("return_1", 0.75, 20), "m2": roll("var_pop", "return_1", 20),
        "returns_20": full("return_1", 20, d.window_list("return_1", 20)), "typicals_20": full("typical", 20, d.window_list("typical", 20)),
        "highs_25": full("high", 25, d.window_list("high", 25)), "lows_25": full("low", 25, d.window_list("low", 25)), "closes_20": full("close", 20, d.window_list("close", 20)),
    }
    kst = "kst_10 + 2 * kst_15 + 3 * kst_20 + 4 * kst_30"
    position = "array_position({0}, {1}({0}))" if d.spark else "list_position({0}, list_{2}({0}))"
    moment = lambda p: d.total(d.map_list("returns_20", f"power(v - mean_return_20, {p})")) + " / 20"
    cfo = "(intercept_20 + slope_20 * (bar_no + 1))"
    fit_last = "(intercept_20 + slope_20 * bar_no)"
    abs_dev = d.sorted(d.map_list("returns_20", "abs(v - median_20)"))
    final = {
        "bb_middle": "sma_20", "bb_upper": "sma_20 + 2 * std_20", "bb_lower": "sma_20 - 2 * std_20", "bb_width": div("4 * std_20", "sma_20"),
        "bb_percent_b": div("close - (sma_20 - 2 * std_20)", "4 * std_20"), "price_to_sma_20": div("close", "sma_20") + " - 1", "price_to_sma_60": div("close", "sma_60") + " - 1",
        "sma_20_slope_5": f"100 * ({div('sma_20', lag('sma_20', 5))} - 1)", "price_zscore_20": div("close - sma_20", "std_20"),
        "true_range_pct": div("true_range", "prev_close"), "normalized_range_14": div("nullif(high_14 - low_14, 0)", "sma_14"), "historical_volatility_20": "log_std_20 * sqrt(20)",
        "relative_volatility_index_14": div("100 * up_std_14", "up_std_14 + down_std_14"), "choppiness_index_14": f"100 * log10({div('tr_sum_14', 'high_14 - low_14')}) / log10(14)",
        "parkinson_volatility_20": f"sqrt({roll('avg', 'log_hl * log_hl / (4 * ln(2))', 20)})",
        "garman_klass_volatility_20": f"sqrt(greatest({roll('avg', 'gk_part', 20)}, CASE WHEN {roll('avg', 'gk_part', 20)} IS NOT NULL THEN 0.0 END))",
        "rogers_satchell_volatility_20": "CASE WHEN rs_mean_20 IS NOT NULL THEN sqrt(greatest(rs_mean_20, 0.0)) END",
        "donchian_high_20": "high_20", "donchian_low_20": "low_20", "donchian_mid_20": "(high_20 + low_20) / 2", "donchian_width_20": div("high_20 - low_20", "(high_20 + low_20) / 2"),
        "donchian_position_20": div("close - low_20", "high_20 - low_20"), "vhf_28": div("max_close_28 - min_close_28", "path_28"), "rolling_drawdown_20": "drawdown",
        "ulcer_index_14": f"sqrt({roll('avg', 'drawdown_14 * drawdown_14', 14)})",
        "roc_12": "roc_raw_12", "momentum_10": "move_10", "efficiency_ratio_10": div("abs(move_10)", "path_10"), "dpo_20": "close_11 - sma_20",
        "awesome_oscillator_5_34": "awesome", "accelerator_oscillator_5_34": f"awesome - ({roll('avg', 'awesome', 5)})",
        "pfe_10": div(f"({_sign('move_10')}) * 100 * sqrt(move_10 * move_10 + 100)", "path_sum_10"), "qstick_10": roll("avg", "body", 10),
        "cci_20": f"(typical - typical_20) / nullif(0.015 * ({d.total(d.map_list('typicals_20', 'abs(v - typical_20)'))} / 20), 0)",
        "mfi_14": "100 - 100 / (1 + " + div("flow_up_14", "flow_down_14") + ")", "williams_r_14": div("-100 * (high_14 - close)", "high_14 - low_14"),
        "demarker_14": div("demand_14", "demand_14 + supply_14"), "cmo_14": div("100 * (gain_14 - loss_14)", "gain_14 + loss_14"),
        "ultimate_osc": f"100 * (4 * {div('bp_7', 'ut_7')} + 2 * {div('bp_14', 'ut_14')} + {div('bp_28', 'ut_28')}) / 7",
        "kst_line": kst, "kst_signal": roll("avg", kst, 9), "coppock_signal_10": roll("avg", "coppock_curve_11_14_10", 10),
        "cfo_20": div(f"100 * (close - {cfo})", "close"), "rvi_10": div("rvi_top_10", "rvi_bottom_10"),
        "vortex_plus_14": div("vp_sum", "tr_sum_14"), "vortex_minus_14": div("vm_sum", "tr_sum_14"), "hma_21": _weighted("hull_input", 4),
        "linear_reg_slope_20": div("100 * slope_20", "sma_20"), "linear_reg_r2_20": full("close", 20, f"CASE WHEN var_pop(close) {over(20)} > 0 THEN regr_r2(close, bar_no) {over(20)} END"),
        "regression_distance_20": div(f"close - {fit_last}", fit_last),
        "ichimoku_tenkan_9": "(high_9 + low_9) / 2", "ichimoku_kijun_26": "(high_26 + low_26) / 2", "ichimoku_senkou_a": "((high_9 + low_9) / 2 + (high_26 + low_26) / 2) / 2",
        "ichimoku_senkou_b_52": "(high_52 + low_52) / 2", "price_to_kijun_26": div("close", "(high_26 + low_26) / 2") + " - 1",
        "aroon_up_25": f"100.0 * {position.format('highs_25', 'array_max', 'max')} / 25", "aroon_down_25": f"100.0 * {position.format('lows_25', 'array_min', 'min')} / 25",
        "obv_slope_20": div(_regression("regr_slope", "obv", 20), "volume_20"), "adl_slope_20": div(_regression("regr_slope", "adl", 20), "volume_20"),
        "vwma_20": div("price_volume_20", "volume_sum_20"), "price_to_vwma_20": div("close", div("price_volume_20", "volume_sum_20")) + " - 1",
        "rolling_vwap_20": div("money_20", "volume_sum_20"), "rolling_vwap_deviation_20": div(f"close - {div('money_20', 'volume_sum_20')}", div("money_20", "volume_sum_20")),
        "cmf_20": div("flow_20", "volume_sum_20"), "ease_of_movement_14": roll("avg", "ease", 14), "volume_oscillator_5_20": div("100 * (volume_5 - volume_20)", "volume_20"),
        "volume_ratio_20": div("volume", "volume_20"), "volume_zscore_20": div("volume - volume_20", "volume_std_20"), "volume_price_correlation_20": rolling_corr("return_1", "volume_change", 20),
        "downside_deviation_20": "sqrt(downside_20)", "upside_deviation_20": "sqrt(upside_20)", "sharpe_like_20": div("mean_return_20", "volatility_20"),
        "sortino_like_20": div("mean_return_20", "sqrt(downside_20)"), "calmar_like_20": div("return_20", "abs(worst_20)"), "median_return_20": "median_20",
        "mad_return_20": f"({d.at(abs_dev, '10')} + {d.at(abs_dev, '11')}) / 2", "return_iqr_20": "p75 - p25", "tail_ratio_20": div("p95", "abs(p05)"),
        "positive_return_ratio_20": f"CASE WHEN bar_no >= 20 THEN avg({_flag('return_1 > 0')}) {over(20)} END",
        "gain_to_pain_ratio_20": full("return_1", 20, div(f"sum(greatest(return_1, 0.0)) {over(20)}", f"abs(sum(least(return_1, 0.0)) {over(20)})")),
        "return_autocorr_20": f"CASE WHEN count(return_1) {over(20)} = 20 THEN {rolling_corr('return_1', 'lag_return', 19)} END",
        "volume_autocorr_20": f"CASE WHEN count(volume_change) {over(20)} = 20 THEN {rolling_corr('volume_change', 'lag_volume_change', 19)} END",
        "return_skew_20": f"(({moment(3)}) / nullif(power(m2, 1.5), 0)) * sqrt(20.0 * 19) / 18",
        "return_kurtosis_20": f"((21.0 * (({moment(4)}) / nullif(m2 * m2, 0) - 3)) + 6) * 19.0 / (18.0 * 17)",
        "price_percent_rank_20": d.percent_rank("close", 20), "volume_percent_rank_20": d.percent_rank("volume", 20), "range_percent_rank_20": d.percent_rank("width_pct", 20),
        "balance_of_power": div("body", "width"), "candle_body_pct": div("body", "open"), "upper_shadow_pct": div("upper_shadow", "width"), "lower_shadow_pct": div("lower_shadow", "width"),
        "body_to_range_ratio": div("body_abs", "width"), "close_location_value": "flow_share", "intrabar_trend_efficiency": div("body", "true_range"),
        "sma_cross_10_60": _two_way(f"sma_10 > sma_60 AND {lag('sma_10')} <= {lag('sma_60')}", f"sma_10 < sma_60 AND {lag('sma_10')} >= {lag('sma_60')}"),
        "pivot_classic": "(prev_high + prev_low + prev_close) / 3", "pivot_r1": "2 * (prev_high + prev_low + prev_close) / 3 - prev_low",
        "pivot_s1": "2 * (prev_high + prev_low + prev_close) / 3 - prev_high", "pivot_r2": "(prev_high + prev_low + prev_close) / 3 + (prev_high - prev_low)",
        "pivot_s2": "(prev_high + prev_low + prev_close) / 3 - (prev_high - prev_low)", "distance_to_pivot_pct": div("close - (prev_high + prev_low + prev_close) / 3", "(prev_high + prev_low + prev_close) / 3"),
        "pattern_doji": _flag(div("body_abs", "width") + " < 0.1"), "pattern_hammer": _flag("lower_shadow > 2 * body_abs AND upper_shadow < body_abs AND width > 0"),
        "pattern_engulfing": _two_way("body > 0 AND prev_body < 0 AND body_abs > prev_body_abs", "body < 0 AND prev_body > 0 AND body_abs > prev_body_abs"),
        "pattern_morning_evening_star": _two_way("body_2 < 0 AND prev_body_abs < 0.3 * nullif(prev_width, 0) AND body > 0 AND close > close_2", "body_2 > 0 AND prev_body_abs < 0.3 * nullif(prev_width, 0) AND body < 0 AND close < close_2"),
        "pattern_three_soldiers_crows": _two_way("body > 0 AND prev_body > 0 AND body_2 > 0 AND close > prev_close AND prev_close > close_2", "body < 0 AND prev_body < 0 AND body_2 < 0 AND close < prev_close AND prev_close < close_2"),
        "pattern_pin_bar": _two_way("lower_shadow > 2.5 * body_abs AND upper_shadow < body_abs", "upper_shadow > 2.5 * body_abs AND lower_shadow < body_abs"),
        "pattern_inside_bar": _flag("high < prev_high AND low > prev_low"), "pattern_outside_bar": _flag("high > prev_high AND low < prev_low"),
        "realized_volatility_10": f"sqrt({roll('sum', 'log_return * log_return', 10)})",
        "yang_zhang_volatility_20": keep_null("oc_var + co_var + rs_mean_20", "sqrt(greatest(oc_var + {k} * co_var + (1 - {k}) * rs_mean_20, 0.0))".format(k="(0.34 / (1.34 + 21.0 / 19.0))")),
        "intraday_intensity_20": div("intensity_sum", "volume_sum_20"), "relative_volume_5": div("volume", "volume_5"),
        "tick_intensity": div("abs(return_1)", div("volume", "volume_20")), "amihud_illiquidity_20": "illiquid_20", "kyle_lambda_20": rolling_corr("return_1", div("sign_volume", "volume_20"), 20),
        "return_dispersion_20": roll("stddev_pop", "log_hl", 20), "overnight_gap_pct": div("open - prev_close", "prev_close"),
    }
    last = {
        "rvi_signal_4": f"(rvi_10 + 2 * {lag('rvi_10')} + 2 * {lag('rvi_10', 2)} + {lag('rvi_10', 3)}) / 6", "aroon_osc_25": "aroon_up_25 - aroon_down_25",
        "ichimoku_cloud_width": div("abs(ichimoku_senkou_a - ichimoku_senkou_b_52)", "close"),
        "ichimoku_cloud_position": div("close - least(ichimoku_senkou_a, ichimoku_senkou_b_52)", "abs(ichimoku_senkou_a - ichimoku_senkou_b_52)"),
        "ichimoku_signal": f"({_two_way('close > ichimoku_senkou_a AND close > ichimoku_senkou_b_52', 'close < ichimoku_senkou_a AND close < ichimoku_senkou_b_52')}) + ({_two_way('ichimoku_tenkan_9 > ichimoku_kijun_26', 'ichimoku_tenkan_9 < ichimoku_kijun_26')})",
    }
    return [first, second, third, rolled, final, last]


#: Names that each registered query returns, by group.
GROUPS = {
    "trend": "sma_5 sma_10 sma_20 sma_60 sma_120 hma_21 price_to_sma_20 price_to_sma_60 sma_20_slope_5 vhf_28 linear_reg_slope_20 linear_reg_r2_20 regression_distance_20 ichimoku_tenkan_9 ichimoku_kijun_26 ichimoku_senkou_a ichimoku_senkou_b_52 ichimoku_cloud_width ichimoku_cloud_position price_to_kijun_26 aroon_up_25 aroon_down_25 aroon_osc_25 vortex_plus_14 vortex_minus_14 efficiency_ratio_10 sma_cross_10_60 ichimoku_signal",
    "momentum": "roc_12 momentum_10 cfo_20 awesome_oscillator_5_34 accelerator_oscillator_5_34 pfe_10 cci_20 mfi_14 williams_r_14 ultimate_osc cmo_14 dpo_20 coppock_curve_11_14_10 coppock_signal_10 kst_line kst_signal qstick_10 demarker_14 rvi_10 rvi_signal_4",
    "volatility": "bb_middle bb_upper bb_lower bb_width bb_percent_b true_range_pct normalized_range_14 historical_volatility_20 relative_volatility_index_14 choppiness_index_14 parkinson_volatility_20 garman_klass_volatility_20 rogers_satchell_volatility_20 donchian_high_20 donchian_low_20 donchian_mid_20 donchian_width_20 donchian_position_20 rolling_drawdown_20 ulcer_index_14",
    "volume": "obv obv_slope_20 vwma_20 price_to_vwma_20 rolling_vwap_20 rolling_vwap_deviation_20 cmf_20 adl adl_slope_20 volume_ratio_20 volume_zscore_20 volume_price_correlation_20 price_volume_trend ease_of_movement_14 volume_oscillator_5_20",
    "risk": "return_1 return_5 return_20 volatility_20 downside_deviation_20 upside_deviation_20 sharpe_like_20 sortino_like_20 calmar_like_20 gain_to_pain_ratio_20 median_return_20 mad_return_20 return_iqr_20 tail_ratio_20 positive_return_ratio_20 return_autocorr_20 volume_autocorr_20 return_skew_20 return_kurtosis_20 price_zscore_20 price_percent_rank_20 volume_percent_rank_20 range_percent_rank_20",
    "structure": "balance_of_power candle_body_pct upper_shadow_pct lower_shadow_pct body_to_range_ratio close_location_value intrabar_trend_efficiency pivot_classic pivot_r1 pivot_s1 pivot_r2 pivot_s2 distance_to_pivot_pct pattern_doji pattern_hammer pattern_engulfing pattern_morning_evening_star pattern_three_soldiers_crows pattern_pin_bar pattern_inside_bar pattern_outside_bar",
    "volume_index": "nvi pvi",
    "microstructure": "realized_volatility_10 yang_zhang_volatility_20 intraday_intensity_20 relative_volume_5 tick_intensity amihud_illiquidity_20 kyle_lambda_20 return_dispersion_20 overnight_gap_pct",
}


def names(group: str) -> list[str]:
    return GROUPS[group].split()


def window_indicators(bars: DataFrame) -> DataFrame:
    """All window indicators of bars (see BAR), one row for each bar. A column that no caller
    selects is pruned with the frames that only it needs."""
    out = bars.select(*BAR)
    for layer in layers(SPARK):
        out = out.selectExpr("*", *(f"{formula} AS {name}" for name, formula in layer.items()))
    return out


def sql(bars: str, group: str, dialect: Dialect) -> str:
    """The same as one SQL statement over the table or subquery ``bars``."""
    text = f"SELECT {', '.join(BAR)} FROM ({bars}) b"
    for i, layer in enumerate(layers(dialect)):
        text = f"SELECT *, {', '.join(f'{formula} AS {name}' for name, formula in layer.items())} FROM ({text}) l{i}"
    return f"SELECT {', '.join([*KEY, *names(group)])} FROM ({text}) x"
