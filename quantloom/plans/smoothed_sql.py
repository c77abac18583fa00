"""SQL of the smoothed indicators for a second engine: one recursive query that carries every average from bar to
bar. Written from the definitions, not from the operator."""

from __future__ import annotations

#: (average, its input, its weight): an input names earlier averages by n_; it is skipped while it is null
AVERAGES = (
    ("e7", "b.close", "2 / 8"), ("e20", "b.close", "2 / 21"), ("e50", "b.close", "2 / 51"), ("e100", "b.close", "2 / 101"), ("e12", "b.close", "2 / 13"), ("e26", "b.close", "2 / 27"), ("e30", "b.close", "2 / 31"),
    ("e20b", "n_e20", "2 / 21"), ("e20c", "n_e20b", "2 / 21"), ("e30b", "n_e30", "2 / 31"), ("e30c", "n_e30b", "2 / 31"), ("zl", "2 * b.close - b.close_9", "2 / 21"),
    ("macds", "n_e12 - n_e26", "2 / 10"), ("ppos", "100 * (n_e12 - n_e26) / n_e26", "2 / 10"),
    ("g14", "b.gain", "1 / 14"), ("l14", "b.loss", "1 / 14"), ("g28", "b.gain", "1 / 28"), ("l28", "b.loss", "1 / 28"), ("rg", "b.gain_5", "1 / 14"), ("rl", "b.loss_5", "1 / 14"),
    ("atr", "b.tr", "1 / 14"), ("pdm", "b.pdm", "1 / 14"), ("mdm", "b.mdm", "1 / 14"),
    ("dx", "CASE WHEN b.i >= 15 THEN 100 * abs(n_pdm - n_mdm) / nullif(n_pdm + n_mdm, 0) END", "1 / 14"),
    ("k", "b.rsv", "1 / 3"), ("d", "n_k", "1 / 3"), ("sd1", "b.mid_gap", "2 / 4"), ("sd2", "n_sd1", "2 / 4"), ("ss1", "b.span", "2 / 4"), ("ss2", "n_ss1", "2 / 4"), ("smis", "200 * n_sd2 / nullif(n_ss2, 0)", "2 / 4"),
    ("t1", "b.delta", "2 / 26"), ("t2", "n_t1", "2 / 14"), ("u1", "abs(b.delta)", "2 / 26"), ("u2", "n_u1", "2 / 14"), ("tsis", "100 * n_t2 / nullif(n_u2, 0)", "2 / 8"),
    ("fi", "b.delta * b.volume", "2 / 14"),
)

INPUTS = """SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS mdm, greatest(delta, 0) + 0 * delta AS gain, greatest(-delta, 0) + 0 * delta AS loss,
 greatest(close - close_5, 0) + 0 * close_5 AS gain_5, greatest(close_5 - close, 0) + 0 * close_5 AS loss_5 FROM (
 SELECT *, close - before AS delta, high - high_before AS up, low_before - low AS down, CASE WHEN before IS NOT NULL THEN greatest(high - low, abs(high - before), abs(low - before)) END AS tr,
  CASE WHEN i >= 9 THEN 100 * (close - bottom_9) / nullif(top_9 - bottom_9, 0) END AS rsv, CASE WHEN i >= 14 THEN close - (top_14 + bottom_14) / 2 END AS mid_gap, CASE WHEN i >= 14 THEN top_14 - bottom_14 END AS span FROM (
 SELECT symbol, timeframe, open_time, high, low, close, volume, row_number() OVER w AS i, lag(close) OVER w AS before, lag(high) OVER w AS high_before, lag(low) OVER w AS low_before, lag(close, 5) OVER w AS close_5, lag(close, 9) OVER w AS close_9,
  max(high) OVER (w ROWS 8 PRECEDING) AS top_9, min(low) OVER (w ROWS 8 PRECEDING) AS bottom_9, max(high) OVER (w ROWS 13 PRECEDING) AS top_14, min(low) OVER (w ROWS 13 PRECEDING) AS bottom_14 FROM ({bars}) x WINDOW w AS (PARTITION BY symbol ORDER BY open_time)))"""

COLUMNS = """ema_7 ema_20 ema_50 ema_100 dema_20 tema_20 zlema_20 price_to_ema_20 price_to_ema_50 ema_20_slope_5 macd_line macd_signal macd_hist macd_hist_zscore_20 ppo_line ppo_signal ppo_hist rsi_14 rsi_28 rmi_14_5 stoch_rsi_k_14 stoch_rsi_d_14
stoch_k stoch_d stoch_j stochastic_momentum_index_14_3 stochastic_momentum_signal_14_3 atr_14 atr_pct_14 keltner_middle_20 keltner_upper_20 keltner_lower_20 keltner_width_20 plus_di_14 minus_di_14 adx_14 adxr_14 dmi_oscillator_14 tsi_line tsi_signal trix_30
force_index_13""".split()


def sql(bars: str) -> str:
    names = [n for n, _, _ in AVERAGES]
    first = ", ".join(f"{x} AS n_{n}" for n, x, _ in AVERAGES)
    then = ", ".join(f"coalesce(r.{n} + ({w}) * (({x}) - r.{n}), r.{n}, {x}) AS n_{n}" for n, x, w in AVERAGES)
    full = lambda x, n: f"CASE WHEN count({x}) OVER (w ROWS {n - 1} PRECEDING) = {n} THEN "
    return f"""WITH RECURSIVE b AS (SELECT * REPLACE (i::BIGINT AS i) FROM ({INPUTS.format(bars=bars)})), r(symbol, i, {', '.join(names)}) AS (
 SELECT b.symbol, b.i, {first} FROM b WHERE b.i = 1 UNION ALL SELECT b.symbol, b.i, {then} FROM r JOIN b ON b.symbol = r.symbol AND b.i = r.i + 1),
 c AS (SELECT b.timeframe, b.open_time, b.close, r.*, CASE WHEN r.i >= 15 THEN atr END AS atr_14, CASE WHEN r.i >= 15 THEN 100 - 100 / (1 + g14 / nullif(l14, 0)) END AS rsi_14, e12 - e26 - macds AS macd_hist FROM r JOIN b ON b.symbol = r.symbol AND b.i = r.i),
 s AS (SELECT *, {full('rsi_14', 14)} 100 * (rsi_14 - min(rsi_14) OVER (w ROWS 13 PRECEDING)) / nullif(max(rsi_14) OVER (w ROWS 13 PRECEDING) - min(rsi_14) OVER (w ROWS 13 PRECEDING), 0) END AS stoch_rsi, CASE WHEN i >= 28 THEN dx END AS adx_14 FROM c WINDOW w AS (PARTITION BY symbol ORDER BY i)),
 t AS (SELECT *, {full('stoch_rsi', 3)} avg(stoch_rsi) OVER (w ROWS 2 PRECEDING) END AS stoch_rsi_k_14 FROM s WINDOW w AS (PARTITION BY symbol ORDER BY i))
 SELECT symbol, timeframe, open_time, e7 AS ema_7, e20 AS ema_20, e50 AS ema_50, e100 AS ema_100, 2 * e20 - e20b AS dema_20, 3 * (e20 - e20b) + e20c AS tema_20, zl AS zlema_20, close / e20 - 1 AS price_to_ema_20, close / e50 - 1 AS price_to_ema_50,
  100 * (e20 / lag(e20, 5) OVER w - 1) AS ema_20_slope_5, e12 - e26 AS macd_line, macds AS macd_signal, macd_hist, {full('macd_hist', 20)} (macd_hist - avg(macd_hist) OVER (w ROWS 19 PRECEDING)) / nullif(stddev_pop(macd_hist) OVER (w ROWS 19 PRECEDING), 0) END AS macd_hist_zscore_20,
  100 * (e12 - e26) / e26 AS ppo_line, ppos AS ppo_signal, 100 * (e12 - e26) / e26 - ppos AS ppo_hist, rsi_14, CASE WHEN i >= 29 THEN 100 - 100 / (1 + g28 / nullif(l28, 0)) END AS rsi_28, CASE WHEN i >= 19 THEN 100 - 100 / (1 + rg / nullif(rl, 0)) END AS rmi_14_5,
  stoch_rsi_k_14, {full('stoch_rsi_k_14', 3)} avg(stoch_rsi_k_14) OVER (w ROWS 2 PRECEDING) END AS stoch_rsi_d_14, k AS stoch_k, d AS stoch_d, 3 * k - 2 * d AS stoch_j, 200 * sd2 / nullif(ss2, 0) AS stochastic_momentum_index_14_3, smis AS stochastic_momentum_signal_14_3,
  atr_14, atr_14 / close AS atr_pct_14, e20 AS keltner_middle_20, e20 + 2 * atr_14 AS keltner_upper_20, e20 - 2 * atr_14 AS keltner_lower_20, 4 * atr_14 / e20 AS keltner_width_20, 100 * pdm / nullif(atr_14, 0) AS plus_di_14, 100 * mdm / nullif(atr_14, 0) AS minus_di_14,
  adx_14, (adx_14 + lag(adx_14, 14) OVER w) / 2 AS adxr_14, 100 * (pdm - mdm) / nullif(atr_14, 0) AS dmi_oscillator_14, 100 * t2 / nullif(u2, 0) AS tsi_line, tsis AS tsi_signal, 100 * (e30c / lag(e30c) OVER w - 1) AS trix_30, fi AS force_index_13
 FROM t WINDOW w AS (PARTITION BY symbol ORDER BY i)"""
