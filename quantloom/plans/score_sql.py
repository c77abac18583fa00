"""SQL of the score queries for a second engine, written out by hand from the scores' definitions and not from the
functions that Spark runs. Inputs: u, v in 0 to 1; h in 2 to 100; p a price; s, r in -1 to 1; m in -24.5 to 24.5."""

LADDERS = """CASE WHEN m / 8 >= 2 THEN 'extreme_high' WHEN m / 8 >= 1 THEN 'elevated' WHEN m / 8 < -2 THEN 'extreme_low' WHEN m / 8 < -1 THEN 'depressed' ELSE 'normal' END AS regime,
 CASE WHEN h >= 72 THEN 'high' WHEN h >= 45 THEN 'medium' ELSE 'low' END AS confidence,
 CASE WHEN h / 70 >= 1 THEN 'extreme' WHEN h / 70 >= 0.6 THEN 'high' WHEN h / 70 >= 0.3 THEN 'normal' ELSE 'low' END AS volatility,
 CASE WHEN abs(s / 1000) <= 0.0001 THEN 'neutral' WHEN abs(s / 1000) > 0.0005 THEN CASE WHEN s > 0 THEN 'long_crowded' ELSE 'short_crowded' END WHEN s > 0 THEN 'slight_long' ELSE 'slight_short' END AS bias,
 CASE WHEN abs(s / 4) <= 0.1 THEN 'flat' WHEN s > 0 THEN 'contango' ELSE 'backwardation' END AS basis,
 CASE WHEN s BETWEEN -0.4 AND 0.4 AND abs(s) < 0.4 THEN 'decorrelated' WHEN abs(s) < 0.7 THEN 'moderate_corr' ELSE 'high_corr' END AS correlation,
 CASE WHEN h < 20 THEN 'crisis' WHEN h < 45 THEN 'contraction' WHEN h < 70 THEN 'neutral' ELSE 'expansion' END AS cycle,
 CASE WHEN h > 85 THEN 'extreme_greed' WHEN h > 70 THEN 'greed' WHEN h >= 30 THEN 'neutral' WHEN h >= 15 THEN 'fear' ELSE 'extreme_fear' END AS extreme,
 CASE WHEN h > 80 THEN 'overheated' WHEN h > 16 THEN 'normal' WHEN h > 10 THEN 'recovery' ELSE 'capitulation' END AS puell,
 CASE WHEN h < 20 THEN 'strong_bearish' WHEN h < 40 THEN 'bearish' WHEN h < 60 THEN 'neutral' WHEN h < 80 THEN 'bullish' ELSE 'strong_bullish' END AS direction,
 CASE WHEN abs(s / 3) <= 0.15 THEN 'neutral' WHEN s > 0 THEN 'expansion' ELSE 'contraction' END AS expansion,
 CASE WHEN h = 50 THEN 'neutral' WHEN h > 50 THEN 'profit_taking' ELSE 'capitulation' END AS sopr,
 CASE WHEN p * 5 + p * v * 9 >= 500000 THEN CASE WHEN abs(s) > 0.4 THEN 'asymmetric' ELSE 'thick' END WHEN p * 5 + p * v * 9 >= 50000 THEN 'thin' ELSE 'vacuum' END AS depth,
 CASE WHEN h > 60 THEN 'missing' WHEN h > 20 THEN 'limited' ELSE 'ready' END AS fresh"""

BOOKS = """least(100, 0.3 * greatest(0, 100 - h / 2) + 0.4 * least(100, 100 * log10(greatest(p * 10 + p * 40 * u, 1)) / 7) + CASE WHEN u > 0 THEN 30 * least(p * 10, p * 40 * u) / greatest(p * 10, p * 40 * u) ELSE 0 END) AS liquidity,
 least(100, least(50, 10 * p / (p * (0.1 + u))) + least(50, 5 * (h / 8))) AS wall,
 greatest(-1, least(1, -s * r)) AS divergence,
 least(1, 0.6 * least(1, (p * u) / (p * 3) * 10) + 0.4 * exp(-(h / 10) / 3)) AS cascade,
 CASE WHEN x >= 0.75 THEN 'critical' WHEN x >= 0.5 THEN 'high' WHEN x >= 0.25 THEN 'medium' ELSE 'low' END AS severity,
 (p * (1 + s / 100) - p) * 100 / p AS basis_pct,
 CASE WHEN h > 10 THEN 365 * s / (h - 10) ELSE 0 END AS annualized,
 greatest(-1, least(1, m / -12)) AS reversion,
 CASE WHEN u > 0 THEN least(50, sqrt(u * 3) * 2 * greatest(0.5, least(3, h / 20))) ELSE 0 END AS impact,
 0.6 * least(1, p * 2000 / 100000000) + 0.4 * least(1, p * 60 / 5000000) AS absorption"""
#: what BOOKS reads beside the inputs
BOOKS_INPUT = "u * 0.987 / 2 + least(1, 20 * (p * v * 0.97) / (p * 20)) / 2 AS x"

ONCHAIN = """least(100, least(40, u * 80) + least(30, v * 100 / 3) + least(30, u * 37.5)) AS stress,
 least(1, k + k * k / 2) AS cascade,
 u > 0.6 OR h > 90 OR (u > 0.3 AND h > 70) AS systemic,
 least(1, v / 0.95) * 40 + least(1, u * 2) * 40 + least(1, p / 100000) * 20 AS protocol,
 50 + 15 * greatest(-1, least(1, s * 1.25)) + 20 * greatest(-1, least(1, r * 1.25)) + 15 * greatest(-1, least(1, s * 0.625)) AS liquidity,
 1 / (1 + exp(s * -2)) AS shock,
 CASE WHEN v > 0.5 THEN CASE WHEN h < 25 THEN 'accumulation' WHEN u > 0.6 THEN 'markup' WHEN h <= 50 AND u < 0.4 THEN 'markdown' WHEN h > 60 THEN 'markup' WHEN h < 40 THEN 'accumulation' WHEN u < 0.5 THEN 'markdown' ELSE 'markup' END
  ELSE CASE WHEN h > 75 THEN 'distribution' WHEN h >= 25 AND u > 0.6 THEN 'markup' WHEN h > 60 THEN 'distribution' WHEN h < 40 THEN 'markdown' WHEN u < 0.5 THEN 'markdown' ELSE 'markup' END END AS phase,
 0.4 * (100 - h) + 0.35 * least(100, CASE WHEN s < 0 THEN s * -125 ELSE 0 END) + 25 * least(1, v) AS miner,
 least(100, p * 4 / 2100) AS halving,
 least(50, u * 75) + least(50, abs(s) * 500 / 9) AS unlock"""
#: the risk k of a drop of h / 5 percent, with the shares of positions below and above its steps
ONCHAIN_INPUT = """CASE WHEN h / 5 > 10 THEN least(1, u / 2.5 + (0.5 + u / 4) * h / 125) WHEN h / 5 > 5 THEN u / 2.5 + (1 - u / 2.5 - (0.5 - u / 4)) * (h / 5 - 5) / 15 ELSE u / 5 + (u / 2.5 - u / 5) * h / 50 END AS k"""

SENTIMENT = """0.35 * h + 0.25 * least(100, u * 150) + 0.2 * greatest(0, least(100, 50 + s * 25)) + 20 * least(1, v) AS composite,
 least(1, CASE WHEN h < 15 THEN 0.35 WHEN h < 40 THEN 0.15 ELSE 0.05 END + u * 0.3 + CASE WHEN m > 0 THEN 0.25 - 0.25 * exp(m / -16) ELSE 0 END) AS reversal,
 CASE WHEN h > 60 AND s < -0.2 THEN 'divergent' WHEN h < 40 AND s > 0.2 THEN 'divergent' ELSE 'consistent' END AS consistency,
 least(100, 0.3 * h + least(25, greatest(0, s * 25)) + 20 * least(1, v) + greatest(0, u * 50 - 25)) AS fomo,
 least(100, 0.35 * h + 35 * least(1, v) + greatest(0, 30 - u * 60)) AS fud,
 greatest(0, least(1, greatest(h, v * 100) / 30 - 7.0 / 3)) AS contrarian,
 least(40, sqrt(h / 4) * 10) + least(30, abs(s) * 30) + greatest(0, least(30, r * 30)) AS attention,
 CASE WHEN v < 0.3 THEN CASE WHEN h > 20 AND s > 0.2 THEN 'growing' END WHEN v < 0.5 THEN CASE WHEN s < 0.1 AND h > 70 THEN 'peak' WHEN s < -0.3 THEN 'decaying' END
  WHEN v < 0.8 THEN CASE WHEN h < 50 OR s < -0.2 THEN 'decaying' END WHEN m > 0 AND s > 0.3 THEN 'growing' END AS transition,
 least(100, 30 * least(1, p / 100000) + 30 * (1 - least(1, p * 9 / 1000000)) + 40 * least(1, abs(s))) AS event,
 CASE WHEN abs(s) <= 0.1 THEN 'neutral' WHEN (v > 0.5 AND s > 0) OR (v <= 0.5 AND s < 0) THEN 'confirmed' ELSE 'divergent' END AS validation,
 least(100, 20 + 20 * greatest(-1, least(1, s * 1.25)) + 35 * abs(r) + 25 * u) AS conviction,
 greatest(-1, least(1, r - s / 2)) AS retail,
 pow(greatest(u, 0.000001), 2.0 / 7) * pow(greatest(v, 0.000001), 4.0 / 7) * pow(greatest(h / 100, 0.000001), 1.0 / 7) AS wmi,
 exp(v * -2) * (0.5 + u / 2) AS honesty,
 greatest(0, (u + 1.9208 / h - 1.96 * sqrt((u * (1 - u) + 0.9604 / h) / h)) / (1 + 3.8416 / h)) AS wilson_low,
 least(1, (u + 1.9208 / h + 1.96 * sqrt((u * (1 - u) + 0.9604 / h) / h)) / (1 + 3.8416 / h)) AS wilson_high"""

BY_GROUP = {"ladders": (LADDERS, ""), "books": (BOOKS, BOOKS_INPUT), "onchain": (ONCHAIN, ONCHAIN_INPUT), "sentiment": (SENTIMENT, "")}


def sql(group: str, source: str) -> str:
    body, inputs = BY_GROUP[group]
    return f"SELECT l_orderkey, l_linenumber, {body} FROM (SELECT *{', ' * bool(inputs)}{inputs} FROM ({source}) i) j"
