"""Domain scores and classifiers as SQL expressions of their arguments.

Every function takes SQL text (a column name or an expression) and returns SQL text that
Catalyst compiles into the surrounding projection; column() makes a Column of it. Where
an argument is NULL a score is NULL, and a ladder gives its last label.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(expression: str) -> Column:
    return F.expr(expression)


def clip(x: str, low: float, high: float) -> str:
    """x within bounds. greatest() and least() skip NULL, so a formula that clips is a strict() one; to test x
    here would write it twice, and a nest of clips would double with every level."""
    return f"greatest({low}, least({high}, ({x})))"


def strict(formula: Callable[..., str]) -> Callable[..., str]:
    """The formula, and NULL where any of its arguments is."""

    @wraps(formula)
    def guarded(*args) -> str:
        given = " AND ".join(f"({a}) IS NOT NULL" for a in args if isinstance(a, str))
        return f"CASE WHEN {given} THEN {formula(*args)} END"

    return guarded


def ladder(x: str, steps: list[tuple[str, str]], last: str) -> str:
    """The label of the first step ('>= 2', 'extreme') that x meets."""
    return "CASE " + " ".join(f"WHEN ({x}) {test} THEN '{label}'" for test, label in steps) + f" ELSE '{last}' END"


def share(a: str, b: str) -> str:
    """a / b, 0 unless b is positive."""
    return f"CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE 0.0 END"


# Ladders: values at which the label changes, from the top.
def standard_regime(z: str) -> str:
    return f"CASE WHEN ({z}) IS NULL THEN 'unknown' ELSE {ladder(z, [('>= 2', 'extreme_high'), ('>= 1', 'elevated'), ('>= -1', 'normal'), ('>= -2', 'depressed')], 'extreme_low')} END"


def coverage_confidence(available: str, required: str) -> str:
    return ladder(share(available, required), [(">= 0.8", "high"), (">= 0.5", "medium")], "low")


def volatility_regime(v: str) -> str:
    return ladder(v, [("< 0.3", "low"), ("< 0.6", "normal"), ("< 1.0", "high")], "extreme")


def funding_bias(rate: str) -> str:
    return ladder(rate, [("> 0.0005", "long_crowded"), ("< -0.0005", "short_crowded"), ("> 0.0001", "slight_long"), ("< -0.0001", "slight_short")], "neutral")


def basis_regime(pct: str) -> str:
    return ladder(pct, [("> 0.1", "contango"), ("< -0.1", "backwardation")], "flat")


def correlation_regime(r: str) -> str:
    return ladder(f"abs({r})", [(">= 0.7", "high_corr"), (">= 0.4", "moderate_corr")], "decorrelated")


def liquidity_cycle(score: str) -> str:
    return ladder(score, [(">= 70", "expansion"), (">= 45", "neutral"), (">= 20", "contraction")], "crisis")


def sentiment_extreme(score: str) -> str:
    return ladder(score, [("< 15", "extreme_fear"), ("< 30", "fear"), ("<= 70", "neutral"), ("<= 85", "greed")], "extreme_greed")


def puell_zone(x: str) -> str:
    return ladder(x, [("<= 0.5", "capitulation"), ("<= 0.8", "recovery"), ("<= 4.0", "normal")], "overheated")


def conviction_direction(x: str) -> str:
    return ladder(x, [(">= 80", "strong_bullish"), (">= 60", "bullish"), (">= 40", "neutral"), (">= 20", "bearish")], "strong_bearish")


def expansion_signal(pulse: str) -> str:
    return ladder(pulse, [("> 0.15", "expansion"), ("< -0.15", "contraction")], "neutral")


def sopr_state(x: str) -> str:
    return ladder(x, [("> 1", "profit_taking"), ("< 1", "capitulation")], "neutral")


def depth_regime(bid: str, ask: str, imbalance: str) -> str:
    total = f"(({bid}) + ({ask}))"
    return f"CASE WHEN {total} < 50000 THEN 'vacuum' WHEN {total} < 500000 THEN 'thin' WHEN abs({imbalance}) > 0.4 THEN 'asymmetric' ELSE 'thick' END"


def freshness(age: str, fresh: str) -> str:
    return f"CASE WHEN ({age}) <= ({fresh}) THEN 'ready' WHEN ({age}) <= 3 * ({fresh}) THEN 'limited' ELSE 'missing' END"


# Order books and liquidations.
@strict
def liquidity_score(spread: str, bid: str, ask: str) -> str:
    depth = clip(f"log10(greatest(({bid}) + ({ask}), 1.0)) / 7 * 100", -1e9, 100)
    balance = f"CASE WHEN ({bid}) > 0 AND ({ask}) > 0 THEN 100 * least({bid}, {ask}) / greatest({bid}, {ask}) ELSE 0.0 END"
    return clip(f"0.3 * greatest(0.0, 100 - 2 * ({spread})) + 0.4 * ({depth}) + 0.3 * ({balance})", 0, 100)


@strict
def wall_strength(wall: str, mean_level: str, seen: str) -> str:
    return f"CASE WHEN ({mean_level}) > 0 THEN {clip(f'least(50.0, ({wall}) / ({mean_level}) * 10) + least(50.0, ({seen}) * 5.0)', 0, 100)} ELSE 0.0 END"


@strict
def depth_price_divergence(depth_change: str, price_change: str) -> str:
    return clip(f"-10 * ({depth_change}) * ({price_change})", -1, 1)


@strict
def cascade_probability(cluster: str, daily_volume: str, distance: str) -> str:
    inner = clip(f"0.6 * least(({cluster}) / ({daily_volume}) / 0.1, 1.0) + 0.4 * exp(-({distance}) / 3)", 0, 1)
    return f"CASE WHEN ({daily_volume}) <= 0 OR ({distance}) < 0 THEN 0.0 ELSE {inner} END"


def cascade_severity(probability: str, cluster: str, open_interest: str) -> str:
    score = f"0.5 * ({probability}) + 0.5 * least(({cluster}) / ({open_interest}) / 0.05, 1.0)"
    return f"CASE WHEN ({open_interest}) <= 0 THEN 'low' ELSE {ladder(score, [('>= 0.75', 'critical'), ('>= 0.5', 'high'), ('>= 0.25', 'medium')], 'low')} END"


# Rates and basis.
def basis_pct(spot: str, future: str) -> str:
    return f"CASE WHEN ({spot}) > 0 THEN (({future}) - ({spot})) / ({spot}) * 100 ELSE 0.0 END"


def annualized_basis(pct: str, days: str) -> str:
    return f"CASE WHEN ({days}) > 0 THEN ({pct}) * 365 / ({days}) ELSE 0.0 END"


@strict
def mean_reversion(z: str, scale: float) -> str:
    return clip(f"-({z}) / {scale}", -1, 1)


# On-chain, lending and macro liquidity.
@strict
def stress_index(liquidation_rate: str, utilization: str, low_health: str) -> str:
    return clip(f"least(40.0, ({liquidation_rate}) * 800) + least(30.0, ({utilization}) / 0.9 * 30) + least(30.0, ({low_health}) * 150)", 0, 100)


@strict
def stress_cascade(below_11: str, below_13: str, above_15: str, drop: str) -> str:
    risk = (
        f"CASE WHEN ({drop}) <= 5 THEN ({below_11}) + (({below_13}) - ({below_11})) * ({drop}) / 10"
        f" WHEN ({drop}) <= 10 THEN ({below_13}) + (1 - ({below_13}) - ({above_15})) * (({drop}) - 5) / 15"
        f" ELSE least(1.0, ({below_13}) + (1 - ({above_15})) * ({drop}) / 25) END"
    )
    return clip(f"({risk}) * (1 + 0.5 * ({risk}))", 0, 1)


def systemic(stress: str, probability: str) -> str:
    return f"((({stress}) > 70 AND ({probability}) > 0.3) OR ({stress}) > 90 OR ({probability}) > 0.6)"


def protocol_risk(utilization: str, liquidation_rate: str, tvl: str) -> str:
    return f"40 * least(1.0, ({utilization}) / 0.95) + 40 * least(1.0, ({liquidation_rate}) / 0.05) + 20 * least(1.0, ({tvl}) / 1e10)"


@strict
def liquidity_regime_score(staking: str, reserve: str, stable: str) -> str:
    parts = " + ".join(f"{w} * ({clip(f'({x}) / 0.2', -1, 1)})" for w, x in ((0.3, staking), (0.4, reserve), (0.3, stable)))
    return clip(f"50 * ({parts} + 1)", 0, 100)


def supply_shock(change: str) -> str:
    return f"1 / (1 + exp(-10 * ({change})))"


def market_phase(mvrv: str, sopr: str, shock: str) -> str:
    return (
        f"CASE WHEN ({mvrv}) < 25 AND ({sopr}) = 'capitulation' THEN 'accumulation' WHEN ({mvrv}) > 75 AND ({sopr}) = 'profit_taking' THEN 'distribution'"
        f" WHEN ({mvrv}) >= 25 AND ({shock}) > 0.6 THEN 'markup' WHEN ({mvrv}) <= 50 AND ({shock}) < 0.4 AND ({sopr}) = 'capitulation' THEN 'markdown'"
        f" WHEN ({mvrv}) > 60 THEN CASE WHEN ({sopr}) = 'profit_taking' THEN 'distribution' ELSE 'markup' END"
        f" WHEN ({mvrv}) < 40 THEN CASE WHEN ({sopr}) = 'capitulation' THEN 'accumulation' ELSE 'markdown' END"
        f" WHEN ({shock}) >= 0.5 THEN 'markup' ELSE 'markdown' END"
    )


@strict
def miner_capitulation(puell_pct: str, hashrate_change: str, outflow: str) -> str:
    return f"0.4 * ({clip(f'100 - ({puell_pct})', 0, 100)}) + 0.35 * ({clip(f'-1000 * least(0.0, {hashrate_change})', 0, 100)}) + 0.25 * ({clip(f'100 * ({outflow})', 0, 100)})"


@strict
def halving_progress(height: str, last: int = 840_000, period: int = 210_000) -> str:
    return clip(f"(({height}) - {last}) * 100.0 / {period}", 0, 100)


# Sentiment and attention.
@strict
def sentiment_composite(fear_greed: str, long_short: str, funding: str, social: str) -> str:
    parts = ((0.35, fear_greed), (0.25, f"50 * ({long_short})"), (0.2, f"50 + 500 * ({funding})"), (0.2, social))
    return " + ".join(f"{w} * ({clip(x, 0, 100)})" for w, x in parts)


@strict
def reversal_probability(extreme: str, divergence: str, hours: str) -> str:
    base = f"CASE WHEN ({extreme}) IN ('extreme_fear', 'extreme_greed') THEN 0.35 WHEN ({extreme}) IN ('fear', 'greed') THEN 0.15 ELSE 0.05 END"
    return clip(f"({base}) + 0.3 * ({divergence}) + CASE WHEN ({hours}) > 0 THEN 0.25 * (1 - exp(-({hours}) / 48.0)) ELSE 0.0 END", 0, 1)


def funding_consistency(score: str, funding: str) -> str:
    return f"CASE WHEN (({score}) > 60 AND ({funding}) < -0.0001) OR (({score}) < 40 AND ({funding}) > 0.0001) THEN 'divergent' ELSE 'consistent' END"


@strict
def fomo_index(search: str, social_z: str, listing: str, fear_greed: str) -> str:
    return clip(f"0.3 * ({clip(search, 0, 100)}) + ({clip(f'({social_z}) / 3 * 25', 0, 25)}) + 0.2 * ({clip(listing, 0, 100)}) + greatest(0.0, (({fear_greed}) - 50) / 2)", 0, 100)


@strict
def fud_index(decline: str, negativity: str, fear_greed: str) -> str:
    return clip(f"0.35 * ({clip(decline, 0, 100)}) + 35 * ({clip(negativity, 0, 1)}) + greatest(0.0, (50 - ({fear_greed})) * 0.6)", 0, 100)


@strict
def contrarian_strength(fomo: str, fud: str) -> str:
    return clip(f"(greatest({fomo}, {fud}) - 70) / 30", 0, 1)


@strict
def attention_score(mentions: str, sentiment: str, correlation: str) -> str:
    return f"least(40.0, 10 * sqrt(greatest({mentions}, 0.0))) + least(30.0, 30 * abs({sentiment})) + ({clip(f'30 * ({correlation})', 0, 30)})"


def phase_transition(phase: str, attention: str, trend: str, mentions_delta: str) -> str:
    return (
        f"CASE ({phase}) WHEN 'emerging' THEN CASE WHEN ({trend}) > 0.2 AND ({attention}) > 20 THEN 'growing' END"
        f" WHEN 'growing' THEN CASE WHEN ({attention}) > 70 AND ({trend}) < 0.1 THEN 'peak' WHEN ({trend}) < -0.3 THEN 'decaying' END"
        f" WHEN 'peak' THEN CASE WHEN ({trend}) < -0.2 OR ({attention}) < 50 THEN 'decaying' END"
        f" WHEN 'decaying' THEN CASE WHEN ({trend}) > 0.3 AND ({mentions_delta}) > 0 THEN 'growing' END END"
    )


@strict
def event_impact(volume: str, liquidity: str, change: str) -> str:
    thin = f"CASE WHEN ({liquidity}) > 0 THEN 1 - least(({liquidity}) / 1e7, 1.0) ELSE 1.0 END"
    return clip(f"100 * (0.3 * ({clip(f'({volume}) / 1e6', 0, 1)}) + 0.3 * ({thin}) + 0.4 * least(abs({change}) / 0.5, 1.0))", 0, 100)


def cross_validation(direction: str, sentiment: str) -> str:
    return (
        f"CASE WHEN abs({sentiment}) <= 0.1 OR ({direction}) NOT IN ('up', 'down') THEN 'neutral'"
        f" WHEN (({direction}) = 'up') = (({sentiment}) > 0) THEN 'confirmed' ELSE 'divergent' END"
    )


# Positions and unlocks.
@strict
def conviction_index(pnl: str, direction: str, consistency: str) -> str:
    return clip(f"20 * (({clip(f'({pnl}) / 0.1', -1, 1)}) + 1) + 35 * abs({direction}) + 25 * ({clip(consistency, 0, 1)})", 0, 100)


@strict
def retail_divergence(smart: str, retail: str) -> str:
    return clip(f"(({retail}) - ({smart})) / 2", -1, 1)


@strict
def unlock_impact(pressure: str, reaction: str) -> str:
    return clip(f"least(50.0, 25 * ({pressure})) + least(50.0, 500 * abs({reaction}))", 0, 100)


@strict
def price_impact(pressure: str, depth: str) -> str:
    return f"CASE WHEN ({pressure}) > 0 THEN least(50.0, 2 * sqrt({pressure}) * ({clip(depth, 0.5, 3)})) ELSE 0.0 END"


@strict
def liquidity_absorption(volume: str, depth: str) -> str:
    return f"0.4 * ({clip(f'({depth}) / 5e6', 0, 1)}) + 0.6 * ({clip(f'({volume}) / 1e8', 0, 1)})"


# Research panel.
def weighted_geometric_mean(values: list[str], weights: list[float], floor: float = 1e-6) -> str:
    terms = " + ".join(f"{w} * ln(greatest({v}, {floor}))" for v, w in zip(values, weights, strict=True))
    return f"exp(({terms}) / {sum(weights)})"


def continuous_honesty(excluded: str, contamination: str) -> str:
    return f"exp(-2 * ({contamination})) * greatest(0.0, 1 - 0.5 * (1 - ({excluded})))"


def wilson(p: str, n: str, z: float = 1.96) -> tuple[str, str]:
    """Bounds of the interval of a share."""
    base, spread = f"(({p}) + {z * z} / (2 * ({n}))) / (1 + {z * z} / ({n}))", f"{z} * sqrt(({p}) * (1 - ({p})) / ({n}) + {z * z} / (4 * ({n}) * ({n}))) / (1 + {z * z} / ({n}))"
    return f"greatest(0.0, {base} - {spread})", f"least(1.0, {base} + {spread})"
