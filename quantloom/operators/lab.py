"""The research lab: rules for positions, calibration over a grid, placebos and inference over many strategies.

A panel has one row for each asset and day: (asset, day, ret) and what the rules read: signal, mom5, outage, cascade_p, wmi, ac, c.
All points of a grid are scored in one pass, each as a conditional aggregate beside the others, so the panel is neither
copied nor read again for a point. Chance comes from md5 of a seed and a key: the same everywhere, whatever the tasks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

YEAR = 365
GAMMA = 2.0
# The grid of thresholds, and what stands in where no point of it is admitted.
AC_GRID = (0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55)
C_GRID = (0.25, 0.35, 0.45)
CASCADE_GRID = (0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90)
DEFAULTS = {"ac_thr": 0.35, "c_thr": 0.30, "casc_only_thr": 0.70, "wmi_thr": 0.2}


def keyed(seed: int, *parts: Column) -> Column:
    """A number below 2 ** 60 that seed and parts decide."""
    text = F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


# Positions -------------------------------------------------------------------------------


def directional_signal(regime: Column, cascade_p: Column, mom5: Column, macro: Column, alternative: Column) -> Column:
    """-1, 0 or 1: short in a crisis with a cascade, long in a trend that macro does not contradict or in a range that both tilts
    support, else the sign of momentum, where two negative tilts keep from a long, and of the tilts where there is none."""
    macro, alternative, mom = (F.coalesce(x, F.lit(0.0)) for x in (macro, alternative, mom5))
    return (
        F.when((regime == "crisis") & (cascade_p >= 0.60), -1.0)
        .when((regime == "trend") & (mom > 0) & (cascade_p < 0.45) & (macro >= 0), 1.0)
        .when((regime == "range") & (macro > 0) & (alternative > 0) & (mom >= 0), 1.0)
        .when((mom > 0) & (macro < 0) & (alternative < 0), 0.0)
        .when(mom != 0, mom)
        .otherwise(F.signum(macro + alternative))
    )


def position(policy: str, params: dict | None = None) -> Column:
    """The position that a policy takes; 0 is to stand aside, also where the signal says so."""
    p = DEFAULTS | (params or {})
    signal, mom = F.col("signal").cast("double"), F.col("mom5").cast("double")
    aside = {
        "thick_ungated": F.lit(False), "simple_outage": F.col("outage").cast("boolean"), "simple_casc": F.col("cascade_p") >= p["casc_only_thr"],
        "wmi": F.col("wmi") < p["wmi_thr"], "ac": (F.col("ac") < p["ac_thr"]) | (F.col("c") < p["c_thr"]),
    }
    if policy == "always_long":
        return F.lit(1.0)
    if policy == "mom_always":
        return F.when(mom == 0, 1.0).otherwise(mom)
    return F.when(aside[policy], 0.0).otherwise(signal)


POLICIES = ("always_long", "mom_always", "thick_ungated", "simple_outage", "simple_casc", "wmi", "ac")


# Statistics ------------------------------------------------------------------------------


def utility(pnl: Column, gamma: float) -> Column:
    wealth = F.greatest(1 + pnl, F.lit(1e-8))
    return F.ln(wealth) if gamma == 1 else F.pow(wealth, F.lit(1 - gamma))


def certainty_equivalent(mean_utility: Column, gamma: float) -> Column:
    """A year's certain return of a mean daily utility."""
    daily = F.exp(mean_utility) if gamma == 1 else F.pow(mean_utility, F.lit(1 / (1 - gamma)))
    return (daily - 1) * YEAR


def daily_curves(panel: DataFrame, points: dict[str, Column], cost_bps: float = 0.0) -> DataFrame:
    """(day, rows, and of each point its mean profit ``name`` and how many assets stand aside ``name__aside``). A cost is paid on each change
    of an asset's position, the first one included."""
    held = panel.withColumns({f"_{n}": c for n, c in points.items()})
    if cost_bps:
        before = W.partitionBy("asset").orderBy("day")
        turn = lambda n: F.abs(F.col(f"_{n}") - F.coalesce(F.lag(f"_{n}").over(before), F.lit(0.0)))
        held = held.withColumns({f"_{n}_cost": turn(n) * (cost_bps / 1e4) for n in points})
    profit = lambda n: F.col(f"_{n}") * F.col("ret") - (F.col(f"_{n}_cost") if cost_bps else 0.0)
    aggregates = [a for n in points for a in (F.avg(profit(n)).alias(n), F.count_if(F.col(f"_{n}") == 0).alias(f"{n}__aside"))]
    return held.groupBy("day").agg(F.count("*").alias("rows"), *aggregates)


def curve_stats(daily: DataFrame, names: list[str], gamma: float = GAMMA) -> DataFrame:
    """(place, point, ann_return, ann_vol, sharpe, ce, abstain_rate, n_days) of each curve of daily_curves(), by one aggregate."""
    aggregates = [F.count("*").alias("n"), F.sum("rows").alias("rows")]
    for n in names:
        aggregates += [F.avg(n).alias(f"{n}__mu"), (F.stddev_samp(n) + 1e-12).alias(f"{n}__sd"), F.avg(utility(F.col(n), gamma)).alias(f"{n}__u"), F.sum(f"{n}__aside").alias(f"{n}__z")]
    row = daily.agg(*aggregates)
    out = [
        F.struct(
            F.lit(i).alias("place"), F.lit(n).alias("point"), (F.col(f"{n}__mu") * YEAR).alias("ann_return"), (F.col(f"{n}__sd") * YEAR**0.5).alias("ann_vol"),
            (F.col(f"{n}__mu") / F.col(f"{n}__sd") * YEAR**0.5).alias("sharpe"), certainty_equivalent(F.col(f"{n}__u"), gamma).alias("ce"), (F.col(f"{n}__z") / F.col("rows")).alias("abstain_rate"), F.col("n").alias("n_days"),
        )
        for i, n in enumerate(names)
    ]
    return row.select(F.explode(F.array(*out)).alias("x")).select("x.*")


def max_drawdown(daily: DataFrame, names: list[str]) -> DataFrame:
    """(point, max_dd): the deepest fall of each curve's wealth below its peak so far."""
    long = daily.unpivot("day", names, "point", "pnl")
    w = W.partitionBy("point").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    wealth = long.withColumn("wealth", F.exp(F.sum(F.log1p("pnl")).over(w)))
    return wealth.withColumn("peak", F.max("wealth").over(w)).groupBy("point").agg(F.min(F.col("wealth") / F.col("peak") - 1).alias("max_dd"))


# Calibration -----------------------------------------------------------------------------


def split_day(panel: DataFrame, share: float = 0.5):
    """The first day of the second part: one value, null for an empty panel."""
    days = panel.select("day").distinct().agg(F.array_sort(F.collect_list("day")).alias("d"))  # one entry a day
    return days.select(F.try_element_at("d", F.floor(F.size("d") * share).cast("int") + 1)).first()[0]


def grid() -> dict[str, tuple[str, dict]]:
    """Points in the order in which the first of equally good ones wins."""
    gated = {f"ac_{i}_{j}": ("ac", {"ac_thr": a, "c_thr": c}) for i, a in enumerate(AC_GRID) for j, c in enumerate(C_GRID)}
    return gated | {f"casc_{i}": ("simple_casc", {"casc_only_thr": t}) for i, t in enumerate(CASCADE_GRID)}


def grid_stats(panel: DataFrame) -> DataFrame:
    """curve_stats() of every point of the grid, with its thresholds, whether it is admitted, and whether it is the chosen one: of the gated
    points that stand aside in 5 to 55 % of rows the one with the best Sharpe ratio, of the cascade points (5 to 50 %) that with the best
    certainty equivalent."""
    points = grid()
    stats = curve_stats(daily_curves(panel, {n: position(*x) for n, x in points.items()}), list(points))
    threshold = lambda key: F.element_at(F.create_map(*(F.lit(v) for n, (_, p) in points.items() for v in (n, float(p.get(key, np.nan))))), F.col("point"))
    gated = F.col("point").startswith("ac_")
    stats = stats.withColumns({k: F.nullif(threshold(k), F.lit(float("nan"))) for k in ("ac_thr", "c_thr", "casc_only_thr")})
    stats = stats.withColumn("admitted", (F.col("abstain_rate") >= 0.05) & (F.col("abstain_rate") <= F.when(gated, 0.55).otherwise(0.5)))
    score = F.when(F.col("admitted"), F.when(gated, F.col("sharpe")).otherwise(F.col("ce")))
    best = F.row_number().over(W.partitionBy(gated).orderBy(score.desc_nulls_last(), "place"))
    return stats.withColumn("chosen", F.col("admitted") & (best == 1))


def calibrate(panel: DataFrame) -> dict[str, float]:
    """Thresholds frozen on this panel; DEFAULTS where no point is admitted."""
    chosen = grid_stats(panel).where("chosen").select("ac_thr", "c_thr", "casc_only_thr").collect()  # two rows at most
    found = dict(DEFAULTS)
    for r in chosen:
        found |= {k: v for k, v in r.asDict().items() if v is not None}
    return found


def evaluate_policies(panel: DataFrame, params: dict) -> DataFrame:
    """curve_stats() and max_dd of every policy with given thresholds."""
    daily = daily_curves(panel, {p: position(p, params) for p in POLICIES})
    return curve_stats(daily, list(POLICIES)).join(max_drawdown(daily, list(POLICIES)), "point")


def conditional_signal_value(panel: DataFrame, value: str = "ac") -> DataFrame:
    """(sample, tercile, n, mean_value, signal_ic, hit_rate, ann_active_ret, outage_rate): what the signal earns in each third of a value, over all
    rows and over those without an outage; samples of fewer than 50 rows are left out."""
    samples = [("all", panel), ("no_outage", panel.where(~F.col("outage").cast("boolean")))]
    out = []
    for name, rows in samples:
        edges = rows.agg(F.count("*").alias("rows"), F.percentile(value, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("edges")).where("rows >= 50")
        label = F.when(F.col(value) <= F.col("edges")[0], "low").when(F.col(value) <= F.col("edges")[1], "mid").otherwise("high")
        active = F.col("signal") != 0
        gain = F.when(active, F.col("signal") * F.col("ret"))
        hit = F.when(active, (F.signum(F.col("signal").cast("double")) == F.signum("ret")).cast("double"))
        out.append(
            rows.join(F.broadcast(edges)).groupBy(F.lit(name).alias("sample"), label.alias("tercile")).agg(
                F.count("*").alias("n"), F.avg(value).alias("mean_value"), F.coalesce(F.avg(gain), F.lit(0.0)).alias("signal_ic"), F.coalesce(F.avg(hit), F.lit(0.0)).alias("hit_rate"),
                F.coalesce(F.avg(gain) * YEAR, F.lit(0.0)).alias("ann_active_ret"), F.avg(F.col("outage").cast("double")).alias("outage_rate"),
            )
        )
    return reduce(DataFrame.unionByName, out)


# Inference -------------------------------------------------------------------------------


def resamples(days: DataFrame, draws: int, block: int, seed: int) -> DataFrame:
    """(draw, place, times): how often each of n places, from 0, stands in each circular block resample. days: (n) in one row. Block k of a draw begins where
    seed, draw and k say; the last one is cut to length."""
    starts = days.sparkSession.range(draws).select(F.col("id").alias("draw")).join(F.broadcast(days.where("n > 0")))
    length = F.least(F.lit(block), F.col("n"))
    starts = starts.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / length))))
    starts = starts.withColumn("start", keyed(seed, F.col("draw"), F.col("k")) % F.col("n"))
    steps = F.sequence(F.lit(0).cast("long"), F.least(length, F.col("n") - F.col("k") * length) - 1)
    taken = starts.select("draw", "start", "n", F.explode(steps).alias("step"))
    return taken.select("draw", ((F.col("start") + F.col("step")) % F.col("n")).alias("place")).groupBy("draw", "place").agg(F.count("*").alias("times"))


def reality_check(curves: DataFrame, benchmark: str, draws: int = 999, block: int = 5, seed: int = 20260803, gamma: float = GAMMA) -> DataFrame:
    """(strategy, delta, best, max_delta, p_value, n_days): of curves (day, strategy, pnl), how far each strategy's certainty equivalent is above the
    benchmark's, and whether the largest distance is more than chance.

    All strategies of a draw are resampled by the same places, so their dependence stays; the statistic is the largest of their
    recentred distances. Days that a strategy lacks are left out for all. Draws, places and strategies are joined by equi-joins on one
    row a day, and summed before they are shuffled.
    """
    curves = curves.where("pnl IS NOT NULL").dropDuplicates(["day", "strategy"])
    number = curves.agg(F.count_distinct("strategy").alias("all"))
    common = curves.groupBy("day").agg(F.count("*").alias("there")).join(F.broadcast(number)).where(F.col("there") == F.col("all"))
    placed = common.select("day", (F.row_number().over(W.orderBy("day")) - 1).cast("long").alias("place"))  # one row a day
    at = curves.join(placed, "day").select("place", "strategy", utility(F.col("pnl"), gamma).alias("u"))
    days = placed.agg(F.count("*").alias("n"))
    of_draws = (
        resamples(days, draws, block, seed).join(at, "place").groupBy("draw", "strategy")
        .agg((F.sum(F.col("u") * F.col("times")) / F.sum("times")).alias("u"))
    )
    real = at.groupBy("strategy").agg(F.avg("u").alias("u"))

    def distances(rows: DataFrame, keys: list[str]) -> DataFrame:
        ce = certainty_equivalent(F.col("u"), gamma)
        base = rows.where(F.col("strategy") == benchmark).select(*keys, ce.alias("base"))
        others = rows.where(F.col("strategy") != benchmark).select(*keys, "strategy", ce.alias("ce"))
        joined = others.join(base, keys) if keys else others.join(F.broadcast(base))
        return joined.select(*keys, "strategy", (F.col("ce") - F.col("base")).alias("delta"))

    deltas = distances(real, [])
    most = deltas.agg(F.max("delta").alias("max_delta"), F.max_by("strategy", F.struct("delta", "strategy")).alias("top"))
    drawn = distances(of_draws, ["draw"]).join(F.broadcast(deltas.select("strategy", F.col("delta").alias("seen"))), "strategy")
    highest = drawn.groupBy("draw").agg(F.max(F.col("delta") - F.col("seen")).alias("m"))
    chance = highest.join(F.broadcast(most)).agg(((F.count_if(F.col("m") >= F.col("max_delta")) + 1) / (F.count("*") + 1)).alias("p_value"))
    return deltas.join(F.broadcast(most)).join(F.broadcast(chance)).join(F.broadcast(days)).select(
        "strategy", "delta", (F.col("strategy") == F.col("top")).alias("best"), "max_delta", "p_value", F.col("n").alias("n_days")
    )


# Placebos --------------------------------------------------------------------------------


def permute(rows: DataFrame, keys: list[str], place: str, values: list[str], seed: int = 17) -> DataFrame:
    """rows (keys, place, values, others) with the values of another place of the same group: a permutation that seed, keys and place decide. Rows are ranked by
    a keyed hash and, apart, by place, and joined by rank, so each group is two sorts. A place occurs once in a group."""
    chance = keyed(seed, *(F.col(k) for k in keys), F.col(place))
    spot = lambda order: F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    given = rows.select(*keys, *(F.col(v).alias(f"_{v}") for v in values), spot([chance, F.col(place)]).alias("_spot"))
    own = rows.drop(*values).withColumn("_spot", spot([F.col(place)]))
    same = reduce(lambda a, b: a & b, [own[k].eqNullSafe(given[k]) for k in keys], own["_spot"] == given["_spot"])
    kept = [own[c] for c in rows.columns if c not in values]
    return own.join(given, same).select(*kept, *(F.col(f"_{v}").alias(v) for v in values))


def scramble_days(panel: DataFrame, values: list[str], seed: int = 17) -> DataFrame:
    """The panel with the mean values of another day: marginals stay, timing goes."""
    of_day = panel.groupBy("day").agg(*(F.avg(v).alias(v) for v in values)).withColumn("_one", F.lit(1))
    mixed = permute(of_day, ["_one"], "day", values, seed).drop("_one")
    return panel.drop(*values).join(mixed, "day")


def plant_shocks(panel: DataFrame, columns: dict[str, Column], rate: float = 0.05, seed: int = 42) -> DataFrame:
    """The panel with planted_shock, and on shocked days the given columns' values instead: a share ``rate`` of all days, one at least, those with
    the smallest keyed hashes."""
    days = panel.select("day").distinct().withColumn("_rank", F.row_number().over(W.orderBy(keyed(seed, F.col("day")), "day")))  # one row a day
    number = days.agg(F.greatest(F.lit(1), F.bround(F.count("*") * F.lit(rate)).cast("int")).alias("_n"))
    hit = days.join(F.broadcast(number)).where("_rank <= _n").select("day", F.lit(1).alias("planted_shock"))
    out = panel.join(hit, "day", "left").withColumn("planted_shock", F.coalesce("planted_shock", F.lit(0)))
    return out.withColumns({c: F.when(F.col("planted_shock") == 1, x).otherwise(F.col(c)) for c, x in columns.items()})


# Least squares ---------------------------------------------------------------------------


def least_squares(rows: DataFrame, features: list[str], target: str) -> np.ndarray:
    """Coefficients, the constant first, from sums of products, which the tasks add up; of several solutions the shortest."""
    x = [F.lit(1.0), *(F.col(f).cast("double") for f in features)]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    row = rows.agg(*(F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i, j in pairs), *(F.sum(v * F.col(target)).alias(f"b{i}") for i, v in enumerate(x))).first()
    gram, right = np.zeros((len(x), len(x))), np.array([row[f"b{i}"] for i in range(len(x))], float)
    for i, j in pairs:
        gram[i, j] = gram[j, i] = row[f"g{i}_{j}"]
    return np.linalg.lstsq(gram, right, rcond=None)[0]


def compilation_bridge(panel: DataFrame, compiled: list[str], thin: list[str], cut) -> DataFrame:
    """(features, r2, ann_mean, sharpe, ce, sign_hit, n_rows): fitted before ``cut`` on the next day's return, judged from it on by how much it explains and by
    what its sign earns. Fewer than 50 rows on a side give no rows."""
    ahead = panel.withColumn("y", F.lead("ret").over(W.partitionBy("asset").orderBy("day"))).dropna(subset=["y", *compiled])
    train, test = ahead.where(F.col("day") < F.lit(cut)), ahead.where(F.col("day") >= F.lit(cut))
    out = []
    for name, features in (("compiled", compiled), ("thin", thin)):
        beta = least_squares(train, features, "y")
        predicted = reduce(lambda a, b: a + b, [F.lit(float(beta[0])), *(F.col(f) * float(b) for f, b in zip(features, beta[1:], strict=True))])
        judged = test.withColumn("p", predicted).withColumn("pos", F.signum("p"))
        whole = judged.agg(
            F.count("*").alias("n_rows"), F.sum(F.pow(F.col("y") - F.col("p"), 2)).alias("rest"), (F.var_pop("y") * F.count("y")).alias("all"),
            F.avg(F.when(F.col("pos") != 0, (F.signum("y") == F.col("pos")).cast("double"))).alias("sign_hit"),
        )
        daily = judged.groupBy("day").agg(F.avg(F.col("pos") * F.col("y")).alias("pnl")).agg(F.avg("pnl").alias("mu"), F.stddev_samp("pnl").alias("sd"), F.avg(utility(F.col("pnl"), 2)).alias("u"))
        out.append(
            whole.join(F.broadcast(daily)).select(
                F.lit(name).alias("features"), F.coalesce(1 - F.try_divide("rest", "all"), F.lit(0.0)).alias("r2"), (F.col("mu") * YEAR).alias("ann_mean"),
                F.coalesce(F.try_divide("mu", "sd") * YEAR**0.5, F.lit(0.0)).alias("sharpe"), certainty_equivalent(F.col("u"), 2).alias("ce"), F.coalesce("sign_hit", F.lit(0.0)).alias("sign_hit"), "n_rows",
            )
        )
    enough = train.limit(50).count() == 50
    return reduce(DataFrame.unionByName, out).where(F.lit(enough) & (F.col("n_rows") >= 50))
