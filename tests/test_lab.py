"""The research lab against plain loops."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import lab


def chance(seed, *parts):
    return int(hashlib.md5(":".join(map(str, (seed, *parts))).encode()).hexdigest()[:15], 16)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    n, assets = 90, 4
    rows = pd.DataFrame({
        "asset": np.tile(np.arange(assets), n), "day": np.repeat(np.arange(n), assets), "ret": rng.normal(0, 0.02, n * assets), "signal": rng.choice([-1.0, 0.0, 1.0], n * assets, p=[0.45, 0.1, 0.45]), "mom5": rng.integers(-1, 2, n * assets).astype(float),
        "outage": np.repeat(rng.random(n) < 0.1, assets), "cascade_p": rng.random(n * assets), "wmi": rng.random(n * assets), "ac": 0.2 + 0.8 * rng.random(n * assets), "c": 0.2 + 0.8 * rng.random(n * assets),
    })
    return rows, spark.createDataFrame(rows)


def ce(x, gamma=2.0):
    w = np.maximum(1 + np.asarray(x), 1e-8)
    return (np.exp(np.log(w).mean()) - 1 if gamma == 1 else (w ** (1 - gamma)).mean() ** (1 / (1 - gamma)) - 1) * 365


def test_directional_signal(spark):
    cases = [
        (("crisis", 0.65, 1.0, None, None), -1), (("crisis", 0.1, 1.0, None, None), 1), (("range", 0.65, 1.0, None, None), 1), (("trend", 0.2, 1.0, 0.0, None), 1), (("trend", 0.2, 1.0, -1.0, None), 1), (("trend", 0.2, 1.0, -1.0, -1.0), 0),
        (("range", 0.2, 0.0, 1.0, 1.0), 1), (("range", 0.2, 0.0, -1.0, 0.0), -1), (("range", 0.2, -1.0, None, None), -1), (("range", 0.2, 0.0, None, None), 0), (("range", 0.2, -1.0, 1.0, 1.0), -1),
    ]
    df = spark.createDataFrame([(i, *x) for i, (x, _) in enumerate(cases)], "i int, regime string, casc double, mom double, macro double, alt double")
    got = df.select("i", lab.directional_signal(*(F.col(c) for c in ("regime", "casc", "mom", "macro", "alt"))).alias("s")).collect()
    assert [r.s for r in sorted(got)] == [w for _, w in cases]


def test_grid_and_policies(panel):
    rows, df = panel
    got = {r.point: r for r in lab.grid_stats(df).collect()}
    assert len(got) == 29 and sum(r.chosen for r in got.values()) == 2
    best = {}
    for name, (policy, p) in lab.grid().items():
        aside = (rows.ac < p["ac_thr"]) | (rows.c < p["c_thr"]) if policy == "ac" else rows.cascade_p >= p["casc_only_thr"]
        pos = np.where(aside, 0, rows.signal)
        daily = (pos * rows.ret).groupby(rows.day).mean()
        r = got[name]
        assert (r.abstain_rate, r.ce, r.n_days) == (pytest.approx((pos == 0).mean()), pytest.approx(ce(daily)), 90)
        assert r.sharpe == pytest.approx(daily.mean() / (daily.std() + 1e-12) * 365**0.5)
        if r.admitted:
            score = r.sharpe if policy == "ac" else r.ce
            best[policy] = max(best.get(policy, (-9e9, "")), (score, name), key=lambda x: x[0])
    assert {n for n, r in got.items() if r.chosen} == {n for _, n in best.values()}
    found = lab.evaluate_policies(df, lab.calibrate(df)).collect()
    long = rows.ret.groupby(rows.day).mean()
    wealth = (1 + long).cumprod()
    assert {r.point: r.max_dd for r in found}["always_long"] == pytest.approx((wealth / wealth.cummax() - 1).min())
    assert lab.calibrate(df.where("day < 0")) == lab.DEFAULTS and lab.split_day(df) == 45 and lab.split_day(df.limit(0)) is None


def test_costs_are_paid_on_changes(panel):
    rows, df = panel
    got = {r.day: r.p for r in lab.daily_curves(df, {"p": F.col("signal")}, 25.0).collect()}
    turn = rows.sort_values("day").groupby("asset").signal.diff().abs().fillna(rows.signal.abs())
    want = (rows.signal * rows.ret - 0.0025 * turn).groupby(rows.day).mean()
    assert got == pytest.approx(want.to_dict())


@pytest.mark.parametrize("gamma", [1.0, 2.0])
def test_reality_check(spark, gamma):
    rng = np.random.default_rng(2)
    n, draws, block, seed = 60, 80, 7, 11
    curves = {"base": rng.normal(0, 0.01, n), "x": rng.normal(0.002, 0.01, n), "y": rng.normal(0, 0.02, n), "z": rng.normal(0.001, 0.01, n)}
    rows = [(d, s, float(v)) for s, c in curves.items() for d, v in enumerate(c)] + [(n + 1, "x", 0.5), (n + 2, "base", 0.1)]
    got = {r.strategy: r for r in lab.reality_check(spark.createDataFrame(rows, "day int, strategy string, pnl double"), "base", draws, block, seed, gamma).collect()}
    deltas = {k: ce(curves[k], gamma) - ce(curves["base"], gamma) for k in "xyz"}
    beyond = 0
    for b in range(draws):
        places = [(chance(seed, b, i // block) % n + i % block) % n for i in range(n)]
        beyond += max(ce(curves[k][places], gamma) - ce(curves["base"][places], gamma) - deltas[k] for k in "xyz") >= max(deltas.values())
    assert {k: r.delta for k, r in got.items()} == pytest.approx(deltas)
    assert all(r.p_value == pytest.approx((beyond + 1) / (draws + 1)) and r.n_days == n for r in got.values())
    assert [k for k, r in got.items() if r.best] == [max(deltas, key=deltas.get)]


def test_a_permutation_stays_in_its_group(spark):
    rows = [(g, i, i * 10, f"{g}{i}") for g in ("a", "b", None) for i in range(50 if g == "a" else 3)]
    df = spark.createDataFrame(rows, "g string, i int, v int, name string")
    got = lab.permute(df, ["g"], "i", ["v"], 3).collect()
    assert len(got) == len(rows) and all(r.name == f"{r.g}{r.i}" for r in got)
    for g in ("a", "b", None):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.i)
        assert sorted(r.v for r in own) == [10 * i for i in range(len(own))]
    assert sum(r.v == r.i * 10 for r in got if r.g == "a") < 10
    assert got and sorted(map(str, got)) == sorted(map(str, lab.permute(df.repartition(5), ["g"], "i", ["v"], 3).collect()))


def test_planted_shocks(panel):
    _, df = panel
    got = lab.plant_shocks(df, {"wmi": F.lit(0.0)}, 0.05, 42).toPandas()
    days = sorted(range(90), key=lambda d: (chance(42, d), d))[:4]
    assert set(got[got.planted_shock == 1].day) == set(days) and (got[got.planted_shock == 1].wmi == 0).all() and (got[got.planted_shock == 0].wmi > 0).all()
    assert lab.plant_shocks(df.where("day = 1"), {}, 0.01).where("planted_shock = 1").count() == 4


def test_least_squares_and_bridge(panel):
    rows, df = panel
    x = rows[["mom5", "ac", "wmi"]].to_numpy()
    want = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), rows.ret, rcond=None)[0]
    assert lab.least_squares(df, ["mom5", "ac", "wmi"], "ret") == pytest.approx(want)
    assert lab.least_squares(df.withColumn("twice", F.col("ac") * 2), ["ac", "twice"], "ret") == pytest.approx(np.linalg.lstsq(np.column_stack([np.ones(len(x)), rows.ac, 2 * rows.ac]), rows.ret, rcond=None)[0])
    p = rows.sort_values(["asset", "day"]).assign(y=lambda t: t.groupby("asset").ret.shift(-1)).dropna()
    train, test = p[p.day < 45], p[p.day >= 45]
    got = {r.features: r for r in lab.compilation_bridge(df, ["mom5", "ac", "wmi"], ["mom5"], 45).collect()}
    for name, features in (("compiled", ["mom5", "ac", "wmi"]), ("thin", ["mom5"])):
        beta = np.linalg.lstsq(np.column_stack([np.ones(len(train)), train[features]]), train.y, rcond=None)[0]
        pred = np.column_stack([np.ones(len(test)), test[features]]) @ beta
        daily = (np.sign(pred) * test.y).groupby(test.day).mean()
        r = got[name]
        assert r.r2 == pytest.approx(1 - ((test.y - pred) ** 2).sum() / ((test.y - test.y.mean()) ** 2).sum()) and r.sign_hit == pytest.approx((np.sign(test.y) == np.sign(pred)).mean())
        assert r.ce == pytest.approx(ce(daily)) and r.n_rows == len(test)
    assert lab.compilation_bridge(df, ["mom5"], ["mom5"], 5).count() == 0
