"""Edge cases of the operators on event time, flow, inference and streams."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd

from quantloom.functions import scores
from quantloom.operators import backtest, bars, cross, flow, temporal
from quantloom.streaming import jobs


def at(minute: int) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_asof_directions_and_tolerance(spark):
    left = spark.createDataFrame([("a", at(10), 1), ("a", at(5), 2), ("b", at(1), 3), ("a", at(0), 4)], "k string, ts timestamp_ntz, id long")
    right = spark.createDataFrame([("a", at(4), 40.0, 1), ("a", at(10), 100.0, 2), ("a", at(10), 101.0, 3), ("a", at(12), 120.0, 4), ("b", at(9), 9.0, 5)], "k string, ts timestamp_ntz, v double, rid long")
    get = lambda **k: {r.id: r.v for r in temporal.as_of(left, right, ["k"], "ts", ["v"], tiebreak="rid", **k).collect()}
    assert get() == {1: 101.0, 2: 40.0, 3: None, 4: None}
    assert get(direction="forward") == {1: 101.0, 2: 101.0, 3: 9.0, 4: 40.0}
    assert get(direction="nearest") == {1: 101.0, 2: 40.0, 3: 9.0, 4: 40.0}
    assert get(direction="nearest", tolerance=240) == {1: 101.0, 2: 40.0, 3: None, 4: 40.0}
    assert get(tolerance=59) == {1: 101.0, 2: None, 3: None, 4: None}
    assert temporal.as_of(left, right.limit(0), ["k"], "ts", ["v"], tiebreak="rid").where("v is null").count() == 4


def test_latest_and_carry_in(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 3, 2), ("a", 3, 5), ("b", 2, 3)], "k string, t int, id long")
    assert {tuple(r) for r in temporal.latest(df, ["k"], "t", "id").collect()} == {("a", 3, 5), ("b", 2, 3)}
    assert temporal.with_carry_in(df, ["k"], "t", 3, "id").count() == 4
    assert temporal.latest(df.limit(0), ["k"], "t").count() == 0


def test_vpin_splits_trades(spark):
    t = spark.createDataFrame([("a", at(0), 1, 30.0, "buy"), ("a", at(1), 2, 90.0, "sell"), ("a", at(2), 3, 10.0, "buy")], "symbol string, ts timestamp_ntz, event_id long, amount double, side string")
    r = flow.vpin(t).first()
    assert r.buckets == 2 and abs(r.vpin - (10 / 50 + 50 / 50) / 2) < 1e-12


def test_liquidation_bins_are_open_above(spark):
    p = spark.createDataFrame([("a", "long", float(x), 10.0, 2.0) for x in (100, 150, 200)] + [("a", "short", 70.0, 5.0, 1.0)], "symbol string, direction string, liquidation_price double, size_usd double, leverage double")
    got = {(r.direction, r.bin): r.positions for r in flow.liquidation_clusters(p, __import__("pyspark.sql.functions", fromlist=["x"]).lit(100.0), 5).collect()}
    assert got == {("long", 0): 1, ("long", 2): 1, ("short", 0): 1}


def test_scores_at_their_limits(spark):
    one = lambda e: spark.range(1).selectExpr(f"{e} AS x").first().x
    assert [one(scores.standard_regime(z)) for z in ("2", "1", "-1", "-2", "-2.1", "cast(null as double)")] == ["extreme_high", "elevated", "normal", "depressed", "extreme_low", "unknown"]
    assert [one(scores.depth_regime(*x)) for x in (("1", "2", "0"), ("2e5", "2e5", "0"), ("5e5", "5e5", "0.41"), ("5e5", "5e5", "0.4"))] == ["vacuum", "thin", "asymmetric", "thick"]
    assert one(scores.liquidity_score("5", "5e6", "5e6")) == 0.3 * 90 + 40 + 30
    assert one(scores.cascade_probability("1", "0", "1")) == 0
    assert abs(one(scores.price_impact("4.0", "9")) - 12) < 1e-12
    assert one(scores.contrarian_strength("60", "65")) == 0


def test_bootstrap(spark):
    rng = np.random.default_rng(0)
    noise = rng.normal(0, 0.01, 120)
    days = pd.date_range("2024-01-01", periods=120).date
    strong = spark.createDataFrame(pd.DataFrame({"day": days, "a": noise + 0.01, "b": noise * 0.5}))
    r = backtest.bootstrap_difference(strong, draws=300).first()
    assert r.p_value < 0.05 or r.low > 0
    same = backtest.bootstrap_difference(spark.createDataFrame(pd.DataFrame({"day": days, "a": noise, "b": noise})), draws=100, stationary=True).first()
    assert same.delta == 0 and same.p_value > 0.5
    assert backtest.bootstrap_difference(strong.limit(5), draws=10).first().p_value is None
    assert set(backtest.block_indices(10, 3, rng)) <= set(range(10)) and len(backtest.block_indices(10, 4, rng, True)) == 10


def test_correlation_of_constant_is_zero(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(5)] + [("b", i, 1.0) for i in range(5)], "symbol string, open_time int, close double")
    assert {(r.a, r.b): round(r["corr"], 9) for r in cross.correlation_matrix(df).collect()} == {("a", "a"): 1.0, ("a", "b"): 0.0, ("b", "a"): 0.0, ("b", "b"): 0.0}


def test_densify_and_merge(spark):
    d = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.0), ("a", dt.date(2024, 1, 4), 4.0)], "k string, day date, v double")
    assert [r.v for r in temporal.densify(d, ["k"], "day", "v").orderBy("day").collect()] == [1.0, 1.0, 1.0, 4.0]
    b = spark.createDataFrame([("s", "1h", at(0), v, 1.0, 2.0, 0.5, c, q) for v, c, q in (("x", 1.0, 0.0), ("y", 3.0, 0.0), ("z", None, 1.0))], "symbol string, timeframe string, open_time timestamp_ntz, venue string, open double, high double, low double, close double, volume double")
    r = bars.merge_venues(b).first()
    assert r.close == 2.0 and r.exchange_count == 2 and r.source_exchanges == "x,y"


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, s string, v double")
    new = spark.createDataFrame([(2, None, 3.0), (3, "c", None), (3, "d", None)], "k int, s string, v double")
    got = {r.k: (r.s, r.v, r.changed) for r in temporal.coalesce_upsert(old, new.where("s is null or s = 'c'"), ["k"], ["s", "v"]).collect()}
    assert got == {1: ("a", 1.0, False), 2: ("b", 3.0, True), 3: ("c", None, True)}
    assert temporal.first_wins(old, new, ["k"]).count() == 3


def test_stream_matches_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"symbol": rng.choice(["a", "b"], 400), "ts": pd.to_datetime("2024-01-01") + pd.to_timedelta(np.arange(400) * 20, "s"), "event_id": np.arange(400), "price": rng.random(400), "amount": 1.0})
    for i, part in enumerate(np.array_split(rows, 4)):
        spark.createDataFrame(part).coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
    source = jobs.read_events(spark, f"{tmp_path}/in/*", spark.createDataFrame(rows).schema)
    job = jobs.tumbling_bars(source).writeStream.format("memory").queryName("bars_test").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    job.awaitTermination()
    got = spark.table("bars_test").toPandas().sort_values(["symbol", "open_time"]).reset_index(drop=True)
    want = rows.assign(open_time=rows.ts.dt.floor("5min")).groupby(["symbol", "open_time"]).agg(open=("price", "first"), high=("price", "max"), low=("price", "min"), close=("price", "last"), trades=("price", "size")).reset_index()
    for c in ("open", "high", "low", "close", "trades"):
        np.testing.assert_allclose(got[c], want[c])


def test_upsert_sink_is_repeatable(spark, tmp_path):
    write = jobs.upsert_sink(str(tmp_path / "t"), ["k"], "t")
    first = spark.createDataFrame([("a", 1, 1.0), ("b", 5, 2.0)], "k string, t int, v double")
    second = spark.createDataFrame([("a", 3, 9.0), ("b", 4, 0.0)], "k string, t int, v double")
    write(first, 0)
    write(second, 1)
    write(second, 1)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "t" / "v=1")).collect()} == {("a", 3, 9.0), ("b", 5, 2.0)}
