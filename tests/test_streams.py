"""Streams over several batches against plain loops over all rows."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.streaming import jobs

START = datetime(2026, 1, 1)


@pytest.fixture
def streamed(spark, tmp_path):
    """A stream of batches, a file each."""

    def run(batches, schema):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))

    return run


def test_anomalies_keep_their_moments_between_batches(streamed):
    rng = np.random.default_rng(3)
    batches, whole = [], {"a": [], "b": []}
    for b in range(4):
        rows = []
        for key in "ab":
            for call in range(b * 3, b * 3 + 3):
                size = 2 if (key, call) == ("a", 10) else 30
                values = rng.normal(5 if key == "a" else -2, 1, size)
                if call in (5, 11):
                    values[0] += 9
                    values[1] = (5 if key == "a" else -2) + 3.8
                whole[key].append((call, values))
                rows += [(key, call, i, float(v)) for i, v in enumerate(values)]
        batches.append([rows[i] for i in rng.permutation(len(rows))])
    got = jobs.run_to_end(jobs.anomalies(streamed(batches, "key string, call long, at long, value double")), "append").collect()
    want = []
    for key, calls in whole.items():
        seen, rate = np.zeros(0), None
        for call, values in calls:
            if len(seen) > 10:
                want += [(key, call, "zscore", "critical" if z >= 4.5 else "warning", v) for v, z in zip(values, np.abs(values - seen.mean()) / seen.std(), strict=True) if z >= 3]
            if rate and len(values) < 0.2 * rate:
                want.append((key, call, "volume_drop", "critical", float(len(values))))
            rate = len(values) if rate is None else 0.9 * rate + 0.1 * len(values)
            seen = np.concatenate([seen, values])
    assert sorted(r[:5] for r in map(tuple, got)) == sorted(want)
    assert {w[2] for w in want} == {"zscore", "volume_drop"} and {w[3] for w in want} == {"warning", "critical"}


def test_windows_and_sessions_over_batches(streamed):
    at = lambda m: START + timedelta(minutes=m)
    rows = [[("u", at(0), 1), ("u", at(7), 2), ("v", at(3), 3)], [("u", at(20), 4), ("v", at(8), 5), ("u", at(4), 6)], [("u", at(90), 7), ("v", at(36), 8)]]
    stream = streamed(rows, "user_id string, ts timestamp, event_id long")
    bars = stream.select(F.col("user_id").alias("symbol"), "ts", "event_id", F.col("event_id").cast("double").alias("price"), F.lit(1.0).alias("amount"))
    got = {(r.symbol, r.open_time): (r.open, r.close, r.trades) for r in jobs.run_to_end(jobs.tumbling_bars(bars, "10 minutes", "1 day"), "update", ["symbol", "open_time"]).collect()}
    assert got == {("u", at(0)): (1, 2, 3), ("u", at(20)): (4, 4, 1), ("u", at(90)): (7, 7, 1), ("v", at(0)): (3, 5, 2), ("v", at(30)): (8, 8, 1)}
    assert sorted((r.user_id, r.events) for r in jobs.run_to_end(jobs.sessions(stream, late="1 day"), "complete").collect()) == [("u", 1), ("u", 4), ("v", 3)]


def test_an_empty_stream_and_a_repeated_batch(spark, streamed, tmp_path):
    assert jobs.run_to_end(streamed([], "user_id string, ts timestamp"), "append").count() == 0
    write = jobs.changes_sink(str(tmp_path / "t"))
    for _ in range(2):
        write(spark.createDataFrame([(1,)], "k int"), 0)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_null_spikes(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", None, None), ("b", 1, None), ("a", 1, None), ("b", 2, 3)], "k string, x int, y int")
    assert sorted((r.k, r.column, r.nulls, r.severity) for r in jobs.null_spikes(df, ["k"], ["x", "y"]).collect()) == [("a", "x", 2, "warning"), ("a", "y", 2, "warning")]
    assert jobs.null_spikes(df.where("y IS NULL"), ["k"], ["y"]).first().severity == "critical"
