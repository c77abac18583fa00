"""Vintages, readiness of bands and expanding quantiles against plain loops."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import pointintime as pit

DAY = datetime(2026, 1, 1)


def at(days, **kw):
    return DAY + timedelta(days=days, **kw)


def test_revisions_and_late_rows_do_not_show(spark):
    rows = [("a", at(1), at(2), 1, 10.0), ("a", at(1), at(5), 2, 11.0), ("a", at(3), at(4), 3, 30.0), ("a", at(2), at(6), 4, 20.0), ("a", at(8), None, 5, 80.0), ("b", at(1), at(9), 6, 1.0), ("a", None, at(1), 7, 99.0), ("a", at(3), at(4), 8, 31.0)]
    vintages = spark.createDataFrame(rows, "k string, observed timestamp_ntz, available timestamp_ntz, id long, v double")
    moments = spark.createDataFrame([("a", at(d)) for d in range(1, 10)] + [("b", at(8)), ("b", at(9)), ("c", at(9))], "k string, at timestamp_ntz")
    got = {(r.k, r.at): r.v for r in pit.known_by(moments, vintages, ["k"], ["v"], "id").collect()}
    for (k, t), v in got.items():
        known = [r for r in rows if r[0] == k and r[1] and (r[2] or r[1]) <= t]
        assert v == (max(known, key=lambda r: (r[1], r[2] or r[1], r[3]))[4] if known else None)
    # At day 5 the first value of day 1 is revised, but day 3 is already known.
    assert [got["a", at(d)] for d in (1, 2, 3, 4, 5, 6, 8)] == [None, 10.0, 10.0, 31.0, 31.0, 31.0, 80.0]


def test_band_readiness(spark):
    bands = [("exchange", "BTC", at(10), None, 1), ("exchange", "ETH", at(4), None, 2), ("macro", None, at(1), at(9, hours=1), 3), ("news", None, at(3), None, 4), ("options", None, at(12), None, 5)]
    df = spark.createDataFrame(bands, "band string, symbol string, observed timestamp_ntz, available timestamp_ntz, id long")
    got = {r.symbol: r for r in pit.band_readiness(spark.createDataFrame([("BTC", at(11)), ("ETH", at(11)), ("XRP", at(11))], "symbol string, at timestamp_ntz"), df, "id").collect()}
    assert [got[s].st_exchange for s in ("BTC", "ETH", "XRP")] == ["ready", "missing", "missing"]
    b = got["BTC"]
    assert (b.st_macro, b.st_news, b.st_options, b.st_onchain) == ("ready", "limited", "missing", "missing")
    assert b.readiness_score == pytest.approx(0.30 + 0.05 + 0.075) and (b.n_ready, b.n_limited) == (2, 1)


def test_world(spark):
    ready = {f"st_{b}": "ready" for b in pit.BAND_WEIGHTS}
    rows = spark.createDataFrame([tuple(ready.values()), tuple((ready | {"st_news": "limited", "st_macro": None}).values())], ", ".join(f"{c} string" for c in ready))
    full, part = pit.world(rows).collect()
    assert (full.b_hier, full.u, full.h, full.wmi) == (pytest.approx(1), 1, 1, 1.0)
    asset = sum(w * (0.5 if n == "news" else 0 if n == "macro" else 1) for n, w in pit.BAND_WEIGHTS.items())
    b = 0.25 * 6.5 / 8 + 0.35 * 5.5 / 7 + 0.4 * asset
    assert part.b_hier == pytest.approx(b) and part.u == pytest.approx(6.7 / 8) and part.h == pytest.approx(np.exp(-2 / 16) * (1 - 0.5 * 0.25)) and part.wmi == pytest.approx(b * 6.7 / 8, abs=1e-4)
    assert pit.world(rows, "exchange").first().b_hier < 1 and pit.world(rows, thin=True).first().u == 1 / 8


@pytest.mark.parametrize(("chunk", "q"), [(7, 0.2), (16, 0.5), (64, 0.9), (5, 0.0), (9, 1.0)])
def test_expanding_quantile(spark, chunk, q):
    rng = np.random.default_rng(chunk)
    rows = []
    for k, n in (("a", 150), ("b", 33), ("c", 1), (None, 20)):
        trend = np.linspace(0, 5, n) if k == "a" else np.zeros(n)
        values = np.round(rng.normal(size=n) + trend, 1)
        rows += [(k, i * 3, None if rng.random() < 0.1 else float("nan") if rng.random() < 0.05 else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, t long, x double")
    df = df.where("k IS NOT NULL")
    got = {(r.k, r.t): r.threshold for r in pit.expanding_quantile(df.repartition(3), ["k"], ["t"], "x", q, least=4, chunk=chunk).collect()}
    assert len(got) == 184
    for k in "abc":
        series = [np.nan if x is None else x for kk, _, x in rows if kk == k]
        for i in range(len(series)):
            before = np.array(series[:i])
            if i < 4 or np.isnan(before).all():
                assert got[k, 3 * i] is None
            else:
                assert got[k, 3 * i] == pytest.approx(np.nanquantile(before, q)), (k, i)


def test_a_task_gets_few_earlier_values(spark, monkeypatch):
    real = pit._walk

    def spied(q, least):
        inner = real(q, least)
        return lambda rows, near: inner(rows, near).assign(threshold=float(len(near)))

    monkeypatch.setattr(pit, "_walk", spied)
    df = spark.range(3000).withColumns({"k": F.lit("a"), "x": F.pmod(F.xxhash64("id"), F.lit(100_000)).cast("double")})
    most = pit.expanding_quantile(df, ["k"], ["id"], "x", 0.3, chunk=100).agg(F.max("threshold")).first()[0]
    assert most <= 500
