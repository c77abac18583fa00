"""Segments stitched by a plain fold over their rows."""

from __future__ import annotations

from statistics import median

import numpy as np
import pytest

from quantloom.operators import stitching


def folded(segments):
    """{day: (value, scale)} by taking one segment after the other into what is stitched so far."""
    done = {}
    for i, rows in enumerate(segments):
        shared = sorted(set(done) & set(rows))
        ratios = [done[d][0] / rows[d] for d in shared if done[d][0] > 0 and rows[d] > 0]
        high = max((done[d][0] for d in shared), default=0), max((rows[d] for d in shared), default=0)
        scale = 1.0 if not i else median(ratios) if ratios else high[0] / high[1] if min(high) > 0 else 1.0
        done |= {d: (v * scale, scale, len(shared)) for d, v in rows.items() if d not in done}
    return done


def test_stitch(spark):
    rng = np.random.default_rng(8)
    table, want = [], {}
    for key in "abc":
        segments = []
        for k in range(6):
            start = 100 - 15 * k
            rows = {d: float(np.round(rng.random() * 100 + 1, 2)) for d in range(start, start + 20) if rng.random() < 0.9}
            if key == "b" and k == 2:
                rows = {d: 0.0 for d in rows}
            if key == "c" and k == 3:
                rows = {d: v for d, v in rows.items() if d < start + 15}
            segments.append(rows)
            table += [(key, k * 10, d, v) for d, v in rows.items()]
        want |= {(key, d): x for d, x in folded(segments).items()}
    df = spark.createDataFrame(table, "key string, segment int, day int, value double").repartition(3)
    got = {(r.key, r.day): (r.value, r.rescale_factor, r.overlap) for r in stitching.stitch(df, ["key"]).collect()}
    assert got.keys() == want.keys()
    for k in got:
        assert got[k] == pytest.approx(want[k], rel=1e-9), k
    assert stitching.stitch(df.limit(0), ["key"]).count() == 0


def test_segments_that_are_no_neighbours_are_refused(spark):
    df = spark.createDataFrame([("a", 1, 5, 1.0), ("a", 2, 9, 1.0), ("a", 3, 5, 1.0)], "key string, segment int, day int, value double")
    with pytest.raises(Exception, match="no neighbours"):
        stitching.stitch(df, ["key"]).collect()
