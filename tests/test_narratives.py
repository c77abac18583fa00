"""Narratives against the plain loop over all pairs of topics."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from quantloom.operators import narratives


def plain(words):
    """Every free topic passes over all others in order."""
    free, out = [True] * len(words), []
    for i, own in enumerate(words):
        if free[i]:
            own, members, free[i] = set(own), [i], False
            for j, other in enumerate(words):
                if free[j] and len(own & other) >= max(1, len(own) // 3):
                    members.append(j)
                    free[j] = False
                    own |= other
            out.append(members)
    return out


def test_absorb():
    rng = np.random.default_rng(6)
    for n in (0, 1, 5, 40, 120):
        for kinds in (6, 40, 400):
            words = [{f"w{x}" for x in rng.integers(0, kinds, rng.integers(0, 7))} for _ in range(n)]
            assert narratives.absorb(words) == plain(words)


def test_clusters(spark):
    rows = [("a", 3, "t3", ["x", "y"], 1, 0.5), ("a", 1, "t1", ["x"], 2, None), ("a", 2, "t2", ["z"], None, 1.0), ("a", 4, "t4", None, 4, 0.0), ("b", 1, "t1", ["x"], 5, 0.25), (None, 1, "n", ["q", "q"], 1, 1.0)]
    got = narratives.cluster_narratives(spark.createDataFrame(rows, "day string, i int, topic string, keywords array<string>, mentions int, sentiment double"), "day", "i").collect()
    name = lambda *w: hashlib.md5("|".join(w).encode()).hexdigest()[:12]
    assert sorted((str(r.day), r.narrative_name, r.narrative_id, r.mentions, r.avg_sentiment, r.source_count) for r in got) == [
        ("None", "n", name("q"), 1.0, 1.0, 1), ("a", "t1", name("x", "y"), 3.0, 0.25, 2), ("a", "t2", name("z"), 0.0, 1.0, 1), ("a", "t4", name(""), 4.0, 0.0, 1), ("b", "t1", name("x"), 5.0, 0.25, 1),
    ]


def test_phases(spark):
    cases = [([1.0], "emerging"), ([], "emerging"), (None, "emerging"), ([1.0, 2.0, 3.0], "peak"), ([1.0, 5.0, 4.0, 4.0], "growing"), ([9.0, 8.0, 1.0, 2.0], "decaying"), ([5.0, 4.0, 5.0, 4.0], "emerging")]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, h array<double>")
    assert [r.p for r in sorted(df.select("i", narratives.lifecycle_phase(F.col("h")).alias("p")).collect())] == [p for _, p in cases]
