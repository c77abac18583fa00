"""Narratives: topics that absorb one another by shared keywords, and the phase of a narrative's life."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

NARRATIVE = "narrative_id string, narrative_name string, keywords array<string>, mentions double, avg_sentiment double, source_count int"


def absorb(keywords: list[set[str]]) -> list[list[int]]:
    """Clusters of topics in their order. The first free topic opens a cluster and passes over all later ones once: a topic that shares a third of the cluster's
    keywords, and one at least, joins and adds its own, which topics after it may meet.

    Only topics that share a keyword can join, so an index from keywords to topics names them, in order, as the cluster's keywords come to be."""
    having = defaultdict(list)
    for i, words in enumerate(keywords):
        for w in words:
            having[w].append(i)
    free = np.ones(len(keywords), bool)
    clusters = []
    for first in range(len(keywords)):
        if not free[first]:
            continue
        free[first] = False
        cluster, own, ahead, seen = [first], set(), [], set()

        def take(words: set[str], after: int, own=own, ahead=ahead, seen=seen) -> None:
            for w in words - own:
                for j in having[w]:
                    if j > after and free[j] and j not in seen:
                        seen.add(j)
                        heappush(ahead, j)
            own |= words

        take(keywords[first], first)
        while ahead:
            j = heappop(ahead)
            if len(own & keywords[j]) >= max(1, len(own) // 3):
                free[j] = False
                cluster.append(j)
                take(keywords[j], j)
        clusters.append(cluster)
    return clusters


def cluster_narratives(topics: DataFrame, batch: str, place: str) -> DataFrame:
    """(batch, and NARRATIVE) of topics (batch, place, topic, keywords, mentions, sentiment): what one batch reports, in the order of place, is clustered by itself. Null
    keywords are none, null mentions and sentiments 0. A batch is one task's work; ties in place are put in order of topic."""
    ship(topics.sparkSession)

    def clusters(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_place", "topic"], kind="stable").reset_index(drop=True)
        words = [set() if x is None else set(x) for x in pdf["keywords"]]
        out = []
        for members in absorb(words):
            every = sorted(set().union(*(words[i] for i in members)))
            mood = sum(pdf["sentiment"].iloc[members]) / len(members)
            out.append((pdf["_batch"].iloc[0], hashlib.md5("|".join(every).encode()).hexdigest()[:12], pdf["topic"].iloc[members[0]], every, float(pdf["mentions"].iloc[members].sum()), round(mood, 4), len(members)))
        return pd.DataFrame(out, columns=["batch", "narrative_id", "narrative_name", "keywords", "mentions", "avg_sentiment", "source_count"])

    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    rows = topics.select(F.col(batch).alias("_batch"), F.col(place).alias("_place"), F.col("topic").cast("string").alias("topic"), "keywords", number("mentions"), number("sentiment"))
    kind = rows.schema["_batch"].dataType.simpleString()
    return rows.groupBy("_batch").applyInPandas(clusters, f"batch {kind}, {NARRATIVE}").withColumnRenamed("batch", batch)


def lifecycle_phase(history: Column) -> Column:
    """peak, growing, decaying or emerging, from attention of old to new: the second half's mean against the first's, and the last value against the largest."""
    half = F.floor(F.size(history) / 2).cast("int")
    mean = lambda part: F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / F.size(part)
    earlier, recent = mean(F.slice(history, 1, half)), mean(F.slice(history, half + 1, F.size(history)))
    last, top = F.element_at(history, -1), F.array_max(history)
    phase = F.when((last >= top * 0.9) & (recent > earlier), "peak").when(recent > earlier * 1.3, "growing").when(recent < earlier * 0.7, "decaying").otherwise("emerging")
    return F.when(F.coalesce(F.size(history), F.lit(0)) < 2, "emerging").otherwise(phase)
