"""What was known at a time: vintages, readiness of evidence bands, and quantiles of all earlier values."""

from __future__ import annotations

from bisect import insort
from math import fma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import continuous_honesty
from ..shipping import ship

# Weights of the evidence bands, those that are required, and seconds for which they are fresh.
BAND_WEIGHTS = {"exchange": 0.30, "news": 0.15, "event_calendar": 0.10, "onchain": 0.15, "tokenomics": 0.10, "options": 0.10, "alternative": 0.05, "macro": 0.05}
REQUIRED_BANDS = ("exchange", "news", "event_calendar", "onchain", "tokenomics", "options", "macro")
BAND_FRESH = {"exchange": 172_800, "macro": 432_000, "news": 259_200, "onchain": 259_200, "options": 259_200, "tokenomics": 604_800, "alternative": 604_800, "event_calendar": 1_209_600}
MIX = (0.25, 0.35, 0.40)


def known_by(moments: DataFrame, vintages: DataFrame, keys: list[str], values: list[str], tiebreak: str) -> DataFrame:
    """Each moment (keys, at, others) with the newest observation among the vintages (keys, observed, available, values, tiebreak) that were available by then:
    the latest observed, of these the vintage that came last. What was revised or published later does not show. Adds observed, available and
    the values, null before the first. One exchange and one sorted window with a running maximum; no row is multiplied."""
    packed = F.struct(F.col("observed"), F.col("available"), F.col(tiebreak).cast("long").alias("_tie"), *values)
    there = vintages.where("observed IS NOT NULL").withColumn("available", F.coalesce("available", "observed"))
    made = there.select(*keys, F.col("available").alias("at"), F.lit(0).alias("_side"), packed.alias("_seen"))
    both = moments.withColumns({"_side": F.lit(1), "_seen": F.lit(None).cast(made.schema["_seen"].dataType)}).unionByName(made, allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy("at", "_side").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_known", F.max("_seen").over(w)).where("_side = 1")
    return found.select(*moments.columns, "_known.observed", "_known.available", *(F.col(f"_known.{v}").alias(v) for v in values))


def status_of_age(age: Column, fresh: Column | float) -> Column:
    """ready while fresh, limited up to three times as long, else missing."""
    return F.when(age <= fresh, "ready").when(age <= fresh * 3, "limited").otherwise("missing")


def ratio(status: Column) -> Column:
    return F.when(status.isin("ready", "shared_ready"), 1.0).when(status == "limited", 0.5).otherwise(0.0)


def band_readiness(moments: DataFrame, bands: DataFrame, tiebreak: str, fresh: dict[str, int] | None = None) -> DataFrame:
    """Each moment (symbol, at, others) with st_<band> of every band, from what bands (band, symbol, observed, available, tiebreak) knew of the symbol, or with a null
    symbol of all, by then; with it readiness_score, n_ready and n_limited. A band's time is when its newest known row became available."""
    fresh = BAND_FRESH | (fresh or {})
    everywhere = bands.where("symbol IS NULL").select("band").distinct().withColumn("_all", F.lit(True))
    asked = moments.select("symbol", "at").distinct().crossJoin(F.broadcast(moments.sparkSession.createDataFrame([(b,) for b in BAND_WEIGHTS], "band string")))  # eight names
    asked = asked.join(F.broadcast(everywhere), "band", "left").withColumn("_of", F.when(F.col("_all"), F.lit("")).otherwise(F.concat(F.lit("s"), F.col("symbol"))))
    rows = bands.select("band", F.coalesce(F.concat(F.lit("s"), F.col("symbol")), F.lit("")).alias("_of"), F.coalesce("available", "observed").alias("observed"), F.lit(None).cast("timestamp_ntz").alias("available"), tiebreak)
    seen = known_by(asked.select("band", "_of", "symbol", "at"), rows, ["band", "_of"], [], tiebreak)
    age = F.timestamp_diff("MICROSECOND", F.col("observed"), F.col("at")) / 1e6
    limit = F.element_at(F.create_map(*(F.lit(x) for b in BAND_WEIGHTS for x in (b, fresh[b]))), F.col("band"))
    status = seen.withColumn("status", status_of_age(age, limit))
    wide = status.groupBy(F.col("symbol").alias("_symbol"), F.col("at").alias("_at")).agg(*(F.max(F.when(F.col("band") == b, F.col("status"))).alias(f"st_{b}") for b in BAND_WEIGHTS))
    out = moments.join(wide, moments["symbol"].eqNullSafe(wide["_symbol"]) & moments["at"].eqNullSafe(wide["_at"]), "left").drop("_symbol", "_at")
    return with_score(out)


def _number(status: str, bands) -> Column:
    return sum(((F.col(f"st_{b}") == status).cast("int") for b in bands), F.lit(0))


def with_score(rows: DataFrame) -> DataFrame:
    score = sum((w * ratio(F.col(f"st_{b}")) for b, w in BAND_WEIGHTS.items()), F.lit(0.0))
    return rows.withColumns({"readiness_score": F.round(score, 4), "n_ready": _number("ready", BAND_WEIGHTS), "n_limited": _number("limited", BAND_WEIGHTS)})


def world(rows: DataFrame, drop_band: str | None = None, thin: bool = False) -> DataFrame:
    """rows (st_<band>) with b_hier, u, h and wmi: breadth mixed from the means over all and over required bands and the weighted one, stability, honesty and their
    index. ``drop_band`` counts as missing; ``thin`` leaves the exchange band alone."""
    gone = [b for b in BAND_WEIGHTS if b == drop_band or (thin and b != "exchange")]
    status = {b: F.lit("missing") if b in gone else F.coalesce(F.col(f"st_{b}"), F.lit("missing")) for b in BAND_WEIGHTS}
    ratios = {b: ratio(s) for b, s in status.items()}
    mean = lambda bands: sum((ratios[b] for b in bands), F.lit(0.0)) / len(bands)
    asset = sum((w * ratios[b] for b, w in BAND_WEIGHTS.items()), F.lit(0.0))
    count = lambda name: sum(((s == name).cast("double") for s in status.values()), F.lit(0.0))
    out = rows.withColumns({"b_hier": MIX[0] * mean(list(BAND_WEIGHTS)) + MIX[1] * mean(REQUIRED_BANDS) + MIX[2] * asset, "_ready": count("ready"), "_limited": count("limited")})
    total = len(BAND_WEIGHTS)
    out = out.withColumns({"u": (F.col("_ready") + 0.7 * F.col("_limited")) / total, "h": F.expr(continuous_honesty(f"_ready / {total}", f"_limited / {2 * total}"))})
    flag = F.when((F.col("b_hier") >= 0.55) & (F.col("_limited") / (2 * total) < 0.15), 1.0).when(F.col("b_hier") >= 0.35, 0.7).otherwise(0.4)
    return out.withColumn("wmi", F.round(F.col("b_hier") * F.least(F.lit(1.0), F.col("u")) * flag, 4)).drop("_ready", "_limited")


# Expanding quantile ----------------------------------------------------------------------


def _walk(q: float, least: int):
    """Thresholds of one chunk: its rows in order, each against the values before it. Of the values before the chunk only those near the
    quantile are there, in order, with the number of smaller ones that are not."""

    def walk(rows: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_i", kind="stable")
        held = sorted(near["v"].tolist())
        below = int(near["_below"].iloc[0]) if len(near) else 0
        n = int(rows["_before"].iloc[0])
        found = []
        for i, v in zip(rows["_i"].tolist(), rows["v"].tolist(), strict=True):
            if n == 0 or i < least:
                found.append(np.nan)
            else:
                place = (n - 1) * q
                low = int(place)
                share = place - low
                # As the SQL's engine rounds it, so that ties of later rounding agree.
                found.append(fma(held[low - below], 1 - share, held[min(low + 1, n - 1) - below] * share))
            if not np.isnan(v):
                insort(held, v)
                n += 1
        return pd.DataFrame({"_id": rows["_id"].to_numpy(), "threshold": found})

    return walk


def expanding_quantile(rows: DataFrame, keys: list[str], order: list[str], value: str, q: float, least: int = 0, chunk: int = 4096) -> DataFrame:
    """rows with threshold: the q-quantile, between order statistics, of the value over all earlier rows of the same keys; null for the first ``least`` rows and
    while there is no value. Null and NaN values are passed over. ``order`` must be without ties.

    A series is cut into chunks of time and its values into buckets of as many ranks. Counts by chunk and bucket, summed along both, tell which buckets hold the
    quantile of everything before a chunk; over the chunk its place moves by the chunk's length at most, so a task gets its own rows and
    some four chunks of earlier values, however long the series is, and keeps them in order as it goes.
    """
    ship(rows.sparkSession)
    number = F.col(value).cast("double")
    series = W.partitionBy(*keys)
    placed = rows.withColumn("_i", F.row_number().over(series.orderBy(*order)) - 1)
    clean = F.when(~F.isnan(number), number)
    slim = placed.select(*keys, "_i", clean.alias("v")).withColumn("_chunk", F.floor(F.col("_i") / chunk).cast("long"))
    there = slim.where("v IS NOT NULL").withColumn("_bucket", F.floor((F.row_number().over(series.orderBy("v", "_i")) - 1) / chunk).cast("long"))
    counts = there.groupBy(*keys, "_chunk", "_bucket").agg(F.count("*").alias("c"))
    chunks = slim.groupBy(*keys, "_chunk").agg(F.count("v").alias("own"))
    before = F.coalesce(F.sum("own").over(W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    chunks = chunks.withColumn("_before", before)
    buckets = counts.select(*keys, "_bucket").distinct()
    every = chunks.join(buckets, keys).join(counts, [*keys, "_chunk", "_bucket"], "left")  # as many rows as values at most, where a chunk has as many rows as there are chunks
    earlier = F.coalesce(F.sum("c").over(W.partitionBy(*keys, "_bucket").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    every = every.withColumn("_n", earlier)
    up_to = F.sum("_n").over(W.partitionBy(*keys, "_chunk").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0))
    low = F.floor((F.col("_before") - 1) * q) - F.col("own") - 1
    high = F.ceil((F.col("_before") + F.col("own") - 1) * q) + 1
    needed = every.withColumn("_to", up_to).where((F.col("_n") > 0) & (F.col("_to") > low) & (F.col("_to") - F.col("_n") <= high))
    first = F.min(F.col("_to") - F.col("_n")).over(W.partitionBy(*keys, "_chunk"))
    needed = needed.select(*keys, F.col("_chunk").alias("_for"), "_bucket", first.alias("_below"))
    near = there.drop("_i").join(needed, [*keys, "_bucket"]).where(F.col("_chunk") < F.col("_for")).select(*(F.col(k).alias(f"_near_{k}") for k in keys), F.col("_for").alias("_near_chunk"), "v", "_below")
    packed = F.struct(*keys, "_i").alias("_id")
    mine = slim.join(chunks.drop("own"), [*keys, "_chunk"]).withColumn("_id", packed).withColumn("v", F.coalesce("v", F.lit(float("nan"))))
    id_type = mine.schema["_id"].dataType.simpleString()
    mine = mine.withColumn("_id", F.to_json("_id"))
    done = mine.groupBy(*keys, "_chunk").cogroup(near.groupBy(*(f"_near_{k}" for k in keys), "_near_chunk")).applyInPandas(_walk(q, least), "_id string, threshold double")
    done = done.withColumn("_id", F.from_json("_id", id_type)).select("_id.*", F.nullif("threshold", F.lit(float("nan"))).alias("threshold"))
    return placed.join(done, [*keys, "_i"]).drop("_i")
