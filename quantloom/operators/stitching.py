"""Long histories from overlapping segments that each have a scale of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def segment_scales(rows: DataFrame, keys: list[str], segment: str = "segment", on: str = "day", value: str = "value") -> DataFrame:
    """(keys, segment, ratio, overlap, scale): how each segment is scaled to fit the one before it in order; the first is the anchor.

    ratio is the median, over the days that both have, of the anchor's value by the segment's, where both are above 0; without such a day the
    ratio of their largest values there, and without those null. Scales are the running product of the ratios; a null starts it
    again at 1. Neighbouring segments share days; a day that a segment shares with an earlier one than its neighbour is an error.
    """
    order = rows.select(*keys, segment).distinct().withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(segment)))
    placed = rows.select(*keys, segment, on, F.col(value).cast("double").alias("_v")).join(order, [*keys, segment])
    # Each row beside the row of the same day in the segment before: one sorted window, no self-join.
    same_day = W.partitionBy(*keys, on).orderBy("_k")
    before = placed.withColumns({"_anchor": F.lag("_v").over(same_day), "_from": F.lag("_k").over(same_day)})
    before = before.withColumn("_anchor", F.when(F.col("_from") == F.col("_k") - 1, F.col("_anchor")).when(F.col("_from").isNotNull(), F.raise_error(F.lit("a day is in segments that are no neighbours")).cast("double")))
    shared = F.col("_from").isNotNull()
    both = shared & (F.col("_anchor") > 0) & (F.col("_v") > 0)
    largest = F.max(F.when(shared, F.col("_anchor"))), F.max(F.when(shared, F.col("_v")))
    ratios = before.groupBy(*keys, segment, "_k").agg(
        F.median(F.when(both, F.col("_anchor") / F.col("_v"))).alias("_middle"), F.when((largest[0] > 0) & (largest[1] > 0), largest[0] / largest[1]).alias("_highest"), F.count_if(shared).alias("overlap"),
    )
    ratios = ratios.withColumn("ratio", F.coalesce("_middle", "_highest"))
    chain = W.partitionBy(*keys).orderBy("_k")
    run = F.sum(F.col("ratio").isNull().cast("int")).over(chain)
    product = F.exp(F.sum(F.ln("ratio")).over(W.partitionBy(*keys, "_run").orderBy("_k")))
    return ratios.withColumn("_run", run).withColumn("scale", F.coalesce(product, F.lit(1.0))).select(*keys, segment, "ratio", "overlap", "scale")


def stitch(rows: DataFrame, keys: list[str], segment: str = "segment", on: str = "day", value: str = "value") -> DataFrame:
    """(keys, day, value, segment, rescale_factor, overlap): one row a day, of the first segment that has it, scaled along the chain of segments."""
    scales = segment_scales(rows, keys, segment, on, value)
    first = rows.groupBy(*keys, on).agg(F.min_by(value, segment).cast("double").alias(value), F.min(segment).alias(segment))
    return first.join(scales, [*keys, segment]).select(*keys, on, (F.col(value) * F.col("scale")).alias(value), segment, F.col("scale").alias("rescale_factor"), "overlap")


def attention_shocks(rows: DataFrame, keys: list[str], on: str = "day", value: str = "value", days: int = 7, least: int = 2) -> DataFrame:
    """rows with baseline_n, baseline_mean and shock: how far a value is from the mean of those of the ``days`` before, in units of that mean, or of 1 if it is
    smaller; rows with fewer than ``least`` values before them are left out. Times of a series are distinct."""
    w = W.partitionBy(*keys).orderBy(F.unix_seconds(F.col(on).cast("timestamp"))).rangeBetween(-days * 86_400, -1)
    out = rows.withColumns({"baseline_n": F.count(value).over(w), "baseline_mean": F.avg(value).over(w)}).where(F.col("baseline_n") >= least)
    return out.withColumn("shock", (F.col(value) - F.col("baseline_mean")) / F.greatest(F.abs("baseline_mean"), F.lit(1.0)))
