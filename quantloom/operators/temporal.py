"""As-of joins, latest rows, point-in-time slices and other operators on event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: str, n: int = 1) -> DataFrame:
    """The n newest rows of each key; a window limit keeps n rows a task before the exchange."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def _seconds(a: Column, b: Column) -> Column:
    return (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 1e6


def as_of(left: DataFrame, right: DataFrame, keys: list[str], on: str, values: list[str], *, tiebreak: str, direction: str = "backward", tolerance: float | None = None) -> DataFrame:
    """Each row of left with the values of the right row nearest in time: at or before it
    (backward), at or after it (forward) or the nearer of both, the earlier of equals.

    Both sides meet in one sorted window, so the cost is one exchange and no row is
    multiplied. Adds the right side's values and ``gap_seconds``; all NULL if nothing is within the tolerance.
    """
    packed = F.struct(F.col(on).alias("t"), *values)
    both = left.withColumns({"_side": F.lit(1), "_right": F.lit(None).cast(right.select(packed.alias("x")).schema["x"].dataType), "_tie": F.lit(None).cast("long")}).unionByName(
        right.select(*keys, on, F.lit(0).alias("_side"), packed.alias("_right"), F.col(tiebreak).cast("long").alias("_tie")), allowMissingColumns=True
    )
    back = F.last("_right", ignorenulls=True).over(W.partitionBy(*keys).orderBy(on, "_side", "_tie").rowsBetween(W.unboundedPreceding, 0))
    ahead_side = W.partitionBy(*keys).orderBy(F.desc(on), F.asc("_side"), F.asc("_tie")).rowsBetween(W.unboundedPreceding, 0)
    ahead = F.last("_right", ignorenulls=True).over(ahead_side)
    if direction == "backward":
        found = back
    elif direction == "forward":
        found = ahead
    else:
        both = both.withColumns({"_back": back, "_ahead": ahead})
        near = F.coalesce(_seconds(F.col(on), F.col("_back.t")) <= _seconds(F.col("_ahead.t"), F.col(on)), F.col("_ahead").isNull())
        found = F.when(near, F.col("_back")).otherwise(F.col("_ahead"))
    out = both.withColumn("_found", found).where("_side = 1").withColumn("gap_seconds", _seconds(F.col(on), F.col("_found.t")))
    if tolerance is not None:
        fits = F.abs("gap_seconds") <= tolerance
        out = out.withColumns({"_found": F.when(fits, F.col("_found")), "gap_seconds": F.when(fits, F.col("gap_seconds"))})
    return out.select(*left.columns, *(F.col(f"_found.{v}").alias(v) for v in values), "gap_seconds")


def with_carry_in(df: DataFrame, keys: list[str], on: str, since, tiebreak: str) -> DataFrame:
    """Rows from ``since`` on, and of each key the last one before it."""
    return df.where(F.col(on) >= since).unionByName(latest(df.where(F.col(on) < since), keys, on, tiebreak))


def point_in_time(df: DataFrame, keys: list[str], available: str, on: str, as_of_time, tiebreak: str) -> DataFrame:
    """What was known at a time: of each key and observation the last vintage available by then."""
    return latest(df.where(F.col(available) <= as_of_time), [*keys, on], available, tiebreak)


def snapshot_diff(df: DataFrame, key: str, snapshot: str, value: str) -> DataFrame:
    """Values of the newest snapshot beside those of the one before (0 where missing)."""
    snapshots = df.select(snapshot).distinct().orderBy(F.desc(snapshot)).limit(2).withColumn("_r", F.row_number().over(W.orderBy(F.desc(snapshot))))
    ranked = df.join(F.broadcast(snapshots), snapshot)
    now, before = (ranked.where(F.col("_r") == r).select(key, F.col(value).alias(name)) for r, name in ((1, "now"), (2, "before")))
    return now.join(before, key, "left").select(key, "now", F.coalesce("before", F.lit(0)).alias("before"), (F.col("now") - F.coalesce("before", F.lit(0))).alias("change"))


def coalesce_upsert(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """old with new's values where they are not NULL, new keys added; ``changed`` marks what differs."""
    a, b = old.select(*keys, *values), new.select(*keys, *(F.col(v).alias(f"_{v}") for v in values), F.lit(True).alias("_there"))
    joined = a.withColumn("_had", F.lit(True)).join(b, keys, "full")
    merged = {v: F.coalesce(f"_{v}", v) for v in values}
    same = F.lit(True)
    for v in values:
        same = same & merged[v].eqNullSafe(F.col(v))
    return joined.select(*keys, *(m.alias(v) for v, m in merged.items()), (F.col("_had").isNull() | ~same).alias("changed"))


def newest_wins(old: DataFrame, new: DataFrame, keys: list[str], on: str, tiebreak: str) -> DataFrame:
    """Guarded upsert: of each key the row with the newest event time."""
    return latest(old.unionByName(new), keys, on, tiebreak)


def first_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new whose key it has not; equal keys inside new count once."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti"))


def densify(df: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """One row a day from each key's first to its last, missing values carried forward."""
    days = df.groupBy(*keys).agg(F.explode(F.sequence(F.min(day), F.max(day), F.expr("INTERVAL 1 DAY"))).alias(day))
    w = W.partitionBy(*keys).orderBy(day).rowsBetween(W.unboundedPreceding, 0)
    return days.join(df.select(*keys, day, value), [*keys, day], "left").withColumn(value, F.last(value, ignorenulls=True).over(w))


def keyset_page(df: DataFrame, on: str, id_: str, after: tuple | None, size: int) -> DataFrame:
    """The page after a (time, id) cursor, newest first, and one row more that tells whether there is another."""
    if after is not None:
        df = df.where((F.col(on) < F.lit(after[0])) | ((F.col(on) == F.lit(after[0])) & (F.col(id_) < F.lit(after[1]))))
    return df.orderBy(F.desc(on), F.desc(id_)).limit(size + 1)
