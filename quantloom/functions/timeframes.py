"""Timeframes such as 15m, 4h, 1d and 2w as lengths of time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FORM = "^([0-9]+)([mhdw])$"


def timeframe_seconds(timeframe: Column, bars: Column | int = 1) -> Column:
    """Seconds of ``bars`` bars; a timeframe of another form is an error, null is null."""
    unit = F.regexp_extract(timeframe, _FORM, 2)
    length = F.when(unit == "m", 60).when(unit == "h", 3_600).when(unit == "d", 86_400).otherwise(604_800)
    seconds = F.regexp_extract(timeframe, _FORM, 1).try_cast("long") * length * bars
    wrong = F.raise_error(F.concat(F.lit("not a timeframe: "), timeframe)).cast("long")
    return F.when(timeframe.isNull(), F.lit(None).cast("long")).when(timeframe.rlike(_FORM), seconds).otherwise(wrong)


def close_time(open_time: Column, timeframe: Column) -> Column:
    """When a bar ends."""
    return F.timestamp_add("SECOND", timeframe_seconds(timeframe), open_time)
