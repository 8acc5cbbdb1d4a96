"""Binary search in a sorted array of the row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_at_most(values: Column, x: Column, most: int, key: Callable[[Column], Column] = lambda v: v) -> Column:
    """Place (from 0) of the last element whose ``key`` is at most ``x``, or -1.

    ``most`` is the largest size that ``values``, which should be a plain column, can have; the interval
    is halved as often as that takes.
    """

    def halve(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["low"] + acc["high"], 1)
        ended = acc["high"] - acc["low"] <= 1
        fits = key(F.get(values, middle)) <= x
        return F.struct(
            F.when(~ended & fits, middle).otherwise(acc["low"]).alias("low"), F.when(~ended & ~fits, middle).otherwise(acc["high"]).alias("high")
        )

    steps = F.sequence(F.lit(1), F.lit(max(1, (most + 1).bit_length())))
    start = F.struct(F.lit(-1).alias("low"), F.coalesce(F.size(values), F.lit(0)).alias("high"))
    return F.aggregate(steps, start, halve, lambda acc: acc["low"])
