"""Exact values by rank, without sorting what lies far from the rank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingualoom.functions.search import last_at_most
from lingualoom.session import discard, stage

# Distinct values of a group that may be sorted in one task, and ranges that more of them are cut into.
FEW = 1_000_000
RANGES = 256


def at_ranks(
    rows: DataFrame, by: list[str], value: str, ranks: Callable[[Column], tuple[Column, Column]], few: int = FEW
) -> DataFrame:
    """``by..., n, low, high``: the values at two neighbouring ranks (from 0) of each group's sorted values.

    ``ranks`` maps a group's number of values to the two ranks, and the columns ``by`` aren't null.  Equal values are counted first
    (with map-side combine).  While a group has more than ``few`` distinct values, splitters from a mergeable sketch cut
    them into RANGES ranges, an aggregate counts each, and only the ranges that hold the ranks are kept;
    how evenly the splitters lie makes no difference to the result.  What is left is sorted group by group.
    Nulls are left out; a group without values has no row, and without ``by`` all rows are one group.
    """
    groups = by or ["_all"]
    one = rows if by else rows.withColumn("_all", F.lit(1))
    held = one.filter(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    held = stage(held, "values")
    first, last = ranks(F.col("n"))
    known = held.groupBy(*groups).agg(F.sum("_c").alias("n"), F.count("*").alias("_m"))
    known = stage(known.select("*", first.cast("long").alias("_a"), last.cast("long").alias("_b"), F.lit(0).cast("long").alias("_below")), "groups")
    while not known.filter(F.col("_m") > few).isEmpty():
        spent = (held, known)
        held, known = _narrowed(held, known, groups)
        discard(*spent)
    order = Window.partitionBy(*groups).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = held.withColumn("_upto", F.sum("_c").over(order)).join(known, groups).withColumn("_upto", F.col("_below") + F.col("_upto"))
    low, high = (F.min(F.when(F.col("_upto") > F.col(c), F.col("_v"))) for c in ("_a", "_b"))
    return near.groupBy(*groups).agg(F.min("n").alias("n"), low.alias("low"), high.alias("high")).drop("_all")


def _narrowed(held: DataFrame, known: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Values in the ranges that hold the ranks, and what is now known of each group."""
    shares = [i / RANGES for i in range(1, RANGES)]
    cuts = held.groupBy(*by).agg(F.array_sort(F.array_distinct(F.percentile_approx("_v", shares, 16 * RANGES))).alias("_cuts"))
    # A few hundred numbers per group, next to its values.
    placed = held.join(cuts, by).withColumn("_range", last_at_most(F.col("_cuts"), F.col("_v"), RANGES)).drop("_cuts")
    placed = stage(placed, "ranges")
    counts = placed.groupBy(*by, "_range").agg(F.sum("_c").alias("_s"), F.count("*").alias("_k"))
    # At most RANGES rows per group.
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    told = counts.withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0))).join(known.drop("_m"), by)
    start = F.col("_below") + F.col("_before")
    kept = told.filter((F.col("_b") >= start) & (F.col("_a") < start + F.col("_s")))
    after = stage(
        kept.groupBy(*by).agg(
            F.min("n").alias("n"), F.sum("_k").alias("_m"), F.min("_a").alias("_a"), F.min("_b").alias("_b"), F.min(start).alias("_below"),
            F.min("_range").alias("_from"), F.max("_range").alias("_to"),
        ),
        "groups",
    )
    inside = placed.join(after.select(*by, "_from", "_to"), by).filter(F.col("_range").between(F.col("_from"), F.col("_to")))
    narrowed = stage(inside.select(*by, "_v", "_c"), "values")
    discard(placed)
    return narrowed, after.drop("_from", "_to")
