"""Comparison of two scored runs: aligned deltas, paired bootstrap, verdict, gate."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingualoom.session import stage

# ---- fixed values: the test that decides ---------------------------------------------------------
RESAMPLES = 1000
SEED = 0
DECIDING = "zh-en"
# Places (from 1) of the interval's ends among 1,000 sorted means.
LOW_RANK, HIGH_RANK, OF_MEANS = 26, 976, 1000
# ---- end of fixed values -------------------------------------------------------------------------

def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """direction, id, a, b: both sides of every segment id; one side is NULL where it is missing."""
    left = a.select("direction", "id", F.col("score").alias("a"))
    right = b.select("direction", "id", F.col("score").alias("b"))
    return left.join(right, ["direction", "id"], "full_outer")


def paired_delta(pairs: DataFrame) -> DataFrame:
    """n, only_in_a, only_in_b and means over the shared ids.

    A direction that one run lacks, and one without a shared id, have an error code.
    """
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    delta = F.when(both, F.col("b") - F.col("a"))
    sums = pairs.groupBy("direction").agg(
        F.count_if(both).alias("n"),
        F.count_if(F.col("b").isNull()).alias("only_in_a"),
        F.count_if(F.col("a").isNull()).alias("only_in_b"),
        F.round(F.avg(F.when(both, F.col("a"))), 9).alias("comet_a"),
        F.round(F.avg(F.when(both, F.col("b"))), 9).alias("comet_b"),
        F.round(F.avg(delta), 9).alias("delta_comet"),
    )
    one_sided = (F.col("only_in_a") == 0) | (F.col("only_in_b") == 0)
    return sums.withColumn(
        "error_code",
        F.when(F.col("n") == 0, F.when(one_sided, F.lit("missing_direction")).otherwise(F.lit("no_shared_ids"))),
    )


def shared_directions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each direction of either run and whether both have it."""
    left = a.select("direction").distinct().withColumn("_a", F.lit(True))
    right = b.select("direction").distinct().withColumn("_b", F.lit(True))
    both = left.join(right, "direction", "full_outer")
    return both.select(
        "direction", (F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("shared")
    )


def draw_limits() -> tuple[int, ...]:
    """Where 16 bits that are read as a number begin to mean 1, 2, ... draws: the Poisson distribution of mean 1."""
    below, term, out = 0.0, math.exp(-1), []
    for k in range(1, 9):
        below += term
        term /= k
        out.append(math.floor(below * (1 << 16)))
    return tuple(out)


def draws(ids: list[str], resamples: int, seed: int) -> np.ndarray:
    """ids x resamples: how often each resample draws each segment.

    SHA-256 of ``seed|id|block`` holds the numbers of 16 resamples, so that SQL can repeat them.
    """
    blocks = -(-resamples // 16)
    hashed = b"".join(hashlib.sha256(f"{seed}|{i}|{k}".encode()).digest() for i in ids for k in range(blocks))
    numbers = np.frombuffer(hashed, ">u2").reshape(len(ids), blocks * 16)[:, :resamples]
    return np.searchsorted(np.array(draw_limits()), numbers, "right")


_DRAWN = "direction string, draws array<bigint>, sums array<double>, n bigint, total double"
# Segments whose draws are in memory at once, and directions that a task adds up before it hands them on.
_ROWS, _DIRECTIONS = 512, 256


def _add_draws(batches: Iterator[pa.RecordBatch], resamples: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Adds up, for each direction that a task meets, draws and drawn deltas of every resample."""
    held: dict[str, list] = {}

    def out() -> pa.RecordBatch:
        columns = [list(held), *([x[i].tolist() for x in held.values()] for i in (0, 1)), *([x[i] for x in held.values()] for i in (2, 3))]
        types = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.int64(), pa.float64()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in _DRAWN.split(", ")])

    for batch in batches:
        directions = batch.column(0).to_pylist()
        ids, deltas = batch.column(1).to_pylist(), np.asarray(batch.column(2))
        for at in range(0, len(ids), _ROWS):
            part = slice(at, at + _ROWS)
            counts, delta = draws(ids[part], resamples, seed), deltas[part]
            names = np.array(directions[part], object)
            for name in dict.fromkeys(directions[part]):
                own = names == name
                sums = held.setdefault(name, [np.zeros(resamples, np.int64), np.zeros(resamples), 0, 0.0])
                sums[0] += counts[own].sum(0)
                sums[1] += delta[own] @ counts[own]
                sums[2] += int(own.sum())
                sums[3] += float(delta[own].sum())
            if len(held) > _DIRECTIONS:
                yield out()
    if held:
        yield out()


def bootstrap_means(
    pairs: DataFrame, resamples: int = RESAMPLES, seed: int = SEED
) -> DataFrame:
    """direction, resample, mean: means of resampled deltas (Poisson bootstrap).

    A resample draws each segment a number of times that follows from a hash of the segment's id and
    the resample alone, so segments need no numbers, no joins and no knowledge of each other, and a lost
    task repeats its draws.  Each task adds its rows up in one array per direction; what is shuffled is one
    number pair for each task, direction and resample.  A resample that draws nothing, which happens with a
    few segments only, has the mean of all.
    """
    shared = pairs.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).select(
        "direction", F.col("id").cast("string").alias("id"), (F.col("b") - F.col("a")).cast("double").alias("delta")
    )
    added = shared.mapInArrow(lambda b: _add_draws(b, resamples, seed), _DRAWN)
    each = added.select("direction", "n", "total", F.posexplode(F.arrays_zip("draws", "sums")).alias("resample", "x"))
    sums = each.groupBy("direction", "resample").agg(
        F.sum("x.draws").alias("draws"), F.sum("x.sums").alias("drawn"), F.sum("n").alias("n"), F.sum("total").alias("total")
    )
    mean = F.when(F.col("draws") > 0, F.col("drawn") / F.col("draws")).otherwise(F.col("total") / F.col("n"))
    return sums.select("direction", "resample", mean.alias("mean"))


def bootstrap_ci(means: DataFrame, resamples: int = RESAMPLES) -> DataFrame:
    """Percentile interval: two elements of the sorted means (at most ``resamples`` per group)."""
    low, high = ((rank - 1) * resamples // OF_MEANS for rank in (LOW_RANK, HIGH_RANK))
    ordered = means.groupBy("direction").agg(F.array_sort(F.collect_list("mean")).alias("m"))
    return ordered.select(
        "direction",
        F.round(F.get("m", F.lit(low)), 9).alias("ci_low"),
        F.round(F.get("m", F.lit(high)), 9).alias("ci_high"),
    )


def verdict(intervals: DataFrame) -> DataFrame:
    return intervals.withColumn(
        "verdict",
        F.when(F.col("ci_low") > 0, F.lit("better"))
        .when(F.col("ci_high") < 0, F.lit("worse"))
        .otherwise(F.lit("no significant difference")),
    )


def regression_gate(verdicts: DataFrame, deciding: str = DECIDING) -> DataFrame:
    """True only if the deciding direction is significantly worse."""
    bad = (F.col("direction") == deciding) & (F.col("verdict") == "worse")
    return verdicts.agg(F.coalesce(F.bool_or(bad), F.lit(False)).alias("regression"))


def compare_runs(a: DataFrame, b: DataFrame, chrf_a: DataFrame, chrf_b: DataFrame) -> DataFrame:
    """One row per direction of either run: counts, means, interval, verdict and the chrF difference.

    A direction without shared ids keeps its row, with an error code and no interval.
    """
    pairs = stage(paired(a, b), "pairs")
    chrf = chrf_a.select("direction", F.col("chrf").alias("_ca")).join(
        chrf_b.select("direction", F.col("chrf").alias("_cb")), "direction"
    )
    return (
        paired_delta(pairs)
        .join(verdict(bootstrap_ci(bootstrap_means(pairs))), "direction", "left")
        .join(chrf, "direction", "left")
        .withColumn("delta_chrf", F.round(F.col("_cb") - F.col("_ca"), 4))
        .drop("_ca", "_cb")
    )
