"""Choice of font sizes from measured candidates: floors, allowances, outcome, roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: the shrinking policy ----------------------------------------------------------
SCALE_STEP = 0.025
MAX_CANDIDATES = 40
SIZE_QUANTUM_PT = 0.5
TOLERANCE_PT = 1.0
MIN_SCALE = 0.7
MIN_SIZE_PT = 8.0
GUARD = 1e-9
# ---- end of fixed values -------------------------------------------------------------------------


def _down(size: Column) -> Column:
    return F.floor(size / SIZE_QUANTUM_PT + GUARD) * F.lit(SIZE_QUANTUM_PT)


def _up(size: Column) -> Column:
    return F.ceil(size / SIZE_QUANTUM_PT - GUARD) * F.lit(SIZE_QUANTUM_PT)


def fit_floor(size: Column, min_size: float = MIN_SIZE_PT, min_scale: float = MIN_SCALE) -> Column:
    """Smallest size a run may get; a run already small is neither shrunk nor enlarged."""
    return F.when(size <= min_size, size).otherwise(
        F.greatest(F.lit(min_size), _up(size * min_scale))
    )


def fit_candidate(size: Column, scale: Column) -> Column:
    return F.greatest(fit_floor(size), _down(size * scale))


def fit_allowed(bound: Column, extent: Column, free: Column) -> Column:
    """Allowed extent of an axis: the larger of bound and original; NULL when unconstrained."""
    return F.when(bound.isNotNull() & ~free, F.greatest(bound, extent))


def fits(extent: Column, allowed: Column) -> Column:
    return allowed.isNull() | (extent <= allowed + TOLERANCE_PT)


def same_text_skip(originals: DataFrame, translated: DataFrame, keys: list[str]) -> DataFrame:
    """Containers whose text changed; the others need no measuring."""
    now = translated.select(*keys, F.col("text").alias("_now"))
    return originals.join(now, keys).filter(~F.col("text").eqNullSafe(F.col("_now"))).drop("_now")


def fit_choose(containers: DataFrame, measurements: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status, reason, scale, final_sizes.

    containers: keys, sizes (array<double>), width, height, allowed_w, allowed_h at original
    sizes, unmeasurable (reason or NULL).  measurements: keys, step (1..40, scale = 1 - 0.025 *
    step), w, h.  The largest scale that fits wins; each container aggregates to one row before
    the join.
    """
    limits = containers.select(*keys, "allowed_w", "allowed_h")
    fitting = (
        measurements.filter(F.col("step") <= MAX_CANDIDATES)
        .join(limits, keys)
        .filter(fits(F.col("w"), F.col("allowed_w")) & fits(F.col("h"), F.col("allowed_h")))
        .groupBy(*keys)
        .agg(F.min("step").alias("step"))
    )
    joined = containers.join(fitting, keys, "left")
    unchanged = fits(F.col("width"), F.col("allowed_w")) & fits(
        F.col("height"), F.col("allowed_h")
    )
    status = (
        F.when(F.col("unmeasurable").isNotNull(), F.lit("unresolved"))
        .when(unchanged, F.lit("unchanged"))
        .when(F.col("step").isNotNull(), F.lit("adjusted"))
        .otherwise(F.lit("unresolved"))
    )
    scale = 1 - F.col("step") * F.lit(SCALE_STEP)
    chosen = joined.withColumn("status", status)
    return chosen.select(
        *keys,
        "status",
        F.when(F.col("unmeasurable").isNotNull(), F.col("unmeasurable"))
        .when(F.col("status") == "adjusted", F.lit("shrunk_to_fit"))
        .when(F.col("status") == "unresolved", F.lit("overflow_at_floor"))
        .alias("reason"),
        F.when(F.col("status") == "adjusted", F.round(scale, 3)).alias("scale"),
        F.when(F.col("status") == "adjusted", F.transform("sizes", lambda s: fit_candidate(s, scale)))
        .when(
            (F.col("status") == "unresolved") & F.col("unmeasurable").isNull(),
            F.transform("sizes", lambda s: fit_floor(s)),
        )
        .otherwise(F.col("sizes"))
        .alias("final_sizes"),
    )


def fit_rollup(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Counts and overall status per document; documents without containers are not_applicable."""
    sums = outcomes.groupBy(*by).agg(
        F.count("status").alias("inspected"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("unchanged", "adjusted", "unresolved")],
    )
    return sums.withColumn(
        "overall",
        F.when(F.col("inspected") == 0, F.lit("not_applicable"))
        .when(F.col("unresolved") > 0, F.lit("unresolved"))
        .when(F.col("adjusted") > 0, F.lit("adjusted"))
        .otherwise(F.lit("passed")),
    )
