"""Writers that never overwrite, read back what they wrote, and keep runs and baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A run directory: manifest, translations, timings, scores and segment scores.
RUN_TABLES = ("manifest", "translations", "timing", "scores", "segment_scores")


class OutputExists(Exception):
    """The output path is taken.  Nothing was written."""


def write_new(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()
) -> None:
    """Write to a path that must not exist; the committer publishes the files atomically."""
    try:
        df.write.mode("errorifexists").format(fmt).partitionBy(*partition_by).save(path)
    except AnalysisException as exc:
        if "PATH_ALREADY_EXISTS" in (exc.getCondition() or ""):
            raise OutputExists(path) from exc
        raise


def verify_written(expected: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """One row: written rows, missing, unexpected and changed ones (the last three must be 0).

    Contents are compared by digest, so that only keys and digests are shuffled.
    """
    spark = expected.sparkSession
    rest = [c for c in expected.columns if c not in keys]

    def digested(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.sha2(F.to_json(F.struct(*rest)), 256).alias(name))

    written = spark.read.schema(expected.schema).parquet(path)
    pairs = digested(expected, "_want").join(digested(written, "_got"), keys, "full_outer")
    return pairs.agg(
        F.count("_got").alias("written"),
        F.count_if(F.col("_got").isNull()).alias("missing"),
        F.count_if(F.col("_want").isNull()).alias("unexpected"),
        F.count_if(F.col("_want") != F.col("_got")).alias("changed"),
    )


def write_run(tables: dict[str, DataFrame], root: str, files: int = 4) -> None:
    """Append one or more runs, each table partitioned by run and, where it has one, direction.

    Rows of a partition are dealt out by id over ``files`` parts, so a large direction is written by
    so many tasks and leaves so many files, whatever the number of input tasks.
    """
    unknown = set(tables) - set(RUN_TABLES)
    if unknown:
        raise ValueError(f"not run tables: {sorted(unknown)}")
    for name, df in tables.items():
        by = [c for c in ("run_id", "direction") if c in df.columns]
        part = F.pmod(F.xxhash64("id"), F.lit(files)) if "id" in df.columns else F.lit(0)
        df.repartition(*by, part).write.mode("append").partitionBy(*by).parquet(f"{root}/{name}")


def read_run(spark: SparkSession, root: str, allowed: Sequence[str]) -> DataFrame:
    """Segment scores of runs whose manifest has one of the allowed statuses."""
    manifests = spark.read.parquet(f"{root}/manifest").filter(F.col("status").isin(*allowed))
    scores = spark.read.parquet(f"{root}/segment_scores")
    return scores.join(manifests.select("run_id"), "run_id", "left_semi")


def baseline_rows(manifests: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores of eligible runs, the newest run per mode: complete, clean tree, not limited."""
    eligible = manifests.filter(
        (F.col("status") == "complete") & ~F.col("git_dirty") & F.col("limit").isNull()
    )
    newest = eligible.groupBy("mode").agg(
        F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id")
    )
    return scores.join(newest, "run_id").select("mode", "run_id", "direction", "id", "comet")


def set_baseline(rows: DataFrame, root: str) -> None:
    """Replace only the modes present in ``rows``; other modes keep their baseline."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "mode"
    ).parquet(root)


def read_baseline(spark: SparkSession, root: str, mode: str) -> DataFrame:
    """direction, id, score of one mode's baseline; only that mode's folder is read."""
    rows = spark.read.parquet(root).filter(F.col("mode") == mode)
    return rows.select("direction", "id", F.col("comet").alias("score"))
