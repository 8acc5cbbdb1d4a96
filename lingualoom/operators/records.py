"""Record tables around translation: submissions, batches, versions, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def idempotent_submissions(
    submissions: DataFrame, key: list[str], content: str, order: list[str], outcome: str
) -> DataFrame:
    """One row per identity: its original outcome, tries, and whether other content ever came.

    Two extremes of the content hash tell whether it varied, so no distinct set is kept.
    """
    return submissions.groupBy(*key).agg(
        F.count("*").alias("tries"),
        F.min_by(outcome, F.struct(*order)).alias("outcome"),
        (F.min(content) != F.max(content)).alias("conflict"),
    )


def batch_status_counts(members: DataFrame, batch: str, status: str, statuses: Sequence[str]) -> DataFrame:
    """Members per batch and status; the status list is fixed, so one aggregation does it."""
    return members.groupBy(batch).pivot(status, list(statuses)).count().na.fill(0)


def latest_version(versions: DataFrame, doc: str, version: str) -> DataFrame:
    """The newest version of each document, by a combining maximum instead of a sort."""
    rest = [c for c in versions.columns if c not in (doc, version)]
    newest = versions.groupBy(doc).agg(F.max(F.struct(version, *rest)).alias("_v"))
    return newest.select(doc, "_v.*")


def expire_unused(cache: DataFrame, last_used: str, now: Column, days: int) -> DataFrame:
    """Rows that have not been used for ``days`` days; a plain filter that reaches the scan."""
    return cache.filter(F.col(last_used) < now - F.make_dt_interval(F.lit(days)))


def unreferenced_blobs(blobs: DataFrame, references: Sequence[DataFrame], key: str) -> DataFrame:
    """Blobs that no cache row, version or job refers to."""
    used = references[0].select(key)
    for table in references[1:]:
        used = used.unionByName(table.select(key))
    return blobs.join(used.filter(F.col(key).isNotNull()).distinct(), key, "left_anti")
