"""Fingerprints of what determines an output, and digests of sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: versions that take part in a fingerprint --------------------------------------
FINGERPRINT_SCHEMA = 1
STRATEGIES = {
    "detect": "detect-v1", "docx": "docx-v1", "fit": "fit-v1", "inline": "inline-v1",
    "measure": "measure-v1", "pipeline": "pipeline-v1", "pptx": "pptx-v1",
    "protect": "protect-v1", "txt": "txt-v1", "xlsx": "xlsx-v1",
}
# ---- end of fixed values -------------------------------------------------------------------------

_WITH_NULLS = {"ignoreNullFields": "false"}


def sorted_map(entries: Column) -> Column:
    """The same map with its keys in order, so that its JSON is canonical."""
    return F.map_from_entries(F.array_sort(F.map_entries(entries)))


def identity_json(mode: Column, model: Column, details: Column) -> Column:
    return F.to_json(
        F.struct(
            sorted_map(details).alias("details"), mode.alias("mode"), model.alias("model")
        ),
        _WITH_NULLS,
    )


def identity_digest(mode: Column, model: Column, details: Column) -> Column:
    return F.sha2(identity_json(mode, model, details), 256)


def output_fingerprint(
    version: Column, mode: Column, model: Column, details: Column, options: Column, fonts: Column
) -> Column:
    """SHA-256 of canonical JSON: fields in key order, compact separators, nulls kept.

    ``options`` is a struct whose fields are already in key order.
    """
    strategies = F.struct(*[F.lit(v).alias(k) for k, v in sorted(STRATEGIES.items())])
    identity = F.struct(sorted_map(details).alias("details"), mode.alias("mode"), model.alias("model"))
    payload = F.struct(
        version.alias("core_version"),
        fonts.alias("font_manifest"),
        identity.alias("identity"),
        options.alias("options"),
        F.lit(FINGERPRINT_SCHEMA).alias("schema"),
        strategies.alias("strategies"),
    )
    return F.sha2(F.to_json(payload, _WITH_NULLS), 256)


def set_digest(entries: DataFrame, by: list[str], entry: Column, levels: tuple[int, ...] = (6, 3)) -> DataFrame:
    """by, digest: order-independent digest of each group's entries.

    Digests are folded by prefix (6 hex digits, then 3, then the group), so that even the largest
    group is never sorted in one place.
    """
    rows = entries.select(*by, F.sha2(entry, 256).alias("d"))
    folded = F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "\n"), 256)
    for width in levels:
        prefix = F.substring("d", 1, width)
        rows = rows.groupBy(*by, prefix.alias("_p")).agg(folded.alias("_d")).select(
            *by, F.concat("_p", "_d").alias("d")
        )
    return rows.groupBy(*by).agg(folded.alias("digest"))


def incremental_manifest(
    found: DataFrame, previous: DataFrame, keys: list[str], described: list[str], describe
) -> DataFrame:
    """Entries of ``found``: those unchanged since ``previous`` reuse its description.

    ``describe`` (DataFrame -> DataFrame) does the expensive reading, for the others only.
    """
    same = previous.select(*keys, *described).dropDuplicates(keys)
    reused = found.join(same, keys).withColumn("reused", F.lit(True))
    fresh = describe(found.join(same, keys, "left_anti")).withColumn("reused", F.lit(False))
    columns = [*found.columns, *described, "reused"]
    return reused.select(*columns).unionByName(fresh.select(*columns))
