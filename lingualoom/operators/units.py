"""Deduplication of engine inputs and the way back to every occurrence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingualoom.functions import protect as P
from lingualoom.functions import text as X
from lingualoom.operators.spread import dense_index, spread_join

PIPELINE_BATCH = 64


def unit_key(text: Column) -> Column:
    """A short fixed-size key, so that long texts are shuffled once and not in every join."""
    return F.sha2(text, 256)


def input_key(text: Column, lang: Column, target: str, fingerprint: str) -> Column:
    """What an answer depends on: both languages, the engine and the text."""
    parts = F.struct(F.coalesce(lang, F.lit("")).alias("s"), F.lit(target).alias("t"), F.lit(fingerprint).alias("f"), text.alias("x"))
    return F.when(text.isNotNull(), F.sha2(F.to_json(parts), 256))


def occurrences(segments: DataFrame, lang: str = "lang", line: str = "line") -> DataFrame:
    """Segments split into whitespace and core, with the engine input of the core.

    ``passed`` rows have nothing to translate and carry no key.  All native, one pass.
    """
    return _placed(segments, lang, line).drop("_core", "_kept")


def _placed(segments: DataFrame, lang: str, line: str) -> DataFrame:
    """``occurrences`` with the stripped line and the texts it keeps."""
    rows = P.with_protection(segments.withColumn("_core", X.strip_column(F.col(line))), "_core")
    rows = rows.withColumn("passed", P.nothing_to_translate(F.col("_rest"), F.col(lang)))
    rows = rows.withColumn("unit_text", F.when(~F.col("passed"), F.col("_input"))).drop("_input", "_rest")
    return rows.withColumn("unit_key", unit_key(F.col("unit_text")))


def placed_occurrences(segments: DataFrame, lang: str = "lang") -> DataFrame:
    """``occurrences`` with ``leading``, ``trailing`` and ``kept``, from which ``join_back`` makes the line again."""
    return around_core(_placed(segments, lang, "line").withColumnRenamed("_kept", "kept")).drop("_core")


def around_core(rows: DataFrame) -> DataFrame:
    """Adds ``leading`` and ``trailing``: what ``line`` holds around ``_core``; all of a blank one is leading."""
    line, core, size = F.col("line"), F.col("_core"), F.octet_length
    whole = size(line) == size(core)
    trailing = F.substring(line, F.length("leading") + F.length(core) + 1, F.length(line))
    return rows.withColumn("leading", F.when(whole, "").otherwise(X.leading_ws(line))).withColumn(
        "trailing", F.when(whole | (core == ""), "").otherwise(trailing)
    )


def engine_inputs(
    segments: DataFrame, lang: str = "lang", line: str = "line", keep: Sequence[str] = ()
) -> DataFrame:
    """Only what an engine has to see: keep, unit_text, unit_key of segments that do not pass.

    The rows are made by an outer ``explode`` of a list that is NULL for passed segments, and those
    are dropped behind it.  Any other filter, and the one that Spark puts below an inner ``explode``,
    would be pushed below the projection, and every pattern would run once there and once again here.
    """
    rows = _placed(segments, lang, line).drop("unit_key")
    wanted = F.when(~F.col("passed"), F.array("unit_text"))
    inputs = rows.select(*keep, F.explode_outer(wanted).alias("unit_text")).filter(F.col("unit_text").isNotNull())
    return inputs.withColumn("unit_key", unit_key(F.col("unit_text")))


def unique_units(
    occ: DataFrame, key: str = "unit_key", text: str = "unit_text", group: Sequence[str] = ()
) -> DataFrame:
    """One row per distinct engine input with its number of occurrences.

    Partial aggregation collapses repeated lines before the shuffle, so boilerplate that fills a
    third of the corpus costs one row per map task.
    """
    wanted = occ.filter(F.col(text).isNotNull())
    return wanted.groupBy(*group, key, text).agg(F.count("*").alias("n_occ"))


def first_seen(
    occ: DataFrame, text: str = "unit_text", order: Sequence[str] = ("doc_id", "seg_no")
) -> DataFrame:
    """Distinct inputs with their first position in the total order (document, segment)."""
    return (
        occ.filter(F.col(text).isNotNull())
        .groupBy(text)
        .agg(F.count("*").alias("n_occ"), F.min(F.struct(*order)).alias("_first"))
        .select(text, "n_occ", *[F.col(f"_first.{c}").alias(f"first_{c}") for c in order])
    )


def unique_texts(texts: DataFrame, text: str) -> DataFrame:
    """Distinct stripped texts; blank ones never reach an engine."""
    core = X.strip(F.col(text))
    return texts.select(core.alias("core")).filter(F.col("core") != "").distinct()


def batch_assign(units: DataFrame, group: list[str], order: list[str], size: int) -> DataFrame:
    """Adds ``batch`` = first-seen rank div ``size`` inside each group, by spans of positions."""
    bucket = F.floor(F.col(order[0]) / 1024)
    return (
        dense_index(units, group, bucket, order)
        .withColumn("batch", F.floor(F.col("idx") / size))
        .drop("idx")
    )


def join_back(occ: DataFrame, translations: DataFrame) -> DataFrame:
    """Every occurrence gets its unit's output; passed segments keep their own text.

    ``occ``: ``placed_occurrences``; ``translations``: unit_key, n_occ, output.  Lines that are
    translated need not travel, so only those that pass are named behind the join.
    """
    joined = spread_join(
        occ.withColumn("_own", F.when(F.col("passed"), F.col("line"))),
        translations, "unit_key", "n_occ", "output", ["doc_id", "seg_no"],
    )
    rebuilt = F.concat("leading", P.fill_spans(F.col("output"), F.col("kept")), "trailing")
    return joined.withColumn("translated", F.when(F.col("passed"), F.col("_own")).otherwise(rebuilt)).drop(
        "_own", "leading", "trailing", "kept"
    )


def count_guard(requested: DataFrame, answered: DataFrame, key: str) -> DataFrame:
    """One row: requested, answered, and what either side lacks (both must be 0)."""
    pairs = requested.select(F.col(key), F.lit(1).alias("_a")).join(
        answered.select(F.col(key), F.lit(1).alias("_b")), key, "full_outer"
    )
    return pairs.agg(
        F.count("_a").alias("requested"),
        F.count("_b").alias("answered"),
        F.count_if(F.col("_b").isNull()).alias("missing"),
        F.count_if(F.col("_a").isNull()).alias("unexpected"),
    )


def fallback_to_source(translated: DataFrame, output: str, source: str) -> DataFrame:
    """Policy of keeping the original where the engine gave nothing."""
    return translated.withColumn(output, F.coalesce(F.col(output), F.col(source)))


# ---- translation memory --------------------------------------------------------------------------


def memory_hits(units: DataFrame, memory: DataFrame, keys: list[str]) -> DataFrame:
    return units.join(memory, keys, "left_semi")


def memory_misses(units: DataFrame, memory: DataFrame, keys: list[str]) -> DataFrame:
    return units.join(memory, keys, "left_anti")


def cache_lookup(
    units: DataFrame, memory: DataFrame, keys: list[str], force: bool = False
) -> DataFrame:
    """Units with ``hit`` and the remembered output; ``force`` treats everything as a miss."""
    remembered = memory.select(*keys, "output", F.lit(True).alias("_known"))
    found = units.join(remembered, keys, "left")
    hit = F.coalesce(F.col("_known"), F.lit(False)) & F.lit(not force)
    return found.withColumn("hit", hit).withColumn(
        "output", F.when(F.col("hit"), F.col("output"))
    ).drop("_known")


def memory_upsert(memory: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The memory after a batch: a forced row replaces, otherwise the first winner stays.

    Both tables: keys, output, forced, created_at, failed.  Failed output is never stored.  A
    ``min_by`` per key needs no sort and combines before the shuffle.
    """
    both = memory.unionByName(fresh).filter(~F.col("failed") & F.col("output").isNotNull())
    age = F.unix_micros(F.col("created_at").cast("timestamp"))
    rank = F.struct(
        F.when(F.col("forced"), 0).otherwise(1),
        F.when(F.col("forced"), -age).otherwise(age),
        F.col("output"),
    )
    best = both.groupBy(*keys).agg(
        F.min_by(F.struct("output", "forced", "created_at"), rank).alias("_best")
    )
    return best.select(*keys, "_best.output", "_best.forced", "_best.created_at")
