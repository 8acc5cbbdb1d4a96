"""Mixing sources to target weights by repeating documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingualoom.llm.words import word_count
from lingualoom.operators.spread import dense_index
from lingualoom.session import discard, stage

# Fixed values of the default mix: weights of the sources in order, and the most repeats.
WEIGHTS = (5, 2, 1)
MOST = 3
# Strings that divide the sources for numbering; they balance the work and change no result.
CUTS = 256


def _numbered(sizes: DataFrame) -> DataFrame:
    """Adds ``idx``: 0, 1, 2, ... in order of source by code point, null last."""
    some = sizes.filter(F.col("source").isNotNull()).orderBy(F.xxhash64("source"), "source").limit(CUTS)
    cuts = sorted({r[0] for r in some.select("source").collect()}, key=lambda s: s.encode())
    below = F.lit(0)
    if cuts:
        below = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("source")))
    bucket = F.when(F.col("source").isNull(), CUTS + 1).otherwise(below)
    return dense_index(sizes, [], bucket, ["source"])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` (one row per source).

    The sources in order weigh ``weights``, repeating, and share the sum of all sizes.  No target
    exceeds ``most`` times its source's size; what is above goes to the others by weight, again
    until none is above.  Each turn is one aggregate over the sources; the driver sees two numbers.
    """
    pattern = F.array(*map(F.lit, weights))
    rows = stage(
        _numbered(sizes).select(
            "source", "source_size", pattern[(F.col("idx") % len(weights)).cast("int")].cast("long").alias("weight")
        ),
        "source-weights",
    )
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, held = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.col("source_size") * most
        n, capped, free = rows.agg(
            F.count(F.when(above, 1)), F.sum(F.when(above, F.col("source_size") * most)), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if n == held or not free:
            break
        level, held = float(total - (capped or 0)) / float(free), n
    share = F.col("source_size").cast("double") * most
    if level is not None:
        share = F.least(share, F.col("weight").cast("double") * F.lit(level))
    return rows.select("source", "source_size", share.alias("target"))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on nothing but the seed and the keys."""
    text = F.concat_ws(":", F.lit(f"mix{seed}"), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix_counts(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 42,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", whole_row: bool = False,
) -> DataFrame:
    """``doc_id, size, source_size, target, copies`` (and the input as ``row``, if asked) for each row.

    ``size`` is the number of words (null: 0).  A document is taken ``floor(rate)`` times for
    ``rate = target / source_size``, and once more with a probability equal to the rest; the draw is
    a hash of seed and id, so reruns and retried tasks agree, and rows that repeat an id share
    their draw.  Rows without a source form one source, which comes last.  Sources without words have
    target 0, and their documents are not taken.  An empty table gives an empty result.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole_row else []
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *row
    )
    sums = stage(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    plan = stage(targets(sums, weights, most), "targets").withColumnRenamed("source", "_source")
    discard(sums)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = uniform(seed, F.col("doc_id")) < F.col("_rate") - F.floor("_rate")
    return (
        sized.join(plan, F.col("source").eqNullSafe(F.col("_source")), "left")
        .withColumn("_rate", rate)
        .withColumn("copies", (F.floor("_rate") + extra.cast("long")).cast("long"))
        .drop("_source", "source", "_rate")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 42) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; the copies of a row are equal."""
    counted = mix_counts(docs, weights, most, seed, whole_row=True).filter("copies > 0")
    return counted.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
