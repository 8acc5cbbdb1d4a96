"""Scores of a translation run: per segment, per direction, and the tables around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingualoom.functions import chrf as K
from lingualoom.functions import text as X

SCORABLE = ("translated", "complete")
COMPARABLE = ("complete",)


def all_directions(languages: DataFrame, lang: str, first: list[str]) -> DataFrame:
    """Ordered pairs of distinct languages; ``first`` gives the standard order, others follow.

    The set of languages is one short array, exploded twice; no join is needed.
    """
    place = F.array_position(F.array(*[F.lit(c) for c in first]), F.col(lang))
    ranked = F.struct(
        F.when(place > 0, place).otherwise(len(first) + 1).alias("rank"), F.col(lang).alias("code")
    )
    codes = languages.agg(F.array_sort(F.collect_set(ranked)).alias("all"))
    pairs = codes.select("all", F.posexplode("all").alias("_i", "a")).select(
        F.col("a.code").alias("source"),
        "_i",
        F.posexplode(F.filter("all", lambda x: x["code"] != F.col("a.code"))).alias("_j", "b"),
        F.size("all").alias("_n"),
    )
    return pairs.select(
        "source",
        F.col("b.code").alias("target"),
        F.concat_ws("-", "source", "b.code").alias("direction"),
        (F.col("_i") * (F.col("_n") - 1) + F.col("_j") + 1).alias("position"),
    )


def parse_direction(text: Column, languages: Column) -> Column:
    """``struct<source,target,error_code>`` of ``a-b``; unknown or equal languages are errors."""
    body = X.strip(text)
    source = F.substring_index(body, "-", 1)
    target = F.substring(body, F.length(source) + 2, F.length(body))
    known = F.array_contains(languages, source) & F.array_contains(languages, target)
    error = F.when(~known, F.lit("not_a_direction")).when(source == target, F.lit("same_language"))
    return F.struct(
        F.when(error.isNull(), source).alias("source"),
        F.when(error.isNull(), target).alias("target"),
        error.alias("error_code"),
    )


def prefix_limit(rows: DataFrame, group: list[str], order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows per group.  The filter on the rank prunes in every map task."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")


def status_gate(runs: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    return runs.filter(F.col("status").isin(*allowed))


def attach_scores(rows: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Scores meet rows by key, never by position; a row without a score stays visible."""
    return rows.join(scores, keys, "left")


def chrf_sentence(rows: DataFrame, hyp: str, ref: str, digits: int = 1) -> DataFrame:
    stats = rows.withColumn("_s", K.chrf_stats(F.col(hyp), F.col(ref)))
    score = K.f_score(lambda i: F.get(F.col("_s"), F.lit(i)))
    return stats.withColumn("chrf", F.round(score, digits)).drop("_s")


def chrf_corpus(rows: DataFrame, hyp: str, ref: str, by: list[str], digits: int = 4) -> DataFrame:
    """Corpus chrF per group: 18 counts per row, summed with map-side combine.

    What is shuffled is 18 numbers per group and map task, however long the texts are.
    """
    stats = rows.select(*by, K.chrf_stats(F.col(hyp), F.col(ref)).alias("_s"))
    sums = stats.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[F.sum(F.get("_s", F.lit(i))).alias(f"_{i}") for i in range(3 * K.ORDERS)],
    )
    score = K.f_score(lambda i: F.col(f"_{i}"))
    return sums.select(*by, "n", F.round(score, digits).alias("chrf"))


def direction_scores(scored: DataFrame, by: list[str], score: str) -> DataFrame:
    """n and mean segment score; an empty direction scores 0."""
    return scored.groupBy(*by).agg(
        F.count(score).alias("n"), F.round(F.coalesce(F.avg(score), F.lit(0.0)), 6).alias("comet")
    )


def direction_timing(batches: DataFrame, by: list[str]) -> DataFrame:
    """Seconds, segments and speed per direction from per-batch job metrics."""
    sums = batches.groupBy(*by).agg(
        F.round(F.sum("seconds"), 3).alias("seconds"), F.sum("segments").alias("segments")
    )
    speed = F.when(F.col("seconds") > 0, F.col("segments") / F.col("seconds")).otherwise(0.0)
    return sums.withColumn("segments_per_second", F.round(speed, 3))


def run_summary(scores: DataFrame, timings: DataFrame, by: list[str]) -> DataFrame:
    """Formatted scores with timings beside them, ``-`` where there are none."""
    joined = scores.join(timings, by, "left")
    return joined.select(
        *by,
        "n",
        F.format_string("%.4f", "comet").alias("comet"),
        F.format_string("%.2f", "chrf").alias("chrf"),
        F.when(
            F.col("segments_per_second").isNotNull(), F.format_string("%.2f", "segments_per_second")
        ).otherwise(F.lit("-")).alias("speed"),
        F.when(
            F.col("peak_rss_mb").isNotNull(), F.format_string("%.0f", "peak_rss_mb")
        ).otherwise(F.lit("-")).alias("memory"),
    )
