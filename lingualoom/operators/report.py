"""Per-document counts, capped diagnostics and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingualoom.functions import text as X
from lingualoom.operators.ranks import at_ranks

MAX_LOCATED = 100


def segment_counts(
    occ: DataFrame, fallback: Column | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """segments, passed_through, unique_inputs and formatting_fallbacks per document.

    The distinct count is two-level: (document, input) pairs are counted first, spread over both
    columns, so one very large document is not one task's work.
    """
    pairs = occ.groupBy("doc_id", *keep, "unit_key").agg(
        F.count("*").alias("_n"),
        F.count_if(F.col("passed")).alias("_passed"),
        F.count_if(fallback if fallback is not None else F.lit(False)).alias("_fallbacks"),
    )
    return pairs.groupBy("doc_id", *keep).agg(
        F.sum("_n").alias("segments"),
        F.sum("_passed").alias("passed_through"),
        F.count("unit_key").alias("unique_inputs"),
        F.sum("_fallbacks").alias("formatting_fallbacks"),
    )


def capped_diagnostics(
    located: DataFrame, group: list[str], order: list[str], cap: int = MAX_LOCATED
) -> DataFrame:
    """The first ``cap`` located rows of each group, then one row counting the rest.

    ``row_number() <= cap`` is evaluated in every map task before the shuffle (window group
    limit), and the overflow is a count; no group is ever gathered.
    """
    ranked = located.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    )
    listed = ranked.filter(F.col("_rank") <= cap).select(
        *group, F.col("location"), F.lit(1).cast("long").alias("count")
    )
    rest = (
        located.groupBy(*group)
        .agg((F.count("*") - cap).alias("count"))
        .filter(F.col("count") > 0)
        .select(*group, F.lit(None).cast("string").alias("location"), "count")
    )
    return listed.unionByName(rest)


def leftover_script(parts: DataFrame, text: str, lang: Column, by: list[str]) -> DataFrame:
    """Source-script characters that are still there after translation."""
    return parts.groupBy(*by).agg(
        F.sum(X.script_letters(F.col(text), lang)).alias("leftover")
    )


def unsupported_counts(findings: DataFrame) -> DataFrame:
    """One diagnostic per document and code."""
    return findings.groupBy("doc_id", "code").agg(F.sum("count").alias("count"))


def route_unchanged(docs: DataFrame, source: str, target: str) -> DataFrame:
    """Adds ``route``: ``copy`` (with the reason) or ``translate``."""
    reason = F.when(F.col(source).isNull(), F.lit("no_translatable_text")).when(
        F.col(source) == target, F.lit("already_target_language")
    )
    return docs.withColumn("note", reason).withColumn(
        "route", F.when(reason.isNotNull(), F.lit("copy")).otherwise(F.lit("translate"))
    )


def report_json(reports: DataFrame, columns: list[str]) -> DataFrame:
    """Result rows as JSON without any document text."""
    return reports.select("doc_id", F.to_json(F.struct(*columns)).alias("report"))


def _middle(n: Column) -> tuple[Column, Column]:
    return F.floor((n - 1) / 2), F.floor(n / 2)


def _median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The exact median of each group by rank."""
    found = at_ranks(rows, by, value, _middle)
    return found.select(*by, ((F.col("low") + F.col("high")) / 2).alias(f"median_{value}"))


def repeat_summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """Median speed and quality of repeated runs, with the range.

    Medians are those of the values as they are, taken by rank.
    """
    summary = runs.groupBy(*by).agg(
        F.count("*").alias("n"), F.min("speed").alias("min_speed"), F.max("speed").alias("max_speed")
    )
    for value in ("speed", "chrf"):
        summary = summary.join(_median(runs.select(*by, value), by, value), by, "left").withColumn(
            f"median_{value}", F.round(f"median_{value}", 4)
        )
    return summary.select(*by, "n", "median_speed", "median_chrf", "min_speed", "max_speed")


def validity_summary(cases: DataFrame, by: list[str]) -> DataFrame:
    """Cases, valid ones, and the mean quality over valid cases only."""
    valid = F.col("failure").isNull()
    return cases.groupBy(*by).agg(
        F.count("*").alias("cases"),
        F.count_if(valid).alias("valid"),
        F.round(F.avg(F.when(valid, F.col("chrf"))), 1).alias("mean_chrf_valid"),
    )


def failure_counts(cases: DataFrame, by: list[str]) -> DataFrame:
    return (
        cases.filter(F.col("failure").isNotNull())
        .groupBy(*by, "failure")
        .agg(F.count("*").alias("n"))
    )


def estimate_errors(cases: DataFrame) -> DataFrame:
    """Adds line differences and the relative height error of each estimate."""
    relative = (F.col("our_height") - F.col("true_height")) / F.col("true_height")
    return cases.withColumn(
        "line_diff", F.abs(F.col("our_lines") - F.col("true_lines"))
    ).withColumn("rel_error", F.round(relative, 4))


def _listed(n: Column) -> tuple[Column, Column]:
    """Element ``int(n*0.95)-1`` of a sorted list, counted from the end when negative."""
    at = F.floor(n * F.lit(0.95)) - 1
    at = F.when(at < 0, at + n).otherwise(at)
    return at, at


def estimate_error_summary(cases: DataFrame) -> DataFrame:
    """One row: exact and off-by-one line counts; median, p95 and maximum relative error."""
    errors = estimate_errors(cases).withColumn("_size", F.abs("rel_error"))
    main = errors.agg(
        F.count("*").alias("cases"),
        F.count_if(F.col("line_diff") == 0).alias("lines_exact"),
        F.count_if(F.col("line_diff") == 1).alias("lines_off_by_one"),
        F.max("_size").alias("max_error"),
    )
    middle = at_ranks(errors.select("_size"), [], "_size", _middle)
    median = middle.select(F.lit(1).alias("_one"), F.round((F.col("low") + F.col("high")) / 2, 4).alias("median_error"))
    tail = at_ranks(errors.select("_size"), [], "_size", _listed).select(F.lit(1).alias("_one"), F.col("low").alias("p95"))
    joined = main.withColumn("_one", F.lit(1)).join(median, "_one", "left").join(tail, "_one", "left")
    return joined.select("cases", "lines_exact", "lines_off_by_one", "median_error", "max_error", "p95")


def estimate_error_by_font(cases: DataFrame, by: list[str]) -> DataFrame:
    return estimate_errors(cases).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("line_diff") == 0).alias("lines_exact"),
        F.round(F.avg("rel_error"), 4).alias("mean_error"),
    )
