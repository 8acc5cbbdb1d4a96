"""Whole jobs over a document corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingualoom.functions import text as X
from lingualoom.operators import infer, units
from lingualoom.session import stage
from lingualoom.sources import text as S


def translate_lines(
    docs: DataFrame, target: str, lang: str = "lang", every_line: bool = False
) -> DataFrame:
    """documents -> segments -> unique inputs -> marker engine -> every occurrence.

    One shuffle for the distinct inputs and one for the join back; the marker engine is a native
    expression, so nothing leaves the JVM.  The occurrences are written down, since inputs and the
    way back both read them and the patterns are what costs; the answers too, as after any engine.
    ``every_line`` keeps blank lines and line endings, for rebuilding files.
    """
    lines = S.scan_txt_lines(docs, keep=(lang,)).drop("location", "is_segment") if every_line else S.scan_segments(docs, keep=(lang,))
    occ = stage(units.placed_occurrences(lines, lang), "occurrences")
    distinct = units.unique_units(occ)
    answered = stage(
        distinct.select(
            "unit_key",
            "n_occ",
            infer.marker_translate(F.col("unit_text"), F.lit(target)).alias("output"),
        ),
        "answers",
    )
    return units.join_back(occ, answered)


def translation_report(docs: DataFrame, target: str, lang: str = "lang") -> DataFrame:
    """One row per document: counts and the size of its translation."""
    done = translate_lines(docs, target, lang)
    pairs = done.groupBy("doc_id", "unit_key").agg(
        F.count("*").alias("_n"),
        F.count_if(F.col("passed")).alias("_passed"),
        F.sum(F.length("translated")).alias("_chars"),
    )
    return pairs.groupBy("doc_id").agg(
        F.sum("_n").alias("segments"),
        F.sum("_passed").alias("passed_through"),
        F.count("unit_key").alias("unique_inputs"),
        F.sum("_chars").alias("output_chars"),
    )


def rebuild_documents(translated: DataFrame, *also: Column) -> DataFrame:
    """doc_id, text, error_code, lost: original line structure with translated lines in it.

    translated: every line with its ending (``translate_lines(..., every_line=True)``), so nothing
    is joined again; ``translated`` of a line that passes is the line itself.  ``also`` are further
    aggregates of a document's lines.  A document with a line that has no translation has no text, an error code
    and the number of such lines; apply ``units.fallback_to_source`` first to keep the original
    there instead.  A file is one row by nature, and ``doc_limits`` keeps any file bounded.
    """
    line = X.one_line(F.col("translated"))
    piece = F.struct("seg_no", F.concat(line, F.col("ending")).alias("text"))
    whole = translated.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["text"]), "").alias("_text"),
        F.count_if(F.col("translated").isNull()).alias("lost"),
        *also,
    )
    failed = F.col("lost") > 0
    return whole.select(
        "doc_id", F.when(~failed, F.col("_text")).alias("text"), F.when(failed, F.lit("engine_response")).alias("error_code"), "lost",
        *whole.columns[3:],
    )
