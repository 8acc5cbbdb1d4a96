"""A whole translation job: route, protect, ask each input once, remember, rebuild, report."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingualoom.functions import protect as P
from lingualoom.functions import text as X
from lingualoom.operators import report, units
from lingualoom.operators.spread import spread_join
from lingualoom.plans.corpus import rebuild_documents
from lingualoom.session import stage
from lingualoom.sources import text as S

# DataFrame(unit_key, unit_text, lang) -> DataFrame(unit_key, output[, error_code]); see infer.translate_units.
Translate = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Result:
    """documents: doc_id, text, error_code, note, lost; counts: one report row per translated document;
    memory: unit_key, unit_text, lang, output of what was asked and answered this time.
    Documents are put together when they are first named; a job that only fills a memory never does."""

    rebuild: Callable[[], DataFrame]
    counts: DataFrame
    memory: DataFrame

    @cached_property
    def documents(self) -> DataFrame:
        return self.rebuild()


@dataclass(frozen=True)
class Prepared:
    """What a job needs of its documents and no engine changes: see ``prepare``."""

    copies: DataFrame
    lines: DataFrame

    def where(self, condition: Column) -> Prepared:
        """Only some documents; the condition names ``doc_id``."""
        return Prepared(self.copies.filter(condition), self.lines.filter(condition))


def prepare(docs: DataFrame, target: str, lang: str = "lang", terms: Sequence[str] = ()) -> Prepared:
    """Documents routed, and those to translate cut into lines with their engine inputs, written once.

    Jobs on the same documents with other engines or memories can share it (``translate_prepared``).
    """
    routed = report.route_unchanged(docs.select("doc_id", "text", lang), lang, target)
    copies = routed.filter("route = 'copy'").select("doc_id", "text", F.lit(None).cast("string").alias("error_code"), "note", F.lit(0).cast("long").alias("lost"))
    lines = S.scan_txt_lines(routed.filter("route = 'translate'"), keep=(lang,)).drop("location", "is_segment")
    # Inputs and occurrences both read it, and the patterns are what costs.  Most inputs are the line itself.
    rows = _inputs(lines, lang, terms).withColumnRenamed(lang, "lang")
    told = stage(rows.withColumn("unit_text", F.nullif("unit_text", "line")), "occurrences")
    return Prepared(copies, told.withColumn("unit_text", F.when(~F.col("passed"), F.coalesce("unit_text", "line"))))


def _inputs(lines: DataFrame, lang: str, terms: Sequence[str]) -> DataFrame:
    """Lines with the texts they keep and the whitespace around them, whether they pass, and their engine input."""
    rows, core = lines.withColumn("_core", X.strip_column(F.col("line"))), F.col("_core")
    if terms:
        rows = rows.withColumn("_spans", P.spans_with_terms(terms)(core))
        rows = rows.withColumn("_kept", P.span_texts(core, F.col("_spans"))).withColumn("_input", P.encode_line_with_terms(core, F.col("_spans")))
        rows = rows.withColumn("_rest", F.regexp_replace("_input", "<x[0-9]+/>", "")).drop("_spans")
        passed = P.passes_through(F.col("_rest"), F.col(lang))
    else:
        rows = P.with_protection(rows, "_core")
        # What stood on both sides of a span may be one where they meet.
        meets = (F.size("_kept") > 0) & P.may_hold_span(F.col("_rest"))
        rest, code = F.col("_rest"), F.col(lang)
        passed = F.when(meets, P.passes_through(rest, code)).otherwise(P.nothing_to_translate(rest, code))
    rows = rows.withColumn("passed", passed).withColumn("unit_text", F.when(~F.col("passed"), F.col("_input"))).drop("_input", "_rest")
    return units.around_core(rows).drop("_core")


def translate_documents(
    docs: DataFrame,
    translate: Translate,
    target: str,
    fingerprint: str,
    lang: str = "lang",
    terms: Sequence[str] = (),
    memory: DataFrame | None = None,
    force: bool = False,
    keep_source: bool = False,
) -> Result:
    """Translate ``docs`` (doc_id, text and their language) with any engine.

    Documents without a language or in the target's come back as they are, with a note.  Addresses,
    paths and ``terms`` are kept.  Each distinct input of a language is looked up in ``memory``
    (unit_key, output) unless ``force``, and the engine sees only what is missing there, once.
    A line without an answer makes its document an error without text, or keeps its source line if
    ``keep_source``; either way it is counted in ``lost``.
    """
    return translate_prepared(prepare(docs, target, lang, terms), translate, target, fingerprint, memory, force, keep_source)


def translate_prepared(
    prepared: Prepared,
    translate: Translate,
    target: str,
    fingerprint: str,
    memory: DataFrame | None = None,
    force: bool = False,
    keep_source: bool = False,
) -> Result:
    """``translate_documents`` for documents that are already cut into lines."""
    lang, copies = "lang", prepared.copies
    key = units.input_key(F.col("unit_text"), F.col(lang), target, fingerprint)
    occ = prepared.lines.withColumn("unit_key", key)
    # A text and its language decide its key, which is then made for distinct ones only.
    distinct = prepared.lines.filter(F.col("unit_text").isNotNull()).groupBy(lang, "unit_text").agg(F.count("*").alias("n_occ"))
    distinct = distinct.withColumn("unit_key", key)
    known = memory.select("unit_key", "output") if memory is not None else None
    if known is None:
        looked = distinct.withColumn("output", F.lit(None).cast("string")).withColumn("hit", F.lit(False))
    else:
        looked = units.cache_lookup(distinct, known, ["unit_key"], force)
    looked = stage(looked, "lookup")
    asked = looked.filter(~F.col("hit")).select("unit_key", "unit_text", "lang")
    answers = stage(translate(asked).select("unit_key", F.col("output").alias("_new")), "answers")

    def rebuild() -> DataFrame:
        answered = looked.join(answers, "unit_key", "left").withColumn("output", F.coalesce("output", "_new"))
        answered = stage(answered.select("unit_key", "n_occ", "output"), "answered")
        # Lines that are translated need not travel.
        own = occ.withColumn("_own", F.when(F.col("passed"), F.col("line")))
        joined = spread_join(own, answered, "unit_key", "n_occ", "output", ["doc_id", "seg_no"])
        filled = F.concat("leading", P.fill_spans(F.col("output"), F.col("_kept")), "trailing")
        done = joined.withColumn("translated", F.when(F.col("passed"), F.col("_own")).otherwise(filled))
        done = done.withColumn("_lost", F.col("translated").isNull())
        if keep_source:
            done = units.fallback_to_source(done, "translated", "line")
        rebuilt = rebuild_documents(done, F.count_if("_lost").alias("_lost"))
        rebuilt = rebuilt.select("doc_id", "text", "error_code", F.lit(None).cast("string").alias("note"), F.col("_lost").alias("lost"))
        return copies.unionByName(rebuilt)

    nonblank = occ.filter(~X.is_blank(F.col("line")))
    fresh = asked.join(answers, "unit_key").filter(F.col("_new").isNotNull())
    return Result(
        rebuild=rebuild,
        counts=report.segment_counts(nonblank),
        memory=fresh.select("unit_key", "unit_text", "lang", F.col("_new").alias("output")),
    )
