"""Paragraphs as rows: normalise, weigh styles, encode for an engine, and join pieces.

Paragraph table: doc_id, seg_no and ``nodes``, the paragraph's tree as ``functions.nodes`` describes it.
A paragraph stays one row from the scan to the distinct engine inputs; only ``paragraphs`` gathers
node rows (doc_id, seg_no, pos, kind, text, style, key) and only ``rows`` gives them back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingualoom.functions import nodes as N
from lingualoom.functions import protect as P
from lingualoom.functions import tags as G

SEG = ["doc_id", "seg_no"]


def paragraphs(node_rows: DataFrame) -> DataFrame:
    """One row per paragraph, from node rows."""
    node = F.struct(*[F.col(f).cast("string" if f in ("kind", "text") else "int").alias(f) for f in N.FIELDS])
    return node_rows.groupBy(*SEG).agg(F.array_sort(F.collect_list(node)).alias("nodes"))


def rows(paragraphs: DataFrame) -> DataFrame:
    """Node rows of paragraphs."""
    return taken_apart(paragraphs, F.inline_outer("nodes"), "kind")


def taken_apart(paragraphs: DataFrame, parts: Column, told: str) -> DataFrame:
    """Rows of an outer generator without those of empty lists, where ``told`` is NULL.

    Below an inner generator Spark filters by the list's size, which would make every list twice.
    """
    return paragraphs.select(*SEG, parts).filter(F.col(told).isNotNull())


def visible_text(paragraphs: DataFrame, kinds: tuple[str, ...] = ("text", "keep")) -> DataFrame:
    """Text of each paragraph: what is visible, or with ``("text",)`` what may be translated."""
    return paragraphs.select(*SEG, N.visible_text(F.col("nodes"), kinds).alias("text"))


def normalize_nodes(paragraphs: DataFrame) -> DataFrame:
    """Empty text goes, whitespace-only text takes a neighbour's style, equal neighbours merge."""
    return paragraphs.withColumn("nodes", N.normalized(F.col("nodes")))


def _keep(paragraphs: DataFrame, found: Column) -> DataFrame:
    # The places are a column of their own, so that nothing evaluates them for each node.
    told = paragraphs.withColumn("_found", found)
    return told.withColumn("nodes", N.split_spans(F.col("nodes"), F.col("_found"))).drop("_found")


def keep_spans(paragraphs: DataFrame, terms: Sequence[str] = ()) -> DataFrame:
    """Addresses, paths, tag-like text and ``terms`` in text nodes become keep nodes, which no engine sees.

    Places are numbered anew within each paragraph.
    """
    some = P.Terms(terms)
    found = some.spans_of_each(N.texts(F.col("nodes"))) if some.terms else N.spans_of_each(F.col("nodes"), P.plain_spans)
    return _keep(paragraphs, found)


def keep_tag_like(paragraphs: DataFrame) -> DataFrame:
    """Text that looks like one of our own tags becomes a keep node, so that encoding can't confuse the two."""
    return _keep(paragraphs, N.spans_of_each(F.col("nodes"), P.tag_like_spans))


def dominant_style(normalized: DataFrame) -> DataFrame:
    return normalized.select(*SEG, N.base_style(F.col("nodes")).alias("base_style"))


def style_ids(runs: DataFrame, properties: str) -> DataFrame:
    """doc_id, properties, style: small ids per document in order of first appearance."""
    first = runs.groupBy("doc_id", properties).agg(
        F.min(F.struct("seg_no", "pos")).alias("_first")
    )
    # Distinct property sets of one document are few: styles, not runs, are ranked.
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("_first")) - 1
    return first.withColumn("style", rank).drop("_first")


def encode_tags(normalized: DataFrame) -> DataFrame:
    """doc_id, seg_no, unit_text, base_style, groups, objects; a paragraph without nodes has no row."""
    told = normalized.select(*SEG, N.encoded(F.col("nodes")).alias("_told"))
    return told.filter(F.col("_told").isNotNull()).select(*SEG, "_told.*")


def validate_tags(encoded: DataFrame, output: str = "output") -> DataFrame:
    """Adds ``reason``: why the output does not correspond to ``unit_text``, or NULL."""
    return encoded.withColumn("reason", G.failure(F.col("unit_text"), F.col(output), F.col("groups")))


def project_spans(failed: DataFrame) -> DataFrame:
    """Adds ``projected``: unit_text's tags set into ``plain`` with ``spans``, validated, or NULL."""
    return failed.withColumn(
        "projected", G.projected(F.col("unit_text"), F.col("plain"), F.col("groups"), F.col("spans"))
    )


def decode_tags(answered: DataFrame, output: str = "output") -> DataFrame:
    """Validated outputs back to normalised paragraphs with the source's styles and wrappers."""
    nodes = G.decode(F.col(output), F.col("base_style"), F.col("groups"), F.col("objects"))
    return normalize_nodes(answered.select(*SEG, nodes.alias("nodes")))


def segmented_pieces(normalized: DataFrame) -> DataFrame:
    """The text leaves, in order, for translation one by one; ``leaf`` is a leaf's number among them."""
    leaves = F.filter("nodes", lambda n: n["kind"] == "text")
    return taken_apart(normalized, F.posexplode_outer(leaves).alias("leaf", "n"), "leaf").select(*SEG, "leaf", "n.pos", "n.text")


def join_segmented(translated: DataFrame, latin_target: bool) -> DataFrame:
    """Normalised paragraphs rebuilt from separately translated leaves.

    translated: normalised paragraphs with ``translations``, one entry per text leaf (NULL keeps the text).
    """
    return translated.select(*SEG, N.joined(F.col("nodes"), F.col("translations"), latin_target).alias("nodes"))
