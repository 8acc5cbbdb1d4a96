"""Benchmark decontamination: winnowed fingerprints find shared passages, comparison extends them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingualoom.llm.words import ascii_lower, gram_hashes, let, words
from lingualoom.session import discard, stage

# What stands between two words once A-Z are in lower case, and a word before that.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]++"
SPAN = 10
GRAM = 6


def tokens(text: Column) -> Column:
    return words(ascii_lower(text), GAPS)


def winnowed(tokens_: Column, span: int = SPAN, gram: int = GRAM) -> Column:
    """``array<bigint>``: hashes of the grams that are the smallest of some window of the text.

    A window is ``span - gram + 1`` consecutive grams, that is ``span`` words, so texts that share a
    run of ``span`` words share the smallest hash of that run.
    """
    width = span - gram + 1

    def least(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(h) - (width - 1))
        return F.array_distinct(F.transform(starts, lambda i: F.array_min(F.slice(h, i, width))))

    none = F.array().cast("array<bigint>")
    return let(tokens_, lambda w: F.when(F.size(w) >= span, let(gram_hashes(w, gram), least)).otherwise(none))


def _placed(tokens_: Column, size: int) -> Column:
    """``array<struct<h, pos>>``: every gram of ``size`` words with its place, from 0."""
    return F.transform(gram_hashes(tokens_, size), lambda h, i: F.struct(h.alias("h"), i.alias("pos")))


def _index(items: DataFrame, span: int, gram: int) -> DataFrame:
    """``ikey, len, size, h, pos``: winnowed grams of the items; a short item is one gram of its size."""
    whole = F.array(F.struct(F.xxhash64("w").alias("h"), F.lit(0).alias("pos")))
    chosen = let(winnowed(F.col("w"), span, gram), lambda m: F.filter(_placed(F.col("w"), gram), lambda g: F.array_contains(m, g["h"])))
    short = F.size("w") < span
    return items.select(
        "ikey",
        F.size("w").alias("len"),
        F.when(short, F.size("w")).otherwise(gram).alias("size"),
        F.inline(F.when(short, whole).otherwise(chosen)),
    )


def _runs(part: Column, whole: Column, shift: Column, span: int) -> Column:
    """Maximal runs of equal words, at least ``span`` long or the whole item, as places in the document.

    ``part`` holds the document's words from place ``greatest(shift, 0)`` on; the item's word ``t``
    stands against the document's word ``t + shift``.
    """
    first = F.greatest(-shift, F.lit(0))
    last = F.least(F.size(whole), first + F.size(part)) - 1
    differ = F.filter(
        F.sequence(first, last), lambda t: whole[t] != part[t - first]
    )
    ends = F.concat(F.array(first - 1), differ, F.array(last + 1))
    long_enough = F.least(F.size(whole), F.lit(span))
    return F.when(
        last >= first,
        let(
            ends,
            lambda b: F.filter(
                F.transform(
                    F.sequence(F.lit(0), F.size(b) - 2),
                    lambda i: F.struct(
                        (b[i] + 1 + shift).alias("start"), (b[i + 1] - 1 + shift).alias("stop")
                    ),
                ),
                lambda r: r["stop"] - r["start"] + 1 >= long_enough,
            ),
        ),
    )


def _covered(spans: Column) -> Column:
    """How many places lie in at least one of the spans."""
    zero = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        F.array_sort(spans),
        zero,
        lambda a, s: F.struct(
            F.greatest(a["last"], s["stop"]).alias("last"),
            (a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"] - 1, a["last"])).cast("long")).alias("n"),
        ),
        lambda a: a["n"],
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    span: int = SPAN,
    gram: int = GRAM,
) -> DataFrame:
    """``k1, k2, n_hit, items, spans`` for each distinct text that shares a passage with an item.

    ``k1, k2`` are ``text_key`` of the text; ``items`` the distinct ids as strings in order; ``spans``
    the places of the shared words.  Every shared run of ``span`` words is found, and every
    occurrence of an item shorter than that.  Null and wordless texts and items share nothing; an
    item without an id counts for ``n_hit`` only.

    The winnowed grams of all documents meet those of the items by hash, which leaves few
    documents.  Those are looked at again: wherever one of their grams stands in an item too, the
    document, the item and the distance between them make one candidate, however many grams
    they share, and candidates are compared word by word.  Whether the item side is broadcast is
    left to Spark, which knows its size: it is written first.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("iid"), tokens(F.col(item_text)).alias("w"))
    items = stage(items.filter(F.size("w") > 0).withColumn("ikey", F.xxhash64("w")), "items")
    unique_items = items.select("ikey", "w").distinct()
    index = stage(_index(unique_items, span, gram), "item-grams")
    # At most `span` pairs of a size and whether it is that of short items.
    sizes = {(r[0], r[1]) for r in index.select("size", F.col("len") < span).distinct().collect()}
    short = sorted(size for size, is_short in sizes if is_short)

    rows = docs.select(*text_key(F.col(text_col)), tokens(F.col(text_col)).alias("w"))
    marks = [winnowed(F.col("w"), span, gram)] + [F.array_distinct(gram_hashes(F.col("w"), size)) for size in short]
    hashes = index.select("h").distinct()
    keys = None
    for mark in marks:
        met = rows.select("k1", "k2", F.explode(mark).alias("h")).join(hashes, "h", "left_semi").select("k1", "k2")
        keys = met if keys is None else keys.unionByName(met)
    keys = stage(keys.distinct(), "met-texts")
    # One text for each key, combined before the shuffle.
    texts = docs.select(*text_key(F.col(text_col)), F.col(text_col).alias("t")).join(keys, ["k1", "k2"], "left_semi")
    texts = stage(texts.groupBy("k1", "k2").agg(F.max("t").alias("t")).select("k1", "k2", tokens(F.col("t")).alias("w")), "met-words")
    shared = None
    for size in sorted({size for size, _ in sizes} | {gram}):
        placed = texts.select("k1", "k2", F.inline(_placed(F.col("w"), size)))
        both = placed.join(index.filter(F.col("size") == size).withColumnRenamed("pos", "ipos"), "h")
        shared = both if shared is None else shared.unionByName(both)
    candidates = shared.select("k1", "k2", "ikey", "len", (F.col("pos") - F.col("ipos")).alias("shift")).distinct()
    candidates = candidates.groupBy("k1", "k2").agg(F.collect_list(F.struct("ikey", "len", "shift")).alias("found"))
    opened = (
        texts.join(candidates, ["k1", "k2"])
        .select("k1", "k2", "w", F.explode("found").alias("f"))
        .select(
            "k1", "k2", "f.ikey", "f.shift",
            F.slice("w", F.greatest(F.col("f.shift"), F.lit(0)) + 1, F.col("f.len") + F.least(F.col("f.shift"), F.lit(0))).alias("part"),
        )
    )
    spans = opened.join(unique_items.withColumnRenamed("w", "whole"), "ikey").select(
        "k1", "k2", "ikey", F.explode(_runs(F.col("part"), F.col("whole"), F.col("shift"), span)).alias("span")
    )
    spans = stage(spans, "shared-spans")
    ids = spans.select("k1", "k2", "ikey").distinct().join(items.select("ikey", "iid").distinct(), "ikey")
    ids = ids.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("iid")).alias("items"))
    covered = spans.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    result = stage(
        covered.join(ids, ["k1", "k2"]).select("k1", "k2", _covered(F.col("spans")).alias("n_hit"), "items", "spans"),
        "contamination",
    )
    discard(items, index, keys, texts, spans)
    return result


def text_key(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes that stand for a text."""
    full = F.coalesce(text, F.lit(""))
    return F.xxhash64(full).alias("k1"), F.xxhash64(F.lit(7), full).alias("k2")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text shares a passage with an item of ``benchmark``."""
    found = contamination(docs, benchmark, text_col)
    k1, k2 = text_key(docs[text_col])
    hit = found.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
    return docs.join(hit, (k1 == F.col("_k1")) & (k2 == F.col("_k2")), "left_anti")
