"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingualoom.llm.words import let, words
from lingualoom.session import discard, stage

SHINGLE = 5
# Bins are numbered by the top 7 bits of a hash; of each bin's smallest hash the low 4 bits are kept.
BIN_BITS = 7
KEPT_BITS = 4
# Documents (by id) whose order is settled in one task.
STRETCH = 1 << 11


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of the runs of ``size`` words in lower case; a shorter text is one run, also if it has no words."""

    def hashed(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, size)))

    return let(words(F.lower(text)), hashed)


def sketch(text: Column, size: int = SHINGLE, bin_bits: int = BIN_BITS) -> Column:
    """``array<bigint>``: the smallest hash of each bin.

    All hashes are sorted once, so that bins lie one behind the other and each begins with its
    smallest.  An empty bin borrows from the first filled bin in an order of all bins that its own
    number determines, the same for every text (optimal densification, Shrivastava 2017).
    """
    bins = 1 << bin_bits
    mask = F.lit(bins - 1).cast("long")

    def bin_of(h: Column) -> Column:
        return F.shiftrightunsigned(h, 64 - bin_bits)

    def smallest(h: Column) -> Column:
        heads = F.filter(h, lambda x, i: (i == 0) | (bin_of(x.bitwiseXOR(h[F.greatest(i - 1, F.lit(0))])) != 0))
        return let(heads, densified)

    def densified(heads: Column) -> Column:
        return let(F.map_from_arrays(F.transform(heads, bin_of), heads), lambda filled: filled_up(filled, F.map_keys(filled)))

    def filled_up(filled: Column, numbers: Column) -> Column:
        def lender(b: Column) -> Column:
            ranks = F.transform(numbers, lambda j: F.xxhash64(b, j).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(j))
            return F.array_min(ranks).bitwiseAND(mask)

        def value(b: Column) -> Column:
            own = F.try_element_at(filled, b)
            return F.coalesce(own, F.try_element_at(filled, lender(b)))

        return F.transform(F.sequence(F.lit(0).cast("long"), mask), value)

    return let(F.sort_array(shingle_hashes(text, size)), smallest)


def packed(minima: Column, kept_bits: int = KEPT_BITS) -> Column:
    """``array<int>``: the low-order bits of each bin, mixed with its number.

    Without the number, bins that borrow from the same bin would agree or differ by chance all together.
    """
    return F.transform(minima, lambda h, i: F.xxhash64(h, i).bitwiseAND(F.lit((1 << kept_bits) - 1).cast("long")).cast("int"))


def as_hex(digits: Column) -> Column:
    """Four bits a character."""
    return F.array_join(F.transform(digits, lambda d: F.lower(F.hex(d.cast("long")))), "")


def likeness(a: Column, b: Column, kept_bits: int = KEPT_BITS) -> Column:
    """Estimated share of common shingles: matching bins, less what low-order bits match by chance (Li and Konig, 2010)."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)).cast("double") / F.size(a)
    chance = 1.0 / (1 << kept_bits)
    return F.greatest(F.lit(0.0), (equal - chance) / (1.0 - chance))


def fingerprint(text: Column, size: int = SHINGLE) -> Column:
    """The packed fingerprint of a text; null counts as empty, and equal texts have equal fingerprints."""
    return packed(sketch(F.coalesce(text, F.lit("")), size))


def with_next(rows: DataFrame, id_col: str, carried: list[str]) -> DataFrame:
    """Adds ``next`` (a struct of ``carried``): the row that follows in descending order of id, after the last the first.

    Ids are cut into stretches of STRETCH numbers; a stretch is ordered in one task.  The row that
    follows the smallest id of a stretch is the largest of the stretch below; those few rows are
    found by id and added to the stretch above.  Rows that repeat an id follow each other in order
    of their values, and rows without an id come last.
    """
    stretch = F.coalesce(F.floor(F.col(id_col) / STRETCH), F.lit(-(1 << 62)))
    values = F.struct(*carried)
    rows = rows.withColumn("_stretch", stretch)
    # Two numbers per stretch, and again two per STRETCH stretches: the stretch above each; the highest
    # one goes below the lowest.
    tops = rows.groupBy("_stretch").agg(F.max(id_col).alias("_top")).withColumn("_part", F.floor(F.col("_stretch") / STRETCH))
    tops = stage(tops, "stretches")
    parts = tops.groupBy("_part").agg(F.min("_stretch").alias("_low"))
    parts = parts.withColumn("_over", F.coalesce(F.lag("_low").over(Window.orderBy(F.desc("_part"))), F.min("_low").over(Window.partitionBy())))
    above = F.lag("_stretch").over(Window.partitionBy("_part").orderBy(F.desc("_stretch")))
    ordered = tops.join(parts, "_part").select("_stretch", "_top", F.coalesce(above, "_over").alias("_guest"))
    ordered = stage(ordered, "stretch-order")
    guests = (
        rows.join(ordered, (rows["_stretch"] == ordered["_stretch"]) & rows[id_col].eqNullSafe(ordered["_top"]), "inner")
        .select(ordered["_guest"].alias("_stretch"), F.col(id_col), values.alias("_values"))
    )
    guests = guests.groupBy("_stretch", id_col).agg(F.min("_values").alias("_values")).select("_stretch", F.lit(True).alias("_guest"), id_col, "_values")
    own = rows.select("_stretch", F.lit(False).alias("_guest"), id_col, values.alias("_values"))
    down = Window.partitionBy("_stretch").orderBy("_guest", F.col(id_col).desc_nulls_last(), "_values")
    both = own.unionByName(guests).withColumn("next", F.lead("_values").over(down))
    result = both.filter(~F.col("_guest")).select(id_col, "_values.*", "next")
    discard(tops)
    return result


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_chars, edited, own, edited_print, next_print`` for each row.

    The edited text is the text with its last half replaced by the beginning of the next text in
    descending order of id.  Null is an empty text; rows that repeat an id are in order of their
    text, rows without an id come last; a table of one row has itself as next.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t")).withColumn("own", fingerprint(F.col("t")))
    rows = with_next(rows, "id", ["t", "own"])
    n = F.length("t")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("t", F.lit(1), n - half), F.substr("next.t", F.lit(1), half))
    rows = rows.select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", F.col("next.own").alias("next_print"))
    return rows.withColumn("edited_print", fingerprint(F.col("edited")))
