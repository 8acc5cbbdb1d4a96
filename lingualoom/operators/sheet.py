"""Spreadsheet operators over cell, merge and width tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lingualoom.functions.search import last_at_most
from lingualoom.operators.spread import dealt_join, once_join, staged_with_hot

# ---- fixed values: spreadsheet limits and units --------------------------------------------------
CELL_LIMIT = 32_767
PX_TO_PT = 0.75
CELL_PADDING_PT = 1.5
DEFAULT_COLUMN_CHARS = 8.43
MOST_COLUMNS = 16_384
# ---- end of fixed values -------------------------------------------------------------------------


def cell_limit_error(text: Column) -> Column:
    return F.when(F.length(text) > CELL_LIMIT, F.lit("document_limit"))


def sheet_string_fanout(cells: DataFrame, shared: DataFrame) -> DataFrame:
    """One row per shared string in use: its text, its cells and where it is first shown.

    cells: doc_id, idx, pos (total order in the workbook), location.  An index outside the table
    is an error code.  Cells collapse to one row per string before the join, and a text that stands in
    many tables travels once.
    """
    used = cells.groupBy("doc_id", "idx").agg(
        F.min(F.struct("pos", "location")).alias("_first"), F.count("*").alias("cells")
    )
    place = F.col("_first.location")
    more = F.concat(place, F.lit(" (and "), (F.col("cells") - 1).cast("string"), F.lit(" more cells)"))
    return once_join(used, shared.select("doc_id", "idx", "text"), ["doc_id", "idx"], "text").select(
        "doc_id",
        "idx",
        "text",
        "cells",
        F.when(F.col("cells") > 1, more).otherwise(place).alias("location"),
        F.when(F.col("text").isNull(), F.lit("invalid_document")).alias("error_code"),
    )


def formula_literals(formula: Column) -> Column:
    """Quoted texts of a formula, with doubled quotes undone."""
    return F.transform(
        F.regexp_extract_all(formula, F.lit('"((?:[^"]|"")*+)"'), F.lit(1)),
        lambda x: F.replace(x, F.lit('""'), F.lit('"')),
    )


def formula_literal_match(formulas: DataFrame, translated: DataFrame) -> DataFrame:
    """Formula cells that compare against a text that was translated in the same document.

    formulas: doc_id, location, formula; translated: doc_id, text.  A literal may occur in very
    many cells, so the cell side is salted.
    """
    literals = formulas.select(
        "doc_id", "location", F.explode(F.array_distinct(formula_literals(F.col("formula")))).alias("text")
    )
    sources = translated.select("doc_id", "text").distinct()
    literals, hot = staged_with_hot(literals, ["doc_id", "text"], "literals")
    hits = dealt_join(literals, hot, sources, ["doc_id", "text"], "left_semi", ["location"])
    return hits.select("doc_id", "location").distinct()


# A tile of the sheet: cells that are looked up together.
TILE_ROWS, TILE_COLS = 4096, 64

_RANGE = ("ord", "c1", "r1", "c2", "r2")


def merge_range_lookup(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """cells(sheet, col, row, ...) with c1, r1, c2, r2 of the first merged range that holds them.

    Sheets are cut into tiles.  A range goes to the tiles it touches, a cell to its own, once; within a tile the
    ranges come first, the one with the smallest ``ord`` last, and each is painted over those before it, so
    that every cell finds its range at its own place.  A task holds one tile's places at a time, whatever
    the number of cells.  Cells outside any range are their own, and repeated cells come back as often as they were there.
    """
    names = cells.columns
    empty = F.lit(None).cast("int")
    looked = cells.select(
        F.struct(*names).alias("cell"), "sheet", F.floor(F.col("row") / TILE_ROWS).cast("int").alias("tr"), F.floor(F.col("col") / TILE_COLS).cast("int").alias("tc"),
        F.lit(1).alias("kind"), empty.alias("ord"), F.col("col").cast("int").alias("c1"), F.col("row").cast("int").alias("r1"), empty.alias("c2"), empty.alias("r2"),
    )
    tiles = lambda a, b, size: F.explode(F.sequence(F.floor(F.col(a) / size).cast("int"), F.floor(F.col(b) / size).cast("int")))
    touched = merges.select("sheet", *[F.col(c).cast("int").alias(c) for c in _RANGE])
    touched = touched.withColumn("tc", tiles("c1", "c2", TILE_COLS)).withColumn("tr", tiles("r1", "r2", TILE_ROWS))
    none = F.lit(None).cast(looked.schema["cell"].dataType)
    painted = touched.select(none.alias("cell"), "sheet", "tr", "tc", F.lit(0).alias("kind"), *_RANGE)
    tile = F.xxhash64("sheet", "tr", "tc")
    met = looked.unionByName(painted).withColumn("tile", tile).repartition("tile").sortWithinPartitions("tile", "kind", F.desc("ord"))
    fields = T.StructType([looked.schema["cell"], *[T.StructField(c, T.IntegerType()) for c in _RANGE]])
    found = met.select("cell", "tile", "kind", "tr", "tc", *_RANGE).mapInArrow(_look_up, fields)
    return found.select(
        "cell.*",
        F.col("ord").isNotNull().alias("merged"),
        F.coalesce("c1", "cell.col").alias("c1"),
        F.coalesce("r1", "cell.row").alias("r1"),
        F.coalesce("c2", "cell.col").alias("c2"),
        F.coalesce("r2", "cell.row").alias("r2"),
    )


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The painted range of each cell; rows come tile by tile, ranges before cells."""
    places = np.full((TILE_ROWS, TILE_COLS), -1, np.int32)
    at, ranges = None, []
    for batch in batches:
        tile, kind, tr, tc, *numbers = (np.asarray(batch.column(i).fill_null(0)) for i in range(1, 10))
        ends = np.flatnonzero(np.r_[(np.diff(tile) != 0) | (np.diff(kind) != 0), True]) + 1
        hits = np.full(batch.num_rows, -1, np.int64)
        known: list[tuple] = []
        for lo, hi in zip(np.r_[0, ends[:-1]], ends, strict=True):
            if tile[lo] != at:
                at = tile[lo]
                if ranges:
                    places.fill(-1)
                ranges = []
            if kind[lo] == 0:
                row, col = int(tr[lo]) * TILE_ROWS, int(tc[lo]) * TILE_COLS
                for x in zip(*(n[lo:hi].tolist() for n in numbers), strict=True):
                    _, c1, r1, c2, r2 = x
                    places[max(r1 - row, 0) : r2 - row + 1, max(c1 - col, 0) : c2 - col + 1] = len(ranges)
                    ranges.append(x)
            elif ranges:
                own = places[numbers[2][lo:hi] % TILE_ROWS, numbers[1][lo:hi] % TILE_COLS]
                hits[lo:hi] = np.where(own >= 0, own + len(known), -1)
                known += ranges
        cells = np.flatnonzero(kind == 1)
        hit = hits[cells]
        table = np.array(known or [(0,) * 5], np.int64)
        columns = [pa.array(table[np.maximum(hit, 0), i].astype(np.int32), mask=hit < 0) for i in range(5)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cells)), *columns], ["cell", *_RANGE])


def chars_to_pt(chars: Column, digit_px: int) -> Column:
    pixels = ((256 * chars + int(128 / digit_px)) / 256 * digit_px).cast("int")
    return pixels * F.lit(PX_TO_PT)


def range_width_sum(
    ranges: DataFrame, widths: DataFrame, digit_px: int = 7, default: float = DEFAULT_COLUMN_CHARS
) -> DataFrame:
    """Adds ``width_pt``: column widths over c1..c2, the default where a column has none.

    widths: sheet, col, chars.  A sheet has at most MOST_COLUMNS columns, so its own widths fit in a row, with what
    they add up to so far; a range takes the difference of two sums, each found by binary search.
    """
    extra = chars_to_pt(F.col("chars"), digit_px) - chars_to_pt(F.lit(default), digit_px)
    upto = Window.partitionBy("sheet").orderBy("col").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = widths.select("sheet", "col", F.sum(extra).over(upto).alias("sum"))
    per_sheet = sums.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("col", "sum"))).alias("_sums"))
    ranges, hot = staged_with_hot(ranges, ["sheet"], "ranges")
    joined = dealt_join(ranges, hot, per_sheet, ["sheet"], "left", ["c1", "r1"])

    def below(col: Column) -> Column:
        place = last_at_most(F.col("_sums"), col, MOST_COLUMNS, lambda s: s["col"])
        return F.coalesce(F.when(place >= 0, F.get("_sums", place)["sum"]), F.lit(0.0))

    base = (F.col("c2") - F.col("c1") + 1) * chars_to_pt(F.lit(default), digit_px)
    width = base + below(F.col("c2")) - below(F.col("c1") - 1) - 2 * CELL_PADDING_PT
    return joined.withColumn("width_pt", width).drop("_sums")


def neighbour_occupied(cells: DataFrame) -> DataFrame:
    """Adds ``clipped``: is the cell next to it, on the side its text would spill to, in use?

    cells: sheet, row, col, align.  Neighbours are the previous and next cell of the same row; a
    row has at most 2^14 cells, so the window is small and needs no join.
    """
    row = Window.partitionBy("sheet", "row").orderBy("col")
    left = F.coalesce(F.lag("col").over(row) == F.col("col") - 1, F.lit(False))
    right = F.coalesce(F.lead("col").over(row) == F.col("col") + 1, F.lit(False))
    clipped = F.when(F.col("align") == "right", left).when(
        F.col("align") == "center", left | right
    ).otherwise(right)
    return cells.withColumn("clipped", clipped)
