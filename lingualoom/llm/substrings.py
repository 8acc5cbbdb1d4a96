"""Exact substring deduplication with fixed-block anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingualoom.llm.words import split_bytes, word_count
from lingualoom.session import discard, stage

SPAN = 20
# Any run of SPAN words holds a whole block of BLOCK words, wherever the blocks begin.
BLOCK = 10
# Words that a task hashes at once, and bytes of text whose windows share a bucket.
CHUNK = 1 << 20
BUCKET_BYTES = 8 << 20
NO_ID = (1 << 63) - 1

_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd multipliers of the two window hashes
_CELLS = "bucket int, known boolean, ids binary, keys binary, counts binary, pos binary, code binary, check binary"
_REPLIES = "part int, ids binary, keys binary, counts binary, pos binary"
_PLACES = "id long, key int, pos array<int>"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, key, t``: rows that repeat an id are told apart by a hash of the text; no id comes last."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.hash(text_col).alias("key"), F.col(text_col).alias("t")
    )


class _Rolling:
    """Hashes of all windows of ``width`` consecutive words in a run of word hashes."""

    def __init__(self, mix: int):
        self.mix, self.up, self.down = mix, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, words: np.ndarray, width: int) -> np.ndarray:
        if len(self.up) <= len(words):
            n = len(words) + 1
            with np.errstate(over="ignore"):
                for name, base in (("up", self.mix), ("down", pow(self.mix, -1, 1 << 64))):
                    powers = np.full(n, base, np.uint64)
                    powers[0] = 1
                    setattr(self, name, np.multiply.accumulate(powers))
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.down[: len(words)], out=sums[1:])
        return (sums[width:] - sums[:-width]) * self.up[: len(words) - width + 1]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, np.ndarray, object]]]:
    """Documents as word hashes, so many at a time that they hold about CHUNK words."""
    held, n = [], 0
    for batch in batches:
        extra = batch.column(3) if batch.num_columns > 3 else [None] * batch.num_rows
        for id_, key, text, more in zip(batch.column(0), batch.column(1), batch.column(2), extra, strict=True):
            tokens = split_bytes(text.as_py())
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
            held.append((id_.as_py(), key.as_py(), hashes, more))
            n += len(tokens)
            if n >= CHUNK:
                yield held
                held, n = [], 0
    if held:
        yield held


def _runs(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a new owner begins, and how long each run is."""
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(owner)])


def _cells(
    bucket: np.ndarray, known: bool, ids: np.ndarray, keys: np.ndarray, owner: np.ndarray, pos: np.ndarray,
    code: np.ndarray | None = None, check: np.ndarray | None = None,
) -> Iterator[pa.RecordBatch]:
    """One row per bucket: documents with their number of windows, then all windows in a row."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    starts, sizes = _runs(bucket[order])
    rows = []
    for start, size in zip(starts, sizes, strict=True):
        own = order[start : start + size]
        first, counts = _runs(owner[own])
        docs = owner[own][first]
        rows.append(
            (
                int(bucket[own[0]]), known, ids[docs].tobytes(), keys[docs].tobytes(), counts.astype(np.uint32).tobytes(),
                pos[own].astype(np.uint32).tobytes(),
                code[own].tobytes() if code is not None else None, check[own].tobytes() if check is not None else None,
            )
        )
    types = [pa.int32(), pa.bool_()] + [pa.binary()] * 6
    names = [c.split()[0] for c in _CELLS.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    parts = [np.frombuffer(x.as_py(), kind) for x in table.column(name)]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _replies(ids: np.ndarray, keys: np.ndarray, pos: np.ndarray, parts: int) -> pa.Table:
    """Windows as one row per part of the documents, in the form of a cell."""
    names = [c.split()[0] for c in _REPLIES.split(", ")]
    kinds = [pa.int32()] + [pa.binary()] * 4
    if not len(ids):
        return pa.table([pa.array([], k) for k in kinds], names=names)
    part = (ids % parts).astype(np.int64)
    order = np.lexsort((keys, ids, part))
    part, ids, keys, pos = part[order], ids[order], keys[order], pos[order].astype(np.uint32)
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    rows = []
    for lo, hi in zip(cuts, np.r_[cuts[1:], len(part)], strict=True):
        first, counts = _document_runs(ids[lo:hi], keys[lo:hi])
        rows.append((int(part[lo]), ids[lo:hi][first].tobytes(), keys[lo:hi][first].tobytes(), counts.astype(np.uint32).tobytes(), pos[lo:hi].tobytes()))
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _document_runs(ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])]) if len(ids) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(ids)])


def _gather(table: pa.Table) -> pa.Table:
    """All windows of each document of one part, which bounds the lists."""
    ids, keys, pos = _opened(table)
    order = np.lexsort((pos, keys, ids))
    ids, keys, pos = ids[order], keys[order], pos[order]
    starts, _ = _document_runs(ids, keys)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(ids)].astype(np.int32)), pa.array(pos.astype(np.int32)))
    return pa.table([pa.array(ids[starts]), pa.array(keys[starts]), lists], names=["id", "key", "pos"])


def _opened(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts = _joined(table, "counts", np.uint32)
    ids, keys = np.repeat(_joined(table, "ids", np.int64), counts), np.repeat(_joined(table, "keys", np.int32), counts)
    return ids, keys, _joined(table, "pos", np.uint32)


def _flat(chunk: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids = np.array([c[0] for c in chunk], np.int64)
    keys = np.array([c[1] for c in chunk], np.int32)
    sizes = np.array([len(c[2]) for c in chunk], np.int64)
    owner = np.repeat(np.arange(len(chunk)), sizes)
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    return ids, keys, owner, np.arange(len(owner)) - first[owner] if len(owner) else owner, np.concatenate([c[2] for c in chunk])


def anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """``id, key, pos``: places whose next BLOCK words are also a block, or the match of one, elsewhere.

    Every rolling window of a document probes the index of blocks, which holds the windows that
    begin at a multiple of BLOCK.  Windows and blocks meet in buckets of their hash.  What repeats
    within a chunk of documents is a match already and goes to its bucket once, so a passage that
    very many documents share does not fill one bucket.  A bucket compares 32 bits; a few chance
    matches pass and are settled by the exact comparison that follows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = _Rolling(_MIX[0])
        for chunk in _chunks(batches):
            ids, keys, owner, pos, words = _flat(chunk)
            if len(words) < BLOCK:
                continue
            whole = np.flatnonzero(owner[BLOCK - 1 :] == owner[: len(owner) - BLOCK + 1])
            code, owner, pos = roll(words, BLOCK)[whole], owner[whole], pos[whole]
            # Blocks first among equals, so that the one that goes on is a block if any is.
            order = np.lexsort((pos % BLOCK != 0, code))
            head = np.r_[True, code[order][1:] != code[order][:-1]] if len(order) else np.zeros(0, bool)
            group = np.cumsum(head) - 1
            repeated = np.bincount(group)[group] > 1 if len(order) else head
            known, sent = np.sort(order[repeated]), np.sort(order[head])
            yield from _cells(-1 - owner[known] % buckets, True, ids, keys, owner[known], pos[known])
            low = (code[sent] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            bucket = ((code[sent] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            yield from _cells(bucket, False, ids, keys, owner[sent], pos[sent], low)

    def match(table: pa.Table) -> pa.Table:
        ids, keys, pos = _opened(table)
        if table.num_rows and not table.column("known")[0].as_py():
            code = _joined(table, "code", np.uint32)
            order = np.argsort(code, kind="stable")
            starts, sizes = _runs(code[order])
            block = np.logical_or.reduceat(pos[order] % BLOCK == 0, starts)
            hit = np.sort(order[np.repeat(block & (sizes > 1), sizes)])
            ids, keys, pos = ids[hit], keys[hit], pos[hit]
        return _replies(ids, keys, pos, buckets)

    return docs.mapInArrow(scan, _CELLS).groupBy("bucket").applyInArrow(match, _REPLIES).groupBy("part").applyInArrow(_gather, _PLACES)


def repeats(suspects: DataFrame, buckets: int) -> DataFrame:
    """``id, key, pos``: places whose next SPAN words also begin earlier, by 96 bits of hash.

    ``suspects`` are ``id, key, t, pos`` with the matched places of each document.  A match is
    extended to every window around it that contains it; equal windows meet in buckets, where
    all but the first in order of document and place are repeats.  Within a chunk of documents
    that is settled at once, and only the first goes on.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolls = [_Rolling(m) for m in _MIX]
        for chunk in _chunks(batches):
            ids, keys, owner, pos, words = _flat(chunk)
            if len(words) < SPAN:
                continue
            around = np.zeros(len(words) + 1, np.int64)
            first = np.r_[0, np.cumsum([len(c[2]) for c in chunk])]
            for at, (_, _, _, places) in enumerate(chunk):
                hits = places.values.to_numpy(zero_copy_only=False).astype(np.int64)
                np.add.at(around, first[at] + np.maximum(hits - (SPAN - BLOCK), 0), 1)
                np.add.at(around, first[at] + hits + 1, -1)
            whole = owner[SPAN - 1 :] == owner[: len(owner) - SPAN + 1]
            near = np.flatnonzero(whole & (np.cumsum(around)[: len(whole)] > 0))
            one, two = (roll(words, SPAN)[near] for roll in rolls)
            two, own, at = (two >> np.uint64(32)).astype(np.uint32), owner[near], pos[near]
            order, head, same = _first_places(one, two, ids[own], keys[own], at)
            later, sent = np.sort(order[~head & ~same]), np.sort(order[head])
            yield from _cells(-1 - own[later] % buckets, True, ids, keys, own[later], at[later])
            bucket = ((one[sent] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            yield from _cells(bucket, False, ids, keys, own[sent], at[sent], one[sent], two[sent])

    def settle(table: pa.Table) -> pa.Table:
        ids, keys, pos = _opened(table)
        if table.num_rows and not table.column("known")[0].as_py():
            one, two = _joined(table, "code", np.uint64), _joined(table, "check", np.uint32)
            order, head, same = _first_places(one, two, ids, keys, pos)
            later = np.sort(order[~head & ~same])
            ids, keys, pos = ids[later], keys[later], pos[later]
        return _replies(ids, keys, pos, buckets)

    return suspects.mapInArrow(scan, _CELLS).groupBy("bucket").applyInArrow(settle, _REPLIES).groupBy("part").applyInArrow(_gather, _PLACES)


def _first_places(
    one: np.ndarray, two: np.ndarray, ids: np.ndarray, keys: np.ndarray, pos: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the windows, which of them begin a group of equal ones, and which are at that same place."""
    order = np.lexsort((keys, pos, ids, two, one))
    if not len(order):
        return order, np.zeros(0, bool), np.zeros(0, bool)
    a, b = one[order], two[order]
    head = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    lead = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    same = (ids[order] == ids[lead]) & (keys[order] == keys[lead]) & (pos[order] == pos[lead])
    return order, head, same


def shortened(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, key, n_removed, kept``: the rows of ``docs`` that lose words, with the words they keep.

    A word goes if one of the windows of SPAN words that cover it also begins earlier: in a document with
    a smaller id, or before it in the same one.  Words are separated by blanks and compared
    unchanged; what is kept is joined by one space.  Null, blank and short texts never lose
    anything.  Rows without an id come after all others; rows that repeat an id and a text
    count as one document, and rows that repeat an id only are in order of place and text hash.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    rows = _keyed(docs, id_col, text_col)
    hits = stage(anchors(rows, buckets), "anchors")
    suspects = stage(rows.join(hits, ["id", "key"]).select("id", "key", "t", "pos").distinct(), "suspects")
    discard(hits)
    later = stage(repeats(suspects, buckets), "repeats").withColumnRenamed("pos", "later")
    result = stage(suspects.join(later, ["id", "key"]).select("id", "key", "t", "later").mapInArrow(_cut, _KEPT), "shortened")
    discard(suspects, later)
    return result


_KEPT = "id long, key int, n_removed long, kept string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, kept = [], []
        for text, places in zip(batch.column(2), batch.column(3), strict=True):
            tokens = split_bytes(text.as_py())
            edge = np.zeros(len(tokens) + 1, np.int64)
            at = places.values.to_numpy(zero_copy_only=False).astype(np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + SPAN, -1)
            gone = np.cumsum(edge)[:-1] > 0
            removed.append(int(gone.sum()))
            kept.append(b" ".join(t for t, g in zip(tokens, gone, strict=True) if not g).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["id", "key", "n_removed", "kept"]
        )


def deduplicated(docs: DataFrame, kept: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` per row; ``kept`` is an expression over the column ``kept``.

    It is applied to the words that stay, joined by one space, before anything is shuffled.
    """
    changed = shortened(docs, id_col, text_col).select("id", "key", "n_removed", kept.alias("changed"))
    full = F.array_join(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ")
    rows = _keyed(docs, id_col, text_col).select("id", "key", F.col("t").alias(text_col))
    rows = rows.select("id", "key", word_count(F.col(text_col)).alias("n_words"), full.alias("kept"))
    rows = rows.select("id", "key", "n_words", kept.alias("own"))
    return rows.join(changed, ["id", "key"], "left").select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"),
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("changed", "own").alias("kept"),
    )
