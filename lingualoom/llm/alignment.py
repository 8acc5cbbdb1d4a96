"""Alignment of two tokenizers over a corpus, each distinct text tokenized once."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingualoom.operators.spread import salted_join
from lingualoom.session import discard, stage

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
# A pair of ids is one number; more B ids than this can't be told apart.
B_IDS = 1 << 15
# Bytes of text that a task aligns at once, texts encoded at once, and bytes of all texts for each bucket of pairs.
CHUNK = 16 << 20
TEXTS = 256
BUCKET_BYTES = 32 << 20
# Pairs are at most A ids times B ids, so more buckets than this are never needed.
MOST_BUCKETS = 512
FEWEST_BUCKETS = 12
# Entries that a task adds up before it merges them.
HELD = 1 << 22

# Fixed value: how the byte-level vocabulary cuts words.
WORD_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Texts for which both encoders were compared character by character; others go to the slower one.
PLAIN = re.compile("[\x00-\u024f\u2010-\u2027\u20ac]*")

MEASURES = ("n_a", "n_b", "n_groups", "n_links")
_ALIGNED = "chunk long, bucket int, keys binary, measures binary, groups array<string>, sizes binary, pairs binary, counts binary"
_COUNTED = "bucket int, pairs binary, counts binary, best binary"
_ANSWERS = "chunk long, bucket int, counts binary, best binary"
_RESULT = "k1 long, k2 long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _quick(ranks: dict[bytes, int], a_file: str) -> Any:
    """A faster encoder for the same vocabulary, if ids come in the order of merges and words are cut by WORD_PATTERN; else None."""
    with open(a_file, encoding="utf-8") as f:
        told = json.load(f)
    table = _byte_of()
    pairs = (m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"])
    merged = (bytes(table[c] for c in "".join(pair)) for pair in pairs)
    ordered = all(ranks.get(m) == 256 + i for i, m in enumerate(merged))
    cut = told.get("pre_tokenizer") or {}
    if not ordered or told.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or cut.get("use_regex") is False:
        return None
    import tiktoken

    return tiktoken.Encoding("a", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


class Side:
    """One tokenizer: ids of texts, and the bytes that each id stands for."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], entries: list[bytes]):
        self.encode, self.entries = encode, entries
        self.lengths = np.array([len(e) for e in entries], np.int64)


class Tokenizers:
    """Both sides, and how their ids are written in a list of groups: within a group, and at the end of its part."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        ends = ((a, b"|"), (b, b";"))
        self.written = [str(i).encode() + end for side, last in ends for i in range(len(side.entries)) for end in (b",", last)]


@lru_cache(maxsize=2)
def tokenizers(a_file: str, b_file: str) -> Tokenizers:
    """Both tokenizers, read once by each worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(a_file)
    first.encode_special_tokens = True
    with open(a_file, encoding="utf-8") as f:
        special = {t["id"] for t in json.load(f)["added_tokens"]}
    table = _byte_of()
    names = [first.id_to_token(i) or "" for i in range(first.get_vocab_size())]
    a_entries = [n.encode() if i in special else bytes(table[c] for c in n) for i, n in enumerate(names)]
    quick = _quick({e: i for i, e in enumerate(a_entries) if i not in special}, a_file)

    def encode(texts: list[str]) -> list[list[int]]:
        """Ids of each text with a space in front; the two encoders differ in speed only."""
        plain = [quick is not None and PLAIN.fullmatch(t) is not None for t in texts]
        others = iter(first.encode_batch([" " + t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        return [quick.encode_ordinary(" " + t) if p else next(others).ids for t, p in zip(texts, plain, strict=True)]

    second = SentencePieceProcessor(model_file=b_file)
    b_entries = []
    for i in range(second.get_piece_size()):
        piece = second.id_to_piece(i)
        b_entries.append(bytes([int(piece[1:-1], 16)]) if second.is_byte(i) else piece.replace("\u2581", " ").encode())
    if len(b_entries) > B_IDS:
        raise ValueError(f"more than {B_IDS} ids: {b_file}")
    return Tokenizers(
        Side(encode, a_entries),
        Side(lambda texts: second.encode(texts, num_threads=1), b_entries),
    )


def align(text: str, a_ids: list[int], b_ids: list[int], both: Tokenizers) -> tuple[np.ndarray, np.ndarray, bytes] | None:
    """Pairs of all links, MEASURES, and the groups as text; None if either side spells another text.

    Both cut the same bytes, so between two neighbouring cuts of either kind lies one link, and the
    cuts that both have end the groups.
    """
    a, b = both.a, both.b
    raw = (" " + text).encode("utf-8", "surrogatepass")
    if b"".join(map(a.entries.__getitem__, a_ids)) != raw or b"".join(map(b.entries.__getitem__, b_ids)) != raw:
        return None
    own, other = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
    a_end, b_end = np.cumsum(a.lengths[own]), np.cumsum(b.lengths[other])
    cut = np.zeros(len(raw) + 1, np.int8)
    cut[a_end] = 1
    cut[b_end] += 2
    ends = np.flatnonzero(cut)
    kinds = cut[ends].astype(np.int64)
    # The tokens of a link are those after all that end before it.
    a_upto, b_upto = np.cumsum(kinds & 1), np.cumsum(kinds >> 1)
    pairs = own[a_upto - (kinds & 1)] * B_IDS + other[b_upto - (kinds >> 1)]
    shared = np.flatnonzero(kinds == 3)
    a_last, b_last = cut[a_end] == 3, cut[b_end] == 3
    # In the list of groups A's tokens follow the earlier groups' tokens of B, and B's those of A up to their own group.
    a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    order = np.empty(len(own) + len(other), np.int64)
    order[np.arange(len(own)) + np.r_[0, b_upto[shared]][a_group]] = 2 * own + a_last
    order[np.arange(len(other)) + a_upto[shared][b_group]] = 2 * (other + len(a.entries)) + b_last
    groups = b"".join(map(both.written.__getitem__, order.tolist()))[:-1]
    return pairs, np.array([len(own), len(other), len(shared), len(ends)], np.int64), groups


def _distinct(docs: DataFrame, text_col: str) -> DataFrame:
    """``k1, k2, n, t``: each text that has tokens at all once, with its number of rows and 128 bits to find it again."""
    some = docs.select(F.col(text_col).alias("t")).filter(F.length("t") > 0)
    return some.groupBy("t").agg(F.count("*").alias("n")).select(*_key("t"), "n", "t")


def _key(text: str) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """``(k1, k2, n, text)`` of texts with CHUNK bytes together."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
            held.append((*row[:3], row[3].as_py()))
            size += len(held[-1][3])
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _numbers(row: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(row.as_py() or b"", kind)


def _align(batches: Iterator[pa.RecordBatch], files: tuple[str, str], buckets: int, digest: bool) -> Iterator[pa.RecordBatch]:
    """For each chunk one row with its texts (bucket -1), and one for each bucket of its pairs with the rows that hold them."""
    both = tokenizers(*files)
    task = TaskContext.get().partitionId() << 32
    fields = [c.split()[0] for c in _ALIGNED.split(", ")]
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()]
    for number, chunk in enumerate(_chunks(batches)):
        keys, measures, groups, pairs, counts, weights = [], [], [], [], [], []
        for at in range(0, len(chunk), TEXTS):
            part = chunk[at : at + TEXTS]
            texts = [t for *_, t in part]
            for (k1, k2, n, text), a_ids, b_ids in zip(part, both.a.encode(texts), both.b.encode(texts), strict=True):
                found = align(text, a_ids, b_ids, both)
                if found is None:
                    continue
                linked, times = np.unique(found[0], return_counts=True)
                keys.append((k1, k2)), measures.append(found[1]), pairs.append(linked), counts.append(times), weights.append(n)
                groups.append(hashlib.sha256(found[2]).hexdigest() if digest else found[2].decode())
        if not keys:
            continue
        sizes = np.array([len(p) for p in pairs], np.int64)
        distinct, local = np.unique(np.concatenate(pairs), return_inverse=True)
        held = np.bincount(local, np.repeat(np.array(weights, np.float64), sizes)).astype(np.int64)
        bucket = distinct // B_IDS % buckets
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        distinct, held, bucket = distinct[order].astype(np.uint32), held[order], bucket[order]
        edges = np.flatnonzero(np.r_[True, np.diff(bucket) != 0, True])
        rows = [(task | number, -1, np.array(keys, np.int64).tobytes(), np.array(measures).tobytes(), groups, sizes.astype(np.int32).tobytes(), place[local].astype(np.int32).tobytes(), np.concatenate(counts).astype(np.int32).tobytes())]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            rows.append((task | number, int(bucket[lo]), None, None, None, None, distinct[lo:hi].tobytes(), held[lo:hi].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], fields)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up each bucket's pairs, which come together; in memory are its distinct pairs and HELD more at most."""
    at, held, size = None, [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        pairs, where = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        return pairs, np.bincount(where, np.concatenate([n for _, n in held]).astype(np.float64)).astype(np.int64)

    def out() -> pa.RecordBatch:
        pairs, counts = merged()
        first = np.flatnonzero(np.r_[True, np.diff(pairs // B_IDS) != 0])
        most = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.r_[first, len(pairs)]))
        columns = [pa.array([at], pa.int32())] + [pa.array([x.tobytes()], pa.binary()) for x in (pairs, counts, counts == most)]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _COUNTED.split(", ")])

    for batch in batches:
        for bucket, pairs, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if bucket != at and held:
                yield out()
                held, size = [], 0
            at = bucket
            held.append((_numbers(pairs, np.uint32), _numbers(counts, np.int64)))
            size += len(held[-1][0])
            if size > HELD:
                held, size = [merged()], 0
    if held:
        yield out()


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts for the pairs of each chunk; in a bucket the counted pairs (no chunk) come first."""
    known = counts = best = None
    for batch in batches:
        for chunk, bucket, pairs, n, top in zip(*(batch.column(i) for i in range(5)), strict=True):
            if chunk.as_py() is None:
                known, counts, best = _numbers(pairs, np.uint32), _numbers(n, np.int64), _numbers(top, bool)
                continue
            where = np.searchsorted(known, _numbers(pairs, np.uint32))
            columns = [pa.array([chunk.as_py()]), pa.array([bucket.as_py()], pa.int32())] + [pa.array([x[where].tobytes()], pa.binary()) for x in (counts, best)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _ANSWERS.split(", ")])


def _measured(table: pa.Table) -> pa.Table:
    """One chunk: its texts and the counts of all its pairs, in order of buckets."""
    order = np.argsort(np.array(table.column("bucket").to_pylist()))
    rows = table.take(pa.array(order)).combine_chunks()
    counts = np.concatenate([_numbers(x, np.int64) for x in rows.column("n")[1:]])
    best = np.concatenate([_numbers(x, bool) for x in rows.column("best")[1:]])
    keys = _numbers(rows.column("keys")[0], np.int64).reshape(-1, 2)
    measures = _numbers(rows.column("measures")[0], np.int64).reshape(-1, len(MEASURES))
    sizes, local, times = (_numbers(rows.column(c)[0], np.int32).astype(np.int64) for c in ("sizes", "pairs", "times"))
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    sums = [np.add.reduceat(times * x[local], first) for x in (best, counts)]
    columns = [keys[:, 0], keys[:, 1], *measures.T, *sums]
    return pa.table([pa.array(c) for c in columns] + [pa.array(rows.column("groups")[0].as_py(), pa.string())], names=[c.split()[0] for c in _RESULT.split(", ")])


def _prepared(docs: DataFrame, text_col: str, files: tuple[str, str], digest: bool) -> tuple[DataFrame, DataFrame]:
    """The aligned chunks, and the corpus-wide count of each pair by bucket."""
    distinct = stage(_distinct(docs, text_col), "distinct-texts")
    size = distinct.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(FEWEST_BUCKETS, -(-size // BUCKET_BYTES)))
    aligned = stage(distinct.mapInArrow(lambda b: _align(b, files, buckets, digest), _ALIGNED), "aligned")
    discard(distinct)
    asked = aligned.filter("bucket >= 0").select("bucket", "pairs", "counts")
    counted = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_count, _COUNTED)
    return aligned, stage(counted, "pair-counts")


def pair_counts(docs: DataFrame, text_col: str = "text", a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """``a_id, b_id, n, best``: how many documents link two ids somewhere, and whether no other id of B has more of ``a_id``."""
    _, counted = _prepared(docs, text_col, (a_file, b_file), True)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, n, best in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                pair = _numbers(pairs, np.uint32).astype(np.int32)
                columns = [pair // B_IDS, pair % B_IDS, _numbers(n, np.int64), _numbers(best, bool)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a_id", "b_id", "n", "best"])

    return counted.mapInArrow(opened, "a_id int, b_id int, n long, best boolean")


def aligned_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str = A_FILE, b_file: str = B_FILE, digest: bool = False
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` per row.

    Rows meet by their full text; each distinct text is tokenized and aligned once and stands for as many
    documents as there are rows with it.  Byte offsets at which tokens of both sides end cut the text into groups, written
    ``a1,a2|b1;a3|b2,b3`` (with ``digest``: their SHA-256 in hex); a link is a token of A and one of B whose bytes overlap.
    The count of two ids is the number of documents that link them; ``n_best`` are a document's links whose count no other
    link of the same A id exceeds anywhere, and ``count_sum`` adds the counts of its links.

    Texts are aligned in chunks.  A chunk sends each of its distinct pairs once, with the number of documents,
    to the bucket of its A id, which adds them up in a stream and sends the counts back; so neither a frequent pair nor
    a frequent text is gathered anywhere.  Tokenizer files are paths that every executor can read.

    Null and empty texts, and texts that one of the tokenizers does not spell exactly, have no tokens: zeros and an
    empty ``groups``.  Names of special tokens are plain text.  Texts of any length are aligned whole; repeated rows count each.  Ties
    are all best.  An empty table gives an empty result.
    """
    aligned, counted = _prepared(docs, text_col, (a_file, b_file), digest)
    asked = aligned.filter("bucket >= 0").select("chunk", "bucket", "pairs", F.lit(None).cast("binary").alias("counts"), F.lit(None).cast("binary").alias("best"))
    known = counted.select(F.lit(None).cast("long").alias("chunk"), "bucket", "pairs", "counts", "best")
    met = known.union(asked).repartition(MOST_BUCKETS, "bucket").sortWithinPartitions("bucket", F.asc_nulls_first("chunk"))
    answers = met.mapInArrow(_answer, _ANSWERS)
    none = {c: F.lit(None).cast(t) for c, t in (("keys", "binary"), ("measures", "binary"), ("groups", "array<string>"), ("sizes", "binary"), ("pairs", "binary"), ("times", "binary"), ("n", "binary"), ("best", "binary"))}
    texts = aligned.filter("bucket < 0").withColumnRenamed("counts", "times").withColumns({c: none[c] for c in ("n", "best")})
    replies = answers.withColumnRenamed("counts", "n").withColumns({c: v for c, v in none.items() if c not in ("n", "best")})
    found = stage(texts.unionByName(replies).groupBy("chunk").applyInArrow(_measured, _RESULT), "alignment")
    discard(aligned, counted)
    rows = docs.select(F.col(id_col).alias("doc_id"), *_key(text_col))
    joined = salted_join(rows, found, ["k1", "k2"], "left", ["doc_id"])
    numbers = [c.split()[0] for c in _RESULT.split(", ")[2:-1]]
    return joined.select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("groups", F.lit("")).alias("groups"))
