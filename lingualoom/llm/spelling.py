"""Spelling variants: words one edit apart, found by probing edits against Bloom filters of the vocabulary."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingualoom.session import discard, stage

# A run of letters, and the letters that a word in lower case can hold.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LETTERS = np.r_[np.arange(ord("a"), ord("z") + 1), np.arange(0xC0, 0x100)].astype(np.uint32)
UPPER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}
TYPO_ODDS = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
LEAST_RATIO = 2

# Filter: bits for each word, bits of a block, bits set for a word, and the bound of the whole, which is broadcast.
BITS = 16
BLOCK = 512
MARKS = 7
FILTER_BYTES = 128 << 20
# Each length has a filter of its own; words of LONG letters and more share one.
LONG = 64
# Distinct words that a task counts before it hands them on, edits probed at once, cells of a part of the filter.
HELD = 500_000
PROBES = 1 << 20
CELLS = 1 << 17

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


def altered(doc_id: int | None, run: str) -> str:
    """The word that a run in lower case stands for: about one in TYPO_ODDS loses a letter; without an id none."""
    if doc_id is None:
        return run
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % TYPO_ODDS:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def counted(doc_id: int | None, text: str | None) -> Counter:
    """The words of a text with their number."""
    runs = Counter()
    for run, n in Counter(RUN.findall(text or "")).items():
        runs[run.lower() if run.isascii() else run.translate(UPPER)] += n
    out: Counter = Counter()
    for run, n in runs.items():
        out[altered(doc_id, run)] += n
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: words of LEAST_LENGTH letters and more that occur LEAST_COUNT times or more in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.update({w: n for w, n in counted(doc_id, text.as_py()).items() if len(w) >= LEAST_LENGTH})
                if len(held) > HELD:
                    yield out()
        if held:
            yield out()

    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


# Hashes: a word is a number in base _BASE, so that an edit changes a few terms of a sum.


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _BASE, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_VALUES = _mixed(np.arange(0x100, dtype=np.uint64) + np.uint64(1))


@dataclass(frozen=True)
class Shards:
    """Where the filter of each length begins, in blocks, and how many blocks it has."""

    start: np.ndarray
    blocks: np.ndarray

    @classmethod
    def of(cls, sizes: dict[int, int], most: int = FILTER_BYTES) -> Shards:
        want = np.array([-(-sizes.get(k, 0) * BITS // BLOCK) for k in range(LONG + 1)], np.int64)
        limit = most * 8 // BLOCK
        if want.sum() > limit:
            want = np.where(want > 0, np.maximum(1, want * limit // want.sum()), 0)
        return cls(np.r_[0, np.cumsum(want)[:-1]], want)

    def bits(self, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First bit of each hash's block, and the hash from which its marks are read."""
        shard = min(length, LONG)
        spread = _mixed(hashes)
        block = self.start[shard] + ((spread >> np.uint64(32)) % np.uint64(max(1, self.blocks[shard]))).astype(np.int64)
        return block * BLOCK, _mixed(spread + np.uint64(_BASE))


def _mark(seed: np.ndarray, k: int) -> np.ndarray:
    return ((seed >> np.uint64(9 * k)) & np.uint64(BLOCK - 1)).astype(np.int64)


def _codes(words: list[str]) -> np.ndarray:
    """The code points of words of one length."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1).astype(np.int64)


def _hashes(words: list[str]) -> np.ndarray:
    codes = _codes(words)
    with np.errstate(over="ignore"):
        return np.sum(_VALUES[codes] * _powers(codes.shape[1])[:-1], axis=1, dtype=np.uint64)


def filters(words: DataFrame, shards: Shards) -> np.ndarray:
    """The bits of all words, as bytes; made in parts, of which each task adds what its words mark."""
    total = int(shards.blocks.sum()) * BLOCK // 8

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [np.zeros(0, np.int64)]
            for _, words in _by_length(batch.column(0).to_pylist()):
                first, seed = shards.bits(_hashes(words), len(words[0]))
                cells += [first + _mark(seed, k) for k in range(MARKS)]
            bits = np.unique(np.concatenate(cells))
            part = bits // (8 * CELLS)
            edges = np.flatnonzero(np.r_[True, np.diff(part) != 0, True]) if len(bits) else np.zeros(1, np.int64)
            parts = [(int(part[a]), bits[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())], ["part", "bits"])

    def joined(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        own = np.zeros(8 * CELLS, bool)
        for bits in table.column("bits"):
            own[np.frombuffer(bits.as_py(), np.int64) - part * 8 * CELLS] = True
        return pa.table({"part": pa.array([part], pa.int32()), "bits": pa.array([np.packbits(own).tobytes()], pa.binary())})

    made = words.select("word").mapInArrow(marked, "part int, bits binary").groupBy("part").applyInArrow(joined, "part int, bits binary")
    # Bounded by FILTER_BYTES.
    out = np.zeros(max(1, -(-total // CELLS)) * CELLS, np.uint8)
    for part, bits in zip(*(c.to_pylist() for c in made.toArrow().columns), strict=True):
        out[part * CELLS : (part + 1) * CELLS] = np.frombuffer(bits, np.uint8)
    return out


def _holds(bits: np.ndarray, shards: Shards, hashes: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the hashes whose marks are all set; each mark looks only at those that had the ones before."""
    left = np.arange(len(hashes)) if shards.blocks[min(length, LONG)] else np.zeros(0, np.int64)
    if not len(left):
        return left
    first, seed = shards.bits(hashes, length)
    for k in range(MARKS):
        at = first[left] + _mark(seed[left], k)
        left = left[(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
    return left


def edits(words: list[str], bits: np.ndarray, shards: Shards) -> Iterator[tuple[int, str]]:
    """Of words of one length: the shorter words, and those with a smaller letter in some place, that the filter may hold.

    Gives the word's number and the edit.  Each pair of near words has one that is shorter, or smaller where they
    differ, so these edits meet every pair once: of equal letters in a row only the first is left out.
    """
    n = len(words[0])
    powers = _powers(n)
    rows = max(1, PROBES // (n * len(LETTERS)))
    step = max(1, PROBES // len(LETTERS))
    for first in range(0, len(words), rows):
        own = words[first : first + rows]
        codes = _codes(own)
        with np.errstate(over="ignore"):
            terms = _VALUES[codes] * powers[:n]
            whole = np.sum(terms, axis=1, dtype=np.uint64)
            if n > LEAST_LENGTH:
                before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
                after = (whole[:, None] - before - terms) * np.uint64(_BACK)
                who, at = np.nonzero(np.c_[np.ones(len(codes), bool), codes[:, 1:] != codes[:, :-1]])
                for x in _holds(bits, shards, (before + after)[who, at], n - 1):
                    word, i = own[who[x]], at[x]
                    yield first + int(who[x]), word[:i] + word[i + 1 :]
            for begin in range(0, n, step):
                who, at, letter = np.nonzero(LETTERS < codes[:, begin : begin + step, None])
                at, new = at + begin, LETTERS[letter]
                hashes = whole[who] - terms[who, at] + _VALUES[new] * powers[at]
                for x in _holds(bits, shards, hashes, n):
                    word, i = own[who[x]], at[x]
                    yield first + int(who[x]), word[:i] + chr(new[x]) + word[i + 1 :]


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Numbers of the words of each length, and these words."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(sizes):
        which = np.flatnonzero(sizes == n)
        yield which, [words[i] for i in which]


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n`` for every two words of ``word, n`` that are one edit apart, once.

    The edits of a word are tried on a broadcast Bloom filter, of which each length has its own part; what
    passes goes to the vocabulary, in a join that leaves only words which are there.  The filter's size
    is bounded by FILTER_BYTES: beyond that more edits pass by chance, and none is lost.
    """
    spark = words.sparkSession
    length = F.least(F.char_length("word"), F.lit(LONG))
    sizes = {r["k"]: r["n"] for r in words.groupBy(length.alias("k")).agg(F.count("*").alias("n")).collect()}
    shards = Shards.of(sizes)
    held = spark.sparkContext.broadcast(filters(words, shards))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for which, own in _by_length(batch.column(0).to_pylist()):
                found = list(edits(own, held.value, shards))
                at = pa.array([which[i] for i, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([e for _, e in found], pa.string())], ["a", "a_n", "b"])

    positive = words.select("word", "n").mapInArrow(probe, "a string, a_n long, b string")
    return positive.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b").select("a", "a_n", "b", "b_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the vocabulary.

    ``form`` is the near word with the largest number (ties: the smallest in code-point order), if that is at
    least LEAST_RATIO times the word's own; ``root`` is where following forms ends.  Numbers at least double from
    word to form, so no chain is longer than the logarithm of the largest number; chains are halved by joins.

    Null and empty texts have no words; rows without an id change no run; repeated rows count each; other
    columns don't matter.  A run of any length is one word.  An empty table gives an empty result.
    """
    words = stage(vocabulary(docs, id_col, text_col), "vocabulary")
    pairs = stage(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form")).alias("x")).union(
        pairs.select(F.col("b"), F.struct((-F.col("a_n")).alias("less"), F.col("a").alias("form")))
    )
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("x").alias("x"))
    firm = -F.col("x.less") >= LEAST_RATIO * F.col("n")
    told = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(firm, F.col("x.form")).alias("form"), F.when(firm, -F.col("x.less")).alias("form_n")
    )
    told = stage(told, "forms")
    discard(pairs, words)
    # Only words with a form have anything to follow, and only those whose form has one too go further.
    links = stage(told.filter("form is not null").select("word", F.col("form").alias("root")), "links")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = stage(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        done = jumped.filter("moved").isEmpty()
        discard(links)
        links = jumped.select("word", "root")
        if done:
            break
    return told.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
