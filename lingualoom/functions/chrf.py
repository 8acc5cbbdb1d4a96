"""Character n-gram F-score (Popovic 2015): orders 1 to 6, beta 2, whitespace removed.

The counts are computed per row from Arrow batches, so n-grams are never rows, never shuffled and
never strings.  The 6-gram at each place is one whole number that begins with its row; after one sort the equal
n-grams of every order lie next to each other, since a shorter one is a prefix.  The numbers are exact, not hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lingualoom.functions import chars as C

ORDERS = 6
BETA = 2
_CHUNK_CHARS = 1 << 16
# Up to this many, numbers of three characters are taken as they are; else those that occur are numbered.
_PLAIN = 1 << 21
_BLANKS = np.array([ord(c) for c in C.WS_CHARS])


def _code_points(texts: list[str]) -> np.ndarray:
    """The texts, each with one more place behind it."""
    return np.frombuffer("".join(t + "\0" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _chunk_stats(hyps: list[str], refs: list[str]) -> np.ndarray:
    """Rows x (6 orders x [hypothesis, reference, matching]) n-gram counts."""
    rows = len(hyps)
    points = _code_points([*hyps, *refs])
    size = np.fromiter((len(t) + 1 for t in (*hyps, *refs)), dtype=np.int64, count=2 * rows)
    owner = np.repeat(np.arange(2 * rows), size)
    # Characters by small numbers; 0 stands behind each text, and whitespace goes.
    seen = np.zeros(max(int(points.max(initial=0)), int(_BLANKS.max())) + 1, dtype=bool)
    seen[points] = True
    blank = np.zeros(len(seen), dtype=bool)
    blank[_BLANKS] = True
    numbers = np.cumsum(seen)
    code = numbers[points]
    ends = np.cumsum(size) - 1
    code[ends] = 0
    keep = ~blank[points]
    keep[ends] = True
    code, owner, base = code[keep], owner[keep], int(numbers[-1]) + 1
    length = np.bincount(owner, minlength=2 * rows) - 1
    n_hyp, n_ref = length[:rows], length[rows:]

    padded = np.concatenate([code, np.zeros(5, dtype=np.int64)])
    three = (padded[:-2] * base + padded[1:-1]) * base + padded[2:]
    if base**3 <= _PLAIN:
        known, name, most = None, three, base**3
    else:
        known, name = np.unique(three, return_inverse=True)
        most = len(known)
    bits = int(most).bit_length()
    live = np.flatnonzero(code)
    key = (((owner[live] % rows) << bits | name[live]) << bits | name[live + 3]) << 1 | (owner[live] >= rows)
    key.sort()
    refs_upto = np.concatenate([[0], np.cumsum(key & 1)])
    row, mask = key >> (2 * bits + 1), (1 << bits) - 1
    halves = [(key >> (bits + 1)) & mask, (key >> 1) & mask]
    if known is not None:
        halves = [known[h] for h in halves]

    stats = np.zeros((rows, ORDERS, 3), dtype=np.int64)
    new = np.diff(row, prepend=-1) != 0
    whole = np.ones(len(key), dtype=bool)
    for order in range(ORDERS):
        prefix = halves[order // 3] // base ** (2 - order % 3)
        # A place too near its text's end has no n-gram of this order.
        whole &= prefix % base != 0
        new |= np.diff(prefix, prepend=-1) != 0
        heads = np.flatnonzero(new)
        until = np.append(heads[1:], len(key))[whole[heads]]
        heads = heads[whole[heads]]
        in_ref = refs_upto[until] - refs_upto[heads]
        matched = np.bincount(row[heads], weights=np.minimum(in_ref, until - heads - in_ref), minlength=rows)
        of_ref = np.maximum(n_ref - order, 0)
        # A hypothesis is not held against an order its reference does not have.
        stats[:, order, 0] = np.where(of_ref > 0, np.maximum(n_hyp - order, 0), 0)
        stats[:, order, 1] = of_ref
        stats[:, order, 2] = matched.astype(np.int64)
    return stats.reshape(rows, ORDERS * 3)


def _chunks(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if i > start and size + n > _CHUNK_CHARS:
            yield start, i
            start, size = i, 0
        size += n
    yield start, len(lengths)


def _stats(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    """18 counts of each row, worked out for a bounded number of characters at a time."""
    hyps, refs = (pc.fill_null(x, "").to_pylist() for x in (hyp, ref))
    lengths = np.array([len(h) + len(r) + 2 for h, r in zip(hyps, refs, strict=True)], dtype=np.int64)
    parts = [_chunk_stats(hyps[a:b], refs[a:b]) for a, b in _chunks(lengths) if b > a]
    counts = np.concatenate([np.zeros((0, ORDERS * 3), dtype=np.int64), *parts])
    ends = np.arange(len(hyps) + 1, dtype=np.int32) * (ORDERS * 3)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(counts.reshape(-1)))


def chrf_stats(hyp: Column, ref: Column) -> Column:
    """18 counts per row: for each order the hypothesis, reference and matching n-grams."""
    return F.arrow_udf(_stats, "array<bigint>")(hyp, ref)


def f_score(stat) -> Column:
    """chrF from ``stat(i)`` = the i-th of the 18 counts: mean P and R over the orders both have."""
    precision = recall = F.lit(0.0)
    orders = F.lit(0)
    for order in range(ORDERS):
        n_hyp, n_ref, hit = (stat(3 * order + i) for i in range(3))
        both = (n_hyp > 0) & (n_ref > 0)
        precision = precision + F.when(both, hit / n_hyp).otherwise(0.0)
        recall = recall + F.when(both, hit / n_ref).otherwise(0.0)
        orders = orders + F.when(both, 1).otherwise(0)
    p = F.try_divide(precision, orders)
    r = F.try_divide(recall, orders)
    score = (1 + BETA**2) * p * r / (BETA**2 * p + r) * 100
    return F.when((orders > 0) & (p + r > 0), score).otherwise(0.0)
