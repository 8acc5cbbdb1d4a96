"""Near-duplicate detection by SimHash with exact, tiled comparison of fingerprints."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingualoom.llm.graph import components
from lingualoom.session import discard, stage

SHINGLE = 3
RADIUS = 2
SEED = 42
# Fingerprints that one task compares at once, and the side of a tile within them.
GROUP = 2048
TILE = 256
# Shingles in the sets that one task compares at once; of sets it compares GROUP at most.
SETS = 1 << 19
# Words of 64 bits in a wide fingerprint; keys of a text, and smallest hashes in each.
WIDE = 4
BANDS = 20
BAND = 2
_CHUNK = 1 << 14


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text, as an unsigned number; no words give 0."""
    # The bytes type lower-cases A-Z only and splits at exactly the characters of GAPS.
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) < shingle:
        grams: Iterator[bytes] = iter([b" ".join(tokens)])
        total = 1
    else:
        grams = map(b" ".join, zip(*(tokens[i:] for i in range(shingle)), strict=False))
        total = len(tokens) - shingle + 1
    counts = np.zeros(64, np.int64)
    for start in range(0, total, _CHUNK):
        size = min(_CHUNK, total - start)
        hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g, _ in zip(grams, range(size), strict=False)), "<u8", size)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id, fp``: one row per input row; ``fp`` is the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, fp long")


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (as positions) that connect what lies within ``radius``, at most one per fingerprint.

    ``fps`` has one row per fingerprint and a column for each 64 bits.  Fingerprints are ordered by
    population count and cut into tiles; a pair of tiles is compared with exclusive-or and bit
    counts, and skipped if their counts differ beyond the radius.
    """
    count = np.bitwise_count(fps).sum(axis=1, dtype=np.int64)
    order = np.argsort(count, kind="stable")
    fps, count = fps[order], count[order]
    left, right = [], []
    for i in range(0, len(fps), TILE):
        most = count[min(i + TILE, len(fps)) - 1] + radius
        for j in range(i, len(fps), TILE):
            if count[j] > most:
                break
            differ = np.zeros((len(fps[i : i + TILE]), len(fps[j : j + TILE])), np.uint16)
            for k in range(fps.shape[1]):
                differ += np.bitwise_count(fps[i : i + TILE, None, k] ^ fps[None, j : j + TILE, k])
            x, y = np.nonzero(differ <= radius)
            left.append(x + i)
            right.append(y + j)
    x, y = np.concatenate(left), np.concatenate(right)
    keep = x < y
    x, y = x[keep], y[keep]
    return [(int(order[i]), int(order[j])) for i, j in _forest_of(len(fps), x, y)]


def field_keys(fp: Column, radius: int) -> Column:
    """Keys of which two 64-bit fingerprints within ``radius`` share at least one.

    The bits are cut into ``radius + 2`` fields.  So many bits touch at most ``radius`` fields,
    hence some two fields are equal in both; there is one key for each choice of two fields.
    """
    cuts = [64 * i // (radius + 2) for i in range(radius + 3)]
    fields = [
        F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long"))
        for lo, hi in zip(cuts, cuts[1:], strict=False)
    ]
    pairs = combinations(range(len(fields)), 2)
    return F.array(*[F.xxhash64(F.lit(100 * i + j), fields[i], fields[j]) for i, j in pairs])


def tiled(rows: DataFrame, reach: int, most: int) -> DataFrame:
    """``node, payload`` as lists: for any two rows of a bucket whose levels differ by ``reach`` at most, a list with both.

    ``rows`` are ``bucket, node, level, weight, payload``.  A bucket that weighs more than ``most`` is
    divided by level, and those parts by a hash; each pair of parts within reach makes a list of
    its own.  So no list weighs more than two parts, and each is compared in one task.
    """
    sizes = rows.groupBy("bucket", "level").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    # One entry per level, of which there are few, whatever the size of the bucket.
    sizes = sizes.groupBy("bucket").agg(F.sum("n").alias("rows"), F.sum("w").alias("total"), F.collect_list(F.struct("level", "w")).alias("parts"))
    rows = rows.join(sizes.filter("rows > 1").drop("rows"), "bucket")

    def splits(w: Column) -> Column:
        return F.ceil(w / most).cast("long")

    code = F.lit(1 << 40).cast("long")
    own = F.col("level") * code + F.pmod(F.xxhash64("node"), splits(F.filter("parts", lambda p: p["level"] == F.col("level"))[0]["w"]))
    others = F.flatten(
        F.transform(
            F.filter("parts", lambda p: F.abs(p["level"] - F.col("level")) <= reach),
            lambda p: F.transform(F.sequence(F.lit(0).cast("long"), splits(p["w"]) - 1), lambda s: p["level"] * code + s),
        )
    )
    rows = rows.withColumn("own", own)
    pairs = F.when(F.col("total") <= most, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(others, lambda o: F.xxhash64(F.least(o, F.col("own")), F.greatest(o, F.col("own"))))
    )
    return (
        rows.select("bucket", "node", "payload", F.explode(pairs).alias("pair"))
        .groupBy("bucket", "pair")
        .agg(F.collect_list(F.struct("node", "payload")).alias("both"))
        .filter(F.size("both") > 1)
        .select("both")
    )


def _linked(lists: DataFrame, find: Callable[[list[np.ndarray]], list[tuple[int, int]]]) -> DataFrame:
    """``a, b``: what ``find`` links in each list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for both in batch.column(0):
                nodes = both.values.field("node").to_numpy(zero_copy_only=False)
                payload = both.values.field("payload")
                flat, cuts = payload.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum([0] + payload.value_lengths().to_pylist())
                found = find([flat[x:y] for x, y in zip(cuts, cuts[1:], strict=False)])
                a += [nodes[i] for i, _ in found]
                b += [nodes[j] for _, j in found]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return lists.mapInArrow(run, "a long, b long").distinct()


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """``a, b``: links that connect all nodes that share a key and lie within ``radius``.

    ``nodes`` are ``node, fp, keys``: an id, the fingerprint as ``array<bigint>``, and the buckets to
    compare it in.  What comes back is a spanning forest of the links of each comparison, so
    dense groups do not multiply.
    """
    ones = F.aggregate("fp", F.lit(0), lambda s, x: s + F.bit_count(x))
    rows = nodes.select("node", F.col("fp").alias("payload"), ones.alias("level"), F.explode("keys").alias("bucket"), F.lit(1).alias("weight"))

    def find(fps: list[np.ndarray]) -> list[tuple[int, int]]:
        if len(fps) == 2:
            return [(0, 1)] if int(np.bitwise_count(fps[0] ^ fps[1]).sum()) <= radius else []
        return forest(np.stack(fps), radius)

    return _linked(tiled(rows, radius, GROUP), find)


def alike(sets: list[np.ndarray], likeness: float) -> list[tuple[int, int]]:
    """Links (as positions) that connect sets with this likeness (Jaccard) or more; exact, at most one per set."""
    n = len(sets)
    if n == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if common >= likeness * (len(sets[0]) + len(sets[1]) - common) else []
    sizes = np.array([len(s) for s in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.r_[True, values[1:] != values[:-1]]
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1
    owner, number = owner[shared], np.cumsum((np.r_[True, np.diff(number[shared]) != 0]) if shared.any() else []) - 1
    number = number.astype(np.int64)
    width = max(1, (1 << 24) // n)
    common = np.zeros((n, n), np.float32)
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        lo, hi = np.searchsorted(number, [start, start + width])
        held = np.zeros((n, min(width, int(number[-1]) + 1 - start)), np.float32)
        held[owner[lo:hi], number[lo:hi] - start] = 1
        for i in range(0, n, TILE):
            common[i : i + TILE] += held[i : i + TILE] @ held.T
    # Row by row of tiles, each folded to a link per set at most.
    found = []
    for i in range(0, n, TILE):
        some = common[i : i + TILE]
        x, y = np.nonzero(some >= likeness * (sizes[i : i + TILE, None] + sizes[None, :] - some) - 1e-3)
        keep = x + i < y
        found += _forest_of(n, x[keep] + i, y[keep])
    ends = np.array(found, np.int64).reshape(-1, 2)
    return _forest_of(n, ends[:, 0], ends[:, 1])


def _forest_of(n: int, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """A link from each position to the smallest one that it reaches by the links ``x, y``."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, y, label[x])
        np.minimum.at(new, x, label[y])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(i), int(label[i])) for i in np.flatnonzero(label != np.arange(n))]


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """``id, fp, component_id`` per input row; ``component_id`` is the smallest id reachable by links.

    Null and blank texts have fingerprint 0, which links like any other.  Rows with equal texts
    share a fingerprint; repeated rows stay repeated.  A null id keeps its row; it gets the
    component of its fingerprint, and null if nothing there has an id.  An empty table gives an
    empty result.  Other columns of ``docs`` are not read.
    """
    rows = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = stage(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    nodes = distinct.select(F.col("fp").alias("node"), F.array("fp").alias("fp"), field_keys(F.col("fp"), radius).alias("keys"))
    found = components(links(nodes, radius), "a", "b").withColumnRenamed("node", "fp")
    linked = distinct.join(found, "fp")
    roots = linked.groupBy("label").agg(F.min("first").alias("root"))
    linked = linked.join(roots, "label").select("fp", "root")
    named = stage(
        distinct.join(linked, "fp", "left").select("fp", F.coalesce("root", "first").alias("component_id")), "components"
    )
    discard(distinct, found)
    return rows.join(named, "fp", "left").select("id", "fp", "component_id")


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Distinct hashes of the runs of ``shingle`` words, A-Z in lower case; a shorter text is one run."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    grams = {b" ".join(g) for g in zip(*(tokens[i:] for i in range(shingle)), strict=False)} or {b" ".join(tokens)}
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, grams), np.uint64, len(grams)))


def wide_fingerprints(rows: DataFrame, shingle: int) -> DataFrame:
    """``id, k1, k2, fp, keys`` from ``id, k1, k2, t``: a fingerprint of WIDE words of 64 bits, and BANDS keys.

    A key is a hash of BAND smallest hashes under permutations of their own, so two texts share a
    given key with the likeness of their sets to the power of BAND.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys = [], []
            for text in batch.column(3):
                hashes = shingle_set(text.as_py(), shingle)
                counts = np.zeros(64 * WIDE, np.int64)
                for start in range(0, len(hashes), _CHUNK):
                    part = hashes[start : start + _CHUNK]
                    mixed = np.stack([_mixed(part, k) for k in range(WIDE)], axis=1)
                    counts += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                fps.append(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64).tolist())
                least = np.array([_mixed(hashes, 100 + k).min() for k in range(BAND * BANDS)], np.uint64).reshape(BANDS, BAND)
                keys.append([xxhash.xxh3_64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(least)])
            arrays = [pa.array(fps, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *arrays], ["id", "k1", "k2", "fp", "keys"])

    return rows.select("id", "k1", "k2", "t").mapInArrow(run, "id long, k1 long, k2 long, fp array<long>, keys array<long>")


def shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """``node, label, payload``: the shingle set of each ``t``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One text at a time: the sets of a batch may be much larger than its texts.
            for i, text in enumerate(batch.column(2)):
                one = pa.array([shingle_set(text.as_py(), shingle).view(np.int64)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), one], ["node", "label", "payload"])

    return rows.select("node", "label", "t").mapInArrow(run, "node long, label long, payload array<long>")


def _mixed(h: np.ndarray, turn: int) -> np.ndarray:
    """One of many permutations of the 64-bit numbers."""
    h = h + np.uint64((turn * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _differing(a: int, b: int, c: int) -> float:
    """Odds that a bit differs between fingerprints of two sets with ``c`` shingles in common, and ``a`` and ``b`` of their own."""

    def odds(n: int) -> np.ndarray:
        return np.array([math.comb(n, k) for k in range(n + 1)], np.float64) / 2.0**n

    ones = np.arange(c + 1)[:, None]
    left = (2 * (ones + np.arange(a + 1)) > a + c) @ odds(a)
    right = (2 * (ones + np.arange(b + 1)) > b + c) @ odds(b)
    return float(odds(c) @ (left * (1 - right) + right * (1 - left)))


@cache
def radius_of(likeness: float, bits: int, miss: float = 1e-9) -> int:
    """Bits in which fingerprints of sets with this likeness (Jaccard) or more differ at most, but for ``miss`` of all pairs.

    Large sets of like size and likeness j have cosine 2j / (1 + j), and each bit differs with
    probability angle / pi.  In small sets ties at half make more bits differ: at 0.8 the worst are 4
    shingles against the same and a fifth.  The odds of all sets up to 60 shingles together are exact.
    """
    worst = math.acos(2 * likeness / (1 + likeness)) / math.pi
    for c in range(1, 61):
        own = min(int(c / likeness - c + 1e-9), 60 - c)
        worst = max([worst, *(_differing(a, b, c) for a in range(own + 1) for b in range(a, own - a + 1))])
    beyond, radius = 0.0, bits
    while radius > 0:
        beyond += math.comb(bits, radius) * worst**radius * (1 - worst) ** (bits - radius)
        if beyond > miss:
            break
        radius -= 1
    return radius


def keep_first(docs: DataFrame, shingle: int = 5, likeness: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the smallest ``doc_id``.

    Near-duplicates have sets of word shingles with ``likeness`` or more, and groups are what is connected.
    Wide fingerprints are compared where two texts share one of BANDS keys; what lies within the radius
    forms loose groups, and within those the sets themselves are compared, in tiles of like size.  At
    a likeness of exactly 0.8 the keys fail once in 750 million pairs and the radius less than once in
    1,000 million, whatever the size of the sets; above 0.8 both fail less.  Equal texts are one from the
    start.  Null and blank texts are equal to the empty text.  Of rows that repeat a ``doc_id`` one stays, that
    with the smallest text.  Rows without an id all stay, since no group can name them.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"), text.alias("t")
    )
    nodes = wide_fingerprints(keyed, shingle).groupBy("k1", "k2")
    nodes = stage(nodes.agg(F.min("id").alias("node"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "wide-fingerprints")
    loose = components(links(nodes, radius_of(likeness, 64 * WIDE)), "a", "b")
    wanted = nodes.join(loose, "node").select("k1", "k2", F.col("node").alias("id"), "label")
    members = stage(shingle_sets(keyed.join(wanted, ["k1", "k2", "id"]).withColumnRenamed("id", "node"), shingle), "shingle-sets")
    step = -math.log(likeness)
    # A part is bounded by its sets too, as their comparison takes memory by the square of their number.
    weight = F.greatest(F.size("payload"), F.lit(-(-SETS // GROUP)))
    rows = members.dropDuplicates(["node"]).select(
        F.col("label").alias("bucket"), "node", "payload", weight.alias("weight"), F.floor(F.log(F.size("payload").cast("double")) / step).alias("level")
    )
    # Sets that are alike differ in size by one level at most.
    found = components(_linked(tiled(rows, 1, SETS), lambda sets: alike(sets, likeness)), "a", "b")
    roots = found.groupBy("label").agg(F.min("node").alias("root"))
    away = found.join(roots, "label").filter("node <> root").select(F.col("node").alias("doc_id"))
    keepers = nodes.select(F.col("node").alias("doc_id")).distinct().join(away, "doc_id", "left_anti")
    keepers = stage(keepers, "keepers")
    discard(nodes, loose, members, found)
    first = Window.partitionBy("doc_id").orderBy(text)
    kept = docs.join(keepers, "doc_id", "left_semi").withColumn("_nth", F.row_number().over(first)).filter("_nth = 1")
    return kept.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))
