"""Approximate nearest neighbours by inner product with a forest of hash prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingualoom.operators.spread import salted_join
from lingualoom.session import discard, stage

NEIGHBOURS = 20
# Trees, digits of a hash string, directions among which a digit chooses (with either sign), bits of a digit.
TREES = 32
DIGITS = 9
DIRECTIONS = 64
BITS = 7
SEED = 11
# Bounds of what the index is fitted on: vectors whose strings tell how common a prefix is, and
# queries that are answered by brute force to learn how many candidates the wanted recall takes.
SAMPLE = 1 << 15
TRIALS = 128
RECALL = 0.96
# Vectors of one slice of a tree, and their bytes in double precision.
SLICE = 1 << 16
SLICE_BYTES = 64 << 20
# Rows hashed at once, and queries scored at once against a range.
ROWS = 4096

_PACKED = "slice long, kind int, keys binary, labels binary, vecs binary"
_PAIRS = "q1 long, q2 long, c1 long, c2 long, first long, score double"


def _key(vec: Column) -> list[Column]:
    """128 bits that name a vector; the sign of a zero makes no difference."""
    return [F.xxhash64(vec).alias("k1"), F.xxhash64(F.lit(1), vec).alias("k2")]


def _usable(vec: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vec, finite) & F.exists(vec, lambda x: x != 0), F.lit(False))


def strings(points: np.ndarray, tree: int) -> np.ndarray:
    """The hash strings of a tree for unit vectors, as numbers whose leading digits come first.

    A digit is the nearest of DIRECTIONS random directions and their opposites: the cross-polytope
    hash, for which near vectors agree more often than for as many bits of hyperplanes.
    """
    noise = np.random.default_rng([SEED, tree]).standard_normal((points.shape[1], DIGITS * DIRECTIONS), np.float32)
    out = np.zeros(len(points), np.int64)
    for at in range(0, len(points), ROWS):
        part = (points[at : at + ROWS] @ noise).reshape(-1, DIGITS, DIRECTIONS)
        best = np.abs(part).argmax(2)
        sign = np.take_along_axis(part, best[:, :, None], 2)[:, :, 0] > 0
        for k in range(DIGITS):
            out[at : at + ROWS] = (out[at : at + ROWS] << BITS) | (2 * best[:, k] + sign[:, k])
    return out


def as_points(vecs: np.ndarray, longest: float | None) -> np.ndarray:
    """Unit vectors whose angles order inner products: items gain a component that makes up for their length."""
    most = np.abs(vecs).max(axis=1).astype(np.float64)
    length = most * np.linalg.norm(vecs / most[:, None], axis=1)
    if longest is None:
        return np.c_[vecs / length[:, None], np.zeros(len(vecs))].astype(np.float32)
    share = length / longest
    return np.c_[vecs / longest, np.sqrt(np.maximum(0.0, 1.0 - share * share))].astype(np.float32)


@dataclass(frozen=True)
class Forest:
    """What every task knows of the index: strings of the sample, and where each tree is cut into slices."""

    dim: int
    kind: str  # of the components
    longest: float
    rows: int
    sample: np.ndarray  # trees x at most SAMPLE, each sorted
    cuts: tuple[np.ndarray, ...]
    parts: tuple[np.ndarray, ...]  # of each slice: how many equal ones share it
    base: tuple[np.ndarray, ...]  # number of a slice's first part

    def common(self, labels: np.ndarray) -> np.ndarray:
        """Queries x depths: about how many vectors share that many digits, added up over the trees.

        ``labels`` are trees x queries.  Depth 0 is the whole table, once.
        """
        out = np.zeros((labels.shape[1], DIGITS + 1))
        scale = self.rows / max(1, self.sample.shape[1])
        for own, known in zip(labels, self.sample, strict=True):
            for depth in range(1, DIGITS + 1):
                low, last = ranges(own, BITS * (DIGITS - depth))
                out[:, depth] += (np.searchsorted(known, last, "right") - np.searchsorted(known, low)) * scale
        out[:, 0] = np.maximum(self.rows, out[:, 1])
        return out

    def place(self, tree: int, labels: np.ndarray, spread: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.cuts[tree], labels, "right")
        return self.base[tree][at] + (spread.astype(np.uint64) % self.parts[tree][at].astype(np.uint64)).astype(np.int64)


def ranges(labels: np.ndarray, rest: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last string that differ at most in the last ``rest`` bits."""
    rest = np.broadcast_to(np.asarray(rest, np.int64), labels.shape)
    low = (labels >> rest) << rest
    # All 63 bits: the shift leaves the least number there is, and one less is the greatest.
    return low, low | ((np.int64(1) << rest) - 1)


def depths(common: np.ndarray, wanted: float) -> np.ndarray:
    """How far all trees ascend together: the deepest level with enough candidates."""
    enough = common >= wanted
    enough[:, 0] = True
    return DIGITS - enough[:, ::-1].argmax(1)


def _numpy(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def distinct_vectors(rows: DataFrame, every: int, keep: int) -> DataFrame:
    """``k1, k2, ids, asked, vec``: each vector once, with its ``keep`` smallest ids and whether a query is among its rows."""
    asked = (F.pmod("id", F.lit(every)) == 0).alias("asked")
    names = rows.select("k1", "k2", "id", asked).distinct()
    first = names.withColumn("_n", F.row_number().over(Window.partitionBy("k1", "k2", "asked").orderBy("id"))).filter(F.col("_n") <= keep)
    names = first.groupBy("k1", "k2").agg(F.slice(F.array_sort(F.collect_list("id")), 1, keep).alias("ids"), F.max("asked").alias("asked"))
    return rows.groupBy("k1", "k2").agg(F.any_value("vec").alias("vec")).join(names, ["k1", "k2"]).select("k1", "k2", "ids", "asked", "vec")


def grow(vectors: DataFrame, dim: int, kind: str, rows: int, longest: float, slice_rows: int = SLICE) -> Forest:
    """Samples the strings and cuts each tree into slices of about ``slice_rows`` vectors."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = as_points(_numpy(batch.column(0), dim), longest)
            labels = np.stack([strings(points, t) for t in range(TREES)], 1)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in labels], pa.binary())], ["labels"])

    # Bounded by SAMPLE: TREES numbers each.
    some = vectors.orderBy("k1", "k2").limit(SAMPLE).select("vec").repartition(16).mapInArrow(hashed, "labels binary").toArrow()
    sample = np.frombuffer(b"".join(some.column(0).to_pylist()), np.int64).reshape(-1, TREES)
    sample = np.sort(sample.T, axis=1)
    limit = max(1, min(slice_rows, SLICE_BYTES // (8 * dim)))
    n, scale, total = max(1, -(-rows // limit)), rows / max(1, sample.shape[1]), 0
    cuts, parts, base = [], [], []
    for known in sample:
        cut = np.unique(known[np.arange(1, n) * len(known) // n]) if n > 1 else np.zeros(0, np.int64)
        held = np.diff(np.r_[0, np.searchsorted(known, cut), len(known)]) * scale
        share = np.maximum(1, np.ceil(held / (2 * limit))).astype(np.int64)
        cuts.append(cut), parts.append(share), base.append(total + np.r_[0, np.cumsum(share)[:-1]])
        total += int(share.sum())
    return Forest(dim, kind, longest, rows, sample, tuple(cuts), tuple(parts), tuple(base))


def brute_force(vectors: DataFrame, queries: np.ndarray, names: np.ndarray, dim: int, keep: int) -> DataFrame:
    """``q, score, k1, k2, vec``: the true neighbours of a bounded number of queries, themselves left out."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.astype(np.float64)
        for batch in batches:
            vecs, k1, k2 = _numpy(batch.column(2), dim), np.asarray(batch.column(0)), np.asarray(batch.column(1))
            scores = q @ vecs.astype(np.float64).T
            scores[(names[:, :1] == k1) & (names[:, 1:] == k2)] = -np.inf
            best = np.argsort(-scores, axis=1)[:, :keep] if len(vecs) <= keep else np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
            at = best.ravel()
            who = np.repeat(np.arange(len(q)), best.shape[1])
            real = np.isfinite(scores[who, at])
            at, who = at[real], who[real]
            yield pa.RecordBatch.from_arrays(
                [pa.array(who), pa.array(scores[who, at]), pa.array(k1[at]), pa.array(k2[at]), pa.array([x.tobytes() for x in vecs[at]], pa.binary())],
                ["q", "score", "k1", "k2", "vec"],
            )

    found = vectors.select("k1", "k2", "vec").mapInArrow(nearest, "q long, score double, k1 long, k2 long, vec binary")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "k1", "k2")
    return found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= keep).drop("_n")


def learn(vectors: DataFrame, forest: Forest, k: int, recall: float, trials: int) -> float:
    """How many candidates a query needs for ``recall``, from true neighbours of at most ``trials`` queries.

    A neighbour is found when the trees ascend to the depth at which one of them has it.  That takes
    as many candidates as lie one level deeper, and one; the share ``recall`` of all true neighbours needs no more.
    """
    some = vectors.filter("asked").orderBy("k2", "k1").limit(trials).select("k1", "k2", "vec").toArrow()
    if not some.num_rows:
        return 1.0
    queries = _numpy(some.column(2).combine_chunks(), forest.dim)
    names = np.c_[np.asarray(some.column(0)), np.asarray(some.column(1))]
    # At most `trials` times k rows.
    near = brute_force(vectors, queries, names, forest.dim, k).toArrow()
    if not near.num_rows:
        return 1.0
    who = np.asarray(near.column("q"))
    items = np.frombuffer(b"".join(near.column("vec").to_pylist()), np.dtype(forest.kind)).reshape(-1, forest.dim)
    asked, held = as_points(queries, None), as_points(items, forest.longest)
    own = np.stack([strings(asked, t) for t in range(TREES)])
    other = np.stack([strings(held, t) for t in range(TREES)])
    best = np.zeros(len(who), np.int64)
    for depth in range(1, DIGITS + 1):
        rest = BITS * (DIGITS - depth)
        best[((own[:, who] >> rest) == (other >> rest)).any(0)] = depth
    common = np.c_[forest.common(own), np.zeros(len(queries))]
    need = np.sort(common[who, best + 1] + 1)
    return float(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)])


def _packed(slices: np.ndarray, kind: int, keys: np.ndarray, labels: np.ndarray, vecs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each slice, with everything of this batch that goes there."""
    order = np.argsort(slices, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(slices[order]) != 0, True]) if len(order) else np.zeros(1, np.int64)
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        at = order[lo:hi]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(slices[at[0]])]), pa.array([kind], pa.int32())] + [pa.array([x[at].tobytes()], pa.binary()) for x in (keys, labels, vecs)],
            ["slice", "kind", "keys", "labels", "vecs"],
        )


def _pack(batches: Iterator[pa.RecordBatch], forest: Forest, wanted: float | None) -> Iterator[pa.RecordBatch]:
    """Items (``wanted`` is None) with their strings, or queries with the ranges that they ask for, by slice."""
    for batch in batches:
        k1, k2, first = (np.asarray(batch.column(i)) for i in range(3))
        vecs = _numpy(batch.column(3), forest.dim)
        if not len(vecs):
            continue
        keys, points = np.c_[k1, k2, first, np.zeros(len(k1), np.int64)], as_points(vecs, forest.longest if wanted is None else None)
        labels = np.stack([strings(points, t) for t in range(TREES)])
        if wanted is None:
            for tree in range(TREES):
                yield from _packed(forest.place(tree, labels[tree], k1), 0, keys, labels[tree], vecs)
            continue
        depth = depths(forest.common(labels), wanted)
        for tree in range(TREES):
            low, last = ranges(labels[tree], BITS * (DIGITS - depth))
            begin, end = np.searchsorted(forest.cuts[tree], low, "right"), np.searchsorted(forest.cuts[tree], last, "right")
            edge = np.r_[forest.base[tree], forest.base[tree][-1] + forest.parts[tree][-1]]
            start, stop = edge[begin], edge[end + 1]
            # The whole table is in every tree; the first one is enough.
            many = np.where((depth == 0) & (tree > 0), 0, stop - start)
            who = np.repeat(np.arange(len(many)), many)
            turn = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
            own = keys[who]
            own[:, 3] = (turn == 0) & (tree == 0)
            yield from _packed(start[who] + turn, 1, own, np.c_[low[who], last[who]], vecs[who])


def _search(batches: Iterator[pa.RecordBatch], forest: Forest, keep: int) -> Iterator[pa.RecordBatch]:
    """Within each slice, whose items come before its queries: the best of every range that is asked for."""
    at, held, ready = None, [], None
    kind = np.dtype(forest.kind)
    for batch in batches:
        for row in batch.to_pylist():
            keys = np.frombuffer(row["keys"], np.int64).reshape(-1, 4)
            vecs = np.frombuffer(row["vecs"], kind).reshape(-1, forest.dim)
            labels = np.frombuffer(row["labels"], np.int64)
            if row["slice"] != at:
                at, held, ready = row["slice"], [], None
            if row["kind"] == 0:
                held.append((keys, labels, vecs))
                continue
            if ready is None:
                if held:
                    order = np.argsort(np.concatenate([h[1] for h in held]), kind="stable")
                    ready = tuple(np.concatenate([h[i] for h in held])[order] for i in range(3))
                    ready = (ready[0], ready[1], ready[2].astype(np.float64))
                else:
                    ready = (np.zeros((0, 4), np.int64), np.zeros(0, np.int64), np.zeros((0, forest.dim)))
                held = []
            yield from _answers(ready, keys, labels.reshape(-1, 2), vecs.astype(np.float64), keep)


def _answers(ready: tuple, keys: np.ndarray, asked: np.ndarray, vecs: np.ndarray, keep: int) -> Iterator[pa.RecordBatch]:
    names, labels, items = ready
    low, high = np.searchsorted(labels, asked[:, 0]), np.searchsorted(labels, asked[:, 1], "right")
    out = [np.c_[keys[:, :2], keys[:, :3]][keys[:, 3] == 1]]
    points = [np.sum(vecs * vecs, axis=1)[keys[:, 3] == 1]]
    order = np.lexsort((high, low))
    edges = np.flatnonzero(np.r_[True, (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0), True]) if len(order) else np.zeros(1, np.int64)
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        a, b = low[order[lo]], high[order[lo]]
        if a == b:
            continue
        # A few more than asked for, since the product of matrices may round equal sums apart; and the query itself.
        most = min(b - a, keep + 9)
        for part in range(lo, hi, max(1, (1 << 22) // (b - a))):
            who = order[part : min(hi, part + max(1, (1 << 22) // (b - a)))]
            rough = vecs[who] @ items[a:b].T
            best = a + (np.argpartition(-rough, most - 1, axis=1)[:, :most] if most < b - a else np.tile(np.arange(b - a), (len(who), 1)))
            exact = np.sum(items[best] * vecs[who][:, None, :], axis=2)
            exact[(names[best, 0] == keys[who, 0][:, None]) & (names[best, 1] == keys[who, 1][:, None])] = -np.inf
            rank = np.lexsort((names[best, 2], -exact), axis=1)[:, :keep]
            best, exact = np.take_along_axis(best, rank, 1).ravel(), np.take_along_axis(exact, rank, 1).ravel()
            whose, real = np.repeat(who, rank.shape[1]), exact > -np.inf
            out.append(np.c_[keys[whose, :2], names[best, :3]][real])
            points.append(exact[real])
    table = np.concatenate(out)
    if len(table):
        yield pa.RecordBatch.from_arrays([pa.array(table[:, i]) for i in range(5)] + [pa.array(np.concatenate(points))], [c.split()[0] for c in _PAIRS.split(", ")])


def neighbours(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = NEIGHBOURS, every: int = 20,
    recall: float = RECALL, trials: int = TRIALS, slice_rows: int = SLICE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows with the largest inner product found for each query.

    Queries are the rows whose id ``every`` divides; candidates are all rows but the query's own.
    Each of TREES trees is an array of vectors sorted by hash string, cut into slices; a query
    descends to its own string in every tree and all trees ascend together, a digit at a time, until
    the prefixes hold as many candidates as the wanted recall takes (``learn``).  How many a prefix
    holds is read from a sample of the strings; every vector is in every tree, and all candidates of the
    depth reached are scored, in double precision.  A range of more vectors than a slice is searched
    slice by slice, and a slice of equal strings in as many parts as it needs.  A vector that many rows share is
    one vector with its ``k + 1`` smallest ids, since no query can need more of them.

    Ties go to the smaller id.  Null, empty or zero vectors, vectors that hold a null, NaN or infinity, vectors of
    another length than most, and rows without an id take no part.  Rows that repeat id and vector count once; rows
    that repeat an id only are rows of their own.  Fewer than ``k`` other rows give as many as there are; an empty table gives none.
    """
    kind = df.schema[vec_col].dataType.elementType.simpleString()
    part = "float" if kind == "float" else "double"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{part}>").alias("vec"))
    rows = rows.filter(F.col("id").isNotNull() & _usable(F.col("vec")))
    most = F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.pow(x / F.col("most"), F.lit(2.0)))
    sizes = rows.withColumn("most", most).groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.max(F.col("most") * F.sqrt(square)).alias("longest"))
    most = sizes.orderBy(F.desc("n"), "dim").first()
    if most is None:
        empty = "query_id long, rank int, vec_id long, score double"
        return df.sparkSession.createDataFrame([], empty)
    dim, longest = most["dim"], most["longest"]
    rows = rows.filter(F.size("vec") == dim).select(*_key(F.col("vec")), "id", "vec")
    vectors = stage(distinct_vectors(rows, every, k + 1), "vectors")
    numpy_kind = "<f4" if part == "float" else "<f8"
    forest = grow(vectors, dim, numpy_kind, vectors.count(), longest, slice_rows)
    wanted = learn(vectors, forest, k, recall, trials)

    plain = vectors.select("k1", "k2", F.col("ids")[0].alias("first"), "vec")
    items = plain.mapInArrow(lambda b: _pack(b, forest, None), _PACKED)
    asked = vectors.filter("asked").select("k1", "k2", F.col("ids")[0].alias("first"), "vec").mapInArrow(lambda b: _pack(b, forest, wanted), _PACKED)
    slices = int(forest.base[-1][-1] + forest.parts[-1][-1])
    met = items.unionByName(asked).repartition(slices, "slice").sortWithinPartitions("slice", "kind")
    pairs = met.mapInArrow(lambda b: _search(b, forest, k), _PAIRS)
    pairs = stage(pairs.groupBy("q1", "q2", "c1", "c2").agg(F.min("first").alias("first"), F.max("score").alias("score")), "pairs")
    # Below the query's own vector, at most k others can be among its neighbours.
    best = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "first", "c1", "c2")
    top = pairs.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k + 1).select("q1", "q2", F.col("c1").alias("k1"), F.col("c2").alias("k2"), "score")
    named = top.join(vectors.select("k1", "k2", "ids"), ["k1", "k2"])
    entry = lambda i: F.struct((-F.col("score")).alias("far"), i.alias("vec_id"), "k1", "k2")
    near = named.select("q1", "q2", F.explode(F.transform("ids", entry)).alias("x"))
    lists = near.groupBy(F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(F.slice(F.array_sort(F.collect_list("x")), 1, k + 1).alias("near"))
    lists = stage(lists, "neighbours")
    discard(pairs, vectors)
    asking = rows.filter(F.pmod("id", F.lit(every)) == 0).select("k1", "k2", "id").distinct()
    joined = salted_join(asking, lists, ["k1", "k2"], "inner", ["id"])
    own = lambda x: (x["vec_id"] == F.col("id")) & (x["k1"] == F.col("k1")) & (x["k2"] == F.col("k2"))
    others = joined.select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("near", lambda x: ~own(x)), 1, k)).alias("pos", "x"))
    return others.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))
