"""Toxic passages by maximum-scoring segments over token log-odds."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingualoom.llm import logistic
from lingualoom.session import discard, stage

# Bound of the labelled rows used for fitting, and of the table of scores.
FIT_ROWS = 20_000
MAX_TOKENS = 5_000
# Weight of the prior in pooled counts, least score in standard deviations, least number of toxic documents.
PRIOR = 0.1
LEAST_Z = 4.0
LEAST_DOCS = 4
# What a word without a score of its own takes from a segment.
NEUTRAL = 0.05
STEMS = range(4, 9)
SIGNIFICANT = 0.01
THRESHOLD = 0.3

_WORD = re.compile(r"\w+")
_FLUSH = 200_000


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def forms(word: str) -> list[str]:
    """The word, and a mark for each stem that it continues."""
    return [word] + [word[:k] + "~" for k in STEMS if k < len(word)]


@dataclass(frozen=True)
class Model:
    scores: dict[str, float]
    rate: float  # lambda of the extreme-value law
    scale: float  # K of the same
    slope: float
    constant: float


def segments(scores: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
    """All maximal segments ``(first, last, score)`` in one pass over the scored places.

    ``scores`` are ``(place, score)`` of the words that have one, in order; a word between them
    takes NEUTRAL away.  A segment is maximal if no extension or part of it scores higher, after
    Ruzzo and Tompa (1999): candidates wait on a stack with the running sums at both ends.
    """
    stack: list[list] = []  # first, last, sum before, sum after
    total, seen = 0.0, 0
    for place, score in scores:
        total -= NEUTRAL * (place - seen)
        seen = place + 1
        before, total = total, total + score
        if score <= 0:
            continue
        new = [place, place, before, total]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2] - 1e-9:
                j -= 1
            if j < 0 or stack[j][3] >= new[3] - 1e-9:
                stack.append(new)
                break
            new = [stack[j][0], place, stack[j][2], total]
            del stack[j:]
    return [(a, b, after - before) for a, b, before, after in stack]


def scored_places(words: list[str], scores: dict[str, float], known: dict[str, float | None]) -> list[tuple[int, float]]:
    """Places with a score; ``known`` remembers words.  Of a word's forms the one with the most extreme score counts."""
    out = []
    for i, w in enumerate(words):
        try:
            s = known[w]
        except KeyError:
            found = [scores[f] for f in forms(w) if f in scores]
            s = max(found, key=abs) if found else None
            if len(known) > 500_000:
                known.clear()
            known[w] = s
        if s is not None:
            out.append((i, s))
    return out


def evidence(model: Model, n_words: int, best: float) -> float:
    """How far the best segment exceeds what a clean text of this length reaches; 0 or more."""
    return max(0.0, model.rate * best - math.log(max(model.scale * n_words, 1.0))) if best > 0 else 0.0


def _fit_docs(docs: DataFrame, labels: DataFrame, train: Column, rows: int) -> DataFrame:
    """``doc_id, t, y`` of at most ``rows`` labelled documents, those with the smallest hash of their id."""
    chosen = (
        labels.filter(train & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    # Bounded by `rows`: two numbers each.
    chosen = F.broadcast(stage(chosen, "fit-labels").limit(rows))
    return docs.select("doc_id", F.col("text").alias("t")).join(chosen, "doc_id")


def fit(docs: DataFrame, labels: DataFrame, train: Column, rows: int = FIT_ROWS, most: int = MAX_TOKENS) -> Model:
    """Log-odds with an informative Dirichlet prior (Monroe et al., 2008) on a bounded labelled sample.

    Each document counts once for each form of each of its words.  The prior has the pooled
    frequencies; forms whose log-odds are LEAST_Z standard deviations from 0 keep them as score.
    Lambda solves the equation of Karlin and Altschul (1990) for the score frequencies of clean
    documents, K matches the number of their segments, and a logistic curve turns evidence into a
    probability.  Without labels every document scores 0.5.
    """
    sample = stage(_fit_docs(docs, labels, train, rows), "fit-documents")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(held)
            columns = [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()), pa.array([held[k] for k in keys], pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["form", "y", "n"])

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.update((f, y) for f in {f for w in set(tokens(text)) for f in forms(w)})
                if len(held) > _FLUSH:
                    yield out()
        if held:
            yield out()

    counted = sample.select("t", F.col("y").cast("int").alias("y")).mapInArrow(count, "form string, y int, n long")
    counts = stage(
        counted.groupBy("form").agg(
            F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("y") != 1, F.col("n")).otherwise(0)).alias("n0")
        ),
        "form-counts",
    )
    n1, n0 = (float(x or 0) for x in counts.agg(F.sum("n1"), F.sum("n0")).first())
    prior = (F.col("n1") + F.col("n0")) * PRIOR
    a, b, all_prior = F.col("n1") + prior, F.col("n0") + prior, (n1 + n0) * PRIOR
    odds = F.log(a / (n1 + all_prior - a + 1)) - F.log(b / (n0 + all_prior - b + 1))
    table = counts.filter(F.col("n1") + F.col("n0") >= LEAST_DOCS).select("form", "n1", "n0", odds.alias("s"), (odds / F.sqrt(1 / a + 1 / b)).alias("z"))
    # Bounded by `most`; only what speaks for toxicity has to have been seen in it.
    kept = table.filter((F.abs("z") >= LEAST_Z) & ((F.col("s") < 0) | (F.col("n1") >= LEAST_DOCS)))
    scores = {r["form"]: r["s"] for r in kept.orderBy(F.desc(F.abs("z")), "form").limit(most).collect()}

    draft = Model(scores, 1.0, 1.0, 1.0, 0.0)
    seen = scan(sample.select("doc_id", "t", "y"), draft, "t", ("y",))
    # Bounded by `rows`: a few numbers each.
    found = seen.select("y", "n_words", "best", "n_segments", "positive", "gained", "lost").limit(rows).toPandas()
    clean, total = found[found.y != 1], float(found[found.y != 1].n_words.sum())
    hits, gained = float(clean.positive.sum()) + 1.0, float(clean.gained.sum()) + 4.0
    mean, share = gained / hits, hits / max(total, 1000.0)
    low, high = 1e-3, 20.0
    for _ in range(60):
        rate = (low + high) / 2
        low, high = (rate, high) if (1 - share) * math.exp(-NEUTRAL * rate) + share * math.exp(min(mean * rate, 600)) < 1 else (low, rate)
    least = min([s for s in scores.values() if s > 0], default=1.0)
    scale = (float(clean.n_segments.sum()) + 1.0) / (max(total, 1000.0) * math.exp(-low * least))
    model = Model(scores, low, scale, 1.0, 0.0)
    x = np.array([[evidence(model, n, s)] for n, s in zip(found.n_words, found.best, strict=True)]).reshape(-1, 1)
    slope, constant = logistic.fit(np.minimum(x, 20.0), (found.y == 1).to_numpy(float), ridge=0.1)
    discard(sample, counts)
    return Model(scores, low, scale, max(0.0, float(slope)), float(constant))


def scan(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds nothing to ``keep`` but scores: one row per document with its score and significant passages.

    Passages are ``first`` and ``last`` word (from 0), ``score`` and ``expected``: how many segments
    at least as good a clean text of this length has.
    """
    passage = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())])
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float | None] = {}
        for batch in batches:
            rows = []
            for text in batch.column(k):
                words = tokens(text.as_py())
                places = scored_places(words, model.scores, known)
                found = segments(places)
                best = max((s for _, _, s in found), default=0.0)
                x = min(evidence(model, len(words), best), 20.0)
                score = 1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * x + model.constant))))
                expected = [model.scale * len(words) * math.exp(-model.rate * s) for _, _, s in found]
                rows.append(
                    (
                        len(words), best, len(found), sum(s > 0 for _, s in places), sum(s for _, s in places if s > 0),
                        -sum(s for _, s in places if s < 0), score,
                        [{"first": a, "last": b, "score": s, "expected": e} for (a, b, s), e in zip(found, expected, strict=True) if e <= SIGNIFICANT],
                    )
                )
            types = [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(passage)]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *columns], [*keep, "n_words", "best", "n_segments", "positive", "gained", "lost", "score", "passages"])

    kinds = dict(docs.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep)
    return docs.select(*keep, text_col).mapInArrow(
        run,
        schema + "n_words long, best double, n_segments long, positive long, gained double, lost double, score double, "
        "passages array<struct<first:int,last:int,score:double,expected:double>>",
    )


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted, passages`` per row of ``docs``.

    Labels are learned from rows that aren't held out only; a score depends on the text alone.
    Null and empty texts have no evidence and get the score of that; a null id isn't held out.
    Rows that repeat an id are scored each; a label given twice counts as toxic if one of them is.
    An empty table gives an empty result.
    """
    model = fit(docs, labels, ~held_out(F.col("doc_id")), rows)
    found = scan(docs, model, "text", ("doc_id",))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages")
