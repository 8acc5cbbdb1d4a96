"""Quality of documents: evidence of the text, shrunk site rates, and their posterior."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingualoom.llm import logistic
from lingualoom.llm.words import let, words
from lingualoom.session import discard, stage

# Bound of the labelled rows used for fitting.
FIT_ROWS = 20_000
# A document is rejected if it is of low quality with more than this probability.
REJECT = 0.8
# Evidence is held within these log-odds, so that no text alone is beyond doubt.
MOST_ODDS = 8.0

FEATURES = ("marks", "upper", "digits", "new_words", "same_as_before", "marked_words", "bare_marks", "size", "stops")
_BLANK = r"[\x20\x09-\x0D]"
_COUNTED = {
    "marks": r"[#$%&*!|<>{}\[\]=_~^\\/@+]",
    "upper": r"\p{Lu}",
    "digits": r"[0-9]",
    "marked_words": rf"[#$%&*!?]{{2}}(?={_BLANK}|$)",
    "bare_marks": rf"(?<![^\x20\x09-\x0D])[|#$%&*!=_~-]{{1,2}}(?={_BLANK}|$)",
    "stops": rf"\.(?={_BLANK}|$)",
}


def features(text: Column) -> Column:
    """``array<double>`` in the order of FEATURES, each between 0 and about 1.

    Null and blank texts have all features 0.
    """
    full = F.coalesce(text, F.lit(""))
    counts = {name: F.regexp_count(full, F.lit(pattern)).cast("double") for name, pattern in _COUNTED.items()}

    def measured(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1)).cast("double")
        chars = F.greatest(F.length(full), F.lit(1)).cast("double")
        again = F.filter(w, lambda x, i: (i > 0) & (x == w[F.greatest(i - 1, F.lit(0))]))
        return F.array(
            counts["marks"] / chars,
            counts["upper"] / chars,
            counts["digits"] / chars,
            F.size(F.array_distinct(w)) / n,
            F.size(again) / n,
            counts["marked_words"] / n,
            counts["bare_marks"] / n,
            F.least(F.log1p(F.size(w).cast("double")) / 10.0, F.lit(1.0)),
            counts["stops"] / n,
        )

    return let(words(full), measured)


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]  # of FEATURES and, last, the constant
    base: float  # share of low quality among the rows it was fitted on


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A logistic classifier of low quality on at most ``rows`` labelled documents, those with the smallest hash of their id.

    Without labels, or with one class only, every document has the same evidence.
    """
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    # Bounded by `rows`: two numbers each.
    chosen = stage(chosen, "quality-labels")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen.limit(rows)), "doc_id")
    sample = sample.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    # Bounded by `rows`, ten numbers each.
    found = sample.select(features(F.col("text")).alias("x"), "y").toPandas()
    discard(chosen)
    y = (found.y == 0).to_numpy(float)
    base = (float(y.sum()) + 1) / (len(y) + 2)
    if not len(y) or y.min() == y.max():
        return Model((0.0,) * len(FEATURES) + (float(np.log(base / (1 - base))),), base)
    return Model(tuple(map(float, logistic.fit(np.array(found.x.tolist()), y, ridge=1e-2))), base)


def _logit(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


def odds(text: Column, model: Model) -> Column:
    """Log-odds of low quality by the text alone."""
    weights = F.array(*[F.lit(w) for w in model.weights[:-1]])
    return let(
        features(text),
        lambda x: F.aggregate(F.zip_with(x, weights, lambda a, b: a * b), F.lit(model.weights[-1]), lambda s, v: s + v),
    )


def _strength(groups: DataFrame, total: str, n: str, mean: float) -> float:
    """How many documents the prior counts as: by moments, from the spread of group rates beyond chance."""
    rate = F.col(total) / F.col(n)
    between, weight, expected = groups.filter(F.col(n) > 1).agg(
        F.sum(F.col(n) * F.pow(rate - mean, 2)), F.sum(n), F.sum(F.lit(mean * (1 - mean)))
    ).first()
    if not weight:
        return 10.0
    spread = max((between - expected) / weight, 1e-6)
    return float(min(max(mean * (1 - mean) / spread - 1, 1.0), 1e4))


def posteriors(
    docs: DataFrame, model: Model, host: str = "source", path: str = "lang", text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``row`` (the columns in ``keep``, else all) and ``p_low``: the posterior probability that the document is of low quality.

    Each document counts with its own probability.  The rate of a host is a Beta posterior around
    the global rate, the rate of a path one around its host's; the strength of both priors is
    estimated by moments over all groups, so sparse sites stay near what they belong to.  A
    document's own share is taken out of its path before the path speaks about it.  Groups are
    summed before the shuffle and come back by joins with one row per group.  A null host or
    path is a group of its own.
    """
    p = 1.0 / (1.0 + F.exp(-F.col("evidence")))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.col(host).cast("string").alias("h"), F.col(path).cast("string").alias("d"),
        F.greatest(F.least(odds(F.col(text_col), model), F.lit(MOST_ODDS)), F.lit(-MOST_ODDS)).alias("evidence"),
    )
    # Written once: the sums and the join both read it, and the evidence is what costs.
    rows = stage(rows, "evidence")
    paths = stage(rows.groupBy("h", "d").agg(F.sum(p).alias("low"), F.count("*").alias("n")), "path-rates")
    hosts = stage(paths.groupBy("h").agg(F.sum("low").alias("host_low"), F.sum("n").alias("host_n")), "host-rates")
    low, n = hosts.agg(F.sum("host_low"), F.sum("host_n")).first()
    mean = min(max(((low or 0.0) + 0.5) / ((n or 0) + 1.0), 1e-4), 1 - 1e-4)
    host_strength = _strength(hosts, "host_low", "host_n", mean)
    path_strength = _strength(paths, "low", "n", mean)
    host_rate = (F.col("host_low") + host_strength * mean) / (F.col("host_n") + host_strength)
    rates = paths.join(hosts.withColumnRenamed("h", "_h"), F.col("h").eqNullSafe(F.col("_h")))
    rates = stage(rates.select(F.col("h").alias("_h"), F.col("d").alias("_d"), "low", "n", host_rate.alias("host_rate")), "rates")
    discard(paths, hosts)
    joined = rows.join(rates, F.col("h").eqNullSafe(F.col("_h")) & F.col("d").eqNullSafe(F.col("_d")))
    others = (F.col("low") - p + path_strength * F.col("host_rate")) / (F.col("n") - 1 + path_strength)
    prior = F.least(F.greatest(others, F.lit(1e-4)), F.lit(1 - 1e-4))
    start = float(np.log(model.base / (1 - model.base)))
    posterior = 1.0 / (1.0 + F.exp(-(F.col("evidence") - start + _logit(prior))))
    return joined.select("row", "evidence", prior.alias("site_rate"), posterior.alias("p_low"))


def classify(
    docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, host: str = "source", path: str = "lang", keep: list[str] | None = None
) -> DataFrame:
    """``row`` (the columns in ``keep``, else all), ``evidence``, ``site_rate``, ``p_low`` and ``rejected`` for each row of ``docs``.

    Null and blank texts are judged like any other; repeated rows count each; an empty table
    gives an empty result.
    """
    found = posteriors(docs, fit(docs, labels, rows), host, path, keep=keep)
    return found.withColumn("rejected", F.col("p_low") > REJECT)


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` without the rejected rows."""
    return classify(docs, labels, rows).filter(~F.col("rejected")).select("row.*")
