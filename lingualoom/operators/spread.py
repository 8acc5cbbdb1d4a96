"""Joins and running positions that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lingualoom.session import stage

# A key with more than 1/HOT_KEYS of all rows is certain to be among the HOT_KEYS most frequent
# ones.  Values up to BROADCAST_CHARS of those are broadcast, so their bytes are bounded too;
# for longer ones the rows are dealt out over copies of the value, one for each SHARE rows.
HOT_KEYS = 1024
BROADCAST_CHARS = 16_384
SHARE = 100_000
SPAN = 1024
# Entries of the sketch of frequent keys: it misses none with more than one row in 0.75 * TRACKED.
TRACKED = 16 * HOT_KEYS


def hot_keys(units: DataFrame, key: str, n: str) -> DataFrame:
    """The at most ``HOT_KEYS`` most frequent keys (``n`` > 1)."""
    return units.filter(F.col(n) > 1).orderBy(F.desc(n), F.col(key)).limit(HOT_KEYS)


def spread_join(
    many: DataFrame, one: DataFrame, key: str, n: str, payload: str, scatter: list[str]
) -> DataFrame:
    """``many LEFT JOIN one`` where ``one`` is unique per ``key`` and knows each key's frequency.

    What is hot is decided by frequency alone.  Rows of hot keys with a short (or no) value take it
    from a bounded broadcast, and carry a scattered key into the shuffle join that follows, so
    no partition receives them all; so do rows without a key.  Hot keys with a long value are joined there on key and a
    salt, with as many copies of the value as the key's frequency asks for.  None of the
    remaining keys can be frequent.  ``many`` is read once; ``scatter`` names columns that tell its
    rows apart.
    """
    short = F.coalesce(F.length(payload) <= BROADCAST_CHARS, F.lit(True))
    copies = F.ceil(F.col(n) / SHARE).cast("int")
    hot = hot_keys(one, key, n).select(
        F.col(key).alias("_hot_key"), short.alias("_short"), F.when(short, F.col(payload)).alias("_hot_value"),
        copies.alias("_hot_copies"),
    )
    marked = many.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    # Rows without a key meet nothing, and would all meet in one partition.
    here = F.coalesce(F.col("_short"), F.col(key).isNull())
    scattered = F.concat(F.lit("#"), F.xxhash64(*scatter).cast("string"))
    marked = (
        marked.withColumn("_joins", ~here)
        .withColumn("_join_key", F.when(here, scattered).otherwise(F.col(key)))
        .withColumn("_salt", F.when(F.col("_hot_copies") > 1, F.pmod(F.xxhash64(*scatter), F.col("_hot_copies")).cast("int")).otherwise(0))
    )
    # Keys that aren't hot have one copy, since all of theirs together are few; a copy too many is never met.
    values = one.select(
        F.col(key).alias("_key"), F.col(payload).alias("_value"),
        F.explode(F.sequence(F.lit(0), F.greatest(F.when(~short, copies).otherwise(1), F.lit(1)) - 1)).alias("_copy"),
    )
    joined = marked.join(
        values,
        (F.col("_join_key") == F.col("_key")) & (F.col("_salt") == F.col("_copy")) & F.col("_joins"),
        "left",
    )
    return joined.select(
        *many.columns, F.coalesce(F.col("_hot_value"), F.col("_value")).alias(payload)
    )


def running_start(
    rows: DataFrame, group: list[str], position: str, amount: Column, span: int = SPAN
) -> DataFrame:
    """Adds ``start``: the sum of ``amount`` over earlier positions of the same group.

    A plain window would sort a whole group in one task.  Here a group is cut into spans of
    positions; spans are summed first (with map-side combine), the short list of span sums is
    accumulated, and rows only accumulate within their own span.  ``rows`` is read twice; stage it
    if it is costly.
    """
    cut = rows.withColumn("_span", F.floor(F.col(position) / span)).withColumn("_amount", amount)
    sums = cut.groupBy(*group, "_span").agg(F.sum("_amount").alias("_total"))
    before = Window.partitionBy(*group).orderBy("_span").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = sums.select(
        *group, "_span", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base")
    )
    within = Window.partitionBy(*group, "_span").orderBy(position).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        cut.join(starts, [*group, "_span"])
        .withColumn(
            "start", F.col("_base") + F.coalesce(F.sum("_amount").over(within), F.lit(0))
        )
        .drop("_span", "_amount", "_base")
    )


def dense_index(rows: DataFrame, group: list[str], bucket: Column, order: list[str]) -> DataFrame:
    """Adds ``idx`` = 0, 1, 2, ... per group in order of (bucket, order).

    The bucket must be a function of the row.  Buckets are counted first, so that no task ever
    sees more than one bucket of a group.  ``rows`` is read twice; stage it if it is costly.
    """
    marked = rows.withColumn("_bucket", bucket)
    counts = marked.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = counts.select(
        *group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    within = Window.partitionBy(*group, "_bucket").orderBy(*order)
    return (
        marked.join(starts, [*group, "_bucket"])
        .withColumn("idx", F.col("_base") + F.row_number().over(within) - 1)
        .drop("_bucket", "_base")
    )


def salted_join(
    many: DataFrame, few: DataFrame, keys: list[str], how: str, by: list[str], share: int = SHARE
) -> DataFrame:
    """A left, semi, anti or inner join whose left side may be very uneven over ``keys``.

    Keys are counted first.  A key with more than ``share`` left rows is dealt out over as many
    salts as it has shares, by ``by`` (columns that vary within a key), and the right side's rows
    of that key are repeated once per salt; all other keys have one.  The keys to deal out are at
    most ``HOT_KEYS``, the most frequent ones, and are broadcast.
    """
    frequent = many.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > share)
    frequent = frequent.orderBy(F.desc("_n"), *keys).limit(HOT_KEYS)
    hot = F.broadcast(frequent.select(*keys, F.ceil(F.col("_n") / share).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    left = many.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), salts).cast("int"))
    right = few.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.drop("_salts").join(right.drop("_salts"), [*keys, "_salt"], how).drop("_salt")


def staged_with_hot(rows: DataFrame, keys: list[str], label: str, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """``rows`` written once, and how many salts the keys need that are frequent in them: ``_hash, _salts``.

    A mergeable sketch of the most frequent keys is filled while the rows are written, so they are evaluated and read
    once.  It has at most ``HOT_KEYS`` keys; any with more than 1/HOT_KEYS of all rows is among them.
    """
    seen = Observation()
    top = F.expr(f"approx_top_k(_hash, {HOT_KEYS}, {TRACKED})").alias("top")
    watched = rows.withColumn("_hash", F.xxhash64(*keys)).observe(seen, F.count(F.lit(1)).alias("n"), top)
    staged = stage(watched, label)
    hot = [(r["item"], -(-r["count"] // share)) for r in seen.get["top"] or [] if r["count"] > share]
    return staged, rows.sparkSession.createDataFrame(hot, "_hash long, _salts long")


def dealt_join(staged: DataFrame, hot: DataFrame, few: DataFrame, keys: list[str], how: str, by: list[str]) -> DataFrame:
    """``salted_join`` for rows of ``staged_with_hot`` (or some of them), whose left side is read once and never counted."""
    hot = F.broadcast(hot)
    salts = F.coalesce("_salts", F.lit(1).cast("long"))
    left = staged.join(hot, "_hash", "left").withColumn("_salt", F.pmod(F.xxhash64(*by), salts)).drop("_salts", "_hash")
    right = few.withColumn("_hash", F.xxhash64(*keys)).join(hot, "_hash", "left")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("_salts", "_hash")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def once_join(many: DataFrame, few: DataFrame, keys: list[str], payload: str, share: int = SHARE) -> DataFrame:
    """``many LEFT JOIN few`` where ``payload`` may be long and the same for many keys: each distinct one is shuffled once.

    Keys meet first, with 128 bits of the payload in its place, and the payloads follow by those bits.  One that more than ``share`` keys
    have is copied over salts, and rows without one are spread.
    """
    value = F.col(payload)
    bits = [F.when(value.isNotNull(), h).alias(f"_bits{i}") for i, h in enumerate((F.xxhash64(value), F.xxhash64(F.lit(1), value)))]
    told = few.select(*keys, payload, *bits)
    values = told.filter(value.isNotNull()).groupBy("_bits0", "_bits1", payload).agg(F.count("*").alias("_n"))
    copies = F.ceil(F.col("_n") / share)
    hot = values.filter(F.col("_n") > share).orderBy(F.desc("_n"), "_bits0", "_bits1").limit(HOT_KEYS)
    found = many.join(told.drop(payload), keys, "left")
    found = found.join(F.broadcast(hot.select("_bits0", "_bits1", copies.alias("_salts"))), ["_bits0", "_bits1"], "left")
    place = F.xxhash64(*keys)
    salt = F.when(F.col("_bits0").isNull(), place).otherwise(F.pmod(place, F.coalesce("_salts", F.lit(1).cast("long"))))
    values = values.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("_n")
    return found.withColumn("_salt", salt).join(values, ["_bits0", "_bits1", "_salt"], "left").select(*many.columns, payload)
