"""Words and shingles, once as column expressions and once for Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what stands between two words.
GAPS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where lambdas read it."""
    return F.transform(F.array(value), body).getItem(0)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; everything else as it is.

    Where no other letter has a lower case, the plain function does the same and is much faster.
    """
    others = text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")
    return F.when(others, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words(text: Column, gaps: str = GAPS) -> Column:
    """The words of a text in order; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), gaps), lambda w: w != "")


def word_count(text: Column) -> Column:
    """How many words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def gram_hashes(tokens: Column, size: int) -> Column:
    """A 64-bit hash of each run of ``size`` words; shorter texts have none."""
    starts = F.sequence(F.lit(1), F.size(tokens) - (size - 1))
    return F.when(
        F.size(tokens) >= size,
        F.transform(starts, lambda i: F.xxhash64(F.slice(tokens, i, size))),
    ).otherwise(F.array().cast("array<bigint>"))


def split_bytes(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; the bytes type splits at exactly the characters of GAPS."""
    return text.encode("utf-8", "surrogatepass").split() if text else []
