"""Spans that must not be translated, and the placeholders that stand for them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingualoom.functions import chars as C
from lingualoom.functions import text as X

# ---- fixed values: what counts as protected ------------------------------------------------------
TRAILING_PUNCTUATION = ".,;:!?)]}'\"。，、；：！？）】」』"
_CJK_MARKS = r"\x{3000}-\x{303F}\x{FF00}-\x{FFEF}"
TAG_LIKE = rf"(?i:</?[{C.WS}]*[gx][{C.WS}]*\p{{Nd}}+[{C.WS}]*/?[{C.WS}]*>)"
SPAN_PATTERNS = {
    "url": rf"(?:https?|ftp)://[^{C.WS}<>\"'{_CJK_MARKS}]+",
    "www": rf"(?<![{C.WORD}])www\.[^{C.WS}<>\"'{_CJK_MARKS}]+",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "drive": rf"(?<![{C.WORD}])[A-Za-z]:\\[^{C.WS}<>\"|?*{_CJK_MARKS}]+",
    "unc": rf"\\\\[^{C.WS}\\<>\"|?*]+\\[^{C.WS}<>\"|?*{_CJK_MARKS}]+",
    "unix": rf"(?<![{C.WORD}/.])/(?:[{C.WORD}.-]+/)+[{C.WORD}.-]*",
}
# ---- end of fixed values -------------------------------------------------------------------------

SPANS = "|".join(f"(?:{p})" for p in SPAN_PATTERNS.values())
# Tag-like text contains no character that a span pattern could start before, so one alternation
# finds both in one scan.
PROTECTED = f"(?:{TAG_LIKE})|{SPANS}"
_HINTS = ("/", "@", "\\", "www.", "<")
_TAIL = "[" + re.escape(TRAILING_PUNCTUATION) + "]+$"


def may_hold_span(text: Column) -> Column:
    """Every pattern needs one of these; most lines have none and skip the regex."""
    return X.contains_any(text, _HINTS)


def _matches(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({PROTECTED})"), F.lit(0))


def _trim_tail(match: Column) -> Column:
    return F.regexp_replace(match, _TAIL, "")


def protected_spans(text: Column) -> Column:
    """Kept texts in order, without their trailing punctuation."""
    return F.when(may_hold_span(text), F.transform(_matches(text), _trim_tail)).otherwise(
        F.array().cast("array<string>")
    )


def _around_spans(text: Column, middle) -> Column:
    """The text with ``middle(i)`` in place of the i-th protected span.

    ``split`` and ``regexp_extract_all`` walk the same matches, so piece *i+1* follows match *i*;
    punctuation cut from a match's end goes back in front of that piece.  The two lists are zipped
    first: an expression inside a lambda would be evaluated again for every element.
    """
    pieces = F.split(text, PROTECTED, -1)
    no_match_first = F.concat(F.array(F.lit("")), _matches(text))
    rest = F.transform(
        F.arrays_zip(no_match_first.alias("m"), pieces.alias("p")),
        lambda x, i: F.concat(
            F.when(i > 0, middle(i)).otherwise(F.lit("")),
            F.substring(x["m"], F.length(_trim_tail(x["m"])) + 1, F.length(x["m"])),
            x["p"],
        ),
    )
    return F.when(may_hold_span(text), F.array_join(rest, "")).otherwise(text)


def outside_spans(text: Column) -> Column:
    """The text between protected spans."""
    return _around_spans(text, lambda i: F.lit(""))


def encode_line(text: Column) -> Column:
    """Engine input of a plain line: every protected span becomes ``<xN/>``."""
    return _around_spans(
        text, lambda i: F.concat(F.lit("<x"), i.cast("string"), F.lit("/>"))
    )


def fill_spans(output: Column, spans: Column) -> Column:
    """Put the kept texts back in place of ``<xN/>``.  ``spans`` should be a plain column."""
    holes = F.regexp_extract_all(output, F.lit("<x([0-9]+)/>"), F.lit(1))
    filled = F.transform(
        F.arrays_zip(
            F.concat(F.array(F.lit(None).cast("string")), holes).alias("n"),
            F.split(output, "<x[0-9]+/>", -1).alias("p"),
        ),
        lambda x: F.concat(F.coalesce(F.get(spans, x["n"].cast("int") - 1), F.lit("")), x["p"]),
    )
    return F.when(F.size(spans) > 0, F.array_join(filled, "")).otherwise(output)


def with_protection(rows: DataFrame, text: str) -> DataFrame:
    """Adds ``_kept`` (``protected_spans``), ``_input`` (``encode_line``) and ``_rest`` (``outside_spans``) of a column.

    The patterns run twice over a text that may hold a span, and not at all over any other.  Each
    step is a column that the next ones name, since an expression is evaluated wherever it stands.
    """
    core, found = F.col(text), F.col("_found")
    rows = rows.withColumn("_found", F.when(may_hold_span(core), _matches(core)))
    rows = rows.withColumn("_kept", F.when(found.isNotNull(), F.transform(found, _trim_tail)))
    # ``split`` compiles its pattern for every row unless that is one plain character.
    gap = "\x00"
    pieces = F.when(F.contains(core, F.lit(gap)), F.split(core, PROTECTED, -1)).otherwise(
        F.split(F.regexp_replace(core, PROTECTED, gap), gap, -1)
    )
    # What follows each kept text, and first what stands before all of them.
    first = F.array(F.lit(""))
    cut = F.arrays_zip(
        F.concat(first, found).alias("m"), F.concat(first, F.col("_kept")).alias("k"), pieces.alias("p")
    )
    after = F.transform(cut, lambda x: F.concat(F.substring(x["m"], F.length(x["k"]) + 1, F.length(x["m"])), x["p"]))
    rows = rows.withColumn("_after", F.when(F.size("_kept") > 0, after))
    marked = F.transform(
        "_after", lambda x, i: F.when(i > 0, F.concat(F.lit("<x"), i.cast("string"), F.lit("/>"), x)).otherwise(x)
    )
    some = F.col("_after").isNotNull()
    return rows.withColumns(
        {
            "_kept": F.coalesce("_kept", F.array().cast("array<string>")),
            "_input": F.when(some, F.array_join(marked, "")).otherwise(core),
            "_rest": F.when(some, F.array_join("_after", "")).otherwise(core),
        }
    ).drop("_found", "_after")


def passes_through(text: Column, lang: Column) -> Column:
    """Nothing to translate: no letter outside protected spans, or none of the source's script."""
    return nothing_to_translate(outside_spans(text), lang)


def nothing_to_translate(rest: Column, lang: Column) -> Column:
    """``passes_through`` for a text whose protected spans are gone."""
    # A Latin script letter is a letter; the CJK blocks also hold marks that are none.
    is_letter = rest.rlike(r"\p{L}") | ~lang.isin(*C.CJK_LANGUAGES)
    # Most texts in these languages hold a character that is both, and are decoded for one search only.
    plain = lang.isin(*C.CJK_LANGUAGES) & rest.rlike(rf"[{C.CJK}&&[\p{{L}}]]")
    return F.when(plain, F.lit(False)).otherwise(~(X.has_script_letter(rest, lang) & is_letter))


def tag_like_spans(text: Column) -> Column:
    """``array<struct<start,end>>`` of what looks like a tag, in one pass."""
    return F.when(F.contains(text, F.lit("<")), _places(text, TAG_LIKE, lambda match: F.length(match))).otherwise(
        F.array().cast("array<struct<start:int,end:int>>")
    )


def _places(text: Column, pattern: str, kept) -> Column:
    """Start of each match, and its end after ``kept`` of its characters."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0))
    pairs = F.zip_with(
        F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda gap, match: F.struct(gap.alias("gap"), match.alias("match"))
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        span = F.struct(start.alias("start"), (start + kept(pair["match"])).alias("end"))
        return F.struct((start + F.length(pair["match"])).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    return F.aggregate(pairs, zero, step, lambda acc: acc["spans"])


SPANS_TYPE = "array<struct<start:int,end:int>>"


def no_spans() -> Column:
    return F.array().cast(SPANS_TYPE)


def plain_spans(text: Column) -> Column:
    """``array<struct<start,end>>`` of what the patterns protect, found by one expression."""
    found = _places(text, f"(?:{TAG_LIKE})|(?:{SPANS})", lambda match: F.length(_trim_tail(match)))
    return F.when(may_hold_span(text), found).otherwise(no_spans())


class Terms:
    """Patterns and exact terms, found together from left to right.

    The terms are one automaton (a trie with failure links), so a text is read once, however many terms there are.
    What begins inside a match is part of it.  At the same place a longer term comes before a
    shorter one.  No pattern runs over a blank, so a term with one is longer than a pattern's match there and
    comes first; others come after.  Punctuation at the end belongs to a term, but not to what a pattern found.
    """

    def __init__(self, terms: Sequence[str]):
        self.terms = tuple(sorted({t for t in terms if t}))

    @cached_property
    def _tools(self) -> tuple:
        import ahocorasick
        import regex

        automaton = ahocorasick.Automaton()
        for term in self.terms:
            automaton.add_word(term, (len(term), bool(re.search(r"\s", term))))
        automaton.make_automaton()

        def ours(pattern: str):
            return regex.compile(re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", pattern))

        return automaton, ours(f"(?P<tag>{TAG_LIKE})|(?:{SPANS})"), regex.compile(_TAIL)

    def __getstate__(self) -> dict:
        return {"terms": self.terms}

    def find(self, text: str) -> list[tuple[int, int]]:
        """Start and end of each kept stretch."""
        automaton, pattern, tail = self._tools
        longest: dict[int, dict[bool, int]] = {}
        for last, (size, blank) in automaton.iter(text):
            own = longest.setdefault(last + 1 - size, {})
            own[blank] = max(own.get(blank, 0), last + 1)
        starts, out, at, turn = sorted(longest), [], 0, 0
        match = pattern.search(text) if any(hint in text for hint in _HINTS) else None
        while True:
            while turn < len(starts) and starts[turn] < at:
                turn += 1
            if match is not None and match.start() < at:
                match = pattern.search(text, at)
                continue
            if match is None and turn == len(starts):
                return out
            first = starts[turn] if turn < len(starts) else len(text) + 1
            here = longest.get(first, {})
            tied = match is not None and match.start() == first
            if match is not None and (match.start() < first or tied and (match["tag"] is not None or True not in here)):
                whole = match[0]
                end = match.end()
                out.append((match.start(), end if whole in self.terms_set else match.start() + len(tail.sub("", whole))))
            else:
                end = here.get(True) or here[False]
                out.append((first, end))
            at = end

    def _live(self, texts: pa.Array) -> np.ndarray:
        """Which of many texts may hold something: a hint of a pattern, or a term found in all of them in one go."""
        hints = "|".join(map(re.escape, _HINTS))
        told = pc.fill_null(pc.match_substring_regex(texts, hints), False).to_numpy(zero_copy_only=False).copy()
        # A separator that is in no term, so that no match runs from one text into the next.
        gap = next(c for c in map(chr, range(0x10FFFF, 0, -1)) if not any(c in t for t in self.terms))
        texts = pc.fill_null(texts, "")
        whole = pc.binary_join(pa.ListArray.from_arrays([0, len(texts)], texts), gap)[0].as_py() if len(texts) else ""
        starts = np.append(0, np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1))
        found = [last for last, _ in self._tools[0].iter(whole)]
        told[np.searchsorted(starts, np.array(found, np.int64), "right") - 1] = True
        return told

    @cached_property
    def terms_set(self) -> frozenset[str]:
        return frozenset(self.terms)

    def spans(self, text: Column | str) -> Column:
        """``array<struct<start,end>>`` for a text column."""
        find = self.find

        @F.pandas_udf(SPANS_TYPE)
        def found(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: None if t is None else [{"start": a, "end": b} for a, b in find(t)])

        return found(text)

    def spans_of_each(self, texts: Column) -> Column:
        """The same for each text of an array column; a batch's texts and spans lie in flat Arrow arrays."""
        find, live = self.find, self._live

        @F.arrow_udf(f"array<{SPANS_TYPE}>")
        def found(lists: pa.Array) -> pa.Array:
            flat = lists.flatten()
            some = live(flat)
            each: list[list[tuple[int, int]]] = [[] for _ in some]
            for k, text in zip(np.flatnonzero(some).tolist(), flat.filter(pa.array(some)).to_pylist(), strict=True):
                each[k] = find(text)
            bounds = [np.array([s[i] for spans in each for s in spans], np.int32) for i in (0, 1)]
            spans = pa.StructArray.from_arrays(list(map(pa.array, bounds)), ["start", "end"])
            counts = np.fromiter(map(len, each), np.int64, len(each))
            inner = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), spans)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            return pa.ListArray.from_arrays(ends, inner, mask=pc.is_null(lists))

        return found(texts)


def spans_with_terms(terms: Sequence[str]):
    """Expression ``text -> array<struct<start,end>>`` that also protects exact terms; without terms it is built in."""
    some = Terms(terms)
    return some.spans if some.terms else lambda text: plain_spans(F.col(text) if isinstance(text, str) else text)


def encode_line_with_terms(text: Column, spans: Column) -> Column:
    """``encode_line`` for spans given as offsets."""
    pieces = F.transform(
        spans,
        lambda s, i: F.concat(
            F.substring(
                text,
                F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)) + 1,
                s["start"] - F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)),
            ),
            F.lit("<x"),
            (i + 1).cast("string"),
            F.lit("/>"),
        ),
    )
    tail = F.substring(
        text, F.coalesce(F.element_at(spans, -1)["end"], F.lit(0)) + 1, F.length(text)
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(pieces, ""), tail))


def span_texts(text: Column, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"]))
