"""Text predicates and projections."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lingualoom.functions import chars as C


def strip(text: Column) -> Column:
    """Without outer Unicode whitespace.  ``btrim`` only walks inwards from the two ends."""
    return F.btrim(text, F.lit(C.WS_CHARS))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(C.WS_CHARS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(C.WS_CHARS))


def strip_column(text: Column) -> Column:
    """``strip`` of a plain column (it is named several times).

    ``rtrim`` measures every character before it looks at the last, so a text whose last byte is
    printable ASCII only loses what is in front.
    """
    last = F.substring(text.cast("binary"), -1, 1)
    return F.when((last >= F.unhex(F.lit("21"))) & (last <= F.unhex(F.lit("7E"))), lstrip(text)).otherwise(strip(text))


def is_blank(text: Column) -> Column:
    """``ltrim`` stops at the first character that stays."""
    return lstrip(text) == ""


def leading_ws(text: Column) -> Column:
    """Outer whitespace in front; a whitespace-only text is all leading."""
    return F.substring(text, F.lit(1), F.length(text) - F.length(lstrip(text)))


def trailing_ws(text: Column) -> Column:
    return F.when(is_blank(text), F.lit("")).otherwise(
        F.substring(text, F.length(rstrip(text)) + 1, F.length(text))
    )


def count_class(text: Column, body: str) -> Column:
    """How many characters fall in a class: what is left after deleting all the others."""
    return F.length(F.regexp_replace(text, f"[^{body}]+", ""))


def count_latin(text: Column) -> Column:
    """Latin letters.  The long class only looks at what is left without ASCII, often nothing."""
    plain = count_class(text, "A-Za-z")
    rest = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    return F.when(F.octet_length(text) == F.length(text), plain).otherwise(
        plain + count_class(rest, C.LATIN)
    )


def script_letters(text: Column, lang: Column) -> Column:
    """Characters of the source language's script: Han and kana for zh and ja, else Latin letters."""
    return F.when(lang.isin(*C.CJK_LANGUAGES), count_class(text, C.CJK)).otherwise(
        count_latin(text)
    )


def has_script_letter(text: Column, lang: Column) -> Column:
    # The long class is only tried on what is not ASCII.
    latin = text.rlike(rf"[A-Za-z]|(?=[^\x00-\x7F])[{C.LATIN}]")
    return F.when(lang.isin(*C.CJK_LANGUAGES), text.rlike(f"[{C.CJK}]")).otherwise(latin)


def clean_text(text: Column) -> Column:
    """Safe for an XML text node: line breaks become spaces, illegal controls go."""
    spaced = F.regexp_replace(text, r"\r\n|\r|\n|\x{2028}|\x{2029}", " ")
    return F.regexp_replace(spaced, f"[{C.XML_ILLEGAL}]", "")


def xml_text_ok(text: Column) -> Column:
    return ~text.rlike(f"[{C.XML_ILLEGAL}]")


def newline_to_space(text: Column) -> Column:
    """One line per segment for scoring; each break character becomes one space."""
    return F.translate(text, "\r\n", "  ")


def one_line(text: Column) -> Column:
    """A translated line never gains a line break; most have none and skip the regex."""
    return F.when(contains_any(text, ("\n", "\r")), F.regexp_replace(text, C.LINE_BREAK, " ")).otherwise(text)


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    """A cheap byte search in front of an expensive pattern."""
    result = F.lit(False)
    for needle in needles:
        result = result | F.contains(text, F.lit(needle))
    return result


def language_slug(model: Column) -> Column:
    """Model name as part of a run id."""
    dashed = F.regexp_replace(model, r"[^A-Za-z0-9._-]+", "-")
    return F.coalesce(F.nullif(F.btrim(dashed, F.lit("-")), F.lit("")), F.lit("model"))


def run_id(created_at: Column, mode: Column, model: Column) -> Column:
    stamp = F.date_format(created_at, "yyyyMMdd'T'HHmmss'Z'")
    return F.concat_ws("-", stamp, mode, language_slug(model))
