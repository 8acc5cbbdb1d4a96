"""Character classes, shared by queries and by the SQL that checks them.

Java and RE2 disagree on the shorthand classes, so every class is spelled out in code points.
"""

from __future__ import annotations

import unicodedata

# ---- fixed values: code-point ranges that decide results -----------------------------------------
WHITESPACE_RANGES = (
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)
KANA_RANGES = ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D))
HAN_RANGES = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F))
# The marker engine and the joining rule each look at a slightly different CJK set.
MARKER_CJK_RANGES = (
    (0x3000, 0x303F), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xFF00, 0xFFEF),
)
JOIN_CJK_RANGES = (
    (0x3000, 0x303F), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF),
    (0xFF00, 0xFFEF),
)
XML_ILLEGAL_RANGES = ((0x00, 0x08), (0x0B, 0x0C), (0x0E, 0x1F), (0xFFFE, 0xFFFF))
LINE_BREAK = r"\r\n|\n|\r"
CJK_LANGUAGES = ("zh", "ja")
# ---- end of fixed values -------------------------------------------------------------------------


def class_body(ranges) -> str:
    """The inside of a regex class, readable by both Java and RE2."""
    return "".join(
        f"\\x{{{lo:X}}}" if lo == hi else f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in ranges
    )


def _latin_ranges() -> tuple[tuple[int, int], ...]:
    """Letters whose Unicode name says LATIN (so not the ordinal signs, which are Latin script)."""
    ranges: list[list[int]] = []
    for code in range(0x20000):
        char = chr(code)
        if char.isalpha() and "LATIN" in unicodedata.name(char, ""):
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return tuple((lo, hi) for lo, hi in ranges)


LATIN_RANGES = _latin_ranges()

WS = class_body(WHITESPACE_RANGES)
WS_CHARS = "".join(chr(c) for lo, hi in WHITESPACE_RANGES for c in range(lo, hi + 1))
KANA = class_body(KANA_RANGES)
HAN = class_body(HAN_RANGES)
CJK = class_body(KANA_RANGES + HAN_RANGES)
LATIN = class_body(LATIN_RANGES)
MARKER_CJK = class_body(MARKER_CJK_RANGES)
JOIN_CJK = class_body(JOIN_CJK_RANGES)
XML_ILLEGAL = class_body(XML_ILLEGAL_RANGES)
WORD = r"\p{L}\p{N}_"
