"""Plain-text documents: bytes to text, text to lines, and the format of any file."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingualoom.functions import chars as C
from lingualoom.functions import text as X

# ---- fixed values: signatures and limits ---------------------------------------------------------
FORMATS = ("txt", "pptx", "docx", "xlsx", "pdf")
OLE_HEAD = "D0CF11E0A1B11AE1"
ZIP_HEADS = ("504B0304", "504B0506")
PDF_HEAD = "255044462D"
MAX_TEXT_BYTES = 100 << 20
MAX_SEGMENTS = 200_000
# ---- end of fixed values -------------------------------------------------------------------------

# The same matches as ``C.LINE_BREAK``, but every other character is refused by one look at it.
LINE_CUT = r"[\r\n](?:(?<=\r)\n)?"

# Encodings Spark decodes itself; every other charset goes through Arrow.
_NATIVE = {"utf-8": "UTF-8", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE"}


def lines_of(text: Column) -> Column:
    """``array<struct<seg_no,line,ending>>`` with every line, blank or not; the last has no ending."""
    return F.transform(
        F.arrays_zip(
            F.split(text, LINE_CUT, -1).alias("line"),
            F.regexp_extract_all(text, F.lit(LINE_CUT), F.lit(0)).alias("ending"),
        ),
        lambda x, i: F.struct(
            i.alias("seg_no"),
            x["line"].alias("line"),
            F.coalesce(x["ending"], F.lit("")).alias("ending"),
        ),
    )


def scan_txt_lines(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """All lines of every document; ``is_segment`` marks those with something besides whitespace.

    A map over rows: no shuffle, and a document is never gathered again to be split.  The generator
    is an outer one, since Spark would make the list a second time to filter by its size below an inner one.
    """
    return docs.select("doc_id", *keep, F.inline_outer(lines_of(F.col(text)))).filter(F.col("seg_no").isNotNull()).select(
        "doc_id",
        *keep,
        "seg_no",
        F.concat(F.lit("line "), (F.col("seg_no") + 1).cast("string")).alias("location"),
        "line",
        "ending",
        (~X.is_blank(F.col("line"))).alias("is_segment"),
    )


def scan_segments(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Only the translatable lines, without endings."""
    kept = F.filter(
        F.transform(
            F.split(F.col(text), LINE_CUT, -1),
            lambda line, i: F.struct(i.alias("seg_no"), line.alias("line")),
        ),
        lambda s: ~X.is_blank(s["line"]),
    )
    return docs.select("doc_id", *keep, F.inline_outer(kept)).filter(F.col("seg_no").isNotNull())


def decode_txt(docs: DataFrame, content: str = "content", encoding: str | None = None) -> DataFrame:
    """``content`` bytes to ``text`` with ``encoding``, ``bom`` (hex) and ``error_code``.

    A BOM decides unless the caller names an encoding.  Bytes that do not decode, and unknown
    encodings, are rejected in ``error_code``; nothing is replaced.
    """
    data = F.col(content)
    if encoding is None:
        head = F.hex(F.substring(data, F.lit(1), F.lit(3)))
        bom = (
            F.when(head == "EFBBBF", F.lit("EFBBBF"))
            .when(head.startswith("FFFE"), F.lit("FFFE"))
            .when(head.startswith("FEFF"), F.lit("FEFF"))
            .otherwise(F.lit(""))
        )
        name = (
            F.when(bom == "FFFE", F.lit("utf-16-le"))
            .when(bom == "FEFF", F.lit("utf-16-be"))
            .otherwise(F.lit("utf-8"))
        )
        start = (F.length(bom) / 2).cast("int") + 1
        docs = docs.select(
            "*",
            name.alias("encoding"),
            bom.alias("bom"),
            F.substring(data, start, F.length(data)).alias("_body"),
        )
    else:
        docs = docs.select(
            "*", F.lit(encoding).alias("encoding"), F.lit("").alias("bom"), data.alias("_body")
        )
    body = F.col("_body")
    if encoding is None or encoding.lower() in _NATIVE:
        # UTF-16 needs whole code units and paired surrogates: deleting those from the hex form,
        # one after the other, must leave nothing.
        unit = {
            "utf-16-le": r"\G(?:..(?!D[89A-F])..|..D[89AB]..D[C-F])",
            "utf-16-be": r"\G(?:(?!D[89A-F])....|D[89AB]..D[C-F]..)",
        }
        chosen = F.col("encoding")
        ok = F.when(chosen == "utf-8", F.is_valid_utf8(body.cast("string")))
        text = F.when(chosen == "utf-8", body.cast("string"))
        for utf16, pattern in unit.items():
            ok = ok.when(chosen == utf16, F.regexp_replace(F.hex(body), pattern, "") == "")
            text = text.when(chosen == utf16, F.decode(body, _NATIVE[utf16]))
        text = F.when(ok, text)
    else:
        text = _arrow_decode(encoding)(body)
    return docs.withColumn("text", text).select(
        *[c for c in docs.columns if c not in (content, "_body")],
        "text",
        F.when(F.col("text").isNull(), F.lit("invalid_document")).alias("error_code"),
    )


def _arrow_decode(encoding: str):
    @F.pandas_udf("string")
    def decode(batch: pd.Series) -> pd.Series:
        def one(data: bytes | None) -> str | None:
            try:
                return None if data is None else bytes(data).decode(encoding)
            except (UnicodeDecodeError, LookupError):
                return None

        return batch.map(one)

    return decode


def encode_txt(text: Column, encoding: Column, bom: Column) -> Column:
    """Bytes of a rebuilt file in its original Unicode encoding, BOM included."""
    body = (
        F.when(encoding == "utf-16-le", F.encode(text, "UTF-16LE"))
        .when(encoding == "utf-16-be", F.encode(text, "UTF-16BE"))
        .otherwise(F.encode(text, "UTF-8"))
    )
    return F.concat(F.unhex(bom), body)


def detect_format(
    files: DataFrame,
    path: str = "path",
    content: str = "content",
    office_kind: str | None = None,
    max_text_bytes: int = MAX_TEXT_BYTES,
) -> DataFrame:
    """Adds ``format`` and ``error_code``: the content decides and the extension must agree.

    ``office_kind`` names a column with the kind found inside ZIP packages (see ``office``);
    without it a package is taken at its extension's word.
    """
    claimed = F.lower(F.regexp_extract(F.col(path), r"\.([^./\\]+)$", 1))
    head = F.hex(F.substring(F.col(content), F.lit(1), F.lit(8)))
    is_zip = head.startswith(ZIP_HEADS[0]) | head.startswith(ZIP_HEADS[1])
    inside = F.col(office_kind) if office_kind else F.when(claimed.isin(*FORMATS[1:4]), claimed)
    actual = (
        F.when(head.startswith(OLE_HEAD), F.lit(None))
        .when(is_zip, inside)
        .when(head.startswith(PDF_HEAD), F.lit("pdf"))
        .when(claimed == "txt", F.lit("txt"))
    )
    error = (
        F.when(~claimed.isin(*FORMATS), F.lit("unsupported_document"))
        .when(head.startswith(OLE_HEAD), F.lit("unsupported_document"))
        .when(actual.isNull() & is_zip, F.lit("unsupported_document"))
        .when(actual.isNull(), F.lit("invalid_document"))
        .when(actual != claimed, F.lit("unsupported_document"))
        .when(
            actual.isin("txt", "pdf") & (F.length(F.col(content)) > max_text_bytes),
            F.lit("document_limit"),
        )
    )
    return files.select(
        "*",
        F.when(error.isNull(), actual).alias("format"),
        error.alias("error_code"),
    )


def doc_limits(
    docs: DataFrame,
    text: str = "text",
    max_segments: int = MAX_SEGMENTS,
    max_text_bytes: int = MAX_TEXT_BYTES,
) -> DataFrame:
    """One row per document with its size and ``error_code``; nothing is truncated.

    Text is still whole in its row here, so both limits are row expressions.  For segment tables
    use :func:`segment_limits`.
    """
    n = F.size(F.filter(F.split(F.col(text), C.LINE_BREAK, -1), lambda s: ~X.is_blank(s)))
    size = F.octet_length(F.col(text))
    return docs.select(
        "doc_id",
        n.alias("segments"),
        size.alias("text_bytes"),
        F.when((size > max_text_bytes) | (n > max_segments), F.lit("document_limit")).alias(
            "error_code"
        ),
    )


def segment_limits(segments: DataFrame, max_segments: int = MAX_SEGMENTS) -> DataFrame:
    """Documents of a segment table that exceed the paragraph limit."""
    return (
        segments.groupBy("doc_id")
        .agg(F.count("*").alias("segments"))
        .filter(F.col("segments") > max_segments)
        .withColumn("error_code", F.lit("document_limit"))
    )
