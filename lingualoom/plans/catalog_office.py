"""Registered queries: office packages, built by Spark from the given documents and read back."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from lingualoom.plans import derived as D
from lingualoom.sources import office as O

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


_MAIN = "http://schemas.openxmlformats.org/{}/2006/main"
_DOC_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_TYPES = {kind: mime for mime, kind in O.MAIN_TYPES.items()}


def pack(main: str, mime: str, parts: dict[str, str], rels: dict[str, list[tuple[str, str]]]) -> bytes:
    """A package with the given XML parts; ``rels`` maps a part to (kind, target) pairs."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(
            "[Content_Types].xml",
            '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
            f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/{main}" ContentType="{mime}"/></Types>',
        )
        for part, targets in {"": [("officeDocument", main)], **rels}.items():
            folder, _, name = part.rpartition("/")
            body = "".join(
                f'<Relationship Id="rId{i}" Type="{_DOC_REL}/{kind}" Target="/{target}"/>'
                for i, (kind, target) in enumerate(targets, start=1)
            )
            z.writestr(
                f"{folder}/_rels/{name}.rels".lstrip("/"),
                f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{body}</Relationships>',
            )
        for part, xml in parts.items():
            z.writestr(part, xml)
    return out.getvalue()


def _run(tag: str, text: str, bold: bool) -> str:
    props = {"w": "<w:rPr><w:b/></w:rPr>", "a": '<a:rPr b="1"/>'}[tag] if bold else ""
    keep = ' xml:space="preserve"' if tag == "w" else ""
    return f"<{tag}:r>{props}<{tag}:t{keep}>{escape(text)}</{tag}:t></{tag}:r>"


def _paragraph(tag: str, line: str) -> str:
    half = len(line) // 2
    runs = _run(tag, line[:half], False) + _run(tag, line[half:], True) if line else ""
    return f"<{tag}:p>{runs}</{tag}:p>"


def make_docx(text: str) -> bytes:
    body = "".join(_paragraph("w", line) for line in text.split("\n"))
    xml = f'<w:document xmlns:w="{_MAIN.format("wordprocessingml")}"><w:body>{body}</w:body></w:document>'
    return pack("word/document.xml", _TYPES["docx"], {"word/document.xml": xml}, {})


def make_pptx(text: str) -> bytes:
    lines = text.split("\n")
    parts, slides = {}, []
    space = f'xmlns:p="{_MAIN.format("presentationml")}" xmlns:a="{_MAIN.format("drawingml")}" xmlns:r="{_DOC_REL}"'
    for n, start in enumerate(range(0, len(lines), 10), start=1):
        body = "".join(_paragraph("a", line) for line in lines[start : start + 10])
        parts[f"ppt/slides/slide{n}.xml"] = (
            f'<p:sld {space}><p:cSld><p:spTree><p:sp><p:nvSpPr><p:cNvPr id="2" name="Body"/><p:nvPr/></p:nvSpPr>'
            f"<p:txBody>{body}</p:txBody></p:sp></p:spTree></p:cSld></p:sld>"
        )
        slides.append(("slide", f"ppt/slides/slide{n}.xml"))
    ids = "".join(f'<p:sldId id="{255 + i}" r:id="rId{i}"/>' for i in range(1, len(slides) + 1))
    main = "ppt/presentation.xml"
    parts[main] = f"<p:presentation {space}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>"
    return pack(main, _TYPES["pptx"], parts, {main: slides})


def make_xlsx(text: str) -> bytes:
    """Lines down column A: every fifth an inline string, the others shared; a formula in B1."""
    space = f'xmlns="{_MAIN.format("spreadsheetml")}"'
    shared: dict[str, int] = {}
    cells = []
    for n, line in enumerate(text.split("\n"), start=1):
        if n % 5 == 0:
            cell = f'<c r="A{n}" t="inlineStr"><is><t xml:space="preserve">{escape(line)}</t></is></c>'
        else:
            cell = f'<c r="A{n}" t="s"><v>{shared.setdefault(line, len(shared))}</v></c>'
        extra = '<c r="B1"><f>IF(A1="x","y","")</f><v>0</v></c>' if n == 1 else ""
        cells.append(f'<row r="{n}">{cell}{extra}</row>')
    main, sheet, strings = "xl/workbook.xml", "xl/worksheets/sheet1.xml", "xl/sharedStrings.xml"
    parts = {
        main: f'<workbook {space} xmlns:r="{_DOC_REL}"><sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>',
        sheet: f"<worksheet {space}><sheetData>{''.join(cells)}</sheetData></worksheet>",
        strings: f"<sst {space}>" + "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in shared) + "</sst>",
    }
    return pack(main, _TYPES["xlsx"], parts, {main: [("worksheet", sheet), ("sharedStrings", strings)]})


_MAKERS = {"docx": make_docx, "pptx": make_pptx, "xlsx": make_xlsx}


def _files(spark, sf, kind: str):
    make = _MAKERS[kind]

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "content": frame["text"].map(make)})

    docs = D.table(spark, sf, "documents").select("doc_id", "text")
    return docs.mapInPandas(run, "doc_id long, content binary")


_LINES = f"""l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
    k AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INTEGER AS seg_no FROM l WHERE NOT {D.sql_blank('line')})"""


def _shown(rows):
    return rows.select(
        "doc_id", "seg_no", "location",
        F.array_join(F.transform("nodes", lambda n: n["text"]), "").alias("text"),
        F.size("nodes").alias("n_nodes"),
    )


@query(
    "scan_docx",
    f"""WITH {_LINES} SELECT doc_id, seg_no, 'body / paragraph ' || n AS location, line AS text, 2::INTEGER AS n_nodes FROM k""",
)
def scan_docx(spark, sf):
    return _shown(O.paragraphs(O.scan_docx(_files(spark, sf, "docx"))))


@query(
    "scan_pptx",
    f"""WITH {_LINES} SELECT doc_id, seg_no, 'slide ' || ((n - 1) // 10 + 1) || ' / shape "Body" (id 2) / paragraph ' || ((n - 1) % 10 + 1) AS location,
      line AS text, 2::INTEGER AS n_nodes FROM k""",
)
def scan_pptx(spark, sf):
    return _shown(O.paragraphs(O.scan_pptx(_files(spark, sf, "pptx"))))


@query(
    "scan_xlsx",
    f"""WITH {_LINES}, c AS (SELECT doc_id, line, min(n) AS n, count(*) AS cells, 1 AS shared FROM l WHERE n % 5 <> 0 GROUP BY doc_id, line
      UNION ALL SELECT doc_id, line, n, 1, 0 FROM l WHERE n % 5 = 0),
    f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY shared, n) - 1 AS s FROM c WHERE NOT {D.sql_blank('line')})
    SELECT doc_id, s::INTEGER AS seg_no, 'sheet "Data" / A' || n || CASE WHEN cells > 1 THEN ' (and ' || (cells - 1) || ' more cells)' ELSE '' END AS location,
      line AS text, 1::INTEGER AS n_nodes FROM f""",
)
def scan_xlsx(spark, sf):
    return _shown(O.xlsx_segments(O.scan_xlsx(_files(spark, sf, "xlsx"))))


@query("ooxml_kind", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'docx' WHEN 1 THEN 'pptx' END AS kind, CASE WHEN doc_id % 3 = 2 THEN 'unsupported_document' END AS error_code FROM documents")
def ooxml_kind(spark, sf):
    def run(frames):
        for frame in frames:
            made = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                data = make_docx(text) if doc_id % 3 == 0 else make_pptx(text)
                if doc_id % 3 == 2:
                    mime = "application/vnd.ms-powerpoint.presentation.macroEnabled.main+xml"
                    data = pack("ppt/presentation.xml", mime, {"ppt/presentation.xml": "<x/>"}, {})
                made.append(data)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "content": made})

    docs = D.table(spark, sf, "documents").select("doc_id", "text")
    return O.ooxml_kind(docs.mapInPandas(run, "doc_id long, content binary"))


@query(
    "package_limits",
    """WITH p AS (SELECT doc_id, octet_length(encode(text)) AS n, doc_id % 4 AS k FROM documents)
    SELECT doc_id, (CASE k WHEN 0 THEN 1 ELSE 2 END)::BIGINT AS entries, (CASE k WHEN 0 THEN n ELSE n + 3 END)::BIGINT AS bytes,
      CASE WHEN k = 3 AND n > 20000 THEN 'document_limit' WHEN k = 1 THEN CASE WHEN n > 20000 THEN 'document_limit' ELSE 'invalid_document' END
        WHEN k = 2 THEN CASE WHEN n > 20000 THEN 'document_limit' ELSE 'unsupported_document' END
        WHEN n > 20000 THEN 'document_limit' END AS error_code FROM p""",
)
def package_limits(spark, sf):
    second = {1: "../up.xml", 2: "_xmlsignatures/s.xml", 3: "b.xml"}

    def run(frames):
        for frame in frames:
            made = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr("a.xml", text)
                    if doc_id % 4:
                        z.writestr(second[doc_id % 4], "abc")
                made.append(out.getvalue())
            yield pd.DataFrame({"doc_id": frame["doc_id"], "content": made})

    docs = D.table(spark, sf, "documents").select("doc_id", "text")
    entries = O.package_entries(docs.mapInPandas(run, "doc_id long, content binary"))
    return O.package_limits(entries, max_entry_bytes=20000)
