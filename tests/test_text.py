"""Lines, encodings, protection and the whole text job on byte-exact cases."""

from pyspark.sql import functions as F

from lingualoom.functions import protect as P
from lingualoom.operators import report, units
from lingualoom.plans import corpus as jobs
from lingualoom.sources import text as S


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, lang string, text string")


def translated(spark, text, lang="zh"):
    table = docs(spark, (1, lang, text))
    done = jobs.rebuild_documents(jobs.translate_lines(table, "en", every_line=True))
    return done.first()["text"]


def test_line_structure_and_endings_survive(spark):
    out = translated(spark, "\t山 水 \r第二\n\r\n 三\r\n")
    assert out == "\tEN:x x \rEN:xx\n\r\n EN:x\r\n"


def test_a_failed_line_is_an_error_not_a_shorter_document(spark):
    table = docs(spark, (1, "zh", "山\n水\n火"), (2, "zh", "木\n12"))
    done = jobs.translate_lines(table, "en", every_line=True).withColumn(
        "translated", F.when(F.col("line") != "水", F.col("translated"))
    )
    got = {r["doc_id"]: (r["text"], r["error_code"], r["lost"]) for r in jobs.rebuild_documents(done).collect()}
    assert got == {1: (None, "engine_response", 1), 2: ("EN:x\n12", None, 0)}
    kept = units.fallback_to_source(done, "translated", "line")
    assert {r["text"] for r in jobs.rebuild_documents(kept).collect()} == {"EN:x\n水\nEN:x", "EN:x\n12"}


def test_lines_without_source_script_pass_through(spark):
    text = "3 + 4 = 7\nftp://files.example.net/a/b\nRFC 2119\n河流\n"
    assert translated(spark, text) == "3 + 4 = 7\nftp://files.example.net/a/b\nRFC 2119\nEN:xx\n"
    occ = units.occurrences(S.scan_segments(docs(spark, (1, "zh", text)), keep=("lang",)))
    counts = report.segment_counts(occ).first()
    assert (counts["segments"], counts["passed_through"], counts["unique_inputs"]) == (4, 3, 1)


def test_equal_lines_are_asked_once(spark):
    text = "\n".join(f"河{k % 9}" for k in range(50))
    occ = units.occurrences(S.scan_segments(docs(spark, (1, "zh", text), (2, "zh", text)), keep=("lang",)))
    assert occ.count() == 100 and units.unique_units(occ).count() == 9


def test_terms_and_addresses_become_placeholders(spark):
    text = "把 Blue Heron 的照片寄到 heron@birds.example.org，谢谢 Blue！"
    row = docs(spark, (1, "zh", text)).withColumn(
        "spans", P.spans_with_terms(["Blue", "Blue Heron"])("text")
    ).select(
        P.encode_line_with_terms(F.col("text"), F.col("spans")).alias("with_terms"),
        P.encode_line(F.col("text")).alias("plain"),
        P.span_texts(F.col("text"), F.col("spans")).alias("kept"),
    ).first()
    assert row["with_terms"] == "把 <x1/> 的照片寄到 <x2/>，谢谢 <x3/>！"
    assert row["plain"] == "把 Blue Heron 的照片寄到 <x1/>，谢谢 Blue！"
    assert row["kept"] == ["Blue Heron", "heron@birds.example.org", "Blue"]


def test_overlapping_terms_prefer_earliest_then_longest(spark):
    row = docs(spark, (1, "en", "data lake house on www.lake.org/lake")).select(
        P.spans_with_terms(["data", "data lake", "lake house", "lake"])("text").alias("s")
    ).first()
    assert [(s["start"], s["end"]) for s in row["s"]] == [(0, 9), (19, 36)]


def test_native_and_arrow_spans_agree(spark):
    texts = [
        r"see C:\data\x, \\srv\share\f and (/usr/lib/x).", "a/b/c /a/b//c/d x/y", "mail a.b@c.org, ok",
        "www.x.org www.y.org.", "xwww.no but \"www.yes\"", "<g1>/tmp/a/ < / X 2 > <g 1>", "plain",
        "http://...", "ftp://a。b 中文/路径/名",
    ]
    table = docs(spark, *[(i, "en", t) for i, t in enumerate(texts)]).withColumn(
        "spans", P.spans_with_terms([])("text")
    )
    for row in table.select(
        "text", P.span_texts(F.col("text"), F.col("spans")).alias("a"),
        P.protected_spans(F.col("text")).alias("b"),
        P.encode_line(F.col("text")).alias("c"),
        P.encode_line_with_terms(F.col("text"), F.col("spans")).alias("d"),
        P.fill_spans(P.encode_line(F.col("text")), P.protected_spans(F.col("text"))).alias("back"),
    ).collect():
        assert row["a"] == row["b"], row["text"]
        assert row["c"] == row["d"]
        assert row["back"] == row["text"]


def test_decoding(spark):
    cases = {
        "bom8": b"\xef\xbb\xbf" + "你好\n".encode(), "u16": b"\xff\xfe" + "你好😀".encode("utf-16-le"),
        "be": b"\xfe\xff" + "é".encode("utf-16-be"), "gbk": "你好".encode("gbk"),
        "odd": b"\xff\xfea", "lone": b"\xff\xfe\x00\xd8", "plain": b"abc",
    }
    files = spark.createDataFrame(
        [(k, bytearray(v)) for k, v in cases.items()], "doc_id string, content binary"
    )
    got = {r["doc_id"]: r for r in S.decode_txt(files).collect()}
    assert (got["bom8"]["text"], got["bom8"]["bom"]) == ("你好\n", "EFBBBF")
    assert (got["u16"]["text"], got["u16"]["encoding"]) == ("你好😀", "utf-16-le")
    assert got["be"]["text"] == "é" and got["plain"]["text"] == "abc"
    for bad in ("gbk", "odd", "lone"):
        assert got[bad]["text"] is None and got[bad]["error_code"] == "invalid_document"
    named = S.decode_txt(files.filter("doc_id = 'gbk'"), encoding="gbk").first()
    assert named["text"] == "你好"
    assert S.decode_txt(files, encoding="no-such").first()["error_code"] == "invalid_document"
    back = S.decode_txt(files).withColumn(
        "again", S.encode_txt(F.col("text"), F.col("encoding"), F.col("bom"))
    )
    assert all(
        bytes(r["again"]) == cases[r["doc_id"]] for r in back.filter("error_code is null").collect()
    )


def test_formats(spark):
    files = spark.createDataFrame(
        [("a.txt", b"x"), ("a.docx", b"PK\x03\x04"), ("b.docx", b"x"), ("c.pdf", b"%PDF-1"),
         ("d.txt", b"%PDF-1"), ("e.doc", b"x"), ("f.xlsx", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1")],
        "path string, content binary",
    )
    got = {r["path"]: r["format"] or r["error_code"] for r in S.detect_format(files).collect()}
    assert got == {
        "a.txt": "txt", "a.docx": "docx", "b.docx": "invalid_document", "c.pdf": "pdf",
        "d.txt": "unsupported_document", "e.doc": "unsupported_document",
        "f.xlsx": "unsupported_document",
    }
