"""Skew-safe joins against plain ones, spreadsheets against brute force, packages, streams."""

import random

from pyspark.sql import functions as F

from lingualoom.operators import identity, infer, sheet, spread, units
from lingualoom.operators.memory import Memory
from lingualoom.plans import catalog_office as made
from lingualoom.sources import office as O
from lingualoom.sources import parallel as par
from lingualoom.sources import text as S
from lingualoom.streaming import jobs


def test_spread_join_equals_a_plain_join(spark, monkeypatch):
    monkeypatch.setattr(spread, "HOT_KEYS", 2)
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 40}") for i in range(1200)] + [(9999, "unknown")]
    many = spark.createDataFrame(rows, "i int, key string")
    one = many.filter("key <> 'unknown'").groupBy("key").agg(F.count("*").alias("n")).withColumn(
        "v", F.concat(F.lit("v-"), "key")
    )
    got = sorted(map(tuple, spread.spread_join(many, one, "key", "n", "v", ["i"]).collect()))
    want = sorted(map(tuple, many.join(one.select("key", "v"), "key", "left").select("i", "key", "v").collect()))
    assert got == want and len(got) == 1201


def test_dense_index_and_running_start(spark):
    rng = random.Random(1)
    rows = [("a" if rng.random() < 0.7 else "b", i, rng.randrange(5)) for i in range(4000)]
    table = spark.createDataFrame(rows, "g string, pos int, n int")
    indexed = spread.dense_index(table, ["g"], F.floor(F.col("pos") / 100), ["pos"]).collect()
    for g in "ab":
        ordered = sorted((r["pos"], r["idx"]) for r in indexed if r["g"] == g)
        assert [i for _, i in ordered] == list(range(len(ordered)))
    started = spread.running_start(table, ["g"], "pos", F.col("n"), span=64).collect()
    for g in "ab":
        total = 0
        for r in sorted((r for r in started if r["g"] == g), key=lambda r: r["pos"]):
            assert r["start"] == total
            total += r["n"]


def test_merge_lookup_matches_brute_force(spark):
    rng = random.Random(5)
    cells = {(rng.randrange(2), rng.randrange(40), rng.randrange(40)) for _ in range(500)}
    merges = []
    for i in range(60):
        c1, r1 = rng.randrange(40), rng.randrange(40)
        merges.append((rng.randrange(2), i, c1, r1, c1 + rng.choice([0, 1, 5, 33]), r1 + rng.choice([0, 2, 7, 40])))
    got = sheet.merge_range_lookup(
        spark.createDataFrame(list(cells), "sheet int, col int, row int"),
        spark.createDataFrame(merges, "sheet int, ord int, c1 int, r1 int, c2 int, r2 int"),
    ).collect()
    assert len(got) == len(cells)
    for r in got:
        hits = [m for m in merges if m[0] == r["sheet"] and m[2] <= r["col"] <= m[4] and m[3] <= r["row"] <= m[5]]
        want = min(hits, key=lambda m: m[1])[2:] if hits else (r["col"], r["row"], r["col"], r["row"])
        assert (r["c1"], r["r1"], r["c2"], r["r2"]) == tuple(want) and r["merged"] == bool(hits)


def test_memory_keeps_the_first_and_forced_replaces(spark):
    schema = "k string, output string, forced boolean, created_at timestamp, failed boolean"
    at = "2024-01-0{} 00:00:00".format
    rows = [("a", "old", False, at(1), False), ("a", "new", False, at(2), False), ("b", "old", False, at(1), False),
            ("b", "forced", True, at(2), False), ("b", "last", True, at(3), False), ("c", "bad", True, at(1), True)]
    table = spark.createDataFrame([], schema).unionByName(
        spark.createDataFrame([(k, o, f, None, x) for k, o, f, _, x in rows[:0]], schema)
    )
    fresh = spark.createDataFrame([(*r[:3], r[3], r[4]) for r in rows],
                                  "k string, output string, forced boolean, at string, failed boolean").withColumn(
        "created_at", F.to_timestamp("at")).drop("at")
    got = {r["k"]: r["output"] for r in units.memory_upsert(table, fresh, ["k"]).collect()}
    assert got == {"a": "old", "b": "last"}


def test_parallel_rows_and_refusals(spark):
    lines = [
        ("ok", '{"id": 1, "source_lang": "zh", "target_lang": "en", "source": "a", "reference": "b"}'),
        ("ok", "   "), ("ok", '{"id": "x", "source_lang": "en", "target_lang": "zh", "source": "c", "reference": "d"}'),
        ("dup", '{"id": 1, "source_lang": "zh", "target_lang": "en", "source": "a", "reference": "b"}'),
        ("dup", '{"id": "1", "source_lang": "en", "target_lang": "zh", "source": "a", "reference": "b"}'),
        ("bad", '{"id": 2, "source_lang": "zh", "target_lang": "en", "source": "a"}'), ("json", "{"), ("list", "[1]"),
        ("noid", '{"id": 1.5, "source_lang": "zh"}'),
    ]
    rows = par.parse_parallel(spark.createDataFrame(lines, "dataset string, value string"))
    codes = {(r["dataset"], r["error_code"]) for r in rows.filter("error_code is not null").collect()}
    assert codes == {("json", "invalid_json"), ("list", "not_an_object"), ("noid", "no_id")}
    got = [tuple(r) for r in par.scan_parallel(rows, "zh", "en").collect()]
    assert got == [("ok", "1", "a", "b")]


def test_set_digest_ignores_order_and_sees_changes(spark):
    def digest(values):
        table = spark.createDataFrame([("g", v) for v in values], "g string, v string")
        return identity.set_digest(table, ["g"], F.col("v")).first()["digest"]

    values = [f"entry {i}" for i in range(50)]
    assert digest(values) == digest(values[::-1]) != digest(values[1:])


W = made._MAIN.format("wordprocessingml")


def docx(body, **extra):
    def story(tag, inner):
        return f'<w:{tag} xmlns:w="{W}">{inner}</w:{tag}>'

    parts = {"word/document.xml": story("document", f"<w:body>{body}</w:body>")}
    rels = []
    for kind, inner in extra.items():
        parts[f"word/{kind}.xml"] = story("part", inner)
        rels.append((kind, f"word/{kind}.xml"))
    return made.pack("word/document.xml", made._TYPES["docx"], parts, {"word/document.xml": rels})


def files(spark, **named):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in named.items()], "doc_id string, content binary")


def test_docx_structure(spark):
    """Texts with styles, wrappers around theirs, and one object for everything that stays as it is."""
    run = "<w:r><w:t>{}</w:t></w:r>".format
    mark = '<w:r><w:fldChar w:fldCharType="{}"/></w:r>'.format
    body = (
        f"<w:p>{run('one ')}<w:r><w:rPr><w:i/><w:noProof/></w:rPr><w:t>two</w:t><w:tab/></w:r>"
        f"<w:hyperlink>{run('three')}</w:hyperlink><w:moveFrom>{run('gone')}</w:moveFrom></w:p>"
        f"<w:p>{run('on ')}{mark('begin')}{run('7 May')}{mark('end')}{run(' at')}</w:p>"
        f'<w:p>{run("of ")}<w:fldSimple w:instr="NUMPAGES">{run("12")}</w:fldSimple></w:p>'
        f"<w:tbl><w:tr><w:tc><w:p>{run('inside')}</w:p></w:tc></w:tr></w:tbl><w:p>{run(' ')}</w:p>"
    )
    notes = f'<w:footnote w:type="separator"><w:p>{run("-")}</w:p></w:footnote><w:footnote><w:p>{run("see")}</w:p></w:footnote>'
    made_files = files(spark, d=docx(body, header=f"<w:p>{run('top')}</w:p>", footnotes=notes))
    got = O.paragraphs(O.scan_docx(made_files)).orderBy("seg_no").collect()
    assert [r["location"] for r in got] == [
        "body / paragraph 1", "body / paragraph 2", "body / paragraph 3", "body / paragraph 4 (table cell)",
        "header 1 / paragraph 1", "footnotes / paragraph 2",
    ]
    seen = [[(n["kind"], n["text"]) for n in r["nodes"]] for r in got]
    assert seen[0] == [("text", "one "), ("text", "two"), ("obj", None), ("open", None), ("text", "three"), ("close", None), ("obj", None)]
    assert [n["style"] for n in got[0]["nodes"] if n["kind"] == "text"] == [0, 1, 0]
    assert [n for n in seen[1] if n[0] == "text"] == [("text", "on "), ("text", " at")]
    assert seen[2] == [("text", "of "), ("obj", None)] and seen[5] == [("text", "see")]
    codes = {(r["code"], r["count"]) for r in O.findings(made_files).collect()}
    assert codes == {("tracked_changes_present", 1), ("field_results_not_translated", 2)}


def test_pptx_structure(spark):
    """Slides in their order each with its notes, groups, tables by row and cell, then layouts and masters without placeholders."""
    space = f'xmlns:p="{made._MAIN.format("presentationml")}" xmlns:a="{made._MAIN.format("drawingml")}" xmlns:r="{made._DOC_REL}"'
    body = lambda *texts: "".join(made._paragraph("a", t) for t in texts)

    def sp(name, *texts, ph=""):
        named = f'<p:cNvPr id="7" name="{name}"/>' if name else ""
        return f"<p:sp><p:nvSpPr>{named}<p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody>{body(*texts)}</p:txBody></p:sp>"

    def page(tag, inner, name=""):
        return f'<p:{tag} {space} type="x"><p:cSld{name}><p:spTree>{inner}</p:spTree></p:cSld></p:{tag}>'

    cell = lambda t: f"<a:tc><a:txBody>{body('', t)}</a:txBody></a:tc>"
    table = "".join(f"<a:tr>{cell(f'{r}1')}{cell(f'{r}2')}</a:tr>" for r in "ab")
    frame = (
        '<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="4" name="T"/></p:nvGraphicFramePr><a:graphic><a:graphicData>{}</a:graphicData>'
        "</a:graphic></p:graphicFrame>"
    ).format
    title, body_ph, foot = ('<p:ph type="title"/>', '<p:ph type="body"/>', '<p:ph type="ftr"/>')
    group = f"<p:grpSp><p:grpSp>{sp('G', 'grouped')}</p:grpSp><mc:AlternateContent xmlns:mc='m'><mc:Choice>{sp('C', 'chosen')}</mc:Choice></mc:AlternateContent></p:grpSp>"
    s = "ppt/slides/s{}.xml".format
    parts = {
        "ppt/presentation.xml": f'<p:presentation {space}><p:sldIdLst><p:sldId r:id="rId2"/><p:sldId r:id="rId1"/></p:sldIdLst></p:presentation>',
        s(1): page("sld", sp("A", "second", "more")),
        s(2): page("sld", sp("Title", "first", ph=title) + group + frame(f"<a:tbl>{table}</a:tbl>") + frame(f"<a:lockedCanvas>{sp('L', 'locked')}</a:lockedCanvas>") + sp("", "nameless")),
        "ppt/n2.xml": page("notes", sp("N", "noted", ph=body_ph) + sp("F", "footer", ph=foot) + sp("O", "other")),
        "ppt/l1.xml": page("sldLayout", sp("P", "Click to edit", ph=title) + sp("S", "of the layout"), ' name="Plain"'),
        "ppt/l2.xml": page("sldLayout", sp("S", "unused")),
        "ppt/m1.xml": page("sldMaster", sp("P", "Click", ph=body_ph) + sp("S", "of the master")),
    }
    rels = {
        "ppt/presentation.xml": [("slide", s(1)), ("slide", s(2))], s(1): [("slideLayout", "ppt/l1.xml")],
        s(2): [("slideLayout", "ppt/l1.xml"), ("notesSlide", "ppt/n2.xml")], "ppt/l1.xml": [("slideMaster", "ppt/m1.xml")],
    }
    found = files(spark, d=made.pack("ppt/presentation.xml", made._TYPES["pptx"], parts, rels))
    got = O.paragraphs(O.scan_pptx(found)).orderBy("seg_no").collect()
    assert [(r["location"], "".join(n["text"] for n in r["nodes"])) for r in got] == [
        ('slide 1 / shape "Title" (id 7) / paragraph 1', "first"), ('slide 1 / shape "G" (id 7) / paragraph 1', "grouped"),
        ('slide 1 / shape "C" (id 7) / paragraph 1', "chosen"),
        *((f'slide 1 / table "T" (id 4) / row {i} / cell {j} / paragraph 2', f"{r}{j}") for i, r in ((1, "a"), (2, "b")) for j in (1, 2)),
        ("slide 1 / shape (unnamed) / paragraph 1", "nameless"), ("slide 1 notes / paragraph 1", "noted"),
        ('slide 2 / shape "A" (id 7) / paragraph 1', "second"), ('slide 2 / shape "A" (id 7) / paragraph 2', "more"),
        ('layout "Plain" / shape "S" (id 7) / paragraph 1', "of the layout"), ('master m1.xml / shape "S" (id 7) / paragraph 1', "of the master"),
    ]
    assert [r["seg_no"] for r in got] == list(range(len(got)))


def test_refused_packages(spark):
    """A bad file is an error row, and the good file beside it is read."""
    good = docx("<w:p><w:r><w:t>fine</w:t></w:r></w:p>")
    doctype = made.pack("word/document.xml", made._TYPES["docx"], {"word/document.xml": "<!DOCTYPE x><x/>"}, {})
    place = good.index(b"word/document.xml") + len("word/document.xml")
    damaged = good[:place] + bytes(8) + good[place + 8 :]
    bomb = made.pack("word/document.xml", made._TYPES["docx"], {"word/document.xml": "<x>" + " " * 5_000_000 + "</x>"}, {})
    scanned = O.scan_docx(files(spark, good=good, no=b"text", dtd=doctype, damaged=damaged, bomb=bomb)).collect()
    assert {r["doc_id"]: r["error_code"] for r in scanned} == {
        "good": None, "no": "invalid_document", "dtd": "invalid_document", "damaged": "invalid_document", "bomb": "document_limit",
    }
    kinds = {r["doc_id"]: r["kind"] or r["error_code"] for r in O.ooxml_kind(
        files(spark, d=good, x=made.make_xlsx("a"), p=made.make_pptx("a"), cut=good[:20])).collect()}
    assert kinds == {"d": "docx", "x": "xlsx", "p": "pptx", "cut": "invalid_document"}


def test_stream_equals_batch_over_many_files(spark, tmp_path):
    docs = spark.createDataFrame(
        [(i, "zh", f"句子{i % 7}\n共同\n句{i}") for i in range(30)], "doc_id long, lang string, text string"
    )
    docs.repartition(6).write.parquet(str(tmp_path / "in"))
    calls = []

    def translate(asked):
        calls.append(asked.count())
        return asked.withColumn("output", infer.marker_translate(F.col("unit_text"), F.lit("en")))

    stream = jobs.document_stream(spark, str(tmp_path / "in"), docs.schema, per_batch=2)
    jobs.ingest_units(stream, translate, str(tmp_path / "work"), "en", "marker-1").awaitTermination()
    memory = Memory(spark, str(tmp_path / "work/memory")).rows()
    batch = units.unique_units(units.occurrences(S.scan_segments(docs, keep=("lang",))))
    assert len(calls) == 3 and sum(calls) == batch.count() == memory.count()
    assert {r["unit_text"] for r in memory.collect()} == {r["unit_text"] for r in batch.collect()}


def test_ingestion_reads_a_table_that_is_a_folder_of_files(spark, tmp_path):
    from lingualoom.plans import catalog_stream

    docs = [(k, f"Line {k} of the text\nand another {k}", "en", "web", 30) for k in range(6)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["unit_text"] for r in catalog_stream.stream_ingest_units(spark, str(tmp_path)).collect()}
    assert got == {line for _, text, *_ in docs for line in text.split("\n")}


def test_rows_of_many_files_leave_together(spark):
    """No frame for each file, and packages are not opened once for each reader of their entries."""
    some = files(spark, a=made.make_docx("x\ny"), b=b"no", c=made.make_xlsx("z"))
    for rows in (O.elements(some), O.package_entries(some), O.scan_xlsx(some)):
        assert "MapInArrow" in rows._jdf.queryExecution().optimizedPlan().toString()
    limits = O.package_limits(O.package_entries(some))
    assert "MapIn" not in limits._jdf.queryExecution().optimizedPlan().toString()
    assert {r["doc_id"]: (r["entries"], r["error_code"]) for r in limits.collect()} == {"a": (3, None), "b": (0, "invalid_document"), "c": (6, None)}


def test_texts_in_a_field_stay_as_they_are(spark):
    run = "<w:r><w:rPr><w:b/></w:rPr><w:t>{}</w:t></w:r>".format
    mark = '<w:r><w:fldChar w:fldCharType="{}"/></w:r>'.format
    body = f"<w:p>{run('a')}{mark('begin')}<w:ins>{run('b')}</w:ins></w:p><w:p>{run('c')}{mark('end')}{run('d')}</w:p>"
    got = O.paragraphs(O.scan_docx(files(spark, d=docx(body)))).orderBy("seg_no").collect()
    seen = [[(n["kind"], n["text"], n["style"]) for n in r["nodes"]] for r in got]
    assert seen == [
        [("text", "a", 0), ("obj", None, None), ("open", None, None), ("obj", None, None), ("close", None, None)],
        [("obj", None, None), ("obj", None, None), ("text", "d", 0)],
    ]
