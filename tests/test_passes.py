"""Lines are read and matched in one pass, and the way back has no crowded partition."""

import os
import re

from pyspark.sql import functions as F

from lingualoom.functions import chars as C
from lingualoom.functions import protect as P
from lingualoom.functions import text as X
from lingualoom.operators import infer, units
from lingualoom.operators.spread import spread_join
from lingualoom.plans import job
from lingualoom.session import shared_dir
from lingualoom.sources import text as S

ODD = [
    "", " ", "\u3000", " \u3000\t", "a", "7", "é", " é ", "水\u3000", "\x7f ", "x\x85", "\u2003x\u2003", "a b\xa0", "https://a.b/c.", "(https://a.b/c)",
    " see <x1/> and /usr/x/y, a@b.cd! ", "<x<g1>1/>", "www.a.b www.c.d", "/", "<", "C:\\x\\y。", "\\\\h\\s\\t", "水 <g 1 > 火", "½ ª", "\U0001f600 ", "ǅ", "١٢",
    "http://a.b<g1>http://", "a/b", "@", "a\x00b www.x.y \x00", "〇", "豈 a",
]


def test_one_pass_gives_what_each_expression_gives(spark):
    rows = spark.createDataFrame([(i, t, g) for i, t in enumerate(ODD) for g in ("de", "zh", None)], "i int, line string, lang string")
    text = F.col("line")
    core = X.strip(text)
    told = units.around_core(P.with_protection(rows.withColumn("_core", X.strip_column(text)), "_core"))
    passed = F.col("passed").eqNullSafe(P.passes_through(text, F.col("lang")))
    told = told.withColumn("passed", P.nothing_to_translate(F.col("_rest"), F.col("lang")))
    same = {
        "core": F.col("_core") == core, "kept": F.col("_kept") == P.protected_spans(core), "input": F.col("_input") == P.encode_line(core),
        "rest": F.col("_rest") == P.outside_spans(core), "leading": F.col("leading") == X.leading_ws(text),
        "trailing": F.col("trailing") == X.trailing_ws(text), "passed": passed, "blank": X.is_blank(text) == (core == ""),
    }
    bad = told.select("line", "lang", *[c.alias(n) for n, c in same.items()]).filter(" OR ".join(f"{n} IS NOT TRUE" for n in same))
    assert bad.collect() == []


def test_marker_blanks(spark):
    got = spark.createDataFrame([(t,) for t in ODD], "t string").select("t", infer.marker_translate(F.col("t"), F.lit("en"))).collect()
    for text, marked in got:
        want = re.sub("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in C.MARKER_CJK_RANGES) + "]", "x", text)
        assert marked == (want if want.strip(C.WS_CHARS) == "" else "EN:" + want), repr(text)


def test_documents_are_split_and_matched_once(spark):
    docs = spark.createDataFrame([(1, "de", "a\n\nb"), (2, "de", None), (3, "de", "\n")], "doc_id long, lang string, text string")
    lines = S.scan_txt_lines(docs, keep=("lang",))
    assert sorted((r["doc_id"], r["seg_no"], r["line"]) for r in lines.collect()) == [(1, 0, "a"), (1, 1, ""), (1, 2, "b"), (3, 0, ""), (3, 1, "")]
    assert [tuple(r) for r in S.scan_segments(docs).orderBy("seg_no").collect()] == [(1, 0, "a"), (1, 2, "b")]
    split = f", {S.LINE_CUT}, -1"
    for made in (lines, S.scan_segments(docs), units.occurrences(lines), units.engine_inputs(lines)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(split) == 1
        # Once to find, once to cut, and once to cut what holds the mark of a cut; the address pattern stands for all.
        assert plan.count("(?:https?|ftp)") <= 3


def test_rows_without_a_key_are_spread(spark):
    many = spark.range(4000).select("id", F.when(F.col("id") % 4 == 0, F.concat(F.lit("k"), F.col("id") % 400)).alias("key"))
    one = many.groupBy("key").agg(F.count("*").alias("n")).filter("key IS NOT NULL").withColumn("v", F.upper("key"))
    adaptive, limit = (spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spread_join(many, one, "key", "n", "v", ["id"])
        counts = [r["count"] for r in joined.filter("v IS NULL").groupBy(F.spark_partition_id()).count().collect()]
        assert sum(counts) == 3000 and max(counts) < 1500
        assert joined.filter("key IS NOT NULL AND v = upper(key)").count() == 1000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_job_inputs_are_the_same_with_and_without_terms(spark):
    rows = spark.createDataFrame([(i, t, g) for i, t in enumerate(ODD) for g in ("de", "zh", None)], "i int, line string, lang string")
    columns = ["i", "lang", "_kept", "passed", "unit_text", "leading", "trailing"]
    plain, termed = (
        sorted(map(str, job._inputs(rows, "lang", terms).select(*columns).collect())) for terms in ((), ["no such term"])
    )
    assert plain == termed and len(plain) == 3 * len(ODD)


def test_documents_are_joined_once_and_only_if_wanted(spark):
    docs = spark.createDataFrame([(1, "de", " Hallo \n\nhttps://a.b x\n12"), (2, "en", "stays")], "doc_id long, lang string, text string")

    def written():
        return sum(name.startswith("answered-") for name in os.listdir(shared_dir(spark)))

    before = written()
    done = job.translate_documents(docs, lambda asked: asked.select("unit_key", F.concat(F.lit("T:"), F.col("unit_text")).alias("output")), "en", "e")
    assert done.memory.count() == 2 and written() == before
    documents = done.documents
    assert written() == before + 1 and done.documents is documents
    plan = documents._jdf.queryExecution().optimizedPlan().toString()
    # The marks of hot keys, and the values: one join of each.
    assert plan.count("Join LeftOuter") == 2
    assert {r["doc_id"]: (r["text"], r["lost"]) for r in documents.collect()} == {1: (" T:Hallo \n\nT:https://a.b x\n12", 0), 2: ("stays", 0)}
