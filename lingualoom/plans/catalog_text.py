"""Registered queries: lines, protection, deduplication, join back, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingualoom.functions import chars as C
from lingualoom.functions import protect as P
from lingualoom.functions import text as X
from lingualoom.operators import infer, report, units
from lingualoom.plans import corpus as jobs
from lingualoom.plans import job
from lingualoom.plans import derived as D
from lingualoom.sources import text as S

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    return S.scan_segments(D.corpus(spark, sf), keep=("lang", "source"))


def _occ(spark: SparkSession, sf: str) -> DataFrame:
    return units.occurrences(_segments(spark, sf))


def _inputs(spark: SparkSession, sf: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return units.engine_inputs(_segments(spark, sf), keep=keep)


# ---- flagship ------------------------------------------------------------------------------------


@query(
    "translate_corpus",
    f"""WITH {D.OCC_SQL}
    SELECT doc_id, count(*) AS segments, count(*) FILTER (passed) AS passed_through,
           count(DISTINCT unit_text) AS unique_inputs,
           CAST(sum(CASE WHEN passed THEN length(line) ELSE
             length(line) - length(core) + length({D.sql_marker('unit_text', 'en')})
             - COALESCE(CAST(list_sum(list_transform(range(1, len({D.sql_spans('core')}) + 1),
                        lambda n: 4 + length(CAST(n AS VARCHAR)))) AS BIGINT), 0)
             + length(array_to_string({D.sql_spans('core')}, '')) END) AS BIGINT) AS output_chars
    FROM occ GROUP BY doc_id""",
)
def translate_corpus(spark, sf):
    return jobs.translation_report(D.corpus(spark, sf), "en")


# ---- sources -------------------------------------------------------------------------------------


@query(
    "scan_txt_lines",
    f"""WITH {D.CORPUS_SQL}, l AS (
      SELECT doc_id, string_split_regex(text, '\\r\\n|\\n|\\r') AS ls,
             regexp_extract_all(text, '\\r\\n|\\n|\\r') AS es FROM corpus),
    r AS (SELECT doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS seg_no, ls, es FROM l)
    SELECT doc_id, seg_no, 'line ' || (seg_no + 1) AS location, ls[seg_no + 1] AS line,
           COALESCE(es[seg_no + 1], '') AS ending,
           NOT {D.sql_blank('ls[seg_no + 1]')} AS is_segment FROM r""",
)
def scan_txt_lines(spark, sf):
    return S.scan_txt_lines(D.corpus(spark, sf))


@query(
    "decode_txt",
    """SELECT doc_id,
      CASE doc_id % 5 WHEN 1 THEN 'utf-16-le' WHEN 2 THEN 'utf-16-be' ELSE 'utf-8' END AS encoding,
      CASE doc_id % 5 WHEN 1 THEN 'FFFE' WHEN 2 THEN 'FEFF' WHEN 3 THEN 'EFBBBF' ELSE '' END AS bom,
      CASE WHEN doc_id % 5 <> 4 THEN md5(text) END AS text_md5,
      CASE WHEN doc_id % 5 <> 4 THEN length(text) END::INTEGER AS n,
      CASE WHEN doc_id % 5 = 4 THEN 'invalid_document' END AS error_code
    FROM documents""",
)
def decode_txt(spark, sf):
    kind = F.col("doc_id") % 5
    content = (
        F.when(kind == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
        .when(kind == 2, F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE")))
        .when(kind == 3, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
        .when(kind == 4, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("C3"))))
        .otherwise(F.encode("text", "UTF-8"))
    )
    docs = D.table(spark, sf, "documents").select("doc_id", content.alias("content"))
    return S.decode_txt(docs).select(
        "doc_id", "encoding", "bom", F.md5("text").alias("text_md5"),
        F.length("text").alias("n"), "error_code",
    )


@query(
    "detect_format",
    """WITH f AS (SELECT doc_id, doc_id % 7 AS k, octet_length(encode(text)) AS n FROM documents)
    SELECT doc_id,
      CASE k WHEN 0 THEN CASE WHEN n <= 20000 THEN 'txt' END WHEN 1 THEN 'docx'
             WHEN 2 THEN CASE WHEN n + 5 <= 20000 THEN 'pdf' END END AS format,
      CASE k WHEN 0 THEN CASE WHEN n > 20000 THEN 'document_limit' END
             WHEN 1 THEN NULL
             WHEN 2 THEN CASE WHEN n + 5 > 20000 THEN 'document_limit' END
             WHEN 3 THEN 'unsupported_document' WHEN 4 THEN 'unsupported_document'
             WHEN 5 THEN 'invalid_document' ELSE 'unsupported_document' END AS error_code
    FROM f""",
)
def detect_format(spark, sf):
    kind = F.col("doc_id") % 7
    ext = F.element_at(
        F.array(*[F.lit(e) for e in (".TXT", ".docx", ".pdf", ".doc", ".pptx", ".xlsx", ".txt")]),
        (kind + 1).cast("int"),
    )
    head = F.element_at(
        F.array(*[F.lit(h) for h in ("", "504B0304", "255044462D", "", "D0CF11E0A1B11AE1", "",
                                     "255044462D")]),
        (kind + 1).cast("int"),
    )
    files = D.table(spark, sf, "documents").select(
        "doc_id",
        F.concat(F.lit("/in/file-"), F.col("doc_id").cast("string"), ext).alias("path"),
        F.concat(F.unhex(head), F.encode("text", "UTF-8")).alias("content"),
    )
    return S.detect_format(files, max_text_bytes=20000).select("doc_id", "format", "error_code")


@query(
    "doc_limits",
    f"""WITH {D.CORPUS_SQL}, n AS (SELECT doc_id, octet_length(encode(text)) AS b,
      len(list_filter(string_split_regex(text, '\\r\\n|\\n|\\r'), lambda s: NOT {D.sql_blank('s')})) AS s
      FROM corpus)
    SELECT doc_id, s::INTEGER AS segments, b::INTEGER AS text_bytes,
      CASE WHEN b > 30000 OR s > 40 THEN 'document_limit' END AS error_code FROM n""",
)
def doc_limits(spark, sf):
    return S.doc_limits(D.corpus(spark, sf), max_segments=40, max_text_bytes=30000)


# ---- projections and predicates ------------------------------------------------------------------


@query(
    "split_whitespace",
    f"""WITH {D.CORPUS_SQL}, lines AS ({D.sql_lines('corpus')})
    SELECT doc_id, seg_no,
      CASE WHEN {D.sql_blank('line')} THEN line
           ELSE left(line, length(line) - length(ltrim(line, {D.quote_ws()}))) END AS leading,
      {D.sql_strip('line')} AS core,
      CASE WHEN {D.sql_blank('line')} THEN ''
           ELSE substr(line, length(rtrim(line, {D.quote_ws()})) + 1) END AS trailing
    FROM lines""",
)
def split_whitespace(spark, sf):
    text = F.col("line")
    return S.scan_txt_lines(D.corpus(spark, sf)).select(
        "doc_id", "seg_no", X.leading_ws(text).alias("leading"), X.strip(text).alias("core"),
        X.trailing_ws(text).alias("trailing"),
    )


@query(
    "nonblank_filter",
    f"""WITH {D.CORPUS_SQL}, lines AS ({D.sql_lines('corpus')})
    SELECT doc_id, seg_no FROM lines WHERE NOT {D.sql_blank('line')}""",
)
def nonblank_filter(spark, sf):
    return S.scan_segments(D.corpus(spark, sf)).select("doc_id", "seg_no")


@query(
    "script_letters",
    f"""WITH {D.OCC_SQL} SELECT doc_id, seg_no,
      CAST({D.sql_script_letters('line', 'lang')} AS INTEGER) AS letters FROM segs""",
)
def script_letters(spark, sf):
    return _segments(spark, sf).select(
        "doc_id", "seg_no", X.script_letters(F.col("line"), F.col("lang")).alias("letters")
    )


@query("passes_through", f"WITH {D.OCC_SQL} SELECT doc_id, seg_no, passed FROM occ")
def passes_through(spark, sf):
    return _segments(spark, sf).select(
        "doc_id", "seg_no", P.passes_through(F.col("line"), F.col("lang")).alias("passed")
    )


@query(
    "protect_spans",
    f"""WITH {D.OCC_SQL} SELECT doc_id, seg_no, unnest({D.sql_spans('core')}) AS kept,
    CAST(unnest(range(1, len({D.sql_spans('core')}) + 1)) AS INTEGER) AS n FROM segs""",
)
def protect_spans(spark, sf):
    spans = P.protected_spans(X.strip(F.col("line")))
    return (
        _segments(spark, sf)
        .select("doc_id", "seg_no", F.posexplode(spans).alias("n", "kept"))
        .withColumn("n", F.col("n") + 1)
    )


@query(
    "protect_tag_like",
    """WITH p AS (SELECT page_id, regexp_replace(html, '<b>', '<g1>', 'g') AS t FROM pages)
    SELECT page_id, len(regexp_extract_all(t, '(?i)</?\\s*[gx]\\s*\\d+\\s*/?\\s*>'))::INTEGER AS tag_like
    FROM p""",
)
def protect_tag_like(spark, sf):
    text = F.regexp_replace("html", "<b>", "<g1>")
    return D.table(spark, sf, "pages").select(
        "page_id", F.regexp_count(text, F.lit(P.TAG_LIKE)).alias("tag_like")
    )


@query(
    "clean_text",
    f"""WITH d AS (SELECT doc_id, replace(replace(text, chr(10), chr(13) || chr(10)), ' t',
             chr(8232) || chr(11) || 't') AS t FROM documents),
    c AS (SELECT doc_id, t, regexp_replace(regexp_replace(t, '\\r\\n|\\r|\\n|\\x{{2028}}|\\x{{2029}}', ' ', 'g'),
             '[{C.XML_ILLEGAL}]', '', 'g') AS x FROM d)
    SELECT doc_id, md5(x) AS cleaned, length(x)::INTEGER AS n,
           NOT regexp_matches(t, '[{C.XML_ILLEGAL}]') AS ok FROM c""",
)
def clean_text(spark, sf):
    text = F.replace(
        F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")), F.lit(" t"), F.lit(" \x0bt")
    )
    return D.table(spark, sf, "documents").select("doc_id", text.alias("t")).select(
        "doc_id",
        F.md5(X.clean_text(F.col("t"))).alias("cleaned"),
        F.length(X.clean_text(F.col("t"))).alias("n"),
        X.xml_text_ok(F.col("t")).alias("ok"),
    )


@query(
    "newline_to_space",
    f"WITH {D.CORPUS_SQL} SELECT doc_id, md5(replace(replace(text, chr(13), ' '), chr(10), ' ')) AS h FROM corpus",
)
def newline_to_space(spark, sf):
    return D.corpus(spark, sf).select("doc_id", F.md5(X.newline_to_space(F.col("text"))).alias("h"))


@query(
    "cell_limit",
    f"""WITH {D.CORPUS_SQL} SELECT doc_id, length(text)::INTEGER AS n,
      CASE WHEN length(text) > 32767 THEN 'document_limit' END AS error_code FROM corpus""",
)
def cell_limit(spark, sf):
    from lingualoom.operators.sheet import cell_limit_error

    return D.corpus(spark, sf).select(
        "doc_id", F.length("text").alias("n"), cell_limit_error(F.col("text")).alias("error_code")
    )


# ---- deduplication and join back -----------------------------------------------------------------


@query(
    "unique_units",
    f"""WITH {D.OCC_SQL} SELECT unit_text, count(*) AS n_occ, arg_min(doc_id, (doc_id, seg_no)) AS first_doc_id,
      arg_min(seg_no, (doc_id, seg_no)) AS first_seg_no
    FROM occ WHERE unit_text IS NOT NULL GROUP BY unit_text""",
)
def unique_units(spark, sf):
    return units.first_seen(_inputs(spark, sf, ("doc_id", "seg_no")))


@query(
    "unique_units_per_document",
    f"""WITH {D.OCC_SQL} SELECT doc_id, sha256(unit_text) AS unit_key, unit_text, count(*) AS n_occ
    FROM occ WHERE unit_text IS NOT NULL GROUP BY ALL""",
)
def unique_units_per_document(spark, sf):
    return units.unique_units(_inputs(spark, sf, ("doc_id",)), group=["doc_id"])


@query(
    "unique_texts",
    f"""WITH {D.CORPUS_SQL}, lines AS ({D.sql_lines('corpus')})
    SELECT DISTINCT {D.sql_strip('line')} AS core FROM lines WHERE NOT {D.sql_blank('line')}""",
)
def unique_texts(spark, sf):
    return units.unique_texts(S.scan_txt_lines(D.corpus(spark, sf)), "line")


@query(
    "batch_assign",
    f"""WITH {D.OCC_SQL}, u AS (
      SELECT doc_id, unit_text, min(seg_no) AS first_seg FROM occ WHERE unit_text IS NOT NULL GROUP BY ALL),
    b AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY first_seg) - 1) // 8 AS batch FROM u)
    SELECT doc_id, batch, count(*) AS inputs FROM b GROUP BY ALL""",
)
def batch_assign(spark, sf):
    first = (
        _inputs(spark, sf, ("doc_id", "seg_no"))
        .groupBy("doc_id", "unit_key")
        .agg(F.min("seg_no").alias("first_seg"))
    )
    batches = units.batch_assign(first, ["doc_id"], ["first_seg"], 8)
    return batches.groupBy("doc_id", "batch").agg(F.count("*").alias("inputs"))


@query(
    "join_back",
    f"""WITH {D.OCC_SQL} SELECT doc_id, seg_no, CASE WHEN passed THEN line ELSE
      left(line, length(line) - length(ltrim(line, {D.quote_ws()})))
      || list_reduce(list_prepend({D.sql_marker('unit_text', 'en')}, {D.sql_spans('core')}),
           lambda acc, s, i: regexp_replace(acc, '<x[0-9]+/>', replace(s, '\\', '\\\\')))
      || substr(line, length(rtrim(line, {D.quote_ws()})) + 1) END AS translated FROM occ""",
)
def join_back(spark, sf):
    return jobs.translate_lines(D.corpus(spark, sf), "en").select("doc_id", "seg_no", "translated")


@query(
    "segment_counts",
    f"""WITH {D.OCC_SQL} SELECT doc_id, count(*) AS segments, count(*) FILTER (passed) AS passed_through,
      count(DISTINCT unit_text) AS unique_inputs, 0::BIGINT AS formatting_fallbacks FROM occ GROUP BY doc_id""",
)
def segment_counts(spark, sf):
    return report.segment_counts(_occ(spark, sf))


@query(
    "count_guard",
    f"""WITH {D.OCC_SQL}, u AS (SELECT DISTINCT unit_text FROM occ WHERE unit_text IS NOT NULL)
    SELECT count(*) AS requested, count(*) FILTER (length(unit_text) % 10 <> 0) AS answered,
      count(*) FILTER (length(unit_text) % 10 = 0) AS missing, 0::BIGINT AS unexpected FROM u""",
)
def count_guard(spark, sf):
    distinct = units.unique_units(_inputs(spark, sf))
    answered = distinct.filter(F.length("unit_text") % 10 != 0)
    return units.count_guard(distinct, answered, "unit_key")


@query(
    "fallback_to_source",
    f"""WITH {D.OCC_SQL}, u AS (SELECT DISTINCT unit_text AS t FROM occ WHERE unit_text IS NOT NULL)
    SELECT t AS unit_text, CASE WHEN length(t) % 3 = 0 THEN t ELSE {D.sql_marker('t', 'en')} END AS output FROM u""",
)
def fallback_to_source(spark, sf):
    out = F.when(
        F.length("unit_text") % 3 != 0, infer.marker_translate(F.col("unit_text"), F.lit("en"))
    )
    answered = units.unique_units(_inputs(spark, sf)).select("unit_text", out.alias("output"))
    return units.fallback_to_source(answered, "output", "unit_text")


@query(
    "marker_translate",
    f"""WITH {D.OCC_SQL} SELECT DISTINCT unit_text, {D.sql_marker('unit_text', 'es')} AS output
    FROM occ WHERE unit_text IS NOT NULL""",
)
def marker_translate(spark, sf):
    return units.unique_units(_inputs(spark, sf)).select(
        "unit_text", infer.marker_translate(F.col("unit_text"), F.lit("es")).alias("output")
    )


_MEMORY = """mem AS (
  SELECT DISTINCT trim(text) AS unit_text FROM (
    SELECT unnest(string_split(text, chr(10))) AS text FROM documents)
  WHERE trim(text) <> '' AND length(trim(text)) % 3 <> 0)"""


def _remembered(spark, sf):
    """Lines of all documents, but for those whose length divides by 3: something has to be missing."""
    lines = D.table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    texts = lines.select(F.trim("line").alias("unit_text"))
    return texts.filter((F.col("unit_text") != "") & (F.length("unit_text") % 3 != 0)).distinct()


@query(
    "cache_lookup",
    f"""WITH {D.OCC_SQL}, {_MEMORY},
    u AS (SELECT unit_text, count(*) AS n FROM occ WHERE unit_text IS NOT NULL GROUP BY 1)
    SELECT (mem.unit_text IS NOT NULL) AS hit, count(*) AS inputs, CAST(sum(n) AS BIGINT) AS occurrences,
      CAST(sum(length(mem.unit_text)) AS BIGINT) AS remembered_chars
    FROM u LEFT JOIN mem USING (unit_text) GROUP BY 1""",
)
def cache_lookup(spark, sf):
    memory = (
        _remembered(spark, sf)
        .select(units.unit_key(F.col("unit_text")).alias("unit_key"), F.col("unit_text").alias("output"))
    )
    found = units.cache_lookup(units.unique_units(_inputs(spark, sf)), memory, ["unit_key"])
    return found.groupBy("hit").agg(
        F.count("*").alias("inputs"), F.sum("n_occ").alias("occurrences"),
        F.sum(F.length("output")).cast("long").alias("remembered_chars"),
    )


@query(
    "cache_hits_and_misses",
    f"""WITH {D.OCC_SQL}, {_MEMORY}, u AS (SELECT DISTINCT unit_text FROM occ WHERE unit_text IS NOT NULL)
    SELECT unit_text, unit_text IN (SELECT unit_text FROM mem) AS hit FROM u""",
)
def cache_hits_and_misses(spark, sf):
    memory = _remembered(spark, sf)
    distinct = units.unique_units(_inputs(spark, sf)).select("unit_text")
    hits = units.memory_hits(distinct, memory, ["unit_text"]).withColumn("hit", F.lit(True))
    return hits.unionByName(
        units.memory_misses(distinct, memory, ["unit_text"]).withColumn("hit", F.lit(False))
    )


@query(
    "tm_upsert",
    """WITH w AS (SELECT user_id % 40 AS k, props, event_id, ts, event_type FROM events),
    r AS (SELECT k, props, 'out-' || event_id AS output, event_type = 'purchase' AS forced, ts AS created_at,
      row_number() OVER (PARTITION BY k, props ORDER BY event_type = 'purchase' DESC,
        CASE WHEN event_type = 'purchase' THEN -epoch_us(ts) ELSE epoch_us(ts) END, 'out-' || event_id) AS rn
      FROM w WHERE event_type <> 'error')
    SELECT k, props, output, forced, created_at FROM r WHERE rn = 1""",
)
def tm_upsert(spark, sf):
    rows = D.table(spark, sf, "events").select(
        (F.col("user_id") % 40).alias("k"), "props",
        F.concat(F.lit("out-"), F.col("event_id").cast("string")).alias("output"),
        (F.col("event_type") == "purchase").alias("forced"),
        F.col("ts").alias("created_at"), (F.col("event_type") == "error").alias("failed"),
        F.col("event_id"),
    )
    before = rows.filter("event_id % 2 = 0").drop("event_id")
    fresh = rows.filter("event_id % 2 = 1").drop("event_id")
    return units.memory_upsert(before, fresh, ["k", "props"])


# ---- documents and reports -----------------------------------------------------------------------

_REBUILT = f"""WITH {D.OCC_SQL}, done AS (SELECT doc_id, seg_no, CASE WHEN passed THEN line ELSE
      left(line, length(line) - length(ltrim(line, {D.quote_ws()})))
      || list_reduce(list_prepend({D.sql_marker('unit_text', 'en')}, {D.sql_spans('core')}),
           lambda acc, s, i: regexp_replace(acc, '<x[0-9]+/>', replace(s, '\\', '\\\\')))
      || substr(line, length(rtrim(line, {D.quote_ws()})) + 1) END AS translated FROM occ),
    parts AS (SELECT doc_id, string_split_regex(text, '\\r\\n|\\n|\\r') AS ls,
             regexp_extract_all(text, '\\r\\n|\\n|\\r') AS es FROM corpus),
    ends AS (SELECT doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS seg_no, unnest(ls) AS line,
             unnest(list_append(es, '')) AS ending FROM parts),
    rebuilt AS (SELECT doc_id, string_agg(COALESCE(translated, line) || ending, '' ORDER BY seg_no) AS text
      FROM ends LEFT JOIN done USING (doc_id, seg_no) GROUP BY doc_id)"""
# (the spans hold backslashes, which a replacement string has to escape)


@query(
    "reassemble_txt",
    _REBUILT + " SELECT doc_id, md5(text) AS text_md5, length(text)::INTEGER AS n FROM rebuilt",
)
def reassemble_txt(spark, sf):
    done = jobs.translate_lines(D.corpus(spark, sf), "en", every_line=True)
    rebuilt = jobs.rebuild_documents(done)
    return rebuilt.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("n"))


# Half of the documents were translated before, with another engine and with this one.
@query(
    "translate_documents",
    _REBUILT + """ SELECT doc_id, CASE WHEN lang = 'en' THEN md5(corpus.text) ELSE md5(rebuilt.text) END AS text_md5,
      CASE WHEN lang = 'en' THEN 'already_target_language' END AS note, CAST(NULL AS VARCHAR) AS error_code, 0::BIGINT AS lost
    FROM corpus JOIN rebuilt USING (doc_id)""",
)
def translate_documents(spark, sf):
    docs = job.prepare(D.corpus(spark, sf), "en")

    def marker(asked):
        return asked.select("unit_key", infer.marker_translate(F.col("unit_text"), F.lit("en")).alias("output"))

    before = docs.where(F.col("doc_id") % 2 == 0)
    other = job.translate_prepared(before, lambda a: a.select("unit_key", F.lit("other").alias("output")), "en", "other-1").memory
    same = job.translate_prepared(before, marker, "en", "marker-1").memory
    done = job.translate_prepared(docs, marker, "en", "marker-1", memory=other.unionByName(same)).documents
    return done.select("doc_id", F.md5("text").alias("text_md5"), "note", "error_code", "lost")


@query(
    "unchanged_copy",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'no_translatable_text'
        WHEN lang = 'en' THEN 'already_target_language' END AS note,
      CASE WHEN doc_id % 4 = 0 OR lang = 'en' THEN 'copy' ELSE 'translate' END AS route,
      CASE WHEN doc_id % 4 = 0 OR lang = 'en' THEN md5(text) ELSE md5('EN:' || text) END AS out_md5
    FROM documents""",
)
def unchanged_copy(spark, sf):
    docs = D.table(spark, sf, "documents").withColumn(
        "detected", F.when(F.col("doc_id") % 4 != 0, F.col("lang"))
    )
    routed = report.route_unchanged(docs, "detected", "en")
    out = F.when(F.col("route") == "copy", F.col("text")).otherwise(
        infer.marker_translate(F.col("text"), F.lit("en"))
    )
    return routed.select("doc_id", "note", "route", F.md5(out).alias("out_md5"))


@query(
    "write_report",
    f"""WITH {D.OCC_SQL}, c AS (SELECT doc_id, count(*) AS s, count(*) FILTER (passed) AS p,
      count(DISTINCT unit_text) AS u FROM occ GROUP BY doc_id)
    SELECT doc_id, '{{"doc_id":' || doc_id || ',"segments":' || s || ',"passed_through":' || p ||
      ',"unique_inputs":' || u || ',"formatting_fallbacks":0}}' AS report FROM c""",
)
def write_report(spark, sf):
    counts = report.segment_counts(_occ(spark, sf))
    return report.report_json(counts, counts.columns)


@query(
    "capped_diagnostics",
    f"""WITH {D.OCC_SQL}, d AS (SELECT source, doc_id, seg_no, 'doc ' || doc_id || ' line ' || (seg_no + 1) AS location,
      row_number() OVER (PARTITION BY source ORDER BY doc_id, seg_no) AS rn, count(*) OVER (PARTITION BY source) AS n
      FROM occ WHERE NOT passed)
    SELECT source, location, 1::BIGINT AS count FROM d WHERE rn <= 100
    UNION ALL SELECT source, NULL, max(n) - 100 FROM d GROUP BY source HAVING max(n) > 100""",
)
def capped_diagnostics(spark, sf):
    located = _occ(spark, sf).filter(~F.col("passed")).select(
        "source", "doc_id", "seg_no",
        F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit(" line "),
                 (F.col("seg_no") + 1).cast("string")).alias("location"),
    )
    return report.capped_diagnostics(located, ["source"], ["doc_id", "seg_no"])


@query(
    "leftover_script",
    f"""WITH {D.OCC_SQL} SELECT doc_id, lang, CAST(sum(CASE WHEN passed THEN
        {D.sql_script_letters('line', 'lang')} ELSE
        {D.sql_script_letters(D.sql_marker('line', 'en'), 'lang')} END) AS BIGINT) AS leftover
    FROM occ GROUP BY doc_id, lang""",
)
def leftover_script(spark, sf):
    out = F.when(F.col("passed"), F.col("line")).otherwise(
        infer.marker_translate(F.col("line"), F.lit("en"))
    )
    parts = _segments(spark, sf).withColumn(
        "passed", P.passes_through(F.col("line"), F.col("lang"))
    ).withColumn("out", out)
    return report.leftover_script(parts, "out", F.col("lang"), ["doc_id", "lang"])


@query(
    "answer_parse",
    """SELECT doc_id, CASE doc_id % 4 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE
         array_to_string(string_split(text, chr(10)), '|') END AS answers
       FROM documents""",
)
def answer_parse(spark, sf):
    lines = F.split("text", "\n")
    kind = F.col("doc_id") % 4
    body = F.to_json(F.struct(lines.alias("translations")))
    content = (
        F.when(kind == 0, body)
        .when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n``` ")))
        .when(kind == 2, F.regexp_replace(body, r"^\{", "{ nonsense "))
        .otherwise(F.regexp_replace(body, r'\["', '[1,"'))
    )
    return D.table(spark, sf, "documents").select(
        "doc_id", F.array_join(infer.parse_answer(content, F.size(lines)), "|").alias("answers")
    )
