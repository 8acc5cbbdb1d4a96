"""Registered queries: inline structure, recovery, engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingualoom.functions import chars as C
from lingualoom.functions import tags as G
from lingualoom.operators import infer, units
from lingualoom.operators import inline as I
from lingualoom.plans import derived as D
from lingualoom.plans import recover
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


def _normalized(spark, sf):
    return I.normalize_nodes(D.paragraphs(spark, sf))


def _encoded(spark, sf):
    return I.encode_tags(_normalized(spark, sf))


@query(
    "normalize_nodes",
    f"WITH {D.NODES_SQL}, {D.sql_normalized('nodes', 'nrm')} SELECT * FROM nrm",
)
def normalize_nodes(spark, sf):
    return I.rows(_normalized(spark, sf))


@query(
    "plain_text",
    f"""WITH {D.NODES_SQL} SELECT doc_id, seg_no, COALESCE(string_agg(text, '' ORDER BY pos) FILTER (kind IN ('text', 'keep')), '') AS text
    FROM nodes GROUP BY ALL""",
)
def plain_text(spark, sf):
    return I.visible_text(D.paragraphs(spark, sf))


@query(
    "translatable_text",
    f"""WITH {D.NODES_SQL} SELECT doc_id, seg_no, COALESCE(string_agg(text, '' ORDER BY pos) FILTER (kind = 'text'), '') AS text
    FROM nodes GROUP BY ALL""",
)
def translatable_text(spark, sf):
    return I.visible_text(D.paragraphs(spark, sf), ("text",))


@query(
    "dominant_style",
    f"""WITH {D.NODES_SQL}, {D.sql_normalized('nodes', 'nrm')}, {D.sql_based('nrm', 'bsd')}
    SELECT doc_id, seg_no, min(base) AS base_style FROM bsd GROUP BY ALL""",
)
def dominant_style(spark, sf):
    return I.dominant_style(_normalized(spark, sf))


@query(
    "style_ids",
    f"""WITH {D.NODES_SQL}, r AS (SELECT doc_id, 'b' || style || left(text, 1) AS props, min((seg_no, pos)) AS f
      FROM nodes WHERE kind = 'text' GROUP BY ALL)
    SELECT doc_id, props, (row_number() OVER (PARTITION BY doc_id ORDER BY f) - 1)::INTEGER AS style FROM r""",
)
def style_ids(spark, sf):
    runs = I.rows(D.paragraphs(spark, sf)).filter("kind = 'text'").select(
        "doc_id", "seg_no", "pos",
        F.concat(F.lit("b"), F.col("style").cast("string"), F.left("text", F.lit(1))).alias("props"),
    )
    return I.style_ids(runs, "props")


@query(
    "encode_tags",
    f"WITH {D.ENCODED_SQL} SELECT doc_id, seg_no, unit_text, base_style, n_groups::INTEGER AS n_groups, n_objects::INTEGER AS n_objects FROM enc",
)
def encode_tags(spark, sf):
    return _encoded(spark, sf).select(
        "doc_id", "seg_no", "unit_text", "base_style", F.size("groups").alias("n_groups"),
        F.size("objects").alias("n_objects"),
    )


@query(
    "strip_tags",
    f"WITH {D.ENCODED_SQL} SELECT doc_id, seg_no, regexp_replace(unit_text, '</?g[0-9]+>', '', 'g') AS bare FROM enc",
)
def strip_tags(spark, sf):
    return _encoded(spark, sf).select("doc_id", "seg_no", G.strip_paired(F.col("unit_text")).alias("bare"))


@query(
    "span_texts",
    f"""WITH {D.ENCODED_SQL}, s AS (SELECT doc_id, seg_no, unit_text, unnest(range(1, n_groups + 1)) AS gid FROM enc)
    SELECT doc_id, seg_no, gid::INTEGER AS gid, regexp_replace(split_part(split_part(unit_text, '<g' || gid || '>', 2), '</g' || gid || '>', 1),
      '</?g[0-9]+>|<x[0-9]+/>', '', 'g') AS text FROM s""",
)
def span_texts(spark, sf):
    return I.taken_apart(_encoded(spark, sf), F.inline_outer(G.span_texts(F.col("unit_text"), F.col("groups"))), "gid")


def _damaged(encoded):
    """Engine outputs that are right or wrong in a known way, by document and line number."""
    text, kind = F.col("unit_text"), (F.col("doc_id") + F.col("seg_no")) % 5
    return encoded.withColumn(
        "output",
        F.when(kind == 1, F.concat(text, F.lit("<x99/>")))
        .when(
            kind == 2,
            F.replace(F.replace(F.replace(text, F.lit("<g1>"), F.lit("\x01")), F.lit("</g1>"), F.lit("<g1>")),
                      F.lit("\x01"), F.lit("</g1>")),
        )
        .when(
            (kind == 3) & F.contains(text, F.lit("<x1/>")),
            F.replace(F.replace(text, F.lit("<x1/>"), F.lit("")), F.lit("<g1>"), F.lit("<g1><x1/>")),
        )
        .when(kind == 4, F.regexp_replace(text, "<g1>[^<]*</g1>", "<g1> </g1>"))
        .otherwise(text),
    )


@query(
    "validate_tags",
    f"""WITH {D.ENCODED_SQL} SELECT doc_id, seg_no, CASE (doc_id + seg_no) % 5
      WHEN 1 THEN 'tag_inventory'
      WHEN 2 THEN CASE WHEN n_groups > 0 THEN 'tag_nesting' END
      WHEN 3 THEN CASE WHEN n_objects > 0 AND n_groups = 0 THEN 'tag_inventory' WHEN n_objects > 0 AND x1_top THEN 'tag_parent' END
      WHEN 4 THEN CASE WHEN g1_style THEN 'empty_span' END END AS reason FROM enc""",
)
def validate_tags(spark, sf):
    return I.validate_tags(_damaged(_encoded(spark, sf))).select("doc_id", "seg_no", "reason")


@query(
    "validate_tag_inventory",
    f"""WITH {D.ENCODED_SQL} SELECT doc_id, seg_no, CASE (doc_id + seg_no) % 5 WHEN 1 THEN false
      WHEN 3 THEN NOT (n_objects > 0 AND n_groups = 0) ELSE true END AS ok FROM enc""",
)
def validate_tag_inventory(spark, sf):
    damaged = _damaged(_encoded(spark, sf))
    return damaged.select(
        "doc_id", "seg_no", G.inventory_ok(F.col("unit_text"), F.col("output")).alias("ok")
    )


def _ws_sql() -> str:
    ws = f"[{C.WS}]"
    moved = "regexp_replace(regexp_replace(unit_text, '(<g[0-9]+>)', '\\1 ', 'g'), '(</g[0-9]+>)', ' \\1', 'g')"
    once = (
        f"regexp_replace(regexp_replace(acc, '(<g[0-9]+>)({ws}+)', '\\2\\1', 'g'), "
        f"'({ws}+)(</g[0-9]+>)', '\\2\\1', 'g')"
    )
    steps = f"list_reduce(list_prepend({moved}, list_transform(range(8), lambda i: '')), lambda acc, x: {once})"
    single = f"regexp_replace(t, '([^{C.WS}]) {{2,}}([^{C.WS}])', '\\1 \\2', 'g')"
    single = f"regexp_replace({single}, '([^{C.WS}]) {{2,}}([^{C.WS}])', '\\1 \\2', 'g')"
    lead = f"left(unit_text, length(unit_text) - length(ltrim(unit_text, {D.quote_ws()})))"
    trail = f"CASE WHEN {D.sql_blank('unit_text')} THEN '' ELSE substr(unit_text, length(rtrim(unit_text, {D.quote_ws()})) + 1) END"
    return f"""WITH {D.ENCODED_SQL}, m AS (SELECT doc_id, seg_no, unit_text, {steps} AS t FROM enc)
    SELECT doc_id, seg_no, {lead} || {D.sql_strip(single)} || {trail} AS text FROM m"""


@query("normalize_tag_ws", _ws_sql())
def normalize_tag_ws(spark, sf):
    moved = F.regexp_replace(
        F.regexp_replace("unit_text", "(<g[0-9]+>)", "$1 "), "(</g[0-9]+>)", " $1"
    )
    return _encoded(spark, sf).withColumn("moved", moved).select(
        "doc_id", "seg_no", G.normalize_whitespace(F.col("moved"), F.col("unit_text")).alias("text")
    )


@query(
    "decode_tags",
    f"""WITH {D.NODES_SQL}, {D.sql_normalized('nodes', 'nrm')}
    SELECT doc_id, seg_no, (row_number() OVER (PARTITION BY doc_id, seg_no ORDER BY pos))::INTEGER AS n, kind, text, style, key FROM nrm""",
)
def decode_tags(spark, sf):
    decoded = I.decode_tags(_encoded(spark, sf), "unit_text")
    fields = [F.col(f"x.{f}").alias(f) for f in ("kind", "text", "style", "key")]
    return I.taken_apart(decoded, F.posexplode_outer("nodes").alias("n", "x"), "n").select("doc_id", "seg_no", (F.col("n") + 1).alias("n"), *fields)


@query(
    "segmented_pieces",
    f"WITH {D.NODES_SQL}, {D.sql_normalized('nodes', 'nrm')} SELECT doc_id, seg_no, pos, text FROM nrm WHERE kind = 'text'",
)
def segmented_pieces(spark, sf):
    return I.segmented_pieces(_normalized(spark, sf)).drop("leaf")


_NEEDLE_SQL = f"""lower(rtrim({D.sql_strip("regexp_replace(split_part(split_part(unit_text, '<g' || g || '>', 2), '</g' || g || '>', 1), '</?g[0-9]+>|<x[0-9]+/>', '', 'g')")}, '.。．'))"""


@query(
    "project_spans",
    f"""WITH {D.ENCODED_SQL}, b AS (SELECT *, regexp_replace(unit_text, '</?g[0-9]+>', '', 'g') AS bare FROM enc),
    s AS (SELECT doc_id, seg_no, lower(bare) AS low, {_NEEDLE_SQL} AS needle
      FROM (SELECT *, unnest(range(1, n_groups + 1)) AS g FROM b)),
    f AS (SELECT doc_id, seg_no, bool_and(needle <> '' AND length(low) - length(replace(low, needle, '')) = length(needle)) AS ok
      FROM s GROUP BY ALL)
    SELECT doc_id, seg_no, COALESCE(ok, true) AS found, CASE WHEN COALESCE(ok, true) THEN md5(bare) END AS plain_md5,
      CASE WHEN COALESCE(ok, true) THEN n_groups::INTEGER END AS groups FROM b LEFT JOIN f USING (doc_id, seg_no)""",
)
def project_spans(spark, sf):
    asked = _encoded(spark, sf).withColumn("plain", G.strip_paired(F.col("unit_text"))).withColumn(
        "spans", G.span_texts(F.col("unit_text"), F.col("groups"))
    )
    return I.project_spans(asked).select(
        "doc_id", "seg_no", F.col("projected").isNotNull().alias("found"),
        F.md5(G.strip_paired(F.col("projected"))).alias("plain_md5"),
        F.when(
            F.col("projected").isNotNull(),
            F.size(F.regexp_extract_all("projected", F.lit("<g[0-9]+>"), F.lit(0))),
        ).alias("groups"),
    )


def _joined_sql() -> str:
    w = "(PARTITION BY doc_id, seg_no ORDER BY pos)"
    return f"""WITH {D.NODES_SQL}, {D.sql_normalized('nodes', 'nrm')}, {D.sql_based('nrm', 'bsd')},
    lf AS (SELECT *, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id, seg_no
        ORDER BY pos ROWS UNBOUNDED PRECEDING) AS depth,
      CASE kind WHEN 'text' THEN {D.sql_strip('text')} WHEN 'keep' THEN text END AS t, kind <> 'text' AS kept FROM bsd),
    lv AS (SELECT *, kind = 'text' AND style = base AND depth = 0 AS plain FROM lf),
    nb AS (SELECT *, lag(t) OVER {w} AS lt, lag(kept) OVER {w} AS lk, lead(t) OVER {w} AS rt, lead(kept) OVER {w} AS rk,
      lead(plain) OVER {w} AS rp FROM lv WHERE kind NOT IN ('open', 'close')),
    bd AS (SELECT *, COALESCE(regexp_matches(lt, '[\\p{{L}}\\p{{N}}.,;:!?)\\]]$') AND regexp_matches(t, '^[\\p{{L}}\\p{{N}}]'), false) AS m1,
      COALESCE(regexp_matches(t, '[\\p{{L}}\\p{{N}}.,;:!?)\\]]$') AND regexp_matches(rt, '^[\\p{{L}}\\p{{N}}]'), false) AS m2 FROM nb),
    nw AS (SELECT doc_id, seg_no, pos, kind, CASE WHEN kind = 'text' THEN
        CASE WHEN m1 AND (plain OR (lk AND NOT kept)) THEN ' ' ELSE '' END || t ||
        CASE WHEN m2 AND NOT (rp OR (kept AND NOT rk)) THEN ' ' ELSE '' END ELSE text END AS text, style, key FROM bd
      UNION ALL SELECT doc_id, seg_no, pos, kind, text, style, key FROM lv WHERE kind IN ('open', 'close')),
    {D.sql_normalized('nw', 'fin')} SELECT * FROM fin"""


@query("join_segmented", _joined_sql())
def join_segmented(spark, sf):
    from lingualoom.functions import text as X

    said = F.transform(F.filter("nodes", lambda n: n["kind"] == "text"), lambda n: X.strip(n["text"]))
    return I.rows(I.join_segmented(_normalized(spark, sf).withColumn("translations", said), latin_target=True))


# ---- engines and recovery ------------------------------------------------------------------------


def _forgetful(texts):
    """A native engine that loses the tags of every text whose length divides by 3."""
    marked = infer.marker_translate(F.col("text"), F.lit("en"))
    lost = F.length("text") % 3 == 0
    return texts.withColumn("output", F.when(lost, G.strip_paired(marked)).otherwise(marked))


TERM = "Loom Term"


def _addressed(paragraphs):
    """Some bold texts end in an address and a term."""
    some = lambda n: (n["kind"] == "text") & (n["style"] == 1) & (n["pos"] % 5 == 2)
    more = lambda n: F.concat(n["text"], F.lit("https://e.org/"), n["pos"].cast("string"), F.lit(f", {TERM}"))
    return paragraphs.withColumn("nodes", F.transform("nodes", lambda n: n.withField("text", F.when(some(n), more(n)).otherwise(n["text"]))))


_ADDRESSED_SQL = f"""{D.NODES_SQL},
nda AS (SELECT * REPLACE (CASE WHEN kind = 'text' AND style = 1 AND pos % 5 = 2 THEN text || 'https://e.org/' || pos || ', {TERM}' ELSE text END AS text) FROM nodes),
ndm AS (SELECT *, CASE WHEN kind = 'text' THEN regexp_extract_all(replace({D.sql_marked('text')}, '{TERM}', '\x01{TERM}\x02'), '\x01[^\x02]*\x02|[^\x01\x02]+') ELSE [text] END AS ps FROM nda),
ndp AS (SELECT doc_id, seg_no, pos, kind, style, key, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM ndm),
ndk AS (SELECT doc_id, seg_no, (row_number() OVER (PARTITION BY doc_id, seg_no ORDER BY pos, i))::INTEGER AS pos,
  CASE WHEN kind = 'text' AND p LIKE '\x01%' THEN 'keep' ELSE kind END AS kind, replace(replace(p, '\x01', ''), '\x02', '') AS text, style, key FROM ndp),
{D.sql_encoding('ndk')}"""


# The forgetful engine puts EN: in front of every answer, so a span's own answer is found in the
# whole answer only where the paragraph begins with that span.  A styled blank between kept things can't be told from
# a span that lost its text, so its paragraph goes piece by piece.
@query(
    "recovery_cascade",
    f"""WITH {_ADDRESSED_SQL}, u AS (SELECT doc_id, unit_text, n_groups, COALESCE(hollow, false) AS hollow, {D.sql_strip("regexp_replace(unit_text, '</?g[0-9]+>', '', 'g')")} AS bare,
      length({D.sql_strip('unit_text')}) AS size, {D.sql_strip("regexp_replace(split_part(split_part(unit_text, '<g1>', 2), '</g1>', 1), '<x[0-9]+/>', '', 'g')")} AS span FROM enc),
    m AS (SELECT doc_id, unit_text, CASE WHEN n_groups = 0 OR (size % 3 <> 0 AND NOT hollow) THEN 'direct'
      WHEN n_groups = 1 AND NOT hollow AND span <> '' AND starts_with(lower(bare), lower(rtrim(span, '.。．'))) THEN 'projected' ELSE 'segmented' END AS method FROM u)
    SELECT doc_id, method, count(*) AS segments, count(DISTINCT unit_text) AS inputs, 0::BIGINT AS errors, 0::BIGINT AS empty
    FROM m GROUP BY ALL""",
)
def recovery_cascade(spark, sf):
    from lingualoom.functions import text as X

    segments, nodes = recover.translate_formatted(_addressed(D.paragraphs(spark, sf)), _forgetful, "en", [TERM])
    # Whether a text is empty is told where it is made, so it need not travel.
    visible = I.visible_text(nodes).select("doc_id", "seg_no", X.is_blank(F.col("text")).alias("blank"))
    return segments.join(visible, ["doc_id", "seg_no"], "left").groupBy("doc_id", "method").agg(
        F.count("*").alias("segments"), F.countDistinct("unit_key").alias("inputs"),
        F.count("error_code").alias("errors"), F.count_if(F.coalesce("blank", F.lit(True))).alias("empty"),
    )


class _MarkerEngine:
    """The marker engine behind the batch interface, refusing batches that hold long texts."""

    def translate_batch(self, texts, source, target):
        import re

        cjk = re.compile("[　-ヿ㐀-䶿一-鿿＀-￯]")
        if len(texts) > 1 and any(len(t) > 400 for t in texts):
            return ["too much"]
        return [f"{target.upper()}:{cjk.sub('x', t)}" for t in texts]


class _NamingEngine(_MarkerEngine):
    """Puts the source language it was given in front."""

    def translate_batch(self, texts, source, target):
        answers = super().translate_batch(texts, source, target)
        return [f"{source}>{a}" for a in answers] if len(answers) == len(texts) else answers


@query(
    "translate_units",
    f"""WITH {D.OCC_SQL}, u AS (SELECT DISTINCT lang, unit_text FROM occ WHERE unit_text IS NOT NULL)
    SELECT unit_text, lang || '>' || {D.sql_marker('unit_text', 'en')} AS output, CAST(NULL AS VARCHAR) AS error_code FROM u""",
)
def translate_units(spark, sf):
    inputs = units.engine_inputs(S.scan_segments(D.corpus(spark, sf), keep=("lang",)), keep=("lang",))
    distinct = units.unique_units(inputs, group=("lang",))
    answers = infer.translate_units(distinct, _NamingEngine, "en")
    return answers.select("unit_text", "output", "error_code")


class _PickyEngine(_MarkerEngine):
    """Fails for good on texts that begin with W, and once on every other fresh batch.

    A batch is asked again right after it failed, so the last one is all that is remembered.
    """

    def __init__(self):
        self.last = None

    def translate_batch(self, texts, source, target):
        if texts[0] != self.last:
            self.last = texts[0]
            raise infer.EngineFailure(503, "0")
        if any(t.startswith("W") for t in texts):
            if len(texts) == 1:
                raise infer.EngineFailure(400)
            return []
        return super().translate_batch(texts, source, target)


@query(
    "bounded_retry",
    f"""WITH {D.OCC_SQL}, u AS (SELECT DISTINCT unit_text FROM occ WHERE unit_text IS NOT NULL)
    SELECT unit_text, CASE WHEN unit_text NOT LIKE 'W%' THEN {D.sql_marker('unit_text', 'en')} END AS output,
      CASE WHEN unit_text LIKE 'W%' THEN 'engine_response' END AS error_code, 2 AS attempts FROM u""",
)
def bounded_retry(spark, sf):
    inputs = units.engine_inputs(S.scan_segments(D.corpus(spark, sf), keep=("lang",)))
    answers = infer.translate_units(
        units.unique_units(inputs), _PickyEngine, "en", lang=None, batch=1, max_in_flight=8
    )
    return answers.select("unit_text", "output", "error_code", "attempts")


@query(
    "split_on_bad_batch",
    f"""WITH {D.OCC_SQL}, u AS (SELECT DISTINCT unit_text FROM occ WHERE unit_text IS NOT NULL)
    SELECT length(unit_text) > 400 AS long, count(*) AS answered, 0::BIGINT AS lost FROM u GROUP BY 1""",
)
def split_on_bad_batch(spark, sf):
    inputs = units.engine_inputs(S.scan_segments(D.corpus(spark, sf), keep=("lang",)))
    answers = infer.translate_units(units.unique_units(inputs), _MarkerEngine, "en", lang=None, batch=64)
    return answers.groupBy((F.length("unit_text") > 400).alias("long")).agg(
        F.count("output").alias("answered"), F.count("error_code").alias("lost")
    )
