"""Tables derived from the given ones, and the same derivations in SQL for checking.

The given documents hold no Chinese, Japanese, addresses or mixed line endings.  These views give
every document such content by rule, over all rows, so that each operator has real work to do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingualoom.functions import chars as C
from lingualoom.functions import nodes as N
from lingualoom.functions import protect as P
from lingualoom.session import read_table
from lingualoom.sources.text import scan_segments

LETTERS = "abcdefghijklmnopqrstuvwxyz"
HAN_LETTERS = "的一是在不了有和人这中大为上个国我以要他时来用们生到"
KANA_LETTERS = "あいうえおかきくけこさしすせそ日本語文章東京時間人学"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, text: five kinds of text by doc_id, each with a few added lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    kind = F.col("doc_id") % 5
    low = F.lower("text")
    body = (
        F.when(kind == 0, F.translate(low, LETTERS, HAN_LETTERS))
        .when(kind == 1, F.translate(low, LETTERS, KANA_LETTERS))
        .when(kind == 2, F.regexp_replace(F.regexp_replace("text", r"\p{L}{4}", "7777"), r"\p{L}", "7"))
        .when(kind == 3, F.replace("text", F.lit("\n"), F.lit("\r\n")))
        .otherwise(F.replace("text", F.lit("\n"), F.lit("\r")))
    )
    end = (
        F.when(kind == 3, F.lit("\r\n")).when(kind == 4, F.lit("\r")).otherwise(F.lit("\n"))
    )
    src = F.col("source")
    added = F.concat(
        end,
        F.lit("https://"), src, F.lit(".example.com/a/"), F.col("doc_id").cast("string"),
        F.lit("."), end, F.lit("\u3000 Contact "), src, F.lit("@example.org, see C:\\data\\"), src,
        F.lit(" or (/usr/share/"), src, F.lit("/x), <g1> 的 あ end. \t"), end, end,
        F.lit("12,345.67"), end,
    )
    lang = F.when(kind == 0, F.lit("zh")).when(kind == 1, F.lit("ja")).otherwise(F.col("lang"))
    return docs.select("doc_id", "source", lang.alias("lang"), F.concat(body, added).alias("text"))


# What a word can become, in order: a wrapper's opening (two), the word itself, a styled blank, a wrapper's end (two).
_EVENTS = ("open", "open", "word", "text", "close", "close")


def _paragraph(lines: pa.Array) -> pa.Array:
    """Nodes of each line, made for a whole batch of words at a time."""
    words = pc.split_pattern(lines, " ")
    size = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words, starts = words.flatten(), N.offsets_of(size)[:-1]
    n = np.repeat(size, size)
    i = np.arange(len(n)) - np.repeat(starts, size)
    wide = n > i - i % 29 + 18
    # One row for each word, one column for each event.
    made = np.stack([wide & (i % 29 == 15), wide & (i % 29 == 16), i >= 0, (i % 13 == 6) & (i < n - 1), wide & (i % 29 == 17), wide & (i % 29 == 18)], 1)
    word, event = np.nonzero(made)
    at = i[word]
    keep, obj = at % 19 == 7, at % 23 == 11
    is_word, blank = event == 2, event == 3
    kind = np.where(is_word, np.where(keep, 6, np.where(obj, 7, 3)), event)
    kinds = pa.array([*_EVENTS, "keep", "obj"]).take(pa.array(kind))
    texts = words.take(pa.array(word, mask=~is_word | (kind == 7)))
    gap = pa.array(["", " "]).take(pa.array((is_word & (kind == 3) & (at < n[word] - 1) & (at % 13 != 6)).astype(np.int64)))
    texts = pc.if_else(pa.array(blank), " ", pc.binary_join_element_wise(texts, gap, ""))
    style = np.where(blank, 2, np.where(np.isin(at % 9, (4, 5)), 1, np.where(at % 31 == 20, 2, 0)))
    wrapped = ~is_word & ~blank
    key = np.where(kind == 7, at, at // 29 * 2 + np.isin(event, (1, 4)))
    fields = [
        pa.array((at * 8 + event).astype(np.int32)), kinds, texts, pa.array(style.astype(np.int32), mask=wrapped | (kind == 7)),
        pa.array(key.astype(np.int32), mask=~wrapped & (kind != 7)),
    ]
    rows = np.repeat(np.arange(len(size)), size)[word]
    return N.lists(np.bincount(rows, minlength=len(size)), pa.StructArray.from_arrays(fields, list(N.FIELDS)), size > 0)


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs: every line of every document cut into words, with styles, kept words, objects,
    wrappers (some nested) and styled blanks placed by word number."""
    lines = scan_segments(table(spark, sf_dir, "documents").select("doc_id", "text"))

    return lines.select("doc_id", "seg_no", F.arrow_udf(_paragraph, N.NODES)(F.col("line")).alias("nodes"))


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


CORPUS_SQL = f"""
corpus AS (
  SELECT doc_id, source,
         CASE doc_id % 5 WHEN 0 THEN 'zh' WHEN 1 THEN 'ja' ELSE lang END AS lang,
         CASE doc_id % 5
           WHEN 0 THEN translate(lower(text), '{LETTERS}', '{HAN_LETTERS}')
           WHEN 1 THEN translate(lower(text), '{LETTERS}', '{KANA_LETTERS}')
           WHEN 2 THEN regexp_replace(text, '\\p{{L}}', '7', 'g')
           WHEN 3 THEN replace(text, chr(10), chr(13) || chr(10))
           ELSE replace(text, chr(10), chr(13)) END
         || e || 'https://' || source || '.example.com/a/' || doc_id || '.' || e
         || '\u3000 Contact ' || source || '@example.org, see C:\\data\\' || source
         || ' or (/usr/share/' || source || '/x), <g1> 的 あ end. ' || chr(9) || e || e
         || '12,345.67' || e AS text
  FROM (SELECT *, CASE doc_id % 5 WHEN 3 THEN chr(13) || chr(10) WHEN 4 THEN chr(13)
                  ELSE chr(10) END AS e
        FROM documents)
)"""


def sql_blank(expr: str) -> str:
    return f"(trim({expr}, {quote_ws()}) = '')"


def quote_ws() -> str:
    return "'" + C.WS_CHARS + "'"


def sql_strip(expr: str) -> str:
    return f"trim({expr}, {quote_ws()})"


def sql_lines(source: str, cols: str = "") -> str:
    """Rows (doc_id, cols, seg_no, line) of every line, blank ones included."""
    extra = f", {cols}" if cols else ""
    return (
        f"SELECT doc_id{extra}, CAST(unnest(range(len(ls))) AS INTEGER) AS seg_no, "
        f"unnest(ls) AS line FROM (SELECT *, string_split_regex(text, '\\r\\n|\\n|\\r') AS ls "
        f"FROM {source})"
    )




# RE2 has no lookbehind: the character in front is matched and put back.
_P = P.SPAN_PATTERNS
_BEHIND_WORD = f"(?<![{C.WORD}])"
_BEHIND_PATH = f"(?<![{C.WORD}/.])"
_NO_PREFIX = "|".join([P.TAG_LIKE, _P["url"], _P["email"], _P["unc"]])
_WORD_START = "|".join([_P["www"].replace(_BEHIND_WORD, ""), _P["drive"].replace(_BEHIND_WORD, "")])
_PATH_START = _P["unix"].replace(_BEHIND_PATH, "")
SQL_SPANS = (
    f"(^|[^{C.WORD}])({_WORD_START})|({_NO_PREFIX})|(^|[^{C.WORD}/.])({_PATH_START})"
).replace("'", "''")
_TAIL_SQL = "[" + "".join("\\" + ch if ord(ch) < 128 else ch for ch in P.TRAILING_PUNCTUATION) + "]+"
_TAIL_SQL = _TAIL_SQL.replace("'", "''")


def sql_marked(expr: str) -> str:
    """Text with U+0001 and U+0002 around each protected span."""
    found = f"regexp_replace({expr}, '{SQL_SPANS}', '\\1\\4\x01\\2\\3\\5\x02', 'g')"
    return f"regexp_replace({found}, '({_TAIL_SQL})\x02', '\x02\\1', 'g')"


def sql_outside(expr: str) -> str:
    return f"regexp_replace({sql_marked(expr)}, '\x01[^\x02]*\x02', '', 'g')"


def sql_encoded(expr: str) -> str:
    holes = f"string_split(regexp_replace({sql_marked(expr)}, '\x01[^\x02]*\x02', '\x01', 'g'), '\x01')"
    return (
        f"array_to_string(list_transform({holes}, lambda p, i: CASE WHEN i = 1 THEN p "
        f"ELSE '<x' || (i - 1) || '/>' || p END), '')"
    )


def sql_spans(expr: str) -> str:
    """List of kept texts."""
    return f"regexp_extract_all({sql_marked(expr)}, '\x01([^\x02]*)\x02', 1)"


def sql_script_letters(expr: str, lang: str) -> str:
    cjk = f"length(regexp_replace({expr}, '[^{C.CJK}]', '', 'g'))"
    latin = f"length(regexp_replace({expr}, '[^{C.LATIN}]', '', 'g'))"
    return f"CASE WHEN {lang} IN ('zh', 'ja') THEN {cjk} ELSE {latin} END"


def sql_passes(expr: str, lang: str) -> str:
    rest = sql_outside(expr)
    letters = sql_script_letters("(" + rest + ")", lang)
    return f"(NOT regexp_matches({rest}, '\\p{{L}}') OR ({letters}) = 0)"


def sql_marker(expr: str, target: str) -> str:
    x = f"regexp_replace({expr}, '[{C.MARKER_CJK}]', 'x', 'g')"
    return f"CASE WHEN {sql_blank(x)} THEN {x} ELSE '{target.upper()}:' || {x} END"


OCC_SQL = f"""{CORPUS_SQL},
lines AS ({sql_lines('corpus', 'lang, source')}),
segs AS (SELECT *, {sql_strip('line')} AS core FROM lines WHERE NOT {sql_blank('line')}),
occ AS (SELECT *, {sql_passes('line', 'lang')} AS passed,
               CASE WHEN NOT {sql_passes('line', 'lang')} THEN {sql_encoded('core')} END AS unit_text
        FROM segs)"""


NODES_SQL = f"""
dl AS ({sql_lines('documents')}),
dw AS (SELECT doc_id, seg_no, string_split(line, ' ') AS ws FROM dl WHERE NOT {sql_blank('line')}),
wd AS (SELECT doc_id, seg_no, len(ws) AS n, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM dw),
wk AS (SELECT *, CASE WHEN i % 19 = 7 THEN 'keep' WHEN i % 23 = 11 THEN 'obj' ELSE 'text' END AS kind,
  CASE WHEN i % 9 IN (4, 5) THEN 1 WHEN i % 31 = 20 THEN 2 ELSE 0 END AS style,
  CASE WHEN i < n - 1 AND i % 13 <> 6 THEN ' ' ELSE '' END AS gap,
  (n > i - i % 29 + 18) AND (i % 29 >= 15) AS wide, i // 29 * 2 AS k FROM wd),
nodes AS (
  SELECT doc_id, seg_no, (i * 8 + 2)::INTEGER AS pos, kind, CASE kind WHEN 'text' THEN w || gap WHEN 'keep' THEN w END AS text,
    (CASE WHEN kind <> 'obj' THEN style END)::INTEGER AS style, (CASE WHEN kind = 'obj' THEN i END)::INTEGER AS key FROM wk
  UNION ALL SELECT doc_id, seg_no, i * 8 + 3, 'text', ' ', 2, NULL FROM wk WHERE i % 13 = 6 AND i < n - 1
  UNION ALL SELECT doc_id, seg_no, i * 8, 'open', NULL, NULL, k FROM wk WHERE wide AND i % 29 = 15
  UNION ALL SELECT doc_id, seg_no, i * 8 + 1, 'open', NULL, NULL, k + 1 FROM wk WHERE wide AND i % 29 = 16
  UNION ALL SELECT doc_id, seg_no, i * 8 + 4, 'close', NULL, NULL, k + 1 FROM wk WHERE wide AND i % 29 = 17
  UNION ALL SELECT doc_id, seg_no, i * 8 + 5, 'close', NULL, NULL, k FROM wk WHERE wide AND i % 29 = 18)"""


def sql_normalized(source: str, out: str) -> str:
    """CTEs that end in ``out``: normalised node rows."""
    blank = sql_blank("text")
    w = "(PARTITION BY doc_id, seg_no ORDER BY pos)"
    return f"""
{out}_a AS (SELECT *, COALESCE(lag(kind) OVER {w} = 'text', false) AS aft, COALESCE(lead(kind) OVER {w} = 'text', false) AS bef,
  lead(style) OVER {w} AS nxt FROM {source} WHERE NOT (kind = 'text' AND text = '')),
{out}_b AS (SELECT *, CASE WHEN kind = 'text' THEN CASE WHEN NOT {blank} THEN style
  WHEN NOT aft THEN CASE WHEN bef THEN nxt ELSE style END END END AS anchor FROM {out}_a),
{out}_c AS (SELECT doc_id, seg_no, pos, kind, text, key, aft, CASE WHEN kind = 'text' THEN
  last_value(anchor IGNORE NULLS) OVER (PARTITION BY doc_id, seg_no ORDER BY pos ROWS UNBOUNDED PRECEDING) ELSE style END AS style FROM {out}_b),
{out}_d AS (SELECT *, CASE WHEN kind = 'text' AND aft AND lag(style) OVER {w} = style THEN 0 ELSE 1 END AS nw FROM {out}_c),
{out}_e AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id, seg_no ORDER BY pos ROWS UNBOUNDED PRECEDING) AS isl FROM {out}_d),
{out} AS (SELECT doc_id, seg_no, min(pos)::INTEGER AS pos, min(kind) AS kind, string_agg(text, '' ORDER BY pos) AS text,
  min(style)::INTEGER AS style, min(key)::INTEGER AS key FROM {out}_e GROUP BY doc_id, seg_no, isl)"""


def sql_based(source: str, out: str) -> str:
    size = f"length({sql_strip('text')})"
    return f"""
{out}_w AS (SELECT *, sum(CASE WHEN kind = 'text' THEN {size} END) OVER (PARTITION BY doc_id, seg_no, style) AS wt FROM {source}),
{out} AS (SELECT * EXCLUDE (wt), COALESCE(first_value(CASE WHEN kind = 'text' THEN style END) OVER (PARTITION BY doc_id, seg_no
  ORDER BY kind = 'text' DESC, wt DESC, pos), 0)::INTEGER AS base FROM {out}_w)"""


def sql_encoding(source: str) -> str:
    """CTEs that end in ``enc``: the engine input of each paragraph of node rows."""
    return f"""{sql_normalized(source, 'nrm')}, {sql_based('nrm', 'bsd')},
num AS (SELECT *, kind = 'text' AND style <> base AS sty,
  sum(CASE WHEN kind = 'open' OR (kind = 'text' AND style <> base) THEN 1 ELSE 0 END) OVER w AS gid,
  sum(CASE WHEN kind IN ('keep', 'obj') THEN 1 ELSE 0 END) OVER w AS xid,
  sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER w AS depth FROM bsd
  WINDOW w AS (PARTITION BY doc_id, seg_no ORDER BY pos ROWS UNBOUNDED PRECEDING)),
lvl AS (SELECT *, CASE kind WHEN 'open' THEN depth WHEN 'close' THEN depth + 1 END AS lv FROM num),
opn AS (SELECT *, last_value(CASE WHEN kind = 'open' THEN gid END IGNORE NULLS) OVER (PARTITION BY doc_id, seg_no, lv
  ORDER BY pos ROWS UNBOUNDED PRECEDING) AS og FROM lvl),
pcs AS (SELECT *, CASE WHEN sty THEN '<g' || gid || '>' || text || '</g' || gid || '>' WHEN kind = 'text' THEN text
  WHEN kind = 'open' THEN '<g' || gid || '>' WHEN kind = 'close' THEN '</g' || og || '>' ELSE '<x' || xid || '/>' END AS piece FROM opn),
enc AS (SELECT doc_id, seg_no, string_agg(piece, '' ORDER BY pos) AS unit_text, min(base) AS base_style,
  count(*) FILTER (sty OR kind = 'open') AS n_groups, count(*) FILTER (kind IN ('keep', 'obj')) AS n_objects,
  bool_or(kind IN ('keep', 'obj') AND xid = 1 AND depth = 0) AS x1_top, bool_or(sty AND gid = 1) AS g1_style,
  bool_or(sty AND gid = 1 AND depth = 0) AS g1_top, bool_or(sty AND {sql_blank('text')}) AS hollow FROM pcs GROUP BY doc_id, seg_no)"""


ENCODED_SQL = f"{NODES_SQL}, {sql_encoding('nodes')}"
