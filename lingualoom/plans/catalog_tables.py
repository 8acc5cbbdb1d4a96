"""Registered queries: spreadsheets, fit, summaries, identity, records."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingualoom.operators import fit, identity, records, report, sheet
from lingualoom.plans import derived as D

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


# ---- spreadsheets: every order line is a cell ----------------------------------------------------


def _cells(spark, sf):
    lines = D.table(spark, sf, "lineitem")
    return lines.select(
        (F.col("l_suppkey") % 7).cast("int").alias("sheet"),
        (F.col("l_partkey") % 300).cast("int").alias("col"),
        (F.col("l_orderkey") % 3000).cast("int").alias("row"),
        "l_returnflag",
    ).distinct()


_CELLS_SQL = """cells AS (SELECT DISTINCT (l_suppkey % 7)::INTEGER AS sheet, (l_partkey % 300)::INTEGER AS col,
    (l_orderkey % 3000)::INTEGER AS row, l_returnflag FROM lineitem)"""


@query(
    "sheet_string_fanout",
    """WITH c AS (SELECT l_suppkey % 7 AS doc_id, l_partkey AS idx, l_orderkey AS pos,
      'cell ' || l_orderkey AS location FROM lineitem),
    u AS (SELECT doc_id, idx, arg_min(location, (pos, location)) AS f, count(*) AS cells FROM c GROUP BY ALL)
    SELECT doc_id, idx, text, cells, CASE WHEN cells > 1 THEN f || ' (and ' || (cells - 1) || ' more cells)' ELSE f END AS location,
      CASE WHEN text IS NULL THEN 'invalid_document' END AS error_code
    FROM u LEFT JOIN (SELECT d.doc_id AS idx, text, s.k AS doc_id FROM documents d, (SELECT unnest(range(7)) AS k) s) USING (doc_id, idx)""",
)
def sheet_string_fanout(spark, sf):
    cells = D.table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 7).alias("doc_id"), F.col("l_partkey").alias("idx"),
        F.col("l_orderkey").alias("pos"),
        F.concat(F.lit("cell "), F.col("l_orderkey").cast("string")).alias("location"),
    )
    shared = D.table(spark, sf, "documents").select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("doc_id"),
        F.col("doc_id").alias("idx"), "text",
    )
    return sheet.sheet_string_fanout(cells, shared)


@query(
    "formula_literal_match",
    """WITH f AS (SELECT o_custkey % 20 AS doc_id, 'o' || o_orderkey AS location, o_orderpriority AS p, o_orderstatus AS s FROM orders),
    t AS (SELECT DISTINCT c_nationkey % 20 AS doc_id, CASE c_custkey % 4 WHEN 0 THEN 'say "F"' WHEN 1 THEN '1-URGENT' ELSE c_name END AS text
      FROM customer)
    SELECT DISTINCT f.doc_id, location FROM f JOIN t ON t.doc_id = f.doc_id AND (t.text = p OR t.text = 'say "' || s || '"')""",
)
def formula_literal_match(spark, sf):
    orders = D.table(spark, sf, "orders")
    formulas = orders.select(
        (F.col("o_custkey") % 20).alias("doc_id"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("location"),
        F.concat(
            F.lit('IF(A1="'), "o_orderpriority", F.lit('","say ""'), "o_orderstatus", F.lit('"""," ")')
        ).alias("formula"),
    )
    translated = D.table(spark, sf, "customer").select(
        (F.col("c_nationkey") % 20).cast("long").alias("doc_id"),
        F.when(F.col("c_custkey") % 4 == 0, F.lit('say "F"')).when(F.col("c_custkey") % 4 == 1, F.lit("1-URGENT"))
        .otherwise(F.col("c_name")).alias("text"),
    )
    return sheet.formula_literal_match(formulas, translated)


_MERGES_SQL = """merges AS (SELECT (p_partkey % 7)::INTEGER AS sheet, p_partkey::INTEGER AS ord,
      (p_partkey * 13 % 300)::INTEGER AS c1, (p_partkey * 31 % 3000)::INTEGER AS r1,
      (p_partkey * 13 % 300 + p_size % 9)::INTEGER AS c2,
      (p_partkey * 31 % 3000 + CASE WHEN p_size = 50 THEN 900 ELSE p_size % 13 END)::INTEGER AS r2 FROM part)"""


def _merges(spark, sf):
    key = F.col("p_partkey")
    c1, r1 = key * 13 % 300, key * 31 % 3000
    return D.table(spark, sf, "part").select(
        (key % 7).cast("int").alias("sheet"), key.cast("int").alias("ord"),
        c1.cast("int").alias("c1"), r1.cast("int").alias("r1"),
        (c1 + F.col("p_size") % 9).cast("int").alias("c2"),
        (r1 + F.when(F.col("p_size") == 50, 900).otherwise(F.col("p_size") % 13)).cast("int").alias("r2"),
    )


@query(
    "merge_range_lookup",
    f"""WITH {_CELLS_SQL}, {_MERGES_SQL},
    j AS (SELECT c.*, m.ord, m.c1, m.r1, m.c2, m.r2, row_number() OVER (PARTITION BY c.sheet, c.col, c.row ORDER BY m.ord) AS rn
      FROM (SELECT DISTINCT sheet, col, row FROM cells) c LEFT JOIN merges m ON c.sheet = m.sheet AND c.col BETWEEN m.c1 AND m.c2 AND c.row BETWEEN m.r1 AND m.r2)
    SELECT sheet, col, row, ord IS NOT NULL AS merged, COALESCE(c1, col) AS c1, COALESCE(r1, row) AS r1,
      COALESCE(c2, col) AS c2, COALESCE(r2, row) AS r2 FROM j WHERE rn = 1""",
)
def merge_range_lookup(spark, sf):
    cells = _cells(spark, sf).select("sheet", "col", "row").distinct()
    return sheet.merge_range_lookup(cells, _merges(spark, sf))


@query(
    "range_width_sum",
    f"""WITH {_MERGES_SQL}, w AS (SELECT (s_suppkey % 7)::INTEGER AS sheet, (s_suppkey * 3 % 300)::INTEGER AS col,
        max(4 + s_nationkey * 0.37::DOUBLE) AS chars FROM supplier GROUP BY ALL),
    px AS (SELECT ord, sheet, c1, c2, x.c AS col FROM merges, LATERAL (SELECT unnest(range(c1, c2 + 1)) AS c) x),
    pt AS (SELECT px.*, trunc((256 * COALESCE(chars, 8.43::DOUBLE) + 18) / 256 * 7) * 0.75 AS pt FROM px LEFT JOIN w ON w.sheet = px.sheet AND w.col = px.col)
    SELECT ord, sheet, c1, c2, (sum(pt) - 3)::DOUBLE AS width_pt FROM pt GROUP BY ALL""",
)
def range_width_sum(spark, sf):
    widths = (
        D.table(spark, sf, "supplier")
        .groupBy((F.col("s_suppkey") % 7).cast("int").alias("sheet"), (F.col("s_suppkey") * 3 % 300).cast("int").alias("col"))
        .agg(F.max(4 + F.col("s_nationkey") * 0.37).alias("chars"))
    )
    return sheet.range_width_sum(_merges(spark, sf), widths).select("ord", "sheet", "c1", "c2", "width_pt")


@query(
    "neighbour_occupied",
    f"""WITH {_CELLS_SQL}, c AS (SELECT sheet, col, row, CASE min(l_returnflag) WHEN 'A' THEN 'right' WHEN 'N' THEN 'center' ELSE 'general' END AS align
      FROM cells GROUP BY ALL)
    SELECT c.*, CASE c.align WHEN 'right' THEN l.col IS NOT NULL WHEN 'center' THEN l.col IS NOT NULL OR r.col IS NOT NULL
      ELSE r.col IS NOT NULL END AS clipped
    FROM c LEFT JOIN c l ON l.sheet = c.sheet AND l.row = c.row AND l.col = c.col - 1
      LEFT JOIN c r ON r.sheet = c.sheet AND r.row = c.row AND r.col = c.col + 1""",
)
def neighbour_occupied(spark, sf):
    align = F.min("l_returnflag")
    cells = _cells(spark, sf).groupBy("sheet", "col", "row").agg(
        F.when(align == "A", F.lit("right")).when(align == "N", F.lit("center"))
        .otherwise(F.lit("general")).alias("align")
    )
    return sheet.neighbour_occupied(cells)


# ---- fit -----------------------------------------------------------------------------------------

_FLOOR_SQL = "CASE WHEN {s} <= 8 THEN {s} ELSE greatest(8, ceil({s} * 0.7::DOUBLE / 0.5::DOUBLE - 1e-9::DOUBLE) * 0.5::DOUBLE) END"
_CAND_SQL = "greatest({f}, floor({s} * {k} / 0.5::DOUBLE + 1e-9::DOUBLE) * 0.5::DOUBLE)"


@query(
    "fit_floor",
    f"""SELECT DISTINCT l_quantity AS size, {_FLOOR_SQL.format(s='l_quantity')} AS floor_pt,
      {_CAND_SQL.format(f=_FLOOR_SQL.format(s='l_quantity'), s='l_quantity', k='(1 - l_discount)')} AS candidate_pt, l_discount AS d FROM lineitem""",
)
def fit_floor(spark, sf):
    size, scale = F.col("l_quantity"), 1 - F.col("l_discount")
    return D.table(spark, sf, "lineitem").select(
        size.alias("size"), fit.fit_floor(size).alias("floor_pt"),
        fit.fit_candidate(size, scale).alias("candidate_pt"), F.col("l_discount").alias("d"),
    ).distinct()


def _containers(spark, sf):
    """One container per order: sizes from its lines, bounds from its price and date."""
    lines = D.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_quantity").alias("s1"), F.max("l_quantity").alias("s2"), F.count("*").alias("n")
    )
    orders = D.table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    wrap = F.col("o_orderstatus") == "F"
    width = F.col("s2") * F.col("n") * 3.0
    bound_w = F.when(F.col("o_custkey") % 5 != 0, F.lit(150.0))
    return orders.select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("doc_id"),
        F.array("s1", "s2").alias("sizes"), width.alias("width"),
        (F.col("s2") * 2.0).alias("height"),
        fit.fit_allowed(bound_w, F.col("s1") * F.col("n") * 3.0, wrap).alias("allowed_w"),
        fit.fit_allowed(F.lit(60.0), F.col("s1") * 2.0, F.lit(False)).alias("allowed_h"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("font_unavailable")).alias("unmeasurable"),
    )


_CONT_SQL = """l AS (SELECT l_orderkey, min(l_quantity) AS s1, max(l_quantity) AS s2, count(*) AS n FROM lineitem GROUP BY 1),
    cont AS (SELECT o_orderkey AS id, o_custkey % 50 AS doc_id, s1, s2, s2 * n * 3 AS width, s2 * 2 AS height,
      CASE WHEN o_custkey % 5 <> 0 AND o_orderstatus <> 'F' THEN greatest(150, s1 * n * 3) END AS allowed_w,
      greatest(60, s1 * 2) AS allowed_h, CASE WHEN o_orderpriority = '5-LOW' THEN 'font_unavailable' END AS unmeasurable
      FROM orders JOIN l ON o_orderkey = l_orderkey),
    meas AS (SELECT id, k, width * (1 - k * 0.025::DOUBLE) AS w, height * (1 - k * 0.025::DOUBLE) AS h FROM cont, (SELECT unnest(range(1, 41)) AS k)),
    fitk AS (SELECT id, min(k) AS k FROM meas JOIN cont USING (id) WHERE (allowed_w IS NULL OR w <= allowed_w + 1) AND h <= allowed_h + 1 GROUP BY id),
    outc AS (SELECT *, CASE WHEN unmeasurable IS NOT NULL THEN 'unresolved'
      WHEN (allowed_w IS NULL OR width <= allowed_w + 1) AND height <= allowed_h + 1 THEN 'unchanged'
      WHEN k IS NOT NULL THEN 'adjusted' ELSE 'unresolved' END AS status FROM cont LEFT JOIN fitk USING (id))"""


def _outcomes(spark, sf):
    containers = _containers(spark, sf)
    scale = 1 - F.col("step") * F.lit(fit.SCALE_STEP)
    measured = containers.select(
        "id", "doc_id", "width", "height", F.explode(F.sequence(F.lit(1), F.lit(fit.MAX_CANDIDATES))).alias("step")
    ).select("id", "doc_id", "step", (F.col("width") * scale).alias("w"), (F.col("height") * scale).alias("h"))
    return fit.fit_choose(containers, measured, ["id", "doc_id"])


@query(
    "fit_allowed",
    f"WITH {_CONT_SQL} SELECT id, allowed_w, allowed_h::DOUBLE AS allowed_h FROM cont",
)
def fit_allowed(spark, sf):
    return _containers(spark, sf).select("id", "allowed_w", "allowed_h")


@query(
    "fit_choose",
    f"""WITH {_CONT_SQL} SELECT id, doc_id, status,
      CASE WHEN unmeasurable IS NOT NULL THEN unmeasurable WHEN status = 'adjusted' THEN 'shrunk_to_fit'
           WHEN status = 'unresolved' THEN 'overflow_at_floor' END AS reason,
      CASE WHEN status = 'adjusted' THEN round(1 - k * 0.025::DOUBLE, 3) END AS scale,
      (CASE WHEN status = 'adjusted' THEN {_CAND_SQL.format(f=_FLOOR_SQL.format(s='s1'), s='s1', k='(1 - k * 0.025::DOUBLE)')}
           WHEN status = 'unresolved' AND unmeasurable IS NULL THEN {_FLOOR_SQL.format(s='s1')} ELSE s1 END)::DOUBLE AS first_size,
      (CASE WHEN status = 'adjusted' THEN {_CAND_SQL.format(f=_FLOOR_SQL.format(s='s2'), s='s2', k='(1 - k * 0.025::DOUBLE)')}
           WHEN status = 'unresolved' AND unmeasurable IS NULL THEN {_FLOOR_SQL.format(s='s2')} ELSE s2 END)::DOUBLE AS last_size
    FROM outc""",
)
def fit_choose(spark, sf):
    return _outcomes(spark, sf).select(
        "id", "doc_id", "status", "reason", "scale",
        F.get("final_sizes", F.lit(0)).alias("first_size"), F.get("final_sizes", F.lit(1)).alias("last_size"),
    )


@query(
    "fit_rollup",
    f"""WITH {_CONT_SQL}, r AS (SELECT doc_id, count(*) AS inspected, count(*) FILTER (status = 'unchanged') AS unchanged,
      count(*) FILTER (status = 'adjusted') AS adjusted, count(*) FILTER (status = 'unresolved') AS unresolved FROM outc GROUP BY doc_id)
    SELECT *, CASE WHEN inspected = 0 THEN 'not_applicable' WHEN unresolved > 0 THEN 'unresolved' WHEN adjusted > 0 THEN 'adjusted'
      ELSE 'passed' END AS overall FROM r""",
)
def fit_rollup(spark, sf):
    return fit.fit_rollup(_outcomes(spark, sf), ["doc_id"])


@query(
    "same_text_skip",
    """SELECT doc_id, md5(text) AS h FROM documents WHERE text <> replace(text, 'ü', 'ue')""",
)
def same_text_skip(spark, sf):
    docs = D.table(spark, sf, "documents").select("doc_id", "text")
    translated = docs.withColumn("text", F.replace(F.col("text"), F.lit("ü"), F.lit("ue")))
    return fit.same_text_skip(docs, translated, ["doc_id"]).select("doc_id", F.md5("text").alias("h"))


# ---- summaries -----------------------------------------------------------------------------------


def _estimates(spark, sf):
    return D.table(spark, sf, "lineitem").select(
        F.col("l_shipdate").alias("d"), F.concat_ws("/", "l_returnflag", "l_linestatus").alias("font"),
        F.col("l_linenumber").alias("true_lines"),
        (F.col("l_linenumber") + F.col("l_partkey") % 3 - 1).alias("our_lines"),
        F.col("l_extendedprice").alias("true_height"),
        (F.col("l_extendedprice") * (1 + F.col("l_discount") - F.col("l_tax"))).alias("our_height"),
    )


_EST_SQL = """e AS (SELECT l_returnflag || '/' || l_linestatus AS font, abs(l_partkey % 3 - 1) AS ld,
    round((l_extendedprice * (1 + l_discount - l_tax) - l_extendedprice) / l_extendedprice, 4) AS re FROM lineitem)"""


@query(
    "estimate_error_summary",
    f"""WITH {_EST_SQL} SELECT count(*) AS cases, count(*) FILTER (ld = 0) AS lines_exact, count(*) FILTER (ld = 1) AS lines_off_by_one,
      round(median(abs(re)), 4) AS median_error, max(abs(re)) AS max_error,
      list_sort(list(abs(re)))[CAST(floor(count(*) * 0.95) AS BIGINT)] AS p95 FROM e""",
)
def estimate_error_summary(spark, sf):
    return report.estimate_error_summary(_estimates(spark, sf))


@query(
    "estimate_error_by_font",
    f"""WITH {_EST_SQL} SELECT font, count(*) AS n, count(*) FILTER (ld = 0) AS lines_exact, round(avg(re), 4) AS mean_error FROM e GROUP BY font""",
)
def estimate_error_by_font(spark, sf):
    return report.estimate_error_by_font(_estimates(spark, sf), ["font"])


def _cases(spark, sf):
    return D.table(spark, sf, "events").select(
        F.col("event_type").alias("engine"), (F.col("user_id") % 12).alias("direction"),
        F.when(F.col("value") > 20, F.lit("tag_inventory")).when(F.col("value") < 2, F.lit("empty_span")).alias("failure"),
        (F.col("event_id") % 1000 / F.lit(10.0)).alias("chrf"),
    )


_CASES_SQL = """c AS (SELECT event_type AS engine, user_id % 12 AS direction, CASE WHEN value > 20 THEN 'tag_inventory'
    WHEN value < 2 THEN 'empty_span' END AS failure, event_id % 1000 / 10.0::DOUBLE AS chrf FROM events)"""


@query(
    "validity_summary",
    f"""WITH {_CASES_SQL} SELECT engine, direction, count(*) AS cases, count(*) FILTER (failure IS NULL) AS valid,
      round(avg(chrf) FILTER (failure IS NULL), 1) AS mean_chrf_valid FROM c GROUP BY ALL""",
)
def validity_summary(spark, sf):
    return report.validity_summary(_cases(spark, sf), ["engine", "direction"])


@query(
    "validity_failures",
    f"WITH {_CASES_SQL} SELECT engine, failure, count(*) AS n FROM c WHERE failure IS NOT NULL GROUP BY ALL",
)
def validity_failures(spark, sf):
    return report.failure_counts(_cases(spark, sf), ["engine"])


@query(
    "unsupported_counts",
    """WITH f AS (SELECT page_id AS doc_id, unnest([{'code': 'links', 'c': len(regexp_extract_all(html, '<a '))},
      {'code': 'scripts', 'c': len(regexp_extract_all(html, '<script'))}]) AS x FROM pages)
    SELECT doc_id, x.code AS code, sum(x.c)::BIGINT AS count FROM f WHERE x.c > 0 GROUP BY ALL""",
)
def unsupported_counts(spark, sf):
    found = F.array(
        F.struct(F.lit("links").alias("code"), F.regexp_count("html", F.lit("<a ")).alias("count")),
        F.struct(F.lit("scripts").alias("code"), F.regexp_count("html", F.lit("<script")).alias("count")),
    )
    findings = D.table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.inline(found))
    return report.unsupported_counts(findings.filter("count > 0"))


# ---- identity ------------------------------------------------------------------------------------


def _details():
    return F.create_map(
        F.lit("temperature"), F.lit("0.0"), F.lit("batch_size"), (F.col("event_id") % 5).cast("string"),
        F.lit("prompt"), F.col("props"),
    )


_DETAILS_SQL = """'{"batch_size":"' || (event_id % 5) || '","prompt":"' || replace(props, '"', '\\"') || '","temperature":"0.0"}'"""


@query(
    "identity_digest",
    f"""SELECT event_id, sha256('{{"details":' || {_DETAILS_SQL} || ',"mode":"llm","model":"' || event_type || '"}}') AS digest FROM events""",
)
def identity_digest(spark, sf):
    return D.table(spark, sf, "events").select(
        "event_id",
        identity.identity_digest(F.lit("llm"), F.col("event_type"), _details()).alias("digest"),
    )


_STRATEGY_JSON = "{" + ",".join(f'"{k}":"{v}"' for k, v in sorted(identity.STRATEGIES.items())) + "}"


@query(
    "output_fingerprint",
    f"""SELECT event_id, sha256('{{"core_version":"1.0","font_manifest":' || CASE WHEN event_id % 2 = 0 THEN 'null' ELSE '"f' || (user_id % 3) || '"' END
      || ',"identity":{{"details":' || {_DETAILS_SQL} || ',"mode":"llm","model":"' || event_type || '"}},"options":{{"source":"auto","target":"en","user":'
      || user_id || '}},"schema":1,"strategies":{_STRATEGY_JSON}}}') AS fingerprint FROM events""",
)
def output_fingerprint(spark, sf):
    fonts = F.when(F.col("event_id") % 2 == 1, F.concat(F.lit("f"), (F.col("user_id") % 3).cast("string")))
    options = F.struct(F.lit("auto").alias("source"), F.lit("en").alias("target"), F.col("user_id").alias("user"))
    return D.table(spark, sf, "events").select(
        "event_id",
        identity.output_fingerprint(
            F.lit("1.0"), F.lit("llm"), F.col("event_type"), _details(), options, fonts
        ).alias("fingerprint"),
    )


@query(
    "set_digest",
    """WITH e AS (SELECT event_type AS g, sha256(event_id || '|' || props) AS d FROM events),
    a AS (SELECT g, left(d, 6) AS p, sha256(string_agg(d, chr(10) ORDER BY d)) AS d FROM e GROUP BY ALL),
    a2 AS (SELECT g, p || d AS d FROM a),
    b AS (SELECT g, left(d, 3) AS p, sha256(string_agg(d, chr(10) ORDER BY d)) AS d FROM a2 GROUP BY ALL),
    b2 AS (SELECT g, p || d AS d FROM b)
    SELECT g, sha256(string_agg(d, chr(10) ORDER BY d)) AS digest FROM b2 GROUP BY g""",
)
def set_digest(spark, sf):
    events = D.table(spark, sf, "events").withColumnRenamed("event_type", "g")
    return identity.set_digest(events, ["g"], F.concat_ws("|", "event_id", "props"))


@query(
    "incremental_manifest",
    """SELECT doc_id, n_chars, md5(text) AS digest, doc_id % 3 <> 0 AND n_chars % 2 = 0 AS reused FROM documents""",
)
def incremental_manifest(spark, sf):
    docs = D.table(spark, sf, "documents")
    found = docs.select("doc_id", "n_chars")
    previous = docs.filter("doc_id % 3 <> 0").select(
        "doc_id", F.when(F.col("n_chars") % 2 == 0, F.col("n_chars")).otherwise(F.col("n_chars") + 1).alias("n_chars"),
        F.md5("text").alias("digest"),
    )

    def describe(rows):
        return rows.join(docs.select("doc_id", F.md5("text").alias("digest")), "doc_id")

    return identity.incremental_manifest(found, previous, ["doc_id", "n_chars"], ["digest"], describe)


# ---- records -------------------------------------------------------------------------------------


@query(
    "idempotent_submissions",
    """SELECT user_id AS owner, props AS submission, count(*) AS tries, arg_min(event_id, (ts, event_id)) AS outcome,
      min(event_type) <> max(event_type) AS conflict FROM events GROUP BY ALL""",
)
def idempotent_submissions(spark, sf):
    rows = D.table(spark, sf, "events").select(
        F.col("user_id").alias("owner"), F.col("props").alias("submission"), "event_type", "ts", "event_id"
    )
    return records.idempotent_submissions(rows, ["owner", "submission"], "event_type", ["ts", "event_id"], "event_id")


@query(
    "batch_status_counts",
    """SELECT user_id AS batch, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error,
      count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup,
      count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id""",
)
def batch_status_counts(spark, sf):
    members = D.table(spark, sf, "events").select(F.col("user_id").alias("batch"), "event_type")
    return records.batch_status_counts(
        members, "batch", "event_type", ("click", "error", "purchase", "signup", "view")
    )


@query(
    "latest_version",
    """SELECT user_id AS document, event_id AS version, arg_max(props, event_id) AS blob FROM events
    WHERE (user_id, event_id) IN (SELECT (user_id, max(event_id)) FROM events GROUP BY user_id) GROUP BY ALL""",
)
def latest_version(spark, sf):
    versions = D.table(spark, sf, "events").select(
        F.col("user_id").alias("document"), F.col("event_id").alias("version"), F.col("props").alias("blob")
    )
    return records.latest_version(versions, "document", "version")


@query(
    "expire_unused",
    "SELECT event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY",
)
def expire_unused(spark, sf):
    now = F.expr("timestamp_ntz '2024-01-31 00:00:00'")
    return records.expire_unused(D.table(spark, sf, "events"), "ts", now, 10).select("event_id", "ts")


@query(
    "unreferenced_blobs",
    """SELECT DISTINCT props || event_id % 50 AS hash FROM events WHERE props || event_id % 50 NOT IN (
      SELECT props || event_id % 50 FROM events WHERE event_type = 'click' UNION SELECT props || event_id % 50 FROM events WHERE event_type = 'view')""",
)
def unreferenced_blobs(spark, sf):
    rows = D.table(spark, sf, "events").select(
        F.concat("props", (F.col("event_id") % 50).cast("string")).alias("hash"), "event_type"
    )
    return records.unreferenced_blobs(
        rows.select("hash").distinct(),
        [rows.filter("event_type = 'click'"), rows.filter("event_type = 'view'")],
        "hash",
    )
