"""Registered queries: detection, parallel data, scores, comparison, runs and baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingualoom.functions import chars as C
from lingualoom.operators import compare as cmp
from lingualoom.operators import detect, evaluate, report
from lingualoom.plans import derived as D
from lingualoom.session import fresh_path, stage
from lingualoom.sinks import tables as sinks
from lingualoom.sources import parallel as par
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


LATIN_LANGUAGES = ("de", "en", "es", "fr")

# ---- detection -----------------------------------------------------------------------------------


def _count(expr: str, body: str) -> str:
    return f"length(regexp_replace({expr}, '[^{body}]', '', 'g'))"


_SAMPLE_SQL = f"""WITH {D.CORPUS_SQL}, lines AS ({D.sql_lines('corpus')}),
    open AS (SELECT doc_id, seg_no, {D.sql_outside('line')} AS line FROM lines WHERE NOT {D.sql_blank('line')}),
    placed AS (SELECT *, COALESCE(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY seg_no
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM open),
    chunks AS (SELECT doc_id, seg_no, start, left(line, 20000 - start) AS chunk FROM placed WHERE start < 20000),
    hist AS (SELECT doc_id, sum({_count('chunk', C.KANA)})::BIGINT AS kana,
        sum({_count('chunk', C.HAN)})::BIGINT AS han, sum({_count('chunk', C.LATIN)})::BIGINT AS latin
        FROM chunks GROUP BY doc_id),
    ruled AS (SELECT *, kana + han + latin = 0 AS none, kana + han >= latin AS cjk,
        kana >= 0.1 * (kana + han) AS ja FROM hist),
    rule AS (SELECT doc_id, kana, han, latin,
        CASE WHEN none THEN NULL WHEN cjk AND ja THEN 'ja' WHEN cjk AND han >= 10 THEN 'zh' END AS lang,
        CASE WHEN NOT none AND cjk AND NOT ja AND han >= 10 THEN 'detected_without_kana' END AS note,
        CASE WHEN NOT none AND ((cjk AND NOT ja AND han < 10) OR (NOT cjk AND latin < 20))
             THEN 'source_ambiguous' END AS error_code,
        NOT none AND NOT cjk AND latin >= 20 AS latin_open FROM ruled)"""


def _open_segments(spark, sf):
    from lingualoom.functions import protect as P

    segments = S.scan_segments(D.corpus(spark, sf))
    return segments.withColumn("line", P.outside_spans(F.col("line")))


@query(
    "detect_sample",
    _SAMPLE_SQL + " SELECT doc_id, seg_no, start, length(chunk)::INTEGER AS n, md5(chunk) AS h FROM chunks",
)
def detect_sample(spark, sf):
    return detect.detect_sample(_open_segments(spark, sf)).select(
        "doc_id", "seg_no", "start", F.length("chunk").alias("n"), F.md5("chunk").alias("h")
    )


@query("script_histogram", _SAMPLE_SQL + " SELECT doc_id, kana, han, latin FROM hist")
def script_histogram(spark, sf):
    return detect.script_histogram(detect.detect_sample(_open_segments(spark, sf)))


@query("detect_rule", _SAMPLE_SQL + " SELECT * FROM rule")
def detect_rule(spark, sf):
    return detect.detect_rule(
        detect.script_histogram(detect.detect_sample(_open_segments(spark, sf)))
    )


def _slots_sql(chars: str) -> str:
    """The slots of the trigrams of a list of characters."""
    return f"""list_transform(range(1, len({chars}) - 1),
          lambda i: (unicode({chars}[i]) * 961 + unicode({chars}[i + 1]) * 31 + unicode({chars}[i + 2])) % {detect.SLOTS})"""


def _profile_sql(some: str) -> str:
    """CTEs that end in ``prof``, learned from the documents that ``some`` admits."""
    return f"""
    tg AS (SELECT lang, string_split(lower(text), '') AS c FROM documents{some}),
    top AS (SELECT lang, slot, count(*) AS n FROM (SELECT lang, unnest({_slots_sql('c')}) AS slot FROM tg) GROUP BY ALL HAVING count(*) >= {detect.LEAST_COUNT}),
    tot AS (SELECT lang, sum(n)::BIGINT AS total FROM top GROUP BY lang),
    grams AS (SELECT DISTINCT slot FROM top),
    prof AS (SELECT slot, tot.lang, CAST(CASE WHEN top.n IS NULL THEN round(ln(0.5::DOUBLE / total) * 1000)
             ELSE round(ln(top.n::DOUBLE / total) * 1000) END AS INTEGER) AS w
             FROM grams CROSS JOIN tot LEFT JOIN top USING (slot, lang))"""


# By order of MD5, as many as ``detect_source`` and ``detect_accuracy`` learn from.
_PROFILE_SQL = _profile_sql(f"""
           WHERE md5(text) <= (SELECT max(h) FROM (SELECT md5(text) AS h FROM documents ORDER BY h LIMIT {detect.PROFILE_ROWS}))""")


def _score_sql(samples: str, keys: str) -> str:
    """CTEs ``scored``/``conf`` over a relation with keys and column ``sample``."""
    return f"""
    sg AS (SELECT {keys}, unnest({_slots_sql('c')}) AS slot
        FROM (SELECT {keys}, string_split(lower(sample), '') AS c FROM {samples})),
    scored AS (SELECT {keys}, lang AS cand, sum(w)::BIGINT AS s FROM sg JOIN prof USING (slot) GROUP BY ALL),
    ranked AS (SELECT *, max(s) OVER (PARTITION BY {keys}) AS b FROM scored),
    conf AS (SELECT {keys}, min(cand) FILTER (s = b) AS best,
        round(1 / sum(exp((s - b) / 1000.0::DOUBLE) ORDER BY cand), 6) AS confidence FROM ranked GROUP BY ALL)"""


def _profile(spark, sf, rows=None):
    docs = D.table(spark, sf, "documents")
    return stage(detect.latin_profile(docs, "lang", "text", LATIN_LANGUAGES, rows=rows), "profile")


@query(
    "latin_profile",
    "WITH " + _profile_sql("").lstrip() + "," + _score_sql("(SELECT doc_id, left(text, 20000) AS sample FROM documents)", "doc_id")
    + " SELECT doc_id, best, confidence, confidence >= 0.7 AS sure FROM conf",
)
def latin_profile(spark, sf):
    docs = D.table(spark, sf, "documents").select("doc_id", F.left("text", F.lit(20000)).alias("sample"))
    return detect.latin_confidence(
        docs, ["doc_id"], "sample", _profile(spark, sf), LATIN_LANGUAGES
    ).withColumn("sure", F.col("confidence") >= detect.MIN_CONFIDENCE)


@query(
    "detect_source",
    _SAMPLE_SQL + "," + _PROFILE_SQL + """,
    smp AS (SELECT doc_id, left(string_agg(line, chr(10) ORDER BY seg_no), 20000) AS sample FROM open
            JOIN rule USING (doc_id) WHERE latin_open GROUP BY doc_id),""" + _score_sql("smp", "doc_id") + """
    SELECT doc_id, CASE WHEN latin_open AND confidence >= 0.7 THEN best ELSE lang END AS lang,
      CASE WHEN latin_open THEN confidence END AS confidence, note,
      CASE WHEN latin_open AND NOT COALESCE(confidence >= 0.7, false) THEN 'source_ambiguous' ELSE error_code END AS error_code
    FROM rule LEFT JOIN conf USING (doc_id)""",
)
def detect_source(spark, sf):
    return detect.detect_source(D.corpus(spark, sf), _profile(spark, sf, detect.PROFILE_ROWS), LATIN_LANGUAGES)


@query(
    "detect_accuracy",
    f"""WITH {D.CORPUS_SQL}, lines AS ({D.sql_lines('corpus', 'lang')}),
    nb AS (SELECT doc_id, lang AS expected, line AS s, row_number() OVER (PARTITION BY doc_id ORDER BY seg_no) - 1 AS n,
           count(*) OVER (PARTITION BY doc_id) AS total FROM lines WHERE NOT {D.sql_blank('line')}),
    samples AS (
      SELECT 'sentence' AS kind, expected, doc_id, n, s AS sample FROM nb
      UNION ALL SELECT 'short', expected, doc_id, n, CASE WHEN expected IN ('zh','ja') THEN left(s, 12)
        ELSE array_to_string(string_split_regex({D.sql_strip('s')}, '[{C.WS}]+')[1:3], ' ') END FROM nb
      UNION ALL SELECT 'ja_without_kana', expected, doc_id, n, b FROM (
        SELECT *, {D.sql_strip(f"regexp_replace(s, '[{C.KANA}]+', '', 'g')")} AS b FROM nb)
        WHERE expected = 'ja' AND length(b) >= 4
      UNION ALL SELECT 'document', expected, doc_id, n // 5, string_agg(s, ' ' ORDER BY n) FROM nb
        WHERE (n // 5) * 5 < total - 5 GROUP BY expected, doc_id, n // 5),
    counted AS (SELECT *, {_count('sample', C.KANA)} AS kana, {_count('sample', C.HAN)} AS han,
        {_count('sample', C.LATIN)} AS latin FROM samples),
    ruled AS (SELECT kind, expected, doc_id, n, sample,
        CASE WHEN kana + han >= latin AND kana > 0 THEN 'ja' WHEN kana + han >= latin AND han > 0 THEN 'zh' END AS script,
        NOT (kana + han >= latin AND kana + han > 0) AND latin > 0 AS latin_open FROM counted),
    {_PROFILE_SQL}, {_score_sql('(SELECT * FROM ruled WHERE latin_open)', 'kind, expected, doc_id, n')}
    SELECT kind, expected, COALESCE(script, best) AS got, count(*) AS samples
    FROM ruled LEFT JOIN conf USING (kind, expected, doc_id, n) GROUP BY ALL""",
)
def detect_accuracy(spark, sf):
    samples = detect.accuracy_samples(D.corpus(spark, sf))
    return detect.detect_accuracy(samples, _profile(spark, sf, detect.PROFILE_ROWS), LATIN_LANGUAGES)


# ---- parallel data -------------------------------------------------------------------------------


@query(
    "scan_parallel_jsonl",
    """WITH r AS (SELECT source AS dataset, CASE WHEN n_chars < 130 THEN 'dup' ELSE 'd' || doc_id END AS id, lang,
        text FROM documents),
    bad AS (SELECT dataset FROM r GROUP BY dataset, id HAVING count(*) > 1)
    SELECT dataset, id, text AS source, upper(text) AS reference FROM r
    WHERE lang = 'fr' AND dataset NOT IN (SELECT dataset FROM bad)""",
)
def scan_parallel_jsonl(spark, sf):
    key = F.when(F.col("n_chars") < 130, F.lit("dup")).otherwise(
        F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    )
    lines = D.table(spark, sf, "documents").select(
        F.col("source").alias("dataset"),
        F.explode(
            F.array(
                F.to_json(
                    F.struct(
                        key.alias("id"), F.col("lang").alias("source_lang"),
                        F.lit("en").alias("target_lang"), F.col("text").alias("source"),
                        F.upper("text").alias("reference"),
                    )
                ),
                F.lit("  "),
            )
        ).alias("value"),
    )
    return par.scan_parallel(par.parse_parallel(lines), "fr", "en")


@query(
    "scan_aligned_corpus",
    """WITH a AS (SELECT conv_id % 50 AS dataset, conv_id * 1000 + turn AS id, text AS source FROM conversations WHERE role <> 'assistant'),
    b AS (SELECT conv_id % 50 AS dataset, conv_id * 1000 + turn - 1 AS id, text AS reference FROM conversations WHERE role = 'assistant'),
    p AS (SELECT * FROM a FULL JOIN b USING (dataset, id))
    SELECT dataset, id, CAST(id AS VARCHAR) AS id_text, source, reference,
      count(*) FILTER (source IS NULL OR reference IS NULL) OVER (PARTITION BY dataset) = 0 AS sound FROM p""",
)
def scan_aligned_corpus(spark, sf):
    rows = D.table(spark, sf, "conversations").withColumn("dataset", F.col("conv_id") % 50)
    asked = rows.filter("role <> 'assistant'").select(
        "dataset", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"
    )
    replied = rows.filter("role = 'assistant'").select(
        "dataset", (F.col("conv_id") * 1000 + F.col("turn") - 1).alias("id"), "text"
    )
    return par.aligned_pairs(asked, replied).withColumn("id_text", F.col("id").cast("string"))


@query(
    "dataset_spec",
    f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'flores_plus' WHEN 1 THEN 'domain:set-' || doc_id || '.jsonl' END AS name,
      CASE doc_id % 4 WHEN 0 THEN '{par.PINNED_REVISION}' WHEN 1 THEN 'sha256:' || sha256(text) END AS revision,
      CASE doc_id % 4 WHEN 2 THEN 'dataset_not_found' WHEN 3 THEN 'unknown_dataset' END AS error_code
    FROM documents""",
)
def dataset_spec(spark, sf):
    kind = F.col("doc_id") % 4
    path = F.concat(F.lit("domain:/data/set-"), F.col("doc_id").cast("string"), F.lit(".jsonl"))
    specs = D.table(spark, sf, "documents").select(
        "doc_id",
        F.when(kind == 0, F.lit("flores")).when(kind == 3, F.lit("other")).otherwise(path).alias("spec"),
        F.when(kind != 2, F.encode("text", "UTF-8")).alias("content"),
    )
    return par.dataset_spec(specs, "spec", "content").select("doc_id", "name", "revision", "error_code")


@query(
    "all_directions",
    """WITH l AS (SELECT DISTINCT lang, CASE lang WHEN 'en' THEN 2 WHEN 'es' THEN 4 ELSE 5 END AS r FROM documents)
    SELECT a.lang AS source, b.lang AS target, a.lang || '-' || b.lang AS direction,
      CAST(row_number() OVER (ORDER BY a.r, a.lang, b.r, b.lang) AS INTEGER) AS position
    FROM l a JOIN l b ON a.lang <> b.lang""",
)
def all_directions(spark, sf):
    langs = D.table(spark, sf, "documents").select("lang").distinct()
    return evaluate.all_directions(langs, "lang", ["zh", "en", "ja", "es"])


@query(
    "parse_direction",
    """WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang || '-en' WHEN 1 THEN 'zh-' || lang
        WHEN 2 THEN lang || '-xx' ELSE ' en-' || lang || ' ' END AS t FROM documents),
    p AS (SELECT doc_id, split_part(trim(t), '-', 1) AS s, split_part(trim(t), '-', 2) AS g FROM d),
    e AS (SELECT *, CASE WHEN s NOT IN ('zh','en','ja','es') OR g NOT IN ('zh','en','ja','es') THEN 'not_a_direction'
        WHEN s = g THEN 'same_language' END AS error_code FROM p)
    SELECT doc_id, CASE WHEN error_code IS NULL THEN s END AS source,
      CASE WHEN error_code IS NULL THEN g END AS target, error_code FROM e""",
)
def parse_direction(spark, sf):
    kind = F.col("doc_id") % 4
    text = (
        F.when(kind == 0, F.concat("lang", F.lit("-en")))
        .when(kind == 1, F.concat(F.lit("zh-"), "lang"))
        .when(kind == 2, F.concat("lang", F.lit("-xx")))
        .otherwise(F.concat(F.lit(" en-"), "lang", F.lit(" ")))
    )
    known = F.array(*[F.lit(c) for c in ("zh", "en", "ja", "es")])
    return D.table(spark, sf, "documents").select(
        "doc_id", evaluate.parse_direction(text, known).alias("d")
    ).select("doc_id", "d.*")


@query(
    "prefix_limit",
    """SELECT lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents)
    WHERE rn <= 50""",
)
def prefix_limit(spark, sf):
    docs = D.table(spark, sf, "documents").select("lang", "doc_id", "n_chars")
    return evaluate.prefix_limit(docs, ["lang"], ["doc_id"], 50)


# ---- runs ----------------------------------------------------------------------------------------

_STATUS = {"click": "complete", "view": "translated", "error": "failed", "signup": "running",
           "purchase": "complete"}
_STATUS_SQL = "CASE event_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items()
) + " END"


def _status():
    return F.create_map(*[F.lit(x) for kv in _STATUS.items() for x in kv])[F.col("event_type")]


@query(
    "run_status_gate",
    f"""SELECT event_id, status, status = 'complete' AS comparable FROM
    (SELECT event_id, {_STATUS_SQL} AS status FROM events) WHERE status IN ('translated', 'complete')""",
)
def run_status_gate(spark, sf):
    runs = D.table(spark, sf, "events").select("event_id", _status().alias("status"))
    return evaluate.status_gate(runs, evaluate.SCORABLE).withColumn(
        "comparable", F.col("status").isin(*evaluate.COMPARABLE)
    )


@query(
    "run_id",
    """SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') || '-' || event_type || '-' || COALESCE(NULLIF(trim(
      regexp_replace(CASE WHEN event_id % 3 = 0 THEN '***' ELSE props END, '[^A-Za-z0-9._-]+', '-', 'g'), '-'), ''), 'model') AS run_id
    FROM events""",
)
def run_id(spark, sf):
    from lingualoom.functions import text as X

    model = F.when(F.col("event_id") % 3 == 0, F.lit("***")).otherwise(F.col("props"))
    return D.table(spark, sf, "events").select(
        "event_id", X.run_id(F.col("ts"), F.col("event_type"), model).alias("run_id")
    )


def _runs(spark, sf):
    """Manifests (one run per hour of day) and segment scores derived from the event stream."""
    events = D.table(spark, sf, "events").withColumn(
        "run_id", F.concat(F.lit("run-"), F.hour("ts").cast("string"))
    )
    manifests = events.groupBy("run_id").agg(
        F.max("ts").alias("created_at"),
        F.max_by(_status(), F.struct("ts", "event_id")).alias("status"),
        F.max_by((F.col("user_id") % 3 == 0), F.struct("ts", "event_id")).alias("git_dirty"),
        F.max_by(F.when(F.col("user_id") % 4 == 1, F.col("user_id")), F.struct("ts", "event_id")).alias("limit"),
        F.when(F.substring("run_id", -1, 1).isin("1", "3", "5", "7", "9"), F.lit("mt"))
        .otherwise(F.lit("llm")).alias("mode"),
    )
    scores = events.select(
        "run_id", F.col("event_type").alias("direction"), F.col("event_id").alias("id"),
        F.col("value").alias("comet"),
    )
    return manifests, scores


_RUNS_SQL = f"""ev AS (SELECT *, 'run-' || hour(ts) AS run_id, {_STATUS_SQL} AS st FROM events),
    man AS (SELECT run_id, max(ts) AS created_at, arg_max(st, (ts, event_id)) AS status,
      arg_max(user_id % 3 = 0, (ts, event_id)) AS git_dirty,
      arg_max(user_id, (ts, event_id)) AS last_user,
      CASE WHEN right(run_id, 1) IN ('1','3','5','7','9') THEN 'mt' ELSE 'llm' END AS mode FROM ev GROUP BY run_id)"""


@query(
    "read_run",
    f"""WITH {_RUNS_SQL} SELECT ev.run_id, event_type AS direction, event_id AS id, value AS comet
    FROM ev JOIN man USING (run_id) WHERE status = 'complete'""",
)
def read_run(spark, sf):
    manifests, scores = _runs(spark, sf)
    root = fresh_path(spark, "runs")
    sinks.write_run({"manifest": manifests, "segment_scores": scores}, root)
    return sinks.read_run(spark, root, evaluate.COMPARABLE).select("run_id", "direction", "id", "comet")


@query(
    "write_run",
    f"""WITH {_RUNS_SQL} SELECT ev.run_id, event_type AS direction, count(*) AS n, min(event_id) AS first_id, max(value) AS best
    FROM ev GROUP BY ALL""",
)
def write_run(spark, sf):
    manifests, scores = _runs(spark, sf)
    root = fresh_path(spark, "runs")
    sinks.write_run({"manifest": manifests, "segment_scores": scores}, root)
    return spark.read.parquet(f"{root}/segment_scores").groupBy("run_id", "direction").agg(
        F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("comet").alias("best")
    )


@query(
    "set_baseline",
    f"""WITH {_RUNS_SQL}, best AS (SELECT mode, arg_max(run_id, (created_at, run_id)) AS run_id FROM man
      WHERE status = 'complete' AND NOT git_dirty AND last_user % 4 <> 1 GROUP BY mode)
    SELECT mode, ev.run_id, event_type AS direction, event_id AS id, value AS comet FROM ev JOIN best USING (run_id)""",
)
def set_baseline(spark, sf):
    manifests, scores = _runs(spark, sf)
    root = fresh_path(spark, "baselines")
    rows = sinks.baseline_rows(manifests, scores)
    sinks.set_baseline(rows, root)
    sinks.set_baseline(rows, root)  # replacing is idempotent
    return spark.read.schema(rows.schema).parquet(root)


@query(
    "read_baseline",
    f"""WITH {_RUNS_SQL}, best AS (SELECT mode, arg_max(run_id, (created_at, run_id)) AS run_id FROM man
      WHERE status = 'complete' AND NOT git_dirty AND last_user % 4 <> 1 AND mode = 'llm' GROUP BY mode)
    SELECT event_type AS direction, event_id AS id, value AS score FROM ev JOIN best USING (run_id)""",
)
def read_baseline(spark, sf):
    root = fresh_path(spark, "baselines")
    sinks.set_baseline(sinks.baseline_rows(*_runs(spark, sf)), root)
    return sinks.read_baseline(spark, root, "llm")


@query(
    "write_no_overwrite",
    "SELECT count(*) AS written, true AS refused, count(*) AS still_there FROM documents",
)
def write_no_overwrite(spark, sf):
    docs = D.table(spark, sf, "documents").select("doc_id", "text")
    path = fresh_path(spark, "out")
    sinks.write_new(docs, path)
    try:
        sinks.write_new(docs.select("doc_id"), path)
        refused = False
    except sinks.OutputExists:
        refused = True
    return spark.read.schema(docs.schema).parquet(path).agg(
        F.count("text").alias("written"), F.lit(refused).alias("refused"),
        F.count("*").alias("still_there"),
    )


@query(
    "verify_written",
    """SELECT count(*) AS written, 0::BIGINT AS missing, 0::BIGINT AS unexpected, 0::BIGINT AS changed
    FROM documents""",
)
def verify_written(spark, sf):
    docs = D.table(spark, sf, "documents").select("doc_id", "lang", "text")
    path = fresh_path(spark, "out")
    sinks.write_new(docs, path)
    return sinks.verify_written(docs, path, ["doc_id"])


# ---- scores --------------------------------------------------------------------------------------

_HYP_SQL = "replace(replace(lower(line), 'th', 'z'), 'ein ', 'eine ')"
_PAIR_SQL = f"""WITH lines AS ({D.sql_lines('documents', 'lang')}),
    pairs AS (SELECT lang || '-en' AS direction, doc_id, seg_no, {_HYP_SQL} AS hyp, line AS ref FROM lines WHERE NOT {D.sql_blank('line')}),
    bare AS (SELECT direction, doc_id, seg_no, regexp_replace(hyp, '[{C.WS}]+', '', 'g') AS h,
             regexp_replace(ref, '[{C.WS}]+', '', 'g') AS r FROM pairs),
    orders AS (SELECT unnest(range(1, 7)) AS n),
    hg AS (SELECT doc_id, seg_no, n, h[i:i+n-1] AS g, count(*) AS c FROM (
        SELECT doc_id, seg_no, n, h, unnest(range(1, length(h) - n + 2)) AS i FROM bare, orders) GROUP BY ALL),
    rg AS (SELECT doc_id, seg_no, n, r[i:i+n-1] AS g, count(*) AS c FROM (
        SELECT doc_id, seg_no, n, r, unnest(range(1, length(r) - n + 2)) AS i FROM bare, orders) GROUP BY ALL),
    m AS (SELECT doc_id, seg_no, n, sum(least(COALESCE(hg.c, 0), COALESCE(rg.c, 0)))::BIGINT AS hit,
        sum(COALESCE(hg.c, 0))::BIGINT AS nh, sum(COALESCE(rg.c, 0))::BIGINT AS nr
        FROM hg FULL JOIN rg USING (doc_id, seg_no, n, g) GROUP BY ALL),
    stat AS (SELECT direction, doc_id, seg_no, n, hit, CASE WHEN nr > 0 THEN nh ELSE 0 END AS nh, nr
        FROM m JOIN bare USING (doc_id, seg_no))"""


def _chrf_sql(keys: str, digits: int) -> str:
    return f"""
    per AS (SELECT {keys}, n, sum(hit)::BIGINT AS hit, sum(nh)::BIGINT AS nh, sum(nr)::BIGINT AS nr FROM stat GROUP BY ALL),
    pr AS (SELECT {keys}, sum(hit / nh ORDER BY n) FILTER (nh > 0 AND nr > 0) / count(*) FILTER (nh > 0 AND nr > 0) AS p,
        sum(hit / nr ORDER BY n) FILTER (nh > 0 AND nr > 0) / count(*) FILTER (nh > 0 AND nr > 0) AS r FROM per GROUP BY {keys}),
    score AS (SELECT {keys}, round(CASE WHEN p + r > 0 THEN 5 * p * r / (4 * p + r) * 100 ELSE 0.0::DOUBLE END, {digits}) AS chrf FROM pr)"""


def _pairs(spark, sf):
    lines = S.scan_segments(D.table(spark, sf, "documents"), keep=("lang",))
    hyp = F.replace(
        F.replace(F.lower("line"), F.lit("th"), F.lit("z")), F.lit("ein "), F.lit("eine ")
    )
    return lines.select(
        F.concat("lang", F.lit("-en")).alias("direction"), "doc_id", "seg_no", hyp.alias("hyp"),
        F.col("line").alias("ref"),
    )


@query(
    "chrf_corpus",
    _PAIR_SQL + "," + _chrf_sql("direction", 4)
    + " SELECT direction, (SELECT count(*) FROM pairs p WHERE p.direction = score.direction) AS n, chrf FROM score",
)
def chrf_corpus(spark, sf):
    return evaluate.chrf_corpus(_pairs(spark, sf), "hyp", "ref", ["direction"])


@query(
    "chrf_sentence",
    _PAIR_SQL + "," + _chrf_sql("doc_id, seg_no", 1) + " SELECT doc_id, seg_no, chrf FROM score",
)
def chrf_sentence(spark, sf):
    return evaluate.chrf_sentence(_pairs(spark, sf), "hyp", "ref").select("doc_id", "seg_no", "chrf")


def _scored(spark, sf):
    """direction, id, n_chars and the scores of two runs for every document."""
    docs = D.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    a = (F.col("n_chars") % 100) / F.lit(100.0)
    step = (
        F.when(F.col("lang") == "en", -(F.col("doc_id") % 3))
        .when(F.col("lang") == "fr", F.col("doc_id") % 3)
        .otherwise(F.col("doc_id") % 5 - 2)
    )
    direction = F.when(F.col("lang") == "en", F.lit("zh-en")).otherwise(
        F.concat("lang", F.lit("-en"))
    )
    return docs.select(
        direction.alias("direction"), F.col("doc_id").alias("id"), "n_chars", a.alias("a"),
        (a + step / F.lit(100.0)).alias("b"),
    )


def _scores(spark, sf):
    """Two runs: each scored only documents within its own length limits, so that either lacks some ids."""
    rows = _scored(spark, sf)
    run_a = rows.filter("n_chars > 120").select("direction", "id", F.col("a").alias("score"))
    run_b = rows.filter("n_chars < 20000").select("direction", "id", F.col("b").alias("score"))
    return run_a, run_b


_SCORES_SQL = """sc AS (SELECT CASE lang WHEN 'en' THEN 'zh-en' ELSE lang || '-en' END AS direction, doc_id AS id, n_chars,
      (n_chars % 100) / 100.0::DOUBLE AS a, (n_chars % 100) / 100.0::DOUBLE + (CASE lang WHEN 'en' THEN -(doc_id % 3)
      WHEN 'fr' THEN doc_id % 3 ELSE doc_id % 5 - 2 END) / 100.0::DOUBLE AS b FROM documents),
    ra AS (SELECT direction, id, a FROM sc WHERE n_chars > 120),
    rb AS (SELECT direction, id, b FROM sc WHERE n_chars < 20000),
    pr AS (SELECT * FROM ra FULL JOIN rb USING (direction, id))"""
_DELTA_SQL = """pd AS (SELECT direction, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n,
      count(*) FILTER (b IS NULL) AS only_in_a, count(*) FILTER (a IS NULL) AS only_in_b,
      round(avg(a) FILTER (b IS NOT NULL), 9) AS comet_a, round(avg(b) FILTER (a IS NOT NULL), 9) AS comet_b,
      round(avg(b - a), 9) AS delta_comet FROM pr GROUP BY direction)"""
_BOOT_SQL = f"""sh AS (SELECT direction, id, b - a AS delta FROM pr WHERE a IS NOT NULL AND b IS NOT NULL),
    hx AS (SELECT direction, delta, k, sha256('0|' || id || '|' || k) AS h FROM sh, (SELECT unnest(range(63)) AS k)),
    nm AS (SELECT direction, delta, 16 * k + i AS r, ('0x' || substr(h, (4 * i + 1)::INT, 4))::BIGINT AS u
      FROM hx, (SELECT unnest(range(16)) AS i) WHERE 16 * k + i < 1000),
    dr AS (SELECT direction, delta, r, {" + ".join(f"(u >= {limit})::INT" for limit in cmp.draw_limits())} AS c FROM nm),
    ms AS (SELECT direction, r, CASE WHEN sum(c) > 0 THEN sum(c * delta) / sum(c) ELSE avg(delta) END AS mean FROM dr GROUP BY ALL),
    ci AS (SELECT direction, round(list_sort(list(mean))[26], 9) AS ci_low, round(list_sort(list(mean))[976], 9) AS ci_high
      FROM ms GROUP BY direction),
    vd AS (SELECT *, CASE WHEN ci_low > 0 THEN 'better' WHEN ci_high < 0 THEN 'worse'
      ELSE 'no significant difference' END AS verdict FROM ci)"""


@query(
    "direction_scores",
    f"""WITH {_SCORES_SQL} SELECT direction, count(a) AS n, round(COALESCE(avg(a), 0), 6) AS comet FROM sc GROUP BY direction""",
)
def direction_scores(spark, sf):
    return evaluate.direction_scores(_scored(spark, sf).withColumnRenamed("a", "score"), ["direction"], "score")


@query(
    "attach_scores",
    f"""WITH {_SCORES_SQL}, rows AS (SELECT CASE lang WHEN 'en' THEN 'zh-en' ELSE lang || '-en' END AS direction,
      doc_id AS id, md5(text) AS h FROM documents)
    SELECT direction, id, h, a AS score FROM rows LEFT JOIN ra USING (direction, id)""",
)
def attach_scores(spark, sf):
    rows = D.table(spark, sf, "documents").select(
        F.when(F.col("lang") == "en", F.lit("zh-en")).otherwise(F.concat("lang", F.lit("-en"))).alias("direction"),
        F.col("doc_id").alias("id"), F.md5("text").alias("h"),
    )
    return evaluate.attach_scores(rows, _scores(spark, sf)[0], ["direction", "id"])


@query(
    "direction_timing",
    """SELECT event_type AS direction, round(sum(value) / 1000, 3) AS seconds, count(*) AS segments,
      round(CASE WHEN round(sum(value) / 1000, 3) > 0 THEN count(*) / round(sum(value) / 1000, 3) ELSE 0 END, 3) AS segments_per_second
    FROM events GROUP BY event_type""",
)
def direction_timing(spark, sf):
    batches = D.table(spark, sf, "events").select(
        F.col("event_type").alias("direction"), (F.col("value") / 1000).alias("seconds"),
        F.lit(1).alias("segments"),
    )
    return evaluate.direction_timing(batches, ["direction"])


@query(
    "run_summary",
    """WITH s AS (SELECT lang AS direction, count(*) AS n, avg((n_chars % 100) / 100.0::DOUBLE) AS comet,
        avg(n_chars % 97) AS chrf FROM documents GROUP BY lang),
    t AS (SELECT CASE event_type WHEN 'click' THEN 'en' WHEN 'view' THEN 'fr' ELSE 'es' END AS direction,
      avg(user_id) AS sp, max(user_id) * 1.5::DOUBLE AS mem FROM events GROUP BY 1)
    SELECT direction, n, printf('%.4f', comet) AS comet, printf('%.2f', chrf) AS chrf,
      COALESCE(printf('%.2f', sp), '-') AS speed, COALESCE(printf('%.0f', mem + 0.2::DOUBLE), '-') AS memory FROM s LEFT JOIN t USING (direction)""",
)
def run_summary(spark, sf):
    scores = D.table(spark, sf, "documents").groupBy(F.col("lang").alias("direction")).agg(
        F.count("*").alias("n"), F.avg((F.col("n_chars") % 100) / 100.0).alias("comet"),
        F.avg(F.col("n_chars") % 97).alias("chrf"),
    )
    direction = F.when(F.col("event_type") == "click", F.lit("en")).when(
        F.col("event_type") == "view", F.lit("fr")
    ).otherwise(F.lit("es"))
    timings = (
        D.table(spark, sf, "events").withColumn("direction", direction)
        .groupBy("direction")
        .agg(F.avg("user_id").alias("segments_per_second"), (F.max("user_id") * 1.5 + 0.2).alias("peak_rss_mb"))
    )
    return evaluate.run_summary(scores, timings, ["direction"])


@query(
    "repeat_summary",
    """SELECT event_type AS direction, user_id % 3 AS concurrency, count(*) AS n, round(median(value), 4) AS median_speed,
      round(median(event_id % 1000 / 10.0::DOUBLE), 4) AS median_chrf, min(value) AS min_speed, max(value) AS max_speed
    FROM events GROUP BY ALL""",
)
def repeat_summary(spark, sf):
    runs = D.table(spark, sf, "events").select(
        F.col("event_type").alias("direction"), (F.col("user_id") % 3).alias("concurrency"),
        F.col("value").alias("speed"), (F.col("event_id") % 1000 / 10.0).alias("chrf"),
    )
    return report.repeat_summary(runs, ["direction", "concurrency"])


# ---- comparison ----------------------------------------------------------------------------------


@query("paired_delta", f"WITH {_SCORES_SQL}, {_DELTA_SQL} SELECT *, CASE WHEN n = 0 THEN CASE WHEN only_in_a = 0 OR only_in_b = 0 THEN 'missing_direction' ELSE 'no_shared_ids' END END AS error_code FROM pd")
def paired_delta(spark, sf):
    return cmp.paired_delta(cmp.paired(*_scores(spark, sf)))


@query(
    "shared_directions",
    """WITH a AS (SELECT DISTINCT lang || '-en' AS direction FROM documents WHERE lang <> 'fr'),
    b AS (SELECT DISTINCT lang || '-en' AS direction FROM documents WHERE lang <> 'es')
    SELECT direction, true AS shared FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
    UNION ALL SELECT direction, false FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a))""",
)
def shared_directions(spark, sf):
    rows = D.table(spark, sf, "documents").select("lang", F.concat("lang", F.lit("-en")).alias("direction"))
    return cmp.shared_directions(rows.filter("lang <> 'fr'"), rows.filter("lang <> 'es'"))


def _intervals(spark, sf):
    pairs = cmp.paired(*_scores(spark, sf))
    return cmp.bootstrap_ci(cmp.bootstrap_means(pairs))


@query("bootstrap_ci", f"WITH {_SCORES_SQL}, {_BOOT_SQL} SELECT * FROM ci")
def bootstrap_ci(spark, sf):
    return _intervals(spark, sf)


# Both runs with the scores of every document.
_ALL_SCORES_SQL = _SCORES_SQL.replace(" WHERE n_chars > 120", "").replace(" WHERE n_chars < 20000", "")


@query("verdict", f"WITH {_ALL_SCORES_SQL}, {_BOOT_SQL} SELECT * FROM vd")
def verdict(spark, sf):
    rows = _scored(spark, sf)
    pairs = cmp.paired(*(rows.select("direction", "id", F.col(run).alias("score")) for run in ("a", "b")))
    return cmp.verdict(cmp.bootstrap_ci(cmp.bootstrap_means(pairs)))


@query(
    "regression_gate",
    f"WITH {_SCORES_SQL}, {_BOOT_SQL} SELECT bool_or(direction = 'zh-en' AND verdict = 'worse') AS regression FROM vd",
)
def regression_gate(spark, sf):
    return cmp.regression_gate(cmp.verdict(_intervals(spark, sf)))


@query(
    "compare_runs",
    f"""WITH {_SCORES_SQL}, {_DELTA_SQL}, {_BOOT_SQL},
    ca AS (SELECT direction, avg(n_chars % 50) AS c FROM sc GROUP BY 1),
    cb AS (SELECT direction, avg(n_chars % 60) AS c FROM sc GROUP BY 1)
    SELECT pd.*, CASE WHEN n = 0 THEN CASE WHEN only_in_a = 0 OR only_in_b = 0 THEN 'missing_direction' ELSE 'no_shared_ids' END END AS error_code, ci_low, ci_high, verdict, round(cb.c - ca.c, 4) AS delta_chrf
    FROM pd LEFT JOIN vd USING (direction) LEFT JOIN ca USING (direction) LEFT JOIN cb USING (direction)""",
)
def compare_runs(spark, sf):
    docs = D.table(spark, sf, "documents").withColumn(
        "direction", F.when(F.col("lang") == "en", F.lit("zh-en")).otherwise(F.concat("lang", F.lit("-en")))
    )
    chrf_a = docs.groupBy("direction").agg(F.avg(F.col("n_chars") % 50).alias("chrf"))
    chrf_b = docs.groupBy("direction").agg(F.avg(F.col("n_chars") % 60).alias("chrf"))
    return cmp.compare_runs(*_scores(spark, sf), chrf_a, chrf_b)
