"""Registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingualoom.llm import (
    alignment, decontaminate, fingerprints, licenses, mixing, neighbours, pii, quality, simhash, spelling, substrings, toxicity, warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprints.edited_pairs(_table(spark, sf_dir, "documents"))
    return pairs.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_hex(F.col("own")).alias("fingerprint"),
        fingerprints.as_hex(F.col("edited_print")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("own"), F.col("edited_print")).alias("near_edited"),
        fingerprints.likeness(F.col("own"), F.col("next_print")).alias("near_next"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), firsts AS (SELECT h, min(page_id) AS first FROM p GROUP BY h
), coded AS (
  SELECT h, first, array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda b:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 5 * i::INT + 1, 5))::BIGINT >> b) & 31)::INT, 1)), '')), '') AS digest
  FROM firsts
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN coded USING (h)
"""


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    known = F.filter("licenses", lambda r: r["family"] != licenses.UNKNOWN)
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size(known).cast("long").alias("n_known"),
        (F.size("licenses") - F.size(known)).cast("long").alias("n_unknown"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(known, lambda r: r["family"]))), ",").alias("families"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), keep=["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"), "evidence", "site_rate", "p_low", "rejected")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = mixing.mix_counts(_table(spark, sf_dir, "documents"))
    return counted.select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken")
    )


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS s,
         [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT]::BIGINT AS w
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY 3 * s / w, source NULLS LAST) AS k,
         coalesce(sum(3 * s) OVER before, 0) AS capped, coalesce(sum(w) OVER before, 0) AS gone,
         sum(s) OVER () AS total, sum(w) OVER () AS weights
  FROM sums WINDOW before AS (ORDER BY 3 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  -- The first source, from the one that reaches its limit soonest, that stays within it.
  SELECT arg_min((total - capped)::DOUBLE / (weights - gone)::DOUBLE, k) AS l
  FROM ordered WHERE (total - capped)::DOUBLE / (weights - gone)::DOUBLE * w <= 3 * s
), plan AS (
  SELECT source, s, CASE WHEN l IS NULL THEN s::DOUBLE * 3 ELSE least(s::DOUBLE * 3, w::DOUBLE * l) END AS target
  FROM sums, level
), rated AS (
  SELECT doc_id, size, s AS source_size, target, CASE WHEN s > 0 THEN target / s ELSE 0.0 END AS rate,
         ('0x' || substr(md5('mix42:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM sized JOIN plan ON sized.source IS NOT DISTINCT FROM plan.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (size * (floor(rate) + (u < rate - floor(rate))::INT))::BIGINT AS taken
FROM rated
"""


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    found = decontaminate.contamination(docs, benchmark)
    key = decontaminate.text_key(F.col("text"))
    counted = docs.select(
        "doc_id", *key, F.coalesce(F.regexp_count("text", F.lit(decontaminate.WORD)), F.lit(0)).cast("long").alias("n_words")
    )
    return counted.join(found, ["k1", "k2"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), b_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS p FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM b_windows
), d_windows AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, p, n, item_id FROM d_windows JOIN b_windows USING (n, gram)
), places AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places ON places.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_spans(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.concat(*[pii.listed(F.col(f"_{k}"), k) for k in pii.KINDS])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, pii.listed(F.col("_term"), pii.TERM)), ",").alias("spans"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.deduplicated(_table(spark, sf_dir, "documents"), F.sha2("kept", 256))
    return found.withColumnRenamed("kept", "kept_sha256")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS p FROM d WHERE len(w) >= 20)
), later AS (
  SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM windows) WHERE k > 1
), gone AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 19)) AS q FROM later
), cut AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY q) FILTER (WHERE NOT lost) AS kept, count(*) FILTER (WHERE lost) AS n_removed
  FROM (SELECT a.doc_id, a.q, a.word, gone.q IS NOT NULL AS lost
        FROM (SELECT doc_id, unnest(generate_series(1, len(w))) AS q, unnest(w) AS word FROM d) a
        LEFT JOIN gone ON gone.doc_id = a.doc_id AND gone.q = a.q) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id
"""


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(_table(spark, sf_dir, "embeddings"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_texts(_table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("groups", "groups_sha256")


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_warc": op2_warc,
    "op3_licenses": op3_licenses,
    "op4_quality": op4_quality,
    "op5_simhash": op5_simhash,
    "op6_mixing": op6_mixing,
    "op7_decontaminate": op7_decontaminate,
    "op8_pii": op8_pii,
    "op9_toxicity": op9_toxicity,
    "op10_substrings": op10_substrings,
    "op11_neighbours": op11_neighbours,
    "op12_spelling": op12_spelling,
    "op13_alignment": op13_alignment,
}
ORACLE = {"op2_warc": OP2_SQL, "op6_mixing": OP6_SQL, "op7_decontaminate": OP7_SQL, "op10_substrings": OP10_SQL}
