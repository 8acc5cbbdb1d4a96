"""Registered queries: the streaming jobs, run until their input is used up."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from lingualoom.operators import infer
from lingualoom.operators.memory import Memory
from lingualoom.plans import derived as D
from lingualoom.session import fresh_path
from lingualoom.streaming import jobs

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


@query(
    "stream_ingest_units",
    f"""WITH lines AS ({D.sql_lines('documents', 'lang')}),
    segs AS (SELECT *, {D.sql_strip('line')} AS core FROM lines WHERE NOT {D.sql_blank('line')}),
    u AS (SELECT DISTINCT lang, {D.sql_encoded('core')} AS unit_text FROM segs WHERE NOT {D.sql_passes('line', 'lang')})
    SELECT unit_text, {D.sql_marker('unit_text', 'en')} AS output FROM u""",
)
def stream_ingest_units(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    root = fresh_path(spark, "stream")
    # A table is one file or a folder of files; a pattern stands for either.
    docs = jobs.document_stream(spark, f"{sf}/[d]ocuments.parquet", schema)

    def translate(asked):
        return asked.withColumn(
            "output", infer.marker_translate(F.col("unit_text"), F.lit("en"))
        )

    jobs.ingest_units(docs, translate, root, "en", "marker-1").awaitTermination()
    return Memory(spark, f"{root}/memory").rows().select("unit_text", "output")


def _arrivals(spark, sf, root):
    """The events in four files, one micro-batch each, in order of time but for the ids that divide by 7, which come last."""
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    file = F.when(F.col("event_id") % 7 == 0, 3).otherwise(F.pmod(F.col("event_id"), F.lit(3)))
    events.withColumn("file", file).repartition("file").write.partitionBy("file").parquet(f"{root}/in")
    return jobs.document_stream(spark, f"{root}/in/*", events.schema, per_batch=1)


@query("stream_dedup_submissions", "SELECT DISTINCT user_id, props FROM events")
def stream_dedup_submissions(spark, sf):
    root = fresh_path(spark, "stream")
    events = _arrivals(spark, sf, root)
    jobs.dedup_submissions(events, ["user_id", "props"], ["ts", "event_id"], "at", timedelta(days=3650), root).awaitTermination()
    return spark.read.parquet(f"{root}/accepted").select("user_id", "props")


@query(
    "stream_submission_outcomes",
    """SELECT user_id, props, count(*) AS tries, 1::BIGINT AS accepted, min(event_type) <> max(event_type) AS conflict
    FROM events GROUP BY ALL""",
)
def stream_submission_outcomes(spark, sf):
    root = fresh_path(spark, "stream")
    stream = _arrivals(spark, sf, root)
    jobs.submission_outcomes(stream, ["user_id", "props"], "event_type", ["ts", "event_id"], "at", timedelta(days=3650), root).awaitTermination()
    done = spark.read.parquet(f"{root}/outcomes")
    return done.groupBy("user_id", "props").agg(
        F.count("*").alias("tries"), F.count_if(F.col("outcome") == "accepted").alias("accepted"),
        F.bool_or(F.col("outcome") == "conflict").alias("conflict"),
    )
