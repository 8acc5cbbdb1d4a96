"""The whole job: terms, languages that share a text, memory, failures."""

import pytest
from pyspark.sql import functions as F

from lingualoom.plans import job


def engine(asked):
    """Names the language it was asked in; has no answer to what holds a 7."""
    answer = F.concat(F.col("lang"), F.lit(":"), F.col("unit_text"))
    return asked.select("unit_key", F.when(~F.col("unit_text").contains("7"), answer).alias("output"))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "de", "Hallo\nfrag Otto unter https://o.example/x\n12"), (2, "fr", "Hallo\n\nOtto"), (3, "en", "stays"), (4, None, "??"),
        (5, "de", "eins\nzwei 7"),
    ]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string")


def texts(result):
    return {r["doc_id"]: (r["text"], r["error_code"], r["lost"]) for r in result.documents.collect()}


def test_job(spark, docs):
    done = job.translate_documents(docs, engine, "en", "e1", terms=["Otto"])
    assert texts(done) == {
        1: ("de:Hallo\nde:frag Otto unter https://o.example/x\n12", None, 0), 2: ("fr:Hallo\n\nOtto", None, 0), 3: ("stays", None, 0),
        4: ("??", None, 0), 5: (None, "engine_response", 1),
    }
    notes = {r["doc_id"]: r["note"] for r in done.documents.collect()}
    assert notes == {1: None, 2: None, 3: "already_target_language", 4: "no_translatable_text", 5: None}
    counts = {r["doc_id"]: (r["segments"], r["passed_through"], r["unique_inputs"]) for r in done.counts.collect()}
    assert counts == {1: (3, 1, 2), 2: (2, 1, 1), 5: (2, 0, 2)}
    kept = job.translate_documents(docs, engine, "en", "e1", terms=["Otto"], keep_source=True)
    assert texts(kept)[5] == ("de:eins\nzwei 7", None, 1)


def test_memory_is_for_one_engine_and_language(spark, docs):
    first = job.translate_documents(docs, engine, "en", "e1")
    assert {r["lang"] for r in first.memory.filter("unit_text = 'Hallo'").collect()} == {"de", "fr"}
    asked = []

    def watched(rows):
        asked.append(sorted(r["unit_text"] for r in rows.collect()))
        return engine(rows)

    again = job.translate_documents(docs, watched, "en", "e1", memory=first.memory)
    assert texts(again) == texts(first)
    job.translate_documents(docs, watched, "en", "e2", memory=first.memory)
    job.translate_documents(docs, watched, "en", "e1", memory=first.memory, force=True)
    assert asked[0] == ["zwei 7"] and len(asked[1]) == len(asked[2]) > 4
