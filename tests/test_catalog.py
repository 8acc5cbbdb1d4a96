"""The driver contract, and some registered queries against their SQL on the smallest data."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare

DATA = "/root/testdata/sf0.001"
CHECKED = (
    "translate_corpus", "reassemble_txt", "encode_tags", "validate_tags", "chrf_corpus", "detect_source",
    "merge_range_lookup", "bootstrap_ci", "set_digest", "scan_xlsx", "tm_upsert", "capped_diagnostics",
)


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 90


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test data")
def test_entry_has_one_row_per_document(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["doc_id", "segments", "passed_through", "unique_inputs", "output_chars"]
    assert rows.count() == 200


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test data")
@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_its_sql(spark, name):
    status, _, _, note = compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], DATA)
    assert status == "OK", note
