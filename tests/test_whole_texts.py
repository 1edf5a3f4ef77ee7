"""The cascade and the routes over all of their texts and rows."""

import os

import pytest

from siltstone.operators import lookup


def test_words_at_the_end_of_a_long_text_count(spark):
    """Bodies were scored by their first 8000 characters."""
    long = "filler " * 2000
    records = [(1, "D-1", "one", long + "alpha beta", 0), (2, "D-2", "two", "alpha beta " + long, 0), (3, "D-3", "three", long + "alpha", 0)]
    frame = spark.createDataFrame(records, "id long, doc_identifier string, title string, content string, clearance int")
    found = lookup.cascade(frame, spark.createDataFrame([(0, "alpha beta")], "question long, text string")).collect()
    assert {r.id: (r.overlap, r.score) for r in found} == {1: (4.0, 0.84), 2: (4.0, 0.84), 3: (2.5, 0.66)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_every_record_asks_for_its_route(spark):
    """One of twenty did."""
    from siltstone.plans import record_queries

    sf = "/root/testdata/sf0.001"
    ids = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").where(f"doc_id % 4 <= {record_queries.CLEARANCE}").collect()}
    rows = record_queries.r6_route(spark, sf).collect()
    assert {r.question for r in rows if r.question >= 0} == ids and all(r.id == r.question for r in rows if r.question >= 0)
