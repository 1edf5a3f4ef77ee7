"""Queries that work long on each row of a small table deal its rows first: its file may be one row group, read in one task."""

import pytest

from siltstone.plans import text_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["f5_classify", "f21_classified", "s24_table_rows", "s12_csv_sections"])
def test_rows_are_worked_on_in_many_tasks(spark, name):
    assert getattr(text_queries, name)(spark, SF).rdd.getNumPartitions() >= 4


def test_bills_are_dealt(spark):
    assert text_queries._bills(spark, SF).rdd.getNumPartitions() >= 4
