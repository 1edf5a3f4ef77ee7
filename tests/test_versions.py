"""Fingerprints under changes, and slices of a small tree."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators import versions as V

SCHEMA = "id long, `a.b` string, n double"


def rows(frame):
    return sorted(map(tuple, frame.select("bucket", "rows", "print").collect()))


def table(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_a_change_moves_one_bucket_and_is_a_sum(spark):
    data = [(i, f"text {i % 7}", i / 3) for i in range(500)] + [(None, None, None), (3, "text 3", 1.0), (3, "text 3", 1.0)]
    old = V.fingerprint(table(spark, data), "id", 32)
    assert rows(old) == rows(V.fingerprint(table(spark, data[::-1]).repartition(7), "id", 32)) and sum(r[1] for r in rows(old)) == len(data)
    changed = [(77, "other", 1.5), *(r for r in data if r[0] != 77)]
    new = V.fingerprint(table(spark, changed), "id", 32)
    assert V.differing(old, new).count() == 1 and V.differing(old, old).count() == 0
    moved = V.moved(old, V.fingerprint(table(spark, [data[77]]), "id", 32), V.fingerprint(table(spark, changed[:1]), "id", 32))
    assert rows(moved) == rows(new)
    assert rows(V.moved(old, old, V.fingerprint(table(spark, []), "id", 32))) == []


def test_columns_do_not_run_into_each_other(spark):
    make = lambda x, y: rows(V.fingerprint(spark.createDataFrame([(1, x, y)], "id int, x string, y string"), "id"))
    assert len({str(make(*v)) for v in (("ab", "c"), ("a", "bc"), ("", "abc"), (None, "abc"), ("abc", None), ("-", "c"), ("1:c", ""))}) == 7


def test_one_version_for_several_tables(spark):
    a, b = (V.fingerprint(table(spark, [(i, "x", 1.0) for i in range(n)]), "id", 8) for n in (20, 21))
    name = lambda prints: V.content_version(prints).first()[0]
    assert name({"one": a, "two": b}) == name({"two": b, "one": a}) != name({"one": b, "two": a})
    assert len(name({"none": V.fingerprint(table(spark, []), "id")})) == 12


@pytest.mark.parametrize(("focus", "levels", "budget", "expected"), [(None, 0, None, {("a", 0), ("z", 0)}), (None, 1, None, {("a", 0), ("z", 0), ("b", 1)}), ("b", 2, None, {("b", 0), ("c", 1), ("d", 1)}), ("b", 1, 1, {("b", 0), ("c", 1)}), (None, 9, None, {("a", 0), ("z", 0), ("b", 1), ("c", 2), ("d", 2)})])
def test_slices(spark, focus, levels, budget, expected):
    nodes = spark.createDataFrame([(t, t, 0, "p") for t in "abcdhez"], "topic_id string, name string, depth int, package string")
    edges = spark.createDataFrame([("a", None, 1), ("z", None, 1), ("b", "a", 1), ("h", "a", 1), ("c", "b", 1), ("d", "b", 1), ("e", "h", 1), ("d", "z", 0)], "child string, parent string, is_primary int")
    records = spark.createDataFrame([(1, "a", 0), (2, "b", 1), (3, "c", 0), (4, "d", 1), (5, "h", 3), (6, "e", 0), (7, "z", 0)], "id int, topic_id string, clearance int")
    at = None if focus is None else spark.createDataFrame([(focus,)], "topic_id string")
    assert {tuple(r) for r in V.tree_slice(nodes, edges, records, 1, levels, at, budget).collect()} == expected  # h is hidden, and e below it
