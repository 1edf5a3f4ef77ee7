"""Blocks of bridges are read from where they are written, not sent to each other (F1, F2)."""

import os

import pytest
from pyspark.sql import functions as F

from siltstone.operators import bridges


def _topics(spark):
    words = "array('optical', 'power', 'fault', 'board', 'link', 'cell', 'alarm', 'clock')"
    return spark.range(120).select(F.col("id").alias("topic_id"), F.expr("concat('p', id % 3)").alias("package"), F.expr(f"array_join(transform(sequence(0, 5), i -> concat(element_at({words}, CAST(pmod(xxhash64(id, i), 8) AS INT) + 1), IF(i = 5, CAST(id % 40 AS STRING), ''))), ' ')").alias("text"))


@pytest.mark.parametrize("least", [0.0, 0.5])
def test_pairs_of_blocks_are_not_dealt(spark, least, monkeypatch):
    companions = spark.createDataFrame([("p0", "p1"), ("p1", "p0"), ("p2", "p0")], "source_package string, target_package string")
    columns = ("source_id", "target_id", "similarity", "rationale", "rank")
    rows = lambda: sorted(tuple(r[c] for c in columns) for r in bridges.nearest(_topics(spark), companions, 3, least).collect())
    whole = rows()
    monkeypatch.setattr(bridges, "BLOCK_TOPICS", 30)
    assert whole and rows() == whole
    plans = []
    paired = bridges._paired
    monkeypatch.setattr(bridges, "_paired", lambda *sides: plans.append(paired(*sides)) or plans[-1])
    rows()
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert plans[0].rdd.getNumPartitions() == 16 and "Exchange" not in plan and "CartesianProduct" in plan


def test_tables_on_the_way_are_removed(spark):
    """Term tables and blocks stayed until the session's end."""
    from siltstone.operators import graph

    frame = graph.cut(spark.range(10))
    where = frame._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.isdir(where) and frame.count() == 10
    graph.forget(frame)
    assert not os.path.exists(where)


def test_a_refresh_deals_stored_terms_once(spark, monkeypatch):
    """They were joined with the changed topics for each side of each comparison."""
    old = _topics(spark).where("topic_id % 10 <> 7")
    companions = spark.createDataFrame([("p0", "p1"), ("p1", "p0"), ("p2", "p0")], "source_package string, target_package string")
    held = bridges.stored_terms(old).cache()
    stored = bridges.among(held, companions, 3, 0.5)
    sides, scored = [], bridges._scored
    monkeypatch.setattr(bridges, "_scored", lambda left, right, *rest: sides.extend(x._jdf.queryExecution().executedPlan().toString() for x in (left, right)) or scored(left, right, *rest))
    columns = ("source_id", "target_id", "similarity", "rank")
    rows = lambda frame: sorted(tuple(r[c] for c in columns) for r in frame.collect())
    found = rows(bridges.refresh(stored, held, _topics(spark), companions, 3, 0.5))
    assert len(sides) == 4 and not any("Exchange" in plan for plan in sides)
    assert found and found == rows(bridges.nearest(_topics(spark), companions, 3, 0.5))
