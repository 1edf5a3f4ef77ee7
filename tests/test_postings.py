"""The written index against BM25 over the records, before and after updates."""

import os
import random

import pytest

from siltstone.operators import retrieval as R
from siltstone.operators.postings import Index

SCHEMA = "id long, clearance int, title string, content string"


def corpus(n=900, seed=1):
    draw = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    text = lambda k: " ".join(draw.choices(words, weights, k=k))
    rows = [(i, i % 4, text(3), text(draw.randint(1, 120))) for i in range(n)]
    rows[7] = (7, 0, None, None)
    rows[8] = (8, 0, "", "")
    rows[9] = (9, 0, "Ünïcode w1", "é w2 w2")
    return rows


def questions(spark, n=40):
    draw = random.Random(2)
    rows = [(i, " ".join("w%d" % min(399, int(draw.expovariate(0.02))) for _ in range(draw.randint(1, 12)))) for i in range(n)]
    return spark.createDataFrame([*rows, (90, ""), (91, None), (92, "nothing known"), (None, "w1"), (93, "unicode")], "question long, text string")


def rows(frame):
    return sorted(map(tuple, frame.select("question", "id", "score", "rank").collect()))


def files(where):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(where) for f in names if f.endswith(".parquet")}


@pytest.mark.parametrize("clearance", [3, 1])
def test_search_equals_bm25(spark, tmp_path, clearance):
    records = spark.createDataFrame([*corpus(), (None, 0, "w1", "w1")], SCHEMA)
    index = Index.build(records, f"file://{tmp_path}/i", rows=256)
    asked = questions(spark)
    for k, block in ((3, 7), (2000, 1024)):
        assert rows(index.search(asked, k, clearance, block)) == rows(R.bm25(records, asked, k, clearance))
    told = index.work(asked, 3, clearance).agg({"read": "sum", "held": "sum"}).first()
    assert 0 < told["sum(read)"] < told["sum(held)"]  # some blocks are not decoded
    assert index.search(asked, 3, -1).count() == 0


def test_buckets_meet_their_questions_in_any_partition(spark, tmp_path):
    records = spark.createDataFrame(corpus(300), SCHEMA)
    index = Index.build(records, f"file://{tmp_path}/i", rows=20)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows(index.search(questions(spark))) == rows(R.bm25(records, questions(spark)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ties_and_repeated_texts(spark, tmp_path):
    records = spark.createDataFrame([(i, 0, "same title", "same words here") for i in range(300)], SCHEMA)
    index = Index.build(records, f"file://{tmp_path}/i", rows=64)
    asked = spark.createDataFrame([(1, "same here")], "question long, text string")
    assert rows(index.search(asked, 7)) == rows(R.bm25(records, asked, 7)) and [r[1] for r in rows(index.search(asked, 7))] == list(range(7))


def test_update_equals_rebuild_and_touches_few_files(spark, tmp_path):
    before = corpus(2000)
    index = Index.build(spark.createDataFrame(before, SCHEMA), f"file://{tmp_path}/i", rows=20)
    old = files(f"{tmp_path}/i")
    changed = [(i, 2, t, f"{c} fresh w{i % 50}") for i, _, t, c in corpus(2000, 5)[1000:1015]]
    gone = [(1015,), (1016,), (1017,), (1018,), (1019,), (999_999,), (None,)]
    for _ in range(2):  # doing it again changes nothing
        index.update(spark.createDataFrame(changed, SCHEMA), spark.createDataFrame(gone, "id long"))
    new = files(f"{tmp_path}/i")
    assert len([f for f in new if old.get(f) != new[f]]) <= 0.02 * len(old)
    ids = {r[0] for r in changed} | {r[0] for r in gone}
    after = spark.createDataFrame([*(r for r in before if r[0] not in ids), *changed], SCHEMA)
    asked = questions(spark).union(spark.createDataFrame([(95, "fresh")], "question long, text string"))
    assert rows(index.search(asked, 10, 2)) == rows(R.bm25(after, asked, 10, 2))


def test_a_bucket_that_is_emptied_is_gone(spark, tmp_path):
    index = Index.build(spark.createDataFrame(corpus(100), SCHEMA), f"file://{tmp_path}/i", rows=10)
    index.update(spark.createDataFrame([(500, 0, "w1", "far away")], SCHEMA), spark.createDataFrame([(i,) for i in range(20, 40)], "id long"))
    left = {r.bucket for r in index.table("postings").select("bucket").distinct().collect()}
    assert left == {0, 1, 4, 5, 6, 7, 8, 9, 50} == {r.bucket for r in index.table("stats").select("bucket").distinct().collect()}
    after = spark.createDataFrame([*(r for r in corpus(100) if not 20 <= r[0] < 40), (500, 0, "w1", "far away")], SCHEMA)
    assert rows(index.search(questions(spark))) == rows(R.bm25(after, questions(spark)))


def test_an_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    index = Index.build(none, f"file://{tmp_path}/i", rows=10)
    assert index.search(questions(spark)).count() == 0
    index.update(spark.createDataFrame([(3, 0, "w1", "w2 w3")], SCHEMA), spark.createDataFrame([], "id long"))
    assert [r[:2] for r in rows(index.search(spark.createDataFrame([(1, "w3")], "question long, text string")))] == [(1, 3)]
