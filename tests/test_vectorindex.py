"""The vector index against a full scan."""

import numpy as np

from siltstone.operators import retrieval as R
from siltstone.operators.vectorindex import VectorIndex, train


def clustered(spark, n=1500, dim=12, seed=1):
    draw = np.random.default_rng(seed)
    centre = draw.normal(size=(15, dim))
    x = centre[draw.integers(0, 15, n)] + 0.35 * draw.normal(size=(n, dim))
    x[200:600] = x[200]  # copies
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * dim), (9000, None), (9001, [0.0] * dim), (9002, [float("nan")] * dim), (9003, [1.0, None] + [1.0] * (dim - 2))]
    frame = spark.createDataFrame(data, "id long, v array<double>").repartition(4)
    asked = frame.where("id % 20 = 0 or id > 8999").selectExpr("id as question", "v as q")
    return frame, asked


def rows(frame):
    return sorted(map(tuple, frame.select("question", "id", "score", "rank").collect()))


def test_exact_search_equals_a_scan(spark, tmp_path):
    frame, asked = clustered(spark)
    index = VectorIndex.build(frame, f"file://{tmp_path}/i")
    assert rows(index.search(asked, 10, exact=True)) == rows(R.cosine(frame, asked, 10))
    assert rows(index.search(asked, 7, share=0.02, exact=True, shard_rows=60, block_questions=9)) == rows(R.cosine(frame, asked, 7))
    assert index.cells().agg({"n": "sum"}).first()[0] == 1500 == index.vectors().count()  # every row is in a cell


def test_recall_of_a_tenth_of_the_cells(spark, tmp_path):
    frame, asked = clustered(spark)
    index = VectorIndex.build(frame, f"file://{tmp_path}/i")
    best = {(q, i) for q, i, _, _ in rows(R.cosine(frame, asked, 10))}
    found = {(q, i) for q, i, _, _ in rows(index.search(asked, 10, share=0.1, exact=False))}
    assert len(best & found) >= 0.9 * len(best)


def test_few_vectors_and_none(spark, tmp_path):
    frame, asked = clustered(spark, 700)
    few = frame.where("id < 3")
    index = VectorIndex.build(few, f"file://{tmp_path}/few")
    assert rows(index.search(asked, 10, exact=True)) == rows(R.cosine(few, asked, 10))
    none = VectorIndex.build(frame.where("id < 0"), f"file://{tmp_path}/none")
    assert none.search(asked, 10, exact=True).count() == 0 == none.search(asked, exact=False).count()


def test_centres_of_few_distinct_rows():
    assert len(train(np.array([[1.0, 0.0]] * 5 + [[0.0, 1.0]]), 4)) == 2


def test_tasks_hold_distances_of_few_vectors_at_once():
    """A batch of 6,000 vectors against 1,000 centres: distances of all at once, and rows for all open cells at once, took hundreds of MB."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from siltstone.operators import vectorindex as V

    rng = np.random.default_rng(5)
    centres, x = rng.normal(size=(1000, 16)), rng.normal(size=(6000, 16))
    centres /= np.sqrt((centres**2).sum(axis=1))[:, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6000)), pa.array(list(x)), pa.array([None] * 6000, pa.float64())], names=["question", "q", "low"])
    most_rows, n = 0, 0
    tracemalloc.start()
    placed = [b.column(3).to_numpy() for b in V._placed(centres)(iter([batch]))]
    near = [b.column(2).to_numpy() for b in V._nearest_cells(centres, 3)(iter([batch]))]
    for b in V._open_cells(centres, np.zeros(1000), 3)(iter([batch])):
        most_rows, n = max(most_rows, b.num_rows), n + b.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = V.distances(V.units(batch.column(1)), centres)
    assert (np.concatenate(placed) == whole.argmin(axis=1)).all() and (np.concatenate(near).reshape(-1, 3) == np.argsort(whole, axis=1, kind="stable")[:, :3]).all()
    assert n == 6000 * 997 and most_rows <= V.SENT_AT_ONCE and peak < 60e6
