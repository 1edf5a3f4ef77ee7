"""Clustering with Hamerly's bounds against plain k-means in Python numbers."""

import hashlib

import numpy as np
import pytest

from siltstone.llm import clusters


def plain(data, k, rounds, scale, seed):
    """data: (id, components). (id, components as numbers) -> cluster by full scans; final centroids."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in data]
    start = sorted(kept, key=lambda r: hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest())[:k]
    centres = [list(v) for _, v in start]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(centres)), key=lambda c: (square(v, centres[c]), c))
    for _ in range(rounds):
        own = [[] for _ in centres]
        for _, v in kept:
            own[nearest(v)].append(v)
        centres = [[sum(x) // len(rows) for x in zip(*rows, strict=True)] if rows else c for rows, c in zip(own, centres, strict=True)]
    return sorted((i, nearest(v), min(square(v, centres[nearest(v)]), 2**63 - 1)) for i, v in kept), centres


def run(spark, data, **options):
    frame = spark.createDataFrame([(i, v, 0, "x") for i, v in data], "vec_id long, embedding array<double>, cluster int, distance string").repartition(3)
    state, centres, store = clusters.cluster_vectors(frame, **options)
    rows = sorted((r.vec_id, r.cluster, r.distance) for r in state.collect())
    scanned = state.where("scanned").count()
    store.close()
    return rows, centres, scanned


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_k_means(spark, seed):
    draw = np.random.default_rng(seed)
    centre = draw.normal(size=(6, 5))
    points = (centre[draw.integers(0, 6, 400)] + 0.2 * draw.normal(size=(400, 5))).round(1)
    points[100:230] = points[100]  # a third of the rows are copies: ties and equal centroids
    data = [(i, v.tolist()) for i, v in enumerate(points)]
    rows, centres, scanned = run(spark, data, k=9, rounds=4, dim=5, scale=16.0)
    assert (rows, centres) == plain(data, 9, 4, 16.0, 2)
    assert scanned < len(data)  # the bounds do skip


def test_bounds_skip_far_clusters(spark):
    draw = np.random.default_rng(3)
    centre = 50 * draw.normal(size=(4, 8))
    data = [(i, (centre[i % 4] + draw.normal(size=8)).tolist()) for i in range(300)]
    rows, centres, scanned = run(spark, data, k=4, rounds=3, dim=8)
    assert (rows, centres) == plain(data, 4, 3, 256.0, 2)
    assert scanned <= 75  # two centroids start in one cluster of 75; the rest is skipped


def test_numbers_that_doubles_do_not_hold(spark):
    draw = np.random.default_rng(4)
    data = [(i, (draw.normal(size=3) * 10.0 ** (i % 40)).tolist()) for i in range(60)]
    rows, centres, _ = run(spark, data, k=5, rounds=3, dim=3)
    assert (rows, centres) == plain(data, 5, 3, 256.0, 2)


def test_edges(spark):
    good = [(i, [float(i % 3), 1.0]) for i in range(7)]
    odd = [(None, [1.0, 1.0]), (90, None), (91, [1.0, None]), (92, [float("nan"), 1.0]), (93, [float("inf"), 1.0]), (94, [1.0]), (95, [1.0, 2.0, 3.0]), (96, [])]
    rows, centres, _ = run(spark, [*good, good[0], *odd], k=40, rounds=5, dim=2)  # fewer vectors than clusters, a repeated row
    assert (rows, centres) == plain([*good, good[0]], 40, 5, 256.0, 2)
    assert run(spark, odd, k=4, rounds=2, dim=2) == ([], [], 0)
    one, centre, _ = run(spark, good[:1], k=4, rounds=2, dim=2)
    assert one == [(0, 0, 0)] and centre == [[0, 256]]


def test_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = clusters.query(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
