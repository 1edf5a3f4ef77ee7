"""Exact integer k-means with Hamerly's bounds.

Each vector carries its cluster, an upper bound on the distance to that centroid and one lower bound on the
distance to any other. When centroids move, the upper bound grows by the own centroid's drift and the lower
one shrinks by the largest drift of the others. A vector whose upper bound stays below its lower bound, or
below half the distance from its centroid to the nearest other one, can't change; for the rest the upper
bound is first made tight, and only what is still ambiguous is held against all centroids, in whole numbers.
The bounds are doubles, widened by more than their rounding error, and decide nothing but what to skip;
equality counts as ambiguous, so ties always go to the smaller number.

A round is one pass over the state, written to the shared folder (the state before it goes then). Sums are
kept as running totals: only vectors that changed their cluster are read to bring them up to date, added up
in the tasks and sent on as one row per cluster and component. The driver holds k centroids and nothing else.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import topk

#: More than the relative rounding error of a square root and a few sums.
SLACK = 1e-12
#: Sums of components that no double may hold are kept as limbs of so many bits.
LIMB_BITS = 30
WIDE_LIMBS = 1024 // LIMB_BITS + 2
LARGEST = 2**63 - 1
STATE = "vec_id long, v binary, cluster int, was int, upper double, lower double, scanned boolean, distance long"


def _root(square: int) -> float:
    return math.sqrt(square) if square < 1 << 1000 else math.inf


@dataclass
class Centroids:
    rows: list[list[int]]
    #: How far each moved since the bounds were written, at least.
    drift: list[float]

    def matrix(self) -> np.ndarray:
        """Doubles where they hold every component, else Python numbers."""
        fits = all(abs(x) < 1 << 50 for row in self.rows for x in row)
        return np.array(self.rows, dtype=np.float64 if fits else object)

    def halves(self) -> np.ndarray:
        """Half the distance from each centroid to the nearest other one, at most."""
        out = []
        for i, a in enumerate(self.rows):
            near = min((sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) for j, b in enumerate(self.rows) if j != i), default=None)
            out.append(math.inf if near is None else _root(near) / 2 * (1 - SLACK))
        return np.array(out)

    def others(self) -> np.ndarray:
        """For each centroid the largest drift among the others."""
        d = np.array(self.drift)
        order = np.argsort(-d, kind="stable")
        out = np.full(len(d), d[order[0]])
        out[order[0]] = d[order[1]] if len(d) > 1 else 0.0
        return out


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows x centroids): doubles if every term stays below 2**53, else Python numbers."""
    most = max(float(np.abs(x).max(initial=0)), float(np.abs(c).max(initial=0)))
    if c.dtype != object and 4 * most * most * x.shape[1] < 2.0**53:
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    whole = [[int(v) for v in row] for row in x]
    centres = [[int(v) for v in row] for row in c]
    return np.array([[sum((p - q) ** 2 for p, q in zip(a, b, strict=True)) for b in centres] for a in whole], dtype=object).reshape(len(x), len(c))


def _roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares) if squares.dtype != object else np.array([_root(s) for s in squares])


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower, scanned) after the centroids moved. cluster -1: not assigned yet."""
    c, halves, drift, others = centroids.matrix(), centroids.halves(), np.array(centroids.drift), centroids.others()
    cluster, own = cluster.copy(), np.maximum(cluster, 0)
    upper = np.where(cluster < 0, np.inf, (upper + drift[own]) * (1 + SLACK))
    lower = np.where(cluster < 0, -np.inf, lower - others[own] * (1 + SLACK))
    bar = np.maximum(lower, halves[own])
    unsure = np.flatnonzero(~(upper < bar))
    known = unsure[cluster[unsure] >= 0]
    for k in np.unique(cluster[known]):
        rows = known[cluster[known] == k]
        upper[rows] = _roots(_squares(x[rows], c[k : k + 1])[:, 0]) * (1 + SLACK)
    unsure = unsure[~(upper[unsure] < bar[unsure])]
    scanned = np.zeros(len(x), dtype=bool)
    scanned[unsure] = True
    if len(unsure):
        squares = _squares(x[unsure], c)
        best = squares.argmin(axis=1)  # the first of equals
        at = np.arange(len(unsure))
        cluster[unsure], upper[unsure] = best, _roots(squares[at, best]) * (1 + SLACK)
        if len(c) > 1:
            squares[at, best] = np.inf
            lower[unsure] = _roots(squares.min(axis=1)) * (1 - SLACK)
        else:
            lower[unsure] = np.inf
    return cluster, upper, lower, scanned


def _pass(centroids: Centroids, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids.matrix()
        for batch in batches:
            if not batch.num_rows:
                continue
            x = topk.unpack(batch.column(1).to_pylist())
            was, upper, lower = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4))
            cluster, upper, lower, scanned = assign(x, was, upper, lower, centroids)
            distance = np.zeros(len(x), np.int64)
            for k in np.unique(cluster) if last else ():
                rows = np.flatnonzero(cluster == k)
                distance[rows] = [min(int(d), LARGEST) for d in _squares(x[rows], c[k : k + 1])[:, 0]]
            cells = [batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(was.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(scanned), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(cells, names=[x.split()[0] for x in STATE.split(", ")])

    return run


def _limbs(value: int, n: int) -> list[int]:
    """n limbs of which only the last may be negative; they add up one by one."""
    return [(value >> (LIMB_BITS * i)) & ((1 << LIMB_BITS) - 1) for i in range(n - 1)] + [value >> (LIMB_BITS * (n - 1))]


def _changes(k: int, dim: int, limbs: int):
    """One row per cluster and place: the sums that came in less those that left. The place after the last is the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim * limbs + 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = topk.unpack(batch.column(0).to_pylist())
            parts = x.astype(np.int64) if limbs == 1 else np.array([[limb for v in row for limb in _limbs(int(v), limbs)] for row in x], np.int64)
            parts = np.concatenate([parts, np.ones((len(x), 1), np.int64)], axis=1)
            for column, sign in ((1, 1), (2, -1)):
                at = batch.column(column).to_numpy(zero_copy_only=False)
                for c in np.unique(at[at >= 0]):
                    total[c] += sign * parts[at == c].sum(axis=0)
        row, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(total[row, place])], names=["cluster", "place", "part"])

    return run


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, scale: float = 256.0, dim: int = 64, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]], C.Store]:
    """(STATE after the last assignment, final centroids, the store that holds the state until it is closed).

    Components become floor(scale * x). Vectors that are null, of another length or hold null or non-finite
    components take no part, nor do rows without an id. The k vectors with the smallest SHA-256 of ``seed:id``
    start, in the order of the hash (rows that share an id: of their bytes); with fewer vectors there are as
    many clusters. Repeated rows each count. Empty clusters keep their centroid. Components of any size are
    exact; distances beyond 64 bits are reported as the largest that fits. Other columns are not read. Empty
    table: no rows and no centroids.
    """
    spark = vectors.sparkSession
    C.ship(spark)
    store = C.Store(spark, "clusters")
    source = vectors.where(F.size(vector_col) == dim).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    whole = store.put("whole", source.mapInArrow(topk._quantise(scale), "vec_id long, v binary"))
    first = whole.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), "v").limit(k).select("v").collect()
    centroids = Centroids([[int(x) for x in row] for row in topk.unpack([bytes(r.v) for r in first])] if first else [], [0.0] * len(first))
    nowhere = whole.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
    if not first:
        return store.put("state", nowhere.select("vec_id", "v", "cluster", F.lit(-1).alias("was"), "upper", "lower", F.lit(False).alias("scanned"), F.lit(0).cast("long").alias("distance"))), [], store
    limbs = WIDE_LIMBS if whole.where(F.octet_length("v") % 2 == 1).limit(1).count() else 1
    sums = [[0] * (dim * limbs + 1) for _ in first]
    state, before = nowhere, "whole"
    for turn in range(rounds + 1):
        read = state.select("vec_id", "v", "cluster", "upper", "lower")
        state = store.put(f"state-{turn}", read.mapInArrow(_pass(centroids, turn == rounds), STATE))
        store.drop(before)
        before = f"state-{turn}"
        if turn == rounds:
            break
        moved = state.where("cluster <> was").select("v", "cluster", "was").mapInArrow(_changes(len(first), dim, limbs), "cluster int, place int, part long")
        for r in moved.groupBy("cluster", "place").agg(F.sum("part").alias("part")).collect():  # at most k * (dim * limbs + 1) rows
            sums[r.cluster][r.place] += r.part
        new = []
        for own, old in zip(sums, centroids.rows, strict=True):
            values = [sum(own[j * limbs + i] << (LIMB_BITS * i) for i in range(limbs)) for j in range(dim)]
            new.append([v // own[-1] for v in values] if own[-1] else old)
        drift = [_root(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))) * (1 + SLACK) for x, y in zip(new, centroids.rows, strict=True)]
        centroids = Centroids(new, drift)
    return state, centroids.rows, store


def query(spark, sf_dir: str) -> DataFrame:
    state, centroids, _ = cluster_vectors(C.table(spark, sf_dir, "embeddings"))
    spent = {r.cluster: int(r.total) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}  # at most k rows
    inertia = min(sum(spent.values()), LARGEST)
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids]
    about = spark.createDataFrame([(i, min(spent.get(i, 0), LARGEST), inertia, d) for i, d in enumerate(digest)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 40, rounds: int = 5) -> str:
    """The same steps as DuckDB SQL, one pair of tables for each round."""
    parts = [
        "kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster, v FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        square = "CAST(list_sum(list_transform(list_zip(kept.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min(d) AS distance, CAST(arg_min(cluster, d * {k} + cluster) AS INTEGER) AS cluster FROM (SELECT kept.vec_id, kept.v, c.cluster, {square} AS d FROM kept CROSS JOIN c{r} AS c) GROUP BY vec_id)")
        if r < rounds:
            cells = f"SELECT cluster, place, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{r}) GROUP BY cluster, place"
            means = f"SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS v FROM ({cells}) GROUP BY cluster"
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.cluster, coalesce(m.v, c{r}.v) AS v FROM c{r} LEFT JOIN ({means}) AS m ON m.cluster = c{r}.cluster)")
    return f"WITH {', '.join(parts)} SELECT a.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} AS a JOIN c{rounds} AS c ON c.cluster = a.cluster"


SQL = sql()
