"""Exact top-k search by inner product, with a ball tree in each shard.

Vectors are turned into integers once. Shards hold a bounded number of vectors, query blocks a bounded
number of queries. A first pass searches each query in one shard only, which gives a score that at least k
candidates reach: the current kth score. It goes along with the query to all shards; there a ball tree
over the shard's vectors is searched branch and bound. A node's bound on the inner product is
q . centre + |q| * radius; of two children the one with the larger mean bound is searched first, queries
whose kth score exceeds a node's bound leave the node, and what a shard finds raises the kth score for the
rest of that shard. Each (shard, query) sends at most k rows on, and a window keeps the k best.

All work is in (shard, block) pairs of bounded size; no vector table is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C

SHARD_ROWS, BLOCK_QUERIES, LEAF = 8192, 8192, 128


def _quantise(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                with np.errstate(over="ignore"):
                    q = np.floor(scale * x)
                if np.isfinite(x).all() and np.isfinite(q).all():
                    ids.append(i)
                    rows.append(q.astype("<i2").tobytes() if not len(q) or np.abs(q).max() < 32768 else q.astype("<f8").tobytes() + b"d")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], names=["vec_id", "v"])

    return run


def unpack(cells: list[bytes]) -> np.ndarray:
    """Rows of one dimension, as numbers that are whole."""
    rows = [np.frombuffer(c[:-1], "<f8") if len(c) % 2 else np.frombuffer(c, "<i2") for c in cells]
    return np.stack(rows).astype(np.float64)


class BallTree:
    """Nodes as (centre, radius, rows or children). Rows of a leaf are in the order of their ids."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        self.ids, self.x, self.leaf = ids, x, leaf
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray):
        x = self.x[rows]
        centre = x.mean(axis=0)
        away = np.sqrt(((x - centre) ** 2).sum(axis=1))
        radius = float(away.max())
        if len(rows) <= self.leaf or radius == 0.0:
            return centre, radius, rows, None
        a = x[int(away.argmax())]
        b = x[int(((x - a) ** 2).sum(axis=1).argmax())]
        order = np.argsort(x @ (b - a), kind="stable")
        half = len(rows) // 2
        return centre, radius, None, (self._build(np.sort(rows[order[:half]])), self._build(np.sort(rows[order[half:]])))

    def search(self, query_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, vector id, score) of each query's k best here that reach its floor; ties to the smaller id."""
        n = len(q)
        length = np.sqrt((q**2).sum(axis=1))
        best = np.full((n, k), -np.inf)
        best_id = np.full((n, k), np.iinfo(np.int64).max)
        kth = floor.astype(np.float64).copy()
        slack = 1e-9 * (length * float(np.sqrt((self.x**2).sum(axis=1)).max(initial=0.0)) + 1.0)

        def bound(node, rows):
            return q[rows] @ node[0] + length[rows] * node[1] + slack[rows]

        stack = [(self.root, np.arange(n))]
        while stack:
            node, rows = stack.pop()
            rows = rows[bound(node, rows) >= kth[rows]]
            if not len(rows):
                continue
            if node[3] is not None:
                first, second = sorted(node[3], key=lambda child: float(bound(child, rows).mean()))
                stack += [(first, rows), (second, rows)]  # the larger bound is popped first
                continue
            for at in range(0, len(node[2]), 4 * self.leaf):  # a leaf of equal vectors may be large
                part = node[2][at : at + 4 * self.leaf]
                score = q[rows] @ self.x[part].T
                ids = np.broadcast_to(self.ids[part], score.shape).copy()
                score[ids == query_ids[rows][:, None]] = -np.inf
                score[score < kth[rows][:, None]] = -np.inf
                some = np.isfinite(score).any(axis=1)
                if not some.any():
                    continue
                live = rows[some]
                all_s = np.concatenate([best[live], score[some]], axis=1)
                all_i = np.concatenate([best_id[live], ids[some]], axis=1)
                pick = np.lexsort((all_i, -all_s), axis=1)[:, :k]
                best[live], best_id[live] = np.take_along_axis(all_s, pick, 1), np.take_along_axis(all_i, pick, 1)
                kth[live] = np.maximum(kth[live], best[live, k - 1])
        row, col = np.nonzero(np.isfinite(best))
        return row, best_id[row, col], best[row, col]


LIMIT = 2**63 - 1


def _exact(x: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[list[int], list[int], list[int]]:
    """(query row, vector id, score) by whole-number arithmetic, for products that doubles can't hold. Scores beyond 64 bits count as the nearest that fits."""
    rows: list[int] = []
    found: list[int] = []
    scores: list[int] = []
    wide = float(np.abs(x).max(initial=0.0)) * float(np.abs(q).max(initial=0.0)) * x.shape[1] >= 2.0**62
    kind = object if wide else np.int64
    whole = lambda m: np.array([[int(v) for v in row] for row in m], dtype=object) if wide else m.astype(np.int64)
    left, right = whole(x).reshape(x.shape).T, whole(q).reshape(q.shape)
    for i in range(len(q)):
        score = np.asarray(right[i] @ left, dtype=kind)
        if wide:
            score = np.array([max(-LIMIT - 1, min(LIMIT, int(v))) for v in score], dtype=np.int64)
        other = np.flatnonzero(ids != query_ids[i])
        best = other[np.lexsort((ids[other], ~score[other]))[:k]]  # ~ turns the order round and, unlike a minus, always fits
        rows += [i] * len(best)
        found += ids[best].tolist()
        scores += score[best].tolist()
    return rows, found, scores


def _search(k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        empty = pa.table({n: pa.array([], pa.int64()) for n in names})
        if not vectors.num_rows or not queries.num_rows:
            return empty
        cells, sizes = vectors["v"].to_pylist(), {}
        for i, c in enumerate(cells):
            sizes.setdefault(_width(c), []).append(i)
        out = []
        asked, floors, q_cells = queries["asked"].to_numpy(), queries["floor"].to_numpy(), queries["asked_v"].to_pylist()
        for width, at in sizes.items():  # vectors of different lengths have no inner product
            mine = [i for i, c in enumerate(q_cells) if _width(c) == width]
            if not mine or not width:
                continue
            x, q = unpack([cells[i] for i in at]), unpack([q_cells[i] for i in mine])
            ids, mine = vectors["vec_id"].to_numpy()[at], np.array(mine)
            large = (2.0**53 / width) ** 0.5  # two vectors below it have a product that doubles hold exactly
            big_x, big_q = np.abs(x).max(axis=1) >= large, np.abs(q).max(axis=1) >= large
            small = np.flatnonzero(~big_x)
            if len(small) and not big_q.all():
                own = mine[~big_q]
                order = small[np.argsort(ids[small], kind="stable")]
                row, found, score = BallTree(ids[order], x[order]).search(asked[own], q[~big_q], floors[own], k)
                out.append(pa.table({"query_id": pa.array(asked[own][row]), "vec_id": pa.array(found), "score": pa.array(score.astype(np.int64))}))
            for ask, hold in ((big_q, np.ones(len(x), dtype=bool)), (~big_q, big_x)):
                if ask.any() and hold.any():
                    own = mine[ask]
                    rows, found, score = _exact(x[hold], ids[hold], asked[own], q[ask], k)
                    out.append(pa.table({"query_id": pa.array(asked[own][rows], pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(score, pa.int64())}))
        return pa.concat_tables(out) if out else empty

    return run


def _width(cell: bytes) -> int:
    return (len(cell) - 1) // 8 if len(cell) % 2 else len(cell) // 2


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows but itself, or all if there are fewer.

    ``is_query`` is a condition on ``vec_id``. Vectors that are null or hold null or non-finite components,
    rows without an id and pairs of different lengths take no part. Rows that repeat an id are all
    candidates for other ids; such an id asks once, with the least of its vectors in byte order. Products that
    doubles can't hold are computed in whole numbers, and scores beyond 64 bits count as the nearest that
    fits. Empty table: no rows.
    """
    spark = vectors.sparkSession
    C.ship(spark)
    store = C.Store(spark, "topk")
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    whole = store.put("whole", source.mapInArrow(_quantise(scale), "vec_id long, v binary"))
    asked = whole.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, n_asked = whole.count(), asked.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_asked // block_queries))
    home = lambda salt, m: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(m)).cast("int")
    held = whole.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.hash("v"), F.lit("shard")), F.lit(shards)).cast("int"))
    queries = asked.withColumn("block", home("block", blocks)).withColumn("home", home("home", shards))
    spread = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else held.withColumn("block", F.lit(0))
    schema = "query_id long, vec_id long, score long"
    lowest = F.lit(-float("inf"))

    def search(queries: DataFrame) -> DataFrame:
        asking = queries.select(F.col("shard").alias("at_shard"), F.col("block").alias("at_block"), F.col("vec_id").alias("asked"), F.col("v").alias("asked_v"), "floor")
        return spread.groupBy("shard", "block").cogroup(asking.groupBy("at_shard", "at_block")).applyInArrow(_search(k), schema)

    first = store.put("first", search(queries.withColumn("shard", F.col("home")).withColumn("floor", lowest)))
    floors = first.groupBy("query_id").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), "low")
    others = queries.join(floors, "vec_id", "left").withColumn("floor", F.coalesce(F.col("low").cast("double"), lowest))
    rest = search(others.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home")) if shards > 1 else first.limit(0)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(C.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
