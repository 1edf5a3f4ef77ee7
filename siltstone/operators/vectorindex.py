"""An inverted-file index of vectors: cells of a k-means, searched nearest first, with an exact way.

Vectors are compared by the angle, so cells and distances are those of the vectors scaled to length one, where the
distance d and the cosine c hold d * d = 2 - 2 c. The cells' centres come from a bounded sample (SAMPLE rows, chosen by
a hash of the id); every vector then goes to its nearest centre and is written there, and a cell keeps the distance of its
farthest member.

A search looks into the nearest share of a question's cells and ranks what is there by the exact cosine. The exact way
goes on from that: with t the distance of the kth best so far, a cell whose centre is farther than its radius plus t holds
nothing better (triangle inequality), and all others are searched too. Cells larger than a shard are split by a hash
of the id, so copies of one vector do not meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import workspace
from ..shipping import ship
from . import graph as G
from . import retrieval as R

#: Rows that the centres are learnt from, at about the most; cells at the most.
SAMPLE, MOST_CELLS = 20_000, 4096
#: Scores are rounded to six digits; bounds keep more than that as slack.
SLACK = 2e-6
#: Vectors whose distances to all centres a task holds at once, and rows that it sends at once.
ROWS_AT_ONCE, SENT_AT_ONCE = 256, 8192


def sound(v):
    """Vectors with a direction: no null or non-finite components, not all zero."""
    return v.isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(v, lambda x: x != 0)


def units(column: pa.Array) -> np.ndarray:
    x = np.array(column.to_pylist(), np.float64)
    return x / np.sqrt((x**2).sum(axis=1))[:, None]


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (x**2).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres**2).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(square, 0.0))


def train(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of Lloyd's k-means on rows of length one; a cell that empties keeps its centre."""
    distinct = np.unique(x, axis=0)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:cells]]
    for _ in range(rounds):
        own = np.concatenate([distances(x[at : at + 1024], centres).argmin(axis=1) for at in range(0, len(x), 1024)])
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches, few at a time: distances to 4096 centres take 32 kB a row, several times over."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _sent(batch: pa.RecordBatch, rows: np.ndarray, cell: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(question, q, cell) of a batch's rows, repeated for their cells."""
    for at in range(0, len(rows), SENT_AT_ONCE):
        own = rows[at : at + SENT_AT_ONCE]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(cell[at : at + SENT_AT_ONCE].astype(np.int32))], names=["question", "q", "cell"])


def _placed(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            away = distances(units(batch.column(1)), centres)
            cell = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(away[np.arange(len(cell)), cell]), pa.array(cell.astype(np.int32))], names=["id", "v", "away", "cell"])

    return run


def _nearest_cells(centres: np.ndarray, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            best = np.argsort(distances(units(batch.column(1)), centres), axis=1, kind="stable")[:, :probes]
            yield from _sent(batch, np.repeat(np.arange(len(best)), best.shape[1]), best.ravel())

    return run


def _open_cells(centres: np.ndarray, radius: np.ndarray, probes: int):
    """The cells beyond the first ones that may hold a score as good as ``low``; without one, all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            away = distances(units(batch.column(1)), centres)
            order = np.argsort(away, axis=1, kind="stable")
            low = batch.column(2).fill_null(-2.0).to_numpy(zero_copy_only=False)
            open_ = away - radius[None, :] <= np.sqrt(np.maximum(2 - 2 * low, 0.0) + 2 * SLACK)[:, None] + SLACK
            np.put_along_axis(open_, order[:, :probes], False, axis=1)
            yield from _sent(batch, *np.nonzero(open_))

    return run


PICKED = "question long, q array<double>, cell int"


@dataclass
class VectorIndex:
    """A folder with vectors (id, v, away), partitioned by cell, and cells (cell, centre, n, radius)."""

    spark: SparkSession
    where: str

    @classmethod
    def build(cls, vectors: DataFrame, where: str, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """The index of vectors (id, v) of one length. Rows without an id or a direction take no part; the square root of their number is the number of cells if none is given."""
        spark = vectors.sparkSession
        ship(spark)
        index = cls(spark, where)
        held = vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where(F.col("id").isNotNull() & sound(F.col("v")))
        n = held.count()
        few = held if n <= sample else held.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * sample / n)).limit(sample + sample // 4)
        rows = [r.v for r in few.select("v").collect()]
        width = len(rows[0]) if rows else 0
        centres = train(units(pa.array(rows)), cells or max(1, min(MOST_CELLS, round(n**0.5)))) if rows else np.zeros((0, 0))
        placed = held.where(F.size("v") == width).mapInArrow(_placed(centres), "id long, v array<double>, away double, cell int")
        placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("cell").parquet(f"{where}/vectors")
        sizes = {r.cell: r for r in index.vectors().groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()}  # at most MOST_CELLS rows
        about = [(i, c.tolist(), sizes[i].n if i in sizes else 0, sizes[i].radius if i in sizes else 0.0) for i, c in enumerate(centres)]
        spark.createDataFrame(about, "cell int, centre array<double>, n long, radius double").coalesce(1).write.parquet(f"{where}/cells")
        return index

    def vectors(self) -> DataFrame:
        return self.spark.read.schema("id long, v array<double>, away double, cell int").parquet(f"{self.where}/vectors")

    def cells(self) -> DataFrame:
        return self.spark.read.schema("cell int, centre array<double>, n long, radius double").parquet(f"{self.where}/cells")

    def _within(self, picked: DataFrame, blocks: int, k: int, shard_rows: int) -> DataFrame:
        """The k best of each question in each of its cells."""
        shards = F.broadcast(self.cells().select("cell", F.greatest(F.lit(1), F.ceil(F.col("n") / shard_rows)).cast("int").alias("shards")))  # at most MOST_CELLS rows
        every = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
        wanted = picked.select("cell").distinct()
        held = self.vectors().join(F.broadcast(wanted), "cell", "left_semi").join(shards, "cell")
        left = held.select("cell", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int").alias("shard"), "id", "v", every(F.lit(blocks)).alias("block"))
        right = picked.join(shards, "cell").select("question", "q", F.col("cell").alias("at_cell"), every(F.col("shards")).alias("at_shard"), R._home("question", blocks).alias("at_block"))
        return left.groupBy("cell", "shard", "block").cogroup(right.groupBy("at_cell", "at_shard", "at_block")).applyInArrow(R._nearest(k), "question long, id long, score double")

    def search(self, questions: DataFrame, k: int = 10, share: float = 0.1, exact: bool = True, shard_rows: int = R.SHARD_ROWS, block_questions: int = R.BLOCK_QUESTIONS) -> DataFrame:
        """question, id, score, rank for questions (question, q) of the index's length: the k best by cosine, as ``retrieval.cosine`` gives them, or without ``exact`` those in the nearest ``share`` of cells. How many of the best these hold depends on the vectors: most of them where there are clusters, few where all directions are alike. A vector under the question's own number is left out."""
        known = self.cells().orderBy("cell").collect()  # at most MOST_CELLS rows
        centres, radius = np.array([r.centre for r in known]).reshape(len(known), -1) if known else np.zeros((0, 0)), np.array([r.radius for r in known])
        asked = questions.select(F.col("question").cast("long").alias("question"), F.col("q").cast("array<double>").alias("q")).where(F.col("question").isNotNull() & sound(F.col("q")) & (F.size("q") == centres.shape[1]))
        blocks, probes = max(1, -(-asked.count() // block_questions)), max(1, -(-int(len(known) * share * 1000) // 1000))
        if not known:
            return R.top(asked.select("question", F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("score")).limit(0), k)
        first = self._within(asked.mapInArrow(_nearest_cells(centres, probes), PICKED), blocks, k, shard_rows)
        if not exact:
            return R.top(first, k)
        first = G.cut(R.top(first, k))
        low = first.where(F.col("rank") == k).select("question", F.col("score").alias("low"))
        more = asked.join(low, "question", "left").select("question", "q", "low").mapInArrow(_open_cells(centres, radius, probes), PICKED)
        return R.top(first.select("question", "id", "score").unionByName(self._within(more, blocks, k, shard_rows)), k)
