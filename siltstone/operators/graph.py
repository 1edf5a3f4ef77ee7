"""Breadth-first reads of an edge table (src, dst, relation), level by level.

Each level is one join of the edges with a frontier of distinct nodes, so a hub's edges are read once per
level, however many paths lead to it. A frontier is checkpointed in the shared folder, as each later level reads it
twice; whether it is broadcast is left to the optimizer, which then knows its size.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(frame: DataFrame) -> DataFrame:
    """Checkpoints in spark.checkpoint.dir. Only on a local master may that be unset: a temporary folder then serves; on a cluster each host would have its own."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        where = frame.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="siltstone-"))
    return frame.checkpoint()


def forget(frame: DataFrame) -> None:
    """Removes the files of a frame of ``cut`` that nothing will read again; Spark itself would keep them."""
    where = frame._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if where.isDefined():
        path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(where.get())
        path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def both_ways(edges: DataFrame) -> DataFrame:
    forward = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), "relation")
    return forward.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("next"), F.concat("relation", F.lit(" (rev)")).alias("relation"))).where("node is not null and next is not null")


def walk(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(node, level, path) of every node within ``depth`` edges of ``starts`` (node), edges read both ways.

    ``path`` names the nodes of a shortest path; of several, the first in string order.
    """
    steps = both_ways(edges)
    seen = starts.select("node").distinct().withColumn("level", F.lit(0)).withColumn("path", F.col("node"))
    frontier = seen
    for level in range(1, depth + 1):
        reached = frontier.select("node", "path").join(steps, "node").select(F.col("next").alias("node"), F.concat("path", F.lit(" > "), "next").alias("path"))
        fresh = reached.groupBy("node").agg(F.min("path").alias("path")).join(seen.select("node"), "node", "left_anti")
        frontier = cut(fresh.select("node", F.lit(level).alias("level"), "path"))
        seen = seen.unionByName(frontier)
    return seen


def trails(edges: DataFrame, starts: DataFrame, targets: DataFrame, depth: int = 4) -> DataFrame:
    """(node, level, trail) of the shortest way to each target (node): nodes with the relations between them, in turn. Of several ways, the first in string order."""
    steps = both_ways(edges)
    seen = starts.select("node").distinct().withColumn("level", F.lit(0)).withColumn("trail", F.array("node"))
    frontier = seen
    for level in range(1, depth + 1):
        reached = frontier.select("node", "trail").join(steps, "node").select(F.col("next").alias("node"), F.concat("trail", F.array("relation", "next")).alias("trail"))
        fresh = reached.groupBy("node").agg(F.min("trail").alias("trail")).join(seen.select("node"), "node", "left_anti")
        frontier = cut(fresh.select("node", F.lit(level).alias("level"), "trail"))
        seen = seen.unionByName(frontier)
    return seen.join(targets.select("node").distinct(), "node", "left_semi")


def neighbourhood(edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    return walk(edges, starts, depth).select("node", "level")


def shortest_path(edges: DataFrame, starts: DataFrame, targets: DataFrame, depth: int = 4) -> DataFrame:
    """The shortest path from any start to each target (node) within ``depth`` edges."""
    return walk(edges, starts, depth).join(targets.select("node").distinct(), "node", "left_semi")
