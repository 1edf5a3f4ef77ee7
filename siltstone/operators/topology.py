"""A part of the entity graph that is dense enough to be looked at: an induced subgraph, peeled to its core.

Peeling goes in rounds: nodes with fewer than ``core`` neighbours go, and with them their edges, until none has. What is left does not depend
on the order. A round counts neighbours only of nodes that lost some, and writes its two small tables in the shared folder; older ones go. Rounds
are as many as the longest chain of nodes that fall one after the other, so their number is bounded by ``most`` and not by rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Scratch
from . import graph as G
from .graphstore import Graph

MAX_ROUNDS = 1000


def induced(graph: Graph, kinds: Sequence[str] | None = None, clearance: int = 3, term: str = "") -> tuple[DataFrame, DataFrame]:
    """(nodes, links) that a caller may see: entities of some kinds whose name or kind holds ``term`` (letter case does not count, no sign is a wildcard), with their relations.

    links are (a, b), a before b, one for each two entities that any visible relation joins, in either direction; a relation from an entity to itself is none.
    """
    seen = graph.entities.where(F.col("clearance") <= clearance)
    if kinds is not None:
        seen = seen.where(F.col("kind").isin(list(kinds)))
    if term.strip():
        wanted = term.strip().lower()
        seen = seen.where(F.contains(F.lower("name"), F.lit(wanted)) | F.contains(F.lower("kind"), F.lit(wanted)))
    ids = seen.select("norm").distinct()
    own = graph.relations.where((F.col("clearance") <= clearance) & (F.col("source") != F.col("target")))
    ends = own.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    links = ends.join(ids.withColumnRenamed("norm", "a"), "a", "left_semi").join(ids.withColumnRenamed("norm", "b"), "b", "left_semi")
    return seen, links.select("a", "b")


def _both(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))


def degrees(links: DataFrame) -> DataFrame:
    """(node, degree) of nodes with any link."""
    return _both(links).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def without_hubs(links: DataFrame, cap: int) -> DataFrame:
    """links without those of nodes that have more than ``cap``; all nodes are judged on the links given."""
    hubs = degrees(links).where(F.col("degree") > cap).select("node")
    return links.join(hubs.withColumnRenamed("node", "a"), "a", "left_anti").join(hubs.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b")


def peeled(links: DataFrame, core: int, most: int = MAX_ROUNDS) -> DataFrame:
    """(node, degree) of the largest part in which each node has at least ``core`` neighbours; empty if there is none."""
    spark = links.sparkSession
    with Scratch(spark, "peeled") as scratch:
        steps = scratch.put("steps", _both(links))
        left = scratch.put("left-0", steps.groupBy("node").agg(F.count(F.lit(1)).alias("degree")))
        for n in range(1, most + 1):
            falls = left.where(F.col("degree") < core).select("node")
            if falls.isEmpty():
                return G.cut(left)
            lost = steps.join(falls, "node").groupBy(F.col("other").alias("node")).agg(F.count(F.lit(1)).alias("lost"))
            stay = left.where(F.col("degree") >= core).join(lost, "node", "left")
            left = scratch.put(f"left-{n}", stay.select("node", (F.col("degree") - F.coalesce("lost", F.lit(0))).alias("degree")))
            if n > 1:
                scratch.drop(f"left-{n - 2}")
    raise RuntimeError(f"not peeled after {most} rounds")


def topology(graph: Graph, kinds: Sequence[str] | None = None, clearance: int = 3, term: str = "", cap: int | None = None, core: int = 1, most: int = MAX_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the induced subgraph after hubs of more than ``cap`` links are left out and the rest is peeled to ``core``.

    nodes are (norm, name, kind, degree); edges the visible relations between them (source, target, relation). With ``core`` 0, nodes without links stay.
    """
    seen, links = induced(graph, kinds, clearance, term)
    links = links if cap is None else without_hubs(links, cap)
    found = peeled(links, core, most) if core > 1 else degrees(links)
    nodes = seen.join(found.withColumnRenamed("node", "norm"), "norm", "inner" if core > 0 else "left").select("norm", "name", "kind", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
    inside = links.join(nodes.select(F.col("norm").alias("a")), "a", "left_semi").join(nodes.select(F.col("norm").alias("b")), "b", "left_semi")
    own = graph.relations.where(F.col("clearance") <= clearance).select("source", "target", "relation", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    return nodes, own.join(inside, ["a", "b"], "left_semi").select("source", "target", "relation").distinct()
