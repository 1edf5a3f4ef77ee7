"""The topic tree: paths, clearance, visibility, themes, edges and reads of it.

nodes are (topic_id, package, name, depth), edges (child, parent, is_primary) with a null parent for roots, records (id, topic_id, clearance,
console, record_kind, ...). The primary edges form a forest; it is walked level by level, a join per level, so depth bounds the number of
joins and no limit on rows applies. Each level is checkpointed. A tree deeper than ``most`` levels raises RuntimeError; so does a circle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graph as G

# Fixed values.
UNKNOWN = 3
MAX_LEVELS = 200
FIND_LIMIT = 200
SHARED_LINKS = 3
ALARM, COMMAND = r"^(ALM-\d+)", r"^([A-Z]{2,6}\s+[A-Z0-9_]{2,15})"


def primary(edges: DataFrame) -> DataFrame:
    """(child, parent) of the primary edges; roots have a null parent."""
    return edges.where("is_primary = 1").select("child", "parent")


def by_level(edges: DataFrame, first: DataFrame, grow: Callable[[DataFrame], DataFrame], most: int = MAX_LEVELS) -> DataFrame:
    """All rows of ``first`` and of what ``grow`` makes of each level's rows, until a level is empty."""
    level, done = G.cut(first), None
    for _ in range(most):
        done = level if done is None else done.unionByName(level)
        level = G.cut(grow(level))
        if level.isEmpty():
            return done
    raise RuntimeError(f"deeper than {most} levels")


def paths(nodes: DataFrame, edges: DataFrame, sign: str = " > ", most: int = MAX_LEVELS) -> DataFrame:
    """(topic_id, path, level): the names from the root down. Topics that no root leads to have no row."""
    names, links = nodes.select("topic_id", "name"), primary(edges)
    roots = links.where("parent is null").select(F.col("child").alias("topic_id")).distinct().join(names, "topic_id").select("topic_id", F.col("name").alias("path"), F.lit(0).alias("level"))
    down = links.where("parent is not null")

    def grow(level: DataFrame) -> DataFrame:
        kids = level.select(F.col("topic_id").alias("parent"), "path", "level").join(down, "parent").select(F.col("child").alias("topic_id"), "path", "level")
        return kids.join(names, "topic_id").select("topic_id", F.concat("path", F.lit(sign), "name").alias("path"), (F.col("level") + 1).alias("level"))

    return by_level(links, roots, grow, most)


def closure(edges: DataFrame, most: int = MAX_LEVELS) -> DataFrame:
    """(topic_id, above, distance): every topic with each of its ancestors by primary edges."""
    links = primary(edges).where("parent is not null").distinct()
    first = links.select(F.col("child").alias("topic_id"), F.col("parent").alias("above"), F.lit(1).alias("distance"))
    up = links.select(F.col("child").alias("above"), F.col("parent").alias("next"))
    return by_level(links, first, lambda level: level.join(up, "above").select("topic_id", F.col("next").alias("above"), (F.col("distance") + 1).alias("distance")), most)


def descendants(edges: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(topic_id, n_desc) of topics with any; ``among`` (topic_id) limits which descendants count."""
    pairs = closure(edges)
    if among is not None:
        pairs = pairs.join(among.select("topic_id"), "topic_id", "left_semi")
    return pairs.groupBy(F.col("above").alias("topic_id")).agg(F.count(F.lit(1)).alias("n_desc"))


def clearances(nodes: DataFrame, edges: DataFrame, records: DataFrame) -> DataFrame:
    """(topic_id, clearance): the lowest of a topic's own records; without any, the lowest that its primary children come to; without any below it, its nearest ancestor's that has one; else UNKNOWN.

    A topic with records stands for itself: what lies below it does not change its level, and hides what lies below it from those above.
    """
    own = records.where("topic_id is not null").groupBy("topic_id").agg(F.min("clearance").alias("own"))
    pairs = G.cut(closure(edges))
    # The nearest topics with records below count: those with no other topic with records in between.
    known = own.select("topic_id")
    between = pairs.join(own, "topic_id")  # a topic with records, and all above it
    blocked = pairs.join(known.withColumnRenamed("topic_id", "above"), "above", "left_semi")  # ancestors that have records
    nearest = blocked.groupBy("topic_id").agg(F.min("distance").alias("stop"))
    lifted = between.join(nearest, "topic_id", "left").where(F.col("stop").isNull() | (F.col("distance") < F.col("stop")))
    below = lifted.groupBy(F.col("above").alias("topic_id")).agg(F.min("own").alias("below"))
    derived = G.cut(nodes.select("topic_id").join(own, "topic_id", "left").join(below, "topic_id", "left").select("topic_id", F.coalesce("own", "below").alias("level")))
    above = pairs.join(derived.where("level is not null").select(F.col("topic_id").alias("above"), "level"), "above").groupBy("topic_id").agg(F.min_by("level", "distance").alias("inherited"))
    return derived.join(above, "topic_id", "left").select("topic_id", F.coalesce("level", "inherited", F.lit(UNKNOWN)).alias("clearance"))


def visible(edges: DataFrame, levels: DataFrame, clearance: int) -> DataFrame:
    """(topic_id) of topics that a caller may see: themselves and all above them have a level (topic_id, clearance) of at most theirs."""
    hidden = levels.where(F.col("clearance") > clearance).select("topic_id")
    below = closure(edges).join(hidden.withColumnRenamed("topic_id", "above"), "above", "left_semi").select("topic_id")
    return levels.select("topic_id").join(hidden.unionByName(below).distinct(), "topic_id", "left_anti")


def themes(nodes: DataFrame, edges: DataFrame, records: DataFrame) -> DataFrame:
    """(topic_id, theme): the most frequent console of a topic's records, of equal ones the first by name; without any, that of its nearest ancestor with one; else empty."""
    counts = records.where("topic_id is not null and console is not null and console <> ''").groupBy("topic_id", "console").agg(F.count(F.lit(1)).alias("n"))
    own = counts.groupBy("topic_id").agg(F.min_by("console", F.struct(-F.col("n"), "console")).alias("own"))
    above = closure(edges).join(own.select(F.col("topic_id").alias("above"), "own"), "above").groupBy("topic_id").agg(F.min_by("own", "distance").alias("inherited"))
    return nodes.select("topic_id").join(own, "topic_id", "left").join(above, "topic_id", "left").select("topic_id", F.coalesce("own", "inherited", F.lit("")).alias("theme"))


def shared(nodes: DataFrame, pattern: str, kind: str, unless: str | None = None, most: int = SHARED_LINKS) -> DataFrame:
    """Topics whose names begin with one key, in a chain by id: its first links."""
    keyed = nodes.select("topic_id", F.nullif(F.regexp_extract("name", pattern, 1), F.lit("")).alias("key"), "name").where("key is not null")
    keyed = keyed.where(~F.col("name").rlike(unless)) if unless else keyed
    order = W.partitionBy("key").orderBy("topic_id")
    linked = keyed.select(F.col("topic_id").alias("source"), F.lead("topic_id").over(order).alias("target"), F.row_number().over(order).alias("n"))
    return linked.where(F.col("target").isNotNull() & (F.col("n") <= most)).select("source", "target", F.lit(kind).alias("kind"))


def layer(nodes: DataFrame, edges: DataFrame, records: DataFrame, clearance: int, bridges: DataFrame | None = None, companions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the tree that a caller may see: nodes with theme and n_desc, edges (source, target, kind).

    Kinds: CHILD_OF (roots to their package), SECOND_PARENT, NEXT_TOPIC between siblings by id, SHARED_ALARM and SHARED_MML by names,
    FUNCTIONAL_BRIDGE from ``bridges`` (source_id, target_id), and those of ``companions`` (source, target, kind) between packages.
    """
    levels = G.cut(clearances(nodes, edges, records))
    seen = G.cut(visible(edges, levels, clearance))
    own = nodes.join(seen, "topic_id", "left_semi")
    shown = own.join(themes(nodes, edges, records), "topic_id").join(descendants(edges, seen), "topic_id", "left").fillna(0, ["n_desc"])
    package = lambda c: F.concat(F.lit("p:"), c)
    topic = lambda c: F.concat(F.lit("t:"), c)
    inner = edges.join(seen.withColumnRenamed("topic_id", "child"), "child", "left_semi")
    linked = inner.join(seen.withColumnRenamed("topic_id", "parent"), "parent", "left_semi")
    roots = inner.where("parent is null").select(F.col("child").alias("topic_id")).distinct().join(own.select("topic_id", "package"), "topic_id")
    next_ = W.partitionBy("parent").orderBy("child")
    chain = linked.where("is_primary = 1").select(F.col("child").alias("a"), F.lead("child").over(next_).alias("b")).where("b is not null")
    first = W.partitionBy("package").orderBy("topic_id")
    chain = chain.unionByName(roots.select(F.col("topic_id").alias("a"), F.lead("topic_id").over(first).alias("b")).where("b is not null"))
    parts = [
        roots.select(topic(F.col("topic_id")).alias("source"), package(F.col("package")).alias("target"), F.lit("CHILD_OF").alias("kind")),
        linked.select(topic(F.col("child")).alias("source"), topic(F.col("parent")).alias("target"), F.when(F.col("is_primary") == 1, "CHILD_OF").otherwise("SECOND_PARENT").alias("kind")),
        chain.select(topic(F.col("a")).alias("source"), topic(F.col("b")).alias("target"), F.lit("NEXT_TOPIC").alias("kind")),
    ]
    for found in (shared(own, ALARM, "SHARED_ALARM"), shared(own, COMMAND, "SHARED_MML", unless="^ALM-")):
        parts.append(found.select(topic(F.col("source")).alias("source"), topic(F.col("target")).alias("target"), "kind"))
    if bridges is not None:
        both = bridges.select(F.col("source_id").alias("s"), F.col("target_id").alias("t")).join(seen.withColumnRenamed("topic_id", "s"), "s", "left_semi").join(seen.withColumnRenamed("topic_id", "t"), "t", "left_semi")
        parts.append(both.select(topic(F.col("s")).alias("source"), topic(F.col("t")).alias("target"), F.lit("FUNCTIONAL_BRIDGE").alias("kind")))
    if companions is not None:
        present = own.select(F.col("package").alias("p")).distinct()
        pairs = companions.join(present.withColumnRenamed("p", "source"), "source", "left_semi").join(present.withColumnRenamed("p", "target"), "target", "left_semi")
        parts.append(pairs.select(package(F.col("source")).alias("source"), package(F.col("target")).alias("target"), "kind"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return shown, out


def expand(edges: DataFrame, focus: DataFrame, levels: int) -> DataFrame:
    """(topic_id, level) of the topics of focus (topic_id) and ``levels`` levels of primary children."""
    links = primary(edges).where("parent is not null")
    level = focus.select("topic_id", F.lit(0).alias("level"))
    out = level
    for n in range(1, levels + 1):
        level = G.cut(level.select(F.col("topic_id").alias("parent")).join(links, "parent").select(F.col("child").alias("topic_id"), F.lit(n).alias("level")))
        out = out.unionByName(level)
    return out


def hierarchy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(topic_id, parent, previous, following, n_siblings, n_children) of every topic; siblings in the order of their ids, roots by package."""
    links = primary(edges).join(nodes.select(F.col("topic_id").alias("child"), "package"), "child")
    group = F.coalesce(F.concat(F.lit("t:"), "parent"), F.concat(F.lit("p:"), "package"))
    placed = links.withColumn("group", group)
    order, whole = W.partitionBy("group").orderBy("child"), W.partitionBy("group")
    kids = primary(edges).where("parent is not null").groupBy(F.col("parent").alias("topic_id")).agg(F.count(F.lit(1)).alias("n_children"))
    rows = placed.select(F.col("child").alias("topic_id"), "parent", F.lag("child").over(order).alias("previous"), F.lead("child").over(order).alias("following"), F.count(F.lit(1)).over(whole).alias("n_siblings"))
    return rows.join(kids, "topic_id", "left").fillna(0, ["n_children"])


def children(nodes: DataFrame, edges: DataFrame, of: DataFrame) -> DataFrame:
    """(parent, topic_id, name, depth, child_count) of the primary children of the topics of ``of`` (topic_id)."""
    counts = edges.where("parent is not null").groupBy("parent").agg(F.countDistinct("child").alias("child_count")).withColumnRenamed("parent", "topic_id")
    rows = primary(edges).join(of.select(F.col("topic_id").alias("parent")), "parent", "left_semi").distinct().withColumnRenamed("child", "topic_id")
    return rows.join(nodes.select("topic_id", "name", "depth"), "topic_id").join(counts, "topic_id", "left").fillna(0, ["child_count"]).select("parent", "topic_id", "name", "depth", "child_count")


def catalog(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(package, topic_id, name, topic_count): the roots of each package with the topics below them."""
    roots = primary(edges).where("parent is null").select(F.col("child").alias("topic_id")).distinct()
    return nodes.join(roots, "topic_id", "left_semi").join(descendants(edges), "topic_id", "left").select("package", "topic_id", "name", F.coalesce("n_desc", F.lit(0)).alias("topic_count"))


def find(nodes: DataFrame, asked: DataFrame, limit: int = FIND_LIMIT) -> DataFrame:
    """(question, topic_id, name, how, rank) for asked (question, text): names that equal a text, begin with it, or hold it; then by depth, name and id. Letter case does not count, and no sign is a wildcard.

    Names are looked up through three-letter pieces, so texts of fewer letters are held against all names.
    """
    low = F.lower("name")
    pieces = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 2)), lambda i: F.substring(c, i, F.lit(3))))
    wanted = asked.select("question", F.lower(F.trim("text")).alias("asked")).where("asked <> ''")
    keyed = nodes.select("topic_id", "name", "depth", low.alias("low"))
    long_ = wanted.where("length(asked) >= 3").withColumn("piece", F.substring("asked", 1, 3)).join(keyed.withColumn("piece", F.explode(pieces(F.col("low")))), "piece").drop("piece")
    short = wanted.where("length(asked) < 3").join(keyed, F.contains(keyed["low"], F.col("asked")))
    held = long_.unionByName(short.select(*long_.columns)).where(F.contains("low", "asked"))
    how = F.when(F.col("low") == F.col("asked"), 0).when(F.startswith("low", "asked"), 1).otherwise(2)
    order = W.partitionBy("question").orderBy("how", "depth", "name", "topic_id")
    return held.withColumn("how", how).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("question", "topic_id", "name", "how", "rank")


def prefixes(files: DataFrame, path: Column, label: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the folders and files of a table: each part of a path is a topic below the part before it, the first below a root called ``label``."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    below = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.cast("int").alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("rel"), F.when(n > 0, F.element_at(parts, F.greatest(n, F.lit(1)).cast("int"))).otherwise(F.lit(label)).alias("name"), F.when(n > 0, F.array_join(F.slice(parts, F.lit(1), n - 1), "/")).alias("up")))
    rows = files.select(F.inline(below)).distinct()
    key = lambda c: F.concat(F.lit(f"{label}:path:"), c)
    nodes = rows.select(key(F.col("rel")).alias("topic_id"), F.lit(label).alias("package"), "name", (F.col("depth") + 1).alias("depth")).distinct()
    return nodes, rows.select(key(F.col("rel")).alias("child"), key(F.col("up")).alias("parent"), F.lit(1).alias("is_primary")).distinct()


def assign(records: DataFrame, claims: DataFrame) -> DataFrame:
    """records with the topic of the first claim (id, priority, topic_id) on each; of a topic whose records are none of them native, the first by id becomes it."""
    first = claims.groupBy("id").agg(F.min_by("topic_id", F.struct("priority", "topic_id")).alias("claimed"))
    placed = records.drop("topic_id").join(first, "id", "left").withColumnRenamed("claimed", "topic_id")
    topic = W.partitionBy("topic_id")
    natives = F.max((F.col("record_kind") == "native").cast("int")).over(topic)
    promoted = F.col("topic_id").isNotNull() & (natives == 0) & (F.row_number().over(topic.orderBy("id")) == 1)
    return placed.withColumn("record_kind", F.when(promoted, F.lit("native")).otherwise(F.col("record_kind")))
