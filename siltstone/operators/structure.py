"""A registry of structure extractors: each reads one kind of source into topics and places the records of that source.

An extractor is a name, a priority and four functions: ``detect`` (can it read this source?), ``claims`` (a condition on records), ``assign`` (the claimed records with
topic_id, record_kind, console and review) and ``tree`` (nodes and edges of the source). Of the extractors that detect a source, the lowest priority
counts, then the name. A record goes to the first source, in the order given, that claims it. Sources are few and named by the caller; records are a table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tree as T

# Fixed values.
NATIVE, COMPOSITE, EXTERNAL = "native", "composite", "external"


@dataclass(frozen=True)
class Source:
    """A labelled place of records; ``contents`` (page, topic, parent, name, place) is its table of contents, if it has one."""

    label: str
    uri: str
    contents: DataFrame | None = None


@dataclass(frozen=True)
class Extractor:
    name: str
    priority: int
    detect: Callable[[Source], bool]
    claims: Callable[[Source], Column]
    assign: Callable[[DataFrame, Source], DataFrame]
    tree: Callable[[DataFrame, Source], tuple[DataFrame, DataFrame]]


REGISTRY: dict[str, Extractor] = {}


def register(extractor: Extractor) -> Extractor:
    """Adds an extractor; a name that is taken raises ValueError."""
    if extractor.name in REGISTRY:
        raise ValueError(f"extractor {extractor.name} is registered")
    REGISTRY[extractor.name] = extractor
    return extractor


def extractor_for(source: Source, registry: dict[str, Extractor] | None = None) -> Extractor:
    """The extractor of a source; ValueError if none detects it."""
    found = [e for e in (REGISTRY if registry is None else registry).values() if e.detect(source)]
    if not found:
        raise ValueError(f"no extractor reads {source.uri}")
    return min(found, key=lambda e: (e.priority, e.name))


@dataclass(frozen=True)
class Structure:
    """records (id, label, topic_id, record_kind, console, review), nodes and edges as of the topic tree."""

    records: DataFrame
    nodes: DataFrame
    edges: DataFrame


def apply(records: DataFrame, sources: Sequence[Source], registry: dict[str, Extractor] | None = None) -> Structure:
    """Places records (id, uri, ...) in the trees of their sources.

    A record that no source claims is external and has no topic. Of a topic none of whose records is native, the first by id becomes it.
    """
    chosen = [(s, extractor_for(s, registry)) for s in sources]
    label = F.coalesce(*(F.when(e.claims(s), F.lit(s.label)) for s, e in chosen), F.lit(None).cast("string"))
    marked = records.select("id", "uri").withColumn("label", label)
    columns = ("id", "label", "topic_id", "record_kind", "console", "review")
    none = F.lit(None).cast("string")
    placed = marked.where("label is null").select("id", "label", none.alias("topic_id"), F.lit(EXTERNAL).alias("record_kind"), none.alias("console"), F.lit("").alias("review"))
    nodes = edges = None
    for source, extractor in chosen:
        claimed = marked.where(F.col("label") == source.label)
        placed = placed.unionByName(extractor.assign(claimed, source).select(*columns))
        n, e = extractor.tree(claimed, source)
        nodes = n if nodes is None else nodes.unionByName(n)
        edges = e if edges is None else edges.unionByName(e)
    # One row per topic, so that a topic of any number of records meets in partial counts and not in one task.
    topics = placed.where("topic_id is not null").groupBy("topic_id").agg(F.max((F.col("record_kind") == NATIVE).cast("int")).alias("natives"), F.min("id").alias("first"))
    promoted = topics.where("natives = 0").select(F.col("first").alias("id"), F.lit(True).alias("promoted"))
    kept = placed.join(promoted, "id", "left").withColumn("record_kind", F.when(F.col("promoted"), NATIVE).otherwise(F.col("record_kind")))
    return Structure(kept.select(*columns), nodes, edges)


def report(found: Structure) -> DataFrame:
    """(label, record_kind, review, n, topics) of placed records, for people who look them through."""
    return found.records.groupBy("label", "record_kind", "review").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("topic_id").alias("topics"))


def _path(source: Source) -> Column:
    """A record's path below its source, without fragment."""
    below = F.substring(F.col("uri"), len(source.uri) + 1, 1 << 30)
    return F.regexp_replace(F.split(below, "#", 2)[0], "^/+", "")


def _within(source: Source) -> Column:
    return F.col("uri").startswith(source.uri)


def _by_folder(records: DataFrame, source: Source) -> DataFrame:
    topic = F.concat(F.lit(f"{source.label}:path:"), _path(source))
    whole = ~F.col("uri").contains("#")
    return records.select("id", "label", topic.alias("topic_id"), F.when(whole, NATIVE).otherwise(COMPOSITE).alias("record_kind"), F.lit(None).cast("string").alias("console"), F.lit("").alias("review"))


def _folders(records: DataFrame, source: Source) -> tuple[DataFrame, DataFrame]:
    return T.prefixes(records.select(_path(source).alias("path")).distinct(), F.col("path"), source.label)


def _page(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def _listed(source: Source) -> DataFrame:
    """(page, topic) of the contents: a page that is listed more than once belongs to its first place."""
    rows = source.contents.where("page is not null").select(_page(F.col("page")).alias("page"), "topic", "place")
    return rows.groupBy("page").agg(F.min_by("topic", F.struct("place", "topic")).alias("topic"))


def _by_contents(records: DataFrame, source: Source) -> DataFrame:
    looked = records.withColumn("page", _page(_path(source))).join(_listed(source), "page", "left")
    found = F.col("topic").isNotNull()
    topic = F.when(found, F.concat(F.lit(f"{source.label}:"), F.col("topic").cast("string")))
    kind = F.when(found & ~F.col("uri").contains("#"), NATIVE).otherwise(COMPOSITE)
    return looked.select("id", "label", topic.alias("topic_id"), kind.alias("record_kind"), F.lit(None).cast("string").alias("console"), F.when(found, "").otherwise("page not listed").alias("review"))


def _contents(_: DataFrame, source: Source) -> tuple[DataFrame, DataFrame]:
    """Topics of the contents with their depth, walked level by level; the first place of a topic is its primary edge."""
    key = lambda c: F.concat(F.lit(f"{source.label}:"), F.col(c).cast("string"))
    first = W.partitionBy("topic").orderBy("place", "parent")
    rows = source.contents.where("topic is not null").withColumn("n", F.row_number().over(first))
    edges = rows.groupBy(key("topic").alias("child"), key("parent").alias("parent")).agg(F.max((F.col("n") == 1).cast("int")).alias("is_primary"))
    names = rows.where("n = 1").select(key("topic").alias("topic_id"), F.coalesce("name", F.col("topic").cast("string")).alias("name"))
    placed = names.join(T.paths(names, edges).select("topic_id", "level"), "topic_id")
    return placed.select("topic_id", F.lit(source.label).alias("package"), "name", (F.col("level") + 1).alias("depth")), edges


CONTENTS = register(Extractor("contents", 10, lambda s: s.contents is not None, _within, _by_contents, _contents))
FOLDERS = register(Extractor("folders", 100, lambda s: s.uri == "" or s.uri.endswith("/"), _within, _by_folder, _folders))
