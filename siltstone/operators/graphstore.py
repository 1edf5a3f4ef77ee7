"""An entity graph as four tables, its lifecycle, and reads of it.

documents (doc_id, identifier, title, created, clearance), entities (norm, name, kind, clearance), postings (doc_id, norm, n, context)
and relations (source, target, relation, doc_id, clearance). Entities are named by their normalised name: the kind of its first mention
counts, and the highest clearance. Relations are told apart by all four keys, where a null document is a value like any other; the last
clearance counts. Each function takes and returns tables, so a caller decides what is written, and where.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graph as G

# Fixed values.
RELATION_KEYS = ("source", "target", "relation", "doc_id")
MAX_COUNTERS, MAX_NEIGHBOURS = 8, 24
#: Documents that go, for each task that takes them out.
GONE_ROWS = 100_000
#: Documents and entities of both graphs, for each task that merges them.
MERGED_ROWS = 100_000
PRIORITIES = (("DIAGNOSED_BY_MML", 0), ("REMEDIATED_BY_MML", 1), ("CONFIGURED_BY_MML", 2), ("DIAGRAM", 3), ("AUTO_HEALING|SWITCHOVER|AFFECTS_NE|CAUSED_BY|CANONICAL", 4))
KEY_COUNTERS = "RTR|AAD|ADEV|SCTP|THRESHOLD|DELAY|SUCCESS"
BUCKETS = (("DIAGNOSED_BY_MML", "DIAGNOSED_BY_MML"), ("REMEDIATED_BY_MML|CONFIGURED_BY_MML", "REMEDIATED_BY_MML"), ("MEASURED_BY_COUNTER", "MEASURED_BY_COUNTER"), ("DIAGRAM", "HAS_DIAGRAM"), ("AFFECTS_NE|DEFINES_ALARM|ADAPTATION", "AFFECTS_NE"))


@dataclass(frozen=True)
class Graph:
    documents: DataFrame
    entities: DataFrame
    postings: DataFrame
    relations: DataFrame


def resolve(found: DataFrame) -> DataFrame:
    """Mentions (norm, kind, name, clearance, seq) to entities. Of one normalised name, the first kind and name by ``seq`` count, and the highest clearance."""
    first = F.min_by(F.struct("kind", "name"), "seq")
    return found.where("norm is not null").groupBy("norm").agg(first.alias("f"), F.max("clearance").alias("clearance")).select("norm", F.col("f.name").alias("name"), F.col("f.kind").alias("kind"), "clearance")


def latest(rows: DataFrame, keys: tuple[str, ...], order: str = "seq") -> DataFrame:
    """One row per key, that of the highest ``order``: the last writer wins. Nulls are values like any other."""
    ranked = W.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(ranked)).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """old with the rows of new put in their place; of rows that share a key, new ones count."""
    same = F.lit(True)
    taken = new.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return old.join(taken, same, "left_anti").unionByName(new)


def index(graph: Graph, documents: DataFrame, found: DataFrame, edges: DataFrame) -> Graph:
    """Documents (as the table), mentions (doc_id, norm, kind, name, n, context, clearance, seq) and edges (RELATION_KEYS, clearance, seq) put into the graph.

    A document that is known is indexed anew: its own postings and relations go first. Entities keep their kind and name.
    """
    renewed = documents.select("doc_id").distinct()
    old_postings, old_relations = (t.join(renewed, "doc_id", "left_anti").select(*t.columns) for t in (graph.postings, graph.relations))
    known = graph.entities.withColumn("seq", F.lit(-1).cast("long"))
    entities = resolve(known.unionByName(found.select("norm", "name", "kind", "clearance", F.col("seq").cast("long").alias("seq"))))
    postings = found.groupBy("doc_id", "norm").agg(F.sum("n").alias("n"), F.min_by("context", "seq").alias("context"))
    return Graph(
        upsert(graph.documents, latest(documents.withColumn("seq", F.lit(0)), ("doc_id",)).drop("seq"), ("doc_id",)),
        entities,
        old_postings.unionByName(postings),
        upsert(old_relations, latest(edges, RELATION_KEYS).select(*RELATION_KEYS, "clearance"), RELATION_KEYS),
    )


def sweep(graph: Graph) -> Graph:
    """Without entities that neither a posting nor a relation names."""
    used = graph.postings.select("norm").unionByName(graph.relations.select(F.col("source").alias("norm"))).unionByName(graph.relations.select(F.col("target").alias("norm"))).where("norm is not null").distinct()
    return replace(graph, entities=graph.entities.join(used, "norm", "left_semi"))


def delete_documents(graph: Graph, gone: DataFrame, orphans: bool = True) -> Graph:
    """Without the documents (doc_id), their postings and relations and, if asked for, entities that nothing names any more."""
    ids = gone.select("doc_id").where("doc_id is not null").distinct()
    # Beyond GONE_ROWS both sides are dealt to as many tasks as their number asks for: partitions sized by their compressed bytes hold more rows the better these compress.
    parts = -(-ids.count() // GONE_ROWS)
    dealt = lambda t: t.repartition(max(parts, t.sparkSession.sparkContext.defaultParallelism), "doc_id") if parts > 1 else t
    without = lambda t, own: t.join(own, "doc_id", "left_anti").select(*t.columns)
    # Relations are left to the optimizer: most have no document, and would meet in one task.
    left = Graph(without(dealt(graph.documents), dealt(ids)), graph.entities, without(dealt(graph.postings), dealt(ids)), without(graph.relations, ids))
    return sweep(left) if orphans else left


def purge_prefix(graph: Graph, prefix: str) -> Graph:
    """Without documents whose identifier begins with ``prefix``; letter case does not count, wildcards are plain characters."""
    return delete_documents(graph, graph.documents.where(F.lower("identifier").startswith(prefix.lower())))


def merge(left: Graph, right: Graph) -> Graph:
    """Both graphs as one. Fields of the right count where they are set; of postings, the higher count.

    Tasks follow the number of documents and entities: partitions sized by their compressed bytes hold more rows the better these compress.
    """
    seq = lambda t, n: t.withColumn("seq", F.lit(n).cast("long"))
    parts = -(-sum(t.count() for g in (left, right) for t in (g.documents, g.entities)) // MERGED_ROWS)
    # Dealt before the aggregates, which sort their rows, so that these are dealt and sorted once and not by what a split of a file holds.
    dealt = lambda t, *keys: t.repartition(max(parts, t.sparkSession.sparkContext.defaultParallelism), *keys) if parts > 1 else t
    both_of = lambda name, *keys: dealt(seq(getattr(left, name), 0).unionByName(seq(getattr(right, name), 1)), *keys)
    columns = left.documents.columns
    both = dealt(left.documents, "doc_id").alias("l").join(dealt(right.documents, "doc_id").alias("r"), "doc_id", "full_outer")
    documents = both.select("doc_id", *(F.coalesce(F.col(f"r.{c}"), F.col(f"l.{c}")).alias(c) for c in columns if c != "doc_id"))
    postings = both_of("postings", "doc_id", "norm").groupBy("doc_id", "norm").agg(F.max("n").alias("n"), F.min_by("context", "seq").alias("context"))
    # A window, unlike a join, reads the left once and takes nulls for values.
    known = F.min("seq").over(W.partitionBy(*RELATION_KEYS))
    relations = both_of("relations", *RELATION_KEYS).withColumn("__known", known).where((F.col("seq") == 0) | (F.col("__known") == 1)).select(*left.relations.columns)
    return Graph(documents.select(*columns), resolve(both_of("entities", "norm")), postings, relations)


# Reads.


def find_entities(graph: Graph, names: DataFrame, aliases: Mapping[str, str] | None = None, clearance: int = 3) -> DataFrame:
    """(question, name) to (question, norm, step): by alias, else by name, else the entity that holds the name, else the longest that the name holds.

    Ties: of entities that hold it, more documents, then shorter names; of those held, longer names, then more documents; then by name.
    Containment is looked up by whole substrings of the lengths that occur on the other side, so a join meets only what it finds: common pieces bring
    no pairs. Each text is answered once, however many questions ask it, and only texts that no name equals look for containment.
    """
    aliases = {k.lower(): v.lower() for k, v in (aliases or {}).items()}
    seen = graph.entities.where(F.col("clearance") <= clearance).join(graph.postings.groupBy("norm").agg(F.countDistinct("doc_id").alias("docs")), "norm", "left").select("norm", F.lower("name").alias("low"), F.coalesce("docs", F.lit(0)).alias("docs"))
    asked = names.select("question", F.lower(F.trim("name")).alias("asked")).where("asked <> ''").distinct()
    texts = asked.select("asked").distinct()
    mapped = F.element_at(F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair)), F.col("asked")) if aliases else F.lit(None).cast("string")
    keyed = seen.select("norm", "docs", F.explode(F.array_distinct(F.array("norm", "low"))).alias("key"))
    equal = lambda key, step: texts.withColumn("key", key).where("key is not null").join(keyed, "key").select("asked", "norm", "docs", F.lit(step).alias("step"))
    named = G.cut(equal(mapped, 1).unionByName(equal(F.col("asked"), 2)))
    others = G.cut(texts.join(named, "asked", "left_anti"))
    held_by = seen.select("norm", "docs").where("norm is not null")
    lengths = lambda t, column, least: t.select(F.length(column).alias("n")).where(F.col("n") >= least).agg(F.collect_set("n").alias("lengths"))

    def parts(text: str) -> Column:
        """The distinct substrings of a text that have one of ``lengths``."""
        fit = F.filter("lengths", lambda n: n <= F.length(text))
        return F.explode(F.array_distinct(F.flatten(F.transform(fit, lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(F.col(text), i, n))))))

    holding = held_by.crossJoin(F.broadcast(lengths(others, "asked", 1))).select("norm", "docs", parts("norm").alias("asked")).join(others, "asked").select("asked", "norm", "docs", F.lit(3).alias("step"))
    held = others.crossJoin(F.broadcast(lengths(held_by, "norm", 3))).select("asked", parts("asked").alias("norm")).join(held_by, "norm").select("asked", "norm", "docs", F.lit(4).alias("step"))
    size = F.length("norm")
    order = F.struct("step", F.when(F.col("step") == 4, -size).otherwise(F.lit(0)).alias("longest"), (-F.col("docs")).alias("most"), F.when(F.col("step") == 3, size).otherwise(F.lit(0)).alias("shortest"), "norm")
    best = named.unionByName(holding).unionByName(held).groupBy("asked").agg(F.min(order).alias("best"))
    return asked.join(best, "asked").withColumn("__n", F.row_number().over(W.partitionBy("question").orderBy("best"))).where("__n = 1").select("question", F.col("best.norm").alias("norm"), F.col("best.step").alias("step"))


def visible(graph: Graph, clearance: int) -> DataFrame:
    """Relations whose ends and themselves the caller may see."""
    seen = graph.entities.where(F.col("clearance") <= clearance).select("norm")
    edges = graph.relations.where(F.col("clearance") <= clearance)
    return edges.join(seen.withColumnRenamed("norm", "source"), "source", "left_semi").join(seen.withColumnRenamed("norm", "target"), "target", "left_semi")


def neighbourhood(graph: Graph, starts: DataFrame, depth: int = 2, clearance: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (norm, level), edges between them and documents that name them, of what the caller may see within ``depth`` edges of starts (norm)."""
    edges = visible(graph, clearance)
    shaped = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), "relation")
    first = starts.select(F.col("norm").alias("node")).join(graph.entities.where(F.col("clearance") <= clearance).select(F.col("norm").alias("node")), "node", "left_semi")
    nodes = G.neighbourhood(shaped, first, depth).select(F.col("node").alias("norm"), "level")
    ends = lambda name: nodes.select(F.col("norm").alias(name), F.col("level").alias(f"{name}_level"))
    inner = edges.join(ends("source"), "source").join(ends("target"), "target").where(F.least("source_level", "target_level") < depth).select("source", "target", "relation", F.least("source_level", "target_level").alias("level")).distinct()
    allowed = graph.documents.where(F.col("clearance") <= clearance)
    docs = allowed.join(graph.postings.join(nodes.select("norm"), "norm", "left_semi").select("doc_id").distinct(), "doc_id", "left_semi")
    return nodes, inner, docs


def paths(graph: Graph, starts: DataFrame, targets: DataFrame, depth: int = 4, clearance: int = 3) -> DataFrame:
    """(norm, level, steps): a shortest path from starts (norm) to each target (norm), as node and relation in turn; edges read backwards are marked ``(rev)``. Of several, the first in string order."""
    edges = visible(graph, clearance).select(F.col("source").alias("src"), F.col("target").alias("dst"), "relation")
    return G.trails(edges, starts.select(F.col("norm").alias("node")), targets.select(F.col("norm").alias("node")), depth).select(F.col("node").alias("norm"), "level", F.col("trail").alias("steps"))


def query_relations(graph: Graph, source: str | None = None, target: str | None = None, relation: str | None = None, clearance: int = 3) -> DataFrame:
    """Named relations that fit what is given; letter case of names does not count."""
    edges = visible(graph, clearance)
    name = lambda side: graph.entities.select(F.col("norm").alias(side), F.col("name").alias(f"{side}_name"))
    rows = edges.join(name("source"), "source").join(name("target"), "target")
    for side, wanted in (("source", source), ("target", target)):
        if wanted is not None:
            rows = rows.where((F.lower(f"{side}_name") == wanted.lower()) | (F.col(side) == wanted.lower()))
    return rows.where(F.col("relation") == relation) if relation is not None else rows


def dossiers(graph: Graph, names: DataFrame, clearance: int = 3) -> DataFrame:
    """For each entity (norm): its documents, their dates and amounts (each once), the sum of amounts, and the other entities in them by kind."""
    allowed = graph.documents.where(F.col("clearance") <= clearance).select("doc_id")
    seen = graph.entities.where(F.col("clearance") <= clearance).select("norm", "kind", "name")
    root = graph.postings.join(names.select("norm").distinct(), "norm", "left_semi").join(allowed, "doc_id", "left_semi").select(F.col("norm").alias("root"), "doc_id").distinct()
    together = root.join(graph.postings.select("doc_id", "norm").distinct().join(seen, "norm"), "doc_id").groupBy("root", "norm", "kind", "name").agg(F.count(F.lit(1)).alias("shared"))
    value = F.regexp_replace(F.regexp_replace("name", r"[^\d,]", ""), ",", ".").try_cast("double")
    of_kind = lambda k, what: F.array_sort(F.collect_set(F.when(F.col("kind") == k, what)))
    facts = together.groupBy("root").agg(
        of_kind("date", F.col("norm")).alias("dates"),
        of_kind("monetary", F.when(value > 0, F.col("name"))).alias("amounts"),
        F.round(F.coalesce(F.sum(F.when((F.col("kind") == "monetary") & (value > 0), value)), F.lit(0.0)), 2).alias("total_amount"),
    )
    others = together.where(~F.col("kind").isin("date", "monetary") & (F.col("norm") != F.col("root"))).groupBy("root", "kind").agg(F.array_sort(F.collect_list("name")).alias("names"))
    connected = others.groupBy("root").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "names")))).alias("connected"))
    counts = root.groupBy("root").agg(F.count(F.lit(1)).alias("n_documents"))
    return names.select(F.col("norm").alias("root")).distinct().join(counts, "root", "left").join(facts, "root", "left").join(connected, "root", "left").select(F.col("root").alias("norm"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), "dates", "amounts", F.coalesce("total_amount", F.lit(0.0)).alias("total_amount"), "connected")


def statistics(graph: Graph) -> DataFrame:
    """(what, kind, n): documents and relations in all, entities by kind."""
    count = lambda t, what: t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), F.lit(None).cast("string").alias("kind"), "n")
    kinds = graph.entities.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("entities").alias("what"), "kind", "n")
    return count(graph.documents, "documents").unionByName(count(graph.relations, "relations")).unionByName(kinds)


def relation_priority(relation: Column, name: Column) -> Column:
    """The order in which a neighbour's relation is shown, from 0."""
    out = F.lit(None).cast("int")
    rules = [(F.upper(relation).rlike(p), F.lit(n)) for p, n in PRIORITIES] + [(F.upper(relation).contains("MEASURED_BY_COUNTER"), F.when(F.upper(name).rlike(KEY_COUNTERS), F.lit(5)).otherwise(F.lit(6)))]
    for test, value in reversed(rules):
        out = F.when(test, value).otherwise(F.coalesce(out, F.lit(7)))
    return out


def enriched(graph: Graph, starts: DataFrame, clearance: int = 3) -> DataFrame:
    """(root, relation, direction, norm, name, priority, bucket): neighbours of starts (norm) by priority and name, each relation and name once.

    Of counters the first MAX_COUNTERS stay, and then MAX_NEIGHBOURS of all.
    """
    edges = visible(graph, clearance)
    out = edges.select(F.col("source").alias("root"), "relation", F.lit("outgoing").alias("direction"), F.col("target").alias("norm"))
    back = edges.select(F.col("target").alias("root"), "relation", F.lit("incoming").alias("direction"), F.col("source").alias("norm"))
    near = out.unionByName(back).join(starts.select(F.col("norm").alias("root")).distinct(), "root", "left_semi").join(graph.entities.select("norm", "name"), "norm")
    once = near.groupBy("root", "relation", "name").agg(F.min(F.struct("direction", "norm")).alias("f")).select("root", "relation", "name", "f.*").withColumn("priority", relation_priority(F.col("relation"), F.col("name")))
    order = W.partitionBy("root").orderBy("priority", "name", "relation")
    counters = F.sum((F.col("relation") == "MEASURED_BY_COUNTER").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    kept = once.withColumn("__c", counters).where((F.col("relation") != "MEASURED_BY_COUNTER") | (F.col("__c") <= MAX_COUNTERS)).drop("__c")
    bucket = F.lit(None).cast("string")
    for pattern, label in reversed(BUCKETS):
        bucket = F.when(F.col("relation").rlike(pattern), F.lit(label)).otherwise(F.coalesce(bucket, F.lit("CAUSED_BY")))
    ranked = kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= MAX_NEIGHBOURS)
    return ranked.withColumn("bucket", bucket).select("root", "relation", "direction", "norm", "name", "priority", "bucket", "place")


def ordered_path(graph: Graph, steps: DataFrame) -> DataFrame:
    """(path, step, source, target) to (path, step, source, via, target, first_relation, second_relation): each pair's direct relation, else the first bridge of two."""
    both = G.both_ways(graph.relations.select(F.col("source").alias("src"), F.col("target").alias("dst"), "relation"))
    asked = steps.select("path", "step", "source", "target")
    direct = asked.join(both, (F.col("source") == F.col("node")) & (F.col("target") == F.col("next"))).select("path", "step", "source", "target", F.lit(None).cast("string").alias("via"), F.col("relation").alias("first_relation"), F.lit(None).cast("string").alias("second_relation"))
    rest = asked.join(direct.select("path", "step").distinct(), ["path", "step"], "left_anti")
    onward = both.select(F.col("node").alias("via"), F.col("next").alias("target"), F.col("relation").alias("second_relation"))
    bridged = rest.join(both.select(F.col("node").alias("source"), F.col("next").alias("via"), F.col("relation").alias("first_relation")), "source").join(onward, ["via", "target"])
    best = bridged.where((F.col("via") != F.col("source")) & (F.col("via") != F.col("target"))).groupBy("path", "step", "source", "target").agg(F.min(F.struct("via", "first_relation", "second_relation")).alias("b")).select("path", "step", "source", "target", "b.*")
    return direct.select(*best.columns).unionByName(best)
