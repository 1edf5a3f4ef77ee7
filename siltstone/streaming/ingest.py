"""From a dropped document to its action, in one stream: a batch is classified, indexed, held against the rules, and its actions dispatched.

Each of the four tables is written by batch number and read as it stood before the batch. So a batch that failed after any of its sinks is done
again from the start and leaves what it would have left at once: no document, mention or action is missing or doubled. What a
``deliver`` function sends out of the engine is repeated with such a batch, under the same keys.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intent
from ..functions import text as T
from ..operators import extraction, lifecycle
from ..workspace import Scratch
from .keyed import KeyedTable
from .watch import ACTIONS

PAYLOAD = "doc_id long, seq long, title string, content string, correspondent string, document_type string, tags array<string>, clearance string"
DOCUMENTS = "doc_id long, title string, content string, correspondent string, document_type string, tags array<string>, confidence double, clearance int"
POSTINGS = "entry string, doc_id long, norm string, kind string, name string, n long, clearance int"
BATCHES = "batch long, documents long, postings long, actions long"
SINKS = ("documents", "postings", "actions", "batches")


@dataclass(frozen=True)
class Rules:
    """Phrases by document type, correspondent and tag, and the scanners of mentions."""

    types: Mapping[str, Sequence[str]] = field(default_factory=dict)
    organisations: Mapping[str, Sequence[str]] = field(default_factory=dict)
    tags: Mapping[str, Sequence[str]] = field(default_factory=dict)
    scanners: Sequence[extraction.Scanner] = extraction.SCANNERS


@dataclass(frozen=True)
class Tables:
    documents: KeyedTable
    postings: KeyedTable
    actions: KeyedTable
    batches: KeyedTable


def tables(spark: SparkSession, where: str, **options) -> Tables:
    """The tables below a folder that driver and executors share. Postings are dealt by document, so that those of a batch's documents are found without a look at others."""
    at = lambda name, schema, *keys: KeyedTable(spark, f"{where.rstrip('/')}/{name}", schema, *keys, **options)
    return Tables(at("documents", DOCUMENTS, "doc_id"), at("postings", POSTINGS, "entry", "doc_id"), at("actions", ACTIONS, "key"), at("batches", BATCHES, "batch"))


def described(batch: DataFrame, rules: Rules) -> DataFrame:
    """The documents of a batch (PAYLOAD) as they are held: what the sender says of type and correspondent counts, else what the rules find; tags are of both.

    Rows without doc_id are left out. Of rows that share one, the highest ``seq`` counts (null lowest), and of equal ones the last by their fields. A document without a
    title is called by its id; an unknown clearance is the highest, none is 0.
    """
    columns = [c for c in batch.columns if c not in ("doc_id", "seq")]
    last = batch.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("seq", *columns)).alias("d")).select("doc_id", "d.*")
    given = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    named = last.withColumn("title", F.coalesce(given("title"), F.concat(F.lit("Document-"), "doc_id"))).withColumn("content", F.coalesce("content", F.lit("")))
    found = named.withColumn("c", T.classified(F.col("title"), F.col("content"), rules.types, rules.organisations, rules.tags))
    both = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.coalesce("tags", F.array().cast("array<string>")), "c.tags"))))
    level = F.when(given("clearance").isNull(), 0).otherwise(intent.clearance_level(F.col("clearance"))).cast("int")
    return found.select("doc_id", "title", "content", F.coalesce(given("correspondent"), "c.correspondent").alias("correspondent"), F.coalesce(given("document_type"), "c.document_type").alias("document_type"), both.alias("tags"), F.col("c.confidence").alias("confidence"), level.alias("clearance"))


def indexed(docs: DataFrame, rules: Rules) -> DataFrame:
    """The mentions of documents, one row for each document and entity, with correspondents, types and tags as entities of their own."""
    texts = docs.select("doc_id", F.concat_ws("\n", "title", "content").alias("text"))
    found = extraction.mentions(texts, rules.scanners).groupBy("doc_id", "norm").agg(F.min_by(F.struct("kind", "name"), "first").alias("f"), F.sum("n").alias("n")).select("doc_id", "norm", "f.kind", "f.name", "n")
    label = lambda kind, value: docs.where(value.isNotNull()).select("doc_id", F.concat(F.lit(f"{kind}:"), F.lower(value)).alias("norm"), F.lit(kind).alias("kind"), value.alias("name"), F.lit(1).cast("long").alias("n"))
    tagged = docs.select("doc_id", F.explode("tags").alias("tag")).groupBy("doc_id", F.lower("tag").alias("low")).agg(F.min("tag").alias("tag"))
    tags = tagged.select("doc_id", F.concat(F.lit("tag:"), "low").alias("norm"), F.lit("tag").alias("kind"), F.col("tag").alias("name"), F.lit(1).cast("long").alias("n"))
    every = found.unionByName(label("correspondent", F.col("correspondent"))).unionByName(label("document_type", F.col("document_type"))).unionByName(tags)
    whole = every.groupBy("doc_id", "norm").agg(F.min(F.struct("kind", "name")).alias("f"), F.sum("n").alias("n"))
    return whole.select(F.concat_ws("/", "doc_id", "norm").alias("entry"), "doc_id", "norm", "f.kind", "f.name", "n").join(docs.select("doc_id", "clearance"), "doc_id")


def take(batch: DataFrame, number: int, into: Tables, rules: Rules, today: Column, deliver: Callable[[DataFrame, int], None] | None = None, after: Callable[[str, int], None] | None = None) -> None:
    """One batch through all sinks. ``after`` is called with each sink's name once it is written."""
    spark = batch.sparkSession
    done = after or (lambda sink, n: None)
    with Scratch(spark, f"ingest-{number}") as scratch:
        docs = scratch.put("documents", described(batch, rules))
        into.documents.put(number, docs)
        done("documents", number)
        # A document that comes again loses the mentions that it no longer has.
        posted = scratch.put("postings", indexed(docs, rules))
        old = into.postings.current(before=number, only=docs.select("doc_id"))
        into.postings.put(number, posted, old.select("entry"))
        done("postings", number)
        called = scratch.put("actions", lifecycle.pending_actions(docs, today))
        known = into.actions.current(before=number, only=called.select("key"))
        fresh = scratch.put("fresh", called.join(known.select("key"), "key", "left_anti"))
        if deliver is not None:
            deliver(fresh, number)
        into.actions.put(number, fresh)
        done("actions", number)
        told = docs.select(F.lit("documents").alias("what")).unionByName(posted.select(F.lit("postings").alias("what"))).unionByName(fresh.select(F.lit("actions").alias("what")))
        into.batches.put(number, told.agg(F.lit(number).cast("long").alias("batch"), *(F.count_if(F.col("what") == w).alias(w) for w in SINKS[:3])))
        done("batches", number)


def status(into: Tables) -> DataFrame:
    """(batches, documents, actions) taken in so far, from the table of batches."""
    return into.batches.current().agg(F.count(F.lit(1)).alias("batches"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("actions"), F.lit(0)).alias("actions"))


def ingest(payloads: DataFrame, into: Tables, rules: Rules, today: Column, checkpoint: str, deliver: Callable[[DataFrame, int], None] | None = None, after: Callable[[str, int], None] | None = None):
    """A stream of payloads (PAYLOAD, as ``watch.webhook`` reads them from a folder of JSON lines) taken in batch by batch."""
    return payloads.writeStream.foreachBatch(lambda batch, number: take(batch, number, into, rules, today, deliver, after)).option("checkpointLocation", checkpoint)
