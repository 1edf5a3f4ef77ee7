"""The life of records: ownership of what a file gave, decisions on files that come again, upserts, purges and moves.

Records are (id, doc_identifier, title, content, clearance, topic_id, virtual_uri, source_sha256); functions take and return tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph as G

# Fixed values.
MODES = ("missing", "changed", "grow", "replace")
GROWTH = 1.5
MAX_FILES, MAX_CHARS = 80, 12_000
BATCH = 12
DIAGNOSTIC = "DSP LST PING TRC".split()


def owner(identifier: Column) -> Column:
    """The file that a record's identifier belongs to: what stands before ``::`` or the mark of a part."""
    return F.regexp_extract(identifier, r"^(.*?)(?:::.*)?$", 1)


def owned(records: DataFrame, uris: DataFrame) -> DataFrame:
    """(uri, *records): records that a file (uri) gave: of that identifier, or of one that goes on with ``::`` or ``#``. Joined on all prefixes of an identifier that end there, so no ranges are compared."""
    marks = F.concat(F.array("doc_identifier"), F.transform(F.filter(F.sequence(F.lit(1), F.length("doc_identifier")), lambda i: F.startswith(F.substr("doc_identifier", i), F.lit("::")) | F.startswith(F.substr("doc_identifier", i), F.lit("#"))), lambda i: F.substring("doc_identifier", 1, i - 1)))
    keyed = records.withColumn("uri", F.explode(F.array_distinct(marks)))
    return keyed.join(uris.select("uri").distinct(), "uri", "left_semi")


def decide(files: DataFrame, records: DataFrame, mode: str = "changed") -> DataFrame:
    """(uri, decision, new_chars, old_chars) for files (uri, sha256, format, new_chars): ``ingest``, or why not. A file without a format is unsupported."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    held = owned(records, files).groupBy("uri").agg(F.sum(F.length("content")).alias("old_chars"), F.collect_set("source_sha256").alias("__known"))
    rows = files.join(held, "uri", "left")
    known = F.col("old_chars").isNotNull()
    skip = {
        "missing": F.when(known, "exists"),
        "changed": F.when(known & F.coalesce(F.array_contains("__known", F.col("sha256")), F.lit(False)), "unchanged"),
        "grow": F.when(known & (F.col("new_chars") <= GROWTH * F.col("old_chars")), "not larger"),
        "replace": F.lit(None).cast("string"),
    }[mode]
    return rows.select("uri", F.when(F.col("format").isNull(), "unsupported").otherwise(F.coalesce(skip, F.lit("ingest"))).alias("decision"), "new_chars", F.coalesce("old_chars", F.lit(0)).alias("old_chars"))


def ingest(records: DataFrame, files: DataFrame, chunks: DataFrame, mode: str = "changed", dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, report): records of files that are to be ingested replaced by chunks (uri, *records columns); the report counts files, characters in and out by decision.

    With ``dry_run`` the records stay as they are and only the report is made.
    """
    decisions = G.cut(decide(files, records, mode))
    report = decisions.groupBy("decision").agg(F.count(F.lit(1)).alias("files"), F.sum("new_chars").alias("new_chars"), F.sum("old_chars").alias("old_chars"))
    if dry_run:
        return records, report
    taken = decisions.where("decision = 'ingest'").select("uri")
    gone = owned(records, taken).select("id").distinct()
    fresh = chunks.join(taken, "uri", "left_semi").select(*records.columns)
    return records.join(gone, "id", "left_anti").unionByName(fresh), report


def purge_document(records: DataFrame, nodes: DataFrame, edges: DataFrame, bridges: DataFrame, vectors: DataFrame, uri: str, most: int = 200) -> dict[str, DataFrame]:
    """All five tables without a file: its records, topics that are left without records and children, their edges, and bridges and vectors of what is gone.

    Topics are pruned from the leaves up until nothing changes; only those above the file's records can go.
    """
    file = uri.replace("\\", "/")
    base = file.rsplit("/", 1)[-1]
    name, where = F.col("doc_identifier"), F.col("virtual_uri")
    fits = (name == file) | name.startswith(file + "::") | name.startswith(file + "#") | name.endswith("#" + file) | name.endswith("/" + base)
    fits = fits | F.coalesce((where == file) | where.endswith("/" + base), F.lit(False))
    gone = G.cut(records.where(F.coalesce(fits, F.lit(False))).select("id", "topic_id"))
    left = records.join(gone.select("id"), "id", "left_anti")
    full = left.where("topic_id is not null").select("topic_id").distinct()
    named = nodes.where(F.col("topic_id").contains(":path:") & F.col("topic_id").contains(base) | F.col("topic_id").contains("#" + base) | (F.col("name") == base)).select("topic_id")
    candidates = G.cut(gone.where("topic_id is not null").select("topic_id").unionByName(named).distinct())
    dropped = candidates.limit(0)
    for _ in range(most):
        links = edges.join(dropped.withColumnRenamed("topic_id", "child"), "child", "left_anti")
        parents = links.where("parent is not null").select(F.col("parent").alias("topic_id")).distinct()
        empty = G.cut(candidates.join(dropped, "topic_id", "left_anti").join(full, "topic_id", "left_anti").join(parents, "topic_id", "left_anti"))
        if empty.isEmpty():
            break
        dropped = G.cut(dropped.unionByName(empty))
        above = edges.join(empty.withColumnRenamed("topic_id", "child"), "child", "left_semi").where("parent is not null").select(F.col("parent").alias("topic_id"))
        candidates = G.cut(candidates.unionByName(above).distinct())
    else:
        raise RuntimeError(f"deeper than {most} levels")
    kept_nodes = nodes.join(dropped, "topic_id", "left_anti")
    here = lambda c: kept_nodes.select(F.col("topic_id").alias(c))
    kept_edges = edges.join(here("child"), "child", "left_semi")
    kept_edges = kept_edges.where("parent is null").unionByName(kept_edges.where("parent is not null").join(here("parent"), "parent", "left_semi").select(*kept_edges.columns))
    return {
        "records": left,
        "nodes": kept_nodes,
        "edges": kept_edges,
        "bridges": bridges.join(dropped.withColumnRenamed("topic_id", "source_id"), "source_id", "left_anti").join(dropped.withColumnRenamed("topic_id", "target_id"), "target_id", "left_anti"),
        "vectors": vectors.join(gone.select("id"), "id", "left_anti"),
    }


def purge_prefix(records: DataFrame, prefix: str, columns: tuple[str, ...] = ("doc_identifier", "metadata")) -> tuple[DataFrame, DataFrame]:
    """(kept, purged): records any of whose columns holds the text. Letter case does not count; wildcards are plain characters; null holds nothing."""
    low = prefix.lower()
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(column)), F.lit(low)), F.lit(False))
    return records.where(~hit), records.where(hit)


def relocate(records: DataFrame, old: str, new: str, columns: tuple[str, ...] = ("doc_identifier", "virtual_uri")) -> DataFrame:
    """records with ``old`` at the start of a column's text replaced by ``new``."""
    out = records
    for column in columns:
        c = F.col(column)
        out = out.withColumn(column, F.when(c.startswith(old), F.concat(F.lit(new), F.substr(c, F.lit(len(old) + 1)))).otherwise(c))
    return out


def statistics(records: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("content")), 6).alias("mean_length"), F.max(F.length("content")).alias("max_length"), F.countDistinct("topic_id").alias("topics"))


def capped_sync(files: DataFrame, most_files: int = MAX_FILES, most_chars: int = MAX_CHARS) -> DataFrame:
    """The first files of each source (source, path, text) by path, each cut at a number of characters, with ``truncated``. This cap is what the operator is for."""
    order = W.partitionBy("source").orderBy("path")
    first = files.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most_files).drop("__n")
    return first.withColumn("truncated", F.length("text") > most_chars).withColumn("text", F.substring("text", 1, most_chars))


def remove_source(records: DataFrame, source: str) -> DataFrame:
    """Without the records of a watched source: those whose address lies in it."""
    path = source.rstrip("/") + "/"
    return records.where(~F.coalesce(F.col("virtual_uri").startswith(path) | (F.col("virtual_uri") == source), F.lit(False)))


def sync(held: DataFrame, files: DataFrame) -> DataFrame:
    """(path, state) of added, deleted and modified files between two snapshots (path, sha256)."""
    both = held.select("path", F.col("sha256").alias("old")).join(files.select("path", F.col("sha256").alias("new")), "path", "full_outer")
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return both.select("path", state.alias("state")).where("state is not null")


def file_hashes(files: DataFrame) -> DataFrame:
    """(path, sha256) of binary files."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def enrich(records: DataFrame, texts: DataFrame) -> DataFrame:
    """records with the longer of their content and a new text (doc_identifier, text); ``enriched`` tells which."""
    best = texts.groupBy("doc_identifier").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("__text"))
    longer = F.coalesce(F.length("__text") > F.length(F.coalesce("content", F.lit(""))), F.lit(False))
    return records.join(best, "doc_identifier", "left").withColumn("enriched", longer).withColumn("content", F.when(longer, F.col("__text")).otherwise(F.col("content"))).drop("__text")


def command_class(command: Column) -> Column:
    """``diagnostic`` or ``remediation``, by a command's verb; null for other texts."""
    verb = F.regexp_extract(F.upper(command), r"^\s*([A-Z]{2,6})\s+[A-Z0-9_]+", 1)
    return F.when(verb.isin(DIAGNOSTIC), "diagnostic").when(verb != "", "remediation")


def row_batches(rows: DataFrame, key: str, order: str, size: int = BATCH) -> DataFrame:
    """(key, batch, n, first, last): ordered rows of a key in batches."""
    place = F.row_number().over(W.partitionBy(key).orderBy(order)) - 1
    return rows.withColumn("batch", F.floor(place / size).cast("int")).groupBy(key, "batch").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.max(order).alias("last"))


def planned(current: DataFrame, wanted: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, change) that turn one table into another: insert, delete or update of the columns named; equal rows are left out, null equals null."""
    side = lambda t, mark: t.select(key, F.struct(*columns).alias(mark))
    both = side(current, "__old").join(side(wanted, "__new"), key, "full_outer")
    change = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "delete").when(~F.col("__old").eqNullSafe(F.col("__new")), "update")
    return both.select(key, change.alias("change")).where("change is not null")


def action_key(doc: Column, action: Column, due: Column) -> Column:
    return F.concat_ws(":", doc.cast("string"), action, F.coalesce(due.cast("string"), F.lit("none")))


def pending_actions(docs: DataFrame, today: Column, done: DataFrame | None = None) -> DataFrame:
    """The actions that documents (doc_id, title, content) call for, each once, without those whose key is done (key)."""
    rows = docs.select("doc_id", F.inline(T.actions(F.col("title"), F.col("content"), today))).withColumn("key", action_key(F.col("doc_id"), F.col("action_type"), F.col("due_date"))).dropDuplicates(["key"])
    return rows if done is None else rows.join(done.select("key"), "key", "left_anti").select(*rows.columns)
