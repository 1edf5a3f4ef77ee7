"""Fingerprints of tables that follow changes row by row, and slices of the topic tree.

A row's print is a number from the MD5 of its columns; a bucket's is the sum of its rows' prints and their number.
Sums do not depend on the order of rows or tasks, and a change is a sum too: what came in less what left. So a version is
brought up to date from the changed rows alone, and two versions are compared bucket by bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tree

BUCKETS = 256
#: Hexadecimal digits of an MD5 that fit a long.
DIGITS = 15


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def row_text(frame: DataFrame) -> Column:
    """All columns in the order of their names, each with its length before it, so that no two rows read alike; nulls as a dash."""
    cells = [F.col("`" + c.replace("`", "``") + "`").cast("string") for c in sorted(frame.columns)]
    return F.concat(*(F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in cells)) if cells else F.lit("")


def fingerprint(frame: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, rows, print) of the rows by the hash of a key column; a null key counts as an empty one. Nested columns are to be given as JSON. An empty table has no buckets."""
    bucket = F.pmod(_number(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(buckets)).cast("int")
    rows = frame.select(bucket.alias("bucket"), _number(row_text(frame)).cast("decimal(20,0)").alias("n"))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").cast("decimal(38,0)").alias("print"))


def moved(version: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """The version after a change, from the fingerprints of the removed and the added rows. Buckets that empty go."""
    less = removed.select("bucket", (-F.col("rows")).alias("rows"), (-F.col("print")).alias("print"))
    parts = version.select("bucket", "rows", "print").unionByName(less).unionByName(added.select("bucket", "rows", "print"))
    return parts.groupBy("bucket").agg(F.sum("rows").alias("rows"), F.sum("print").cast("decimal(38,0)").alias("print")).where((F.col("rows") != 0) | (F.col("print") != 0))


def differing(old: DataFrame, new: DataFrame) -> DataFrame:
    """(bucket) of buckets in which two versions differ."""
    a = old.select("bucket", F.struct("rows", "print").alias("a"))
    b = new.select("bucket", F.struct("rows", "print").alias("b"))
    return a.join(b, "bucket", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("bucket")


def content_version(prints: dict[str, DataFrame]) -> DataFrame:
    """(content_version): twelve digits for the fingerprints of several tables, one row."""
    parts = [p.groupBy().agg(F.sum("rows").alias("rows"), F.sum(F.col("print") * (F.col("bucket") + 1)).alias("print")).select(F.lit(name).alias("name"), F.concat_ws(":", F.lit(name), F.coalesce(F.col("rows"), F.lit(0)).cast("string"), F.coalesce(F.col("print").cast("decimal(38,0)"), F.lit(0)).cast("string")).alias("told")) for name, p in sorted(prints.items())]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "told"))), lambda x: x["told"]), "|").alias("told")).select(F.substring(F.md5("told"), 1, 12).alias("content_version"))  # a row for each table


def tree_slice(nodes: DataFrame, edges: DataFrame, records: DataFrame, clearance: int, levels: int, focus: DataFrame | None = None, budget: int | None = None) -> DataFrame:
    """(topic_id, level) of the topics that a caller may see: the roots, or those of focus (topic_id), and ``levels`` levels below them. With ``budget``, the first so many of each level by id."""
    seen = tree.visible(edges, tree.clearances(nodes, edges, records), clearance)
    starts = tree.primary(edges).where("parent is null").select(F.col("child").alias("topic_id")) if focus is None else focus
    shown = tree.expand(edges, starts.select("topic_id").distinct(), levels).join(seen, "topic_id", "left_semi")
    if budget is None:
        return shown.select("topic_id", "level")
    place = F.row_number().over(W.partitionBy("level").orderBy("topic_id"))
    return shown.withColumn("place", place).where(F.col("place") <= budget).select("topic_id", "level")
