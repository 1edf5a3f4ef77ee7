"""Coalescing of file events: a burst ends when no event of any path arrives for ``delay`` seconds.

Within a burst a path has one outcome: ``delete`` if it was deleted at all, else its last event. The gap is
global, over all paths. A plain window over all events would sort them in one task; here each stretch of
``stretch`` seconds finds its own gaps, and only one row per stretch (its first and last event and the last
gap in it) is ordered globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bursts(events: DataFrame, delay: float = 0.040, stretch: int = 3600) -> DataFrame:
    """(path, event_type, ts, seq) to (burst, path, outcome, n_events); ``burst`` is the burst's first time.

    Rows without a time are left out. A gap of exactly ``delay`` ends a burst. ``seq`` breaks ties of time.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = round(delay * 1_000_000)
    timed = events.where(F.col("ts").isNotNull()).select("path", "event_type", "seq", micros.alias("__t")).withColumn("__part", F.floor(F.col("__t") / (stretch * 1_000_000)))
    inside = Window.partitionBy("__part").orderBy("__t", "seq")
    marked = timed.withColumn("__gap", F.col("__t") - F.lag("__t").over(inside))
    opened = F.when(F.col("__gap") >= gap, F.col("__t"))
    edges = marked.groupBy("__part").agg(F.min("__t").alias("first"), F.max("__t").alias("last"), F.max(opened).alias("opened"))
    across = Window.orderBy("__part")  # one row per stretch of time, however many events there are
    joined = edges.withColumn("before", F.lag("last").over(across))
    own = F.when(F.col("before").isNull() | (F.col("first") - F.col("before") >= gap), F.col("first"))
    carried = joined.withColumn("own", own).withColumn("latest", F.greatest("opened", "own"))
    carried = carried.withColumn("open", F.coalesce("own", F.max("latest").over(across.rowsBetween(Window.unboundedPreceding, -1))))
    placed = marked.join(carried.select("__part", "open"), "__part")
    burst = F.coalesce(F.max(opened).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("open"))
    return outcomes(placed.withColumn("burst", F.timestamp_micros(burst)).withColumn("ts", F.timestamp_micros("__t")), "burst")


def outcomes(events: DataFrame, *keys: str) -> DataFrame:
    last = F.max_by("event_type", F.struct("ts", "seq"))
    return events.groupBy(*keys, "path").agg(F.when(F.max(F.col("event_type") == "delete"), F.lit("delete")).otherwise(last).alias("outcome"), F.count(F.lit(1)).alias("n_events"))


def per_path(events: DataFrame, delay: str = "40 milliseconds", late: str = "10 minutes") -> DataFrame:
    """A variant for unbounded streams whose gap counts for each path by itself, so state is split by path."""
    window: Column = F.session_window("ts", delay)
    return outcomes(events.withWatermark("ts", late).withColumn("session", window), "session").select(F.col("session.start").alias("burst"), "path", "outcome", "n_events")


def moves(events: DataFrame) -> DataFrame:
    """(src, dst, event_type, ts, seq) to path events: a move is the deletion of one path and the creation of another."""
    pair = F.array(F.struct(F.col("src").alias("path"), F.lit("delete").alias("event_type")), F.struct(F.col("dst").alias("path"), F.lit("create").alias("event_type")))
    single = F.array(F.struct(F.col("src").alias("path"), F.col("event_type").alias("event_type")))
    return events.select(F.inline(F.when(F.col("event_type") == "move", pair).otherwise(single)), "ts", "seq")
