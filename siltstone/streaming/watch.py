"""File events and documents as streams: index tables that follow a folder, actions that fire once, and the global quiet gap.

Sinks are keyed tables: a batch writes its own changes and no more, so its cost follows the batch, and a batch that is done again after a failure leaves
the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from ..operators import graph as G
from ..operators import lifecycle
from . import debounce
from .keyed import KeyedTable


INDEX = "path string, sha256 string, content binary"


def follow(events: DataFrame, table: KeyedTable, read: Callable[[DataFrame], DataFrame], checkpoint: str):
    """A stream of file events (path, event_type, ts, seq) applied to an index: of each batch, deleted paths go and the others are read anew.

    ``read`` gives (path, content) of paths; a path that it does not give is gone. Within a batch the last event of a path counts, and a deletion
    overrules whatever else the path had.
    """

    def apply(batch: DataFrame, number: int) -> None:
        outcome = debounce.outcomes(batch.where(T.watched(F.col("path"), (".md", ".txt", ".csv", ".json", ".html", ".xml")))).select("path", "outcome")
        changed = outcome.where("outcome <> 'delete'").select("path")
        fresh = read(changed).select("path", F.sha2("content", 256).alias("sha256"), "content")
        table.put(number, fresh, outcome.select("path"))

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


ACTIONS = "doc_id long, action_type string, severity string, message string, amount double, due_date date, key string"


def dispatch(docs: DataFrame, today, table: KeyedTable, checkpoint: str):
    """A stream of documents (doc_id, title, content) whose actions are written to a table, each key once for all time."""

    def apply(batch: DataFrame, number: int) -> None:
        found = G.cut(lifecycle.pending_actions(batch, today, table.nothing().select("key")))
        done = table.current(before=number, only=found.select("key"))
        table.put(number, found.join(done.select("key"), "key", "left_anti"))

    return docs.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def webhook(spark: SparkSession, where: str, schema: str = "doc_id long, title string, content string"):
    """Documents that a receiver drops as JSON lines into a folder, as a stream."""
    return spark.readStream.schema(schema).json(where)


def changes(held: DataFrame, files: DataFrame) -> DataFrame:
    """What a watched source's sync has to do: (path, state), from the snapshot held and the binary files now there."""
    return lifecycle.sync(held, lifecycle.file_hashes(files))


_OUT = "burst timestamp, path string, outcome string, n_events long"
_STATE = "first timestamp, last timestamp, paths array<string>, outcomes array<string>, counts array<long>"


def global_bursts(events: DataFrame, delay: float = 0.040, late: str = "1 minute") -> DataFrame:
    """(burst, path, outcome, n_events) of a stream of file events with one quiet gap for all paths.

    The gap is global, so all events share one state; the events of an open burst are folded to one row per path first, which bounds it by
    the paths of a burst. Events are taken in order of time within a batch; a burst ends with the first event that comes ``delay`` or more after
    the last, or when the watermark passes that time.
    """
    gap = pd.Timedelta(seconds=delay)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, open_ = None, None, {}
        if state.exists:
            first, last, paths, outcomes, counts = state.get
            first, last = pd.Timestamp(first), pd.Timestamp(last)
            open_ = {p: [o, n] for p, o, n in zip(paths, outcomes, counts, strict=True)}
        out: list[tuple] = []

        def close() -> None:
            out.extend((first, path, outcome, n) for path, (outcome, n) in open_.items())
            open_.clear()

        if state.hasTimedOut:
            close()
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values(["ts", "seq"], kind="stable")
            for path, kind, at in zip(rows["path"], rows["event_type"], rows["ts"], strict=True):
                if last is None or at - last >= gap:
                    close()
                    first = at
                last = at if last is None else max(last, at)
                outcome, n = open_.get(path, ("", 0))
                open_[path] = ["delete" if "delete" in (outcome, kind) else kind, n + 1]
            state.update((first, last, list(open_), [o for o, _ in open_.values()], [n for _, n in open_.values()]))
            # A timeout must lie after the watermark; rows that came late may end a burst at once.
            state.setTimeoutTimestamp(max(int((last + gap).timestamp() * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["burst", "path", "outcome", "n_events"])

    timed = events.where("ts is not null").withWatermark("ts", late).withColumn("one", F.lit(0))
    return timed.groupBy("one").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
