"""Removal of repeated substrings by prefix-free parsing (after Boucher et al.).

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else.

1. Parse. A rolling hash runs over ``width`` bytes; the smallest hash in a window of ``length`` bytes is the
   window's trigger. Runs of window starts with one trigger form a phrase: those starts and the ``length``
   bytes that the last of them needs, so phrases overlap and every window lies within one. Equal windows
   have equal triggers at equal places, so equal windows lie in phrases of equal triggers, wherever
   documents or partitions are cut.
2. Parse order. Phrases whose trigger hash occurs once hold no repeat. As phrases overlap by all but one byte
   of a window, order in the parse is needed to a depth of one phrase only: a phrase that occurs twice repeats
   at all its starts. A group of any number of copies comes to one dictionary entry with a count.
3. Dictionary order. Only triggers with several different phrases are left. Their phrases are dealt into cells
   of bounded size, and each task builds the suffix array of its cells by prefix doubling over the bytes, to a
   depth of ``length``. Suffixes that agree to that depth are neighbours in it; where the counts of their
   phrases add up to two or more, the string is a repeat.
4. The repeated starts of a phrase that occurs once are the repeats of its document; per document all are
   merged into spans.

Cells. A cell (a, b) holds phrases that agree on the ``a`` bytes before their trigger's start and the ``b`` bytes
after it, and decides the windows that reach at least that far on both sides. At first it is a trigger's
own ``width`` bytes. One with more than ``most`` phrases is split in two halves of its windows: those that reach
further back, by the bytes there, and those that reach further on, by the bytes there. After seven halvings a
cell is one window, which is counted by its bytes. So a string in any number of contexts never comes to one task.

Exactness. Hashes of triggers and of cells only bring together what is then compared by its bytes; phrases are
told apart by two 64-bit hashes from different tables. Rows are told apart by a number that is written with
their texts. Null text: empty. Empty table: no rows. Equal rows are documents of their own.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import hashing as H

U = np.uint64
LENGTH, WIDTH = 200, 80
POSITION_BITS = 26
#: Phrases of a cell, and bytes of the cells that share one suffix array, at about the most.
MOST, ARRAY_BYTES = 8192, 2 << 20


def phrases(data: np.ndarray, offsets: np.ndarray, prefix: H.Prefix, length: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, trigger position) of every phrase, as positions in data."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty
    q, at = length - width + 1, np.arange(n - width + 1)
    bits = max(POSITION_BITS, int(n).bit_length())
    mask = U((1 << bits) - 1)
    key = (prefix.of(at, at + width) & ~mask) | (mask - at.astype(U))  # of equal hashes, the last
    full = np.concatenate([key, np.full(-len(key) % q, np.iinfo(U).max, U)]).reshape(-1, q)
    ahead = np.minimum.accumulate(full, axis=1).reshape(-1)
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    m = n - length + 1
    least = np.minimum(back[:m], ahead[q - 1 : q - 1 + m])
    ends = np.repeat(offsets[1:], np.diff(offsets))[:m]
    starts = np.flatnonzero(np.arange(m) + length <= ends)
    if not len(starts):
        return empty, empty, empty
    trigger = (mask - (least[starts] & mask)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], trigger[1:] != trigger[:-1]]))
    return starts[first], np.diff(np.concatenate([first, [len(starts)]])), trigger[first]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(U).view(np.int64))


def _parse(length: int, width: int, hash_bits: int):
    keep = U(0xFFFFFFFFFFFFFFFF >> (64 - hash_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for row, data, offsets in H.chunks(batch.column(1)):
                prefix, second = H.Prefix(data), H.Prefix(data, H.BYTES_2)
                start, n, trigger = phrases(data, offsets, prefix, length, width)
                at = np.searchsorted(offsets, start, side="right") - 1
                end = start + n + length - 1
                cols = [pa.array(rows[row + at]), pa.array((start - offsets[at]).astype(np.int64)), pa.array(n.astype(np.int32)), pa.array((trigger - start).astype(np.int32)), _signed(prefix.of(trigger, trigger + width) & keep), _signed(prefix.of(start, end)), _signed(second.of(start, end))]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "start", "n", "place", "trigger", "content", "content2"])

    return run


def _bodies(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for row, data, offsets in H.chunks(batch.column(1)):
                lists = batch.column(2).slice(row, len(offsets) - 1)
                flat, size = lists.flatten(), np.diff(lists.offsets.to_numpy())
                which = np.repeat(np.arange(len(size)), size)
                for low in range(0, len(flat), 1 << 14):
                    part, doc = flat.slice(low, 1 << 14), which[low : low + (1 << 14)]
                    start, n = part.field("start").to_numpy(), part.field("n").to_numpy().astype(np.int64)
                    sizes = n + length - 1
                    ends = np.concatenate([[0], np.cumsum(sizes)])
                    at = np.repeat(offsets[doc] + start - ends[:-1], sizes) + np.arange(ends[-1])
                    body = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data[at].tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(rows[row + doc]), *(part.field(x) for x in ("start", "n", "place", "trigger", "weight")), body], names=["row", "start", "n", "place", "trigger", "weight", "body"])

    return run


def suffix_ranks(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The places of the suffixes that begin at ``at`` in the suffix array of data, by their first ``depth`` bytes; those that agree so far share a place.

    Prefix doubling: places by 8 bytes give those by 16, and so on. Bytes past the end count as zero.
    """

    def places(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        ranked = key[order]
        out = np.empty(len(key), U)
        out[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])]).astype(U)
        return out

    n = len(data)
    padded = np.concatenate([data, np.zeros(depth + 8, np.uint8)]).astype(U)
    have = min(8, depth)
    key = np.zeros(n + depth, U)
    for k in range(have):
        key = (key << U(8)) | padded[k : k + n + depth]
    while have < depth:
        step = min(have, depth - have)
        place = places(key)
        last = have + step >= depth
        here = at if last else np.arange(n + depth)
        key = (place[here] << U(32)) | place[np.minimum(here + step, n + depth - 1)]
        have += step
        if last:
            return places(key)
    return places(key[at])


def repeated_windows(body: pa.Array, n: np.ndarray, place: np.ndarray, back: np.ndarray, on: np.ndarray, weight: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, first start, last start) of every run of repeated windows in phrases that occur once, among the windows that their cells decide."""
    offsets = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
    data = np.frombuffer(body.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    low, high = np.maximum(0, place - (length - on)), np.minimum(n - 1, place - back)
    count = np.maximum(0, high - low + 1)
    which = np.repeat(np.arange(len(n)), count)
    start = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    if not len(start):
        return which, start, start
    rank = suffix_ranks(data, offsets[which] - offsets[0] + start, length).astype(np.int64)
    marked = np.flatnonzero((np.bincount(rank, weight[which])[rank] > 1) & (weight[which] == 1))
    which, start = which[marked], start[marked]
    new = np.concatenate([[True], (which[1:] != which[:-1]) | (start[1:] != start[:-1] + 1)]) if len(which) else np.zeros(0, bool)
    last = np.concatenate([new[1:], [True]]) if len(which) else new
    return which[new], start[new], start[last]


def _solve(length: int, array_bytes: int):
    """Whole cells, which come one after another, share a suffix array of about ``array_bytes``."""

    def solved(rows: pa.Table) -> pa.RecordBatch:
        body = pa.concat_arrays(rows["body"].chunks)
        n, place, back, on, weight, row, start = (rows[x].to_numpy().astype(np.int64) for x in ("n", "place", "back", "on", "weight", "row", "start"))
        which, low, high = repeated_windows(body, n, place, back, on, weight, length)
        return pa.RecordBatch.from_arrays([pa.array(row[which]), pa.array(start[which] + low), pa.array(start[which] + high + length)], names=["row", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            fresh = pa.Table.from_batches([batch])
            held = fresh if held is None else pa.concat_tables([held, fresh])
            if held["body"].nbytes >= array_bytes:
                cell = held["cell"].to_numpy()
                cut = int(np.searchsorted(cell, cell[-1]))  # rows come in the order of their cells
                edges = np.concatenate([[0], np.flatnonzero(np.diff(cell[:cut])) + 1, [cut]]) if cut else np.zeros(1, np.int64)
                sizes = np.concatenate([[0], np.cumsum(held["n"].to_numpy().astype(np.int64) + length - 1)])
                at = 0
                for low, high in zip(edges[:-1], edges[1:], strict=True):
                    if sizes[high] - sizes[at] >= array_bytes or high == cut:
                        yield solved(held.slice(at, high - at))
                        at = int(high)
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield solved(held)

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, size, sums = [], [], [], []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                body = text.as_py().encode() if text.is_valid else b""
                gone = np.zeros(len(body) + 1, np.int32)
                if found.is_valid and len(found.values):
                    np.add.at(gone, found.values.field("a").to_numpy(), 1)
                    np.add.at(gone, found.values.field("b").to_numpy(), -1)
                mask = np.cumsum(gone[:-1]) > 0
                size.append(len(body))
                removed.append(int(mask.sum()))
                spans.append(int((mask & ~np.concatenate([[False], mask[:-1]])).sum()) if len(body) else 0)
                sums.append(hashlib.sha256(np.frombuffer(body, np.uint8)[~mask].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sums)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _cells(entries: DataFrame, store: C.Store, length: int, width: int, most: int, hash_bits: int) -> tuple[DataFrame, DataFrame | None]:
    """Dictionary entries in cells of at most ``most`` (cell, back, on added), and those whose cells came down to one window."""
    narrow = lambda key: key.bitwiseAND(F.lit((1 << hash_bits) - 1)) if hash_bits < 64 else key
    open_ = entries.withColumn("cell", F.col("trigger")).withColumn("back", F.lit(0)).withColumn("on", F.lit(width)).drop("trigger")
    ready, single = [], []
    for level in range(2 * length):
        crowded = store.put(f"crowded-{level}", open_.groupBy("cell").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > most).select("cell"))
        if crowded.isEmpty():
            ready.append(open_)
            break
        ready.append(open_.join(crowded, "cell", "left_anti"))
        half = F.floor((F.lit(length) - F.col("on") - F.col("back")) / 2).cast("int")
        halves = F.array(
            F.struct((F.col("back") + half + 1).alias("back"), F.col("on").alias("on"), F.lit("back").alias("side")),
            F.struct(F.col("back").alias("back"), (F.lit(length) - F.col("back") - half).alias("on"), F.lit("on").alias("side")),
        )
        split = open_.join(crowded, "cell", "left_semi").withColumn("half", F.explode(halves))
        fits = F.greatest(F.lit(0), F.col("place") - (F.lit(length) - F.col("half.on"))) <= F.least(F.col("n") - 1, F.col("place") - F.col("half.back"))
        read = F.when(F.col("half.side") == "back", F.substring("body", F.col("place") - F.col("half.back") + 1, F.col("half.back") - F.col("back"))).otherwise(F.substring("body", F.col("place") + F.col("on") + 1, F.col("half.on") - F.col("on")))
        key = narrow(F.xxhash64("cell", "half.back", "half.on", read))
        fine = split.where(fits).select("row", "start", "n", "place", "weight", "body", key.alias("cell"), F.col("half.back").alias("back"), F.col("half.on").alias("on"))
        fine = store.put(f"split-{level}", fine)
        single.append(fine.where(F.col("back") + F.col("on") == length))
        open_ = fine.where(F.col("back") + F.col("on") < length)
    union = lambda frames: functools.reduce(DataFrame.unionByName, frames)
    return union(ready), union(single) if single else None


def repeated_spans(docs: DataFrame, length: int = LENGTH, width: int = WIDTH, most: int = MOST, array_bytes: int = ARRAY_BYTES, hash_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """docs as (row, doc_id, text), and (row, spans) with the byte spans [a, b) that repeated strings cover; spans may overlap.

    ``hash_bits`` narrows the hashes of triggers and cells; results do not depend on it.
    """
    spark = docs.sparkSession
    C.ship(spark)
    store = C.Store(spark, "suffix-dedup")
    # Written, so that a row's number holds whatever is computed again.
    named = store.put("texts", docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col("text").cast("string").alias("text")))
    columns = "row long, start long, n int, place int, trigger long, content long, content2 long"
    parse = store.put("parse", named.select("row", "text").mapInArrow(_parse(length, width, hash_bits), columns))
    # Keys to join on are written first: a join of two plain exchanges can split the partitions of hot keys.
    again = store.put("again", parse.groupBy("trigger").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("trigger"))
    hot = store.put("hot", parse.join(again, "trigger", "left_semi"))
    store.drop("parse")
    first = F.min(F.struct("row", "start", "n", "place", "trigger")).alias("first")
    book = store.put("book", hot.groupBy("content", "content2").agg(F.count(F.lit(1)).alias("weight"), first).select("content", "content2", "weight", "first.*"))
    store.drop("again")
    several = store.put("several", book.groupBy("trigger").agg(F.count(F.lit(1)).alias("c"), F.min("weight").alias("least")).where("c > 1 and least = 1").select("trigger"))
    by_row = book.join(several, "trigger", "left_semi").groupBy("row").agg(F.collect_list(F.struct("start", "n", "place", "trigger", "weight")).alias("phrases"))
    entry = "row long, start long, n int, place int, trigger long, weight long, body binary"
    entries = store.put("entries", named.select("row", "text").join(by_row, "row").mapInArrow(_bodies(length), entry))
    cells, single = _cells(entries, store, length, width, most, hash_bits)
    span = "row long, start long, stop long"
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # stated, as the work is many times what the bytes suggest
    bits = store.put("bits", cells.repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(_solve(length, array_bytes), span))
    # What occurs once is told by its place, so the copies of one phrase are not dealt by it.
    alone = store.put("alone", book.where("weight = 1").select("row", "start"))
    whole = hot.join(alone, ["row", "start"], "left_anti").select("row", "start", (F.col("start") + F.col("n") - 1 + length).alias("stop"))
    found = whole.unionByName(bits)
    if single is not None:
        windows = store.put("windows", single.select("row", (F.col("start") + F.col("place") - F.col("back")).alias("start"), "weight", F.substring("body", F.col("place") - F.col("back") + 1, F.lit(length)).alias("window")))
        classes = store.put("classes", windows.groupBy("window").agg(F.sum("weight").alias("total")).where("total > 1").select("window"))
        found = found.unionByName(windows.where("weight = 1").join(classes, "window", "left_semi").select("row", "start", (F.col("start") + length).alias("stop")))
    store.drop("entries", "several", "book", *(f"{name}-{level}" for level in range(length.bit_length() + 1) for name in ("crowded", "split")))
    spans = found.groupBy("row").agg(F.collect_list(F.struct(F.col("start").alias("a"), F.col("stop").alias("b"))).alias("spans"))
    return named, spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, width: int = WIDTH, most: int = MOST, array_bytes: int = ARRAY_BYTES, hash_bits: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256; one row per input row."""
    named, spans = repeated_spans(docs, length, width, most, array_bytes, hash_bits)
    joined = named.join(spans, "row", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(C.table(spark, sf_dir, "documents"))
