"""Language-model scoring with a log-frequency Bloom filter (Talbot and Osborne).

A count c of an n-gram is quantised to level 1 + floor(log_b c) and the n-gram goes into a Bloom filter once
for each level up to its own. A lookup probes level 1, 2, ... until one is missing; the last one found stands
for the mean of the counts that share it. An n-gram's level is no higher than that of the n-grams inside
it, which takes away most false hits. Counts of words are exact, in a table keyed by 96-bit hashes. The
smoothed probability of a word after a history interpolates each order with the next lower one,

    p(w | h) = (c(h w) + m p(w | h')) / (c(h) + m),    p(w) = (c(w) + 1/2) / (N + (V + 1) / 2).

Texts are held in chunks of a few megabytes, one row each. Keys of the n-grams of a chunk are made unique
in numpy, so a frequent word or n-gram counts once for each chunk before anything is shuffled. The filter
is a table of segments: the upper half of a key's hash names its segment, all its bits are there, and the
number of segments follows the number of training tokens, so that a segment is bounded and the whole grows
with the corpus. Word counts lie in segments as well.

Segments are broadcast while they all fit ``broadcast_bytes``. Beyond that each chunk sends its unique keys
to their segments, in one packed row for each segment, and gets back one row of levels or counts. Both ways probe the same
bits and give the same scores. A key that every chunk asks for adds 4 bytes for each chunk to its segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import hashing as H

U = np.uint64
ORDER = 3
#: Base of the count levels, and the weight m of the next lower order.
LEVEL_BASE, PRIOR = 1.5, 64.0
#: Probes for each level, and filter bits for each level of each n-gram: about 0.5 % of the probes for what is not there are all set.
PROBES, BITS = 5, 12
CHUNK_BYTES, BLOCK_BYTES = 6 << 20, 1 << 20
#: Rows of a row group of chunks, segments and answers. They bound what a task holds of a table, however much of it the task reads or writes.
CHUNK_ROWS, SEGMENT_ROWS, ANSWER_ROWS = 2, 16, 1024
#: n-gram entries for each segment of the filter, and training tokens for each segment of the word table.
SEGMENT_ENTRIES, SEGMENT_TOKENS = 1 << 19, 1 << 21
#: Up to so many bytes of segments are broadcast.
BROADCAST_BYTES = 32 << 20
WORDS, GRAMS = 0, 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_END = (U(0x6A09E667F3BCC909), U(0x84CAA73B))
_STEP = U(0x9E3779B97F4A7C15)
_HALF, _LOW = U(32), U(0xFFFFFFFF)
#: The least count of each level.
LEVELS = np.unique(np.ceil(LEVEL_BASE ** np.arange(0, 120)).astype(np.float64))
#: The mean of the counts of each level; level 0 is no count.
MEANS = np.concatenate([[0.0], (LEVELS[:-1] + LEVELS[1:] - 1) / 2])
CHUNK = "chunk long, ids array<long>, held_out array<boolean>, ends array<long>, body binary, train_tokens long"
SEGMENT = "kind int, segment int, body binary, n long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id: Column) -> Column:
    """Rows that the model does not learn from: crc32 of the id as text leaves 1 when divided by 5. A null id is not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 1, F.lit(False))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the rows start and stop."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_SPACE[data]
    starts, stops = word.copy(), word.copy()
    starts[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    starts[inner], stops[inner - 1] = word[inner], word[inner - 1]
    return np.flatnonzero(starts), np.flatnonzero(stops) + 1


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64 and 32 bits for each token of the rows, and the number of tokens of each row."""
    starts, stops = _words(data, offsets)
    low = _LOWER[data]
    n = np.diff(np.searchsorted(starts, offsets)) + 1
    words = np.ones(len(starts) + len(n), dtype=bool)
    words[np.cumsum(n) - 1] = False
    a, b = np.full(len(words), _END[0]), np.full(len(words), _END[1])
    if len(starts):
        a[words] = H.Prefix(low).of(starts, stops)
        b[words] = H.Prefix(low, H.BYTES_2).of(starts, stops) & _LOW
    return a, b, n


@dataclass
class Tokens:
    """The tokens of a chunk: two hashes each, the row, and the place within the row. Every row ends with the end token."""

    a: np.ndarray
    b: np.ndarray
    row: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Tokens:
        row, parts, sizes = 0, [(np.zeros(0, U), np.zeros(0, U))], []
        while row < len(offsets) - 1:  # hashed in blocks, as prefix sums take many times the text
            to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, side="right")) - 1)
            *hashes, n = _hashed(data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row])
            parts.append(hashes)
            sizes.append(n)
            row = to
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        ends = np.cumsum(n) - 1
        return cls(a, b, np.repeat(np.arange(len(n), dtype=np.int32), n), (np.arange(len(a)) - np.repeat(ends - n + 1, n)).astype(np.int32))

    def only(self, rows: np.ndarray) -> Tokens:
        keep = rows[self.row]
        return Tokens(self.a[keep], self.b[keep], self.row[keep], self.place[keep])

    def grams(self, order: int, segments: int) -> Iterator[np.ndarray]:
        """For each order from 2, the keys of its n-grams in the order of their last tokens, as segment and 32 bits."""
        keys = self.a
        for n in range(2, order + 1):
            keys = H.mix(np.concatenate([keys[:1], keys[:-1]]) * _STEP + self.a + U(n))
            own = keys[self.place >= n - 1]
            yield ((((own >> _HALF) * U(segments)) >> _HALF) << _HALF) | (own & _LOW)


def distinct_words(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (a, b), their counts, and the place of each input among them."""
    if not len(a):
        return a, b, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(a, kind="stable")
    x, y = a[order], b[order]
    if ((x[1:] == x[:-1]) & (y[1:] != y[:-1])).any():  # two words share 64 bits
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    starts = np.flatnonzero(new)
    where = np.empty(len(a), np.int64)
    where[order] = np.cumsum(new) - 1
    return x[starts], y[starts], np.diff(np.append(starts, len(x))), where


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts."""
    keys = np.sort(keys)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.diff(np.append(starts, len(keys)))


def runs(segments: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(segment, from, to) of sorted segment numbers."""
    if len(segments):
        starts = np.flatnonzero(np.concatenate([[True], segments[1:] != segments[:-1]]))
        yield from zip(segments[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(segments)], strict=True)


def word_segment(a: np.ndarray, segments: int) -> np.ndarray:
    return ((a >> _HALF) * U(segments)) >> _HALF


class _Probes:
    """The bits, one probe after the other, that keys at a level have in a filter of so many bits."""

    def __init__(self, keys: np.ndarray, level: int, size: int):
        mixed = H.mix(keys.astype(U) | U(level << 32))
        self.at, self.step, self.size = mixed & _LOW, (mixed >> _HALF) | U(1), U(size)

    def next(self) -> np.ndarray:
        out = ((self.at * self.size) >> _HALF).view(np.int64)
        self.at = (self.at + self.step) & _LOW
        return out

    def keep(self, rows: np.ndarray) -> None:
        self.at, self.step = self.at[rows], self.step[rows]


def build_filter(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """The filter of distinct 32-bit keys and their counts."""
    level = np.searchsorted(LEVELS, counts, side="right")
    size = max(64, -(-int(level.sum()) * BITS // 8) * 8)
    bits = np.zeros(size, dtype=bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        probes = _Probes(keys[level >= j], j, size)
        for _ in range(PROBES):
            bits[probes.next()] = True
    return np.packbits(bits).tobytes()


def levels(keys: np.ndarray, body: bytes | None) -> np.ndarray:
    """The highest level up to which the filter holds every level of a key; 0: not there."""
    out = np.zeros(len(keys), np.uint8)
    if not body:
        return out
    bits = np.frombuffer(body, np.uint8)
    alive = np.arange(len(keys))
    for j in range(1, len(LEVELS)):
        probes = _Probes(keys[alive], j, 8 * len(bits))
        for _ in range(PROBES):
            at = probes.next()
            hit = (np.take(bits, at >> 3) << (at & 7).astype(np.uint8)) & 128 != 0
            if not hit.all():
                alive = alive[hit]
                probes.keep(hit)
        if not len(alive):
            break
        out[alive] = j
    return out


def pack_words(a: np.ndarray, b: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    return a.astype("<u8").tobytes() + (b"" if counts is None else counts.astype("<u8").tobytes()) + b.astype("<u4").tobytes()


def open_words(cell: bytes | pa.Buffer, columns: int) -> list[np.ndarray]:
    """The 8-byte columns, then the 4-byte one, as they were packed."""
    n = len(cell) // (8 * columns + 4)
    return [np.frombuffer(cell, "<u8", n, 8 * n * k) for k in range(columns)] + [np.frombuffer(cell, "<u4", n, 8 * n * columns).astype(U)]


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 32-bit keys as differences of three bytes, or as they are where one difference needs more."""
    steps = np.diff(keys, prepend=keys.dtype.type(0)).astype("<u4")
    if steps.max(initial=0) >= 1 << 24:
        return b"\4" + keys.astype("<u4").tobytes()
    return b"\3" + steps.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def open_keys(cell: bytes | pa.Buffer) -> np.ndarray:
    body = np.frombuffer(cell, np.uint8)
    if body[0] == 4:
        return np.frombuffer(body[1:].tobytes(), "<u4")
    steps = np.zeros((len(body) // 3, 4), np.uint8)
    steps[:, :3] = body[1:].reshape(-1, 3)
    return np.cumsum(steps.view("<u4")[:, 0], dtype=np.uint32)


def counts_of(a: np.ndarray, b: np.ndarray, body: bytes | None) -> np.ndarray:
    """The counts of words in a segment of the word table; 0 for those that are not there."""
    if not body:
        return np.zeros(len(a), np.int64)
    x, n, y = open_words(body, 2)
    low, high = np.searchsorted(x, a, side="left"), np.searchsorted(x, a, side="right")
    out = np.zeros(len(a), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:  # one step, but where words share 64 bits
        hit = y[low[open_]] == b[open_]
        out[open_[hit]] = n[low[open_[hit]]]
        low[open_] = np.where(hit, high[open_], low[open_] + 1)
    return out


def _chunked(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 33
        names = [x.split()[0] for x in CHUNK.split(", ")]
        for batch in batches:
            for row, data, offsets in H.chunks(batch.column(1), chunk_bytes):
                size = len(offsets) - 1
                out = batch.column(2).slice(row, size)
                learn = ~out.to_numpy(zero_copy_only=False).astype(bool)
                tokens = np.diff(np.searchsorted(_words(data, offsets)[0], offsets)) + 1
                lists = [pa.array([x.to_pylist()], pa.list_(kind)) for x, kind in ((batch.column(0).slice(row, size), pa.int64()), (out, pa.bool_()), (pa.array(offsets[1:]), pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([number]), *lists, pa.array([data.tobytes()], pa.binary()), pa.array([int(tokens[learn].sum())], pa.int64())], names=names)
                number += 1

    return run


def _opened(batch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, row offsets and whether each row is held out, of one chunk."""
    ends = batch.column(3)[i].values.to_numpy(zero_copy_only=False)
    held = batch.column(2)[i].values.to_numpy(zero_copy_only=False).astype(bool)
    return np.frombuffer(batch.column(4)[i].as_buffer(), np.uint8), np.concatenate([[0], ends]).astype(np.int64), held


def _counted(order: int, gram_segments: int, word_segments: int):
    """Counts of a chunk's training tokens, packed by segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, offsets, held = _opened(batch, i)
                tokens = Tokens.of(data, offsets).only(~held)
                a, b, n, _ = distinct_words(tokens.a, tokens.b)
                rows = [(WORDS, s, pack_words(a[x:y], b[x:y]), n[x:y].astype("<u4").tobytes()) for s, x, y in runs(word_segment(a, word_segments))]
                keys, n = distinct(np.concatenate([np.zeros(0, U), *tokens.grams(order, gram_segments)]))
                low = keys.astype("<u4")  # drops the segment
                rows += [(GRAMS, s, pack_keys(low[x:y]), n[x:y].astype("<u4").tobytes()) for s, x, y in runs(keys >> _HALF)]
                cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["kind", "segment", "keys", "counts"])

    return run


def _segment(key: tuple, table: pa.Table) -> pa.Table:
    """One segment of the word table or of the filter, from all counts that belong there."""
    kind, segment = key[0].as_py(), key[1].as_py()
    counts = np.concatenate([np.frombuffer(c.as_buffer(), "<u4") for c in table["counts"]]).astype(np.int64)
    if kind == WORDS:
        a, b = (np.concatenate(x) for x in zip(*(open_words(c.as_buffer(), 1) for c in table["keys"]), strict=True))
        a, b, _, where = distinct_words(a, b)
        total = np.zeros(len(a), np.int64)
        np.add.at(total, where, counts)
        body, n = pack_words(a, b, total), len(a)
    else:
        keys = np.concatenate([open_keys(c.as_buffer()) for c in table["keys"]])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        body, n = build_filter(keys[starts], np.add.reduceat(counts, starts)), len(starts)
    return pa.table({"kind": pa.array([kind], pa.int32()), "segment": pa.array([segment], pa.int32()), "body": pa.array([body], pa.binary()), "n": pa.array([n], pa.int64())})


@dataclass
class Model:
    """Segments of word counts and of the filter, and what is needed to find one's way in them."""

    segments: DataFrame
    order: int
    gram_segments: int
    word_segments: int
    train_tokens: int
    train_types: int
    size: int
    prior: float


def train(chunks: DataFrame, store: C.Store, order: int = ORDER, prior: float = PRIOR, segment_entries: int = SEGMENT_ENTRIES, segment_tokens: int = SEGMENT_TOKENS) -> Model:
    """The model of the chunks' rows that are not held out."""
    total = chunks.agg(F.sum("train_tokens")).first()[0] or 0
    gram_segments, word_segments = max(1, -(-(order - 1) * total // segment_entries)), max(1, -(-total // segment_tokens))
    counted = chunks.mapInArrow(_counted(order, gram_segments, word_segments), "kind int, segment int, keys binary, counts binary")
    segments = store.put("segments", counted.groupBy("kind", "segment").applyInArrow(_segment, SEGMENT), SEGMENT_ROWS)
    about = segments.agg(F.sum(F.when(F.col("kind") == WORDS, F.col("n"))), F.sum(F.octet_length("body"))).first()
    return Model(segments, order, gram_segments, word_segments, total, about[0] or 0, about[1] or 0, prior)


class Scorer:
    """What a chunk asks for, and its scores once that is known."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, order: int, gram_segments: int, word_segments: int):
        tokens = Tokens.of(data, offsets)
        self.place, self.order, self.word_segments = tokens.place, order, word_segments
        self.a, self.b, _, self.words = distinct_words(tokens.a, tokens.b)
        self.keys = np.concatenate([np.zeros(0, U), *tokens.grams(order, gram_segments)])

    def asks(self) -> Iterator[tuple[int, int, bytes]]:
        for segment, x, y in runs(word_segment(self.a, self.word_segments)):
            yield WORDS, segment, pack_words(self.a[x:y], self.b[x:y])
        keys, _ = distinct(self.keys)
        low = keys.astype("<u4")
        for segment, x, y in runs(keys >> _HALF):
            yield GRAMS, segment, pack_keys(low[x:y])

    def known(self, bodies: dict[tuple[int, int], bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the distinct words and levels of the distinct keys, from the segments at hand."""
        counts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
        for kind, segment, cell in self.asks():
            if kind == WORDS:
                counts.append(counts_of(*open_words(cell, 1), bodies.get((WORDS, segment))))
            else:
                found.append(levels(open_keys(cell), bodies.get((GRAMS, segment))))
        return np.concatenate(counts), np.concatenate(found)

    def spread(self, found: np.ndarray) -> np.ndarray:
        """The levels of the n-grams, order by order, from those of the distinct keys."""
        order = np.argsort(self.keys)
        ranked = self.keys[order]
        rank = np.zeros(len(order), np.int32)
        np.cumsum(ranked[1:] != ranked[:-1], out=rank[1:], dtype=np.int32)
        out = np.zeros(len(order), np.uint8)
        out[order] = found[rank]
        return out

    def scores(self, counts: np.ndarray, found: np.ndarray, total: int, types: int, prior: float) -> tuple[np.ndarray, ...]:
        """For each row: tokens, known tokens, base score and score."""
        count = counts[self.words].astype(np.float64)
        p = (count + 0.5) / (total + 0.5 * (types + 1))
        base = np.log10(p)
        history, lower = count, None  # how often what stands before the last word was seen; levels of the n-grams one order below
        found, start = self.spread(found), 0
        for n in range(2, self.order + 1):
            at, level = np.flatnonzero(self.place >= n - 1), np.zeros(len(count), np.uint8)
            level[at] = found[start : start + len(at)]
            start += len(at)
            if lower is not None:
                level[at] = np.minimum(level[at], np.minimum(lower[at], lower[at - 1]))
            seen = MEANS[level]
            if lower is None:
                seen[at] = np.minimum(seen[at], np.minimum(count[at], count[at - 1]))
            p[at] = (seen[at] + prior * p[at]) / (history[at - 1] + prior)
            history, lower = seen, level
        starts = np.flatnonzero(self.place == 0)
        return tuple(np.add.reduceat(x, starts) for x in (np.ones(len(count), np.int64), (count > 0).astype(np.int64), base, np.log10(p)))


def _rows(batch, i: int, scorer: Scorer, counts: np.ndarray, found: np.ndarray, total: int, types: int, prior: float) -> pa.RecordBatch:
    n, known, base, score = scorer.scores(counts, found, total, types, prior)
    cells = [pa.array(batch.column(1)[i].as_py(), pa.int64()), pa.array(batch.column(2)[i].as_py(), pa.bool_()), pa.array(n), pa.array(known), pa.array(np.full(len(n), total)), pa.array(base), pa.array(score)]
    return pa.RecordBatch.from_arrays(cells, names=[x.split()[0] for x in SCORES.split(", ")])


def score(chunks: DataFrame, model: Model, store: C.Store, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """SCORES of every row of the chunks."""
    spark = chunks.sparkSession
    shape, total, fit = (model.order, model.gram_segments, model.word_segments), model.train_tokens, (model.train_types, model.prior)
    if model.size <= broadcast_bytes:
        sent = spark.sparkContext.broadcast({(r.kind, r.segment): bytes(r.body) for r in model.segments.select("kind", "segment", "body").collect()})

        def at_hand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    scorer = Scorer(*_opened(batch, i)[:2], *shape)
                    yield _rows(batch, i, scorer, *scorer.known(sent.value), total, *fit)

        return chunks.mapInArrow(at_hand, SCORES)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                kinds, segments, keys = zip(*Scorer(*_opened(batch, i)[:2], *shape).asks(), strict=True)
                cells = [pa.array(kinds, pa.int32()), pa.array(segments, pa.int32()), pa.array([batch.column(0)[i].as_py()] * len(kinds), pa.int64()), pa.array(keys, pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, names=["kind", "segment", "chunk", "keys"])

    def answer(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        kind, body = key[0].as_py(), held["body"][0].as_py() if held.num_rows else None
        out, cells, held_keys = [], [c.as_buffer() for c in asked["keys"]], []
        if kind == WORDS:
            out = [counts_of(*open_words(c, 1), body).astype("<u8").tobytes() for c in cells]
        for i, cell in enumerate(cells if kind == GRAMS else ()):  # many chunks' keys at a time
            held_keys.append(open_keys(cell))
            if sum(map(len, held_keys)) >= SEGMENT_ENTRIES or i == len(cells) - 1:
                found = levels(np.concatenate(held_keys), body)
                out += [x.tobytes() for x in np.split(found, np.cumsum([len(k) for k in held_keys])[:-1])]
                held_keys = []
        return pa.table({"chunk": asked["chunk"], "kind": asked["kind"], "segment": asked["segment"], "found": pa.array(out, pa.binary())})

    def answered(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by([("kind", "ascending"), ("segment", "ascending")])
        parts = [[np.frombuffer(c.as_buffer(), kind) for c, k in zip(answers["found"], answers["kind"].to_pylist(), strict=True) if k == own] for own, kind in ((WORDS, "<u8"), (GRAMS, np.uint8))]
        counts, found = (np.concatenate(p) if p else np.zeros(0, np.uint8) for p in parts)
        batch = chunk.combine_chunks().to_batches()[0]
        return pa.Table.from_batches([_rows(batch, 0, Scorer(*_opened(batch, 0)[:2], *shape), counts, found, total, *fit)])

    asked = chunks.mapInArrow(ask, "kind int, segment int, chunk long, keys binary")
    answers = store.put("answers", asked.groupBy("kind", "segment").cogroup(model.segments.groupBy("kind", "segment")).applyInArrow(answer, "chunk long, kind int, segment int, found binary").where("chunk IS NOT NULL"), ANSWER_ROWS)
    store.drop("segments")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(answered, SCORES)


def score_documents(docs: DataFrame, order: int = ORDER, prior: float = PRIOR, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, segment_entries: int = SEGMENT_ENTRIES, segment_tokens: int = SEGMENT_TOKENS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """SCORES; one row per input row. The model learns from the rows that are not held out, and all are scored.

    Null texts count as empty: one end token. Rows without an id are learnt from. Repeated rows count each
    time, and so do rows that share an id. Without training rows N and V are 0. Texts of any length are one
    chunk at most each. Other columns are not read, whatever their names. Empty table: no rows.
    """
    spark = docs.sparkSession
    C.ship(spark)
    store = C.Store(spark, "lm-score")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chunks = store.put("chunks", source.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(_chunked(chunk_bytes), CHUNK), CHUNK_ROWS)
    return score(chunks, train(chunks, store, order, prior, segment_entries, segment_tokens), store, broadcast_bytes)


def query(spark, sf_dir: str) -> DataFrame:
    return score_documents(C.table(spark, sf_dir, "documents"))
