"""Hierarchical multi-length packing of tokenised documents.

A document's tokens are those of its text and one end token. Documents are routed to context-size tiers:
whole windows of the longest tier are cut off first, and what remains goes to the smallest tier that holds
it. Each tier is packed on its own: an item opens a window of its tier's size, and the gap is filled from
shorter tiers, the longest item that fits first, and at last by cutting one item to the exact gap. Items
of the shortest tier that fill no gap are laid end to end. Leftover windows that cannot be filled are
closed at the sizes of shorter tiers, so at most one window of a block ends in padding.

Packing is done block by block within an input partition, so tokens are never shuffled; a block holds
``block_tokens`` tokens and ends with a few hundred padding tokens at the most, whatever the input's size.
A lost task packs the same rows of the same file split again, under the same sequence ids.

Step groups: the windows of a block are sorted by size and dealt in a snake to groups of ``group_windows``,
so that groups of a block hold nearly the same number of tokens of each tier.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 2048
#: Tier sizes, shortest first; all are powers of two, and a window of a tier is full at its size.
TIERS = (256, 512, 1024, 2048)
#: Leftovers are closed at powers of two down to this size.
LEAST = 64
END_ID = 1
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
_HARD = re.compile("[^\x00-ɏ]|[\x1c-\x1f\x85\xa0\xad]")
_encoders: dict[str, "Encoder"] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids as little-endian bytes.

    The rank file holds the same vocabulary as the JSON file and is read by a faster library. The two split
    text by the same pattern, but with their own Unicode tables, so texts with characters beyond Latin
    letters, or with rare white space, go to the ``tokenizers`` library itself. So do texts that hold the literal of an
    added token: it is one token there, while the rank file knows no added tokens.
    """

    def __init__(self, path: str):
        import os

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.slow = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.slow.get_added_tokens_decoder().values()]
        self.hard = re.compile("|".join([_HARD.pattern, *added]))
        self.fast = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.fast is None or self.hard.search(text):
            ids = self.slow.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.asarray(ids, dtype="<u4").tobytes()


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Shelves:
    """Items below ``window`` tokens, by length. A bit mask of the lengths at hand finds the next item without a scan."""

    def __init__(self, window: int):
        self.cells: list[list[tuple[int, int]]] = [[] for _ in range(window)]
        self.mask = self.total = 0

    def put(self, n: int, item: int, start: int) -> None:
        self.cells[n].append((item, start))
        self.mask |= 1 << n
        self.total += n

    def take(self, n: int) -> tuple[int, int]:
        own = self.cells[n]
        item = own.pop()
        if not own:
            self.mask ^= 1 << n
        self.total -= n
        return item

    def longest(self, most: int | None = None) -> int:
        """The length of the longest item, of at most ``most`` tokens; 0 if there is none."""
        return max(0, (self.mask if most is None else self.mask & ((2 << most) - 1)).bit_length() - 1)

    def shortest(self) -> int:
        return (self.mask & -self.mask).bit_length() - 1


def plan(lengths: list[int], window: int = WINDOW, tiers: tuple[int, ...] = TIERS, least: int = LEAST) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows as (size, pieces), where a piece is (item, start, length). Every token of every item is in one piece."""
    done: list[tuple[int, list[tuple[int, int, int]]]] = []
    rest = Shelves(window)
    for item, n in enumerate(lengths):
        start = 0
        while n - start >= window:
            done.append((window, [(item, start, window)]))
            start += window
        if n > start:
            rest.put(n - start, item, start)

    def piece(pieces: list[tuple[int, int, int]], n: int, most: int) -> int:
        """Takes an item of n tokens, cut at ``most``; what is cut off goes back."""
        item, start = rest.take(n)
        took = min(n, most)
        pieces.append((item, start, took))
        if n > took:
            rest.put(n - took, item, start + took)
        return took

    def fill(gap: int, pieces: list[tuple[int, int, int]]) -> None:
        """The longest item that fits, again and again; then one item cut to the gap. Only what was routed below the window's tier, or is left of it, is at hand."""
        while gap and rest.total:
            gap -= piece(pieces, rest.longest(gap) or rest.shortest(), gap)

    for below, tier in reversed(list(zip((0, *tiers), tiers, strict=False))):
        while rest.longest() > below and rest.total >= tier:  # with less, a window of this tier can't be filled
            pieces: list[tuple[int, int, int]] = []
            fill(tier - piece(pieces, rest.longest(), tier), pieces)  # longer only where a longer tier's last window could not be filled
            done.append((tier, pieces))
    while rest.total:
        size = min(1 << (rest.total.bit_length() - 1), window) if rest.total >= least else rest.total
        pieces = []
        fill(size, pieces)
        done.append((size, pieces))
    return done


def step_groups(sizes: list[int], group_windows: int) -> list[int]:
    """A group for each window: sorted by size, dealt back and forth."""
    groups = max(1, -(-len(sizes) // group_windows))
    out = [0] * len(sizes)
    for k, i in enumerate(sorted(range(len(sizes)), key=lambda i: -sizes[i])):
        row, col = divmod(k, groups)
        out[i] = col if row % 2 == 0 else groups - 1 - col
    return out


def _packer(path: str, block_tokens: int, group_windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 36
        encode, end = encoder(path), np.asarray([END_ID], dtype="<u4").tobytes()
        ids: list[int | None] = []
        tokens: list[bytes] = []
        held = made = steps = 0

        def flush():
            nonlocal ids, tokens, held, made, steps
            windows = plan([len(t) // 4 for t in tokens])
            cols: list[list] = [[] for _ in range(9)]
            groups = step_groups([s for s, _ in windows], group_windows)
            for (size, pieces), group in zip(windows, groups, strict=True):
                at = 0
                for item, start, n in pieces:
                    row = (ids[item], start, n, zlib.crc32(tokens[item][4 * start : 4 * (start + n)]), len(tokens[item]) // 4, first + made, at, size, first + steps + group)
                    for col, value in zip(cols, row, strict=True):
                        col.append(value)
                    at += n
                made += 1
            steps += max(groups, default=-1) + 1
            ids, tokens, held = [], [], 0
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            names = [x.split()[0] for x in OUT.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc)
                tokens.append((encode(text.as_py()) if text.is_valid else b"") + end)
                held += len(tokens[-1]) // 4
                if held >= block_tokens:
                    yield flush()
        if tokens:
            yield flush()

    return run


def pack(docs: DataFrame, path: str | None = None, block_tokens: int = 2_000_000, group_windows: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; columns OUT. ``tier`` is the window's size, ``step_group`` its training step.

    Null and empty texts are one end token. Repeated rows are separate documents that share an id. Empty
    table: no rows. Other columns of the input are not read.
    """
    C.ship(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_packer(path or tokenizer_path(), block_tokens, group_windows), OUT)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(C.table(spark, sf_dir, "documents"))
