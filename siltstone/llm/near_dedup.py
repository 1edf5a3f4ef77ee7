"""Near-duplicate detection with HyperMinHash sketches (Yu and Weber).

1. A text's shingle set is hashed to 64-bit numbers. Equal sets form one class; only its document with the
   smallest id goes on, so a group of any number of exact copies costs one node.
2. A class keeps 128 registers. The first 7 bits of a hash name a bucket; of the smallest remainder in it
   a register stores the count of leading zeros (6 bits) and the 10 mantissa bits after them. Empty buckets
   borrow from full ones by a fixed probe order (optimal densification, Shrivastava).
3. Four registers are one 64-bit band, 32 bands in all: a pair with similarity 0.8 shares none with
   probability (1 - 0.8**4)**32, about 5e-8.
4. In each band bucket every member is paired with the bucket's smallest id. Pairs are filtered by sizes
   and by the register matches, corrected for chance collisions, with six standard errors of slack; what
   is left is confirmed on the full shingle sets of both texts. Confirmed links give components.
5. Then only buckets that still hold several components are looked at: members outside the bucket's largest
   component are held against all members of other components, in blocks of bounded size. A block first names
   the members that may have a similar one, judged by 16-bit prints of the whole set (their overlap is never
   below the true one) or, for sets over ``WHOLE``, by the registers. Only those bring their full sets into
   the second look, which confirms pairs and joins their components as it goes: it passes over pairs that are
   joined by then, so a block gives fewer links than it has components. So each pair of classes in a bucket is
   confirmed, refused or already joined, without writing out all pairs of a group.

Components are found by alternating large-star and small-star steps (Kiveris et al.), with every state
written to the shared folder. Rows that share an id count as one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C
from . import hashing as H

U = np.uint64
BUCKET_BITS, MANTISSA_BITS = 7, 10
REGISTERS = 1 << BUCKET_BITS
BANDS = REGISTERS // 4
#: Below this many shingles the registers repeat each other too much for an estimate; such pairs are confirmed directly.
ESTIMATE_FROM = 256
#: Sets of up to this many shingles carry a 16-bit print of each.
WHOLE = 1024
#: Up to this many ids (16 MB) are broadcast to pick out the texts to move; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Rows on either side of a block of a bucket, and shingles on either side where full sets are compared.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
_PROBES = np.random.default_rng(20240229).integers(0, REGISTERS, size=(4096, REGISTERS))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each row, its distinct shingles as sorted hashes. ASCII letters count as lower case."""
    rows = len(offsets) - 1
    if not len(data):
        return [np.zeros(0, U)] * rows
    low = _LOWER[data]
    word = ~_SPACE[low]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]])
    after = np.concatenate([word[1:], [False]])
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    hashes = H.Prefix(low).of(starts, ends)
    first = np.searchsorted(starts, offsets)
    joined = hashes.copy()
    for k in range(1, width):
        joined = joined * U(0x9E3779B97F4A7C15)
        joined[: len(hashes) - k] += hashes[k:]
    joined = H.mix(joined)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(joined[a : b - width + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            whole = np.array([b - a], dtype=U)
            for h in hashes[a:b]:
                whole = H.mix(whole * U(0xD1342543DE82EF95) + h)
            out.append(whole)
        else:
            out.append(np.zeros(0, U))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers (sets x REGISTERS, uint16). No set may be empty."""
    edges = np.arange(REGISTERS, dtype=U) << U(64 - BUCKET_BITS)
    least = np.zeros((len(sets), REGISTERS), U)
    full = np.zeros((len(sets), REGISTERS), dtype=bool)
    for i, own in enumerate(sets):
        at = np.minimum(np.searchsorted(own, edges), len(own) - 1)
        least[i] = own[at]
        full[i] = (own[at] >> U(64 - BUCKET_BITS)) == (edges >> U(64 - BUCKET_BITS))
    rest = least << U(BUCKET_BITS)
    _, length = np.frexp((rest >> U(11)).astype(np.float64))
    zeros = np.minimum(53 - length, 62).astype(U)
    mantissa = (rest << (zeros + U(1))) >> U(64 - MANTISSA_BITS)
    value = (((zeros + U(1)) << U(MANTISSA_BITS)) | mantissa).astype(np.uint16)
    row, col = np.nonzero(~full)
    for probe in _PROBES:
        if not len(row):
            break
        source = probe[col]
        hit = full[row, source]
        value[row[hit], col[hit]] = value[row[hit], source[hit]]
        row, col = row[~hit], col[~hit]
    return value


def _sketch(width: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in H.chunks(batch.column(1)):
                sets = shingle_sets(data, offsets, width)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                prints = np.array([[H.mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U), H.mix(s + U(0x14057B7EF767814F)).sum(dtype=U)] for s in sets], dtype=U).view(np.int64)
                large = np.flatnonzero(n >= least)
                bands = registers([sets[i] for i in large]).view("<u8").astype(U).view(np.int64) if len(large) else np.zeros((0, BANDS), np.int64)
                at = np.zeros(len(sets) + 1, np.int32)
                at[1:] = np.cumsum(n >= least) * BANDS
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(bands.reshape(-1)))
                small = pa.array([(s >> U(40)).astype("<u2").tobytes() if least <= len(s) <= WHOLE else b"" for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sets)), pa.array(n), pa.array(prints[:, 0]), pa.array(prints[:, 1]), lists, small], names=["doc_id", "n_shingles", "fp1", "fp2", "bands", "small"])

    return run


def sketches(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit print of the set and its bands. Sets too small to be linked with another set have no bands."""
    C.ship(docs.sparkSession)
    least = next(n for n in range(1, 1000) if 100 * n >= percent * (n + 1))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_sketch(width, least), "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, small binary")


def similar(shared: int, left: int, right: int, percent: int) -> bool:
    return 100 * shared >= percent * (left + right - shared)


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept_a, kept_b = [], []
            lefts: dict[int, np.ndarray] = {}
            a_ids, b_ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for row, data, offsets in H.chunks(batch.column(3)):
                rights = shingle_sets(data, offsets, width)
                for i, right in enumerate(rights, row):
                    if a_ids[i] not in lefts:
                        for _, d, o in H.chunks(batch.column(2).slice(i, 1)):
                            lefts = {a_ids[i]: shingle_sets(d, o, width)[0]}
                    left = lefts[a_ids[i]]
                    shared = len(left) + len(right) - len(np.unique(np.concatenate([left, right])))
                    if similar(shared, len(left), len(right), percent):
                        kept_a.append(a_ids[i])
                        kept_b.append(b_ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(kept_a, pa.int64()), pa.array(kept_b, pa.int64())], names=["a", "b"])

    return run


def matches(left: Column, right: Column) -> Column:
    """How many 16-bit registers two band arrays have in common."""
    same = lambda x, lane: (F.shiftrightunsigned(x, 16 * lane).bitwiseAND(0xFFFF) == 0).cast("int")
    each = F.zip_with(left, right, lambda a, b: a.bitwiseXOR(b))
    return F.aggregate(each, F.lit(0), lambda n, x: n + same(x, 0) + same(x, 1) + same(x, 2) + same(x, 3))


def estimate(left: Column, right: Column, n_left: Column, n_right: Column) -> Column:
    """Jaccard similarity from register matches, without those that chance brings.

    Two independent minima of n and m values fall into one register value with probability close to
    n m / (n + m)**2 / ln 2 / 2**(r + 1), for r mantissa bits.
    """
    chance = (n_left * n_right).cast("double") / F.pow((n_left + n_right).cast("double"), F.lit(2.0)) * (0.5 / np.log(2) / (1 << MANTISSA_BITS))
    return (matches(left, right) / F.lit(float(REGISTERS)) - chance) / (F.lit(1.0) - chance)


class Linker:
    """The steps of one run, which share its tables."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.width, self.percent = width, percent
        self.store = C.Store(docs.sparkSession, "near-dedup")

    def candidates(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """Pairs that sizes and estimates do not rule out."""
        side = lambda name: nodes.select(F.col("node").alias(name), F.col("n").alias(f"n{name}"), F.col("bands").alias(f"bands{name}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        sizes = 100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb")
        least = self.percent / 100
        slack = 6 * (least * (1 - least) / REGISTERS) ** 0.5
        small = F.least("na", "nb") < ESTIMATE_FROM
        return both.where(sizes).where(small | (estimate(F.col("bandsa"), F.col("bandsb"), F.col("na"), F.col("nb")) >= least - slack)).select("a", "b")

    def confirmed(self, pairs: DataFrame, label: str) -> DataFrame:
        """Pairs whose full shingle sets are similar enough. Only texts that occur in a pair are moved."""
        involved = self.store.put(f"involved-{label}", pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
        small = involved.count() <= BROADCAST_IDS
        texts = self.docs.join(F.broadcast(involved) if small else involved, self.docs["doc_id"] == involved["id"], "left_semi")
        left, right = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
        both = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
        return both.mapInArrow(_confirm(self.width, self.percent), "a long, b long").distinct()

    def run(self) -> DataFrame:
        put = self.store.put
        rows = put("rows", sketches(self.docs, self.width, self.percent))
        full = rows.where("n_shingles > 0 and doc_id is not null")
        classes = put("classes", full.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("small").alias("small")))
        nodes = classes.where(F.size("bands") > 0).select("node", F.col("n_shingles").alias("n"), "bands", "small")
        banded = nodes.select("node", F.posexplode("bands").alias("band", "value")).select("node", F.xxhash64("band", "value").alias("key"))
        heads = put("heads", banded.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last").select("key", "head"))
        members = put("members", banded.join(heads, "key"))
        stars = members.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
        tested = put("tested", self.candidates(stars, nodes))
        links = put("links", self.confirmed(tested, "first"))
        parts = put("parts", components(links, self.store, "first"))
        extra = self.leftover(members, parts, nodes)
        final = parts if extra is None or extra.isEmpty() else put("final", components(links.unionByName(extra), self.store, "second"))
        self.store.drop("heads", "members", "tested", "links", "extra", "open", "totals", "full", "flagged", "chosen", "involved-first", "involved-second")
        groups = classes.where("copies > 1").select("fp1", "fp2", "n_shingles", "node")
        placed = rows.drop("bands", "small").join(groups, ["fp1", "fp2", "n_shingles"], "left").withColumn("node", F.when(F.col("n_shingles") > 0, F.coalesce("node", "doc_id")).otherwise(F.col("doc_id")))
        least = placed.join(final, "node", "left").withColumn("component_id", F.coalesce("component", "node"))
        own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.col("component_id"))
        return least.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))

    def leftover(self, members: DataFrame, parts: DataFrame, nodes: DataFrame) -> DataFrame | None:
        """Confirmed links that join what is similar in buckets of more than one component; None without such buckets' candidates."""
        placed = members.join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
        mixed = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
        open_ = self.store.put("open", placed.join(mixed, "key", "left_semi"))
        sizes = open_.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
        totals = self.store.put("totals", sizes.groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("largest"), F.sum("n").alias("n_all"), F.max("n").alias("n_largest")))
        facts = nodes.select("node", "n", "small", F.when(F.col("n") > WHOLE, F.col("bands")).alias("bands"))
        full = self.store.put("full", open_.join(totals, "key").join(facts, "node"))
        number = lambda n: F.ceil(n / BLOCK).cast("int")
        left_blocks, right_blocks = number(F.col("n_all") - F.col("n_largest")), number(F.col("n_all"))
        flags = _crossed(full, left_blocks, right_blocks, ["key", "l", "r", "node", "part", "n", "small", "bands"], _block(self.percent), "key long, nodes array<long>")
        flagged = self.store.put("flagged", flags)
        if flagged.isEmpty():
            return None
        named = flagged.select("key", F.explode("nodes").alias("node")).distinct()
        involved = self.store.put("involved-second", named.select("node").distinct())
        small = involved.count() <= BROADCAST_IDS
        texts = self.docs.join(F.broadcast(involved) if small else involved, self.docs["doc_id"] == involved["node"], "left_semi")
        sets = texts.select(F.col("doc_id").alias("node"), "text").mapInArrow(_sets(self.width), "node long, full binary")
        rows = full.join(named, ["key", "node"], "left_semi").groupBy("key", "node", "part", "largest").agg(F.max("n").alias("n"))
        chosen = self.store.put("chosen", rows.withColumn("shingles", F.sum("n").over(W.partitionBy("key"))).drop("n"))
        again = chosen.join(sets, "node")
        blocks = F.ceil(F.col("shingles") / BLOCK_SHINGLES).cast("int")
        links = _crossed(again, blocks, blocks, ["key", "l", "r", "node", "part", "full"], _joined(self.percent), "a long, b long")
        return self.store.put("extra", links.distinct())


def _crossed(rows: DataFrame, left_blocks: Column, right_blocks: Column, columns: list[str], run, schema: str) -> DataFrame:
    """``run`` over each block of the members outside a bucket's largest component and each block of all its members."""
    salt = lambda blocks: F.pmod(F.xxhash64("node"), blocks).cast("int")
    all_ = lambda blocks: F.explode(F.sequence(F.lit(0), blocks - 1))
    rest = rows.where("part <> largest").withColumn("l", salt(left_blocks)).withColumn("r", all_(right_blocks)).select(*columns)
    every = rows.withColumn("r", salt(right_blocks)).withColumn("l", all_(left_blocks)).select(*(F.col(c).alias(f"{c}_") for c in columns))
    return rest.groupBy("key", "l", "r").cogroup(every.groupBy("key_", "l_", "r_")).applyInArrow(run, schema)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in H.chunks(batch.column(1)):
                sets = shingle_sets(data, offsets, width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sets)), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["node", "full"])

    return run


def _overlaps(cell: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of each row's 16-bit prints a set has too."""
    times = np.zeros(1 << 16, np.int32)
    times[cell] = 1
    sums = np.concatenate([[0], np.cumsum(times[flat])])
    return sums[ends] - sums[np.concatenate([[0], ends[:-1]])]


def _block(percent: int):
    least = percent / 100
    slack = 6 * (least * (1 - least) / REGISTERS) ** 0.5

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, found = [], np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            node, part, n = (right[c].to_numpy() for c in ("node_", "part_", "n_"))
            cells = right["small_"].to_pylist()
            flat = np.frombuffer(b"".join(cells), "<u2")
            ends = np.cumsum([len(c) // 2 for c in cells])
            large = np.flatnonzero(n > WHOLE)
            bands = np.array([right["bands_"][int(i)].as_py() for i in large], dtype=np.int64).view("<u2").reshape(len(large), REGISTERS)
            flagged, own_nodes = np.zeros(len(node), dtype=bool), []
            for i in range(left.num_rows):
                x, own, size, cell, own_bands = (left[c][i].as_py() for c in ("node", "part", "n", "small", "bands"))
                ok = (part != own) & (100 * np.minimum(n, size) >= percent * np.maximum(n, size))
                if not ok.any():
                    continue
                if size <= WHOLE:
                    shared = np.minimum(_overlaps(np.frombuffer(cell, "<u2"), flat, ends), np.minimum(n, size))
                    ok &= (n > WHOLE) | (100 * shared >= percent * (n + size - shared))
                else:
                    same = (bands == np.array(own_bands, dtype=np.int64).view("<u2")).mean(axis=1)
                    ok[large[same < least - slack]] = False
                if ok.any():
                    own_nodes.append(x)
                    flagged |= ok
            found = np.unique(np.concatenate([node[flagged], np.array(own_nodes, np.int64)]))
            keys = [left["key"][0].as_py()] if len(found) else []
        return pa.table({"key": pa.array(keys, pa.int64()), "nodes": pa.array([found] if keys else [], pa.list_(pa.int64()))})

    return run


def _joined(percent: int):
    """Links that join the components of a block as far as their members are similar; each is confirmed on full sets."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if left.num_rows and right.num_rows:
            node = right["node_"].to_numpy()
            sets = [np.frombuffer(c.as_buffer(), "<u8") for c in right["full_"]]
            n = np.array([len(x) for x in sets])
            ends, flat = np.cumsum(n), (np.concatenate(sets) >> U(40)).astype(np.uint16)
            _, labels = np.unique(np.concatenate([left["part"].to_numpy(), right["part_"].to_numpy()]), return_inverse=True)
            rows = left.num_rows
            for i in range(rows):
                own = np.frombuffer(left["full"][i].as_buffer(), "<u8")
                x, size = left["node"][i].as_py(), len(own)
                ok = (labels[rows:] != labels[i]) & (100 * np.minimum(n, size) >= percent * np.maximum(n, size))
                if ok.any():
                    shared = np.minimum(_overlaps((own >> U(40)).astype(np.uint16), flat, ends), np.minimum(n, size))
                    ok &= 100 * shared >= percent * (n + size - shared)
                for j in np.flatnonzero(ok):
                    if labels[rows + j] == labels[i]:
                        continue
                    both = size + n[j] - len(np.unique(np.concatenate([own, sets[j]])))
                    if similar(both, size, n[j], percent):
                        a.append(min(x, node[j]))
                        b.append(max(x, node[j]))
                        labels[labels == labels[rows + j]] = labels[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def components(links: DataFrame, store: C.Store, label: str, most: int = 60) -> DataFrame:
    """(node, component) for every node with a link; a component is named by its smallest node.

    Rounds grow with the logarithm of the longest chain of links; RuntimeError after ``most`` of them.
    """
    edges = store.put(f"{label}-0", links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    before = state(edges)
    for i in range(1, most):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_least.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        edges = store.put(f"{label}-{i}", small)
        store.drop(f"{label}-{i - 1}")
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def link_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept; one row per input row.

    ``width`` words make a shingle. Texts with fewer words are one shingle, texts without words none: those
    link with nothing, and so does a row without an id, which is kept with a null component.
    """
    return Linker(docs, width, percent).run()


def query(spark, sf_dir: str) -> DataFrame:
    return link_documents(C.table(spark, sf_dir, "documents"), width=2)


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that are the first of their component, with all columns, whatever those are called.

    Each row is a document of its own here, so different texts under one id, or without an id, lose nothing.
    First is the smallest id, of equal ids the first row; rows without an id come last. Texts without words
    link with nothing and stay, repeated ones too. Empty table: no rows.
    """
    store = C.Store(docs.sparkSession, "near-dedup-rows")
    # Written, so that a row's number holds whatever is computed again.
    rows = store.put("rows", docs.select(C.row_struct(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("key")))
    found = link_documents(rows.select(F.col("key").alias("doc_id"), "text"), width, percent)
    ranked = found.select(F.col("doc_id").alias("key"), "component_id").join(rows.select("key", "id"), "key")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "key")
    first = ranked.groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.key").alias("key"))
    return rows.join(first, "key", "left_semi").select("row.*")


#: The same rows by a join on shared shingles and a recursive walk over links; for small tables.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w
), n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s
), t AS (SELECT doc_id, hash(unnest(sh)) AS h FROM s
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM t a JOIN t b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n_shingles + b.n_shingles - k)
), e AS (SELECT x, y FROM l UNION SELECT y, x FROM l
), r AS (
  SELECT doc_id AS d, doc_id AS c FROM n UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.d
), m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
SELECT n.doc_id, n_shingles, c AS component_id, n.doc_id = c AS kept FROM n JOIN m ON m.d = n.doc_id
"""
