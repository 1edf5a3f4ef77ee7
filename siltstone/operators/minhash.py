"""MinHash signatures of 64 permutations over CRC-32 shingles, and near duplicates in order of arrival.

A signature is an array column, by built-in functions alone for a column or with the permutations in numpy for a table. Candidates share a band of a signature; each is checked on the whole
signatures, so bands decide only what is looked at: with one row a band, any pair that reaches the threshold shares a band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S
from . import graph as G

# Fixed values.
PERMUTATIONS, SHINGLE_WORDS, THRESHOLD = 64, 2, 0.85
MODULUS = 1 << 32
REPLY = r"(?im)^(subject:\s*)(?:re|fwd|fw|enc):\s*"


#: Multipliers and addends of the i-th permutation, from 1 on: (i * step + shift) mod 2**32, multipliers made odd.
MULTIPLIER, ADDEND = (2654435761, 1013904223), (1664525, 374761393)


def coefficients(n: int = PERMUTATIONS) -> list[tuple[int, int]]:
    line = lambda rule, i: (i * rule[0] + rule[1]) % MODULUS
    return [(line(MULTIPLIER, i) | 1, line(ADDEND, i)) for i in range(1, n + 1)]


def _runs(text: Column, words: int) -> Column:
    body = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), REPLY, "$1"))
    runs = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(t) - words + 1)), lambda i: F.array_join(F.slice(t, i, words), " "))
    return S.bound(F.array_remove(F.split(body, r"(?U)\s+"), ""), lambda t: F.when(F.size(t) >= words, runs(t)).otherwise(F.array(F.array_join(t, " "))))


def shingles(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """The distinct runs of ``words`` words, lower case; with fewer words, all of them as one; without any, the empty string. Reply marks of subject lines are left out."""
    return F.array_distinct(_runs(text, words))


def signature(text: Column, n: int = PERMUTATIONS, words: int = SHINGLE_WORDS) -> Column:
    """For each permutation, the least (a * crc32 + b) mod 2**32 over the shingles."""
    hashes = F.transform(shingles(text, words), lambda s: F.crc32(F.encode(s, "UTF-8")))
    # a * h overflows 64 bits, and both engines and Python agree on its lower half by splitting a: only the lower 32 bits count.
    rules = F.array(*(F.struct(F.lit(a >> 16).cast("long").alias("high"), F.lit(a & 0xFFFF).cast("long").alias("low"), F.lit(b).cast("long").alias("b")) for a, b in coefficients(n)))
    product = lambda r, h: (((r["high"] * h) % (1 << 16)) * (1 << 16) + r["low"] * h + r["b"]) % MODULUS
    return S.bound(hashes, lambda hs: F.transform(rules, lambda r: F.array_min(F.transform(hs, lambda h: product(r, h)))))


def signed(docs: DataFrame, n: int = PERMUTATIONS, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, signature) of docs (doc_id, text): the values of ``signature``, with the permutations in numpy over many texts at once."""
    rules = coefficients(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(1)
            size = pc.list_value_length(hashes).to_numpy(zero_copy_only=False)
            h, starts = hashes.flatten().to_numpy(zero_copy_only=False).astype(np.uint32), np.cumsum(size) - size
            out = np.empty((len(hashes), n), np.int64)
            first = 0
            while first < len(hashes):  # whole texts, about as many hashes as a cache holds
                last = max(first + 1, int(np.searchsorted(starts, starts[first] + (1 << 16))))
                part, at = h[starts[first] : starts[last - 1] + size[last - 1]], starts[first:last] - starts[first]
                for i, (a, b) in enumerate(rules):  # unsigned 32-bit numbers wrap, which is the modulus
                    out[first:last, i] = np.minimum.reduceat(part * np.uint32(a) + np.uint32(b), at)
                first = last
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, n, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], ["doc_id", "signature"])

    # Repeated shingles don't change a least value, and every text has a shingle.
    rows = docs.select("doc_id", F.transform(_runs(F.col("text"), words), lambda s: F.crc32(F.encode(s, "UTF-8"))).alias("hashes"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("signature", T.ArrayType(T.LongType()))]))


def similarity(left: Column, right: Column) -> Column:
    """The share of permutations with equal values: an estimate of Jaccard similarity. Null for signatures of different lengths or none."""
    same = F.aggregate(F.zip_with(left, right, lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, x: n + x)
    return F.when((F.size(left) == F.size(right)) & (F.size(left) > 0), same / F.size(left))


def bands_for(threshold: float, n: int = PERMUTATIONS) -> int:
    """The fewest bands of which signatures with a share of ``threshold`` equal values must share one: more bands than differing values."""
    differing = int(n * (1 - threshold) + 1e-9)
    return next((b for b in range(1, n + 1) if n % b == 0 and b > differing), n)


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD, n: int = PERMUTATIONS, words: int = SHINGLE_WORDS) -> tuple[DataFrame, DataFrame]:
    """(classes, pairs) of docs (doc_id, text): (doc_id, head, signature), where documents with one signature share their smallest id as head, and pairs (a, b, similarity) of heads at or above the threshold.

    Copies are no pairs, however many there are; and no pair is missed. A band's bucket is as large as the heads that share the band.
    """
    held = G.cut(signed(docs.where("doc_id is not null"), n, words))
    heads = G.cut(held.groupBy("signature").agg(F.min("doc_id").alias("head")))
    classes = held.join(heads, "signature").select("doc_id", "head", "signature")
    bands = bands_for(threshold, n)
    rows = n // bands
    keyed = heads.select("head", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.slice("signature", k * rows + 1, rows))).alias("band", "part")).select("head", F.xxhash64("band", "part").alias("key"))
    pairs = keyed.select(F.col("head").alias("a"), "key").join(keyed.select(F.col("head").alias("b"), "key"), "key").where("a < b").select("a", "b").distinct()
    side = lambda name: heads.select(F.col("head").alias(name), F.col("signature").alias(f"s{name}"))
    close = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("similarity", similarity(F.col("sa"), F.col("sb"))).where(F.col("similarity") >= threshold)
    return classes, close.select("a", "b", "similarity")


def first_kept(docs: DataFrame, threshold: float = THRESHOLD, n: int = PERMUTATIONS, words: int = SHINGLE_WORDS, most: int = 1000) -> DataFrame:
    """(doc_id, kept): documents in order of their ids, each kept unless one that was kept before it is as similar as the threshold.

    A document is decided once all its smaller neighbours are: kept if none of them is, else dropped. Each round decides at least the
    smallest that is open, and along a chain of neighbours as many as have no open one before them. RuntimeError after ``most`` rounds.
    """
    classes, pairs = near_pairs(docs, threshold, n, words)
    pairs = G.cut(pairs.select("a", "b"))
    dropped = pairs.select(F.col("b").alias("id")).limit(0)
    kept = G.cut(pairs.select(F.col("a").alias("id")).distinct().join(pairs.select(F.col("b").alias("id")).distinct(), "id", "left_anti"))
    for _ in range(most):
        fresh = pairs.join(kept.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        dropped = G.cut(fresh)
        decided = kept.unionByName(dropped)
        waiting = pairs.join(dropped.select(F.col("id").alias("b")), "b", "left_anti").join(decided.select(F.col("id").alias("b")), "b", "left_anti")
        waiting = waiting.join(dropped.select(F.col("id").alias("a")), "a", "left_anti")
        blocked = waiting.select(F.col("b").alias("id")).distinct()
        every = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        new = G.cut(every.join(decided, "id", "left_anti").join(blocked, "id", "left_anti"))
        if new.isEmpty():
            break
        kept = G.cut(kept.unionByName(new))
    else:
        raise RuntimeError(f"not decided in {most} rounds")
    gone = dropped.select(F.col("id").alias("head"), F.lit(True).alias("__gone"))
    return classes.select("doc_id", "head").join(gone, "head", "left").select("doc_id", ((F.col("doc_id") == F.col("head")) & F.col("__gone").isNull()).alias("kept"))


def duplicate_of(known: DataFrame, fresh: DataFrame, threshold: float = THRESHOLD, n: int = PERMUTATIONS, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, match) of fresh documents (doc_id, text) that are as similar as the threshold to a known one (doc_id, signature); the smallest of these."""
    bands = bands_for(threshold, n)
    rows = n // bands
    keys = lambda c: F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(k, F.slice(c, k * rows + 1, rows)))
    left = known.select(F.col("doc_id").alias("match"), F.col("signature").alias("__known"), F.explode(keys(F.col("signature"))).alias("key"))
    right = signed(fresh, n, words).withColumnRenamed("signature", "__own").select("doc_id", "__own", F.explode(keys(F.col("__own"))).alias("key"))
    close = right.join(left, "key").where(similarity(F.col("__own"), F.col("__known")) >= threshold)
    return close.groupBy("doc_id").agg(F.min("match").alias("match"))
