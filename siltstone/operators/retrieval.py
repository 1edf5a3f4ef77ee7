"""Lexical, vector and hybrid retrieval for many questions at once.

Questions, records, vectors and postings may all be large; none is broadcast or collected. Clearance is filtered
before ranking, so a caller gets full pages of what they may see.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import graph as G
from .sieve import bitmap

#: Okapi BM25 (Robertson and others): saturation, length normalisation and the weight of a title word.
K1, B, TITLE_WEIGHT = 1.2, 0.75, 10
#: The constant of reciprocal rank fusion (Cormack, Clarke and Buettcher).
RRF_K = 60
#: Vectors of a shard and questions of a block, at about the most: a task scores one of each against the other.
SHARD_ROWS, BLOCK_QUESTIONS, BLOCK_TEXTS = 8192, 8192, 1024
#: Records whose words are counted at once.
COUNT_ROWS = 512


def _accents() -> tuple[str, str]:
    """Latin letters with marks and what is left without these; then the marks themselves, which go."""
    letters = [chr(c) for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)) for c in block]
    plain = {c: unicodedata.normalize("NFD", c)[0] for c in letters if len(unicodedata.normalize("NFD", c)) > 1}
    return "".join(plain) + "".join(map(chr, range(0x300, 0x370))), "".join(plain.values())


def folded(text):
    """Lower case, without the marks of Latin letters. Texts without a character beyond ASCII have none to take off."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(F.translate(low, *_accents()))


def terms(text):
    """Runs of letters and digits of any script, folded."""
    return F.array_remove(F.split(folded(text), r"[^\p{L}\p{N}]+"), "")


def _times(bits: np.ndarray):
    """Distinct words of rows (id, head, body) that have a bit, with how often they stand there. Nested, so that it is sent by value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, COUNT_ROWS):
                batch = whole.slice(at, COUNT_ROWS)
                body, head = batch.column("body"), batch.column("head")
                n_body, n_head = (pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in (body, head))
                words = pa.concat_arrays([body.flatten(), head.flatten()]).dictionary_encode()
                at = np.array([zlib.crc32(w) for w in words.dictionary.cast(pa.binary()).to_pylist()], np.int64) % (len(bits) * 64)
                code = words.indices.to_numpy(zero_copy_only=False)
                some = ((bits[at >> 6] >> (at & 63)) & 1 == 1)[code]
                row = np.concatenate([np.repeat(np.arange(batch.num_rows), n) for n in (n_body, n_head)])
                weight = np.repeat([1, TITLE_WEIGHT], [n_body.sum(), n_head.sum()])
                size = max(1, len(words.dictionary))
                own, place = np.unique((row * size + code)[some], return_inverse=True)
                times = np.bincount(place, weights=weight[some], minlength=len(own)).astype(np.int32)
                ends = pa.array(np.searchsorted(own // size, np.arange(batch.num_rows + 1)), pa.int32())
                terms_ = pa.ListArray.from_arrays(ends, words.dictionary.take(pa.array(own % size, pa.int64())))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_body, pa.int32()), terms_, pa.ListArray.from_arrays(ends, pa.array(times))], ["id", "length", "terms", "times"])

    return run


def counted(records: DataFrame, names: DataFrame) -> DataFrame:
    """(id, length, terms, times): a row for each record with how often each of the asked terms (term) stands in it, and few others; title words weigh TITLE_WEIGHT. Written.

    A record's words are counted where it is read, so nothing is dealt, and whoever asks for them later need not cut the texts again.
    """
    rows = records.select("id", terms(F.col("title")).alias("head"), terms(F.col("content")).alias("body"))
    kind = rows.schema["id"].dataType.simpleString()
    return G.cut(rows.mapInArrow(_times(bitmap(names, "term")), f"id {kind}, length int, terms array<string>, times array<int>"))


def frequencies(counted: DataFrame, names: DataFrame) -> DataFrame:
    """(term, df, n, mean): in how many records (``counted``) each of the terms (term) stands; beside it, the number of records and their mean length. Written."""
    facts = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    held = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return G.cut(held.join(names.select("term").distinct(), "term", "left_semi").crossJoin(F.broadcast(facts)))  # facts is one row


def rarity() -> Column:
    """The weight of a term by its ``frequencies``."""
    return F.ln(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each question, ranks from 1; ties to the smaller id."""
    order = W.partitionBy("question").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _lexical(k: int):
    """The k records of a shard (id, length, terms, times) with the largest sums of their shared words' weights, for each question of a block (question, asked_term, idf, mean). Nested, so that it is sent by value."""

    def run(hits: pa.Table, asked: pa.Table) -> pa.Table:
        parts = [pa.table({"question": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
        if hits.num_rows and asked.num_rows:
            ids, doc = np.unique(hits["id"].to_numpy(), return_inverse=True)
            names, row = np.unique(asked["question"].to_numpy(), return_inverse=True)
            words = pc.unique(asked["asked_term"])
            of_ask = pc.index_in(asked["asked_term"], value_set=words).to_numpy()
            of_hit = pc.fill_null(pc.index_in(pc.list_flatten(hits["terms"]), value_set=words), -1).to_numpy()
            shared = np.nonzero(of_hit >= 0)[0]  # records hold the words of all questions
            line = np.repeat(np.arange(hits.num_rows), pc.list_value_length(hits["terms"]).to_numpy())[shared]
            of_hit, tf, length = of_hit[shared], pc.list_flatten(hits["times"]).to_numpy()[shared].astype(np.float64), hits["length"].to_numpy()[line].astype(np.float64)
            idf = np.zeros(len(words))
            idf[of_ask] = asked["idf"].to_numpy()
            weight = idf[of_hit] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / asked["mean"][0].as_py()))
            by_hit, by_ask = np.argsort(of_hit, kind="stable"), np.argsort(of_ask, kind="stable")
            doc, weight, of_hit, row = doc[line][by_hit], weight[by_hit], of_hit[by_hit], row[by_ask]
            edges = np.arange(len(words) + 1)
            at, at_ask = np.searchsorted(of_hit, edges), np.searchsorted(of_ask[by_ask], edges)
            score = np.zeros((len(names), len(ids)))
            for t in np.nonzero(np.diff(at))[0]:
                d, w, q = doc[at[t] : at[t + 1]], weight[at[t] : at[t + 1]], row[at_ask[t] : at_ask[t + 1]]
                if len(d) * 8 > len(ids):
                    score[q] += np.bincount(d, weights=w, minlength=len(ids))
                else:
                    np.add.at(score, (q[:, None], d[None, :]), w[None, :])
            for name, line in zip(names, score, strict=True):
                some = np.nonzero(line)[0]
                value = np.round(line[some], 6)
                if len(some) > k:
                    high = value >= np.partition(value, -k)[-k]
                    some, value = some[high], value[high]
                best = np.lexsort((ids[some], -value))[:k]
                parts.append(pa.table({"question": pa.array(np.full(len(best), name), pa.int64()), "id": pa.array(ids[some[best]], pa.int64()), "score": pa.array(value[best], pa.float64())}))
        return pa.concat_tables(parts)

    return run


def _home(name: str, m: int):
    return F.pmod(F.xxhash64(name), F.lit(m)).cast("int")


def bm25(records: DataFrame, questions: DataFrame, k: int = 10, clearance: int = 3, shard_rows: int = SHARD_ROWS, block_questions: int = BLOCK_TEXTS) -> DataFrame:
    """question, id, score, rank. Only asked terms of the records are kept. Rows without an id take no part."""
    seen = records.where((F.col("clearance") <= clearance) & F.col("id").isNotNull())
    asked = G.cut(questions.where("question is not null").select(F.col("question").cast("long").alias("question"), F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct())
    names = G.cut(asked.select("term").distinct())
    held = counted(seen, names)
    return lexical(held, frequencies(held, names), asked, k, shard_rows, block_questions)


def lexical(held: DataFrame, known: DataFrame, asked: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS, block_questions: int = BLOCK_TEXTS) -> DataFrame:
    """question, id, score, rank of records (``counted``) for asked (question, term) terms. known: their ``frequencies``.

    A record goes to each block of questions with all of its terms, in one row, and is there summed for a shard of records at a
    time: a row for each record and question that share a word would be many times the input.
    """
    n_seen, n_asking = held.count(), asked.select("question").distinct().count()
    shards, blocks = max(1, -(-n_seen // shard_rows)), max(1, -(-n_asking // block_questions))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = held.where(F.size("terms") > 0).select(F.col("id").cast("long").alias("id"), "length", "terms", "times").withColumn("shard", _home("id", shards)).withColumn("block", every(blocks))
    weighed = asked.distinct().join(known, "term").select(F.col("question").cast("long").alias("question"), F.col("term").alias("asked_term"), rarity().alias("idf"), "mean")
    right = weighed.withColumn("at_block", _home("question", blocks)).withColumn("at_shard", every(shards))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("at_shard", "at_block")).applyInArrow(_lexical(k), "question long, id long, score double")
    return top(found, k).select("question", "id", "score", "rank")


def _nearest(k: int):
    """The k best vectors of a shard for each question of a block; ties to the smaller id. Nested, so that it is sent by value."""

    def run(vectors: pa.Table, questions: pa.Table) -> pa.Table:
        def unit(column: pa.ChunkedArray, rows: list[int]) -> np.ndarray:
            x = np.array(column.take(rows).to_pylist(), np.float64)
            return x / np.sqrt((x**2).sum(axis=1))[:, None]

        def by_width(column: pa.ChunkedArray) -> dict[int, list[int]]:
            out: dict[int, list[int]] = {}
            for row, n in enumerate(pc.list_value_length(column).to_pylist()):
                out.setdefault(n, []).append(row)
            return out

        parts = [pa.table({"question": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
        held, asking = by_width(vectors["v"]), by_width(questions["q"])
        for width in held.keys() & asking.keys():  # vectors of different lengths have no angle
            x, ids = unit(vectors["v"], held[width]), vectors["id"].to_numpy()[held[width]]
            q, asked = unit(questions["q"], asking[width]), questions["question"].to_numpy()[asking[width]]
            for at in range(0, len(q), 256):
                names = asked[at : at + 256]
                score = np.round(q[at : at + 256] @ x.T, 6)
                score[names[:, None] == ids[None, :]] = -np.inf
                kth = -np.partition(-score, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(names), -np.inf)
                row, col = np.nonzero((score >= kth[:, None]) & np.isfinite(score))
                order = np.lexsort((ids[col], -score[row, col], row))
                row, col = row[order], col[order]
                best = np.arange(len(row)) - np.searchsorted(row, row) < k
                parts.append(pa.table({"question": pa.array(names[row[best]], pa.int64()), "id": pa.array(ids[col[best]], pa.int64()), "score": pa.array(score[row[best], col[best]], pa.float64())}))
        return pa.concat_tables(parts)

    return run


def cosine(vectors: DataFrame, questions: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS, block_questions: int = BLOCK_QUESTIONS) -> DataFrame:
    """question, id, score, rank of vectors (id, v) for questions (question, q).

    Both sides may grow: each pair of a shard of vectors and a block of questions is scored in one task and sends
    at most k rows a question on. Vectors without a direction (null, with null or non-finite components, all zero) and rows
    without an id take no part.
    """
    def sound(v):
        return v.isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(v, lambda x: x != 0)

    held = vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where(F.col("id").isNotNull() & sound(F.col("v")))
    asked = questions.select(F.col("question").cast("long").alias("question"), F.col("q").cast("array<double>").alias("q")).where(F.col("question").isNotNull() & sound(F.col("q")))
    shards, blocks = max(1, -(-held.count() // shard_rows)), max(1, -(-asked.count() // block_questions))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = held.withColumn("shard", _home("id", shards)).withColumn("block", every(blocks))
    right = asked.withColumn("at_block", _home("question", blocks)).withColumn("at_shard", every(shards))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("at_shard", "at_block")).applyInArrow(_nearest(k), "question long, id long, score double")
    return top(found, k)


def fuse(dense: DataFrame, sparse: DataFrame, k: int = 10, dense_weight: float = 1.0, sparse_weight: float = 1.0) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists; ties: dense rank, then sparse rank, then id."""
    d = dense.select("question", "id", F.col("rank").alias("dense_rank"))
    s = sparse.select("question", "id", F.col("rank").alias("sparse_rank"))
    part = lambda rank, w: F.coalesce(F.lit(w) / (F.lit(RRF_K) + F.col(rank)), F.lit(0.0))
    both = d.join(s, ["question", "id"], "full_outer").withColumn("score", F.round(part("dense_rank", dense_weight) + part("sparse_rank", sparse_weight), 6))
    order = W.partitionBy("question").orderBy(F.desc("score"), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last(), "id")
    return both.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("question", "id", "score", "rank")
