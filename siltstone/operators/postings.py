"""A written inverted index: postings in blocks with what bounds their scores, replaced bucket by bucket as records change.

A bucket holds the records of a range of ``rows`` ids, so a delivery of neighbouring records touches few of
them and a bucket never holds more than that. In it, each term and clearance has its postings in id order, cut into
blocks of BLOCK, and a block states its largest term frequency and its smallest length: no posting in it can score
more than one with both. Document frequencies are kept as one part for each bucket; a search adds up those of
the terms it asks for. So an update rewrites the files of the buckets that it touches and no others.

A search reads the blocks of asked terms only. In a bucket the terms of a question are taken from the largest bound
down; once the bounds of what is left can't lift a new record past the current kth score, only records that may still
win are completed (MaxScore), and a block without such a record, or whose bound lifts none of them to the kth score, is not
decoded (block-max).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import workspace
from . import retrieval as R

#: Postings in a block; ids for each bucket.
BLOCK, ROWS = 128, 8192
#: Scores are rounded to six digits; bounds keep more than that as slack.
SLACK = 1e-5
TABLES = ("postings", "stats")
#: A term that every record has once: its postings are the records of a bucket with their lengths. Real terms are not empty.
EVERY = ""
FOUND = "question long, id long, score double, read long, held long"


def _rows(records: DataFrame) -> DataFrame:
    """(bucket, id, clearance, length, body, head, gone) of each record: its terms, joined by spaces, which no term holds."""
    body, head = R.terms(F.col("content")), R.terms(F.col("title"))
    return records.select("bucket", "id", "clearance", F.size(body).alias("length"), F.array_join(body, " ").alias("body"), F.array_join(head, " ").alias("head"), F.lit(False).alias("gone"))


def _sound(records: DataFrame) -> DataFrame:
    """Records with an id; without a clearance they are for no one."""
    kept = records.where("id is not null and clearance is not null")
    return kept.select(F.col("id").cast("long").alias("id"), F.col("clearance").cast("int").alias("clearance"), "title", "content")


#: What a bucket's task makes: blocks of BLOCK postings at the most, in the order of terms within a task.
BLOCKS = "term string, clearance int, block int, ids array<long>, tfs array<int>, lengths array<int>, max_tf int, min_length int, df long, bucket long"


def _invert(rows: int):
    """The blocks of a bucket: its old blocks (an empty table if there are none) without the ids that come in ``new``, whose rows that are not gone are added. Nested, so that it is sent by value.

    Postings are sorted in numpy in one go; a task holds those of one bucket. Title words weigh R.TITLE_WEIGHT; each record has EVERY once.
    """
    title_weight, block_rows, every = R.TITLE_WEIGHT, BLOCK, EVERY

    def run(key: tuple, old: pa.Table, new: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        touched = np.unique(new["id"].to_numpy())
        new = new.filter(pc.invert(new["gone"]))
        terms, of, count, weight = [], [], [], []  # the terms of each part, and for each term its row, how often it is repeated and what it weighs
        for name, w in (("body", 1), ("head", title_weight)):
            lists = pc.split_pattern(pc.cast(new[name], pa.large_string()).combine_chunks(), " ")
            row, values = np.repeat(np.arange(new.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten()
            real = pc.not_equal(values, "").to_numpy(zero_copy_only=False)
            terms.append(values.filter(pa.array(real)))
            of.append(row[real])
            weight.append(np.full(len(of[-1]), w))
        terms.append(pa.array([every] * new.num_rows, pa.large_string()))
        of.append(np.arange(new.num_rows))
        weight.append(np.ones(new.num_rows, np.int64))
        terms.append(pc.cast(old["term"], pa.large_string()).combine_chunks())
        coded = pa.concat_arrays(terms).dictionary_encode()
        codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        fresh, held = codes[: len(codes) - old.num_rows], codes[len(codes) - old.num_rows :]
        n = max(1, new.num_rows)
        pair, own = np.unique(fresh * n + np.concatenate(of), return_inverse=True)
        tf = np.bincount(own, weights=np.concatenate(weight), minlength=len(pair)).astype(np.int64)
        code, row = pair // n, pair % n
        column = lambda t, c: t[c].to_numpy().astype(np.int64)
        code, tf, ids, length, clearance = ([x] for x in (code, tf, column(new, "id")[row], column(new, "length")[row], column(new, "clearance")[row]))
        if old.num_rows:
            flat = lambda c: old[c].combine_chunks().flatten().to_numpy().astype(np.int64)
            sizes = pc.list_value_length(old["ids"]).to_numpy()
            was = flat("ids")
            stays = ~np.isin(was, touched)
            for into, values in ((code, np.repeat(held, sizes)), (tf, flat("tfs")), (ids, was), (length, flat("lengths")), (clearance, np.repeat(column(old, "clearance"), sizes))):
                into.append(values[stays])
        code, tf, ids, length, clearance = (np.concatenate(x) for x in (code, tf, ids, length, clearance))
        levels, level = np.unique(clearance, return_inverse=True)
        group = code * max(1, len(levels)) + level
        order = np.lexsort((length, group * rows + (ids - bucket * rows)))
        group, code, tf, ids, length, clearance = (x[order] for x in (group, code, tf, ids, length, clearance))
        # Equal rows of one id are one record's.
        first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (ids[1:] != ids[:-1]) | (length[1:] != length[:-1])])) if len(ids) else np.zeros(0, np.int64)
        tf = np.add.reduceat(tf, first) if len(first) else tf[:0]
        group, code, ids, length, clearance = (x[first] for x in (group, code, ids, length, clearance))
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(ids) else np.zeros(0, np.int64)
        df = np.diff(np.append(starts, len(ids)))
        within = np.arange(len(ids)) - np.repeat(starts, df)
        at = np.flatnonzero(within % block_rows == 0)
        edges = pa.array(np.append(at, len(ids)), pa.int32())
        lists = lambda values, kind: pa.ListArray.from_arrays(edges, pa.array(values, kind))
        least, most = (np.minimum.reduceat(length, at), np.maximum.reduceat(tf, at)) if len(at) else (length, tf)
        return pa.table({
            "term": pc.cast(words.take(pa.array(code[at])), pa.string()), "clearance": pa.array(clearance[at], pa.int32()), "block": pa.array(within[at] // block_rows, pa.int32()),
            "ids": lists(ids, pa.int64()), "tfs": lists(tf, pa.int32()), "lengths": lists(length, pa.int32()), "max_tf": pa.array(most, pa.int32()), "min_length": pa.array(least, pa.int32()),
            "df": pa.array(np.repeat(df, df)[at], pa.int64()), "bucket": pa.array(np.full(len(at), bucket), pa.int64()),
        })

    return run


@dataclass
class Index:
    """A folder with the tables postings and stats, both partitioned by bucket."""

    spark: SparkSession
    where: str
    rows: int = ROWS

    def table(self, name: str) -> DataFrame:
        schemas = {
            "postings": BLOCKS,
            "stats": "term string, clearance int, n long, length long, bucket long",
        }
        return self.spark.read.schema(schemas[name]).parquet(f"{self.where}/{name}")

    def bucket(self, frame: DataFrame) -> DataFrame:
        return frame.withColumn("bucket", F.floor(F.col("id") / F.lit(self.rows)))

    def _put(self, name: str, frame: DataFrame, *order: str) -> None:
        """Replaces the buckets that the frame holds."""
        frame.sortWithinPartitions("bucket", *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.where}/{name}")

    def _write(self, postings: DataFrame, touched: DataFrame | None) -> None:
        """Replaces the postings of the buckets that the frame, dealt by bucket, holds, and the statistics of those touched. A term's first block tells its frequency."""
        self._put("postings", postings, "term", "clearance", "block")
        if not workspace.exists(self.spark, f"{self.where}/postings"):
            return
        held = self.table("postings") if touched is None else self.table("postings").join(touched, "bucket", "left_semi")
        terms = held.where((F.col("block") == 0) & (F.col("term") != EVERY)).select("term", "clearance", F.col("df").alias("n"), F.lit(0).cast("long").alias("length"), "bucket")
        total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
        totals = held.where(F.col("term") == EVERY).groupBy("clearance", "bucket").agg(F.sum(F.size("ids")).cast("long").alias("n"), F.sum(total).alias("length")).select(F.lit(None).cast("string").alias("term"), "clearance", "n", "length", "bucket")
        self._put("stats", terms.unionByName(totals).repartition("bucket"), "term")

    @classmethod
    def build(cls, records: DataFrame, where: str, rows: int = ROWS) -> Index:
        """The index of records (id, clearance, title, content) in a new folder. Rows that share an id are one record's only if they are equal in length."""
        index = cls(records.sparkSession, where, rows)
        nothing = index.spark.createDataFrame([], BLOCKS)
        made = nothing.groupBy("bucket").cogroup(_rows(index.bucket(_sound(records))).groupBy("bucket")).applyInArrow(_invert(rows), BLOCKS)
        index._write(made, None)
        for name in TABLES:  # an index of nothing has its folders too
            if not workspace.exists(index.spark, f"{where}/{name}"):
                index.table_of_nothing(name)
        return index

    def table_of_nothing(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.where}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(path)

    def update(self, changed: DataFrame, deleted: DataFrame) -> None:
        """Puts changed records (id, clearance, title, content) in the place of those with their ids, and takes out deleted ones (id).

        Only buckets of those ids are read and written. An update that was broken off is mended by doing it again.
        """
        new, gone = _sound(changed), deleted.select(F.col("id").cast("long").alias("id")).where("id is not null")
        with workspace.Scratch(self.spark, "index-update") as scratch:
            ids = scratch.put("ids", self.bucket(new.select("id").unionByName(gone).distinct()))
            touched = scratch.put("touched", ids.select("bucket").distinct())
            kept = self.table("postings").join(touched, "bucket", "left_semi")
            gone_rows = ids.select("bucket", "id", F.lit(0).alias("clearance"), F.lit(0).alias("length"), F.lit("").alias("body"), F.lit("").alias("head"), F.lit(True).alias("gone"))
            after = _rows(self.bucket(new)).unionByName(gone_rows)
            # Written aside first, as it reads what it replaces.
            held = scratch.put("held", kept.groupBy("bucket").cogroup(after.groupBy("bucket")).applyInArrow(_invert(self.rows), BLOCKS))
            self._write(held.repartition("bucket"), touched)
            # A bucket that is empty now has no rows to replace its files with.
            for r in touched.join(held.select("bucket").distinct(), "bucket", "left_anti").toLocalIterator():
                for name in TABLES:
                    workspace.drop(self.spark, f"{self.where}/{name}/bucket={r.bucket}")

    def frequencies(self, terms: DataFrame, clearance: int) -> DataFrame:
        """(term, df) of the terms (term), over all buckets."""
        seen = self.table("stats").where((F.col("clearance") <= clearance) & F.col("term").isNotNull())
        return seen.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))

    def facts(self, clearance: int) -> tuple[int, float, int, int]:
        """Records, their mean length, and the first and last bucket."""
        r = self.table("stats").where((F.col("clearance") <= clearance) & F.col("term").isNull()).agg(F.sum("n").alias("n"), F.sum("length").alias("length"), F.min("bucket").alias("low"), F.max("bucket").alias("high")).first()
        return (r.n, r.length / r.n, r.low, r.high) if r.n else (0, 0.0, 0, -1)

    def _found(self, questions: DataFrame, k: int, clearance: int, block_questions: int) -> DataFrame:
        n, mean, low, high = self.facts(clearance)
        asking = questions.where("question is not null").select(F.col("question").cast("long").alias("question"), "text")
        blocks = max(1, -(-asking.count() // block_questions))
        asked = asking.select("question", F.explode(F.array_distinct(R.terms(F.col("text")))).alias("term")).distinct()
        idf = F.ln(F.lit(1.0) + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighed = asked.join(self.frequencies(asked, clearance), "term").select("question", "term", idf.alias("idf"), R._home("question", blocks).alias("at"))
        wanted = weighed.select("term", "at").distinct()
        hits = self.table("postings").where(F.col("clearance") <= clearance).join(wanted, "term")
        every = F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long"))) if high >= low else F.lit(None).cast("long")  # the type of bucket, as equal keys of two types are dealt apart
        spread = weighed.select("question", F.col("term").alias("asked_term"), "idf", F.col("at").alias("at_block"), every.alias("at_bucket"))
        return hits.groupBy("bucket", "at").cogroup(spread.groupBy("at_bucket", "at_block")).applyInArrow(_best(k, mean, self.rows), FOUND)

    def search(self, questions: DataFrame, k: int = 10, clearance: int = 3, block_questions: int = R.BLOCK_TEXTS) -> DataFrame:
        """question, id, score, rank by BM25 for questions (question, text): the rows of ``retrieval.bm25`` over the indexed records."""
        return R.top(self._found(questions, k, clearance, block_questions).where("id is not null"), k).select("question", "id", "score", "rank")

    def work(self, questions: DataFrame, k: int = 10, clearance: int = 3, block_questions: int = R.BLOCK_TEXTS) -> DataFrame:
        """question, read, held: the postings that a search decodes for each question, and those that its terms have."""
        told = self._found(questions, k, clearance, block_questions).where("id is null")
        return told.groupBy("question").agg(F.sum("read").alias("read"), F.sum("held").alias("held"))


def _best(k: int, mean: float, rows: int):
    """The k best records of a bucket for each question of a block, and a row that tells the work. Nested, so that it is sent by value."""
    k1, b = R.K1, R.B

    def impact(tf, length):
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))

    class Term:
        """A term's blocks in the bucket; a block is decoded when first needed."""

        def __init__(self, hits: pa.Table, at: np.ndarray):
            ids = [hits["ids"][i].values.to_numpy() for i in at.tolist()]
            self.places = [x % rows for x in ids]
            self.first, self.last = np.array([p[0] for p in self.places]), np.array([p[-1] for p in self.places])
            self.sizes = np.array([len(p) for p in self.places])
            self.bound = impact(hits["max_tf"].to_numpy()[at].astype(np.float64), hits["min_length"].to_numpy()[at])
            self.raw, self.weights = [(hits["tfs"][i], hits["lengths"][i]) for i in at.tolist()], [None] * len(at)

        def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
            if self.weights[i] is None:
                tf, length = (x.values.to_numpy() for x in self.raw[i])
                self.weights[i] = impact(tf.astype(np.float64), length)
            return self.places[i], self.weights[i]

    def one(terms: list[tuple[float, "Term"]]) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, scores, postings read) of the k best."""
        terms = sorted(terms, key=lambda t: -t[0] * t[1].bound.max())
        left = np.append(np.cumsum([idf * t.bound.max() for idf, t in terms][::-1])[::-1], 0.0)
        score, read, floor, i = np.zeros(rows), 0, 0.0, 0
        while i < len(terms) and left[i] >= floor - SLACK:
            idf, term = terms[i]
            for j in range(len(term.sizes)):
                place, weight = term.block(j)
                score[place] += idf * weight
            read += int(term.sizes.sum())
            i += 1
            if rows > k:
                floor = float(np.partition(score, rows - k)[rows - k])
        alive = np.flatnonzero((score > 0) & (score + left[i] >= floor - SLACK))
        while i < len(terms):
            idf, term = terms[i]
            low, high = np.searchsorted(alive, term.first), np.searchsorted(alive, term.last, side="right")
            for j in np.flatnonzero(low < high):
                own = alive[low[j] : high[j]]
                if score[own].max() + idf * term.bound[j] + left[i + 1] < floor - SLACK:
                    continue
                place, weight = term.block(j)
                at = np.searchsorted(place, own)
                hit = (at < len(place)) & (place[np.minimum(at, len(place) - 1)] == own)
                score[own[hit]] += idf * weight[at[hit]]
                read += len(place)
            i += 1
            if len(alive) > k:
                floor = max(floor, float(np.partition(score[alive], len(alive) - k)[len(alive) - k]))
            alive = alive[score[alive] + left[i] >= floor - SLACK]
        value = np.round(score[alive], 6)
        order = np.lexsort((alive, -value))[:k]
        return alive[order], value[order], read

    def run(key: tuple, hits: pa.Table, asked: pa.Table) -> pa.Table:
        cols: list[list] = [[], [], [], [], []]
        if hits.num_rows and asked.num_rows:
            hits = hits.sort_by([("term", "ascending"), ("clearance", "ascending"), ("block", "ascending")]).combine_chunks()
            base = key[0].as_py() * rows
            words = pc.unique(hits["term"])
            of_hit, of_ask = pc.index_in(hits["term"], value_set=words).to_numpy(), pc.index_in(asked["asked_term"], value_set=words).fill_null(-1).to_numpy()
            edges = np.searchsorted(of_hit, np.arange(len(words) + 1))
            terms: dict[int, Term] = {}
            question, idf = asked["question"].to_numpy(), asked["idf"].to_numpy()
            order = np.argsort(question, kind="stable")
            order = order[of_ask[order] >= 0]
            starts = np.flatnonzero(np.concatenate([[True], question[order][1:] != question[order][:-1]])) if len(order) else []
            for a, z in zip(starts, [*starts[1:], len(order)], strict=True):
                own = []
                for at in order[a:z].tolist():
                    t = int(of_ask[at])
                    if t not in terms:
                        terms[t] = Term(hits, np.arange(edges[t], edges[t + 1]))
                    own.append((float(idf[at]), terms[t]))
                places, scores, read = one(own)
                name = int(question[order[a]])
                for col, values in zip(cols, ([name] * (len(places) + 1), [*(places + base).tolist(), None], [*scores.tolist(), None], [None] * len(places) + [read], [None] * len(places) + [int(sum(t.sizes.sum() for _, t in own))]), strict=True):
                    col += values
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        return pa.table({n.split()[0]: pa.array(c, kind) for n, c, kind in zip(FOUND.split(", "), cols, kinds, strict=True)})

    return run
