"""Near duplicates in a stream: a document is kept unless one that was kept before it is as similar as the threshold.

Of kept documents the signatures lie in a keyed table, one row for each band. A batch looks up the bands of its own documents
only, drops what a kept one of an earlier batch resembles, and decides the rest among themselves in the order of their
ids. Documents that come in the order of their ids are so decided as ``minhash.first_kept`` decides them all at once, however they are
cut into batches. Both tables are written by batch number: a batch that is done again after a failure reads what was there before it
and gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import minhash as M
from .keyed import KeyedTable

BANDS = "entry string, band long, doc_id long, signature array<long>"
VERDICTS = "doc_id long, kept boolean"


def bands_table(spark: SparkSession, where: str, **options) -> KeyedTable:
    return KeyedTable(spark, where, BANDS, "entry", "band", **options)


def verdict_table(spark: SparkSession, where: str, **options) -> KeyedTable:
    return KeyedTable(spark, where, VERDICTS, "doc_id", **options)


def _keys(signature: Column, threshold: float, n: int) -> Column:
    bands = M.bands_for(threshold, n)
    rows = n // bands
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(k, F.slice(signature, k * rows + 1, rows)))


def decide(batch: DataFrame, number: int, bands: KeyedTable, verdicts: KeyedTable, threshold: float = M.THRESHOLD, n: int = M.PERMUTATIONS, words: int = M.SHINGLE_WORDS) -> None:
    """One batch of documents (doc_id, text). Rows without an id are left out; of rows that share one, one counts."""
    docs = G.cut(batch.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").dropDuplicates(["doc_id"]))
    signed = G.cut(M.signed(docs, n, words))
    keyed = signed.select("doc_id", "signature", F.explode(_keys(F.col("signature"), threshold, n)).alias("band"))
    known = bands.current(before=number, only=keyed.select("band")).select("band", F.col("doc_id").alias("__match"), F.col("signature").alias("__known"))
    close = keyed.join(known, "band").where((F.col("doc_id") != F.col("__match")) & (M.similarity(F.col("signature"), F.col("__known")) >= threshold))
    gone = G.cut(close.select("doc_id").distinct())
    own = G.cut(M.first_kept(docs.join(gone, "doc_id", "left_anti"), threshold, n, words))
    kept = keyed.join(own.where("kept").select("doc_id"), "doc_id", "left_semi")
    bands.put(number, kept.select(F.concat_ws(":", "band", "doc_id").alias("entry"), "band", "doc_id", "signature"))
    verdicts.put(number, own.unionByName(gone.select("doc_id", F.lit(False).alias("kept"))))


def keep_first(docs: DataFrame, bands: KeyedTable, verdicts: KeyedTable, checkpoint: str, threshold: float = M.THRESHOLD):
    """A stream of documents (doc_id, text) whose verdicts (doc_id, kept) are written to a table."""
    return docs.writeStream.foreachBatch(lambda batch, number: decide(batch, number, bands, verdicts, threshold)).option("checkpointLocation", checkpoint)
