"""The bounded sample of labelled rows from which the quality models learn."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import text_stats as S

#: At most about this many labelled rows reach the driver; a hash of the id chooses them where there are more.
MAX_ROWS = 20_000


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_ROWS, stats: tuple[str, ...] = S.STATS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics (rows x stats) and labels of labelled rows that are not held out, in a stated order.

    A document that is labelled several times counts once; one with both labels is left out.
    """
    valid = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    usable = valid.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("__most")).where(F.col("label") == F.col("__most")).select("doc_id", "label")
    n = usable.count()
    if n > max_rows:
        usable = usable.where(C.md5_unit(F.concat(F.lit("label/"), F.col("doc_id").cast("string"))) < max_rows / n)
    usable = usable.limit(max_rows + max_rows // 4)  # rows beyond a fair hash's spread; bounds the broadcast
    texts = docs.select(F.col("doc_id").alias("doc_id"), "text").join(F.broadcast(usable), "doc_id")
    rows = S.with_stats(S.with_words(texts)).select("doc_id", "label", *stats).limit(2 * max_rows).collect()
    rows.sort(key=lambda r: tuple(map(float, r)))
    x = np.array([[float(r[s]) for s in stats] for r in rows], dtype=float).reshape(len(rows), len(stats))
    return x, np.array([r["label"] for r in rows], dtype=float)
