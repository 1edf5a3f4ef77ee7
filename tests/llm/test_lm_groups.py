"""Tables of rows of megabytes: their row groups, which bound what a task holds of them, don't grow with the table."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from siltstone.llm import common as C
from siltstone.llm import lm_score as M


def test_row_groups_are_bounded(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b "), F.repeat(F.sha2(F.col("id").cast("string"), 512), 8000)).alias("text")).coalesce(1)
    before = len(C.Store.made)
    rows = M.score_documents(docs, chunk_bytes=1 << 20).collect()
    assert len(rows) == 60
    (own,) = C.Store.made[before:]
    files = glob.glob(f"{own.root.removeprefix('file://')}/chunks/*.parquet")
    groups = [pq.read_metadata(f).row_group(i).num_rows for f in files for i in range(pq.read_metadata(f).num_row_groups)]
    assert sum(groups) >= 55 and max(groups) <= M.CHUNK_ROWS
    own.close()
