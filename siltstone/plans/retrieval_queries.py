"""Retrieval over the driver's tables: every benchmark passage and every vector whose id divides by 20 asks, records and vectors answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import workspace
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators.postings import Index
from ..operators.vectorindex import VectorIndex
from . import views


def _inputs(spark, sf_dir):
    views.register(spark, sf_dir)
    questions = spark.table("benchmark").select(F.col("item_id").alias("question"), "text")
    return spark.table("records"), questions


def bm25_top_k(spark, sf_dir):
    records, questions = _inputs(spark, sf_dir)
    return R.bm25(records, questions, clearance=2)


def _dense(spark, k=10):
    vectors = spark.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return R.cosine(vectors, vectors.where("id % 20 = 0").select(F.col("id").alias("question"), F.col("v").alias("q")), k)


def cosine_top_k(spark, sf_dir):
    _inputs(spark, sf_dir)
    return _dense(spark)


def hybrid_rrf(spark, sf_dir, k=10):
    """Each leg gives 2 * k candidates: a record in the middle of both lists may beat the first of one."""
    records, questions = _inputs(spark, sf_dir)
    return R.fuse(_dense(spark, 2 * k), R.bm25(records, questions, 2 * k, clearance=2), k)


def l3_indexed_search(spark, sf_dir):
    """The rows of bm25_top_k from a written index."""
    records, questions = _inputs(spark, sf_dir)
    index = Index.build(records, workspace.fresh(spark, "index"))
    found = G.cut(index.search(questions, clearance=2))
    workspace.drop(spark, index.where)
    return found


def d22_index_update(spark, sf_dir):
    """An index of records of which one package came shortened; then that package comes whole, and another is taken out."""
    records, questions = _inputs(spark, sf_dir)
    short = F.when(F.col("package") == "src3", F.substring("content", 1, 200)).otherwise(F.col("content"))
    index = Index.build(records.withColumn("content", short), workspace.fresh(spark, "index"), rows=512)
    index.update(records.where("package = 'src3'"), records.where("package = 'src4'").select("id"))
    found = G.cut(index.search(questions, clearance=2))
    workspace.drop(spark, index.where)
    return found


def l2_indexed_vectors(spark, sf_dir):
    """The rows of cosine_top_k from a written index of cells, by the exact way."""
    _inputs(spark, sf_dir)
    vectors = spark.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    index = VectorIndex.build(vectors, workspace.fresh(spark, "vectors"))
    found = G.cut(index.search(vectors.where("id % 20 = 0").select(F.col("id").alias("question"), F.col("v").alias("q")), exact=True))
    workspace.drop(spark, index.where)
    return found


QUERIES = {"bm25_top_k": bm25_top_k, "cosine_top_k": cosine_top_k, "hybrid_rrf": hybrid_rrf, "l3_indexed_search": l3_indexed_search, "d22_index_update": d22_index_update, "l2_indexed_vectors": l2_indexed_vectors}

_TERMS = r"list_filter(string_split_regex(strip_accents(lower(coalesce({}, ''))), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _sparse(k, only="TRUE"):
    return f"""
seen AS (SELECT id, {_TERMS.format("content")} AS body, {_TERMS.format("title")} AS head FROM records WHERE clearance <= 2 AND {only}),
size AS (SELECT count(*) AS n, avg(len(body)) AS mean FROM seen),
post AS (SELECT id, term, any_value(length) AS length, CAST(sum(w) AS BIGINT) AS tf FROM (
  SELECT id, unnest(body) AS term, len(body) AS length, 1 AS w FROM seen UNION ALL SELECT id, unnest(head), len(body), {R.TITLE_WEIGHT} FROM seen) GROUP BY id, term),
asked AS (SELECT DISTINCT item_id AS question, unnest({_TERMS.format("text")}) AS term FROM benchmark),
rare AS (SELECT term, count(*) AS df FROM post GROUP BY term),
sparse_all AS (SELECT question, id, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * {R.K1 + 1} / (tf + {R.K1} * ({1 - R.B} + {R.B} * length / mean))), 6) AS score
  FROM post JOIN rare USING (term) JOIN asked USING (term), size GROUP BY question, id),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS rank FROM sparse_all) WHERE rank <= {k})"""


def _dense_sql(k):
    return f"""
dense AS (SELECT * FROM (SELECT question, id, score, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS rank FROM (
  SELECT q.vec_id AS question, v.vec_id AS id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id)) WHERE rank <= {k})"""


_FUSED = f"""SELECT question, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, dr NULLS LAST, sr NULLS LAST, id) AS rank FROM (
  SELECT question, id, d.rank AS dr, s.rank AS sr, round(coalesce(1.0 / ({R.RRF_K} + d.rank), 0) + coalesce(1.0 / ({R.RRF_K} + s.rank), 0), 6) AS score
  FROM dense d FULL OUTER JOIN sparse s USING (question, id))) WHERE rank <= 10"""
ORACLES = {
    "bm25_top_k": views.with_views(f"WITH {_sparse(10)} SELECT question, id, score, rank FROM sparse"),
    "l3_indexed_search": views.with_views(f"WITH {_sparse(10)} SELECT question, id, score, rank FROM sparse"),
    "d22_index_update": views.with_views(f"WITH {_sparse(10, "package IS DISTINCT FROM 'src4'")} SELECT question, id, score, rank FROM sparse"),
    "cosine_top_k": views.with_views(f"WITH {_dense_sql(10)} SELECT question, id, score, rank FROM dense"),
    "l2_indexed_vectors": views.with_views(f"WITH {_dense_sql(10)} SELECT question, id, score, rank FROM dense"),
    "hybrid_rrf": views.with_views(f"WITH {_sparse(20)}, {_dense_sql(20)} {_FUSED}"),
}
