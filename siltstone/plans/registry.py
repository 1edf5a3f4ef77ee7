"""All registered queries that are not part of the corpus subpackage, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import function_queries, graph_queries, record_queries, relational, retrieval_queries, text_queries, views

FLAGSHIP = "hybrid_rrf"


def _sql(body: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views.register(spark, sf_dir)
        return spark.sql(body)

    return run


QUERIES = {name: _sql(body) for name, body in relational.SQL.items()} | retrieval_queries.QUERIES | function_queries.QUERIES | text_queries.QUERIES | graph_queries.QUERIES | record_queries.QUERIES
ORACLES = {name: views.with_views(body) for name, body in relational.SQL.items()} | retrieval_queries.ORACLES | function_queries.ORACLES | text_queries.ORACLES | graph_queries.ORACLES | record_queries.ORACLES
