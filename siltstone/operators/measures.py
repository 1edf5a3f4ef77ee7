"""Measures of retrieval and of latencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 100_000


def latencies(rows: DataFrame, value: str, *keys: str, exact: bool = False) -> DataFrame:
    """n, mean, p50, p95 and the highest of a column by keys. Percentiles are of the values themselves: ranked ones to one part in ACCURACY or, if exact, interpolated ones over sorted groups."""
    of = (lambda p: F.percentile(value, F.lit(p))) if exact else (lambda p: F.percentile_approx(value, p, ACCURACY))
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), of(0.5).alias("p50"), of(0.95).alias("p95"), F.max(value).alias("highest"))


def ranks(hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """(question, rank): the best rank of any wanted record (question, id) among hits (question, id, rank); null where none is found."""
    asked = wanted.select("question").distinct()
    best = hits.join(wanted.select("question", "id").distinct(), ["question", "id"], "left_semi").groupBy("question").agg(F.min("rank").alias("rank"))
    return asked.join(best, "question", "left")


def quality(found: DataFrame, at: Sequence[int] = (1, 5, 10), most: int = 10) -> DataFrame:
    """One row of questions, hit@k for each k, and MRR at ``most``, from (question, rank)."""
    hit = lambda k: F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0)))
    mrr: Column = F.avg(F.when(F.col("rank") <= most, 1.0 / F.col("rank")).otherwise(F.lit(0.0)))
    return found.agg(F.count(F.lit(1)).alias("questions"), *(F.round(hit(k), 6).alias(f"hit_at_{k}") for k in at), F.round(mrr, 6).alias(f"mrr_at_{most}"))


def coverage(hits: DataFrame, part: str, whole: DataFrame) -> DataFrame:
    """(question, covered, share): how many of the parts of ``whole`` a question's hits touch."""
    n = whole.select(part).distinct().agg(F.count(F.lit(1)).alias("__n"))
    return hits.groupBy("question").agg(F.countDistinct(part).alias("covered")).crossJoin(F.broadcast(n)).select("question", "covered", F.round(F.col("covered") / F.col("__n"), 6).alias("share"))
