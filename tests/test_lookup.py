"""Phrases looked up as wholes, and the bitmap that thins rows before they are dealt."""

import random

from pyspark.sql import functions as F

from siltstone.operators import lookup, sieve


def test_a_sieve_lets_every_key_pass_and_few_others(spark):
    keys = spark.range(0, 30000, 3).selectExpr("concat('k', id) AS name")
    passes = sieve.sieve(keys, "name")
    told = spark.range(30000).select("id", passes(F.concat(F.lit("k"), F.col("id"))).alias("p")).where("p").agg(F.sum((F.col("id") % 3 == 0).cast("int")), F.count("*")).first()
    assert told[0] == 10000 and told[1] < 15000
    assert spark.range(100).where(sieve.sieve(keys.limit(0), "name")(F.col("id").cast("string"))).count() == 0


def test_phrases_of_any_length_within_one_field(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcd")
    rows = [(i, " ".join(word() for _ in range(3)), " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(60)]
    phrases = [(q, b, p, [word() for _ in range(rng.randint(0, 7))]) for q in range(40) for b in range(2) for p in range(rng.randint(1, 2))]
    found = lookup.match(spark.createDataFrame(rows, "id long, title string, content string"), spark.createDataFrame(phrases, "question long, branch int, phrase int, terms array<string>"))
    stands = lambda row, terms: bool(terms) and any(f" {' '.join(terms)} " in f" {t} " for t in row[1:])
    want = {(q, b, r[0]) for r in rows for q, b in {x[:2] for x in phrases} if all(stands(r, x[3]) for x in phrases if x[:2] == (q, b))}
    assert {tuple(r) for r in found.collect()} == want and want
    assert lookup.match(spark.createDataFrame(rows, "id long, title string, content string"), spark.createDataFrame([(0, 0, 0, [])], "question long, branch int, phrase int, terms array<string>")).count() == 0


def test_a_word_that_all_phrases_share_is_not_joined(spark):
    """A word that stands a thousand times and in each of two thousand phrases made two million rows."""
    records = spark.createDataFrame([(0, "t", "doc " * 1000 + "doc 77")], "id long, title string, content string")
    clauses = spark.range(2000).selectExpr("id AS question", "0 AS branch", "0 AS phrase", "array('doc', CAST(id AS STRING)) AS terms")
    found = lookup.match(records, clauses)
    assert [tuple(r) for r in found.collect()] == [(77, 0, 0)]

    def rows(plan):
        metric = plan.metrics().get("numOutputRows")
        own = [metric.get().value()] if metric.isDefined() else []
        children = [plan.executedPlan()] if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else [plan.plan()] if plan.getClass().getSimpleName().endswith("QueryStageExec") else []
        inner = plan.children()
        return own + [v for c in children + [inner.apply(i) for i in range(inner.size())] for v in rows(c)]

    assert max(rows(found._jdf.queryExecution().executedPlan())) < 10000
