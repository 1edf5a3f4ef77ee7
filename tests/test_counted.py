"""Records are cut into terms once, where they are read."""

import random

from pyspark.sql import functions as F

from siltstone.operators import lookup
from siltstone.operators import retrieval as R


def test_counts_of_asked_terms(spark, monkeypatch):
    rng = random.Random(5)
    line = lambda n: " ".join(rng.choice(["Ação", "b", "c-d", "e", "漢字", "x1"]) for _ in range(n))
    rows = [(i, line(rng.randint(0, 3)) or None, line(rng.choice([0, 1, 700])) or None) for i in range(1200)]
    names = spark.createDataFrame([("acao",), ("c",), ("漢字",), ("nowhere",)], "term string")
    asked = {"acao", "c", "漢字"}
    cut = lambda text: (text or "").lower().replace("ação", "acao").replace("-", " ").split()
    found = R.counted(spark.createDataFrame(rows, "id long, title string, content string").repartition(2), names)
    got = {r.id: (r.length, {t: n for t, n in zip(r.terms, r.times, strict=True) if t in asked}) for r in found.collect()}
    assert got == {i: (len(cut(b)), {t: n for t in asked if (n := 10 * cut(h).count(t) + cut(b).count(t))}) for i, h, b in rows}
    known = {r.term: (r.df, r.n, round(r["mean"], 6)) for r in R.frequencies(found, names).collect()}
    mean = round(sum(x[0] for x in got.values()) / 1200, 6)
    assert known == {t: (sum(t in x[1] for x in got.values()), 1200, mean) for t in asked}
    assert R.counted(found.select("id", F.lit("").alias("title"), F.lit("").alias("content")).limit(0), names).count() == 0


def _watched(spark, reads):
    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    shape = "id long, doc_identifier string, title string, content string, clearance int"
    return spark.createDataFrame([(i, f"D-{i}", f"t{i}", f"alpha beta w{i % 7} gamma w{i % 3}", 0) for i in range(200)], shape).mapInArrow(seen, shape)


def test_the_cascade_cuts_its_records_once(spark):
    """They were cut anew for frequencies, each stage and each ranking, and the counts of each were dealt by term."""
    reads = spark.sparkContext.accumulator(0)
    records = _watched(spark, reads)
    asked = spark.createDataFrame([(0, "alpha w3 w2"), (1, "w5 nothing"), (2, "t9")], "question long, text string")
    found = lookup.cascade(records, asked, 3, 3).collect()
    assert {r.question for r in found} == {0, 1, 2} and [r.id for r in found if r.question == 2] == [9]
    assert reads.value <= 3 * 200  # once for its terms, once for the texts of what was found, and a plan's second try


def test_names_that_stand_in_no_text_are_not_scored(spark):
    """Records were cut again for frequencies and ranks of nothing."""
    reads = spark.sparkContext.accumulator(0)
    found = lookup.exact_lookup(_watched(spark, reads), spark.createDataFrame([(0, "d-7", "D-7", "state of"), (1, "D-900", "D-900", "")], "question long, raw string, norm string, text string"))
    assert [(r.question, r.id, r.score, r.source, r["rank"]) for r in found.collect()] == [(0, 7, 0.99, "identifier", 1)]
    assert reads.value <= 2 * 200  # once for names, once for texts
