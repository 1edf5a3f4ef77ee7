"""The retrieval queries against plain Python over whole tables, on the smallest tables."""

import math
import os
import re
import unicodedata

import numpy as np
import pytest

from siltstone.operators import retrieval as R
from siltstone.plans import retrieval_queries, views

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def best(scores, k):
    """{id: rank} of the k best of {id: score}; ties to the smaller id."""
    order = sorted(scores, key=lambda i: (-round(scores[i], 6), i))[:k]
    return {i: n + 1 for n, i in enumerate(order)}


def terms(text):
    plain = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not unicodedata.combining(c))
    return [t for t in re.split(r"[\W_]+", plain) if t]


def lexical(spark, k):
    views.register(spark, SF)
    seen = {r.id: (terms(r.content), terms(r.title)) for r in spark.table("records").where("clearance <= 2").collect()}
    mean = sum(len(b) for b, _ in seen.values()) / len(seen)
    df = {}
    for body, head in seen.values():
        for t in {*body, *head}:
            df[t] = df.get(t, 0) + 1
    out = {}
    for q in spark.table("benchmark").collect():
        scores = {}
        for t in sorted(set(terms(q.text))):
            idf = math.log(1 + (len(seen) - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5))
            for i, (body, head) in seen.items():
                tf = body.count(t) + R.TITLE_WEIGHT * head.count(t)
                if tf:
                    scores[i] = scores.get(i, 0) + idf * tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B * len(body) / mean))
        out[q.item_id] = best(scores, k)
    return out


def angular(spark, k):
    views.register(spark, SF)
    v = {r.vec_id: np.array(r.embedding, float) for r in spark.table("embeddings").collect()}
    unit = {i: x / math.sqrt(x @ x) for i, x in v.items()}
    return {q: best({i: float(unit[q] @ unit[i]) for i in v if i != q}, k) for q in v if q % 20 == 0}


def ranks(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.question, {})[r.id] = r["rank"]
    return out


@needs_tables
def test_every_passage_asks(spark):
    whole = {q: r for q, r in lexical(spark, 10).items() if r}
    assert ranks(retrieval_queries.bm25_top_k(spark, SF)) == whole
    questions = spark.table("benchmark").selectExpr("item_id AS question", "text")
    assert ranks(R.bm25(spark.table("records"), questions, clearance=2, shard_rows=40, block_questions=9)) == whole
    assert R.bm25(spark.table("records").limit(0), questions).count() == 0 and R.bm25(spark.table("records"), questions.limit(0)).count() == 0


@needs_tables
def test_every_twentieth_vector_asks(spark):
    assert ranks(retrieval_queries.cosine_top_k(spark, SF)) == angular(spark, 10)


def test_cosine_in_shards_and_blocks(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(300, 5)).round(2)
    x[50:120] = x[50]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 5), (902, [float("nan")] * 5), (903, [1.0, None, 0.0, 0.0, 0.0]), (904, [1.0]), (None, [1.0] * 5)]
    frame = spark.createDataFrame(rows, "id long, v array<float>")
    x = x.astype(np.float32).astype(float)
    unit = x / np.sqrt((x**2).sum(axis=1))[:, None]
    asked = frame.selectExpr("id AS question", "v AS q").where("question % 3 = 0")
    found = R.cosine(frame, asked, k=7, shard_rows=40, block_questions=30)
    assert ranks(found) == {q: best({i: float(unit[q] @ unit[i]) for i in range(300) if i != q}, 7) for q in range(0, 300, 3)}
    assert R.cosine(frame.limit(0), asked).count() == 0 and R.cosine(frame, asked.limit(0)).count() == 0
    assert R.cosine(frame.where("id < 3"), asked.where("question = 0")).count() == 2  # fewer than k


@needs_tables
def test_each_leg_gives_twice_as_many_candidates(spark):
    d, s = angular(spark, 20), lexical(spark, 20)
    expected = set()
    for q in d.keys() | s.keys():
        dense, sparse = d.get(q, {}), s.get(q, {})
        score = {i: round(sum(1 / (R.RRF_K + leg[i]) for leg in (dense, sparse) if i in leg), 6) for i in dense.keys() | sparse.keys()}
        order = sorted(score, key=lambda i: (-score[i], dense.get(i, 99), sparse.get(i, 99), i))[:10]
        expected |= {(q, i, f"{score[i]:.6f}", n + 1) for n, i in enumerate(order)}
    assert {(r.question, r.id, f"{r.score:.6f}", r["rank"]) for r in retrieval_queries.hybrid_rrf(spark, SF).collect()} == expected
