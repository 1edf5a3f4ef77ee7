"""The language model against plain counters; its filter against what went in."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from siltstone.llm import lm_score as M

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, score string, n_tokens int"


def corpus(rows=300):
    draw = random.Random(9)
    vocabulary = ["w%d" % i for i in range(60)]
    after = {w: draw.sample(vocabulary, 4) for w in vocabulary}
    texts = [None, "", " \t\n", "One", "one ONE\x0bone", "É é", "a\x1cb", "zz " * 3000]
    for _ in range(rows):
        w = draw.choice(vocabulary)
        own = [w]
        for _ in range(draw.randint(1, 50)):
            w = draw.choice(after[w]) if draw.random() < 0.9 else draw.choice(vocabulary)
            own.append(w.upper() if draw.random() < 0.1 else w)
        texts.append(" ".join(own))
    data = [(i, t, "x", 3) for i, t in enumerate(texts)]
    return [*data, data[20], data[20], (None, "w1 w2 no id", "x", 3), (21, "another text under a known id", "x", 3)]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def plain(rows, order=3, prior=M.PRIOR):
    """(id, held out, tokens, known, N, base score, score with counts of their levels) by dictionaries."""
    texts = [(i, [*WORD.findall((t or "").encode().lower()), b" "]) for i, t, *_ in rows]
    counts = Counter(tuple(w[k : k + n]) for i, w in texts if not held(i) for n in range(1, order + 1) for k in range(len(w) - n + 1))
    total = sum(c for g, c in counts.items() if len(g) == 1)
    types = sum(len(g) == 1 for g in counts)
    level = lambda c: 1 + sum(x <= c for x in M.LEVELS[1:]) if c else 0
    mean = lambda c: float(M.MEANS[level(c)])
    out = []
    for i, w in texts:
        base = score = 0.0
        for k in range(len(w)):
            p = (counts[(w[k],)] + 0.5) / (total + 0.5 * (types + 1))
            base += math.log10(p)
            for n in range(2, min(order, k + 1) + 1):
                seen, before = mean(counts[tuple(w[k - n + 1 : k + 1])]), tuple(w[k - n + 1 : k])
                if n == 2:
                    seen, history = min(seen, counts[(w[k],)], counts[before]), counts[before]
                else:
                    history = mean(counts[before]) if n > 3 else min(mean(counts[before]), counts[before[:1]], counts[before[1:]])
                p = (seen + prior * p) / (history + prior)
            score += math.log10(p)
        out.append((str(i), held(i), len(w), sum(counts[(x,)] > 0 for x in w), total, base, score))
    return sorted(out)


def got(frame):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in frame.collect())


@pytest.mark.parametrize("order", [2, 3])
def test_equals_dictionaries(spark, order):
    rows = corpus()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    ours, theirs = got(M.score_documents(frame, order, chunk_bytes=5000)), plain(rows, order)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    near = [a[6] == pytest.approx(b[6], rel=1e-9) for a, b in zip(ours, theirs, strict=True)]
    assert sum(near) > 0.6 * len(near)  # a false hit of the filter changes the rest
    assert all(abs(a[6] - b[6]) < 0.02 * a[2] + 0.5 for a, b in zip(ours, theirs, strict=True))
    unseen = [a for a in ours if a[1] and a[2] > 5]
    assert sum(a[6] for a in unseen) > sum(a[5] for a in unseen)  # better than words alone on held-out texts


def test_both_ways_to_the_segments_agree(spark):
    frame = spark.createDataFrame(corpus(), SCHEMA).repartition(4)
    options = {"chunk_bytes": 3000, "segment_entries": 700, "segment_tokens": 900}
    assert got(M.score_documents(frame, **options)) == got(M.score_documents(frame, broadcast_bytes=0, **options))


def test_segments_hold_the_whole_corpus(spark):
    from siltstone.llm import common as C

    rows = corpus(100)
    store = C.Store(spark, "test-lm")
    source = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", M.held_out(M.F.col("doc_id")))
    chunks = store.put("chunks", source.mapInArrow(M._chunked(2000), M.CHUNK))
    model = M.train(chunks, store, 3, segment_entries=300, segment_tokens=300)
    counts = Counter(g for i, t, *_ in rows if not held(i) for w in [[*WORD.findall((t or "").encode().lower()), b" "]] for n in (1, 2, 3) for g in (tuple(w[k : k + n]) for k in range(len(w) - n + 1)))
    sizes = {r.kind: r for r in model.segments.groupBy("kind").agg(M.F.sum("n").alias("n"), M.F.count(M.F.lit(1)).alias("s"), M.F.max("n").alias("most")).collect()}
    assert sizes[M.WORDS].n == model.train_types == sum(len(g) == 1 for g in counts)
    assert sizes[M.GRAMS].n == sum(len(g) > 1 for g in counts)
    assert sizes[M.GRAMS].s > 5 and sizes[M.GRAMS].most <= 300
    store.close()


def test_filter_has_no_false_misses_and_few_false_hits():
    draw = np.random.default_rng(5)
    keys = np.unique(draw.integers(0, 1 << 32, 40_000, dtype=np.uint32))
    known, other = keys[:20_000], keys[20_000:]
    counts = np.minimum(draw.zipf(1.6, len(known)), 10**9)
    body = M.build_filter(known, counts)
    found, true = M.levels(known, body), np.searchsorted(M.LEVELS, counts, side="right")
    assert (found >= true).all() and (found == true).mean() > 0.99
    assert (M.levels(other, body) > 0).mean() < 0.008
    assert (M.levels(other, None) == 0).all() and len(M.build_filter(known[:0], counts[:0])) == 8
    assert (M.MEANS[1:20] >= M.LEVELS[:19]).all() and M.MEANS[1] == 1.0


def test_packed_keys_come_back():
    draw = np.random.default_rng(7)
    for n in (0, 1, 2, 50, 5000):
        keys = np.unique(draw.integers(0, 1 << 32, n, dtype=np.uint32))
        assert (M.open_keys(M.pack_keys(keys)) == keys).all()
    assert len(M.pack_keys(keys)) == 1 + 3 * len(keys)  # dense keys take three bytes


def test_word_table_tells_words_with_one_common_hash():
    a = np.array([5, 5, 5, 9], np.uint64)
    b = np.array([1, 2, 1, 1], np.uint64)
    x, y, n, where = M.distinct_words(a, b)
    assert (x.tolist(), y.tolist(), n.tolist(), where.tolist()) == ([5, 5, 9], [1, 2, 1], [2, 1, 1], [0, 1, 0, 2])
    body = M.pack_words(x, y, n)
    assert M.counts_of(np.array([5, 5, 9, 9, 7], np.uint64), np.array([2, 1, 1, 4, 1], np.uint64), body).tolist() == [1, 2, 1, 0, 0]


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert M.score_documents(none).count() == 0 and M.score_documents(none, broadcast_bytes=-1).count() == 0
    only = [i for i in range(100) if held(i)][:3]
    frame = spark.createDataFrame([(only[0], "a b", "", 0), (only[1], None, "", 0)], SCHEMA)  # nothing to learn from
    rows = {r.doc_id: r for r in M.score_documents(frame).collect()}
    assert rows[only[0]].train_tokens == 0 and rows[only[0]].n_known == 0 and rows[only[0]].base_score == 0.0 and rows[only[1]].n_tokens == 1


def test_long_texts(spark):
    draw = random.Random(3)
    rows = [(2, "x" * 10_000_000, "", 0), (3, " ".join(draw.choice("abcdefgh") * draw.randint(1, 3) for _ in range(1_000_000)), "", 0)]
    out = {r.doc_id: r for r in M.score_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[2].n_tokens == 2 and out[3].n_tokens == 1_000_001 and out[3].n_known == (0 if held(3) and held(2) else out[3].n_known)
