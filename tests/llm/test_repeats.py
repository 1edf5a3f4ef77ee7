"""Repeated strings against brute force: crowded cells, forced hash collisions, small suffix arrays."""

import hashlib
import random

import numpy as np
import pytest

from siltstone.llm import suffix_dedup as D


def brute(bodies, length):
    seen = {}
    for b in bodies:
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] = seen.get(b[s : s + length], 0) + 1
    out = []
    for i, b in enumerate(bodies):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def texts(seed):
    draw = random.Random(seed)
    some = lambda n: "".join(draw.choice("abcdeé ") for _ in range(n))
    line, passage = some(14), some(45)
    rows = [some(30) + line + some(30) for _ in range(25)]  # a line in many contexts, shorter than a window
    rows += [some(draw.randint(0, 9)) + passage[draw.randint(0, 8) :] + some(9) for _ in range(25)]
    rows += [some(120)] * 4 + ["ab" * 60, "a" * 90, "", None, "short", "x" + "a" * 40]
    near = some(150)
    rows += [near[:70] + draw.choice("xyz") + near[71:] for _ in range(6)]
    return rows


@pytest.mark.parametrize("options", [{}, {"most": 3}, {"most": 2, "array_bytes": 64}, {"most": 5, "hash_bits": 3, "array_bytes": 300}])
def test_against_brute_force(spark, options):
    rows = texts(len(options))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    found = sorted(map(tuple, D.remove_repeats(docs, length=24, width=9, **options).collect()))
    assert found == brute([(t or "").encode() for t in rows], 24)


def test_suffix_ranks():
    draw = np.random.default_rng(6)
    for depth in (3, 8, 9, 16, 24, 40):
        data = draw.integers(97, 99, 400).astype(np.uint8)
        body = data.tobytes()
        at = np.arange(len(data) - depth + 1)
        cuts = [body[i : i + depth] for i in at]
        place = {c: k for k, c in enumerate(sorted(set(cuts)))}
        assert D.suffix_ranks(data, at, depth).tolist() == [place[c] for c in cuts]
