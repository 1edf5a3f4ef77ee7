"""Corpus operators against plain Python: placement, patterns at random, statistics, mixing with its margins, recall of near duplicates, and the pipeline's stages."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from siltstone.llm import labelled, mixing, near_dedup, packing, pii, quality_classifier, sharding, text_stats, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def unit(text):
    return (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)


def descend(key, node):
    """The shard that a key's draws lead to."""
    while node.shard is None:
        best = max((math.log(unit(f"{key}/{c.name}")) / c.total, -i, c) for i, c in enumerate(node.children) if c.total > 0)
        node = best[2]
    return node.shard


def test_placement(spark):
    rows = [(i, f"t{i}") for i in range(300)] + [(None, None)]
    found = {r.doc_id: r for r in sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    root = sharding.topology(40)
    grown = sharding.grow(root, 40)
    for i, _ in rows:
        key = "null" if i is None else str(i)
        assert (found[i].shard, found[i].grown_shard) == (descend(key, root), descend(key, grown))


def test_grown_names_and_weights(spark):
    from pyspark.sql import functions as F

    small = sharding.topology(2)
    twice = sharding.grow(sharding.grow(small, 2), 3)
    assert len({top.name for top in twice.children}) == 4
    keys = spark.range(2000).select(sharding.key_of(F.col("id")).alias("k"))
    used = {r.s for r in keys.select(sharding.place(F.col("k"), twice).alias("s")).distinct().collect()}
    assert used == {0, 1, 2, 3}
    empty = sharding.Node("root", children=(sharding.Node("r0", children=(sharding.rack("k", [(0, 0.0)]),)), sharding.Node("r1", children=(sharding.rack("k", [(1, 1.0), (2, 0.0)]),))))
    assert {r.s for r in keys.select(sharding.place(F.col("k"), empty).alias("s")).distinct().collect()} == {1}
    for weights in ([(0, 0.0)], [(0, -1.0), (1, 2.0)]):
        with pytest.raises(ValueError):
            sharding.place(F.col("k"), sharding.Node("root", children=(sharding.Node("r0", children=(sharding.rack("k", weights),)),)))


def luhn(digits):
    total = 0
    for n, d in enumerate(reversed(digits)):
        v = int(d) * (2 if n % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ]
    return [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text) if ok(m.group())] for k, p, ok in kinds]


def test_base_spans_at_random(spark):
    draw = random.Random(9)
    pieces = ["a.b@c.de", "x@y", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+123", "10.0.0.1", "1.2.3.4.5.6.7.8", "999.1.1.1", "é", "#", "..", "@", "+", "-", " ", "5500000000000004", "0", "12", "\n"]
    rows = [(i, "".join(draw.choice(pieces) + draw.choice(["", " ", ""]) for _ in range(draw.randint(0, 14)))) for i in range(600)]
    for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        wanted = base(rows[r.doc_id][1])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == list(map(len, wanted)), rows[r.doc_id]
        joined = ",".join(s for own in wanted for s in own)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and (r.spans or "").startswith(joined)


def test_secrets_with_signs_around_them():
    code = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    data = np.frombuffer(f'x\nword### token = "{code}"### 12 $$$ de'.encode(), np.uint8)
    found = pii.found_spans(pii.train(), data, np.array([0, len(data)]))
    text = data.tobytes().decode()
    assert [text[a:b] for a, b in found[0][1]] == [code]


def stats(text):
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    chars = sum(map(len, words))
    share = lambda a, b: a / b if b else 0.0
    count = lambda signs: sum(text.count(s) for s in signs)
    return (
        float(len(words)), share(chars, len(words)), share(count("#*$%&|<>"), chars), share(count("!?"), chars), share(sum("A" <= c <= "Z" for c in text), chars), share(sum("0" <= c <= "9" for c in text), chars),
        share(count(".,"), len(words)), share(len(set(words)), len(words)), share(len(lines) - len(set(lines)), len(lines)), share(len(words), len(lines)), float(len((lines or [""])[0].encode())),
    )


TEXTS = ["", None, "One two, two. THREE 4!", "a\na\n\n b | c\n", "é ñ #### $$ <x>", "word " * 500, "x y z\x0bw"]


def test_statistics(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i long, text string")
    for r in text_stats.with_stats(text_stats.with_words(rows)).collect():
        assert np.allclose([r[s] for s in text_stats.STATS], stats(TEXTS[r.i] or "")), TEXTS[r.i]


def test_labels_that_contradict_each_other(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(0, 1), (1, 1)], "doc_id long, quality int")
    x, y = labelled.sample(docs, labels, "quality")
    usable = [i for i in range(1, 12) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(x) == len(usable) and y.sum() == sum(i % 2 for i in usable)


def sources(n=300):
    draw = random.Random(2)
    rows = []
    for i in range(3000):
        text = " ".join("w" * draw.randint(1, 6) for _ in range(draw.randint(5, 40)))
        rows.append((i, text + (" | | | | | | | | |" if i % 9 == 0 else ""), ("en", "de", None)[i % 3], f"s{draw.randint(0, n - 1) if i % 4 else 0}", i))
    return rows


def test_mixing_reaches_its_margins(spark):
    """Without a trim, the expected tokens of every source, language and topic have exactly their target shares; rare sources share OTHER."""
    docs = spark.createDataFrame(sources(), "doc_id long, text string, lang string, source string, n_words long").repartition(4)
    ready = mixing.with_margins(docs)
    cells, targets = mixing.plan(ready, trim=0.0)
    rows = mixing.with_probability(ready, cells, targets).collect()
    total = sum(r["__tokens"] * r["__p"] for r in rows)
    for margin in mixing.MARGINS:
        got = {}
        for r in rows:
            got[r[f"__{margin}"]] = got.get(r[f"__{margin}"], 0.0) + r["__tokens"] * r["__p"]
        assert {k: v for k, v in got.items()} == pytest.approx({k: v * total for k, v in targets[margin].items()}, rel=1e-6)
    assert len(targets["source"]) == mixing.MAX_VALUES + 1
    other = [r for r in rows if r["__source"] == mixing.OTHER]
    assert len({r.source for r in other}) > 50 and all(r["__p"] > 0 for r in other) and any(r["__selected"] for r in other)


def test_selection_is_the_stated_draw(spark):
    docs = spark.createDataFrame(sources(30), "doc_id long, text string, lang string, source string, n_words long")
    rows = mixing.mix(docs).collect()
    for r in rows:
        assert r.selected == (unit(f"mix/0/{r.doc_id}") < r.probability)
        assert r.n_tokens == len(WORD.findall(dict((i, t) for i, t, *_ in sources(30))[r.doc_id])) + 1 if r.doc_id < 20 else True
    kept = mixing.sample(docs.withColumnRenamed("n_words", "__tokens"))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.selected} and "__tokens" in kept.columns


def test_recall_just_above_the_threshold(spark):
    """Of 400 pairs with similarities from 0.80 to 0.85, every one is linked; none of the pairs just below is."""
    draw, rows, wanted = random.Random(12), [], {}
    for k in range(400):
        n = draw.choice([30, 120, 400])
        words = [f"{k}w{j}" for j in range(n)]
        other = list(words)
        for at in range(0, n):
            trial = [*other[:at], f"{k}x{at}", *other[at + 1 :]] if draw.random() < 0.07 else other
            a, b = set(zip(words, words[1:])), set(zip(trial, trial[1:]))  # noqa: B905
            if 100 * len(a & b) < 78 * len(a | b):
                break
            other = trial
        a, b = set(zip(words, words[1:])), set(zip(other, other[1:]))  # noqa: B905
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        wanted[k] = 100 * len(a & b) >= 80 * len(a | b)
    found = {r.doc_id: r.component_id for r in near_dedup.link_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width=2).collect()}
    assert {k: found[2 * k + 1] == 2 * k for k in wanted} == wanted and 0 < sum(wanted.values())


def test_rows_are_kept_by_what_they_say(spark):
    """Different texts under one id, and without ids, are documents of their own."""
    long_ = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long_, 0), (1, "another text of more than five words", 1), (None, long_ + " x", 2), (None, "no copy of this one anywhere here", 3), (5, long_, 4), (6, "", 5), (7, None, 6), (None, None, 7), (6, "", 8)]
    kept = near_dedup.keep_first(spark.createDataFrame(rows, "doc_id long, text string, key int")).collect()
    assert sorted(r.key for r in kept) == [0, 1, 3, 5, 6, 7, 8]
    assert near_dedup.keep_first(spark.createDataFrame([], "doc_id long, text string, row string")).columns == ["doc_id", "text", "row"]


def test_statistics_do_not_touch_the_callers_columns(spark, tmp_path):
    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(i, "good words and more of them " * 5 if i % 2 else "## ##", -99, "u") for i in range(40)] + [(None, None, -99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, `upper.share` string")
    kept = quality_classifier.keep_good(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r.n_words for r in kept.collect()} == {-99}
    assert quality_classifier.keep_good(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_large_components(spark):
    from pyspark.sql import functions as F

    rows = [(i, [float(v) for v in x]) for i, x in enumerate([(3e6, 1.0), (2e6, 2e6), (1.5, 2.5), (-1e30, 5.0), (1e30, 1e30), (2e9, 3e9), (2e9, 3e9 + 1)])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(frame, F.col("vec_id") >= 0, k=4).collect()
    whole = [[math.floor(64 * v) for v in x] for _, x in rows]
    clamp = lambda v: max(-(2**63), min(2**63 - 1, v))
    expected = []
    for i, q in enumerate(whole):
        order = sorted((-clamp(sum(a * b for a, b in zip(q, v, strict=True))), j) for j, v in enumerate(whole) if j != i)[:4]
        expected += [(i, n + 1, j, -s) for n, (s, j) in enumerate(order)]
    assert sorted(map(tuple, found)) == expected


def test_plan_is_linear():
    import time

    began = time.process_time()
    windows = packing.plan([1 + i % 3 for i in range(400_000)])
    assert time.process_time() - began < 10 and sum(s for s, _ in windows) == sum(1 + i % 3 for i in range(400_000))
    assert all(s == packing.WINDOW or s & (s - 1) == 0 for s, _ in windows[:-1])
