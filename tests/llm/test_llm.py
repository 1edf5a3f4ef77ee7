"""The corpus operators against brute force, on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from siltstone.llm import html_text, mixing, near_dedup, packing, pii, quality_classifier, quality_rules, sharding, suffix_dedup, topk
from siltstone.llm import labelled as L
from siltstone.llm import text_stats as S

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, score string, slot int"


def corpus():
    draw = random.Random(5)
    word = lambda: "".join(draw.choice(["an", "er", "lé", "on", "th"]) for _ in range(draw.randint(1, 4)))
    base = [word() for _ in range(300)]
    texts = [None, "", " \n\t ", "One", "one", "two words", " ".join(base), " ".join(base), " ".join([*base[:150], "x", *base[150:]]), " ".join(word() for _ in range(3000)), "a" * 3000, "ab " * 900]
    texts += [" ".join(base[i:]) for i in (5, 30, 80)] + [" ".join(word() for _ in range(60)) + " " + " ".join(base[:60]) for _ in range(4)]
    texts += ["Mail a.b@c.example.org or +1 (555) 010-9999, 4111 1111 1111 1111 é 10.0.0.255 300.1.1.1", "Line one\nLine one\n" * 8, 'token = "' + "0a1b2c3d4e" * 4 + '"']
    rows = [(i, t, None if i % 5 == 0 else "en", "hot" if i % 3 else None, len(t or ""), 1, "x", 2) for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[6], (None, "no id here at all", "en", "hot", 3, 1, "x", 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(spark, docs, none):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == docs.count() and sharding.shard_documents(none).count() == 0
    by = {}
    texts = {r[0]: r[1] or "" for r in corpus()}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_tree_moves_only_where_weights_change(spark):
    from pyspark.sql import functions as F

    keys = spark.range(4000).select(sharding.key_of(F.col("id")).alias("k"))
    root = sharding.topology(40)
    heavy = sharding.Node("root", children=(sharding.Node("r0", children=(sharding.rack("r0k0", [(i, 2.0) for i in range(5)]), *root.children[0].children[1:])), *root.children[1:]))
    moved = keys.select(sharding.place(F.col("k"), root).alias("a"), sharding.place(F.col("k"), heavy).alias("b")).where("a <> b").collect()
    assert moved and all(r.b < 10 for r in moved)  # into the heavier region only
    shares = [r["count"] for r in keys.select(sharding.place(F.col("k"), root).alias("a")).groupBy("a").count().collect()]
    assert len(shares) == 40 and min(shares) > 50


def test_near_dedup(docs, none):
    rows = near_dedup.link_documents(docs, width=2).collect()
    assert len(rows) == docs.count() and near_dedup.link_documents(none, width=2).count() == 0
    fold = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = {}
    for r in corpus():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(fold))
        sets[r[0]] = set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()  # noqa: B905
    ids = [i for i in sets if i is not None]
    part = {i: i for i in ids}
    for a in ids:
        for b in ids:
            k = len(sets[a] & sets[b])
            if a < b and k and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                old, new = max(part[a], part[b]), min(part[a], part[b])
                part = {i: new if p == old else p for i, p in part.items()}
    for r in rows:
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.component_id == (part[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    kept = near_dedup.keep_first(docs, width=2)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(i for i in ids if part[i] == i)


def test_suffix_dedup(docs, none):
    rows = suffix_dedup.remove_repeats(docs).collect()
    assert len(rows) == docs.count() and suffix_dedup.remove_repeats(none).count() == 0
    seen = {}
    bodies = [(r[0], (r[1] or "").encode()) for r in corpus()]
    for _, b in bodies:
        for s in range(len(b) - 199):
            seen[b[s : s + 200]] = seen.get(b[s : s + 200], 0) + 1
    expected = []
    for i, b in bodies:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 199):
            if seen[b[s : s + 200]] > 1:
                gone[s : s + 200] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        expected.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, expected))


def test_pii(docs, none):
    rows = {r.doc_id: r for r in pii.find(docs).collect()}
    assert pii.find(none).count() == 0
    mail = next(r for r in corpus() if r[1] and r[1].startswith("Mail"))
    got = rows[mail[0]]
    assert (got.n_email, got.n_ip, got.n_card, got.n_phone) == (1, 1, 1, 1)
    assert [mail[1][int(a) : int(b)] for _, a, b in (s.split(":") for s in got.spans.split(","))] == ["a.b@c.example.org", "10.0.0.255", "4111 1111 1111 1111", "+1 (555) 010-9999"]
    masked = {r.doc_id: r for r in pii.mask(docs).collect()}
    assert masked[mail[0]].text == "Mail <EMAIL> or <PHONE>, <CARD> é <IP> 300.1.1.1" and masked[mail[0]].n_chars == len(masked[mail[0]].text)
    assert masked[0].text is None and pii.mask(docs).columns == docs.columns


def test_crf_decodes_what_enumeration_finds():
    draw = np.random.default_rng(1)
    trans = pii._transitions(draw.normal(size=(4, 4)))
    emit = draw.normal(size=(5, 4, 4))
    import itertools

    for e, got in zip(emit, pii.viterbi(emit, trans), strict=True):
        value = lambda p: sum(e[t, k] for t, k in enumerate(p)) + trans[0, p[0]] + trans[p[-1], 0] + sum(trans[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, B905, E731
        assert tuple(got) == max(itertools.product(range(4), repeat=4), key=value)
    fresh = pii.labelled_table(2, 77)
    right = 0
    for text, labels in fresh:
        data = np.frombuffer(text.encode(), np.uint8)
        right += tuple(pii.decode(pii.train(), pii.Tokens(data, np.array([0, len(data)])))) == labels
    assert right >= 0.95 * len(fresh)


def test_email_and_ip_scanners_match_the_patterns():
    draw = random.Random(2)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(3000):
        text = "".join(draw.choice("a1@.-@ .9") for _ in range(draw.randint(0, 30)))
        assert pii.emails(text) == [m.span() for m in email.finditer(text)]
        assert pii.ips(text) == [m.span() for m in ip.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]


def test_packing(docs, none):
    rows = packing.pack(docs, block_tokens=3000).collect()
    assert packing.pack(none).count() == 0
    encode = packing.encoder(packing.tokenizer_path())
    seqs = {}
    pieces = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for cells in seqs.values():
        at = 0
        for offset, n in sorted(cells):
            assert offset == at and n > 0
            at += n
        assert at <= packing.WINDOW
    for doc, text in {r[0]: r[1] for r in corpus()}.items():
        ids = np.append(np.frombuffer(encode(text or ""), "<u4"), 1).astype("<u4")
        own = sorted(pieces[doc])
        copies = sum(n for _, n, _, _ in own) // len(ids)
        assert copies == sum(r[0] == doc for r in corpus()) and all(p[3] == len(ids) for p in own)
        assert all(c == zlib.crc32(ids[s : s + n].tobytes()) for s, n, c, _ in own)
        assert encode(text or "") == np.asarray(encode.slow.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_plan_is_whole():
    draw = random.Random(4)
    for _ in range(200):
        lengths = [draw.choice([1, 2, 40, 300, 900, 1500, 2048, 5000]) for _ in range(draw.randint(0, 30))]
        cover = [[] for _ in lengths]
        for size, parts in packing.plan(lengths):
            assert sum(n for _, _, n in parts) == size <= packing.WINDOW
            for item, start, n in parts:
                cover[item].append((start, n))
        for n, own in zip(lengths, cover, strict=True):
            at = 0
            for start, size in sorted(own):
                assert start == at
                at += size
            assert at == n


def test_quality_rules(docs, none):
    stats = lambda d: {r.doc_id: r for r in d.collect()}
    rows = stats(quality_rules.apply_rules(docs, []))
    assert quality_rules.apply_rules(none, []).count() == 0
    for i, text in {r[0]: r[1] or "" for r in corpus()}.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        at = {}
        for k in range(len(w) - 7):
            at.setdefault(tuple(w[k : k + 8]), []).append(k)
        covered = {j for ks in at.values() if len(ks) > 1 for k in ks for j in range(k, k + 8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and r.kept == (not r.base_failed)


def test_models_learn_a_planted_rule(spark):
    draw = np.random.default_rng(3)
    x = draw.random((1500, len(S.STATS)))
    y = (~((x[:, 2] > 0.7) & (x[:, 7] > 0.3))).astype(float)
    model = quality_classifier.fit(x[:1000], y[:1000])
    score = 1 / (1 + np.exp(-model.margin(x[1000:])))
    assert ((score >= quality_classifier.CUT) == y[1000:]).mean() > 0.95
    rules = quality_rules.learn(x[:1000], y[:1000])
    dropped = np.any([r.holds(x[1000:]) for r in rules], axis=0)
    assert (dropped == (y[1000:] == 0)).mean() > 0.95
    assert quality_classifier.fit(x[:0], y[:0]).rules == () and quality_rules.learn(x[:0], y[:0]) == []
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], list(S.STATS)).select(model.score().alias("s")).collect()
    assert np.allclose([r.s for r in rows], 1 / (1 + np.exp(-model.margin(x[:50]))))


def test_classifier_edges(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1), (3, None)], "doc_id long, quality int")
    rows = quality_classifier.score_documents(docs, quality_classifier.train(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert quality_classifier.score_documents(none, quality_classifier.train(none, labels.limit(0))).count() == 0
    x, _ = L.sample(docs, labels, "quality")
    assert len(x)


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and mixing.mix(none).count() == 0
    assert all(0 <= r.probability <= 1 for r in rows) and max(r.probability for r in rows) == 1.0
    assert mixing.sample(docs).columns == docs.columns
    cells = {("a", "x", "t"): 10.0, ("a", "y", "t"): 30.0, ("b", "x", "t"): 50.0, ("b", "y", "t"): 10.0}
    fitted = mixing.rake(cells, {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.2, "y": 0.8}, "topic": {"t": 1.0}})
    assert abs(sum(v for k, v in fitted.items() if k[0] == "a") - 0.5) < 1e-6 and abs(sum(v for k, v in fitted.items() if k[1] == "x") - 0.2) < 1e-6
    odds = lambda c: c[("a", "x", "t")] * c[("b", "y", "t")] / c[("a", "y", "t")] / c[("b", "x", "t")]
    assert abs(odds(fitted) - odds(cells)) < 1e-6  # raking keeps the table's interactions
    assert mixing.scale({1: 0.01, 2: 0.39, 3: 0.6}, {1: 50.0, 2: 1.3, 3: 0.8}) == 1.3  # a rare cell does not set the scale
    assert mixing.scale({1: 0.5, 2: 0.5}, {1: 50.0, 2: 0.5}) == 50.0 and mixing.scale({}, {}) == 1.0


def test_top_k(spark):
    from pyspark.sql import functions as F

    draw = np.random.default_rng(8)
    vectors = draw.normal(size=(600, 6)).round(1)
    vectors[100:300] = vectors[100]
    data = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000, None), (1020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1040, [float("nan")] * 6), (None, [1.0] * 6)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    rows = topk.top_k(frame, F.col("vec_id") % 20 == 0, k=7, shard_rows=90, block_queries=11).collect()
    q = np.floor(64 * vectors.astype(np.float32).astype(np.float64))
    expected = []
    for i in range(0, 600, 20):
        order = sorted((j for j in range(600) if j != i), key=lambda j: (-(q[i] @ q[j]), j))[:7]
        expected += [(i, k + 1, j, int(q[i] @ q[j])) for k, j in enumerate(order)]
    assert sorted(map(tuple, rows)) == expected
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(frame.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2  # fewer than k


def test_html(spark):
    page = "<title>T</title><p>a<p>b &amp; <b>c</b><ul><li>x<li>y<ol><li>z</ol></ul><table><tr><th>aa<th>b<tr><td>c<td>dddd</table>end<script>no()</script><i hidden>no</i><pre>k\n  l</pre>"
    assert html_text.extract(page) == "a\n\nb & c\n\n- x\n- y\n    1. z\n\naa | b\nc  | dddd\n\nend\n\nk\n  l"
    frame = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (3, "u", "<div>" * 5000 + "deep", "x"), (4, "u", "<p title='a>b'>q</p", "x")], "page_id long, url string, html string, text string")
    assert {r.page_id: r.text for r in html_text.extract_pages(frame).collect()} == {1: "", 2: "", 3: "deep", 4: "q"}
