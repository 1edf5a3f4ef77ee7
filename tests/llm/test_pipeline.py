"""The pipeline's stages on a small corpus, each against plain Python on its own input."""

import random
import re
import zlib

import numpy as np

import corpus_pipeline as P
from siltstone.llm import common, labelled, mixing, packing, pii, quality_classifier, text_stats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __score int, n_words string"


def corpus():
    draw = random.Random(3)
    word = lambda: "".join(draw.choice(["an", "er", "lé", "on", "th", "de"]) for _ in range(draw.randint(1, 3)))
    rows = []
    for i in range(160):
        good = i % 4 > 0
        text = " ".join(word() for _ in range(draw.randint(40, 90))) + ". Mail a@b.cd now." if good else " ".join(word() + "###" for _ in range(30))
        rows.append((i, text))
    for i in range(160, 200):  # copies, and copies with a word changed
        text = rows[draw.choice([k for k in range(160) if k % 4])][1]
        rows.append((i, text if i % 2 else text + " extra"))
    rows += [(200, None), (201, ""), (202, " \n"), (None, rows[1][1]), (1, rows[1][1]), (3, "a different text under an id that is taken, with words enough to be judged well by all " * 2)]
    return [(i, t, ("en", "de", None)[n % 3], f"s{n % 5}" if n % 7 else None, None if t is None else len(t), 1, "x") for n, (i, t) in enumerate(rows)]


def same(frame, docs):
    assert frame.columns == docs.columns and frame.schema.simpleString() == docs.schema.simpleString()


def test_stages(spark, tmp_path):
    spark.createDataFrame([(r[0], int(r[0] % 4 > 0)) for r in corpus()[:160]], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = common.table(spark, str(tmp_path), "documents")
    store = common.Store(spark, "test")
    assert [name for name, _ in P.STAGES] == ["quality classifier", "near duplicates", "personal data", "mixing", "packing"]
    key = lambda r: (r.doc_id is None, r.doc_id, r.text or "")

    model = quality_classifier.train(docs, common.table(spark, str(tmp_path), "labels"))
    good = store.put("good", P.quality(spark, docs, str(tmp_path)))
    same(good, docs)
    scored = text_stats.with_stats(text_stats.with_words(docs.select("doc_id", "text"))).collect()
    passed = [r for r in scored if 1 / (1 + np.exp(-model.margin(np.array([[r[s] for s in text_stats.STATS]]))[0])) >= quality_classifier.CUT]
    assert sorted(map(key, good.collect())) == sorted(map(key, passed)) and 0 < len(passed) < len(scored)
    assert all(not (r.text or "").count("###") for r in good.collect())
    assert labelled.MAX_ROWS >= 1000

    rows = good.collect()
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(fold))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    part = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                old, new = part[a], part[b]
                part = [new if p == old else p for p in part]
    first = {}
    for n, r in enumerate(rows):
        order = (r.doc_id is None, r.doc_id if r.doc_id is not None else 0)
        first[part[n]] = min(first.get(part[n], order), order)
    unique = store.put("unique", P.dedup(spark, good, str(tmp_path)))
    same(unique, docs)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in unique.collect()) == sorted(first.values())

    private = store.put("private", P.private(spark, unique, str(tmp_path)))
    same(private, docs)
    before = {(r.doc_id, r.lang, r.source): r.text for r in unique.collect()}
    for r in private.collect():
        text = before[r.doc_id, r.lang, r.source]
        assert r.text == (None if text is None else re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "<EMAIL>", text)) or "<NAME>" in r.text or "<SECRET>" in r.text
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert not any(any(pii.base_spans(r.text or "")) for r in private.collect())

    mixed = store.put("mixed", P.mixture(spark, private, str(tmp_path)))
    same(mixed, docs)
    chosen = {r.doc_id for r in mixing.mix(private).where("selected").collect()}
    assert sorted(map(key, mixed.collect())) == sorted(map(key, (r for r in private.collect() if r.doc_id in chosen)))

    encode = packing.encoder(packing.tokenizer_path())
    tokens = {}
    for r in mixed.collect():
        tokens.setdefault(r.doc_id, []).append(np.append(np.frombuffer(encode(r.text or ""), "<u4"), packing.END_ID).astype("<u4"))
    pieces = P.packed(spark, mixed, str(tmp_path)).collect()
    for doc, own in tokens.items():
        mine = [p for p in pieces if p.doc_id == doc]
        assert sum(p.length for p in mine) == sum(map(len, own))
        assert all(any(p.doc_tokens == len(t) and zlib.crc32(t[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for t in own) for p in mine)

    whole = P.run(spark, str(tmp_path)).collect()
    assert sorted((p.doc_id, p.start, p.length, p.ids_crc32) for p in whole if p.doc_id is not None) == sorted((p.doc_id, p.start, p.length, p.ids_crc32) for p in pieces if p.doc_id is not None)


def test_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
