"""Operators against plain Python on small fixtures: routes, duplicates, the cascade, trees, graphs, notes, layouts, streams."""

import datetime
import math
import os
import random
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.functions import intent
from siltstone.functions import text as T
from siltstone.operators import bridges, chunking, extraction, graphstore, layout, lifecycle, lookup, minhash, notes, search, tree
from siltstone.operators import retrieval as R
from siltstone.streaming import watch


def classified(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, q string").select("i", intent.classify(F.col("q")).alias("c")).collect()
    return [r.c for r in sorted(rows)]


def test_questions(spark):
    cases = [
        ("", "hybrid_needle", None), (None, "hybrid_needle", None), ("TAX", "hybrid_needle", None), ("architecture", "hybrid_needle", None),
        ("por que ALM-26235 acontece?", "compound_fused", "telecom_alarm"), ("Explique ADR-7", "compound_fused", "wiki_adr"), ("hierarquia de TCK-1092", "compound_fused", "ticket"),
        ("relações entre A e B", "relational_graph", None), ("visão geral da obra", "macro_synthesis", None), ("o que é isto", "hybrid_needle", None), ("Lista B1?", "compound_fused", "portaria_344_lista"), ("lista b1", "deterministic_direct", "portaria_344_lista"),
        ("SEC-9901", "deterministic_direct", "ticket"), ("aaaa1111", "hybrid_needle", None), ("k9x2m7q4", "deterministic_direct", "high_entropy_code"), ("ADR-3.1.2 F41.1.2", "deterministic_direct", "wiki_adr"),
        ("3550 1234 5678 9012 3456 7890 1234 5678 9012 3456 7890", "deterministic_direct", "nfe_chave"), ("ISBN 978-0-306-40615-7", "deterministic_direct", "isbn"),
    ]
    for (text, route, kind), got in zip(cases, classified(spark, [c[0] for c in cases]), strict=True):
        assert (got.route_type, got.extracted_identifier.id_type if got.extracted_identifier else None) == (route, kind), text
    one = classified(spark, ["hierarquia de TCK-1092"])[0]
    assert (one.retrieval_mode, one.analytical_depth, one.graph_hops, one.needs_synthesis, one.bypass_vector_search) == ("exact_entity", "relational_audit", 2, True, False)
    assert classified(spark, ["Orbit ADR 5"])[0].extracted_identifier is None
    named = spark.range(1).select(intent.identifier(F.lit("Orbit ADR-5"), "Orbit").alias("x")).first().x
    assert named.normalized_value == "Orbit ADR-05" and named.id_type == "wiki_adr"


def test_signatures_and_first_kept(spark):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = [None, "", "one", "Subject: RE: a b c", "subject:  a b c"] + [" ".join(draw.choice(words) for _ in range(60)) for _ in range(12)]
    for _ in range(25):
        own = draw.choice(texts[5:]).split()
        own[draw.randrange(len(own))] = draw.choice(words)
        texts.append(" ".join(own))
    texts += texts[5:9]

    def signature(text):
        body = re.sub(r"(?im)^(subject:\s*)(?:re|fwd|fw|enc):\s*", r"\1", (text or "").strip()).lower().split()
        shingles = {" ".join(body[i : i + 2]) for i in range(len(body) - 1)} if len(body) > 1 else {" ".join(body)}
        return [min((((i * 2654435761 + 1013904223) & 0xFFFFFFFF | 1) * zlib.crc32(s.encode()) + ((i * 1664525 + 374761393) & 0xFFFFFFFF)) & 0xFFFFFFFF for s in shingles) for i in range(1, 65)]

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    signed = {r.doc_id: r.s for r in docs.select("doc_id", minhash.signature(F.col("text")).alias("s")).collect()}
    assert all(signed[i] == signature(t) for i, t in enumerate(texts))
    share = lambda a, b: sum(x == y for x, y in zip(signed[a], signed[b], strict=True)) / 64
    kept = []
    for i in range(len(texts)):
        if not any(share(i, k) >= 0.85 for k in kept):
            kept.append(i)
    assert sorted(r.doc_id for r in minhash.first_kept(docs).where("kept").collect()) == kept
    classes, pairs = minhash.near_pairs(docs, 0.5)
    heads = {r.doc_id: r["head"] for r in classes.collect()}
    distinct = sorted(set(heads.values()))
    assert {(r.a, r.b) for r in pairs.collect()} == {(a, b) for a in distinct for b in distinct if a < b and share(a, b) >= 0.5}
    fresh = spark.createDataFrame([(900, texts[6]), (901, "nothing like it")], "doc_id long, text string")
    found = minhash.duplicate_of(classes.select("doc_id", "signature"), fresh)
    assert [(r.doc_id, r.match) for r in found.collect()] == [(900, min(i for i in range(len(texts)) if share(i, 6) >= 0.85))]
    assert minhash.first_kept(docs.limit(0)).count() == 0


def fold(text):
    return "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not unicodedata.combining(c))


def test_cascade_against_python(spark):
    draw = random.Random(5)
    words = "alpha beta gamma delta epsilon zeta éta theta iota kappa lambda mu nu xi".split()
    records = [(i, f"D-{i}", " ".join(draw.sample(words, 2)), " ".join(draw.choice(words) for _ in range(draw.randint(3, 30))) + (" long" * 400 if i % 9 == 0 else ""), i % 4) for i in range(120)]
    questions = [(0, "the alpha beta of gamma and delta epsilon"), (1, "ETA theta"), (2, "nu"), (3, "unheard of words"), (4, "the and"), (5, None), (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda")]
    frame = spark.createDataFrame(records, "id long, doc_identifier string, title string, content string, clearance int")
    got = {}
    for r in lookup.cascade(frame, spark.createDataFrame(questions, "question long, text string"), 2, 5).collect():
        got.setdefault(r.question, []).append((r["rank"], r.id, round(r.overlap, 4), r.stage))
    seen = [r for r in records if r[4] <= 2]
    tokens = {r[0]: [re.findall(r"[^\W_]+", fold(r[k])) for k in (2, 3)] for r in seen}
    mean = np.mean([len(t[1]) for t in tokens.values()])
    for q, text in questions:
        every = list(dict.fromkeys(re.findall(r"[^\W_]+", fold(text))))
        asked = [w for w in every if w not in lookup.STOP_WORDS and len(w) > 1 and not re.fullmatch(r"\d{1,2}", w)] or every[:8]
        df = {w: sum(w in a or w in b for a, b in tokens.values()) for w in asked}
        score = lambda i, of=asked: sum(math.log(1 + (len(seen) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tokens[i][1]) / mean)) for w in of if (tf := 10 * tokens[i][0].count(w) + tokens[i][1].count(w)))  # noqa: B023, E731
        has = lambda i, w: w in tokens[i][0] or w in tokens[i][1]
        stages = [asked[:7] if len(asked) > 1 else None, sorted(asked[:8], key=lambda w: -len(w))[:4] if len(asked) > 3 else None]
        stages.append(None)
        stage = {}
        for n, need in enumerate(stages):
            if len(stage) < 25:
                hits = [i for i in tokens if (need and all(has(i, w) for w in need)) or (n == 2 and any(has(i, w) for w in asked[:10]))]
                of = asked[:10] if n == 2 else asked
                for i in sorted(hits, key=lambda i: (-round(score(i, of), 6), i))[:25]:
                    stage.setdefault(i, n)
        chosen = list(stage)
        body = {r[0]: (fold(r[2]), fold(r[3][:8000]), len(r[3])) for r in seen}
        overlap = lambda i: 3.5 * sum(w in body[i][0] for w in asked) + 1.5 * sum(w in body[i][1] for w in asked) + (body[i][2] > 1500)  # noqa: B023, E731
        best = sorted(chosen, key=lambda i: (-overlap(i), -round(score(i), 6), i))[:5]
        assert [(n, i, o, s) for n, i, o, s in sorted(got.get(q, []))] == [(n, i, overlap(i), stage[i]) for n, i in enumerate(best, 1)], text
    direct = lookup.exact_lookup(frame, spark.createDataFrame([(0, "D-3", "D-3", "x"), (1, "d-4", "D-4", ""), (2, "alpha beta", "alpha beta", "with gamma")], "question long, raw string, norm string, text string"), 2, 3).collect()
    assert [(r.question, r.source) for r in sorted(direct) if r.question == 1] == [(1, "identifier")] and not any(r.question == 0 for r in direct)
    phrase = [r.id for r in sorted(direct, key=lambda r: r["rank"]) if r.question == 2]
    assert phrase and all(any("alpha beta" in " ".join(t) for t in tokens[i]) for i in phrase)


def test_deep_tree(spark):
    """The fixture's rules: records decide, then primary children, then the nearest ancestor, then the highest level; a hidden topic hides what is below."""
    edges = [("a", None, 1), ("b", "a", 1), ("c", "b", 1), ("d", "c", 1), ("e", "a", 1), ("f", "e", 1), ("g", "e", 1), ("h", None, 1), ("i", "h", 1), ("j", "f", 1), ("c", "e", 0)]
    records = [("b", 3, "x"), ("d", 0, "y"), ("f", 2, "z"), ("f", 1, "z"), ("j", 0, None)]
    nodes = spark.createDataFrame([(t, "P", t.upper(), 0) for t in "abcdefghij"], "topic_id string, package string, name string, depth int")
    links = spark.createDataFrame(edges, "child string, parent string, is_primary int")
    held = spark.createDataFrame([(n, *r) for n, r in enumerate(records)], "id long, topic_id string, clearance int, console string")
    levels = {r.topic_id: r.clearance for r in tree.clearances(nodes, links, held).collect()}
    assert levels == {"b": 3, "d": 0, "f": 1, "j": 0, "c": 0, "e": 1, "a": 1, "g": 1, "h": 3, "i": 3}
    assert {r.topic_id for r in tree.visible(links, tree.clearances(nodes, links, held), 2).collect()} == {"a", "e", "f", "g", "j"}
    assert {r.topic_id: r.theme for r in tree.themes(nodes, links, held).collect()} == {"a": "", "b": "x", "c": "x", "d": "y", "e": "", "f": "z", "g": "", "h": "", "i": "", "j": "z"}
    assert {r.topic_id: r.n_desc for r in tree.descendants(links).collect()} == {"a": 7, "b": 2, "c": 1, "e": 3, "f": 1, "h": 1}
    assert {r.path for r in tree.paths(nodes, links).where("level = 3").collect()} == {"A > B > C > D", "A > E > F > J"}
    shown, found = tree.layer(nodes, links, held, 1, companions=spark.createDataFrame([("P", "Q", "PEER")], "source string, target string, kind string"))
    assert {(r.source, r.target, r.kind) for r in found.collect()} == {("t:a", "p:P", "CHILD_OF"), ("t:e", "t:a", "CHILD_OF"), ("t:f", "t:e", "CHILD_OF"), ("t:g", "t:e", "CHILD_OF"), ("t:j", "t:f", "CHILD_OF"), ("t:f", "t:g", "NEXT_TOPIC")}
    with pytest.raises(RuntimeError):
        tree.closure(spark.createDataFrame([("x", "y", 1), ("y", "x", 1)], "child string, parent string, is_primary int"), most=5)


def test_graph_store(spark):
    empty = graphstore.Graph(*(spark.createDataFrame([], s) for s in ("doc_id long, identifier string, title string, created string, clearance int", "norm string, name string, kind string, clearance int", "doc_id long, norm string, n long, context string", "source string, target string, relation string, doc_id long, clearance int")))
    docs = spark.createDataFrame([(1, "A-1", "one", "2024", 0), (2, "A-2", "two", None, 3)], empty.documents.schema)
    found = spark.createDataFrame([(1, "x", "tag", "X", 2, "first", 1, 5), (1, "x", "person", "Xx", 1, "later", 3, 9), (2, "y", "tag", "Y", 1, "c", 0, 6)], "doc_id long, norm string, kind string, name string, n long, context string, clearance int, seq long")
    edges = spark.createDataFrame([("x", "y", "R", None, 3, 1), ("x", "y", "R", None, 1, 2), ("y", "x", "R", 2, 0, 3)], "source string, target string, relation string, doc_id long, clearance int, seq long")
    g = graphstore.index(empty, docs, found, edges)
    assert {tuple(r) for r in g.entities.collect()} == {("x", "X", "tag", 3), ("y", "Y", "tag", 0)} and {tuple(r) for r in g.postings.collect()} == {(1, "x", 3, "first"), (2, "y", 1, "c")}
    assert {tuple(r) for r in g.relations.collect()} == {("x", "y", "R", None, 1), ("y", "x", "R", 2, 0)}
    again = graphstore.index(g, docs.where("doc_id = 2"), found.limit(0), edges.where("doc_id is null"))
    assert {tuple(r) for r in again.relations.collect()} == {("x", "y", "R", None, 1)} and again.postings.count() == 1 and again.documents.count() == 2
    gone = graphstore.purge_prefix(g, "a-2")
    assert [r.identifier for r in gone.documents.collect()] == ["A-1"] and {r.norm for r in gone.entities.collect()} == {"x", "y"}
    assert graphstore.query_relations(g, source="X", target="Y", clearance=3).count() == 1 and graphstore.query_relations(g, clearance=2).count() == 0
    names = spark.createDataFrame([(0, "x"), (1, "  "), (2, None), (3, "zz x y zz")], "question long, name string")
    assert {(r.question, r.norm) for r in graphstore.find_entities(g, names).collect()} == {(0, "x")}


def test_note_paths(spark):
    cases = {("a/b.md", "../c.md#x"): "c.md", ("b.md", "./d%20e.md?q"): "d e.md", ("a/b.md", "x/../../y.md"): "y.md", ("a.md", "http://h/x.md"): None, ("a.md", "#top"): None, ("a.md", "file:///h/docs/wiki/k/l.md"): "k/l.md", ("a.md", "file:///h/x.md"): None, ("a.md", "b.csv"): None, ("a.md", "../up.md"): "../up.md"}
    rows = spark.createDataFrame(list(cases), "s string, h string").select("s", "h", notes.resolved(F.col("s"), F.col("h")).alias("t")).collect()
    assert {(r.s, r.h): r.t for r in rows} == cases


def test_layout():
    draw = random.Random(6)
    for _ in range(60):
        n = draw.randint(0, 30)
        period = max(1.0, n * 1.3)
        values = sorted(draw.random() * period * draw.choice([1, 0.05]) for _ in range(n))
        placed = layout.on_ring(values, 1.0, period)
        assert n < 2 or layout.least_gap(placed, period) >= 1 - 1e-6
    assert layout.spread([0.0, 0.0, 10.0], 2.0) == [-1.0, 1.0, 10.0]
    rows = pd.DataFrame([("r", None, 0)] + [(f"k{i:02}", "r", 1) for i in range(40)] + [(f"l{i:02}", f"k{i % 40:02}", 2) for i in range(80)], columns=["topic_id", "parent", "depth"])
    found = layout.package_layout(rows)
    assert len(found) == len(rows) and sorted(found["radius"].unique())[0] == layout.CENTRE and all(abs(math.hypot(r.x, r.y) - r.radius) < 0.2 for r in found.itertuples())


def test_signatures_of_a_table_are_those_of_a_column(spark):
    """Permutations one by one in lambdas took 692 task seconds over 0.1 GB."""
    data = [(1, None), (2, ""), (3, "one"), (4, "a b a b a b"), (5, "Subject: Re: x y z"), (6, " ".join(f"w{i * i % 977}" for i in range(3000))), (None, "a b")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    for n, words in ((64, 2), (16, 3)):
        of_column = {r.doc_id: r.s for r in docs.select("doc_id", minhash.signature(F.col("text"), n, words).alias("s")).collect()}
        table = minhash.signed(docs, n, words)
        assert {r.doc_id: r.signature for r in table.collect()} == of_column
        assert "MapInArrow" in table._jdf.queryExecution().executedPlan().toString()


def test_bridges_against_all_pairs(spark):
    draw = random.Random(8)
    words = [f"term{i}" for i in range(25)]
    topics = [(f"t{i}", draw.choice("AB"), " ".join(draw.choice(words[: draw.choice([5, 25])]) for _ in range(draw.randint(0, 12)))) for i in range(70)]
    vectors = {}
    for t, p, text in topics:
        counts = {w: text.split().count(w) for w in text.split()}
        norm = math.sqrt(sum((1 + math.log(c)) ** 2 for c in counts.values()))
        vectors[t] = (p, {w: (1 + math.log(c)) / norm for w, c in counts.items()})
    for least in (0.65, 0.3, 0.0):
        wanted = set()
        for s, (p, a) in vectors.items():
            if p == "A":
                near = sorted((-round(sum(v * b.get(w, 0) for w, v in a.items()), 9), t) for t, (q, b) in vectors.items() if q == "B" and set(a) & set(b))
                wanted |= {(s, t) for k, t in near[:3] if -k >= least}
        frame = spark.createDataFrame(topics, "topic_id string, package string, text string")
        found = bridges.nearest(frame, spark.createDataFrame([("A", "B")], "source_package string, target_package string"), threshold=least)
        assert {(r.source_id, r.target_id) for r in found.collect()} == wanted
        assert all(r.rationale.startswith("Shared concept: term") for r in found.collect())


def test_purge_follows_the_tree(spark):
    records = spark.createDataFrame([(1, "/d/a.md::part::1", "t3", None), (2, "/d/b.md", "t5", None), (3, "zip#/d/a.md", "t4", None)], "id long, doc_identifier string, topic_id string, virtual_uri string")
    edges = spark.createDataFrame([("t1", None, 1), ("t2", "t1", 1), ("t3", "t2", 1), ("t4", "t3", 1), ("t5", "t1", 1), ("t9", "gone", 1)], "child string, parent string, is_primary int")
    nodes = spark.createDataFrame([(f"t{i}", f"n{i}") for i in (1, 2, 3, 4, 5, 9)], "topic_id string, name string")
    out = lifecycle.purge_document(records, nodes, edges, spark.createDataFrame([("t4", "t5"), ("t5", "t1")], "source_id string, target_id string"), records.select("id"), "/d/a.md")
    assert [r.id for r in out["records"].collect()] == [2] and {r.topic_id for r in out["nodes"].collect()} == {"t1", "t5", "t9"}
    assert {(r.child, r.parent) for r in out["edges"].collect()} == {("t1", None), ("t5", "t1")} and out["bridges"].count() == 1 and out["vectors"].count() == 1


def test_extraction(spark):
    text = "ADR-7 adr-07 PRJ-3, 000.000.000-00 and 123.456.789-09; R$ 1.250,50 and BRL 3,10 on 2024-02-30, 29/02/2024 and 2024-02-29. at 10.1.2.3:8080 or 10.1.2.300, port 22 and :443 at 12:30:15 [N](a/b.md) Nginx proxy"
    scanners = (*extraction.SCANNERS, extraction.named("service", {"nginx": ["nginx", "nginx proxy"]}))
    rows = {(r.kind, r.norm): (r.n, r.name) for r in extraction.mentions(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), scanners).collect()}
    assert rows == {("adr", "ADR-07"): (2, "ADR-7"), ("prj", "PRJ-03"): (1, "PRJ-3"), ("cpf", "123.456.789-09"): (1, "123.456.789-09"), ("monetary", "R$ 1.250,50"): (1, "R$ 1.250,50"), ("monetary", "R$ 3,10"): (1, "R$ 3,10"), ("date", "2024-02-29"): (2, "2024-02-29"), ("ip", "10.1.2.3"): (2, "10.1.2.3"), ("port", "8080"): (1, "8080"), ("ip port", "10.1.2.3 8080"): (1, "10.1.2.3:8080"), ("port", "22"): (1, "22"), ("port", "443"): (1, "443"), ("wiki_link", "b.md"): (1, "b.md"), ("service", "nginx"): (1, "Nginx proxy")}
    found = extraction.relations(extraction.mentions(spark.createDataFrame([(1, text)], "doc_id long, text string"), scanners), extraction.NOTE_RELATIONS, extraction.NOTE_PAIRS)
    assert {(r.source, r.target) for r in found.where("relation = 'runs_on'").collect()} == {("nginx", "10.1.2.3")} and found.where("relation = 'has_port'").count() == 1
    spans = extraction.entities_in_text(spark.createDataFrame([(1, "New York City in new york")], "id long, text string"), {"NY": ["new york"], "NYC": ["New York City"], "City": []}).collect()
    assert {(r.name, r.start) for r in spans} == {("NYC", 0), ("NY", 17)}


def test_search_modes(spark):
    records = spark.createDataFrame([(i, f"t{i}", f"word{i % 3} common", i % 4) for i in range(40)], "id long, title string, content string, clearance int")
    vectors = spark.createDataFrame([(i, [math.cos(i / 9), math.sin(i / 9)]) for i in range(60)], "id long, v array<double>")
    texts, queries = spark.createDataFrame([(0, "word1")], "question long, text string"), spark.createDataFrame([(0, [1.0, 0.0])], "question long, q array<double>")
    plain = search.search(records, vectors, texts, queries, search.Mode(3), 1, 2).collect()
    assert len(plain) == 3 and all(r.id % 4 <= 1 and r.id < 40 for r in plain)
    assert search.search(records, vectors, texts, queries, search.Mode(3, depth="deep_synthesis"), 1).count() == 10 and search.search(records, vectors, texts, queries, search.Mode(3, "legal_discovery", floor=1.0), 1).count() == 0
    hits = spark.createDataFrame([(0, 1, "Alpha works well [1]. Beta is not it. Gamma alpha again.", 0.9), (0, 2, "Alpha works well. Other.", 0.8), (1, 1, "no", 0.1)], "question long, rank long, text string, confidence double")
    asked = spark.createDataFrame([(0, "how does ALPHA work"), (1, "x"), (2, "none")], "question long, text string")
    rows = {r.question: (r.refused, r.answer) for r in search.answers(asked, hits).collect()}
    assert rows == {0: (False, "- Alpha works well . [1]\n- Gamma alpha again. [1]\n- Alpha works well. [2]"), 1: (True, None), 2: (True, None)}


def test_streams(spark, tmp_path):
    at = lambda ms: datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(milliseconds=ms)
    schema = "path string, event_type string, ts timestamp, seq long"
    batches = [[("a.md", "create", at(0), 0), ("b.md", "modify", at(20), 1), ("a.md", "delete", at(30), 2)], [("a.md", "modify", at(500), 3), ("c.exe", "create", at(501), 4)], [("z.md", "modify", at(10_000_000), 5)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    events = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = lambda q: q.trigger(availableNow=True).start().awaitTermination()
    watch.global_bursts(events(), 0.040).writeStream.format("memory").queryName("bursts").option("checkpointLocation", f"{tmp_path}/c0").trigger(availableNow=True).start().awaitTermination()
    got = {(r.path, r.outcome, r.n_events) for r in spark.table("bursts").collect()}
    assert {("a.md", "delete", 2), ("b.md", "modify", 1), ("a.md", "modify", 1), ("c.exe", "create", 1)} <= got
    bodies = spark.createDataFrame([("a.md", b"A"), ("b.md", b"B"), ("z.md", b"Z")], "path string, content binary")
    table = watch.KeyedTable(spark, f"{tmp_path}/index", watch.INDEX, "path")
    run(watch.follow(events(), table, lambda paths: bodies.join(paths, "path", "left_semi"), f"{tmp_path}/c1"))
    assert {r.path for r in table.current().collect()} == {"a.md", "b.md", "z.md"} and table.numbers("batch") == [0, 1, 2]
    bill = [(1, "t", "vencimento 15/03/2024 R$ 2.000,00"), (2, "t", "nothing")]
    for k in (0, 1):
        (tmp_path / "hook").mkdir(exist_ok=True)
        (tmp_path / f"hook/{k}.json").write_text("\n".join(f'{{"doc_id": {i}, "title": "{t}", "content": "{c}"}}' for i, t, c in bill))
    actions = watch.KeyedTable(spark, f"{tmp_path}/actions", watch.ACTIONS, "key")
    run(watch.dispatch(watch.webhook(spark, f"{tmp_path}/hook"), F.lit("2024-03-14").cast("date"), actions, f"{tmp_path}/c2"))
    assert sorted(r.action_type for r in actions.current().collect()) == ["BILL_DUE_SOON", "HIGH_VALUE_PAYMENT"]
    assert {(r.path, r.state) for r in watch.changes(spark.createDataFrame([("a", "x"), ("q", "y")], "path string, sha256 string"), bodies.withColumn("path", F.substring("path", 1, 1))).collect()} == {("a", "modified"), ("q", "deleted"), ("b", "added"), ("z", "added")}


def test_text_edges(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.sections(F.lit(None).cast("string"))) == {} and one(T.sections(F.lit("plain"))) == {"Description": "plain"}
    assert one(T.table_headers(F.lit("a\n| x |\nb"))) is None and one(T.smart_trim(F.lit(None).cast("string"))) == ""
    assert one(T.parse_virtual_uri(F.lit("archive://a#"))) is None and one(T.split_inner(F.lit("plain"))) is None
    assert one(T.unquoted(F.lit("a%2520b+c%zz"))) in ("a b+c%zz", "a%2520b+c%zz")
    assert one(intent.clearance_level(F.lit(None).cast("string"))) == 3 and one(intent.authorized_levels(F.lit("odd"))) == [0]
    assert one(T.chunk_title(F.lit("T"), F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit("s"), F.lit(0), F.lit(2))) == "T — b > c (s) [1/2]"
    assert one(R.terms(F.lit("Ção É naïve_x 漢字 1"))) == ["cao", "e", "naive", "x", "漢字", "1"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_every_query_has_rows(spark):
    from siltstone.plans import registry

    for name in ("r6_route", "r4_search", "f36_answers", "j14_near_pairs", "f35_layout", "s14_html_sections", "f31_scrub"):
        assert not registry.QUERIES[name](spark, "/root/testdata/sf0.001").isEmpty(), name
    assert chunking.PROFILES["edge"].chars == 3000


def test_telemetry(spark):
    from siltstone.functions import telemetry

    row = (1, "mail a@b.org", {"Query": "x", "note": "id 123.456.789-09"}, [("p", {"k": "/home/u/x"})], ("q", None))
    frame = spark.createDataFrame([row, (2, None, None, None, None)], "n long, note string, tags map<string,string>, items array<struct<path:string,more:map<string,string>>>, body struct<a:string,b:int>")
    assert telemetry.violations(frame) == ["items[].path", "body"]
    one, two = telemetry.sanitize(frame).orderBy("n").collect()
    assert one.asDict(True) == {"n": 1, "note": "mail [REDACTED_EMAIL]", "tags": {"note": "id [REDACTED_CPF]"}, "items": [{"more": {"k": "[REDACTED_PATH]"}}]} and two.note is None and two["items"] is None
    packed = spark.createDataFrame([('{"b": 1, "a": "x"}',), (None,)], "j string").select(telemetry.pack(F.col("j"), b'{"a":"x","b":').alias("p")).select("p", telemetry.unpack(F.col("p"), b'{"a":"x","b":').alias("j"))
    assert [r.j for r in packed.collect()] == ['{"a":"x","b":1}', None]
