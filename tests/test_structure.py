"""Structure extractors, dense parts of a graph and bridges that are brought up to date, against plain Python."""

import random

import pytest

from siltstone.operators import bridges, structure, topology
from siltstone.operators.graphstore import Graph


def _rows(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=repr)


def _plain_core(links, core):
    links = set(links)
    while True:
        count = {}
        for a, b in links:
            count[a], count[b] = count.get(a, 0) + 1, count.get(b, 0) + 1
        kept = {(a, b) for a, b in links if count[a] >= core and count[b] >= core}
        if kept == links:
            return count
        links = kept


def _store(spark, entities, relations):
    none = spark.createDataFrame([], "doc_id long, norm string, n long, context string")
    docs = spark.createDataFrame([], "doc_id long, identifier string, title string, created date, clearance int")
    e = spark.createDataFrame(entities, "norm string, name string, kind string, clearance int")
    r = spark.createDataFrame(relations, "source string, target string, relation string, doc_id long, clearance int")
    return Graph(docs, e, none, r)


@pytest.mark.parametrize("core", [1, 2, 3, 4])
def test_core_equals_plain_peeling(spark, core):
    draw = random.Random(core)
    names = [f"n{i}" for i in range(40)]
    links = {tuple(sorted(draw.sample(names, 2))) for _ in range(70)} | {tuple(sorted((f"c{i}", f"c{i + 1}"))) for i in range(6)}
    frame = spark.createDataFrame(sorted(links), "a string, b string")
    assert dict(map(tuple, topology.peeled(frame, core).collect())) == _plain_core(links, core)


def test_chains_fall_link_by_link_and_rounds_are_bounded(spark):
    chain = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(8)], "a string, b string")
    assert topology.peeled(chain, 2).count() == 0
    with pytest.raises(RuntimeError):
        topology.peeled(chain, 2, most=2)


def test_topology_by_kind_clearance_term_and_hubs(spark):
    entities = [(n, n.upper(), "ne" if n < "g" else "alarm", 3 if n == "f" else 0) for n in "abcdefgh"] + [("hub", "100% HUB", "ne", 0)]
    triangle = [("a", "b", "x", None, 0), ("b", "a", "y", 1, 0), ("b", "c", "x", None, 0), ("c", "a", "x", None, 3), ("a", "a", "x", None, 0), ("g", "h", "x", None, 0), ("a", None, "x", None, 0)]
    g = _store(spark, entities, triangle + [("hub", n, "x", None, 0) for n in "abcdf"])
    nodes, edges = topology.topology(g, ("ne",), 2, core=2)
    assert _rows(nodes, "norm", "degree") == [("a", 2), ("b", 3), ("c", 2), ("hub", 3)]
    assert ("b", "a", "y") in _rows(edges, "source", "target", "relation") and ("c", "a", "x") not in _rows(edges, "source", "target", "relation")
    assert _rows(topology.topology(g, ("ne",), 3, core=2, cap=4)[0], "norm") == [("a",), ("b",), ("c",)]
    assert _rows(topology.topology(g, None, 3, term="0% h", core=0)[0], "norm", "degree") == [("hub", 0)]
    assert topology.topology(_store(spark, [], []), core=2)[0].count() == 0


def test_lowest_priority_detects_and_first_source_claims(spark):
    listed = spark.createDataFrame([("A.html", "t1", None, "One", 0), ("a.html", "t2", "t1", None, 1), ("b.html", "t2", "t1", None, 2), ("b.html", "t2", "t3", None, 3), (None, "t3", None, "Three", 4)], "page string, topic string, parent string, name string, place int")
    records = spark.createDataFrame([(1, "/g/x/a.html"), (2, "/g/B.HTML#s"), (3, "/g/B.html#t"), (4, "/g/gone.html"), (5, "/o/d/e.txt#1"), (6, "/o/d/e.txt#2"), (7, "elsewhere"), (8, None)], "id int, uri string")
    guide, rest = structure.Source("guide", "/g/", listed), structure.Source("rest", "/")
    assert structure.extractor_for(guide).name == "contents" and structure.extractor_for(rest).name == "folders"
    got = structure.apply(records, [guide, rest])
    assert _rows(got.records, "id", "label", "topic_id", "record_kind", "review") == [
        (1, "guide", "guide:t1", "native", ""), (2, "guide", "guide:t2", "native", ""), (3, "guide", "guide:t2", "composite", ""), (4, "guide", None, "composite", "page not listed"),
        (5, "rest", "rest:path:o/d/e.txt", "native", ""), (6, "rest", "rest:path:o/d/e.txt", "composite", ""), (7, None, None, "external", ""), (8, None, None, "external", ""),
    ]
    assert _rows(got.nodes.where("package = 'guide'"), "topic_id", "name", "depth") == [("guide:t1", "One", 1), ("guide:t2", "t2", 2), ("guide:t3", "Three", 1)]
    assert ("guide:t2", "guide:t3", 0) in _rows(got.edges, "child", "parent", "is_primary") and ("guide:t2", "guide:t1", 1) in _rows(got.edges, "child", "parent", "is_primary")
    swapped = structure.apply(records, [rest, guide])
    assert _rows(swapped.records.where("label = 'guide'"), "id") == []
    assert structure.report(got).where("review = 'page not listed'").first()["n"] == 1


def test_registry_takes_names_once_and_other_extractors(spark):
    with pytest.raises(ValueError):
        structure.register(structure.FOLDERS)
    with pytest.raises(ValueError):
        structure.extractor_for(structure.Source("x", "notes.map"))
    own = structure.Extractor("own", 1, lambda s: True, structure.FOLDERS.claims, structure.FOLDERS.assign, structure.FOLDERS.tree)
    assert structure.extractor_for(structure.Source("x", "/"), structure.REGISTRY | {"own": own}).name == "own"


WORDS = "link quality alarm module optical power signal bearer loss timer profile session policy charge rule node".split()


def _topics(seed, n=60):
    draw = random.Random(seed)
    return {i: (f"p{i % 3}", " ".join(draw.choices(WORDS, k=draw.randint(0, 6)))) for i in range(n)}


def _frame(spark, topics):
    return spark.createDataFrame([(i, p, t) for i, (p, t) in sorted(topics.items())], "topic_id long, package string, text string")


@pytest.mark.parametrize("least", [0.6, 0.0])
def test_refreshed_bridges_equal_those_made_afresh(spark, least):
    before = _topics(1)
    now = {i: (p, t) for i, (p, t) in before.items() if i % 9 != 2}
    now |= {i: (p, t + " optical power") for i, (p, t) in now.items() if i % 7 == 1} | {100 + i: v for i, v in _topics(2, 8).items()} | {3: ("p1", now[3][1]), 200: ("p2", "wholly unheard words"), 201: ("p0", "unheard words wholly"), 202: ("p0", None)}
    companions = spark.createDataFrame([("p0", "p1"), ("p1", "p0"), ("p2", "p0"), ("p0", "p2")], "source_package string, target_package string")
    old, new = _frame(spark, before), _frame(spark, now)
    held, stored = bridges.stored_terms(old).cache(), bridges.nearest(old, companions, 3, least).cache()
    columns = ("source_id", "target_id", "similarity", "rationale", "rank")
    fresh = _rows(bridges.nearest(new, companions, 3, least), *columns)
    assert fresh and _rows(bridges.refresh(stored, held, new, companions, 3, least), *columns) == fresh
    assert (200, 201) not in {r[:2] for r in _rows(stored, *columns)} and (201, 200) in {r[:2] for r in fresh}
    # No change: nothing is found anew. An empty start: all is.
    assert _rows(bridges.refresh(stored, held, old, companions, 3, least), *columns) == _rows(stored, *columns)
    assert _rows(bridges.refresh(stored.limit(0), held.limit(0), new, companions, 3, least), *columns) == fresh


def test_hybrid_takes_stored_bridges_of_unchanged_topics_only(spark):
    before = _topics(5)
    companions = spark.createDataFrame([("p0", "p1"), ("p1", "p0")], "source_package string, target_package string")
    old = _frame(spark, before)
    held, stored = bridges.stored_terms(old).cache(), bridges.nearest(old, companions, 3, 0.5).cache()
    first = stored.first()["source_id"]
    asked = _frame(spark, {first: before[first], 500: before[first]})
    got = bridges.hybrid(stored, held, asked, companions, 3, 0.5)
    assert {tuple(r) for r in got.select("source_id", "how").collect()} == {(first, "stored"), (500, "realtime")}
    of = lambda n: _rows(got.where(f"source_id = {n}"), "target_id", "similarity", "rationale", "rank")
    assert of(first) == of(500)


def test_term_tables_hold_a_row_for_each_topic(spark):
    """Tables of a row for each topic and word were larger than the texts (F5), and pairs with their terms grew with the square of the topics on disk."""
    topics = _frame(spark, _topics(3, 30) | {900: ("p1", None), 901: ("p1", "-- --- ---")})
    held = bridges.stored_terms(topics)
    rows = {r.topic_id: r for r in held.collect()}
    assert len(rows) == topics.count() and rows[900].terms is None and len(rows[901].counts) == 1
    assert "Exchange" not in held._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [3, 7])
def test_bridges_do_not_depend_on_blocks(spark, size, monkeypatch):
    topics = _frame(spark, _topics(4, 20))
    companions = spark.createDataFrame([("p0", "p1"), ("p1", "p0"), ("p2", "p0")], "source_package string, target_package string")
    columns = ("source_id", "target_id", "similarity", "rationale", "rank")
    whole = _rows(bridges.nearest(topics, companions, 3, 0.2), *columns)
    monkeypatch.setattr(bridges, "BLOCK_TOPICS", size)
    assert whole and _rows(bridges.nearest(topics, companions, 3, 0.2), *columns) == whole
