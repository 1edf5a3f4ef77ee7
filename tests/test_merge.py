"""Two graphs as one."""

from siltstone.operators import graphstore


def _graph(spark, documents, entities, postings, relations):
    return graphstore.Graph(
        spark.createDataFrame(documents, "doc_id long, identifier string, title string, created string, clearance int"),
        spark.createDataFrame(entities, "norm string, name string, kind string, clearance int"),
        spark.createDataFrame(postings, "doc_id long, norm string, n long, context string"),
        spark.createDataFrame(relations, "source string, target string, relation string, doc_id long, clearance int"),
    )


def test_merged_rows_are_dealt_by_number(spark, monkeypatch):
    """Partitions were as large as compressed bytes asked for, and rows were sorted before they were dealt as well as after."""
    monkeypatch.setattr(graphstore, "MERGED_ROWS", 10, raising=False)
    sides = [_graph(spark, [(i, f"D{i}", None if k else "t", "", 0) for i in range(k, 60, k + 1)], [(f"e{i}", f"E{k}", f"kind{k}", k) for i in range(7)], [(i, f"e{i % 7}", 1 + k, f"c{k}") for i in range(k, 60, k + 1)], [("e1", "e2", "r", i if i % 5 else None, k) for i in range(20 + 5 * k)]) for k in (0, 1)]
    out = graphstore.merge(*sides)
    assert sorted((r.doc_id, r.title) for r in out.documents.collect()) == [(i, "t") for i in range(60)]
    assert {tuple(r) for r in out.entities.collect()} == {(f"e{i}", "E0", "kind0", 1) for i in range(7)}
    assert {(r.doc_id, r.n, r.context) for r in out.postings.collect()} == {(i, 1 + i % 2, "c0") for i in range(60)}
    # Each side keeps its copies; of the right only what the left lacks comes, where a null document is a value.
    assert sorted((r.doc_id or -1, r.clearance) for r in out.relations.collect()) == sorted([(i if i % 5 else -1, 0) for i in range(20)] + [(i, 1) for i in range(21, 25)])
    for table in (out.documents, out.entities, out.postings, out.relations):
        assert table.rdd.getNumPartitions() == 11  # 60 and 30 documents, 7 entities twice
    plan = out.postings._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1
