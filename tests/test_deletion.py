"""Many documents taken out of a graph at once."""

from siltstone.operators import graphstore


def test_deletions_are_dealt_by_the_number_of_documents(spark, monkeypatch):
    """Tasks were as many as compressed bytes asked for, however many rows these held."""
    monkeypatch.setattr(graphstore, "GONE_ROWS", 50, raising=False)
    docs = spark.range(1000).selectExpr("id AS doc_id", "concat('D', id) AS identifier", "'' AS title", "'' AS created", "0 AS clearance")
    postings = spark.range(3000).selectExpr("id % 1000 AS doc_id", "concat('e', id % 7) AS norm", "1L AS n", "'' AS context")
    entities = spark.createDataFrame([("e0", "e0", "k", 0)], "norm string, name string, kind string, clearance int")
    relations = spark.createDataFrame([("e0", "e0", "r", None, 0)], "source string, target string, relation string, doc_id long, clearance int")
    out = graphstore.delete_documents(graphstore.Graph(docs, entities, postings, relations), docs.where("doc_id % 2 = 0").select("doc_id"), orphans=False)
    assert sorted(r.doc_id for r in out.documents.collect()) == list(range(1, 1000, 2)) and out.postings.count() == 1500 and out.relations.count() == 1
    assert "REPARTITION_BY_NUM" in out.postings._jdf.queryExecution().executedPlan().toString() and out.postings.rdd.getNumPartitions() == 10
