"""Relations read the mentions once."""

from siltstone.operators import extraction


def test_mentions_are_made_once(spark):
    """They were made for each kind of relation and each side of a pair, and dealt three times."""
    rows = [(1, "cpf", "c1"), (1, "cpf", "c1"), (1, "monetary", "m1"), (1, "monetary", "m2"), (2, "ip port", "10.0.0.7 8080"), (2, "cpf", "c2"), (None, "cpf", "c3"), (None, "monetary", "m3"), (3, "other", "o"), (3, None, "n")]
    found = spark.createDataFrame([(*r, r[2]) for r in rows], "doc_id long, kind string, norm string, name string").mapInArrow(lambda batches: batches, "doc_id long, kind string, norm string, name string")
    out = extraction.relations(found, {"cpf": "mentions_cpf"}, (("cpf", "monetary", "owes"),))
    want = {(1, "document:1", "c1", "mentions_cpf", "document", "cpf"), (2, "document:2", "c2", "mentions_cpf", "document", "cpf"), (None, None, "c3", "mentions_cpf", "document", "cpf"), (2, "10.0.0.7", "8080", "has_port", "ip", "port"), (1, "c1", "m1", "owes", "cpf", "monetary"), (1, "c1", "m2", "owes", "cpf", "monetary")}
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 1
