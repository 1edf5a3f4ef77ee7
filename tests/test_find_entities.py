"""Containment of names against a plain scan, and that it joins on what it finds and not on pieces that many share."""

import random

from siltstone.operators import graphstore


def test_containment_by_whole_substrings(spark):
    draw = random.Random(4)
    norms = sorted({f"customer:{draw.randint(1, 400)}" for _ in range(200)} | {"ab", "b", "abc", "longer name"})
    asked = [(q, draw.choice(["ustomer:%d", "about customer:%d!", "customer:%d", " CUSTOMER:%d "]) % draw.randint(1, 500)) for q in range(300)] + [(300, "b"), (301, "a"), (302, "xabcx"), (303, "xabx"), (304, "  ")]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    docs = {n: draw.randint(0, 3) for n in norms}
    g = graphstore.Graph(None, frame([(n, n.upper(), "k", 0) for n in norms], "norm string, name string, kind string, clearance int"), frame([(d, n) for n in norms for d in range(docs[n])] or None, "doc_id long, norm string"), None)
    expected = set()
    for q, name in asked:
        low = name.strip(" ").lower()
        found = [(2, 0, -docs[n], 0, n) for n in norms if n == low] or [(3, 0, -docs[n], len(n), n) for n in norms if low and low in n] or [(4, -len(n), -docs[n], 0, n) for n in norms if len(n) >= 3 and n in low]
        if found:
            expected.add((q, min(found)[4], min(found)[0]))
    result = graphstore.find_entities(g, frame(asked, "question long, name string"))
    assert {tuple(r) for r in result.collect()} == expected
    assert "Contains(" not in result._jdf.queryExecution().toString()
