"""Missing identifiers and commands that many questions share are compared once each, with the same answers as for each question alone."""

from pyspark.sql import functions as F

from siltstone.operators import lookup


def test_shared_names_are_compared_once(spark):
    titles = [f"ALM-{20000 + 7 * i} here" for i in range(60)] + [f"KPI-{5 * i} there" for i in range(20)] + ["use DSP OPTMAX now", "DSP OPTMB", "DSP OTHER"]
    records = spark.createDataFrame([(i, f"r{i}", t, "", 0) for i, t in enumerate(titles)], "id long, doc_identifier string, title string, content string, clearance int")
    names = ["ALM-20001", "ALM-20050", "ALM-20300", "KPI-12", "DSP OPTMZ", "none"]
    asked = [(q, names[q % len(names)]) for q in range(60)]
    known = [(t.split()[0], t) for t in titles if "-" in t]
    near = {}
    for name in names[:4]:
        prefix, of = name.split("-")
        found = [(abs(int(k[4:]) - int(of)), k) for k, _ in known if k[:3] == prefix and k != name]
        ring = lambda n: [x for x in found if prefix != "ALM" or x[1][4:].startswith(of[:-n])]
        near[name] = [(k, d) for d, k in sorted(ring(1) if len(ring(1)) >= 6 else ring(2))[:3]]
    rows = lookup.number_neighbours(records, spark.createDataFrame(asked, "question long, norm string"), 3, 3)
    result = {}
    for r in rows.orderBy("question", "rank").collect():
        result.setdefault(r.question, []).append((r.identifier, r.distance))
    assert result == {q: near[n] for q, n in asked if n in near}
    commands = lookup.similar_commands(records, spark.createDataFrame(asked, "question long, norm string"), 3, 3)
    assert {(r.question, r.identifier) for r in commands.collect()} == {(q, c) for q, n in asked if n == "DSP OPTMZ" for c in ("DSP OPTMAX", "DSP OPTMB")}
    wide = spark.range(2000).select(F.col("id").alias("question"), F.lit("ALM-20001").alias("norm"))
    assert lookup.number_neighbours(records, wide, 3, 3).count() == 6000
    for found in (rows, commands):  # names are made distinct before they meet records
        assert "Deduplicate" in found._jdf.queryExecution().analyzed().toString()
