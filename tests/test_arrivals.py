"""Keyed tables and near duplicates on streams, with batches done again and restarts."""

import os
import random

from pyspark.sql import functions as F

from siltstone.operators import minhash
from siltstone.streaming import arrivals
from siltstone.streaming.keyed import KeyedTable


def frame(spark, data):
    return spark.createDataFrame(data, "k string, v int")


def held(table, **options):
    return {r.k: r.v for r in table.current(**options).collect()}


def test_keyed_table(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "k string, v int", "k", buckets=4, merge_after=3)
    assert held(table) == {}
    table.put(0, frame(spark, [("a", 1), ("b", 2), (None, 9)]))
    table.put(1, frame(spark, [("b", 3)]), spark.createDataFrame([("a",), ("b",), ("zz",)], "k string"))
    for _ in range(2):  # a batch that is done again
        table.put(2, frame(spark, [("c", 4)]))
    assert held(table) == {None: 9, "b": 3, "c": 4} and held(table, before=1) == {"a": 1, "b": 2, None: 9} and held(table, before=2) == {None: 9, "b": 3}
    assert held(table, only=spark.createDataFrame([("b",), ("a",)], "k string")) == {"b": 3}
    table.put(3, frame(spark, [("a", 5)]))  # merges 0 to 2
    assert table.numbers("base") == [2] and table.numbers("batch") == [3]
    assert held(table) == {None: 9, "b": 3, "c": 4, "a": 5} and held(table, before=3) == {None: 9, "b": 3, "c": 4}
    table.put(3, frame(spark, [("a", 6)]))
    assert held(table)["a"] == 6


def test_a_batch_writes_its_own_rows_only(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "k string, v int", "k", buckets=4)
    table.put(0, spark.range(5000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v")))
    table.put(1, frame(spark, [("77", 2)]))
    size = lambda n: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(f"{tmp_path}/t/batch-{n}") for f in names)
    assert size(1) < size(0) / 5 and held(table)["77"] == 2


def test_stream_decides_as_all_at_once(spark, tmp_path):
    draw = random.Random(8)
    vocabulary = ["w%d" % i for i in range(300)]
    texts = [" ".join(draw.choice(vocabulary) for _ in range(60)) for _ in range(25)]
    for _ in range(45):  # near copies of near copies, and copies
        words = draw.choice(texts).split()
        for _ in range(draw.choice([0, 1, 2, 4])):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        texts.append(" ".join(words))
    draw.shuffle(texts)
    data = [(i, t) for i, t in enumerate([*texts, None, "", None])]
    schema = "doc_id long, text string"
    whole = {tuple(r) for r in minhash.first_kept(spark.createDataFrame(data, schema)).collect()}
    bands, verdicts = arrivals.bands_table(spark, f"file://{tmp_path}/bands", merge_after=2, buckets=4), arrivals.verdict_table(spark, f"file://{tmp_path}/verdicts", buckets=4)
    os.mkdir(tmp_path / "in")
    for part in range(3):  # three deliveries, the query started anew for each
        own = data[part * 25 : (part + 1) * 25]
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").json(f"file://{tmp_path}/in/{part}")
        stream = spark.readStream.schema(schema).json(f"file://{tmp_path}/in/*")
        query = arrivals.keep_first(stream, bands, verdicts, f"file://{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        arrivals.decide(spark.createDataFrame(own, schema), part, bands, verdicts)  # as after a failure before the batch was marked done
    assert {tuple(r) for r in verdicts.current().collect()} == whole and any(not k for _, k in whole)
