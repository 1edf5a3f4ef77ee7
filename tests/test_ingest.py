"""The stream from a dropped document to its action: stopped after each sink, started again, compared with one that ran through."""

import json
import os

import pytest
from pyspark.sql import functions as F

from siltstone.streaming import ingest, watch

RULES = ingest.Rules({"invoice": ["invoice", "fatura"], "contract": ["contract"]}, {"Acme": ["acme ltd"], "Acme Power": ["acme ltd power"]}, {"energy": ["power"], "urgent": ["urgent"]})
def _today():
    return F.lit("2024-03-14").cast("date")


DROPS = [
    [
        {"doc_id": 1, "seq": 1, "title": "Fatura", "content": "Acme Ltd power. Vencimento: 16/03/2024. Total R$ 12.000,00. Host 10.0.0.1"},
        {"doc_id": 2, "seq": 2, "title": "", "content": None, "tags": ["Power", "power", None], "clearance": "nonsense"},
        {"doc_id": None, "seq": 3, "title": "lost"},
        {"doc_id": 3, "seq": 5, "title": "new", "content": "contract for 10.0.0.2"},
        {"doc_id": 3, "seq": 4, "title": "old", "content": "invoice for 10.0.0.3"},
    ],
    [
        {"doc_id": 1, "seq": 6, "title": "Fatura", "content": "Acme Ltd. Vencimento: 16/03/2024. Total R$ 12.000,00. Host 10.0.0.9", "correspondent": "Own"},
        {"doc_id": 4, "seq": 7, "title": "More", "content": "R$ 99.000,00", "clearance": "public"},
    ],
    [{"doc_id": 5, "seq": 8, "title": "Last", "content": "nothing"}],
]


def _drop(tmp_path, name, n):
    os.makedirs(f"{tmp_path}/{name}", exist_ok=True)
    with open(f"{tmp_path}/{name}/{n}.json", "w") as f:
        f.write("\n".join(map(json.dumps, DROPS[n])))


def _held(into):
    return {s: sorted((tuple(r) for r in getattr(into, s).current().collect()), key=repr) for s in ingest.SINKS}


def _run(spark, tmp_path, name, into, after=None, deliver=None):
    stream = watch.webhook(spark, f"{tmp_path}/{name}", ingest.PAYLOAD)
    ingest.ingest(stream, into, RULES, _today(), f"{tmp_path}/{name}-check", deliver, after).trigger(availableNow=True).start().awaitTermination()


@pytest.fixture(scope="module")
def through(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("through")
    into = ingest.tables(spark, f"file://{where}/t", buckets=2)
    for n in range(3):
        _drop(where, "in", n)
        _run(spark, where, "in", into)
    return _held(into), [tuple(r) for r in ingest.status(into).collect()]


def test_a_document_becomes_record_mentions_and_actions(through):
    held, status = through
    docs = {r[0]: r for r in held["documents"]}
    assert sorted(docs) == [1, 2, 3, 4, 5] and docs[3][1] == "new" and docs[2][1] == "Document-2" and docs[2][7] == 3 and docs[4][7] == 0
    assert docs[1][3] == "Own" and docs[1][4] == "invoice" and docs[3][4] == "contract" and docs[2][5] == ["Power", "power"]
    of = lambda n: {r[2] for r in held["postings"] if r[1] == n}
    assert {"correspondent:own", "document_type:invoice"} <= of(1) and "tag:energy" not in of(1) and of(2) == {"tag:power"}
    assert any("10.0.0.9" in x for x in of(1)) and any("10.0.0.2" in x for x in of(3)) and not any("10.0.0.1" in x or "10.0.0.3" in x for x in of(1) | of(3))
    # Document 1 came twice with the same due date and sum: its actions fired once.
    assert sorted((r[0], r[1]) for r in held["actions"]) == [(1, "BILL_DUE_SOON"), (1, "HIGH_VALUE_PAYMENT"), (4, "HIGH_VALUE_PAYMENT")]
    assert status == [(3, 6, 3)]  # documents 1 and 1 again count twice


def test_stopped_after_each_sink_and_started_again(spark, tmp_path, through):
    into = ingest.tables(spark, f"file://{tmp_path}/t", buckets=2)
    sent, stops = [], [(0, "documents"), (0, "postings"), (1, "actions"), (1, "batches"), (2, "postings")]

    def stop(name, number):
        if (number, name) in stops:
            stops.remove((number, name))
            raise RuntimeError("stopped here")

    def deliver(fresh, number):
        sent.extend(r["key"] for r in fresh.select("key").collect())

    for n in range(3):
        _drop(tmp_path, "in", n)
        for _ in [s for s in stops if s[0] == n]:
            with pytest.raises(Exception, match="stopped here"):
                _run(spark, tmp_path, "in", into, stop, deliver)
        _run(spark, tmp_path, "in", into, stop, deliver)
    assert stops == [] and _held(into) == through[0]
    assert set(sent) == {r[-1] for r in through[0]["actions"]} and len(sent) > len(set(sent))


def test_an_empty_batch_changes_nothing(spark, tmp_path):
    into = ingest.tables(spark, f"file://{tmp_path}/t", buckets=2)
    ingest.take(spark.createDataFrame([], ingest.PAYLOAD), 0, into, RULES, _today())
    assert _held(into) == {"documents": [], "postings": [], "actions": [], "batches": [(0, 0, 0, 0)]}
