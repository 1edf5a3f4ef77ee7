"""Functions, file sources and event coalescing against plain Python."""

import io
import math
import random
import re
import tarfile
import zipfile
from collections import Counter
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from siltstone.functions import scalar as S
from siltstone.operators import graph
from siltstone.sources import files
from siltstone.streaming import debounce

TEXTS = [None, "", "   ", "aaaa", "ab\tab", "über\u3000", "id 123.456.789-09 or 12.345.678/0001-95", "mail a.b@c.org now, see /home/me/x y", "x12345678901y", "a" * 32, "0" * 64 + "\n", "C:\\data\\k 12345678901"]


def test_scalars(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i long, t string").select("t", S.entropy(F.col("t")).alias("e"), S.tokens(F.col("t")).alias("n"), S.scrub(F.col("t")).alias("s")).collect()
    for text, bits, tokens, scrubbed in rows:
        body = (text or "").strip()
        counts = Counter(body).values()
        assert abs(bits - -sum(c / len(body) * math.log2(c / len(body)) for c in counts)) < 1e-9
        assert tokens == (max(1, (len(body) + 3) // 4) if text else 0)
        wanted = text
        if text is not None and not re.fullmatch(S.DIGEST, text):
            for pattern, name in ((S.CNPJ, "CNPJ"), (S.CPF, "CPF"), (S.EMAIL, "EMAIL"), (S.PATH, "PATH")):
                wanted = re.sub(pattern, f"[REDACTED_{name}]", wanted)
        assert scrubbed == wanted


def test_formats_and_overlap(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(S.format_cpf(F.lit(" 12 "))) == "12"
    assert one(S.format_registration(F.lit("2023504910024"))) is None
    assert one(S.overlap(F.lit("a b c"), F.lit("B c d e"))) == 0.5
    assert one(S.overlap(F.lit(None).cast("string"), F.lit("b"))) == 0.0
    assert one(S.confidence(F.lit(0.9), F.lit(1), F.lit(None).cast("int"))) == 0.74


def test_bursts_against_a_timer(spark):
    draw, now, rows = random.Random(4), datetime(2024, 1, 1, tzinfo=timezone.utc), []
    for i in range(400):
        now += timedelta(milliseconds=draw.choice([0, 5, 39, 40, 41, 90, 700]))
        rows.append((f"p{draw.randrange(4)}", draw.choice(["create", "modify", "delete"]), now, i))
    wanted, pending, last = Counter(), {}, None
    for path, kind, at, _ in [*rows, (None, None, now + timedelta(days=1), 0)]:
        if last is not None and at - last >= timedelta(milliseconds=40):
            wanted.update(pending.items())
            pending = {}
        if path is not None:
            pending[path] = "delete" if "delete" in (kind, pending.get(path)) else kind
        last = at
    events = spark.createDataFrame(rows, "path string, event_type string, ts timestamp, seq long")
    for stretch in (1, 7, 3600):
        found = debounce.bursts(events.repartition(3), 0.040, stretch).collect()
        assert Counter((r["path"], r["outcome"]) for r in found) == wanted
        assert sum(r["n_events"] for r in found) == len(rows)
    assert debounce.bursts(events.limit(0)).count() == 0


def test_stream_of_file_events(spark, tmp_path):
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [("a", "create", at, 0), ("a", "delete", at, 1), ("b", "modify", at, 2), ("z", "modify", at + timedelta(days=2), 3)]
    for k, row in enumerate(rows):
        spark.createDataFrame([row], "path string, event_type string, ts timestamp, seq long").write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("path string, event_type string, ts timestamp, seq long").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = debounce.per_path(stream, "1 second").writeStream.format("memory").queryName("outcomes").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r["path"], r["outcome"]) for r in spark.table("outcomes").collect()} == {("a", "delete"), ("b", "modify")}


def test_walk_takes_the_first_shortest_path(spark):
    edges = spark.createDataFrame([("a", "b", "r"), ("a", "c", "r"), ("d", "c", "r"), ("b", "d", "r"), ("d", "e", "r"), (None, "e", "r")], "src string, dst string, relation string")
    found = {r["node"]: (r["level"], r["path"]) for r in graph.walk(edges, spark.createDataFrame([("a",)], "node string"), 3).collect()}
    assert found == {"a": (0, "a"), "b": (1, "a > b"), "c": (1, "a > c"), "d": (2, "a > b > d"), "e": (3, "a > b > d > e")}


def test_archives(spark, tmp_path):
    inner, outer, tar = io.BytesIO(), io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "deep")
    with zipfile.ZipFile(outer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "\ufeffone".encode())
        z.writestr("../up.txt", "no")
        z.writestr("bomb.txt", "0" * 1_000_000)
        z.writestr("in.zip", inner.getvalue())
        z.writestr("Thumbs.db", "no")
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        info = tarfile.TarInfo("t.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"tar"))
    for name, body in (("x.zip", outer.getvalue()), ("y.tgz", tar.getvalue()), ("bad.tar", b"no archive"), ("plain.txt", "caf\u00e9".encode("cp1252")), ("zero.bin", b"a\0b"), ("wide.txt", "wide".encode("utf-16")), ("odd.txt", b"\xff\xfea"), ("other.txt", b"\x81"), (".hidden", b"no"), ("empty.txt", b"")):
        (tmp_path / name).write_bytes(body)
    rows = files.members(files.scan(spark, str(tmp_path))).collect()
    found = {(r["path"].rsplit("/", 1)[1], r["member"]): r["error"] or r["text"] for r in rows}
    assert found == {
        ("x.zip", "a.txt"): "one",
        ("x.zip", "../up.txt"): "path",
        ("x.zip", "bomb.txt"): "ratio",
        ("x.zip", "in.zip!deep.txt"): "deep",
        ("y.tgz", "t.txt"): "tar",
        ("bad.tar", None): "ReadError",
        ("plain.txt", "plain.txt"): "caf\u00e9",
        ("zero.bin", "zero.bin"): None,
        ("wide.txt", "wide.txt"): "wide",
        ("odd.txt", "odd.txt"): None,
        ("other.txt", "other.txt"): "\x81",
    }
    empty = spark.createDataFrame([("p/empty.txt", b""), ("p/none.txt", None)], "path string, content binary")
    assert {(r["member"], r["text"]) for r in files.members(empty).collect()} == {("empty.txt", ""), ("none.txt", "")}
