"""Fill-in-middle rewriting against lists of units, and back."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import fill_middle


def plain(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def texts():
    draw = random.Random(6)
    fixed = [None, "", " ", "a", "word", "two words", "é", "ab1 cd\n\n2é😀x", "has <P> in it", "<<P", "<", "<S", "S>", ">", "a<M", "<P<S<M", "\r\n\t", "x" * 5000, "," * 5000, "日本語 text 日本"]
    return fixed + ["".join(draw.choice(["ab", "Q", " ", "<", ">", "P", "S", "M", "é", "😀", "\n", "7"]) for _ in range(draw.randint(1, 60))) for _ in range(400)]


def test_equals_lists_of_units_and_comes_back(spark):
    rows = [(i, t, "c", 1) for i, t in enumerate(texts())] + [(3, "a", "c", 1), (None, "no id at all", "c", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(4)
    out = fill_middle.fill_in_middle(frame).withColumn("back", fill_middle.restore(F.col("output"), F.col("form")))
    got = sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out.collect())
    assert got == sorted((str(i), *plain(i, t), t or "") for i, t, *_ in rows)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(frame.limit(0)).count() == 0


def test_cuts_at_every_place():
    for text in texts():
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "")
        runs = fill_middle.Runs(np.frombuffer((text or "").encode(), np.uint8))
        step = max(1, len(units) // 50)
        assert [runs.cut(u) for u in range(0, len(units) + 1, step)] == [len("".join(units[:u])) for u in range(0, len(units) + 1, step)]


def test_ten_megabytes_in_one_line(spark):
    long = [(1, "ab, " * 2_500_000), (2, "z" * 10_000_000), (3, "é" * 5_000_000)]
    frame = spark.createDataFrame(long, "doc_id long, text string")
    out = fill_middle.fill_in_middle(frame)
    assert {r.doc_id: r.n for r in out.select("doc_id", "n").collect()} == {1: 7_500_000, 2: 1, 3: 5_000_000}
    both = out.join(frame, "doc_id").where(fill_middle.restore(F.col("output"), F.col("form")) == F.col("text"))
    assert both.count() == 3
