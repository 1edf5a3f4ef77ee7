"""Fill-in-middle rewriting of texts, cut by units with a run-length class encoding.

A unit is a run of ASCII letters or any other single character. A text is held as its maximal runs of one
class (letters or not), each with the units and the characters before it; a run of letters is one unit
however long it is, any other run has as many units as characters. A cut after u units is found by binary
search for the run that holds it, and its place inside that run is arithmetic. No list of units is made, so a
text of one word and a text of a million commas cost the same few array operations.

Python sees the text and two numbers and returns three; hashes, slices and the marked text are native columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import hashing as H

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred texts, so many are rewritten; of a hundred rewritten ones, so many put the suffix first.
REWRITTEN, SUFFIX_FIRST = 90, 20
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


class Runs:
    """Maximal class runs of UTF-8 bytes: whether each is of letters, and the units and characters before it."""

    def __init__(self, data: np.ndarray):
        letter = _LETTER[data]
        starts = np.flatnonzero(np.concatenate([[True], letter[1:] != letter[:-1]])) if len(data) else np.zeros(0, np.int64)
        self.letters = letter[starts]
        chars = np.add.reduceat(((data & 0xC0) != 0x80).astype(np.int64), starts) if len(data) else np.zeros(0, np.int64)
        self.chars = np.concatenate([[0], np.cumsum(chars)])
        self.units = np.concatenate([[0], np.cumsum(np.where(self.letters, 1, chars))])

    def cut(self, units: int) -> int:
        """The characters before a cut after so many units."""
        run = int(np.searchsorted(self.units, units, side="right")) - 1
        return int(self.chars[run]) + (0 if run == len(self.letters) or self.letters[run] else units - int(self.units[run]))


def _cuts(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    """(units, characters before the first cut, characters before the second) for each text."""
    a, b = first.to_numpy(zero_copy_only=False), second.to_numpy(zero_copy_only=False)
    out = np.zeros((3, len(text)), np.int64)
    for row, data, offsets in H.chunks(text):
        for i in range(len(offsets) - 1):
            runs, at = Runs(data[offsets[i] : offsets[i + 1]]), row + i
            n = int(runs.units[-1])
            low, high = sorted((int(a[at]) % (n + 1), int(b[at]) % (n + 1)))
            out[:, at] = n, runs.cut(low), runs.cut(high)
    return pa.StructArray.from_arrays([pa.array(x) for x in out], ["n", "low", "high"])


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of ``seed:key``. A null key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rewritten: int = REWRITTEN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output; one row per input row.

    Null texts count as empty; empty texts and texts that hold a mark are plain. A null id draws from the
    seed alone; repeated rows are rewritten alike. Other columns are not read, whatever their names. An empty
    table gives no rows.
    """
    C.ship(docs.sparkSession)
    cuts = F.arrow_udf(_cuts, "struct<n: long, low: long, high: long>")
    text = F.col("text")
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when((text == "") | marked | (h3 % 100 >= rewritten), "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    cut = source.withColumn("cut", cuts(text, h1, h2)).select("doc_id", "text", F.col("cut.n").alias("n"), form.alias("form"), F.col("cut.low").alias("low"), F.col("cut.high").alias("high"))
    low, high = F.col("low").cast("int"), F.col("high").cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), low), F.substring(text, low + 1, high - low), F.substring(text, high + 1, F.length(text))
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    told = F.col("form") != "plain"
    return cut.select("doc_id", "n", "form", F.when(told, F.col("low")).alias("prefix_chars"), F.when(told, F.col("high") - F.col("low")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of. Marks can't arise at the seams, so the parts are what stands between the three marks."""
    parts = F.split(output, "<[PSM]>", -1)
    first, second, last = (F.get(parts, k) for k in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, last, second)).otherwise(F.concat(second, last, first))


def query(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(C.table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = """
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), d AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM u
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle, array_to_string(units[high + 1:n], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
