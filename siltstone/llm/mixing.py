"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed by (source, language, topic). Fitting scales the cells until their sums meet the
target shares of every source, language and topic; cells without tokens stay empty. A document's inclusion
probability is its cell's fitted tokens over its cell's tokens, scaled so that cells with ``TRIM`` of the
fitted tokens, those with the largest ratios, reach 1 and are kept whole. Without that trim, one document of
a rare kind would set the scale for the whole table. It falls short of the targets by ``TRIM`` at most before
scaling. A document is kept if a number hashed from its id and the seed falls below that. So the choice does not depend
on the layout, and a run with the same seed keeps the same documents.

The number of cells is bounded by the targets: a value that no target names counts as ``OTHER``, and so
does null. Default targets are tempered shares, (n / total) ** alpha, of the values in the table itself;
there the ``MAX_VALUES`` largest values have targets of their own, and the tokens of all rarer ones together are ``OTHER``'s.

Topics: a document's topic is its form, judged from native statistics: ``table`` (bars), ``noisy``
(symbols after words), ``long`` (over 2000 tokens) or ``prose``.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

OTHER = "(other)"
MARGINS = ("source", "lang", "topic")
MAX_VALUES = 200
ROUNDS = 200
TRIM = 0.02
Targets = Mapping[str, Mapping[str, float]]


def n_tokens(text: Column) -> Column:
    """Words and one end token."""
    return (F.size(C.words(text)) + 1).cast("long")


def topic(text: Column, tokens: Column) -> Column:
    body = F.coalesce(text, F.lit(""))
    bars = C.count_char(body, "|")
    signs = C.count_chars(body, ("*", "$", "%", "#", "&"))
    return F.when(bars * 5 > tokens, "table").when(signs * 2 > tokens, "noisy").when(tokens > 2000, "long").otherwise("prose")


def with_margins(docs: DataFrame) -> DataFrame:
    """Adds __source, __lang, __topic and __tokens to all columns of docs."""
    text = F.col("text").cast("string")
    out = docs.withColumn("__tokens", n_tokens(text)).withColumn("__topic", topic(text, F.col("__tokens")))
    for name in ("source", "lang"):
        out = out.withColumn(f"__{name}", F.coalesce(F.col(name).cast("string"), F.lit(OTHER)))
    return out


def known(column: Column, values: list[str]) -> Column:
    return F.when(column.isin(values), column).otherwise(F.lit(OTHER)) if values else F.lit(OTHER)


def tempered(docs: DataFrame, alpha: float = 0.8) -> dict[str, dict[str, float]]:
    """Target shares that flatten those of the table: one small aggregate per margin."""
    out: dict[str, dict[str, float]] = {}
    sums = {name: docs.groupBy(F.col(f"__{name}").alias("value")).agg(F.sum("__tokens").alias("n")) for name in MARGINS}
    for name, frame in sums.items():
        rows = frame.orderBy(F.desc("n"), "value").limit(MAX_VALUES).collect()
        counts = {r["value"]: r["n"] for r in rows}
        if len(rows) == MAX_VALUES:
            rest = (frame.agg(F.sum("n").alias("n")).first()["n"] or 0) - sum(counts.values())
            if rest:
                counts[OTHER] = counts.get(OTHER, 0) + rest
        total = sum(counts.values()) or 1
        weights = {value: (n / total) ** alpha for value, n in counts.items()}
        whole = sum(weights.values()) or 1
        out[name] = {k: w / whole for k, w in weights.items()}
    return out


def rake(cells: dict[tuple[str, ...], float], targets: Targets, rounds: int = ROUNDS, tolerance: float = 1e-9) -> dict[tuple[str, ...], float]:
    """Fitted cell weights that sum to 1. Values without tokens, or without a target, are left out of the margins that they can't meet."""
    total = sum(cells.values())
    fitted = {k: v / total for k, v in cells.items()} if total else {}
    wanted = []
    for axis, name in enumerate(MARGINS):
        seen = {k[axis] for k, v in fitted.items() if v > 0}
        shares = {value: max(0.0, float(targets.get(name, {}).get(value, 0.0))) for value in sorted(seen)}
        whole = sum(shares.values())
        wanted.append({value: share / whole for value, share in shares.items()} if whole else None)
    for _ in range(rounds):
        worst = 0.0
        for axis, shares in enumerate(wanted):
            if shares is None:
                continue
            sums: dict[str, float] = {}
            for key in sorted(fitted):
                sums[key[axis]] = sums.get(key[axis], 0.0) + fitted[key]
            worst = max([worst, *(abs(sums[v] - share) for v, share in shares.items() if v in sums)])
            for key in fitted:
                now = sums[key[axis]]
                fitted[key] = fitted[key] * shares[key[axis]] / now if now > 0 else 0.0
        if worst < tolerance:
            break
    return fitted


def scale(fitted: dict[tuple[str, ...], float], ratio: dict[tuple[str, ...], float], trim: float = TRIM) -> float:
    """The ratio that becomes probability 1: cells with larger ones hold at most ``trim`` of the fitted tokens."""
    above = 0.0
    for key in sorted(ratio, key=lambda k: (-ratio[k], k)):
        above += fitted[key]
        if above > trim:
            return ratio[key]
    return max(ratio.values(), default=1.0) or 1.0


def plan(docs: DataFrame, targets: Targets | None = None, alpha: float = 0.8, trim: float = TRIM) -> tuple[list[tuple[str, str, str, float, float]], Targets]:
    """For each cell: its values, its fitted share and its documents' inclusion probability. docs come from with_margins.

    Texts are read once here: their token sums by raw cell are written, and all margins come from those.
    """
    sums = docs.groupBy(*(f"__{m}" for m in MARGINS)).agg(F.sum("__tokens").alias("__tokens"))
    raw = C.Store(docs.sparkSession, "mixing").put("cells", sums)
    targets = targets or tempered(raw, alpha)
    named = [known(F.col(f"__{m}"), sorted(targets.get(m, {}))).alias(m) for m in MARGINS]
    rows = raw.select(*named, "__tokens").groupBy(*MARGINS).agg(F.sum("__tokens").alias("n")).collect()
    cells = {(r["source"], r["lang"], r["topic"]): float(r["n"]) for r in rows}
    fitted = rake(cells, targets)
    ratio = {k: fitted[k] / cells[k] if cells[k] else 0.0 for k in cells}
    most = scale(fitted, ratio, trim)
    return [(*k, fitted[k], min(1.0, ratio[k] / most)) for k in sorted(cells)], targets


def with_probability(docs: DataFrame, cells: list[tuple[str, str, str, float, float]], targets: Targets, seed: int = 0) -> DataFrame:
    """Adds __share, __p and __selected. The cell table is a broadcast of (MAX_VALUES + 1) cubed rows at the very most."""
    rows = json.dumps([dict(zip(("__s", "__l", "__t", "__share", "__p"), c, strict=True)) for c in cells])
    kind = "array<struct<__s:string,__l:string,__t:string,__share:double,__p:double>>"
    small = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(rows), kind)))
    named = docs
    for m, short in zip(MARGINS, "slt", strict=True):
        named = named.withColumn(f"__{m}", known(F.col(f"__{m}"), sorted(targets.get(m, {}))))
    on = (F.col("__source") == F.col("__s")) & (F.col("__lang") == F.col("__l")) & (F.col("__topic") == F.col("__t"))
    u = C.md5_unit(F.concat(F.lit(f"mix/{seed}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return named.join(F.broadcast(small), on, "left").withColumn("__selected", u < F.col("__p")).drop("__s", "__l", "__t")


def mix(docs: DataFrame, targets: Targets | None = None, alpha: float = 0.8, seed: int = 0) -> DataFrame:
    """doc_id, its margins, n_tokens, cell_share, probability and selected; one row per input row.

    Null texts are one token; null sources and languages count as OTHER; repeated ids are kept or left together.
    """
    ready = with_margins(docs.select("doc_id", "text", "source", "lang"))
    cells, used = plan(ready, targets, alpha)
    out = with_probability(ready, cells, used, seed)
    return out.select("doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"), F.col("__share").alias("cell_share"), F.col("__p").alias("probability"), F.col("__selected").alias("selected"))


def sample(docs: DataFrame, targets: Targets | None = None, alpha: float = 0.8, seed: int = 0) -> DataFrame:
    """The selected rows of docs with all their columns, whatever those are called."""
    ready = with_margins(docs.select(C.row_struct(docs).alias("__row"), "doc_id", "text", "source", "lang"))
    cells, used = plan(ready, targets, alpha)
    return with_probability(ready, cells, used, seed).where("__selected").select("__row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(C.table(spark, sf_dir, "documents"))
