"""Quality rules: fixed base rules, then a decision list learnt from labelled statistics.

Learning is sequential covering. Each round splits the rows that no rule covers yet into a growing and a
pruning part, grows a conjunction of thresholds by information gain until it covers rejected rows only,
prunes its last conditions while its precision on the pruning part does not fall, and keeps it if it is
precise enough. The ordered rules become one chain of Spark conditions; what no rule covers is kept.

Statistics, base counts and verdicts are native columns: no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import labelled as L
from . import text_stats as S

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


@dataclass(frozen=True)
class Conjunction:
    """A rule of the list: where all of (statistic, is it above?, threshold) hold, the text is dropped."""

    terms: tuple[tuple[int, bool, float], ...]
    covered: int = 0
    wrong: int = 0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for j, above, t in self.terms:
            out &= (x[:, j] > t) if above else (x[:, j] <= t)
        return out

    def column(self, stats: tuple[str, ...]) -> Column:
        out = F.lit(True)
        for j, above, t in self.terms:
            out = out & (F.col(stats[j]) > t if above else F.col(stats[j]) <= t)
        return out

    def text(self, stats: tuple[str, ...]) -> str:
        return " and ".join(f"{stats[j]} {'>' if above else '<='} {t:.6g}" for j, above, t in self.terms)


def _condition(x: np.ndarray, bad: np.ndarray, on: np.ndarray, bins: int) -> tuple[int, bool, float] | None:
    """The threshold with the largest information gain among the rows that the rule still covers."""
    p0, n0 = (on & bad).sum(), (on & ~bad).sum()
    if not p0 or not n0:
        return None
    before, best, found = np.log2(p0 / (p0 + n0)), 1e-9, None
    for j in range(x.shape[1]):
        values = np.unique(np.quantile(x[on, j], np.linspace(0, 1, bins + 1), method="nearest"))
        cuts = (values[1:] + values[:-1]) / 2
        if not len(cuts):
            continue
        at = np.searchsorted(cuts, x[on, j], side="left")
        pos = np.cumsum(np.bincount(at, bad[on], len(cuts) + 1))[:-1]
        neg = np.cumsum(np.bincount(at, ~bad[on], len(cuts) + 1))[:-1]
        for above, p, n in ((False, pos, neg), (True, p0 - pos, n0 - neg)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - before), -1)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = gain[k], (j, above, float(cuts[k]))
    return found


def learn(x: np.ndarray, y: np.ndarray, max_rules: int = 16, max_terms: int = 4, bins: int = 64, least: int = 5, precision: float = 0.97, seed: int = 11) -> list[Conjunction]:
    """The ordered rules for rejection (label 0). Without labels of both kinds, none."""
    draw, bad, rules = np.random.default_rng(seed), y < 0.5, []
    left = np.ones(len(y), dtype=bool)
    while len(rules) < max_rules and (left & bad).sum() >= least:
        grow = left & (draw.random(len(y)) < 2 / 3)
        prune = left & ~grow
        terms: list[tuple[int, bool, float]] = []
        on = grow.copy()
        while len(terms) < max_terms and (term := _condition(x, bad, on, bins)) is not None:
            terms.append(term)
            on &= Conjunction((term,)).holds(x)
        best, worth = None, -1.0
        for k in range(len(terms), 0, -1):
            hit = Conjunction(tuple(terms[:k])).holds(x)
            p, n = (prune & hit & bad).sum(), (prune & hit & ~bad).sum()
            value = (p + 1) / (p + n + 2)
            if value >= worth:
                best, worth = tuple(terms[:k]), value
        if best is None:
            break
        hit = Conjunction(best).holds(x) & left
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        if p < least or p / (p + n) < precision:
            break
        rules.append(Conjunction(best, p + n, n))
        left &= ~hit
    return rules


def verdict(rules: list[Conjunction], stats: tuple[str, ...] = S.STATS) -> Column:
    """True where the list keeps a text."""
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].column(stats), False)
    for rule in rules[1:]:
        out = out.when(rule.column(stats), False)
    return out.otherwise(True)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = L.MAX_ROWS) -> list[Conjunction]:
    return learn(*L.sample(docs, labels, "quality", max_rows))


def apply_rules(docs: DataFrame, rules: list[Conjunction]) -> DataFrame:
    """One row per input row. Null and empty texts have no words, so they fail the base rules."""
    base = S.with_lines(S.with_repeats(S.with_words(docs.select("doc_id", "text"))))
    base = base.withColumn("word_chars", F.col("__chars")).withColumn("n_symbols", C.count_chars(F.col("__text"), C.SYMBOLS))
    base = base.withColumn("n_dup_lines", (F.size("__lines") - F.col("__own_lines")).cast("long"))
    full = S.with_stats(base).withColumn("__n", F.size("__words").cast("long"))
    failed = (F.col("__n") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__n"))
    full = full.withColumn("base_failed", failed)
    return full.select("doc_id", F.col("__n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.when(F.col("base_failed"), False).otherwise(verdict(rules)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return apply_rules(docs, train(docs, C.table(spark, sf_dir, "labels")))
