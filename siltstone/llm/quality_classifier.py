"""Quality classifier: a sparse rule ensemble (after Friedman and Popescu's RuleFit).

1. Gradient-boosted trees of small depth are grown on statistics of labelled texts.
2. Every path from a root to a node becomes a rule, a conjunction of thresholds.
3. A logistic regression with a lasso penalty weighs the rules; most weights become exactly zero.
4. The rules that are left are compiled into one Spark column expression, so scoring all texts runs no Python.

The driver fits on a bounded sample (``labelled.MAX_ROWS`` rows of numbers, not texts). The intercept is
then moved so that the cut of a score, ``CUT``, falls in the middle of the gap between the labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import labelled as L
from . import text_stats as S

CUT = 0.7


@dataclass(frozen=True)
class Rule:
    """All of (statistic, is it above?, threshold) hold."""

    terms: tuple[tuple[int, bool, float], ...]

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


@dataclass(frozen=True)
class Model:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float
    stats: tuple[str, ...] = S.STATS

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            out += w * rule.holds(x)
        return out

    def score(self) -> Column:
        margin = F.lit(float(self.intercept))
        for rule, w in zip(self.rules, self.weights, strict=True):
            margin = margin + F.when(rule.column(self.stats), F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def _thresholds(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Cut points of each statistic: midpoints between neighbouring quantiles."""
    cuts = []
    for j in range(x.shape[1]):
        values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1), method="nearest"))
        cuts.append((values[1:] + values[:-1]) / 2)
    return cuts


def _best_split(binned: np.ndarray, rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], least: int) -> tuple[int, int] | None:
    best, found = 1e-6, None
    g, h = grad[rows], hess[rows]
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for j, c in enumerate(cuts):
        if not len(c):
            continue
        at = binned[rows, j]
        left_n = np.cumsum(np.bincount(at, minlength=len(c) + 1))[:-1]
        gl, hl = np.cumsum(np.bincount(at, g, len(c) + 1))[:-1], np.cumsum(np.bincount(at, h, len(c) + 1))[:-1]
        gain = gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - whole
        gain[(left_n < least) | (len(rows) - left_n < least)] = -1
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, found = gain[k], (j, k)
    return found


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float, bins: int, least: int, seed: int) -> list[Rule]:
    """Boosts small trees on row subsamples and returns every node's path, each once."""
    cuts = _thresholds(x, bins)
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    draw, rules = np.random.default_rng(seed), {}
    margin = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        start = np.flatnonzero(draw.random(len(y)) < 0.5)
        stack = [(start, np.arange(len(y)), (), 0)]
        while stack:
            own, every, terms, level = stack.pop()
            split = _best_split(binned, own, grad, hess, cuts, least) if level < depth and len(own) >= 2 * least else None
            if split is None:
                margin[every] += rate * grad[own].sum() / (hess[own].sum() + 1.0)
                continue
            j, k = split
            for above in (False, True):
                side = lambda rows, a=above: rows[(binned[rows, j] > k) == a]
                path = (*terms, (j, above, float(cuts[j][k])))
                rules.setdefault(path, Rule(path))
                stack.append((side(own), side(every), path, level + 1))
    return list(rules.values())


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient descent; the intercept is not penalised."""
    n, k = z.shape
    step = 4.0 / (np.linalg.norm(np.column_stack([z, np.ones(n)]), 2) ** 2 / n)
    w, b = np.zeros(k), 0.0
    vw, vb, t = w, b, 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-np.clip(z @ vw + vb, -40, 40))) - y
        nw = vw - step * (z.T @ error) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = vb - step * error.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def fit(x: np.ndarray, y: np.ndarray, stats: tuple[str, ...] = S.STATS, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 10, penalty: float = 0.002, max_rules: int = 400, seed: int = 7) -> Model:
    """With fewer than two labels of either kind nothing can be learnt: the score is then the share of label 1, smoothed."""
    if len(y) < 4 or min(y.sum(), len(y) - y.sum()) < 2:
        share = (y.sum() + 1) / (len(y) + 1.2) if len(y) else 0.75
        return Model((), (), float(np.log(share / (1 - share))), stats)
    least = max(2, min(least, int(min(y.sum(), len(y) - y.sum()) // 4)))
    rules = grow_rules(x, y, trees, depth, rate, bins, least, seed)
    z = np.column_stack([r.holds(x) for r in rules]).astype(float) if rules else np.zeros((len(y), 0))
    _, first = np.unique(z, axis=1, return_index=True)  # rules that hold for the same rows count once
    keep = np.sort(first)[:max_rules]
    scale = np.maximum(z[:, keep].std(axis=0), 1e-3)
    w, b = lasso_logistic(z[:, keep] / scale, y, penalty)
    w = w / scale
    model = Model(tuple(rules[i] for i, v in zip(keep, w, strict=True) if v), tuple(float(v) for v in w if v), float(b), stats)
    return Model(model.rules, model.weights, model.intercept + _shift(model.margin(x), y), stats)


def _shift(margin: np.ndarray, y: np.ndarray) -> float:
    """What moves the cut with the fewest errors, weighted so that both labels count alike, to CUT; of equal cuts, the middle."""
    order = np.argsort(margin, kind="stable")
    m, t = margin[order], y[order]
    bad = np.concatenate([[0.0], np.cumsum(t)]) / max(t.sum(), 1) + np.concatenate([[0.0], np.cumsum(1 - t)])[::-1][0] / max((1 - t).sum(), 1) - np.concatenate([[0.0], np.cumsum(1 - t)]) / max((1 - t).sum(), 1)
    edges = np.concatenate([[m[0] - 1], (m[1:] + m[:-1]) / 2, [m[-1] + 1]])
    possible = np.concatenate([[True], m[1:] > m[:-1], [True]])
    best = bad[possible].min()
    cuts = edges[possible & (bad <= best + 1e-12)]
    return float(np.log(CUT / (1 - CUT)) - cuts[len(cuts) // 2])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per input row. Null texts score as empty ones."""
    scored = S.with_stats(S.with_words(docs.select("doc_id", "text"))).withColumn("score", model.score())
    return scored.select("doc_id", L.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = L.MAX_ROWS) -> Model:
    return fit(*L.sample(docs, labels, "quality", max_rows))


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, C.table(spark, sf_dir, "labels")))


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that the classifier does not reject, with all their columns, whatever those are called.

    Null and empty texts are scored like any other; an empty table gives no rows; equal rows stay or go together.
    """
    model = train(docs, C.table(spark, sf_dir, "labels"))
    apart = docs.select(C.row_struct(docs).alias("__row"), F.col("text"))  # statistics may share names with the caller's columns
    # Generated, not projected: a filter on a projected score is pushed down and computes every statistic again for each rule.
    scored = S.with_stats(S.with_words(apart)).select("__row", F.explode(F.array(model.score())).alias("__score"))
    return scored.where(F.col("__score") >= CUT).select("__row.*")
