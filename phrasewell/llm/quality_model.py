"""Quality classifier as a sparse rule ensemble (operator 5).

1. Statistics of whole texts, all column expressions (see ``quality_rules.metrics``).
2. Boosted shallow trees over the statistics of at most ``SAMPLE`` labelled
   documents; every path from a root to a node is a rule, a conjunction of comparisons.
3. A lasso logistic regression over the rules keeps few and weighs them.
4. The rules compile into one column expression: scoring is a projection, no user function and no shuffle.

Labels are 0 or 1; null labels are ignored, and so are documents with both.
Null text counts as empty and gets a score like any other; very long texts are measured whole.  Ties: equal statistics give equal scores, and
equal gains split on the first statistic.  Other columns pass through, and an existing one of the score's name is replaced.  Without labels
every score is 0.5; with one class only, it is close to that class.  Repeated
rows get equal scores.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import metrics

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 20_000
STATISTICS = ("n_words", "mean_word_chars", "symbols_per_word", "exclaimed_words", "stop_word_ratio", "dup_line_ratio", "longest_word", "repeat_ratio")

#: A rule is a tuple of (statistic, above, threshold): value > threshold if above, else value <= threshold.
Rule = tuple[tuple[str, bool, float], ...]


@dataclass(frozen=True)
class Ensemble:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self, stats: Column) -> Column:
        """Score of a struct of statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for name, above, at in rule:
                holds = holds & ((stats[name] > F.lit(at)) if above else (stats[name] <= F.lit(at)))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def statistics(text: Column) -> Column:
    """Struct of ``STATISTICS`` as doubles."""
    ratio = lambda m: F.when(m["n_words"] > 0, m["n_repeat_words"] / m["n_words"]).otherwise(F.lit(0.0))
    return F.transform(F.array(metrics(text)), lambda m: F.struct(*((ratio(m) if s == "repeat_ratio" else m[s].cast("double")).alias(s) for s in STATISTICS)))[0]


def grow(x: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, hessian: np.ndarray, rows: np.ndarray, depth: int, path: Rule, rules: list[Rule], step: np.ndarray) -> None:
    """Split ``rows`` by the best gain; leaves add their Newton step to ``step``, paths go to ``rules``."""
    g, h = residual[rows].sum(), hessian[rows].sum()
    best = (1e-6, -1, 0.0)
    if depth:
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            b = np.searchsorted(c, x[rows, f])  # values <= c[k] fall in bins up to k
            gl = np.cumsum(np.bincount(b, residual[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, hessian[rows], len(c) + 1))[:-1]
            n = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(n < 5) | (len(rows) - n < 5)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float(c[k]))
    gain, f, at = best
    if f < 0:
        step[rows] += g / (h + 1)
        return
    low = x[rows, f] <= at
    for part, above in ((rows[low], False), (rows[~low], True)):
        p = (*path, (STATISTICS[f], above, at))
        rules.append(p)
        grow(x, cuts, residual, hessian, part, depth - 1, p, rules, step)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float = 0.3, seed: int = 1) -> list[Rule]:
    """Distinct paths of boosted trees, each on a random half of the rows."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 33))) for f in range(x.shape[1])]
    margin, rules = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        rows = np.sort(rng.permutation(len(y))[: max(20, len(y) // 2)])
        found: list[Rule] = []
        grow(x, cuts, y - p, p * (1 - p), rows, depth, (), found, np.zeros(len(y)))
        # The new tree's steps for all rows: each leaf path's rows move by its Newton step.
        for r in found:
            if not any(q[: len(r)] == r and len(q) > len(r) for q in found):
                hit = holds(x, r)
                margin[hit] += rate * (y - p)[hit].sum() / ((p * (1 - p))[hit].sum() + 1)
        rules += found
    return list(dict.fromkeys(simplified(r) for r in rules))


def simplified(rule: Rule) -> Rule:
    """One bound per statistic and side: the tightest."""
    out: dict[tuple[str, bool], float] = {}
    for name, above, at in rule:
        k = (name, above)
        out[k] = at if k not in out else max(at, out[k]) if above else min(at, out[k])
    return tuple((name, above, at) for (name, above), at in sorted(out.items()))


def holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for name, above, at in rule:
        v = x[:, STATISTICS.index(name)]
        ok &= v > at if above else v <= at
    return ok


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 500) -> tuple[float, np.ndarray]:
    """Bias and weights of an L1-penalised logistic regression, by accelerated proximal gradient."""
    n, m = a.shape
    v = np.ones(m) / np.sqrt(max(m, 1))
    for _ in range(20):  # largest squared singular value
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) + 1e-12
    rate = 4 / (np.linalg.norm(a @ v) ** 2 / n + 1)
    w, z, b, c, t = np.zeros(m), np.zeros(m), 0.0, 0.0, 1.0
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(a @ z + c, -30, 30))) - y
        u = z - rate * (a.T @ q) / n
        new, bias = np.sign(u) * np.maximum(np.abs(u) - rate * penalty, 0), c - rate * q.mean()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, c = new + (t - 1) / s * (new - w), bias + (t - 1) / s * (bias - b)
        w, b, t = new, bias, s
    return float(b), w


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, trees: int = 30, depth: int = 3, penalty: float = 1e-3) -> Ensemble:
    """Fit on ``labels (doc_id, label)``: the ``sample`` labelled ids of smallest hash, whatever the tables' size."""
    sane = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most")
    chosen = sane.select(F.col("doc_id").alias("__id"), "label").orderBy(F.xxhash64("__id"), "__id").limit(sample)
    # At most ``sample`` rows of two numbers.
    rows = docs.select(docs[doc_id].alias("__doc"), docs[text].alias("__text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    # The bound holds for rows as well: repeated rows of one id are taken once.
    stats = rows.groupBy("__id", "label").agg(F.min("__text").alias("__text")).select("__id", "label", statistics(F.col("__text")).alias("s")).select("__id", "label", "s.*")
    found = sorted(stats.collect(), key=lambda r: str(r["__id"]))
    if not found:
        return Ensemble(0.0, ())
    x = np.array([[r[s] for s in STATISTICS] for r in found], float)
    y = np.array([r["label"] for r in found], float)
    rules = tree_rules(x, y, trees, depth)
    if not rules:
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return Ensemble(float(np.log(rate / (1 - rate))), ())
    a = np.stack([holds(x, r) for r in rules], axis=1).astype(np.float32)
    bias, w = lasso(a, y, penalty)
    return Ensemble(bias, tuple((r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-6))


def score(docs: DataFrame, model: Ensemble, text: str = "text", as_: str = "score") -> DataFrame:
    """``docs`` with the double column ``as_`` in (0, 1): higher means label 1 is likelier."""
    whole = F.transform(F.array(statistics(docs[text])), lambda s: model.column(s))[0]
    return docs.withColumn(as_, whole)
