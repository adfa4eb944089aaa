"""Quality classifier: a sparse rule ensemble (operator 4).

Statistics of a text (STATISTICS) are Spark column expressions over the whole text. Small trees are boosted on the
statistics of labelled documents; every path from a root becomes a rule, a conjunction of comparisons. A lasso fits
logistic weights to the rules, its penalty chosen on a fifth of the sample that is left out of the fit; rules with weight 0
go. What remains is compiled into one column expression: scoring is a projection, without Python, join or shuffle.

Learning takes at most about `fit_rows` labelled documents (those whose hash of the id is below a threshold set from the
count of labels; the bound is a parameter), whose statistics alone come to the driver. Repeated labels of an id count as
the larger one, and rows that agree in id and statistics are learned from once. Null texts count as empty. With no labels, or one class only, the score is the share of label 1, or 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table


def statistics(text: Column) -> dict[str, Column]:
    """Name and expression of each statistic; all are doubles and finite, for an empty text too."""
    t = F.coalesce(text, F.lit(""))
    words, chars = F.regexp_count(t, F.lit(r"\S+")), F.length(t)
    per_word = lambda pattern: F.regexp_count(t, F.lit(pattern)) / F.greatest(words, F.lit(1))
    return {
        "words": F.log1p(words.cast("double")),
        "word_length": (chars - F.regexp_count(t, F.lit(r"\s"))) / F.greatest(words, F.lit(1)),
        "symbols": per_word(r"[^\p{L}\p{N}\s.,;:!?'\"()-]"),
        "marks": per_word(r"[.,;:!?]"),
        "shouts": per_word("!"),
        "capitals": per_word(r"\p{Lu}"),
        "digits": per_word("[0-9]"),
        "lines": per_word("\n"),
        "distinct": F.size(F.array_distinct(F.split(t, r"\s+"))) / F.greatest(words, F.lit(1)),
    }


@dataclass(frozen=True)
class Rule:
    """All of (statistic, below, bound): the statistic is at most the bound if below, else above it."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self, stats: dict[str, Column]) -> Column:
        out = None
        for name, below, bound in self.terms:
            one = stats[name] <= bound if below else stats[name] > bound
            out = one if out is None else out & one
        return out

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        out = None
        for name, below, bound in self.terms:
            one = values[name] <= bound if below else values[name] > bound
            out = one if out is None else out & one
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, stats: dict[str, Column]) -> Column:
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            z = z + F.when(rule.column(stats), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _grow(binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, bins: int, least: int, path: tuple, out: list) -> None:
    """Splits rows by the best gain; out gets (path, rows, step) of the leaves, path being (feature, below, bin)."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, None)
    if depth and len(rows) >= 2 * least:
        for f in range(binned.shape[1]):
            b = binned[rows, f]
            cg = np.cumsum(np.bincount(b, weights=grad[rows], minlength=bins))[:-1]
            ch = np.cumsum(np.bincount(b, weights=hess[rows], minlength=bins))[:-1]
            cn = np.cumsum(np.bincount(b, minlength=bins))[:-1]
            gain = cg**2 / (ch + 1) + (g - cg) ** 2 / (h - ch + 1) - g**2 / (h + 1)
            gain[(cn < least) | (len(rows) - cn < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, k))
    if best[1] is None:
        out.append((path, rows, -g / (h + 1)))
        return
    f, k = best[1]
    low = binned[rows, f] <= k
    _grow(binned, grad, hess, rows[low], depth - 1, bins, least, (*path, (f, True, k)), out)
    _grow(binned, grad, hess, rows[~low], depth - 1, bins, least, (*path, (f, False, k)), out)


def tree_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 40, depth: int = 3, bins: int = 48, least: int = 10) -> list[Rule]:
    """Boosts small trees on the logistic loss and takes each path, and each beginning of one, as a rule."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    z = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    seen: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        leaves: list = []
        _grow(binned, p - y, p * (1 - p), np.arange(len(y)), depth, bins, least, (), leaves)
        for path, rows, step in leaves:
            z[rows] += 0.3 * step
            for k in range(1, len(path) + 1):
                bound: dict[tuple[int, bool], float] = {}
                for f, below, b in path[:k]:
                    e = float(edges[f][b])
                    bound[f, below] = e if (f, below) not in bound else (min if below else max)(bound[f, below], e)
                seen[Rule(tuple(sorted((names[f], below, e) for (f, below), e in bound.items())))] = None
    return list(seen)


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray | None = None, steps: int = 300) -> np.ndarray:
    """Logistic weights with an L1 penalty by accelerated proximal gradients; the last weight is the free intercept."""
    n, m = a.shape
    a = np.column_stack([a, np.ones(n, np.float32)])
    v = np.ones(m + 1, np.float32)
    for _ in range(15):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / float(np.linalg.norm(a @ v)) ** 2 * 0.95
    w = np.zeros(m + 1) if start is None else start.copy()
    u, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a @ u.astype(np.float32)).astype(np.float64)))
        new = u - step * (a.T @ (p - y).astype(np.float32)).astype(np.float64) / n
        new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


def fit(values: dict[str, np.ndarray], y: np.ndarray, penalties=(0.03, 0.01, 0.003, 0.001, 0.0003)) -> RuleEnsemble:
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return RuleEnsemble(float(np.log(share / (1 - share))), ())
    names = sorted(values)
    x, y = np.stack([values[n] for n in names], axis=1).astype(np.float64), y.astype(np.float64)
    test = np.arange(len(y)) % 5 == 4
    if y[~test].min() == y[~test].max():
        test[:] = False
    rules = tree_rules(x[~test], y[~test], names)
    if not rules:
        return RuleEnsemble(float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), ())
    a = np.stack([r.holds(values) for r in rules], axis=1).astype(np.float32)
    best, w = None, None
    for penalty in penalties:
        w = lasso(a[~test], y[~test], penalty, w)
        at = test if test.any() else ~test
        z = a[at] @ w[:-1] + w[-1]
        loss = float(np.mean(np.logaddexp(0, -z * (2 * y[at] - 1))))
        if best is None or loss < best[0] - 1e-4:
            best = (loss, w)
    w = best[1]
    return RuleEnsemble(float(w[-1]), tuple((r, float(v)) for r, v in zip(rules, w[:-1], strict=True) if abs(v) > 1e-6))


def learn(docs: DataFrame, labels: DataFrame, label: str, fit_rows: int = 12_000, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> RuleEnsemble:
    labels = labels.where(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).alias("_y"))
    n = labels.count()
    chance = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_id"), 11).cast("double") + 0.5) / float(1 << 53)
    labels = labels.where(chance < min(1.0, fit_rows / max(1, n)))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(labels), "_id")
    stats = statistics(F.col("_t"))
    got = rows.select(F.xxhash64(F.lit(seed + 1), "_id").alias("_o"), F.col("_y").cast("double"), *[v.cast("double").alias(k) for k, v in stats.items()]).distinct().toPandas()
    got = got.sort_values(["_o", *stats], kind="stable")
    return fit({k: got[k].to_numpy() for k in stats}, got["_y"].to_numpy())


def score(docs: DataFrame, model: RuleEnsemble, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """docs with the score added. The statistics are computed once a row, in a projection of their own."""
    stats = {f"_stat_{k}": v.cast("double") for k, v in statistics(F.col(text_col)).items()}
    out = docs.withColumns(stats)
    return out.withColumn(score_col, model.score({k: F.col(f"_stat_{k}") for k in statistics(F.lit(""))})).drop(*stats)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = learn(docs, labels.where(~held_out("doc_id", 5, 0)), "quality")
    out = score(docs, model, score_col="score")
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
