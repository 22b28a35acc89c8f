"""Quality classifier: a sparse rule ensemble over text statistics.

Shallow regression trees are boosted on labelled documents; every path from a root to a node is a conjunctive rule over the statistics; a lasso
logistic regression weighs the rules and drops most of them; the rest is compiled into one Spark column expression over the statistics' columns.

Training reads at most `max_rows` labelled documents, drawn by a hash of the id; scoring reads all. Statistics are of the text alone.

Null and empty texts have statistics of 0 and get the score that the rules give to those. Null ids or labels are not learnt from. Without both classes
the score is the constant share of label 1 (0.5 without any label). Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import map_texts
from .toxicity import held_out, training_rows

__all__ = ["Model", "Rule", "compile_rules", "held_out", "score", "statistics", "train"]

STATS = (
    "log_words", "mean_word", "long_words", "upper", "digits", "symbols", "bangs", "pipes", "odd_endings", "odd_words", "distinct_words",
    "top_word", "repeats", "longest_run", "lines", "mean_line", "copied_lines", "worst_line_odd", "worst_line_upper", "worst_line_repeats", "top_byte", "spaces",
)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(97, 123), *range(65, 91), *range(48, 58), *range(128, 256), 32, 10, 44, 46]] = True
_EDGE = b".,;:!?"


def statistics(t: bytes) -> list[float]:
    n = len(t)
    words = t.split()
    if not words:
        return [0.0] * len(STATS)
    m = len(words)
    count = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
    letters = max(1, int(count[97:123].sum() + count[65:91].sum() + count[128:].sum()))
    own = Counter(words)
    odd_word = lambda w: not w.rstrip(_EDGE).isalnum() and any(b < 48 or 57 < b < 65 or 90 < b < 97 or 122 < b < 128 for b in w.rstrip(_EDGE))
    odd = {w: odd_word(w) for w in own}
    run = longest = 1
    repeats = 0
    for a, b in zip(words, words[1:]):  # noqa: B905, RUF007
        if a == b:
            repeats += 1
            run += 1
            longest = max(longest, run)
        else:
            run = 1
    lines = [x for x in t.split(b"\n") if x.strip()]
    worst_odd = worst_upper = worst_rep = 0.0
    for line in lines:
        ws = line.split()
        k = len(ws)
        if k >= 4:
            worst_odd = max(worst_odd, sum(odd[w] for w in ws) / k)
            worst_upper = max(worst_upper, sum(w.isupper() for w in ws) / k)
            worst_rep = max(worst_rep, 1 - len(set(ws)) / k if k >= 8 else 0.0)
    return [
        math.log1p(m), sum(map(len, words)) / m, sum(len(w) > 15 for w in words) / m, int(count[_UPPER].sum()) / letters, int(count[_DIGIT].sum()) / n,
        int(count[~_PLAIN].sum()) / n, int(count[33]) / m, int(count[124]) / m, sum(w[-1] < 48 and w[-1] not in _EDGE for w in words) / m, sum(c for w, c in own.items() if odd[w]) / m, len(own) / m,
        max(own.values()) / m, repeats / m, float(longest), float(len(lines)), m / len(lines), 1 - len(set(lines)) / len(lines), worst_odd, worst_upper, worst_rep,
        int(np.delete(count, [32, 10]).max()) / n, int(count[32] + count[9] + count[10]) / n,
    ]


SCHEMA = ", ".join(f"{s} double" for s in STATS)


def _stat_columns(texts: list[bytes]) -> dict[str, list]:
    return dict(zip(STATS, map(list, zip(*map(statistics, texts), strict=True)), strict=True))


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, at most, threshold) that all hold."""

    conditions: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for j, below, at in self.conditions:
            out &= (x[:, j] <= at) == below
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for j, below, at in self.conditions:
            out = out & ((F.col(STATS[j]) <= at) if below else (F.col(STATS[j]) > at))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{STATS[j]} {'<=' if below else '>'} {at:.4g}" for j, below, at in self.conditions)


@dataclass
class Model:
    bias: float
    rules: list[tuple[float, Rule]]


def _cuts(x: np.ndarray, most: int = 24) -> list[np.ndarray]:
    out = []
    for j in range(x.shape[1]):
        v = np.unique(x[:, j])
        mid = (v[1:] + v[:-1]) / 2
        out.append(mid if len(mid) <= most else np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, most))))
    return out


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, path: tuple, depth: int, least: int, out: list[Rule], fitted: np.ndarray, rate: float) -> None:
    """Grows a tree on gradients g and curvatures h; adds its nodes' rules to out and its leaves' steps to fitted."""
    best, where = 1e-6, None
    if depth:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        base = total_g**2 / (total_h + 1)
        for j, at in enumerate(cuts):
            if not len(at):
                continue
            slot = np.searchsorted(at, x[rows, j], "left")  # x <= at[k] iff slot <= k
            a = np.cumsum(np.bincount(slot, g[rows], len(at) + 1))[:-1]
            b = np.cumsum(np.bincount(slot, h[rows], len(at) + 1))[:-1]
            n = np.cumsum(np.bincount(slot, minlength=len(at) + 1))[:-1]
            gain = np.where((n >= least) & (len(rows) - n >= least), a**2 / (b + 1) + (total_g - a) ** 2 / (total_h - b + 1) - base, 0)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, where = gain[k], (j, float(at[k]))
    if where is None:
        fitted[rows] += rate * g[rows].sum() / (h[rows].sum() + 1)
        return
    j, at = where
    for below in (True, False):
        side = rows[(x[rows, j] <= at) == below]
        more = (*path, (j, below, at))
        out.append(Rule(more))
        _tree(x, g, h, cuts, side, more, depth - 1, least, out, fitted, rate)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 3, rate: float = 0.3) -> list[Rule]:
    """Distinct rules of boosted trees of logistic loss."""
    f, out, cuts = np.zeros(len(y)), [], _cuts(x)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        _tree(x, y - p, p * (1 - p), cuts, np.arange(len(y)), (), depth, max(3, len(y) // 500), out, f, rate)
    return list(dict.fromkeys(out))


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 1500) -> tuple[float, np.ndarray]:
    """Bias and weights of least mean logistic loss + penalty * sum |w| (accelerated proximal gradient)."""
    n, k = z.shape
    one = np.hstack([np.ones((n, 1)), z])
    rate = 4.0 / max(np.linalg.norm(one, 2) ** 2 / n, 1e-9)
    w = prev = np.zeros(k + 1)
    for t in range(1, steps + 1):
        v = w + (t - 1) / (t + 2) * (w - prev)
        g = one.T @ (1 / (1 + np.exp(-(one @ v))) - y) / n
        nxt = v - rate * g
        nxt[1:] = np.sign(nxt[1:]) * np.maximum(np.abs(nxt[1:]) - rate * penalty, 0)
        prev, w = w, nxt
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 2e-3) -> Model:
    if not len(y):
        return Model(0.0, [])
    share = float(y.mean())
    if share in (0.0, 1.0):
        return Model(math.inf if share else -math.inf, [])
    rules = tree_rules(x, y)
    held = np.stack([r.holds(x) for r in rules], axis=1)
    _, first = np.unique(held, axis=1, return_index=True)  # rules that hold for the same rows count once
    rules = [rules[i] for i in sorted(first)]
    rules = [r for r in rules if 0 < r.holds(x).mean() < 1]
    z = np.stack([r.holds(x) for r in rules], axis=1).astype(float)
    b, w = lasso_logistic(z, y, penalty)
    return Model(b, [(float(v), r) for v, r in zip(w, rules, strict=True) if abs(v) > 1e-3])


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", folds: int = 4, fold: int = 2, max_rows: int = 12_000) -> Model:
    rows = training_rows(docs, labels, target, folds, fold, max_rows)
    got = np.array(sorted(map(tuple, map_texts(rows, _stat_columns, SCHEMA, "y", "text", "y").collect())), float).reshape(-1, len(STATS) + 1)  # one row a document, at most max_rows
    return fit(got[:, 1:], got[:, 0])


def compile_rules(model: Model) -> Column:
    """The score as an expression over the statistics' columns."""
    z = F.lit(model.bias)
    for w, r in model.rules:
        z = z + F.when(r.column(), F.lit(w)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the statistics and the score."""
    return map_texts(docs, _stat_columns, SCHEMA, id_col, text_col).withColumn("score", compile_rules(model))
