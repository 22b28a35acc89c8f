"""Toxicity by multiple-instance learning.

A document is a bag of sentences; a sentence's score is logistic in its features, and the document's is the noisy-or
1 - prod(1 - p). Only documents have labels; the sentence weights are fitted through the noisy-or, and the sentences of high score are the offending ones.

Features are words and their beginnings of 3 to 6 letters. Those that tell toxic documents apart (a G-test over the training rows, positive
association) are kept, at most `max_features`. Training reads at most `max_rows` labelled documents, drawn by a hash of the id, whole; it fits on at most
`max_sentences` sentences with features of each (the others count as without). Scoring reads all sentences of all documents.

Null and empty texts have no sentences and score 0. Null ids or labels are not learnt from; repeated labels of one id count once (the larger). Without
both classes every weight is 0. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import map_texts

SENTENCE = re.compile(r"[^.!?\n]+")
EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
CACHE = 400_000


def stems(word: str) -> list[str]:
    w = EDGE.sub("", word)
    return [w[:k] + "*" for k in range(3, min(6, len(w)) + 1)] + [w] if len(w) >= 3 else []


@dataclass
class Model:
    bias: float
    weights: dict[str, float]


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % folds == fold, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, target: str, folds: int, fold: int, max_rows: int) -> DataFrame:
    """text and y of at most max_rows labelled documents outside the held-out fold: the least by a hash of the id, one row each.

    The ids are bounded by max_rows, so they are broadcast and the texts stay where they are. Of rows that share an id the text of the
    least hash counts, null as empty.
    """
    y = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    y = y.groupBy("doc_id").agg(F.max(target).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.struct(F.xxhash64(text).alias("h"), text.alias("text")).alias("t")).join(F.broadcast(y), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min("t").alias("t")).select("t.text", "y")


def _document_features(texts: list[bytes]) -> dict[str, list]:
    """One row a text: its distinct features."""
    out = []
    for t in texts:
        words = set(t.decode("utf-8", "replace").lower().split())
        out.append(sorted({f for w in words for f in stems(w)}))
    return {"features": out}


def select_features(rows: DataFrame, max_features: int, least: int = 3) -> list[str]:
    """Features whose documents are toxic more often than others, the largest G statistics first."""
    counted = map_texts(rows.withColumn("_y", F.col("y").cast("int")), _document_features, "features array<string>", "_y", "text", "y")
    by = counted.select("y", F.explode("features").alias("f")).groupBy("f").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    total = rows.agg(F.sum("y").alias("p"), F.count("*").alias("n")).first()
    p, n = total["p"] or 0, total["n"]
    if not p or p == n:
        return []
    expected = F.col("n") * F.lit(p / n)
    g = F.col("pos") * F.ln(F.col("pos") / expected) + F.when(F.col("n") > F.col("pos"), (F.col("n") - F.col("pos")) * F.ln((F.col("n") - F.col("pos")) / (F.col("n") - expected))).otherwise(0.0)
    best = by.where((F.col("pos") >= least) & (F.col("pos") > 1.5 * expected)).select("f", g.alias("g")).where("g > 6").orderBy(F.desc("g"), "f").limit(max_features)
    return [r["f"] for r in best.collect()]


def _bags(texts: list[bytes], index: dict[str, int], most: int) -> dict[str, list]:
    """For each text: how many sentences it has, and the features of those that have any; of the `most` with most features, where more have."""
    sizes, bags = [], []
    for t in texts:
        n, found = 0, []
        for m in SENTENCE.finditer(t.decode("utf-8", "replace").lower()):
            words = m[0].split()
            if words:
                n += 1
                got = sorted({index[f] for w in set(words) for f in stems(w) if f in index})
                if got:
                    found.append(got)
        sizes.append(n)
        bags.append(found if len(found) <= most else sorted(found, key=lambda f: (-len(f), f))[:most])
    return {"sentences": sizes, "bags": bags}


def fit_noisy_or(y: np.ndarray, sentences: np.ndarray, bags: list[list[list[int]]], n_features: int, l2: float = 2e-3, steps: int = 600) -> tuple[float, np.ndarray]:
    """Bias and weights of least negative log likelihood of the documents' labels (Adam, weights kept from going below 0)."""
    doc = np.array([d for d, b in enumerate(bags) for _ in b], np.int64)
    flat = [(s, f) for s, x in enumerate(x for b in bags for x in b) for f in x]
    row = np.array([s for s, _ in flat], np.int64)
    col = np.array([f for _, f in flat], np.int64)
    empty = sentences - np.bincount(doc, minlength=len(y))
    n_rows = len(doc)
    theta = np.zeros(n_features + 1)
    theta[0] = -6.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        b, w = theta[0], theta[1:]
        z = b + np.bincount(row, w[col], n_rows)
        soft = np.logaddexp(0, z)
        s = np.bincount(doc, soft, len(y)) + empty * np.logaddexp(0, b)
        slope = np.where(y == 1, -1.0 / np.expm1(np.maximum(s, 1e-9)), 1.0)
        at = slope[doc] / (1 + np.exp(-z))
        g = np.empty_like(theta)
        g[0] = at.sum() + (slope * empty).sum() / (1 + np.exp(-b))
        g[1:] = np.bincount(col, at[row], n_features)
        g /= len(y)
        g[1:] += l2 * w / 100
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        theta[1:] = np.maximum(theta[1:], 0)
        theta[0] = min(theta[0], -4.0)
    return float(theta[0]), theta[1:]


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", folds: int = 5, fold: int = 0, max_rows: int = 10_000, max_features: int = 1_500, max_sentences: int = 256) -> Model:
    """The driver holds at most max_rows x max_sentences sentences, of at most max_features features each."""
    rows = training_rows(docs, labels, target, folds, fold, max_rows)
    names = select_features(rows, max_features)
    if not names:
        return Model(-12.0, {})
    index = {f: i for i, f in enumerate(names)}
    got = map_texts(rows, lambda texts: _bags(texts, index, max_sentences), "sentences long, bags array<array<int>>", "y", "text", "y").collect()  # one row a document, at most max_rows
    got = sorted(got, key=lambda r: (r["y"], r["sentences"], r["bags"]))
    b, w = fit_noisy_or(np.array([r["y"] for r in got]), np.array([r["sentences"] for r in got], float), [r["bags"] for r in got], len(names))
    return Model(b, {f: float(x) for f, x in zip(names, w, strict=True) if x > 1e-3})


def score_text(text: str, model: Model, seen: dict[str, float]) -> tuple[float, list[tuple[int, int, float]]]:
    """The document's score and its sentences (from, to, score) that score 0.5 or more. seen: word -> weight, filled here.

    A sentence counts each distinct feature once, as in training.
    """
    plain, log_clean, offending = 0, 0.0, []
    low = text.lower()
    if len(low) != len(text):  # some letters have a longer small form: keep offsets
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    weights = model.weights
    for m in SENTENCE.finditer(low):
        words = m[0].split()
        if not words:
            continue
        hot = []
        for w in words:
            x = seen.get(w)
            if x is None:
                if len(seen) > CACHE:
                    seen.clear()
                x = seen[w] = any(f in weights for f in stems(w))
            if x:
                hot.append(w)
        if not hot:
            plain += 1
            continue
        z = model.bias + sum(weights[f] for f in {f for w in hot for f in stems(w)} if f in weights)
        log_clean -= math.log1p(math.exp(-abs(z))) + max(z, 0.0)
        p = 1 / (1 + math.exp(-z)) if z > -700 else 0.0
        if p >= 0.5:
            offending.append((m.start(), m.end(), p))
    log_clean -= plain * math.log1p(math.exp(model.bias))
    return -math.expm1(log_clean), offending


COLUMNS = "score double, sentences array<struct<from:int,to:int,score:double>>"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and the offending sentences."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most max_features weights
    seen: dict[str, float] = {}

    def run(texts: list[bytes]) -> dict[str, list]:
        got = [score_text(t.decode("utf-8", "replace"), shared.value, seen) for t in texts]
        return {"score": [max(0.0, s) for s, _ in got], "sentences": [[{"from": a, "to": b, "score": p} for a, b, p in o] for _, o in got]}

    return map_texts(docs, run, COLUMNS, id_col, text_col)
