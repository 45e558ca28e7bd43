"""Quality by a sparse rule ensemble.

Boosted trees over text statistics give conjunctive rules, a lasso logistic regression keeps few of them, and those
are compiled into one Spark column expression: 1 / (1 + exp(-(b + sum of weights of rules that hold))).

Statistics come from whole texts (null counts as empty). Training reads a bounded sample of labelled rows; scoring is
one pass without a shuffle. Without labels of both kinds every score is near the known label, or 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan
from .common import bounded_sample, crc_mod, fresh, table
from .trees import bin_columns, fit_tree

#: Names of the statistics, in the order of text_statistics.
STATISTICS = ("log_words", "word_bytes", "upper_share", "digit_share", "symbol_share", "mark_share", "wide_share", "distinct_words", "top_word", "same_as_last", "distinct_lines", "line_words", "long_word", "space_share")

_KIND = np.zeros(256, np.uint8)
_KIND[48:58] = 1
_KIND[65:91] = 2
_KIND[97:123] = 3
_KIND[[35, 36, 37, 38, 42, 60, 62, 124]] = 4
_KIND[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63, 91, 93, 95]] = 5
_KIND[128:] = 6
_KIND[[9, 10, 11, 12, 13, 32]] = 7


@dataclass(frozen=True)
class QualityParams:
    """train_rows bounds the labelled rows that training reads."""

    train_rows: int = 12_000
    trees: int = 40
    depth: int = 3
    share: float = 0.5
    penalty: float = 0.002
    steps: int = 250
    seed: int = 11


def text_statistics(column: pa.Array) -> np.ndarray:
    """(rows, statistics) of a string column."""
    data, offsets = bytescan.buffers(column)
    out = np.zeros((len(offsets) - 1, len(STATISTICS)))
    for a, b in bytescan.slices(offsets):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        hashes, starts, ends, rows = bytescan.words(part, own, lower=False)
        size = ends - starts
        in_line = part != 10
        ls, le, lrows = bytescan.spans(in_line, own)
        lines = bytescan.hash_spans(part, in_line, ls, le, lower=False)
        kinds = _KIND[part]
        words = np.searchsorted(rows, np.arange(b - a + 1))
        line_at = np.searchsorted(lrows, np.arange(b - a + 1))
        for r in range(b - a):
            w = hashes[words[r] : words[r + 1]]
            if not len(w):
                continue
            n, bytes_ = len(w), own[r + 1] - own[r]
            share = np.bincount(kinds[own[r] : own[r + 1]], minlength=8) / bytes_
            _, counts = np.unique(w, return_counts=True)
            found = lines[line_at[r] : line_at[r + 1]]
            sizes = size[words[r] : words[r + 1]]
            out[a + r] = (
                np.log1p(n), sizes.mean(), share[2], share[1], share[4], share[5], share[6], len(counts) / n, counts.max() / n,
                (w[1:] == w[:-1]).mean() if n > 1 else 0.0, len(np.unique(found)) / max(1, len(found)), n / max(1, len(found)), np.log1p(sizes.max()), share[7],
            )
    return out


def with_statistics(docs: DataFrame, text: str = "text", prefix: str = "stat_") -> DataFrame:
    """docs with one double column per statistic, in place of any columns of those names."""
    names = [prefix + s for s in STATISTICS]
    keep = [c for c in docs.columns if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = text_statistics(batch.column(text))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(found[:, j]) for j in range(len(names)))], [*keep, *names])

    schema = docs.select(*keep).schema
    for name in names:
        schema = schema.add(name, "double")
    return docs.select(*keep).mapInArrow(run, schema)


Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class RuleEnsemble:
    base: float
    rules: list[tuple[Rule, float]]

    def column(self, prefix: str = "stat_") -> Column:
        """The score as a column expression over the statistics."""
        names = [prefix + s for s in STATISTICS]
        total = F.lit(self.base)
        for rule, weight in self.rules:
            holds = [(F.col(names[j]) <= cut) if low else (F.col(names[j]) > cut) for j, low, cut in rule]
            total = total + F.when(reduce(lambda x, y: x & y, holds), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for rule, weight in self.rules:
            z += weight * holds(rule, x)
        return 1 / (1 + np.exp(-z))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, low, cut in rule:
        out &= (x[:, j] <= cut) if low else (x[:, j] > cut)
    return out


def fit_rules(x: np.ndarray, y: np.ndarray, params: QualityParams = QualityParams()) -> RuleEnsemble:
    """Rules from subsampled boosted trees, weights by proximal gradient steps on the lasso logistic loss."""
    if len(y) == 0:
        return RuleEnsemble(0.0, [])
    if y.min() == y.max():
        return RuleEnsemble(20.0 if y[0] else -20.0, [])
    rng = np.random.default_rng(params.seed)
    codes, cuts = bin_columns(x)
    z, rules = np.zeros(len(y)), {}
    for _ in range(params.trees):
        p = 1 / (1 + np.exp(-z))
        tree = fit_tree(codes, cuts, p - y, p * (1 - p), int(rng.integers(1, params.depth + 1)), least=min(5.0, max(0.5, len(y) / 200)), rows=np.flatnonzero(rng.random(len(y)) < params.share))
        z += 0.3 * tree.predict(x)
        rules |= {tuple(sorted(path)): None for path in tree.paths()}
    kept, columns = [], []
    for rule in rules:
        own = holds(rule, x)
        if 0.002 < own.mean() < 0.998:
            kept.append(rule)
            columns.append(own)
    if not kept:
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
        return RuleEnsemble(float(np.log(share / (1 - share))), [])
    a = np.stack(columns, axis=1).astype(np.float32)
    mean, scale = a.mean(axis=0), a.std(axis=0)
    a = (a - mean) / scale
    # the largest eigenvalue of a'a / n bounds the curvature
    v = rng.normal(size=a.shape[1]).astype(np.float32)
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 4 / max(1.0, float(np.linalg.norm(a @ v) ** 2 / len(y)))
    w, last, b, t = np.zeros(a.shape[1]), np.zeros(a.shape[1]), 0.0, 1.0
    ahead = w.copy()
    for _ in range(params.steps):
        p = 1 / (1 + np.exp(-(a @ ahead.astype(np.float32) + b)))
        g = a.T @ (p - y).astype(np.float32) / len(y)
        b -= 2.0 * float((p - y).mean())
        w = ahead - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * params.penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, last = w + (before - 1) / t * (w - last), w
    weights = w / scale
    found = [(r, float(c)) for r, c in zip(kept, weights, strict=True) if c]
    return RuleEnsemble(float(b - (weights * mean).sum()), found)


def train_quality(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams(), key: str = "doc_id", text: str = "text", label: str = "quality", prefix: str = "stat_") -> RuleEnsemble:
    """docs: key and text; labels: key and label of rows that training may see. Statistics are taken of sampled rows only.

    Of several labels of a document the least counts, of several texts the first by order.
    """
    names = [prefix + s for s in STATISTICS]
    once = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias(label))
    marked = {r[key]: r[label] for r in bounded_sample(once, key, params.train_rows, labels)}
    if not marked:
        return fit_rules(np.zeros((0, len(names))), np.zeros(0), params)
    # at most train_rows ids: small enough to send to every task
    chosen = docs.sparkSession.createDataFrame([(k,) for k in marked], labels.select(key).schema)
    texts = docs.select(key, text).join(F.broadcast(chosen), key).groupBy(key).agg(F.min(text).alias(text))
    rows = with_statistics(texts, text, prefix).select(key, *names).orderBy(key).collect()
    x = np.array([[r[n] for n in names] for r in rows], float).reshape(len(rows), len(names))
    return fit_rules(x, np.array([marked[r[key]] for r in rows], float), params)


def score_quality(docs: DataFrame, model: RuleEnsemble, score: str = "score", text: str = "text") -> DataFrame:
    """docs with the score added in place of any column of that name."""
    kept = [c for c in docs.columns if c != score]
    prefix = fresh("stat_", docs.columns)
    return with_statistics(docs.select(*kept), text, prefix).select(*kept, model.column(prefix).alias(score))


def drop_low_quality(docs: DataFrame, model: RuleEnsemble, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs whose score reaches `least`."""
    prefix = fresh("stat_", docs.columns)
    return with_statistics(docs, text, prefix).filter(model.column(prefix) >= least).select(*docs.columns)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_quality(docs, table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 3) != 1))
    return score_quality(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
