"""Toxicity by non-negative positive-unlabelled learning.

A text is toxic if any of its distinct tokens is (noisy-or): P = 1 - exp(-sum softplus(token score)), and a token's
score is the sum of hashed weights of itself, its beginnings and its character 4-grams. Training sees confirmed toxic texts and
unlabelled texts only, and lowers the class-prior-corrected risk  pi E_p[1 - P] + max(0, E_u[P] - pi E_p[P]).

Null and empty texts score 0. Repeated rows and extra columns pass, ties do not arise; without labels or texts nothing
is learned and every score is near 0. Rows are independent: no shuffle after training.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, crc_mod, table

_TRIM = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„’‘…¡¿"


@dataclass(frozen=True)
class ToxicParams:
    """Training reads `positives` toxic and `unlabelled` other rows at most, whole. prior: the class prior, estimated where
    None; margin: standard errors of the labelled share that it is taken to be too low, as a low prior costs far more."""

    positives: int = 1500
    unlabelled: int = 3000
    prior: float | None = None
    margin: float = 5.0
    log2_weights: int = 18
    steps: int = 160
    rate: float = 0.25
    start: float = -8.0
    decay: float = 2e-6
    #: Token scores that a worker keeps at most.
    cache: int = 300_000


def tokens(text: str) -> set[str]:
    return set(text.lower().split())


def token_features(token: str, bits: int) -> list[int]:
    word = token.strip(_TRIM)
    if not word:
        return []
    grams = {f"w{word}", *(word[i : i + 4] for i in range(len(word) - 3)), *(f"^{word[:n]}" for n in range(3, min(8, len(word))))}
    return [zlib.crc32(g.encode()) & ((1 << bits) - 1) for g in grams]


@dataclass
class ToxicModel:
    weights: np.ndarray
    start: float
    bits: int
    cache: int

    def __post_init__(self):
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def __setstate__(self, state):
        self.__dict__.update(state, known={})

    def token_mass(self, token: str) -> float:
        found = token_features(token, self.bits)
        mass = float(np.logaddexp(0, self.start + sum(self.weights[i] for i in found))) if found else 0.0
        if len(self.known) >= self.cache:
            self.known.clear()
        self.known[token] = mass
        return mass

    def score(self, text: str | None) -> float:
        known = self.known
        total = 0.0
        for t in tokens(text or ""):
            m = known.get(t)
            total += self.token_mass(t) if m is None else m
        return float(-np.expm1(-total))


def train_toxic_model(positive: list[str], unlabelled: list[str], prior: float, params: ToxicParams = ToxicParams()) -> ToxicModel:
    """Full-batch Adam on the non-negative risk; where its second term falls below zero only the first one counts."""
    model = ToxicModel(np.zeros(1 << params.log2_weights, np.float32), params.start, params.log2_weights, params.cache)
    docs = [tokens(t) for t in (*positive, *unlabelled)]
    if not positive or not unlabelled:
        return model
    index: dict[str, int] = {}
    word_of, doc_of = array("i"), array("i")
    for d, found in enumerate(docs):
        for t in found:
            word_of.append(index.setdefault(t, len(index)))
            doc_of.append(d)
    feature_of, sizes = array("i"), array("i")
    for t in index:
        found = token_features(t, params.log2_weights)
        feature_of.extend(found)
        sizes.append(len(found))
    del docs
    n_words = len(index)
    index.clear()
    sizes, feature_of = np.array(sizes), np.array(feature_of)
    owner = np.repeat(np.arange(n_words, dtype=np.int32), sizes)
    there = sizes > 0
    used, feature_of = np.unique(feature_of, return_inverse=True)
    word_of, doc_of = np.array(word_of), np.array(doc_of)
    n_p, n_u = len(positive), len(unlabelled)
    is_p = np.arange(n_p + n_u) < n_p
    w = np.zeros(len(used))
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for it in range(params.steps):
        s = params.start + np.bincount(owner, weights=w[feature_of], minlength=n_words)
        mass = np.where(there, np.logaddexp(0, s), 0.0)
        total = np.bincount(doc_of, weights=mass[word_of], minlength=n_p + n_u)
        p = -np.expm1(-total)
        negative = p[~is_p].mean() - prior * p[is_p].mean()
        # derivative of the risk by each document's P
        if negative >= 0:
            by_p = np.where(is_p, -2 * prior / n_p, 1 / n_u)
        else:
            by_p = np.where(is_p, -prior / n_p, 0.0)
        by_total = by_p * np.exp(-total)
        by_s = np.bincount(word_of, weights=by_total[doc_of], minlength=n_words) * there / (1 + np.exp(-s))
        grad = np.bincount(feature_of, weights=by_s[owner], minlength=len(used)) + params.decay * w
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        w -= params.rate * (m1 / (1 - 0.9 ** (it + 1))) / (np.sqrt(m2 / (1 - 0.99 ** (it + 1))) + 1e-7)
    model.weights[used] = w
    return model


def class_prior(confirmed: int, labelled: int, margin: float) -> float:
    """The share of toxic texts, from confirmed ones among all that were looked at, at the upper end of its error."""
    share = confirmed / max(1, labelled)
    return min(0.5, share + margin * float(np.sqrt(share * (1 - share) / max(1, labelled))))


def fit_toxicity(docs: DataFrame, labels: DataFrame, params: ToxicParams = ToxicParams(), key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicModel:
    """docs: unlabelled texts; labels: key and label of rows that training may see. A document counts as toxic if any of its labels says so.

    Of negative labels only their number is used, for the class prior; negative texts are never learned from as such.
    """
    once = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias(label))
    n, n_toxic = once.agg(F.count(F.lit(1)), F.count_if(F.col(label) == 1)).first()
    prior = params.prior if params.prior is not None else class_prior(n_toxic, n, params.margin)
    sized = docs.select(key, text).filter(F.length(text) > 0)
    confirmed = [r[key] for r in bounded_sample(once.filter(F.col(label) == 1).select(key), key, params.positives, labels)]
    positive = [r[text] for r in sized.filter(F.col(key).isin(confirmed)).groupBy(key).agg(F.min(text).alias(text)).orderBy(key).collect()] if confirmed else []
    unlabelled = [r[text] for r in bounded_sample(sized, key, params.unlabelled, docs)]
    return train_toxic_model(positive, unlabelled, prior, params)


def score_toxicity(docs: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """docs without the text, with score added in place of any column of that name."""
    keep = [c for c in docs.columns if c not in (text, "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.score(t.as_py()) for t in b.column(text)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(scores, pa.float64())], [*keep, "score"])

    return docs.select(*keep, text).mapInArrow(run, docs.select(*keep).schema.add("score", "double"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    learn = crc_mod("doc_id", 4) != 2
    model = fit_toxicity(docs.filter(learn), labels.filter(learn & F.col("toxic").isNotNull()))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
