"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from the URLs that a rule judges: length, depth, digit ratio, entropy, parameter counts and smoothed
block rates of the host's suffixes. Null and malformed URLs have an empty host and path, fit no rule and are judged
by the trees; without any labelled URL everything unruled is allowed. A score of 0.5 blocks. Repeated rows and rules of
equal length (the later one wins) are judged alike, extra columns go, empty tables give none. No shuffle.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, table
from .trees import Boosted, boost

#: Verdict, host, path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


@dataclass(frozen=True)
class UrlParams:
    """train_rows bounds the labelled URLs that training reads, and with them the suffix table; folds: of hosts, for suffix rates."""

    train_rows: int = 20_000
    trees: int = 40
    depth: int = 3
    rate: float = 0.3
    prior: float = 8.0
    folds: int = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path; both empty without `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)


def judge_by_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(own + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def suffixes(host: str) -> list[str]:
    """The host's last label, its last two and last three."""
    labels = host.split(".")
    return [".".join(labels[-k:]) for k in (1, 2, 3) if len(labels) >= k]


def lexical(url: str, host: str, path: str) -> list[float]:
    n, counts = len(url), Counter(url)
    query = url.partition("#")[0].partition("?")[2]
    return [
        n,
        len(host),
        len(path),
        path.rstrip("/").count("/"),
        host.count("."),
        sum(c.isdigit() for c in url) / max(1, n),
        -sum(v / n * math.log2(v / n) for v in counts.values()) if n else 0.0,
        query.count("&") + bool(query),
        url.count("-") + url.count("_"),
        float("#" in url),
    ]


@dataclass
class UrlModel:
    trees: Boosted
    base: float
    rates: dict[str, float]

    def features(self, urls: list, hosts: list, paths: list) -> np.ndarray:
        rows = []
        for url, host, path in zip(urls, hosts, paths, strict=True):
            known = [self.rates.get(s, self.base) for s in suffixes(host)]
            rows.append(lexical(url or "", host, path) + (known + [self.base] * 3)[:3])
        return np.array(rows, float).reshape(len(rows), 13)

    def probability(self, urls: list, hosts: list, paths: list) -> np.ndarray:
        return self.trees.probability(self.features(urls, hosts, paths))


def train_url_model(labelled: DataFrame, params: UrlParams = UrlParams(), key: str = "page_id") -> UrlModel | None:
    """labelled: key, url, host, path and label (1: block). None without rows."""
    rows = bounded_sample(labelled.select(key, "url", "host", "path", "label"), key, params.train_rows)
    if not rows:
        return None
    y = np.array([r["label"] for r in rows], float)
    base = float(y.mean())
    urls, hosts, paths = ([r[c] for r in rows] for c in ("url", "host", "path"))

    def rates(some: np.ndarray) -> dict[str, float]:
        seen: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for k in some:
            for s in suffixes(hosts[k]):
                seen[s][0] += y[k]
                seen[s][1] += 1
        return {s: (a + params.prior * base) / (n + params.prior) for s, (a, n) in seen.items()}

    # a URL's suffix rates come from other hosts' folds, so that they do not tell its own label
    fold = np.array([zlib.crc32(h.encode()) % params.folds for h in hosts])
    x = np.zeros((len(rows), 13))
    for f in range(params.folds):
        own = np.flatnonzero(fold == f)
        part = UrlModel(Boosted(0.0, 0.0, []), base, rates(np.flatnonzero(fold != f)))
        x[own] = part.features([urls[k] for k in own], [hosts[k] for k in own], [paths[k] for k in own])
    return UrlModel(boost(x, y, params.trees, params.depth, params.rate), base, rates(np.arange(len(rows))))


def filter_urls(pages: DataFrame, rules=RULES, params: UrlParams = UrlParams(), key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict and the trees' block_score of every row."""
    host, path = host_and_path(F.col(url))
    split = pages.select(F.col(key).alias(key), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = judge_by_rules(F.col("host"), F.col("path"), rules)
    ruled = split.withColumns({"rule": rule, "ruled": verdict})
    model = train_url_model(ruled.filter("rule is not null").withColumn("label", (F.col("ruled") == "block").cast("int")), params, key)
    kept = [key, "host", "path", "rule"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = lambda name: b.column(name).to_pylist()  # noqa: E731, B023
            score = model.probability(column("url"), column("host"), column("path")) if model else np.zeros(b.num_rows)
            verdicts = [r or ("block" if s >= 0.5 else "allow") for r, s in zip(column("ruled"), score, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(verdicts, pa.string()), pa.array(score, pa.float64())], [*kept, "verdict", "block_score"])

    return ruled.mapInArrow(run, ruled.select(*kept).schema.add("verdict", "string").add("block_score", "double"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
