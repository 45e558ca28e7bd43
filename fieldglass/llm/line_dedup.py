"""Line dedup over line hashes.

Lines are cut at newlines and after sentence ends, and hashed by their words (A-Z as a-z, any white space). A run of
lines that occurred before, by document id and place, goes if it has `least_words` words, whichever earlier text holds
it. Such runs are found by their grams: from each line, and up to each line, the shortest run with `least_words` words.
Every line of a repeated run is in a gram within that run, and a gram that occurred before is itself such a run; so the
lines that go are those of all occurrences of a gram but its first. The text between runs stays as it is.

Null and empty texts have no lines; null ids take no part. Rows that share an id are one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan
from .common import fresh, release, table, written


@dataclass(frozen=True)
class LineParams:
    """least_words: of a repeated run that goes; gram_words and window_words: of winnowing in fingerprints."""

    gram_words: int = 25
    window_words: int = 50
    least_words: int = 40


_POWER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_END = np.zeros(256, bool)
_END[[33, 46, 63]] = True


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, number of words, start byte, end byte and row of every line with a word."""
    hashes, starts, ends, rows = bytescan.words(data, offsets)
    if not len(hashes):
        return hashes, *(np.zeros(0, np.int64) for _ in range(4))
    newlines = np.cumsum(data == 10, dtype=np.int32)[starts]
    first = np.ones(len(hashes), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (newlines[1:] != newlines[:-1]) | _END[data[ends[:-1] - 1]]
    at = np.flatnonzero(first)
    words = np.diff(np.concatenate([at, [len(hashes)]]))
    place = (np.arange(len(hashes)) - np.repeat(at, words)) & 0xFFFF
    line = bytescan.mix(np.add.reduceat(hashes * bytescan._PLACE[place], at) + words.astype(np.uint64))
    return line, words, starts[at], ends[at + words - 1], rows[at]


def fingerprints(line: np.ndarray, words: np.ndarray, rows: np.ndarray, params: LineParams) -> tuple[np.ndarray, np.ndarray]:
    """The lines at which a gram that winnowing selects starts, and its hash; repeated_runs takes all grams instead."""
    n = len(line)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.cumsum(words)
    before = total - words
    gram_end = np.searchsorted(total, before + params.gram_words)
    window_end = np.searchsorted(total, before + params.window_words)
    turn = np.cumprod(np.full(n, _POWER))
    back = np.cumprod(np.full(n, _INVERSE))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(line * turn, dtype=np.uint64)])
    stop = np.minimum(gram_end, n - 1)
    grams = bytescan.mix((sums[stop + 1] - sums[:-1]) * back + (stop - np.arange(n)).astype(np.uint64))
    row_end = np.searchsorted(rows, rows, "right")
    whole = np.flatnonzero(window_end < row_end)
    last = np.searchsorted(gram_end, window_end[whole], "right") - 1
    best = whole.copy()
    k, live = 1, np.flatnonzero(last > whole)
    while len(live):
        other = whole[live] + k
        lower = grams[other] < grams[best[live]]
        best[live[lower]] = other[lower]
        k += 1
        live = live[whole[live] + k <= last[live]]
    best = np.unique(best)
    return best, grams[best]


def grams(line: np.ndarray, words: np.ndarray, rows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line, last line and hash of every shortest run of `least` words, from each line on and up to each line."""
    n = len(line)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.cumsum(words)
    before = total - words
    end = np.searchsorted(total, before + least)
    begin = np.searchsorted(before, total - least, "right") - 1
    at = np.arange(n)
    onward = end < np.searchsorted(rows, rows, "right")
    # what ends here and is also the shortest from its first line is there already
    upto = (begin >= np.searchsorted(rows, rows, "left")) & (end[begin] != at)
    first, last = np.concatenate([at[onward], begin[upto]]), np.concatenate([end[onward], at[upto]])
    order = np.argsort(first, kind="stable")
    first, last = first[order], last[order]
    turn = np.cumprod(np.full(n, _POWER))
    back = np.cumprod(np.full(n, _INVERSE))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(line * turn, dtype=np.uint64)])
    return first, last, bytescan.mix((sums[last + 1] - sums[first]) * back[first] + (last - first).astype(np.uint64))


def _gram_table(docs: DataFrame, key: str, text: str, params: LineParams) -> DataFrame:
    """One row per document: the words of its lines, and its grams with their first lines and how many more they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytescan.buffers(batch.column(text))
            for a, b in bytescan.slices(offsets):
                line, words, _, _, rows = lines_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                first, last, found = grams(line, words, rows, params.least_words)
                cut = np.searchsorted(rows, np.arange(b - a + 1))
                mark = np.searchsorted(first, cut)
                place = first - cut[rows[first]] if len(first) else first
                lists = lambda values, cuts: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(a, b - a), lists(words.astype(np.int32), cut), lists(found.view(np.int64), mark), lists(place.astype(np.int32), mark), lists((last - first).astype(np.int32), mark)], ["doc", "words", "gram", "place", "more"])

    return docs.select(key, text).filter(F.col(key).isNotNull()).mapInArrow(run, "doc long, words array<int>, gram array<long>, place array<int>, more array<int>")


def _covered(place: np.ndarray, more: np.ndarray) -> list[dict[str, int]]:
    """The lines of all grams as runs (first, last); overlapping and touching ones become one."""
    last = place + more
    steps = np.bincount(place, minlength=last.max() + 2) - np.bincount(last + 1, minlength=last.max() + 2)
    edges = np.flatnonzero(np.diff(np.cumsum(steps) > 0, prepend=False))
    return [{"first": int(a), "last": int(b) - 1} for a, b in edges.reshape(-1, 2)]


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", params: LineParams = LineParams()) -> DataFrame:
    """doc, n_lines, n_words and, for each document, runs: array of (first, last) lines to delete, disjoint and in order; null without any."""
    spark = docs.sparkSession
    prints = written(_gram_table(docs, key, text, params), "lines")
    marks = prints.select("doc", F.explode(F.arrays_zip("gram", "place", "more")).alias("m")).select(F.col("m.gram").alias("gram"), "doc", F.col("m.place").alias("place"), F.col("m.more").alias("more"))
    first = marks.groupBy("gram").agg(F.min(F.struct("doc", "place")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram", "f")
    # written, so that the join below is of two plain sides and Spark can split a gram that very many documents have
    first = written(first, "first")
    later = marks.join(first, "gram").filter(F.struct("doc", "place") > F.col("f")).select("doc", "place", "more")
    hits = later.groupBy("doc").agg(F.collect_list("place").alias("place"), F.collect_list("more").alias("more"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        for batch in batches:
            place, more = batch.column("place"), batch.column("more")
            runs = [_covered(np.asarray(place[i].values), np.asarray(more[i].values)) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(runs, kind)], ["doc", "runs"])

    runs = written(hits.mapInArrow(run, "doc long, runs array<struct<first:int,last:int>>"), "runs")
    release(spark)
    return prints.select("doc", "words").join(runs, "doc", "left").select("doc", F.size("words").cast("long").alias("n_lines"), F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + w).alias("n_words"), "words", "runs")


def cut_lines(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without the lines of the runs; what stands between them is untouched."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    _, _, starts, ends, _ = lines_of(data, np.array([0, len(raw)]))
    out, at = [], 0
    for first, last in runs:
        out.append(raw[at : starts[first]])
        at = int(starts[last + 1]) if last + 1 < len(starts) else len(raw)
    out.append(raw[at:])
    return b"".join(out).decode()


def dedupe_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", params: LineParams = LineParams()) -> DataFrame:
    """docs with repeated runs cut from their texts; every row stays, with an empty text if all of it was a repeat."""
    doc, cut = fresh("__doc", docs.columns), fresh("__runs", docs.columns)
    runs = repeated_runs(docs, key, text, params).filter("runs is not null").groupBy(F.col("doc").alias(doc)).agg(F.min("runs").alias(cut))
    joined = docs.join(runs, docs[key] == runs[doc], "left").drop(doc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() if not r.is_valid or not t.is_valid else cut_lines(t.as_py(), [(x["first"], x["last"]) for x in r.as_py()]) for t, r in zip(batch.column(text), batch.column(cut), strict=True)]
            names = [c for c in batch.schema.names if c != cut]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else batch.column(c) for c in names], names)

    return joined.mapInArrow(run, docs.schema)


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_runs(table(spark, sf_dir, "documents"))
    cut = F.coalesce(F.col("runs"), F.array().cast("array<struct<first:int,last:int>>"))
    lines = F.aggregate(cut, F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1)
    words = F.aggregate(cut, F.lit(0).cast("long"), lambda a, r: a + F.aggregate(F.slice("words", r["first"] + 1, r["last"] - r["first"] + 1), F.lit(0).cast("long"), lambda b, w: b + w))
    return found.select(F.col("doc").alias("doc_id"), "n_lines", "n_words", lines.alias("removed_lines"), words.alias("removed_words"), cut.alias("runs"))
