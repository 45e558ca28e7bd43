"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised alike: lower case, ASCII punctuation and white space as single spaces. An item of m
characters may be found with up to k = m * rate edits. Cut into k + 1 pieces, one piece of any such copy is untouched,
so exact piece hits (one automaton over all pieces) give every candidate place, and Myers' bit-parallel distance
decides. Items come in blocks of bounded size, each a scan of the texts without a shuffle: the automaton of a block is
what a worker has to hold.

Null and empty texts and items match nothing; an item of one piece must occur exactly. Of equally good places the first
is given. Repeated texts and items give repeated rows; item ids are long. Empty tables give no rows, extra columns pass.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class EditParams:
    """rate: edits allowed per character; piece: characters that a piece has at least; block: characters of items in one scan."""

    rate: float = 0.08
    piece: int = 12
    block: int = 1_000_000


_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normal(text: str | None) -> str:
    return b" ".join((text or "").lower().encode().translate(_PLAIN).split()).decode()


def budget(size: int, params: EditParams) -> int:
    """Edits that an item of this size allows."""
    return max(0, min(int(size * params.rate), size // params.piece - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length with their places."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, masks: dict[str, int], text: str, k: int) -> tuple[int, int] | None:
    """The smallest edit distance, at most k, of the pattern to any substring of the text, and where the first such substring ends."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = k + 1, -1
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        plus = mh | ~(xv | ph) & full
        minus = ph & xv
        if score < best:
            best, end = score, j + 1
            if not best:
                break
    return (best, end) if end >= 0 else None


class Matcher:
    def __init__(self, items: list[tuple[int, str]], params: EditParams):
        self.items = []
        found = defaultdict(list)
        for item_id, text in items:
            n = len(self.items)
            k = budget(len(text), params)
            masks: dict[str, int] = defaultdict(int)
            for i, c in enumerate(text):
                masks[c] |= 1 << i
            self.items.append((item_id, text, k, dict(masks)))
            for place, part in pieces(text, k):
                found[part].append((n, place))
        self.automaton = ahocorasick.Automaton()
        for part, owners in found.items():
            self.automaton.add_word(part, (len(part), owners))
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """item_id, distance, and start (within the budget of edits) and end in the normalised text, of each item's best match."""
        starts = defaultdict(list)
        for last, (size, owners) in self.automaton.iter(text):
            for n, place in owners:
                starts[n].append(last + 1 - size - place)
        out = []
        for n, places in sorted(starts.items()):
            item_id, item, k, masks = self.items[n]
            best = None
            places.sort()
            lo = hi = places[0]
            for p in [*places[1:], None]:
                if p is not None and p - hi <= 2 * k:
                    hi = p
                    continue
                a = max(0, lo - k)
                at = text.find(item, a, hi + len(item) + k)
                if at >= 0:
                    best = (0, at, at + len(item))
                    break
                if k and (found := myers(item, masks, text[a : hi + len(item) + k], k if best is None else best[0] - 1)):
                    best = (found[0], max(0, a + found[1] - len(item)), a + found[1])
                lo = hi = p
            if best:
                out.append((item_id, *best))
        return out


def item_blocks(items: DataFrame, key: str, text: str, params: EditParams) -> Iterator[list[tuple[int, str]]]:
    """Normalised items in blocks of bounded size; each goes into the plan of its own scan."""
    block, size = [], 0
    for row in items.select(key, text).filter(F.col(text).isNotNull()).toLocalIterator():
        item = normal(row[1])
        if not item:
            continue
        if block and size + len(item) > params.block:
            yield block
            block, size = [], 0
        block.append((row[0], item))
        size += len(item)
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", params: EditParams = EditParams()) -> DataFrame:
    """key, item_id, distance and the place in the normalised text of every (text, item) pair within the item's budget of edits."""
    schema = docs.select(F.col(key).alias(key)).schema.add("item_id", "long").add("distance", "integer").add("start", "integer").add("end", "integer")
    found = docs.sparkSession.createDataFrame([], schema)
    for block in item_blocks(items, item_key, item_text, params):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, params)
            for batch in batches:
                rows, hits = [], []
                for i, t in enumerate(batch.column(text)):
                    own = matcher.matches(normal(t.as_py()))
                    rows += [i] * len(own)
                    hits += own
                columns = [batch.column(key).take(pa.array(rows, pa.int64())), pa.array([h[0] for h in hits], pa.int64()), *(pa.array([h[j] for h in hits], pa.int32()) for j in (1, 2, 3))]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

        found = found.union(docs.select(key, text).mapInArrow(run, schema))
    return found


def drop_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", params: EditParams = EditParams()) -> DataFrame:
    """The rows of docs without a match of any item."""
    for block in item_blocks(items, item_key, item_text, params):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, params)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.matches(normal(t.as_py())) for t in batch.column(text)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
