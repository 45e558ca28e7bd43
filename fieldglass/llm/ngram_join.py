"""Exact Jaccard self-join on word shingles, as components: rare-first prefix filtering with length, positional and suffix filters.

1. One pass hashes every text to its distinct shingles. Texts with equal sets are one class, named by its smallest id.
2. A second pass deals (shingle, class) out by shingle, packed per task, so that each shingle's document frequency is
   known; only shingles of two classes or more can be shared, and they get numbers that sort rare shingles first.
3. Dealt back by class, a class is dropped unless its shared shingles alone can reach the threshold; the rest keep
   their sorted lists, and their rare-first prefixes become an inverted table.
4. Classes that meet under a prefix shingle are compared in rounds, each with one hub, and only across components found
   so far: a group of k near copies costs about k comparisons a round. Rounds go on, with other hubs and without the
   shingles whose classes are one component by now, while they find links for a good part of what they compare.
5. What then still lies across components meets under its prefix shingles once more. A pair only comes up there if
   neither sizes, nor places, nor sketches rule it out: a sketch holds the parity of each of its cells' shingles, so two
   differ in no more cells than the sets do in shingles. No link between components is missed, no pair is verified
   twice, and what comes up is about what links.

Rows with a null or word-free text have no shingles and link with nothing. Rows that share an id are one document; null
ids stay apart. Empty tables give none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan
from .common import drop_written, release, table, written
from .components import connected_components


@dataclass(frozen=True)
class JoinParams:
    """words per shingle; two sets link if 100 * intersection >= percent * union. bucket: shingles that one task orders;
    worth: percent of a round's comparisons that must link for another round."""

    words: int = 5
    percent: int = 80
    bucket: int = 8_000_000
    worth: int = 50


#: Bytes of text whose shingles are packed together.
PACK_BYTES = 4_000_000
#: Bits of a shingle's rank within its bucket.
RANK_BITS = 26
#: 64-bit words of a sketch.
SKETCH = 16


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and a 128-bit sum for each set."""
    size = np.array([len(s) for s in sets], np.int64)
    one = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
    two = np.array([bytescan.mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) for s in sets], np.uint64)
    return size, one.view(np.int64), two.view(np.int64)


def shingle_classes(docs: DataFrame, key: str, text: str, params: JoinParams) -> DataFrame:
    """key, n_shingles and the signature (s1, s2) of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytescan.buffers(batch.column(text))
            for a, b in bytescan.slices(offsets):
                size, one, two = signatures(bytescan.shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], params.words))
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(a, b - a), pa.array(size), pa.array(one), pa.array(two)], [key, "n_shingles", "s1", "s2"])

    schema = docs.select(key).schema.add("n_shingles", "long").add("s1", "long").add("s2", "long")
    return docs.select(key, text).mapInArrow(run, schema)


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], np.int64).tobytes(), *(a.tobytes() for a in arrays)])


def _unpack(raw: memoryview, kinds: tuple) -> list[np.ndarray]:
    count = np.frombuffer(raw, np.int64, len(kinds))
    out, at = [], 8 * len(kinds)
    for kind, n in zip(kinds, count, strict=True):
        out.append(np.frombuffer(raw, kind, int(n), at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def _narrow(values: np.ndarray, width: int) -> np.ndarray:
    """Unsigned 64-bit values as `width` bytes each."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).reshape(-1)


def _wide(raw: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = raw.reshape(-1, width)
    return out.reshape(-1).view("<u8")


def _packed_shingles(docs: DataFrame, text: str, buckets: int, params: JoinParams) -> DataFrame:
    """bucket and payload: classes (s1, s2, n), sorted shingles without their bucket, as differences of as few bytes as the largest needs, and the class of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytescan.buffers(batch.column(text))
            for a, b in bytescan.slices(offsets, PACK_BYTES):
                sets = []
                for c, d in bytescan.slices(offsets[a : b + 1]):
                    sets += bytescan.shingles(data[offsets[a + c] : offsets[a + d]], offsets[a + c : a + d + 1] - offsets[a + c], params.words)
                size, one, two = signatures(sets)
                _, first = np.unique(np.stack([one, two, size], axis=1), axis=0, return_index=True)
                first = first[size[first] > 0]
                if not len(first):
                    continue
                h = np.concatenate([sets[i] for i in first])
                of = np.repeat(np.arange(len(first), dtype=np.int32), size[first])
                del sets
                bucket, h = (h % np.uint64(buckets)).astype(np.int64), h // np.uint64(buckets)
                order = np.lexsort((h, bucket))
                h, of, bucket = h[order], of[order], bucket[order]
                cuts = np.searchsorted(bucket, np.arange(buckets + 1))
                ids, payloads = [], []
                for k in np.flatnonzero(np.diff(cuts)):
                    own, cls = h[cuts[k] : cuts[k + 1]], of[cuts[k] : cuts[k + 1]]
                    used, cls = np.unique(cls, return_inverse=True)
                    steps = np.diff(own, prepend=np.uint64(0))
                    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
                    kind = np.uint16 if len(used) < 1 << 16 else np.int32
                    src = first[used]
                    ids.append(k)
                    payloads.append(bytes([width, np.dtype(kind).itemsize]) + bytes(6) + _pack(one[src], two[src], size[src].astype(np.int32), _narrow(steps, width), cls.astype(kind)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(payloads, pa.binary())], ["bucket", "payload"])

    return docs.select(text).mapInArrow(run, "bucket int, payload binary")


def _shared_by_class(packed: DataFrame, buckets: int, width: int) -> DataFrame:
    """From each bucket, by class partition: the classes that hold shingles of two classes or more, and those shingles' rare-first numbers."""
    bits = max(1, (buckets - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for k, raw in zip(batch.column("bucket").to_pylist(), batch.column("payload"), strict=True):
                raw = raw.as_buffer().to_pybytes()
                one, two, size, steps, cls = _unpack(memoryview(raw)[8:], (np.int64, np.int64, np.int32, np.uint8, np.uint16 if raw[1] == 2 else np.int32))
                held.setdefault(k, []).append((one, two, size, np.cumsum(_wide(steps, raw[0])), cls))
        for k in list(held):
            parts = held.pop(k)
            base = np.cumsum([0, *(len(p[0]) for p in parts)])
            names = np.stack([np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(3)], axis=1)
            names, same = np.unique(names, axis=0, return_inverse=True)
            h = np.concatenate([p[3] for p in parts])
            cls = same.reshape(-1)[np.concatenate([p[4].astype(np.int64) + b for p, b in zip(parts, base, strict=False)])]
            del parts
            order = np.lexsort((cls, h))
            h, cls = h[order], cls[order]
            once = np.ones(len(h), bool)
            once[1:] = (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])
            h, cls = h[once], cls[once]
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            df = np.diff(np.concatenate([starts, [len(h)]]))
            if len(df) >> RANK_BITS:
                raise ValueError("more distinct shingles in a bucket than ranks: raise spark.sql.shuffle.partitions or lower JoinParams.bucket")
            number = np.floor(np.log2(df)).astype(np.uint64) << np.uint64(RANK_BITS + bits) | np.uint64(k << RANK_BITS) | np.arange(len(df), dtype=np.uint64)
            shared = np.repeat(df >= 2, df)
            tokens, cls = np.repeat(number, df)[shared], cls[shared]
            part = (names[:, 0] % buckets)[cls]
            order = np.lexsort((tokens, cls, part))
            tokens, cls, part = tokens[order], cls[order], part[order]
            cuts = np.searchsorted(part, np.arange(buckets + 1))
            ids, payloads = [], []
            for p in np.flatnonzero(np.diff(cuts)):
                used, count = np.unique(cls[cuts[p] : cuts[p + 1]], return_counts=True)
                ids.append(p)
                payloads.append(_pack(names[used, 0], names[used, 1], names[used, 2].astype(np.int32), count.astype(np.int32), _narrow(tokens[cuts[p] : cuts[p + 1]], width)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(payloads, pa.binary())], ["part", "payload"])

    return packed.repartitionById(buckets, "bucket").mapInArrow(run, "part int, payload binary")


def _able_classes(shared: DataFrame, buckets: int, width: int, params: JoinParams) -> DataFrame:
    """s1, s2, n and the sorted shared shingles of classes that can reach the threshold with any other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for raw in batch.column("payload"):
                held.append(_unpack(raw.as_buffer(), (np.int64, np.int64, np.int32, np.int32, np.uint8)))
        if not held:
            return
        names = np.stack([np.concatenate([p[i] for p in held]).astype(np.int64) for i in range(3)], axis=1)
        names, same = np.unique(names, axis=0, return_inverse=True)
        cls = np.repeat(same.reshape(-1), np.concatenate([p[3] for p in held]))
        tokens = _wide(np.concatenate([p[4] for p in held]), width)
        del held
        total = np.bincount(cls, minlength=len(names))
        able = 100 * total >= params.percent * names[:, 2]
        keep = able[cls]
        tokens, cls = tokens[keep], cls[keep]
        order = np.lexsort((tokens, cls))
        tokens, cls = tokens[order], cls[order]
        which = np.flatnonzero(able)
        cuts = np.searchsorted(cls, np.concatenate([which, [len(names)]]))
        for lo in range(0, len(which), 500):
            some = which[lo : lo + 500]
            lists = [_narrow(tokens[cuts[lo + i] : cuts[lo + i + 1]], width).tobytes() for i in range(len(some))]
            yield pa.RecordBatch.from_arrays([*(pa.array(names[some, i]) for i in range(3)), pa.array(lists, pa.binary())], ["s1", "s2", "n", "tokens"])

    return shared.repartitionById(buckets, "part").mapInArrow(run, "s1 long, s2 long, n long, tokens binary")


def _prefixes(classes: DataFrame, width: int, params: JoinParams) -> DataFrame:
    """token, id, n, c (shared shingles) and j (place among them) for the rare-first prefix of each class; unshared shingles fill its first places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = np.asarray(batch.column("id")), np.asarray(batch.column("n"))
            tokens, counts, lengths = [], [], []
            for n, raw in zip(sizes, batch.column("tokens"), strict=True):
                own = _wide(np.frombuffer(raw.as_buffer(), np.uint8), width)
                prefix = int(n) - -(-params.percent * int(n) // 100) + 1 - (int(n) - len(own))
                tokens.append(own[: max(0, prefix)])
                counts.append(len(own))
                lengths.append(len(tokens[-1]))
            if not tokens:
                continue
            lengths = np.array(lengths)
            place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            columns = [np.concatenate(tokens).view(np.int64), np.repeat(ids, lengths), np.repeat(sizes, lengths).astype(np.int32), np.repeat(counts, lengths).astype(np.int32), place.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "id", "n", "c", "j"])

    return classes.select("id", "n", "tokens").mapInArrow(run, "token long, id long, n int, c int, j int")


def _sketches(classes: DataFrame, width: int) -> DataFrame:
    """id and b0.., the parities of the class's shared shingles by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [_wide(np.frombuffer(raw.as_buffer(), np.uint8), width) for raw in batch.column("tokens")]
            cell = [bytescan.mix(t.astype(np.uint64)) % np.uint64(64 * SKETCH) for t in tokens]
            bits = np.stack([np.bincount(c.astype(np.int64), minlength=64 * SKETCH) & 1 for c in cell]) if cell else np.zeros((0, 64 * SKETCH), np.int64)
            words = np.packbits(bits.astype(np.uint8), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(SKETCH))], ["id", *(f"b{i}" for i in range(SKETCH))])

    return classes.select("id", "tokens").mapInArrow(run, "id long, " + ", ".join(f"b{i} long" for i in range(SKETCH)))


def _can_link(x: str, y: str, params: JoinParams) -> Column:
    """Length and positional filters for two classes that meet under a token."""
    f = lambda side, name: F.col(f"{side}.{name}").cast("long")
    length = 100 * F.least(f(x, "n"), f(y, "n")) >= params.percent * F.greatest(f(x, "n"), f(y, "n"))
    most = F.least(f(x, "j"), f(y, "j")) + 1 + F.least(f(x, "c") - f(x, "j") - 1, f(y, "c") - f(y, "j") - 1)
    return length & ((100 + params.percent) * most >= params.percent * (f(x, "n") + f(y, "n")))


def _alike(x: str, y: str, params: JoinParams) -> Column:
    """Whether sketches allow a link: sets that differ in k cells share at most (c + c - k) / 2 shingles."""
    f = lambda side, name: F.col(f"{side}.{name}").cast("long")
    differ = sum((F.bit_count(f(x, f"b{i}").bitwiseXOR(f(y, f"b{i}"))) for i in range(SKETCH)), F.lit(0))
    return (100 + params.percent) * (f(x, "c") + f(y, "c") - differ) >= 2 * params.percent * (f(x, "n") + f(y, "n"))


def _links(pairs: DataFrame, classes: DataFrame, width: int, params: JoinParams) -> DataFrame:
    """The pairs (a, b) whose shared shingles reach the threshold, by exact intersection after a suffix filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.asarray(batch.column("na")) + np.asarray(batch.column("nb"))
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("ta"), batch.column("tb"), strict=True)):
                a, b = (_wide(np.frombuffer(v.as_buffer(), np.uint8), width) for v in (x, y))
                need = params.percent * int(both[i])
                middle = len(a) // 2
                cut = int(np.searchsorted(b, a[middle]))
                if (100 + params.percent) * (min(middle, cut) + min(len(a) - middle, len(b) - cut)) < need:
                    continue
                if (100 + params.percent) * len(np.intersect1d(a, b, assume_unique=True)) >= need:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], ["a", "b"])

    lists = classes.select("id", "n", "tokens")
    one = pairs.join(lists.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta")), "a")
    return one.join(lists.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb")), "b").select("a", "b", "na", "nb", "ta", "tb").mapInArrow(run, "a long, b long")


def _relabelled(open_: DataFrame, moved: DataFrame) -> DataFrame:
    """open_ with its components replaced by what they are part of, without the tokens whose classes are one component."""
    now = open_.join(moved.select(F.col("id").alias("comp"), "component"), "comp", "left").select("token", "id", "n", "c", "j", F.coalesce("component", "comp").alias("comp"))
    across = now.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    return now.join(across, "token")


def _components(classes: DataFrame, width: int, params: JoinParams) -> DataFrame | None:
    """id and component of classes that link with another."""
    spark = classes.sparkSession
    open_ = written(_prefixes(classes, width, params).withColumn("comp", F.col("id")), "prefixes")
    labels = tested = None

    def compare(pairs: DataFrame) -> tuple[int, int]:
        """Verifies new pairs, merges what links; how many were compared and how many linked."""
        nonlocal open_, labels, tested
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        n = pairs.count()
        if not n:
            return 0, 0
        tested = pairs if tested is None else tested.union(pairs)
        links = written(_links(pairs, classes, width, params), "links")
        release(spark)
        found = links.count()
        if found:
            # between components, so that what is one already does not take part
            of = lambda side: F.col(side) if labels is None else F.coalesce(f"{side}_of", side)
            between = links
            for side in ("a", "b") if labels is not None else ():
                between = between.join(labels.select(F.col("id").alias(side), F.col("component").alias(f"{side}_of")), side, "left")
            moved = written(connected_components(between.select(of("a").alias("a"), of("b").alias("b"))), "moved")
            before, was = labels, open_
            if before is None:
                labels = moved
            else:
                known = before.join(moved.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
                labels = written(known.union(moved.join(before.select("id"), "id", "left_anti").select("id", "component")), "labels")
            open_ = written(_relabelled(was, moved), "open")
            drop_written(was, before, links)
            release(spark)
        return n, found

    r = 0
    while True:
        order = F.col("id") if r == 0 else F.xxhash64("id", F.lit(r))
        hubs = open_.groupBy("token").agg(F.min(F.struct(order.alias("o"), "id", "n", "c", "j", "comp")).alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
        met = open_.alias("x").join(hubs.select("token", "hub.*").alias("y"), "token").filter(F.col("x.comp") != F.col("y.comp")).filter(_can_link("x", "y", params))
        n, found = compare(met.groupBy(F.col("x.id").alias("x")).agg(F.min("y.id").alias("y")))
        if 100 * found <= params.worth * n:
            break
        r += 1
    if not open_.isEmpty():
        # written, so that the join is of two plain sides and Spark can split a token that very many classes have
        drawn = written(open_.join(_sketches(classes, width), "id"), "drawn")
        met = drawn.alias("x").join(drawn.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.comp") != F.col("y.comp")) & _can_link("x", "y", params) & _alike("x", "y", params))
        compare(met.select(F.col("x.id").alias("x"), F.col("y.id").alias("y")))
        drop_written(drawn)
    drop_written(open_, tested)
    return labels


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", params: JoinParams = JoinParams()) -> DataFrame:
    """key (a long), n_shingles and component_id, the smallest key reachable by links, of every row."""
    spark = docs.sparkSession
    rows = written(shingle_classes(docs, key, text, params), "classes")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / params.bucket))
    width = -(-(RANK_BITS + 6 + max(1, (buckets - 1).bit_length())) // 8)
    named = rows.filter("n_shingles > 0").groupBy("s1", "s2").agg(F.min(key).alias("id"))
    packed = _packed_shingles(docs, text, buckets, params)
    able = written(_able_classes(_shared_by_class(packed, buckets, width), buckets, width, params), "able")
    release(spark)
    classes = written(able.join(named, ["s1", "s2"]).filter("id is not null").select("id", "n", "tokens"), "named")
    drop_written(able)
    release(spark)
    labels = _components(classes, width, params)
    ids = named if labels is None else named.join(labels, "id", "left").select("s1", "s2", F.coalesce("component", "id").alias("id"))
    placed = rows.filter("n_shingles > 0").join(ids, ["s1", "s2"], "left").select(key, "n_shingles", F.col("id").alias("component_id"))
    return placed.union(rows.filter("n_shingles = 0").select(key, "n_shingles", F.col(key).alias("component_id")))


def op6_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
