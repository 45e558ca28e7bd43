"""SentencePiece encoding and decoding with N-best segmentation.

A text's lattice has an edge for every vocabulary piece that occurs in it; a character that no piece is falls back to
its bytes at a fixed penalty. Forward Viterbi scores are exact heuristics for a backward A* search, so its completions
come in order of score: the first is the best segmentation, the second tells what the next one loses, and so on.

No piece spans the place between another character and a following word mark, nor a line break, so the lattice falls
apart there. Segments are found for a slice of texts at once, each distinct one is searched once, and a text's N best
follow from its segments' N best, since a sum of independent choices among the N best can only replace those with the
smallest losses.

The searches of a slice run in lockstep on arrays: all lattices first, then the forward scores place by place, then the
backward steps. As the heuristics are exact, the edge that each agenda has on top always leads on from the place just
reached, and once a search has its first completion, the top of its agenda is the score of the second. Further
completions, and segments of over LONG bytes, are searched one by one with a heap.

The vocabulary is read from a .model file and never trained. A model of merges has ranks in place of log-probabilities;
by Zipf's law, rank r then counts as -log(r + zipf_offset). Scores are whole multiples of 2 ** -20, so sums are exact.
Ties: of equal segmentations the one that A* completes first, which goes on from the place nearest to the start.

Null and empty texts have no pieces and score 0; decoding the pieces of a text returns it exactly, also with word marks
or control characters in it. Repeated rows stay. Rows are independent: no shuffle, and a lost task just runs again.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytescan import buffers, slices
from .common import table, trim

MARK = "▁"
#: Whole numbers for one unit of score.
UNIT = 1 << 20
#: No segmentation.
NONE = -(1 << 62)
#: Bytes of a segment that is searched by itself.
LONG = 96
#: Bytes of segments that are searched in lockstep, some 100 bytes of arrays for each.
LOCKSTEP_BYTES = 150_000


@dataclass(frozen=True)
class PieceParams:
    """nbest: segmentations searched; zipf_offset: for models of merges; penalty: of a fallback byte, below the lowest
    score; cached: segments whose next completions a worker keeps, some KB each at most; slice_bytes: of text at once (a
    longer text is taken whole)."""

    model: str = "/opt/tokenizers/piece_bpe_32k.model"
    nbest: int = 4
    zipf_offset: float = 100.0
    penalty: float = 10.0
    cached: int = 4_000
    slice_bytes: int = 2_000_000


@dataclass
class Vocabulary:
    """pieces: of text, with id and score in units; bytes_: ids of the 256 fallback pieces; surface: what each id decodes to."""

    pieces: dict[str, tuple[int, int]]
    bytes_: list[int]
    surface: list[bytes]
    penalty: int

    def __post_init__(self):
        self.mark = zlib.crc32(repr((sorted(self.pieces.items()), self.bytes_, self.penalty)).encode())
        self.spans = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces)
        # where pieces do cross a mark, a whole text is one segment
        self.alone = [] if self.spans else [ord(c) for c in "\n\t\r" if not any(c in p for p in self.pieces)]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("tree", "steps")}

    @cached_property
    def tree(self) -> dict:
        """A tree of characters, with a space for the word mark; the empty key holds the piece that ends there. Made where it is used, never sent."""
        root: dict = {}
        for p, found in self.pieces.items():
            node = root
            for c in p.replace(MARK, " "):
                node = node.setdefault(c, {})
            node[""] = found
        return root

    @cached_property
    def steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same tree over bytes as arrays: sorted node * 256 + byte, the node that it leads to, and each node's id (or -1) and score."""
        to: dict[int, int] = {}
        ids, scores = [-1], [0]
        for p, (i, score) in self.pieces.items():
            node = 0
            for c in p.replace(MARK, " ").encode():
                key = node << 8 | c
                node = to.setdefault(key, len(ids))
                if node == len(ids):
                    ids.append(-1)
                    scores.append(0)
            ids[node], scores[node] = i, score
        keys = np.fromiter(to, np.int32, len(to))
        order = np.argsort(keys)
        return keys[order], np.fromiter(to.values(), np.int32, len(to))[order], np.array(ids, np.int32), np.array(scores, np.int64)


def load_vocabulary(params: PieceParams = PieceParams()) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=params.model)
    scores, fallback, surface = {}, [-1] * 256, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            fallback[int(piece[1:-1], 16)] = i
            surface.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            surface.append(b"")
        else:
            scores[piece] = (i, float(model.get_score(i)))
            surface.append(piece.replace(MARK, " ").encode())
    if min(fallback) < 0:
        raise ValueError("the vocabulary has no byte pieces to fall back to")
    usual = [s for _, s in scores.values() if s > -1e8]
    least, ranks = min(usual), all(s == int(s) and s <= 0 for s in usual)
    # pieces that stand outside the scores count as the lowest
    scores = {p: (i, -math.log(params.zipf_offset - max(s, least)) if ranks else max(s, least)) for p, (i, s) in scores.items()}
    lowest = min(s for _, s in scores.values())
    return Vocabulary({p: (i, round(s * UNIT)) for p, (i, s) in scores.items()}, fallback, surface, round((lowest - params.penalty) * UNIT))


def forward(segment: str, v: Vocabulary) -> tuple[list[int], list[list[tuple[int, int, tuple[int, ...], int]]]]:
    """The best score from the start to each place, and the edges that end there: best score with it, start, ids, score."""
    n = len(segment)
    best, ending = [NONE] * (n + 1), [[] for _ in range(n + 1)]
    best[0] = 0
    tree = v.tree
    for i in range(n):
        here, node, j = best[i], tree.get(segment[i]), i + 1
        if node is None or "" not in node:
            raw = segment[i].encode()
            s = v.penalty * len(raw)
            ending[j].append((here + s, i, tuple([v.bytes_[b] for b in raw]), s))
            if here + s > best[j]:
                best[j] = here + s
        while node is not None:
            found = node.get("")
            if found is not None:
                s = found[1]
                ending[j].append((here + s, i, (found[0],), s))
                if here + s > best[j]:
                    best[j] = here + s
            if j >= n:
                break
            node = node.get(segment[j])
            j += 1
    return best, ending


def search(segment: str, v: Vocabulary, n: int) -> list[tuple[int, tuple[int, ...]]]:
    """The n best (score, ids) of a segment, best first, by A* from its end; forward scores tell exactly what is still to come."""
    best, ending = forward(segment, v)
    agenda = [(-best[-1], len(segment), 0, 0, None)]
    out, made = [], 0
    push, pop = heapq.heappush, heapq.heappop
    while agenda:
        _, at, _, done, path = pop(agenda)
        if at == 0:
            ids: list[int] = []
            while path:
                ids += path[0]
                path = path[1]
            out.append((done, tuple(ids)))
            if len(out) == n:
                break
            continue
        for so_far, i, own, s in ending[at]:
            made += 1
            push(agenda, (-(so_far + done), i, made, done + s, (own, path)))
    return out


def lattices(data: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, ...]:
    """The edges of all segments: segment, start and end byte, id (-1: the character's bytes) and score."""
    keys, nodes, piece, value = v.steps
    at = np.flatnonzero((data & 0xC0) != 0x80).astype(np.int32)
    heads = at
    limit = offsets[np.searchsorted(offsets, at, "right")].astype(np.int32)
    node = np.zeros(len(at), np.int32)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    k = 0
    while len(at):
        key = node << 8 | data[at + k]
        i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        go = keys[i] == key
        at, limit, node = at[go], limit[go], nodes[i[go]]
        whole = piece[node] >= 0
        found.append((at[whole], at[whole] + (k + 1), node[whole]))
        k += 1
        go = at + k < limit
        at, limit, node = at[go], limit[go], node[go]
    start, end, node = (np.concatenate([f[i] for f in found]) for i in range(3))
    after = np.append(heads[1:], len(data)).astype(np.int32)
    own = np.zeros(len(data) + 1, bool)
    own[start[end == after[np.searchsorted(heads, start)]]] = True
    bare = ~own[heads]
    spare = (after - heads)[bare]
    start, end = np.concatenate([start, heads[bare]]), np.concatenate([end, after[bare]])
    ids = np.concatenate([piece[node], np.full(len(spare), -1, np.int32)])
    score = np.concatenate([value[node], spare * np.int64(v.penalty)])
    return np.searchsorted(offsets, start, "right") - 1, start, end, ids, score


def lockstep(data: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For segments of LONG bytes at most, none empty: best ids end to end, how many each has, its score, and what the second best loses (-1: there is none)."""
    n = len(offsets) - 1
    seg, start, end, ids, score = lattices(data, offsets, v)
    reach = end - offsets[seg]
    # a place has a slot; a segment's last one is not the next one's first
    order = np.argsort(reach * np.int64(len(data) + n + 1) + end + seg)
    seg, start, end, ids, score, reach = (x[order] for x in (seg, start, end, ids, score, reach))
    into, out = end + seg, start + seg
    nearer = 127 - (start - offsets[seg])
    best = np.full(len(data) + n, NONE)
    best[offsets[:-1] + np.arange(n)] = 0
    top = np.zeros(len(data) + n, np.int64)
    second = np.full(len(data) + n, NONE)
    cuts = np.searchsorted(reach, np.arange(1, int(reach.max()) + 2)).tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        f = best[out[a:b]] + score[a:b]
        # of equal ones the edge from the place nearest to the start
        rank = f * 128 + nearer[a:b]
        slot = into[a:b]
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        size = np.diff(np.append(first, b - a))
        chosen = rank == np.repeat(np.maximum.reduceat(rank, first), size)
        best[slot[first]], top[slot[first]] = f[chosen], a + np.flatnonzero(chosen)
        f[chosen] = NONE
        second[slot[first]] = np.maximum.reduceat(f, first)
    live = np.arange(n)
    at = offsets[1:] + live
    whole = best[at]
    loss = np.full(n, -NONE)
    taken: list[tuple[np.ndarray, np.ndarray]] = []
    while len(live):
        loss[live] = np.minimum(loss[live], np.where(second[at] > NONE // 2, best[at] - second[at], -NONE))
        edge = top[at]
        taken.append((live, edge))
        at = out[edge]
        on = start[edge] > offsets[live]
        live, at = live[on], at[on]
    of, edge = (np.concatenate([t[i] for t in taken[::-1]]) for i in range(2))
    edge = edge[np.argsort(of, kind="stable")]
    size = np.where(ids[edge] < 0, end[edge] - start[edge], 1)
    flat = np.repeat(ids[edge], size)
    bare = np.flatnonzero(flat < 0)
    byte = (np.repeat(start[edge], size) + np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size))[bare]
    flat[bare] = np.array(v.bytes_, np.int32)[data[byte]]
    return flat, np.bincount(seg[edge], weights=size, minlength=n).astype(np.int64), whole, np.where(loss == -NONE, -1, loss)


def segment_starts(data: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> np.ndarray:
    """The byte places at which the segments of all rows start; rows have their word mark (a space) in front."""
    n = len(data)
    start = np.zeros(n + 4, bool)
    start[offsets[:-1]] = True
    if not v.spans:
        space = data == 32
        start[1:n] |= space[1:] & ~space[:-1]
    for c in v.alone:
        own = np.flatnonzero(data == c)
        start[own] = start[own + 1] = True
    # a word mark that is part of the text itself is a segment of its own
    own = np.flatnonzero(data == 0xE2)
    own = own[(own + 2 < n)]
    own = own[(data[own + 1] == 0x96) & (data[own + 2] == 0x81)]
    start[own] = start[own + 3] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """Searches the segments of slices; keeps the next completions of a bounded number of them."""

    def __init__(self, v: Vocabulary, params: PieceParams):
        self.v, self.params = v, params
        self.more: dict[bytes, list[tuple[int, tuple[int, ...]]]] = {}

    def segments(self, coded: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What lockstep returns, for segments of any length."""
        data, offsets = buffers(coded)
        size = np.diff(offsets)
        n = len(size)
        lengths, score, loss = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        short = np.flatnonzero(size <= LONG)
        own, _ = gather(data, size, short)
        cuts = np.concatenate([[0], np.cumsum(size[short])])
        ids = []
        for a, b in slices(cuts, LOCKSTEP_BYTES):
            some = short[a:b]
            flat, lengths[some], score[some], loss[some] = lockstep(own[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a], self.v)
            ids.append(flat)
        order = short
        for k in np.flatnonzero(size > LONG):
            found = search(coded[k].as_py().decode(), self.v, 2)
            lengths[k], score[k], loss[k] = len(found[0][1]), found[0][0], found[0][0] - found[1][0] if len(found) > 1 else -1
            ids.append(np.array(found[0][1], np.int32))
            order = np.append(order, k)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        return gather(flat, lengths[order], np.argsort(order))[0], lengths, score, loss

    def others(self, raw: bytes) -> list[tuple[int, tuple[int, ...]]]:
        """What the next best segmentations lose, and their ids."""
        found = self.more.get(raw)
        if found is None:
            all_ = search(raw.decode(), self.v, self.params.nbest)
            found = [(all_[0][0] - x, ids) for x, ids in all_[1:]]
            if len(raw) <= LONG:
                if len(self.more) >= self.params.cached:
                    self.more.clear()
                self.more[raw] = found
        return found

    def next_best(self, segments: list[tuple[int, bytes]]) -> list[tuple[int, list[tuple[int, tuple[int, ...]]]]]:
        """From (place, segment) of the smallest losses, by rising place: the loss and replacements (place, ids) of each next best text."""
        chosen = [(0, ())]
        for place, raw in segments:
            more = [(loss + d, (*edits, (place, ids))) for loss, edits in chosen for d, ids in self.others(raw)]
            chosen = sorted([*chosen, *more], key=lambda x: (x[0], len(x[1]), x[1]))[: self.params.nbest]
        return [(loss, list(edits)) for loss, edits in chosen[1:]]

    def encode(self, column: pa.Array) -> tuple[pa.ListArray, np.ndarray, list[list[tuple[int, list[tuple[int, int, tuple[int, ...]]]]]]]:
        """For each text its ids, its score, and the next best as (score, edits (at, drop, ids) of its ids)."""
        column = pc.fill_null(column, "")
        space, none = pa.scalar(" ", column.type), pa.scalar("", column.type)
        data, offsets = buffers(pc.if_else(pc.equal(column, none), none, pc.binary_join_element_wise(space, column, none)))
        n = len(column)
        if not len(data):
            return pa.ListArray.from_arrays(pa.array([0] * (n + 1), pa.int32()), pa.array([], pa.int32())), np.zeros(n, np.int64), [[] for _ in range(n)]
        starts = segment_starts(data, offsets, self.v)
        cuts = np.concatenate([starts, [len(data)]]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        own, which = coded.dictionary, coded.indices.to_numpy()
        flat, lengths, score, loss = self.segments(own)
        ids, ends = gather(flat, lengths, which)
        row = np.searchsorted(offsets, starts, "right") - 1
        first = np.searchsorted(row, np.arange(n + 1))
        before = np.concatenate([[0], ends])
        total = np.concatenate([[0], np.cumsum(score[which])])
        lists = pa.ListArray.from_arrays(pa.array(before[first].astype(np.int32)), pa.array(ids))
        # N - 1 single replacements beat any choice that needs a further segment
        able = np.flatnonzero(loss[which] >= 0)
        able = able[np.lexsort((loss[which[able]], row[able]))]
        able = able[np.arange(len(able)) - np.searchsorted(row[able], row[able]) < self.params.nbest - 1]
        able = np.sort(able)
        at = np.searchsorted(row[able], np.arange(n + 1))
        others = []
        for r in range(n):
            some = able[at[r] : at[r + 1]].tolist()
            scored = int(total[first[r + 1]] - total[first[r]])
            others.append([(scored - lost, [(int(before[k] - before[first[r]]), int(before[k + 1] - before[k]), new) for k, new in edits]) for lost, edits in self.next_best([(k, own[int(which[k])].as_py()) for k in some])])
        return lists, total[first[1:]] - total[first[:-1]], others


def gather(flat: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists that lie end to end in flat, put together in the order of `which`; and the end of each."""
    each = lengths[which]
    ends = np.cumsum(each)
    return flat[np.repeat((np.cumsum(lengths) - lengths)[which] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


#: By parameters and vocabulary; one at a time.
_ENCODERS: dict[tuple[PieceParams, int], Encoder] = {}


def encoder(v: Vocabulary, params: PieceParams) -> Encoder:
    """This process's encoder: a worker's later tasks find what earlier ones have learned."""
    found = _ENCODERS.get((params, v.mark))
    if found is None:
        _ENCODERS.clear()
        found = _ENCODERS[params, v.mark] = Encoder(v, params)
    return found


def apply_edits(ids: list[int], edits: list[tuple[int, int, tuple[int, ...]]]) -> list[int]:
    """The ids of another segmentation, from the best ones and its edits."""
    out, at = [], 0
    for where, drop, new in edits:
        out += [*ids[at:where], *new]
        at = where + drop
    return out + list(ids[at:])


def decode(lists: pa.ListArray, surface: list[bytes]) -> pa.Array:
    """The texts of lists of ids; null lists give null. Bytes that are no UTF-8 become replacement characters."""
    n = len(lists)
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.fromiter(map(len, surface), np.int64, len(surface))
    data, ends = gather(np.frombuffer(b"".join(surface), np.uint8), size, ids)
    cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    raw = data.tobytes()
    # the word mark in front is no part of the text
    return pa.array([raw[a + 1 : b].decode("utf-8", "replace") if k else None for a, b, k in zip(cuts[:-1].tolist(), cuts[1:].tolist(), lists.is_valid().to_pylist(), strict=True)] if n else [], pa.string())


EDIT = "array<struct<at:int,drop:int,ids:array<int>>>"


def encode_pieces(docs: DataFrame, v: Vocabulary, params: PieceParams = PieceParams(), text: str = "text") -> DataFrame:
    """docs with piece_ids, piece_score and nbest (the next best segmentations: score, and edits of piece_ids), in place of any columns of those names."""
    keep = [c for c in docs.columns if c not in ("piece_ids", "piece_score", "nbest")]
    edit = pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))]))
    kind = pa.list_(pa.struct([("score", pa.float64()), ("edits", edit)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(v, params)
        for batch in _sliced(batches, text, params):
            lists, scores, others = own.encode(batch.column(text))
            nbest = [[{"score": s / UNIT, "edits": [{"at": a, "drop": d, "ids": new} for a, d, new in edits]} for s, edits in more] for more in others]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists, pa.array(scores / UNIT), pa.array(nbest, kind)], [*keep, "piece_ids", "piece_score", "nbest"])

    schema = T.StructType([*docs.select(*keep).schema.fields, *T._parse_datatype_string(f"piece_ids array<int>, piece_score double, nbest array<struct<score:double,edits:{EDIT}>>").fields])
    return docs.select(*keep).mapInArrow(run, schema)


def _sliced(batches: Iterator[pa.RecordBatch], text: str, params: PieceParams) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, offsets = buffers(batch.column(text))
        for a, b in slices(offsets, params.slice_bytes):
            yield batch.slice(a, b - a)
    trim()


def decode_pieces(rows: DataFrame, v: Vocabulary, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """rows with the text of their pieces; null ids give a null text."""
    keep = [c for c in rows.columns if c != out]
    surface = v.surface

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), decode(batch.column(ids), surface)], [*keep, out])

    return rows.select(*keep).mapInArrow(run, rows.select(*keep).schema.add(out, "string"))


def piece_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", params: PieceParams = PieceParams()) -> DataFrame:
    """key, piece_ids, piece_score, next_scores (of the next best segmentations) and round_trip (whether decoding gives the text back), in one pass."""
    v = load_vocabulary(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(v, params)
        for batch in _sliced(batches, "t", params):
            lists, scores, others = own.encode(batch.column("t"))
            back = pc.equal(decode(lists, v.surface), pc.fill_null(batch.column("t"), "").cast(pa.string()))
            following = pa.array([[s / UNIT for s, _ in more] for more in others], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("k"), lists, pa.array(scores / UNIT), following, back], [key, "piece_ids", "piece_score", "next_scores", "round_trip"])

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *T._parse_datatype_string("piece_ids array<int>, piece_score double, next_scores array<double>, round_trip boolean").fields])
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema)


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = piece_rows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_score", "next_scores", F.xxhash64("piece_ids").alias("ids_hash"), "round_trip")
