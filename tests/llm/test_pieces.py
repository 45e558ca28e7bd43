import itertools
import random

import pyarrow as pa
import pytest

from fieldglass.llm.pieces import MARK, UNIT, Encoder, PieceParams, apply_edits, buffers, decode, decode_pieces, encode_pieces, load_vocabulary, piece_rows, search, segment_starts

TEXTS = [(1, "plain text."), (2, "▁ marks ▁▁ and \x00▁ too"), (3, "  spaces  \n\n\t tabs\r\n"), (4, "é ñ 漢字 😀 ‍"), (5, ""), (6, None), (7, "long " * 30_000), (8, "x" * 20_000), (None, "no id"), (1, "plain text."), (9, "▁"), (10, "a▁b▁"), (11, "\n"), (12, " "), (13, "\xe2\x96 x")]


@pytest.fixture(scope="module")
def vocabulary():
    return load_vocabulary()


def all_segmentations(s, v):
    """Every path of the lattice."""
    if not s:
        return [(0, ())]
    out = []
    for j in range(1, len(s) + 1):
        if s[:j] in v.pieces:
            i, score = v.pieces[s[:j]]
            out += [(score + x, (i, *ids)) for x, ids in all_segmentations(s[j:], v)]
    if s[0] not in v.pieces:
        raw = s[0].encode()
        out += [(v.penalty * len(raw) + x, (*(v.bytes_[b] for b in raw), *ids)) for x, ids in all_segmentations(s[1:], v)]
    return out


def test_search_equals_enumeration(vocabulary):
    rng = random.Random(4)
    for _ in range(60):
        s = MARK + "".join(rng.choice("theinaro😀é") for _ in range(rng.randint(1, 8)))
        every = sorted((x for x, _ in all_segmentations(s, vocabulary)), reverse=True)
        got = search(s.replace(MARK, " "), vocabulary, 6)
        assert [x for x, _ in got] == every[:6]
        assert len({ids for _, ids in got}) == len(got)
        words = pa.array([s.replace(MARK, " ").encode(), b"\xe2\x96\x81", b" " + b"la" * 60, s.encode()])
        ids, lengths, score, loss = Encoder(vocabulary, PieceParams()).segments(words)
        assert (score[0], tuple(ids[: lengths[0]])) == got[0]
        assert loss[0] == (every[0] - every[1] if len(every) > 1 else -1)
        assert list(ids[lengths[0] : lengths[0] + 3]) == [vocabulary.bytes_[b] for b in b"\xe2\x96\x81"] and loss[1] == -1
        long = search(" " + "la" * 60, vocabulary, 2)
        assert (score[2], tuple(ids[lengths[:2].sum() : lengths[:3].sum()]), loss[2]) == (*long[0], long[0][0] - long[1][0])


def test_lockstep_equals_single_searches(vocabulary):
    rng = random.Random(6)
    words = sorted({" " + "".join(rng.choice("theinaro😀é漢.,s") for _ in range(rng.randint(0, 20))) for _ in range(400)})
    ids, lengths, score, loss = Encoder(vocabulary, PieceParams()).segments(pa.array([w.encode() for w in words]))
    at = 0
    for k, w in enumerate(words):
        found = search(w, vocabulary, 2)
        assert (score[k], tuple(ids[at : at + lengths[k]])) == found[0]
        assert loss[k] == (found[0][0] - found[1][0] if len(found) > 1 else -1)
        at += lengths[k]


def test_whole_texts_equal_enumeration(vocabulary):
    # the lattice of a whole text, with pieces free to lie anywhere in it
    rng = random.Random(5)
    texts = ["to be", "a\nb the", "of", "the  in", "in\tit", *("".join(rng.choice("theinr \n") for _ in range(rng.randint(1, 11))) for _ in range(40))]
    encoder = Encoder(vocabulary, PieceParams(nbest=6))
    lists, scores, others = encoder.encode(pa.array(texts))
    for text, ids, score, more in zip(texts, lists.to_pylist(), scores, others, strict=True):
        every = sorted((x for x, _ in all_segmentations(MARK + text.replace(" ", MARK), vocabulary)), reverse=True)
        assert [score, *(s for s, _ in more)] == every[:6], text
        found = [ids, *(apply_edits(ids, edits) for _, edits in more)]
        assert len({tuple(x) for x in found}) == len(found)
        cost = {i: s for i, s in vocabulary.pieces.values()} | dict.fromkeys(vocabulary.bytes_, vocabulary.penalty)
        assert [sum(cost[i] for i in x) for x in found] == every[: len(found)]
        assert decode(pa.array(found, pa.list_(pa.int32())), vocabulary.surface).to_pylist() == [text] * len(found)


def test_ties_stay_few(vocabulary):
    for s in ("a" * 3000, "it" * 500, "=-" * 2000):
        found = search(" " + s, vocabulary, 8)
        assert len(found) == 8 and [x for x, _ in found] == sorted((x for x, _ in found), reverse=True)


def test_segments_join_to_the_text(vocabulary):
    data, offsets = buffers(pa.array([" a  b\n c", "", " \t▁x", " "]))
    starts = segment_starts(data, offsets, vocabulary)
    cuts = [*starts.tolist(), len(data)]
    assert [bytes(data[a:b]).decode() for a, b in itertools.pairwise(cuts)] == [" a", "  b", "\n", " c", " ", "\t", "▁", "x", " "]


def test_cache_is_bounded(vocabulary):
    encoder = Encoder(vocabulary, PieceParams(cached=50))
    texts = pa.array([" ".join(f"w{i}x{j}" for j in range(40)) for i in range(100)])
    found = encoder.encode(texts)
    assert len(encoder.more) <= 50
    other = Encoder(vocabulary, PieceParams()).encode(texts)
    assert found[0].to_pylist() == other[0].to_pylist() and found[2] == other[2]


def test_scores_of_merges(vocabulary):
    # by Zipf's law: what was merged first scores highest
    assert vocabulary.pieces["▁t"][1] > vocabulary.pieces["▁the"][1] > vocabulary.pieces["z"][1]
    assert all(isinstance(s, int) and s < 0 for _, s in vocabulary.pieces.values()) and vocabulary.penalty < -10 * UNIT


def test_round_trip(spark, docs, vocabulary):
    out = piece_rows(docs(TEXTS, extra=True)).collect()
    assert len(out) == len(TEXTS) and all(r["round_trip"] for r in out)
    empty = [r for r in out if r["doc_id"] in (5, 6)]
    assert all(r["piece_ids"] == [] and r["piece_score"] == 0 and r["next_scores"] == [] for r in empty)
    assert piece_rows(docs([])).count() == 0
    coded = encode_pieces(docs(TEXTS, extra=True), vocabulary)
    assert {r["decoded"] for r in decode_pieces(coded, vocabulary).collect()} == {t or "" for _, t in TEXTS}


def test_agrees_with_the_library(vocabulary):
    # the library applies merges one by one, the lattice adds scores: most pieces of usual words are the same
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PieceParams().model)
    text = "the people of this country have made a new law and the world was waiting for some time to see it"
    lists, _, _ = Encoder(vocabulary, PieceParams()).encode(pa.array([text]))
    assert lists[0].as_py() == model.encode(text)
