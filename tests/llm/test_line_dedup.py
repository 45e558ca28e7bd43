import random
import re

import numpy as np
import pyarrow as pa

from fieldglass.llm import bytescan
from fieldglass.llm.line_dedup import LineParams, dedupe_lines, fingerprints, lines_of, repeated_runs

SENTENCE = "Line {} has a few words that stand together here for once.\n"


def text(tag, n):
    return "".join(SENTENCE.format(f"{tag}{i}") for i in range(n))


def test_passage_goes_from_later_documents_only(docs):
    passage = text("p", 6)
    rows = [(1, text("a", 4) + passage + text("b", 3)), (2, text("c", 2) + passage.upper().replace(" ", "  ") + text("d", 5)), (3, text("e", 9)), (4, text("f", 1) + passage.rstrip("\n"))]
    out = {r["doc_id"]: r["text"] for r in dedupe_lines(docs(rows)).collect()}
    assert out[1] == rows[0][1] and out[3] == rows[2][1]
    assert out[2] == text("c", 2) + text("d", 5)
    assert out[4] == text("f", 1)


def test_short_repeats_and_ties(docs):
    rows = [(1, text("a", 5) + text("x", 1)), (2, text("b", 5) + text("x", 1)), (7, text("q", 8)), (8, text("q", 8)), (9, text("q", 8)), (7, text("q", 8))]
    out = sorted((r["doc_id"], r["text"]) for r in dedupe_lines(docs(rows)).collect())
    assert out == [(1, rows[0][1]), (2, rows[1][1]), (7, text("q", 8)), (7, text("q", 8)), (8, ""), (9, "")]


def test_repeats_within_one_document(docs):
    line = "The same line of words again and again and again.\n"
    out = dedupe_lines(docs([(1, line * 40)])).collect()
    assert out[0]["text"] == line


def test_edges(docs):
    rows = [(1, None), (2, ""), (3, "\n\n \n"), (None, text("n", 9)), (4, text("n", 9)), (5, "w " * 50_000)]
    out = {r["doc_id"]: r["text"] for r in dedupe_lines(docs(rows, extra=True)).collect()}
    assert out == dict(rows)
    assert dedupe_lines(docs([])).count() == 0
    lines = {r["doc"]: (r["n_lines"], r["n_words"]) for r in repeated_runs(docs(rows)).collect()}
    assert lines == {1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (9, 108), 5: (1, 50_000)}


def test_every_shared_run_shares_a_fingerprint():
    rng = np.random.default_rng(2)
    params = LineParams()
    for _ in range(50):
        run = "".join(f"{' '.join(f'r{rng.integers(1e6)}' for _ in range(rng.integers(1, 30)))}.\n" for _ in range(30))
        words = len(run.split())
        assert words >= params.window_words
        prints = []
        for tag in "xy":
            before = "".join(f"{tag}{rng.integers(1e6)} {tag}.\n" for _ in range(rng.integers(0, 40)))
            data, offsets = bytescan.buffers(pa.array([before + run + before]))
            line, n, _, _, rows = lines_of(data, offsets)
            prints.append(set(fingerprints(line, n, rows, params)[1].tolist()))
        assert prints[0] & prints[1]


def brute_lines(docs, least=LineParams().least_words):
    """The lines of each document that lie in a run of enough words which an earlier place holds: every pair of places is tried."""
    lines = {i: [" ".join(x.lower().split()) for x in re.split(r"\n|(?<=[.!?])\s", t) if x.split()] for i, t in docs}
    gone = {i: set() for i in lines}
    for i, mine in lines.items():
        for j, other in lines.items():
            for p in range(len(mine)):
                for q in range(len(other)):
                    if (j, q) >= (i, p):
                        continue
                    k = words = 0
                    while p + k < len(mine) and q + k < len(other) and mine[p + k] == other[q + k]:
                        words += len(mine[p + k].split())
                        k += 1
                    if words >= least:
                        gone[i].update(range(p, p + k))
    return gone


def removed(table):
    return {r["doc"]: {i for x in r["runs"] or [] for i in range(x["first"], x["last"] + 1)} for r in repeated_runs(table).collect()}


def sentence(tag, n):
    return " ".join(f"{tag}{i}" for i in range(n)) + ".\n"


def test_a_copy_goes_whichever_earlier_text_holds_it(docs):
    # the first text shares a sentence only, too short to count; the third is a copy of the second's passage
    cases = [[(1, text("a", 3) + sentence("s", 30) + text("b", 3))] + [(i, text(f"c{i}", 2) + sentence("x", 15) + sentence("s", 30) + sentence("y", 15) + text(f"d{i}", 2)) for i in (2, 3)]]
    rng = random.Random(4)
    for _ in range(6):
        pool = [sentence(f"p{i}q", rng.choice([1, 3, 9, 19, 30, 39, 41])) for i in range(9)]
        cases.append([(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(12)])
    rows = [(100 * k + i, "".join(f"k{k}{x}\n" if x else "" for x in t.split("\n"))) for k, case in enumerate(cases) for i, t in case]
    out = removed(docs(rows))
    for k in range(len(cases)):
        own = [(i, t) for i, t in rows if i // 100 == k]
        assert {i: out[i] for i, _ in own} == brute_lines(own)
    assert out[2] == set() and len(out[3]) == 3


def test_whole_lines_of_the_least_length_go_from_passages_cut_in_mid_sentence(docs):
    # 14 words of a first sentence, whole lines of 40 to 49 words, 8 words of a last one: texts share them verbatim
    rows, want = [], {}
    for k in range(60):
        whole = [10, 10, 10, 10 + k % 10]
        passage = " ".join(f"k{k}a{i}" for i in range(14)) + ".\n" + "".join(sentence(f"k{k}w{i}x", n) for i, n in enumerate(whole)) + " ".join(f"k{k}z{i}" for i in range(8))
        for i in (0, 1):
            rows.append((2 * k + i, text(f"k{k}b{i}", 2) + f"own{k}x{i} words " + passage + f" other{k}x{i} words.\n" + text(f"k{k}c{i}", 2)))
        want |= {2 * k: set(), 2 * k + 1: set(range(3, 7))}
    assert removed(docs(rows)) == want
    # one word fewer stays
    short = [(i, text(f"e{i}", 2) + sentence("f", 20) + sentence("g", 19) + text(f"h{i}", 2)) for i in (1, 2)]
    assert removed(docs(short)) == {1: set(), 2: set()}
