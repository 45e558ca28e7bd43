import random
import re
from collections import Counter

import pytest

from fieldglass.llm.components import connected_components
from fieldglass.llm.ngram_join import jaccard_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_against_brute_force(docs):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstu")
    rows, n = [], 0
    shared = [word() for _ in range(30)]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy = shared + copy
            text = " ".join(copy)
            rows.append((n, text.upper() if rng.random() < 0.2 else text))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "one two"), (n + 4, "One\ttwo"), (n + 5, "one"), (n + 6, "w " * 30_000), (n + 7, "w " * 20_000)]
    assert found(jaccard_components(docs(rows))) == brute(rows)


def test_hot_copies_and_a_chain_of_near_copies(docs):
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base)) for i in range(300)]
    # each variant links with its neighbours only: the component is a path
    for k in range(40):
        rows.append((1000 + k, " ".join([f"v{i}" for i in range(k * 3, k * 3 + 100)])))
    assert found(jaccard_components(docs(rows))) == brute(rows)


@pytest.mark.parametrize("edits", [9, 14])
def test_many_variants_of_one_text(docs, edits):
    # pairs lie about the threshold: links are few or many, and no hub has them all
    rng = random.Random(edits)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(90):
        copy = list(base)
        for i in rng.sample(range(150), rng.randint(0, edits) // 4):
            copy[i] = f"v{rng.randrange(40)}"
        lo = rng.randint(0, edits)
        rows.append((k, " ".join(copy[lo : 150 - rng.randint(0, edits)])))
    assert found(jaccard_components(docs(rows))) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(5, None)], [(1, "a b c d e f"), (1, "a b c d e f")]])
def test_edges(docs, rows):
    out = jaccard_components(docs(rows, extra=True)).collect()
    assert len(out) == len(rows)
    assert all(r["component_id"] == r["doc_id"] for r in out)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(7, 7)]
    root = {}
    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert Counter(got.values())[0] == 61
