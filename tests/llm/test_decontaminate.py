import random

import pytest

from fieldglass.llm.decontaminate import EditParams, Matcher, budget, drop_leaks, find_leaks, myers, normal


def distance_in(pattern, text):
    """Smallest edit distance to any substring."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[:], i
        for j, c in enumerate(text, 1):
            row[j] = min(last[j - 1] + (p != c), last[j] + 1, row[j - 1] + 1)
    return min(row)


def test_myers_equals_dynamic_programming():
    rng = random.Random(5)
    for _ in range(200):
        pattern = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        masks = {c: sum(1 << i for i, x in enumerate(pattern) if x == c) for c in "abc"}
        got = myers(pattern, masks, text, len(pattern))
        want = distance_in(pattern, text)
        assert (got[0] if got else len(pattern)) == want


def test_matcher_finds_all_within_budget():
    rng = random.Random(9)
    params = EditParams()
    letters = "abcdefghij klm"
    items = [(k, normal("".join(rng.choice(letters) for _ in range(rng.randint(60, 250))))) for k in range(10)]
    matcher = Matcher(items, params)
    for _ in range(80):
        k, item = rng.choice(items)
        copy, edits = list(item), rng.randint(0, budget(len(item), params) + 3)
        for _ in range(edits):
            at = rng.randrange(len(copy))
            kind = rng.randrange(3)
            copy[at : at + (kind != 0)] = "" if kind == 1 else rng.choice("xyz")
        text = normal("".join(rng.choice(letters) for _ in range(300)) + "".join(copy) + "".join(rng.choice(letters) for _ in range(200)))
        want = {i: d for i, t in items if (d := distance_in(t, text)) <= budget(len(t), params)}
        assert {m[0]: m[1] for m in matcher.matches(text)} == want


def test_rows(spark, docs):
    item = "The quick brown fox jumps over the lazy dog, and then it runs away through the wide green field again."
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "Short one")], "item_id long, text string")
    rows = [(1, "before. " + item.upper() + " after"), (2, "x " * 40_000 + item.replace("lazy", "lasy")), (3, None), (4, ""), (5, item[:50]), (6, "a SHORT,one b"), (None, item)]
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in find_leaks(docs(rows, extra=True), items).collect()}
    assert got == {(1, 1, 0), (2, 1, 1), (6, 4, 0), (None, 1, 0)}
    assert {r["doc_id"] for r in drop_leaks(docs(rows), items).collect()} == {3, 4, 5}
    assert find_leaks(docs([]), items).count() == 0 and find_leaks(docs(rows), items.limit(0)).count() == 0
    blocks = EditParams(block=30)
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(docs(rows), items, params=blocks).collect()} == {(a, b) for a, b, _ in got}


@pytest.mark.parametrize("size,k", [(0, 0), (10, 0), (24, 1), (100, 7), (1000, 80)])
def test_budget(size, k):
    assert budget(size, EditParams()) == k
