import random
import re
from collections import Counter

import numpy as np

from fieldglass.llm.licenses import TEMPLATES, bigrams, scan_licenses
from fieldglass.llm.rules import OutlierParams, chi_square_quantile, consistency, judge_quality, robust_distances


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if counts[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def test_counts(spark, docs):
    rng = random.Random(8)
    rows = [(1, None), (2, ""), (3, " \n\t\x0b "), (4, "a b c a b c"), (5, "a a a a a"), (6, "é😀 x#y|z\n\nsame\nsame\n same"), (7, "a b"), (None, "no id here"), (8, "long text " * 20_000), (4, "a b c a b c")]
    rows += [(100 + i, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 60))) + "\nx\n" * rng.randint(0, 3)) for i in range(60)]
    out = judge_quality(docs(rows, extra=True)).collect()
    want = Counter((i, *brute(t)) for i, t in rows)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in out) == want
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] is False if r["base_failed"] else r["kept"] in (True, False)
    assert judge_quality(docs([])).count() == 0


def test_outliers_go_and_clean_rows_stay(spark, docs):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(60, 400)))) for i in range(300)]
    rows += [(1000 + i, " ".join(word() + "###" for _ in range(200))) for i in range(20)]
    rows += [(2000, " ".join(word() * 12 for _ in range(120)))]
    kept = {r["doc_id"]: r["kept"] for r in judge_quality(docs(rows)).collect()}
    assert sum(kept[i] for i in range(300)) >= 298
    assert not any(kept[1000 + i] for i in range(20)) and not kept[2000]


def determinants(x, share, floors, ridge, fall):
    """Squared distances from the least determinant of three starts, one row at a time."""
    d, n = x.shape[1], len(x)
    rank = lambda v, q: np.sort(v)[max(0, int(np.ceil(q * len(v))) - 1)]

    def factor(c):
        out = np.zeros((d, d))
        for i in range(d):
            for j in range(i + 1):
                total = c[i, j] * (1 + ridge) + floors[i] if i == j else c[i, j]
                total -= out[i, :j] @ out[j, :j]
                out[i, j] = np.sqrt(max(total, floors[i])) if i == j else total / out[j, j]
        return out

    def distances(m, f):
        return (np.linalg.solve(f, (x - m).T) ** 2).sum(axis=0)

    q = np.array([[rank(x[:, i], p) for p in (0.25, 0.5, 0.75)] for i in range(d)])
    middle, var = q[:, 1], np.maximum(((q[:, 2] - q[:, 0]) / 1.349) ** 2, floors)
    u = (x - middle) / np.sqrt(var)
    u = u / np.sqrt(np.maximum((u**2).sum(axis=1, keepdims=True), 1e-12))
    starts = [(middle, np.diag(var)), (x.mean(axis=0), np.cov(x.T, bias=True)), (middle, d * (u.T @ u / n) * np.sqrt(np.outer(var, var)))]
    found = []
    for m, c in starts:
        f, det = factor(c), np.inf
        while True:
            far = distances(m, f)
            inner = x[far <= rank(far, share)]
            m2, f2 = inner.mean(axis=0), factor(np.cov(inner.T, bias=True))
            det2 = 2 * np.log(np.diag(f2)).sum()
            stop = not det2 < det + np.log1p(-fall)
            if det2 < det:
                m, f, det = m2, f2, det2
            if stop:
                break
        found.append((det, m, f))
    best = min(found, key=lambda e: e[0])
    return distances(best[1], best[2])


def test_distances_equal_those_of_least_determinants(spark):
    rng = np.random.default_rng(9)
    params, floors = OutlierParams(), [0.05, 0.01, 0.02]
    turn = np.array([[1.0, 0, 0], [0.9, 0.4, 0], [-0.5, 0.2, 0.3]])
    groups = {"a": rng.normal(size=(400, 3)) @ turn.T, "b": np.vstack([rng.normal(size=(200, 3)), rng.normal(8, 0.3, size=(60, 3))]), "c": np.zeros((30, 3)), "d": rng.normal(size=(1, 3))}
    rows = [(g, k, *map(float, r)) for g, x in groups.items() for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, "g string, k int, x0 double, x1 double, x2 double").repartition(3)
    got = {(r["g"], r["k"]): r["distance2"] for r in robust_distances(df, ["g"], 3, floors, params).collect()}
    assert len(got) == len(rows)
    for g, x in groups.items():
        if len(x) > 1:
            want = determinants(x, params.share, floors, params.ridge, params.fall) / consistency(params.share, 3)
            np.testing.assert_allclose([got[g, k] for k in range(len(x))], want, rtol=1e-6, atol=1e-9)
    # what lies apart does not draw the estimate to itself
    assert min(got["b", k] for k in range(200, 260)) > 100 > max(got["b", k] for k in range(200))


def test_consistency_and_quantiles():
    x = np.random.default_rng(2).normal(size=(200_000, 5))
    near = x[np.argsort((x**2).sum(axis=1))[:150_000]]
    assert abs(consistency(0.75, 5) * near.var() - 1) < 0.01
    assert abs((x**2 @ np.ones(5) > chi_square_quantile(0.025, 5)).mean() - 0.025) < 0.002


def test_small_groups_are_pooled(spark, docs):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    rows = [(i, " ".join(word() for _ in range(100))) for i in range(150)]
    table = docs(rows).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 50)).withColumn("lang", F.when(F.col("doc_id") > 3, "en"))
    out = judge_quality(table, params=OutlierParams(least=60)).collect()
    assert len(out) == 150 and np.mean([r["kept"] for r in out]) > 0.97


def test_few_rows_are_judged_with_their_language_else_with_all(spark, docs):
    from pyspark.sql import functions as F

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    clean = lambda: " ".join(word() for _ in range(rng.randint(60, 300)))
    junk = lambda: " ".join(word() * 12 + "###" for _ in range(120))
    rows = [(i, clean()) for i in range(240)] + [(1000, junk()), (1001, clean()), (2000, junk()), (2001, clean()), (3000, junk()), (3001, clean())]
    # a rare source and a null one beside large sources, and a rare language
    source = F.when(F.col("doc_id") < 1000, F.concat(F.lit("s"), F.col("doc_id") % 2)).when(F.col("doc_id") < 2000, "rare").when(F.col("doc_id") >= 3000, "s0")
    table = docs(rows).withColumn("source", source).withColumn("lang", F.when(F.col("doc_id") < 3000, "en").otherwise("xx"))
    out = judge_quality(table).collect()
    kept = {r["doc_id"]: r["kept"] for r in out}
    assert len(out) == len(rows) and not any(r["base_failed"] for r in out)
    assert [kept[i] for i in (1000, 2000, 3000)] == [False] * 3
    assert [kept[i] for i in (1001, 2001, 3001)] == [True] * 3
    assert sum(kept[i] for i in range(240)) >= 238


def test_licenses(docs):
    def dice(a, b):
        a, b = set(bigrams(a)), set(bigrams(b))
        return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0

    mit = TEMPLATES[4][1]
    wrapped = "Intro words here\n\n" + re.sub(r"(.{70}\S*) ", r"\1\n", mit) + "\n\nand more words"
    rows = [(1, None), (2, ""), (3, "nothing to see"), (4, "x\nReleased under the  MIT license!\ny"), (5, wrapped), (6, mit.replace("Software", "Program")), (7, "w " * 50_000 + "\nAll rights reserved."), (8, "all rights"), (4, "x\nReleased under the  MIT license!\ny")]
    out = {r["doc_id"]: r for r in scan_licenses(docs(rows, extra=True)).collect()}
    assert [out[i]["license"] for i in (1, 2, 3, 8)] == [None] * 4
    assert out[4]["license"] == "MIT" and out[4]["dice"] == 1.0
    assert out[5]["license"] == "MIT" and out[5]["n_units"] >= 1
    assert (out[6]["license"] == "MIT") == (dice(rows[5][1], mit) >= 0.8)
    assert out[7]["license"] == "Proprietary"
    assert scan_licenses(docs([])).count() == 0


def test_license_at_the_exact_threshold(docs):
    # two of two bigrams shared by three: a coefficient of 4 / 5
    out = {r["doc_id"]: (r["license"], r["dice"]) for r in scan_licenses(docs([(1, "All rights reserved, all."), (2, "All rights reserved, all of")])).collect()}
    assert out == {1: ("Proprietary", 0.8), 2: (None, 0.0)}


def test_license_units_may_repeat_their_text(docs):
    rows = [(1, " ".join([TEMPLATES[4][1]] * 6)), (2, "Released under the MIT License. " * 500), (3, "Released under the MIT License and other words " * 500), (4, "intro\n" + " ".join([TEMPLATES[4][1]] * 40) + "\nend")]
    out = {r["doc_id"]: r for r in scan_licenses(docs(rows)).collect()}
    assert [out[i]["license"] for i in (1, 2, 3, 4)] == ["MIT", "MIT", None, "MIT"]
    for i in (1, 2):
        own, found = set(bigrams(TEMPLATES[4 if i == 1 else 2][1])), set(bigrams(rows[i - 1][1]))
        assert out[i]["dice"] == round(2 * len(own & found) / (len(own) + len(found)), 6)
