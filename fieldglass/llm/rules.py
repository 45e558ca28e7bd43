"""Quality rules: base counts, then robust multivariate outliers per language and source. DataFrame functions only.

Minimum covariance determinant: each group starts from three estimates (medians with quartile ranges; means and
covariances of all rows; medians with the covariance of the rows' directions from them). Concentration steps give each
start the mean and covariance of the `share` of rows nearest to it, until its determinant no longer falls; the least
determinant of the three is the group's estimate. A consistency factor makes distances those of a normal law, so that
squared ones follow the chi-square law, and a row is kept if its base rules hold and its squared distance stays under
the quantile that leaves out `level`. All rows of a group take part in every step; only a few numbers of each group are
joined back. A step's limit is an approximate quantile: exact up to 10,000 rows of a group, within 1 / 10,000 beyond.

Groups without enough rows are judged by the estimate of their whole language, else by that of all rows that pass the
base, however few; floors stand in for missing spread. Null languages and sources form groups of their own. Null and
empty texts have zero counts and fail the base. Repeated rows count, and are judged, as often as they occur; rows of
equal statistics get equal verdicts.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import chi_square_tail
from .common import drop_written, release, table, written

#: White space, and the symbols that count.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class OutlierParams:
    """share: of a group's rows in an estimate; level: share of rows of a normal law that would go; least: rows that a group
    needs; ridge: added to variances, relatively; fall: of a determinant, relatively, that counts as one; most_sent: groups
    whose estimates (some 25 numbers each) may be broadcast."""

    share: float = 0.75
    level: float = 1e-9
    least: int = 100
    fall: float = 1e-3
    ridge: float = 1e-3
    most_sent: int = 20_000


def base_counts(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of whole texts."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def repeated(w: Column) -> Column:
        # hashes of the 3-word windows with their places, sorted: equal neighbours are windows found twice or more
        windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))
        twice = F.transform(F.array(windows), lambda s: F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])))[0]
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    # a one-element array binds a value once; a plain alias would be put back into the lambda and computed for each word
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long"),
        "n_repeat_words": F.transform(F.array(words), lambda w: F.when(F.size(w) < 4, 0).otherwise(repeated(w)))[0].cast("long"),
    }


#: Transformed statistics, over the base counts, and the least variance of each that counts as ordinary: where hardly any text has a repeated line, one such line is still no outlier.
FLOORS = (0.05, 0.01, 0.02, 0.1, 0.01)


def transformed() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log1p(F.col("n_words").cast("double")),
        F.col("word_chars") / n,
        F.log1p(100.0 * F.col("n_symbols") / n),
        F.log1p(1.0 * F.col("n_dup_lines")),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


def _pairs(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i + 1)]


def _moments(rows: DataFrame, by: list[str], centres: DataFrame, d: int) -> DataFrame:
    """Means m0.. and covariances c00.. by group, of rows that hold their differences d0.. to the group's centre m0..: partial sums, one row per group."""
    sums = rows.groupBy(*by).agg(*(F.avg(f"d{i}").alias(f"a{i}") for i in range(d)), *(F.avg(F.col(f"d{i}") * F.col(f"d{j}")).alias(f"p{i}{j}") for i, j in _pairs(d)))
    both = sums.join(centres.select(*by, *(F.col(f"m{i}").alias(f"o{i}") for i in range(d))), by)
    return both.select(*by, *((F.col(f"o{i}") + F.col(f"a{i}")).alias(f"m{i}") for i in range(d)), *((F.col(f"p{i}{j}") - F.col(f"a{i}") * F.col(f"a{j}")).alias(f"c{i}{j}") for i, j in _pairs(d)))


def _triangle(d: int, step: Callable[[Column, Column, Column, Callable[[Column, Callable], Column]], Column]) -> Column:
    """The entries of a lower triangle, row by row; step gives one from the place (i, j), those before it, and a sum over k < upto."""

    def total(upto: Column, term: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.filter(F.array(*(F.lit(k) for k in range(d))), lambda k: k < upto), F.lit(0.0), lambda s, k: s + term(k))

    places = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _pairs(d)))
    return F.aggregate(places, F.array().cast("array<double>"), lambda done, q: F.concat(done, F.array(step(q["i"], q["j"], done, total))))


def _at(i: Column, j: Column) -> Column:
    """Where a lower triangle that lies row by row has (i, j)."""
    return (i * (i + 1) / 2).cast("int") + j


def _with_factor(estimates: DataFrame, d: int, floors: list[float], ridge: float) -> DataFrame:
    """Adds __l, the Cholesky factor of c00.., and __k, its inverse, as arrays; a floor on each variance keeps it regular."""
    c, least = F.array(*(F.col(f"c{i}{j}") for i, j in _pairs(d))), F.array(*(F.lit(float(x)) for x in floors))

    def factor(i, j, done, total):
        rest = F.get(c, _at(i, j)) - total(j, lambda k: F.get(done, _at(i, k)) * F.get(done, _at(j, k)))
        return F.when(i == j, F.sqrt(F.greatest(rest + F.get(c, _at(i, i)) * ridge + F.get(least, i), F.get(least, i)))).otherwise(rest / F.get(done, _at(j, j)))

    def inverse(i, j, done, total):
        l = F.col("__l")  # noqa: E741
        # sums over j <= k < i
        rest = total(i, lambda k: F.when(k >= j, F.get(l, _at(i, k)) * F.get(done, _at(k, j))).otherwise(0.0))
        return (F.when(i == j, 1.0).otherwise(0.0) - rest) / F.get(l, _at(i, i))

    return estimates.withColumn("__l", _triangle(d, factor)).withColumn("__k", _triangle(d, inverse))


def chi_square_quantile(p_above: float, df: int) -> float:
    """The value that the chi-square law exceeds with probability p_above."""
    lo, hi = 0.0, 1.0
    while chi_square_tail(hi, df) > p_above:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_tail(mid, df) > p_above else (lo, mid)
    return hi


def consistency(share: float, d: int) -> float:
    """What the covariance of the nearest `share` of rows of a normal law lacks."""
    return share / (1 - chi_square_tail(chi_square_quantile(1 - share, d), d + 2))


def _starts(rows: DataFrame, by: list[str], d: int, floors: list[float], sent: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Three estimates (m0.., c00..) for each group, numbered by __start."""
    quartiles = [F.percentile_approx(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10_000).alias(f"q{i}") for i in range(d)]
    centre = rows.groupBy(*by).agg(*quartiles).select(*by, *(F.col(f"q{i}")[1].alias(f"m{i}") for i in range(d)), *(F.greatest(F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2), F.lit(floors[i])).alias(f"v{i}") for i in range(d)))
    centre = written(centre, "centre")
    names = [*by, "__start", *(f"m{i}" for i in range(d)), *(f"c{i}{j}" for i, j in _pairs(d))]
    plain = centre.withColumn("__start", F.lit(0)).withColumns({f"c{i}{j}": F.col(f"v{i}") if i == j else F.lit(0.0) for i, j in _pairs(d)})
    apart = rows.join(sent(centre), by).withColumns({f"d{i}": F.col(f"x{i}") - F.col(f"m{i}") for i in range(d)})
    whole = _moments(apart, by, centre, d).withColumn("__start", F.lit(1))
    away = {f"u{i}": F.col(f"d{i}") / F.sqrt(f"v{i}") for i in range(d)}
    signs = apart.select(*by, *(u.alias(n) for n, u in away.items())).withColumn("r", F.greatest(sum((F.col(n) * F.col(n) for n in away), F.lit(0.0)), F.lit(1e-12)))
    shares = signs.groupBy(*by).agg(*(F.avg(F.col(f"u{i}") * F.col(f"u{j}") / F.col("r")).alias(f"s{i}{j}") for i, j in _pairs(d)))
    turned = shares.join(centre, by).withColumn("__start", F.lit(2)).withColumns({f"c{i}{j}": d * F.col(f"s{i}{j}") * F.sqrt(F.col(f"v{i}") * F.col(f"v{j}")) for i, j in _pairs(d)})
    return plain.select(names).unionByName(whole.select(names)).unionByName(turned.select(names))


def robust_distances(rows: DataFrame, by: list[str], d: int, floors: list[float], params: OutlierParams = OutlierParams()) -> DataFrame:
    """rows (with x0.. and no nulls in by) with distance2, squared and consistent, from the estimate of least determinant of their group."""
    # few enough groups go to every task, so that a hot group's rows need not meet in one; beyond that Spark joins by shuffle and splits what is skewed
    groups = rows.select(*by).distinct().limit(params.most_sent + 1).count()
    sent = F.broadcast if groups <= params.most_sent else (lambda df: df)
    spread = [*(f"m{i}" for i in range(d)), *(f"k{i}{j}" for i, j in _pairs(d))]
    keys = [*by, "__start"]

    def factored(estimates: DataFrame) -> DataFrame:
        """Estimates with the inverted factor of their covariance, and the logarithm of its determinant."""
        found = _with_factor(estimates, d, floors, params.ridge)
        det = sum((2 * F.log(F.get("__l", _pairs(d).index((i, i)))) for i in range(d)), F.lit(0.0))
        return found.select(*keys, *(f"m{i}" for i in range(d)), *(F.get("__k", n).alias(f"k{i}{j}") for n, (i, j) in enumerate(_pairs(d))), det.alias("__det"))

    def measured(estimates: DataFrame) -> DataFrame:
        apart = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(d)]
        steps = [sum((F.col(f"k{i}{j}") * apart[j] for j in range(1, i + 1)), F.col(f"k{i}0") * apart[0]) for i in range(d)]
        return rows.join(sent(estimates), by).withColumn("distance2", sum((y * y for y in steps[1:]), steps[0] * steps[0]))

    now = written(factored(_starts(rows, by, d, floors, sent)).withColumns({"__det": F.lit(float("inf")), "__moves": F.lit(True)}), "mcd")
    while True:
        moving = now.filter("__moves")
        near = measured(moving.select(*keys, *spread)).select(*keys, *((F.col(f"x{i}") - F.col(f"m{i}")).alias(f"d{i}") for i in range(d)), "distance2")
        limit = near.groupBy(*keys).agg(F.percentile_approx("distance2", F.lit(params.share), 10_000).alias("__limit"))
        inner = near.join(sent(limit), keys).filter(F.col("distance2") <= F.col("__limit"))
        better = factored(_moments(inner, keys, moving, d)).withColumnRenamed("__det", "__new")
        # a fall below the tolerance ends a start; its better estimate of the two stays
        step = moving.select(*keys, "__det").join(better, keys).withColumn("__moves", F.col("__new") < F.col("__det") + math.log1p(-params.fall))
        lower = step.filter("__new < __det").select(*keys, *spread, F.col("__new").alias("__det"), "__moves")
        before = now
        now = written(lower.unionByName(before.join(lower.select(keys), keys, "left_anti").withColumn("__moves", F.lit(False))), "mcd")
        drop_written(before)
        release(rows.sparkSession)
        if now.filter("__moves").isEmpty():
            break
    best = now.groupBy(*by).agg(F.min(F.struct("__det", "__start", *spread)).alias("e")).select(*by, *(F.col(f"e.{c}").alias(c) for c in spread))
    return measured(best).withColumn("distance2", F.col("distance2") / consistency(params.share, d)).select(*rows.columns, "distance2")


def _levels(rows: DataFrame, groups: list[str], params: OutlierParams) -> DataFrame:
    """rows under each level whose estimate they take part in, __own where it judges them.

    Level k groups by the first k columns: a row's own is the largest k with enough rows, else 0, that is all of them.
    All rows of a group of level k come in where it judges some of them.
    """
    sizes = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"))
    for k in range(len(groups) - 1, 0, -1):
        sizes = sizes.join(sizes.groupBy(*groups[:k]).agg(F.sum("__n").alias(f"__n{k}")), groups[:k])
    own = F.when(F.col("__n") >= params.least, len(groups))
    for k in range(len(groups) - 1, 0, -1):
        own = own.when(F.col(f"__n{k}") >= params.least, k)
    levels = written(sizes.select(*groups, own.otherwise(0).alias("__own_level")), "levels")
    sent = F.broadcast if levels.limit(params.most_sent + 1).count() <= params.most_sent else (lambda df: df)
    placed = rows.join(sent(levels), groups)
    out = placed.filter(F.col("__own_level") == len(groups)).withColumn("__level", F.lit(len(groups)))
    for k in range(len(groups) - 1, -1, -1):
        wanted = levels.filter(F.col("__own_level") == k)
        if wanted.isEmpty():
            continue
        part = placed.join(sent(wanted.select(*groups[:k]).distinct()), groups[:k], "left_semi") if k else placed
        out = out.unionByName(part.withColumn("__level", F.lit(k)).withColumns({g: F.lit("") for g in groups[k:]}))
    return out.withColumn("__own", F.col("__level") == F.col("__own_level")).drop("__own_level")


def judge_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", by: tuple[str, ...] = ("lang", "source"), params: OutlierParams = OutlierParams()) -> DataFrame:
    """key, the base counts, base_failed, distance2 and kept of every row."""
    counts = docs.select(F.col(key).alias(key), *(F.coalesce(F.col(c).cast("string"), F.lit("\x00null")).alias(f"g{i}") for i, c in enumerate(by)), *(c.alias(n) for n, c in base_counts(F.col(text)).items()))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = written(counts.withColumn("base_failed", failed), "counts")
    stats = transformed()
    rows = counts.withColumns({f"x{i}": s.cast("double") for i, s in enumerate(stats)})
    groups = [f"g{i}" for i in range(len(by))]
    passing = rows.filter(~F.col("base_failed")).select(key, *groups, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *(f"x{i}" for i in range(len(stats))))
    judged = robust_distances(_levels(passing, groups, params), ["__level", *groups], len(stats), list(FLOORS), params).filter("__own")
    final = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    good = judged.select(key, *final, "distance2", (F.col("distance2") <= chi_square_quantile(params.level, len(stats))).alias("kept"))
    bad = rows.filter("base_failed").select(key, *final, F.lit(None).cast("double").alias("distance2"), F.lit(False).alias("kept"))
    return good.unionByName(bad)


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"))
