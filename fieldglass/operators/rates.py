"""Conditional outcome rates: per entity against a peer baseline that leaves the entity out. Generic over column names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from ..functions.strings import percent


def class_sums(outcome: str, classes: list[str], value: Column | None = None) -> list[Column]:
    """One conditional sum per class, named c0, c1, ..: a single pass, partial sums before the shuffle."""
    value = F.lit(1).cast("long") if value is None else value
    return [F.sum(F.when(F.col(outcome) == c, value).otherwise(F.lit(0).cast("long"))).alias(f"c{i}") for i, c in enumerate(classes)]


def unpivot_classes(df: DataFrame, keep: list[Column], outcome: str, classes: list[str], **values: str) -> DataFrame:
    """One row per class; values: output name = column prefix. Zeros stay, so every class has a row."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias(outcome), *(F.col(f"{p}{i}").alias(n) for n, p in values.items())) for i, c in enumerate(classes)))).alias("__e")
    return df.select(*keep, each).select("*", "__e.*").drop("__e")


def tendency(df: DataFrame, entity: str, outcome: str, by: list[str], classes: list[str], least: int = 8, floor: float = 0.05) -> DataFrame:
    """AGG-01: rate of each outcome by entity and situation, the peers' rate and the difference.

    Peers are all other rows in the same situation, those of a null entity too: totals by situation minus the entity's
    own, so no self-join of rows. A null situation keeps its rows but has no peers. Cells where neither rate reaches the
    floor go.
    """
    known = df.filter(F.col(outcome).isNotNull())
    own = known.groupBy(entity, *by).agg(F.count(F.lit(1)).alias("n"), *class_sums(outcome, classes))
    whole = Window.partitionBy(*by)
    total = own.withColumns({"all_n": F.sum("n").over(whole), **{f"t{i}": F.sum(f"c{i}").over(whole) for i in range(len(classes))}}).filter((F.col("n") >= least) & F.col(entity).isNotNull())
    known_by = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in by), F.lit(True))
    cells = unpivot_classes(total, [F.col(entity), *map(F.col, by), F.col("n"), F.col("all_n")], outcome, classes, own="c", total="t")
    rate = F.col("own") / F.col("n")
    league = F.when(known_by, F.try_divide(F.col("total") - F.col("own"), F.col("all_n") - F.col("n")))
    out = cells.select(entity, *by, outcome, F.col("n").alias("plays"), rate.alias("rate"), league.alias("league_rate"), (rate - league).alias("delta"))
    return out.filter((F.col("rate") >= floor) | (F.coalesce(F.col("league_rate"), F.lit(0.0)) >= floor))


def outcome_mix(df: DataFrame, entity: str, outcome: str, classes: list[str], weight: Column, least: float = 0.0, rows: str | None = None) -> DataFrame:
    """AGG-02, AGG-05: weighted outcome shares by entity, zeros kept, with raw and effective counts. rows: a count of equal rows that each row stands for."""
    each = F.lit(1).cast("long") if rows is None else F.col(rows)
    weighted = df.filter(F.col(outcome).isNotNull()).withColumns({"__w": weight.cast("double"), "__n": each})
    w = F.col("__w")
    sums = weighted.groupBy(entity).agg(F.sum("__n").alias("n"), F.sum(F.col("__n") * w).alias("w"), F.sum(F.col("__n") * w * w).alias("ww"), *class_sums(outcome, classes, F.col("__n") * w))
    sums = sums.withColumn("n_eff", F.try_divide(F.col("w") * F.col("w"), F.col("ww")))
    cells = unpivot_classes(sums.filter(F.col("w") > least), [F.col(entity), F.col("n"), F.col("w"), F.col("n_eff")], outcome, classes, own="c")
    return cells.select(entity, outcome, "n", "n_eff", F.try_divide(F.col("own"), F.col("w")).alias("rate"), (F.try_divide(F.col("own"), F.col("w")) * F.col("n_eff")).alias("k_eff"))


def peer_mix(df: DataFrame, entity: str, outcome: str, classes: list[str]) -> DataFrame:
    """AGG-03: for each entity the outcome shares of all others. Null entities count among the others."""
    own = df.filter(F.col(outcome).isNotNull()).groupBy(entity).agg(F.count(F.lit(1)).alias("n"), *class_sums(outcome, classes))
    totals = own.agg(F.sum("n").alias("all_n"), *(F.sum(f"c{i}").alias(f"t{i}") for i in range(len(classes))))
    both = own.filter(F.col(entity).isNotNull()).crossJoin(F.broadcast(totals))  # one row
    cells = unpivot_classes(both, [F.col(entity), F.col("n"), F.col("all_n")], outcome, classes, own="c", total="t")
    return cells.select(entity, outcome, F.try_divide(F.col("total") - F.col("own"), F.col("all_n") - F.col("n")).alias("peer_rate"))


def opponent_adjusted(df: DataFrame, entity: str, opponent: str, outcome: str, classes: list[str], least: int = 20) -> DataFrame:
    """AGG-11: raw rate, rate expected from the opponents met, and the difference to the league's.

    What an opponent draws is taken from all other rows against it, those of a null entity too; under `least` such rows
    the league, which is all rows, stands in. Rows without an opponent count in raw and not in expected; an entity that
    met none is expected to be the league's mean.
    """
    known = df.filter(F.col(outcome).isNotNull())
    pairs = known.groupBy(entity, opponent).agg(F.count(F.lit(1)).alias("n"), *class_sums(outcome, classes))
    k = range(len(classes))
    by_opponent = Window.partitionBy(opponent)
    total = pairs.agg(F.sum("n").alias("all_n"), *(F.sum(f"c{i}").alias(f"a{i}") for i in k))
    wide = pairs.withColumns({"opp_n": F.sum("n").over(by_opponent) - F.col("n"), **{f"o{i}": F.sum(f"c{i}").over(by_opponent) - F.col(f"c{i}") for i in k}})
    wide = wide.filter(F.col(entity).isNotNull()).crossJoin(F.broadcast(total))  # one row
    league = lambda i: F.try_divide(F.col(f"a{i}"), F.col("all_n"))
    met = F.col(opponent).isNotNull()
    aggs = [F.sum("n").alias("n"), F.sum(F.when(met, F.col("n"))).alias("met")]
    for i in k:
        draws = F.when(F.col("opp_n") >= least, F.col(f"o{i}") / F.col("opp_n")).otherwise(league(i))
        aggs += [(F.sum(f"c{i}") / F.sum("n")).alias(f"r{i}"), F.sum(F.when(met, draws * F.col("n"))).alias(f"x{i}"), F.max(league(i)).alias(f"l{i}")]
    cells = unpivot_classes(wide.groupBy(entity).agg(*aggs), [F.col(entity), F.col("n"), F.col("met")], outcome, classes, raw="r", drawn="x", league="l")
    expected = F.coalesce(F.try_divide(F.col("drawn"), F.col("met")), F.col("league"))
    return cells.select(entity, outcome, "n", "raw", expected.alias("expected"), (F.col("raw") - expected + F.col("league")).alias("adjusted"), "league", (expected - F.col("league")).alias("schedule_effect"))


def halves(df: DataFrame, entity: str, outcome: str, week: str, classes: list[str], least: float = 0.08, least_weeks: int = 4, most: int = 4) -> DataFrame:
    """AGG-12: outcome shares before and from the middle distinct week of each entity with enough weeks, where they moved: the first `most` by the order of classes, each with a sentence.

    Rows without an outcome or week take no part.
    """
    k = range(len(classes))
    known = df.filter(F.col(outcome).isNotNull() & F.col(week).isNotNull() & F.col(entity).isNotNull())
    weekly = known.groupBy(entity, week).agg(F.count(F.lit(1)).alias("n"), *class_sums(outcome, classes))
    order, whole = Window.partitionBy(entity).orderBy(week), Window.partitionBy(entity)
    placed = weekly.withColumns({"__nth": F.row_number().over(order), "__weeks": F.count(F.lit(1)).over(whole)}).filter(F.col("__weeks") >= least_weeks)
    late = F.col("__nth") > F.floor(F.col("__weeks") / 2)
    part = lambda c, side: F.sum(F.when(side, F.col(c)).otherwise(0))
    sums = placed.groupBy(entity).agg(F.min(F.when(late, F.col(week))).alias("cut"), part("n", ~late).alias("n1"), part("n", late).alias("n2"), *(part(f"c{i}", ~late).alias(f"f{i}") for i in k), *(part(f"c{i}", late).alias(f"s{i}") for i in k), *(F.max(F.lit(i)).alias(f"o{i}") for i in k))
    cells = unpivot_classes(sums, [F.col(entity), F.col("cut"), F.col("n1"), F.col("n2")], outcome, classes, f="f", s="s", nth="o")
    first, second = F.col("f") / F.col("n1"), F.col("s") / F.col("n2")
    moved = cells.withColumns({"first_rate": first, "second_rate": second}).filter((F.abs(F.col("second_rate") - F.col("first_rate")) >= least) & (F.greatest("first_rate", "second_rate") >= least))
    top = moved.withColumn("__rn", F.row_number().over(Window.partitionBy(entity).orderBy("nth"))).filter(F.col("__rn") <= most)
    way = F.when(F.col("second_rate") > F.col("first_rate"), "up").otherwise("down")
    line = F.concat(F.col(outcome), F.lit(" is "), way, F.lit(" from "), percent(F.col("first_rate")), F.lit(" in the first half of the season to "), percent(F.col("second_rate")), F.lit(" since week "), F.col("cut").cast("long").cast("string"), F.lit("."))
    return top.select(entity, outcome, "first_rate", "second_rate", line.alias("line"))


def situational_value(df: DataFrame, keys: list[str], values: dict[str, Column], least: int = 8) -> DataFrame:
    """AGG-08, AGG-09: count and mean values of situations without null keys that occur often enough."""
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    return df.filter(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("plays"), *(F.avg(v).alias(n) for n, v in values.items())).filter(F.col("plays") >= least)


def scheme_splits(df: DataFrame, entity: str, outcome: str, week: str, classes: list[str], margin: int = 3, least: int = 30) -> DataFrame:
    """AGG-13, WIN-17: for every candidate split week, `margin` weeks or more from either end, the chi-square statistic of outcomes before against after, with the correction for continuity at one degree of freedom.

    Weekly counts are cumulated by window, so rows are read once whatever the number of splits.
    """
    k = range(len(classes))
    weekly = df.filter(F.col(outcome).isNotNull() & F.col(week).isNotNull()).groupBy(entity, week).agg(F.count(F.lit(1)).alias("n"), *class_sums(outcome, classes))
    upto = Window.partitionBy(entity).orderBy(week).rowsBetween(Window.unboundedPreceding, -1)
    whole, order = Window.partitionBy(entity), Window.partitionBy(entity).orderBy(week)
    sums = weekly.select(
        entity, week, F.row_number().over(order).alias("nth"), F.count(F.lit(1)).over(whole).alias("weeks"),
        F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total"),
        *(F.coalesce(F.sum(f"c{i}").over(upto), F.lit(0)).alias(f"b{i}") for i in k), *(F.sum(f"c{i}").over(whole).alias(f"t{i}") for i in k),
    )
    after = F.col("total") - F.col("before")
    terms, corrected, present = [], [], []
    for i in k:
        share, x, y = F.col(f"t{i}") / F.col("total"), F.col(f"b{i}"), F.col(f"t{i}") - F.col(f"b{i}")
        both = [(F.abs(v - share * m), share * m) for v, m in ((x, F.col("before")), (y, after))]
        terms += [F.coalesce(F.try_divide(off * off, due), F.lit(0.0)) for off, due in both]
        corrected += [F.coalesce(F.try_divide(F.pow(F.greatest(off - 0.5, F.lit(0.0)), 2), due), F.lit(0.0)) for off, due in both]
        present.append((F.col(f"t{i}") > 0).cast("int"))
    add = lambda many: reduce(lambda a, b: a + b, many)
    df_ = add(present) - 1
    inside = (F.col("nth") > margin) & (F.col("nth") <= F.col("weeks") - margin + 1)
    out = sums.filter(inside).select(entity, week, "before", after.alias("after"), F.count(F.lit(1)).over(whole).alias("candidates"), F.when(df_ == 1, add(corrected)).otherwise(add(terms)).alias("chi2"), df_.alias("df"))
    return out.filter((F.col("before") >= least) & (F.col("after") >= least) & (F.col("df") >= 1))


def detect_scheme_change(df: DataFrame, entity: str, outcome: str, week: str, classes: list[str], alpha: float = 0.01, margin: int = 3, least: int = 30) -> DataFrame:
    """AGG-13: the split with the smallest Bonferroni-adjusted p by entity, where significant; the earliest of ties."""
    p = F.least(F.lit(1.0), stats.chi_square_p(F.col("chi2"), F.col("df")) * F.col("candidates"))
    splits = scheme_splits(df, entity, outcome, week, classes, margin, least).withColumn("p", p)
    return splits.groupBy(entity).agg(F.min(F.struct("p", week, "chi2")).alias("best")).select(entity, "best.*").filter(F.col("p") < alpha)


def family_split(mix: DataFrame, entity: str, outcome: str, rate: str, families: dict[str, str], count: str = "n") -> DataFrame:
    """AGG-44: shares summed over families of outcomes, with the difference to the league's: the shares of all rows."""
    family = reduce(lambda acc, kv: acc.when(F.col(outcome) == kv[0], kv[1]), families.items(), F.when(F.lit(False), ""))
    sums = mix.withColumn("family", family).filter("family is not null").groupBy(entity, "family").agg(F.sum(rate).alias("share"), F.max(count).alias("__n"))
    every = Window.partitionBy("family")
    return sums.withColumn("delta", F.col("share") - F.sum(F.col("share") * F.col("__n")).over(every) / F.sum("__n").over(every)).drop("__n")
