"""Ordered operators: windows over an explicit order, dedupe, splits, resampling, joins in time, paging."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """WIN-03, SET-02: the first row of each key in an explicit order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """SRT-01/02, WIN-26: the first k rows of each group, with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def page(df: DataFrame, order: list[Column], offset: int, limit: int, most: int = 2000) -> DataFrame:
    """SRT-06: a slice in a total order."""
    return df.orderBy(*order).offset(offset).limit(min(limit, most))


def last_groups(df: DataFrame, order: str, k: int, flag: str = "test") -> DataFrame:
    """WIN-22: true for rows of the k last distinct values. The values are few; a dense rank over all rows is not needed."""
    values = df.select(order).distinct().orderBy(F.col(order).desc()).limit(k).agg(F.min(order).alias("__cut"))
    return df.crossJoin(F.broadcast(values)).withColumn(flag, F.coalesce(F.col(order) >= F.col("__cut"), F.lit(False))).drop("__cut")


def last_share(df: DataFrame, order: str, share: float, flag: str = "test") -> DataFrame:
    """WIN-23: true for rows of the last rint(share) of distinct values, at least one and not all."""
    ids = df.select(order).distinct()
    n = ids.count()
    return last_groups(df, order, int(max(1, min(n - 1, round(share * n)))), flag)


def central_difference(value: Column, order: Window, half: int, step: float) -> Column:
    """WIN-04: over +-half rows, clamped at the ends."""
    rank, size = F.row_number().over(order), F.count(F.lit(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ahead = F.coalesce(F.lead(value, half).over(order), F.last(value).over(order.rowsBetween(0, half)))
    back = F.coalesce(F.lag(value, half).over(order), F.first(value).over(order.rowsBetween(-half, 0)))
    span = F.least(F.lit(half), size - rank) + F.least(F.lit(half), rank - 1)
    return F.coalesce(F.try_divide(ahead - back, span * step), F.lit(0.0))


def median3(value: Column, order: Window) -> Column:
    """WIN-06: the median of up to three known neighbours; an unknown centre stays so."""
    near = F.array_sort(F.array_compact(F.array(F.lag(value).over(order), value, F.lead(value).over(order))))
    n = F.size(near)
    middle = (F.get(near, F.floor((n - 1) / 2).cast("int")) + F.get(near, F.floor(n / 2).cast("int"))) / 2
    return F.when(value.isNotNull(), F.when(n >= 2, middle).otherwise(value))


def moving_average(value: Column, order: Window, width: int) -> Column:
    """WIN-09: zero-padded at the ends: sums are divided by the width; series shorter than it stay as they are."""
    ahead = (width - 1) // 2
    size = F.count(F.lit(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.when(size < width, value).otherwise(F.sum(value).over(order.rowsBetween(-(width - 1 - ahead), ahead)) / width)


def resample(obs: DataFrame, grid: DataFrame, key: str, time: str, value: str, gap: float, tolerance: float = 0.06) -> DataFrame:
    """WIN-07, JOIN-15: linear interpolation at grid times between bracketing observations at most `gap` apart.

    Grid and observations are united and sorted once by key and time; no range join. Before the first and after the
    last observation the nearest one holds within the tolerance.
    """
    marked = obs.filter(F.col(value).isNotNull()).select(key, F.col(time).alias("t"), F.col(value).alias("v"), F.lit(0).alias("g"))
    both = marked.unionByName(grid.select(key, F.col(time).alias("t"), F.lit(None).cast("double").alias("v"), F.lit(1).alias("g")))
    order = Window.partitionBy(key).orderBy("t", "g")
    known = F.when(F.col("g") == 0, F.struct("t", "v"))
    back = F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    order_down = Window.partitionBy(key).orderBy(F.col("t").desc(), "g")
    ahead = F.last(known, ignorenulls=True).over(order_down.rowsBetween(Window.unboundedPreceding, 0))
    wide = both.withColumns({"a": back, "b": ahead}).filter("g = 1")
    span = F.col("b.t") - F.col("a.t")
    share = F.try_divide(F.col("t") - F.col("a.t"), span)
    inner = F.when(span == 0, F.col("a.v")).when(span <= gap, F.col("a.v") + (F.col("b.v") - F.col("a.v")) * share)
    edge = F.when(F.col("a").isNull() & (F.col("b.t") - F.col("t") <= tolerance), F.col("b.v")).when(F.col("b").isNull() & (F.col("t") - F.col("a.t") <= tolerance), F.col("a.v"))
    return wide.select(key, F.col("t").alias(time), F.coalesce(inner, edge).alias(value))


def asof(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], direction: str = "backward", within: Column | None = None) -> DataFrame:
    """JOIN-14: to each left row the last right row not after it (backward) or the first not before it (forward).

    Union and one sorted window by key: O(n log n) without a range join. within: over t and m (the match's time).
    """
    cols = [c for c in left.columns if c not in (key, time)]
    tagged = left.select(key, F.col(time).alias("t"), F.struct(*cols).alias("l"), F.lit(None).cast(right.select(F.struct(time, *values).alias("s")).schema["s"].dataType).alias("r"), F.lit(1).alias("side"))
    other = right.select(key, F.col(time).alias("t"), F.lit(None).cast(tagged.schema["l"].dataType).alias("l"), F.struct(time, *values).alias("r"), F.lit(0).alias("side"))
    order = Window.partitionBy(key).orderBy(F.col("t").asc() if direction == "backward" else F.col("t").desc(), "side").rowsBetween(Window.unboundedPreceding, 0)
    found = tagged.unionByName(other).withColumn("m", F.last("r", ignorenulls=True).over(order)).filter("side = 1")
    hit = F.lit(True) if within is None else within
    return found.withColumn("m", F.when(hit, F.col("m"))).select(key, F.col("t").alias(time), *(F.col(f"l.{c}").alias(c) for c in cols), F.col(f"m.{time}").alias(f"{time}_matched"), *(F.col(f"m.{v}").alias(v) for v in values))


def band_join(left: DataFrame, right: DataFrame, key: str, x: str, y: str, width: float) -> DataFrame:
    """JOIN-13, JOIN-18: pairs of one key with |x - y| <= width: both sides go to bins of that width, the right to three."""
    a = left.withColumn("__bin", F.floor(F.col(x) / width))
    b = right.withColumn("__bin", F.explode(F.array(*(F.floor(F.col(y) / width) + d for d in (-1, 0, 1)))))
    return a.join(b, [key, "__bin"]).filter(F.abs(F.col(x) - F.col(y)) <= width).drop("__bin")


def sessions(df: DataFrame, key: str, time: Column, gap: float) -> DataFrame:
    """STR-04: a session number by key; a new one starts after more than `gap` seconds."""
    order = Window.partitionBy(key).orderBy("__t")
    marked = df.withColumn("__t", time).withColumn("__new", F.when(F.col("__t") - F.lag("__t").over(order) <= gap, 0).otherwise(1))
    return marked.withColumn("session", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new", "__t")


def spikes(df: DataFrame, key: str, frame: str, value: str, factor: float = 2.5) -> DataFrame:
    """WIN-11: rows above median + factor * median absolute deviation of their series."""
    middle = df.groupBy(key).agg(F.median(value).alias("__m"))
    off = df.join(middle, key).withColumn("__d", F.abs(F.col(value) - F.col("__m")))
    spread = off.groupBy(key).agg(F.greatest(F.median("__d"), F.lit(1e-6)).alias("__s"))
    return off.join(spread, key).filter(F.col(value) > F.col("__m") + factor * F.col("__s")).drop("__m", "__d", "__s")


def spaced(df: DataFrame, key: str, frame: str, least: float) -> DataFrame:
    """WIN-11, WIN-29: from each series the rows at least `least` after the last kept one.

    A row that far after the one before it is kept for certain, so the series falls apart there and only the stretches
    between are folded, each by itself.
    """
    order = Window.partitionBy(key).orderBy("__f")
    apart = F.coalesce((F.col("__f") - F.lag("__f").over(order) >= least).cast("int"), F.lit(1))
    pieces = df.select(key, F.col(frame).cast("double").alias("__f")).withColumn("__cut", apart).withColumn("__piece", F.sum("__cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    listed = pieces.groupBy(key, "__piece").agg(F.array_sort(F.collect_list("__f")).alias("f"))
    empty = F.array().cast("array<double>")
    kept = F.aggregate("f", empty, lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) >= least), F.concat(acc, F.array(x))).otherwise(acc))
    return listed.select(key, F.explode(kept).alias(frame))


def snap_frame(df: DataFrame, key: str, frame: str, energy: str, trailing: int, leading: int, ratio: float = 2.5, share: float = 0.4) -> DataFrame:
    """WIN-10: the first frame whose leading mean is `ratio` times its trailing mean and near the best such score."""
    order = Window.partitionBy(key).orderBy(frame)
    quiet, loud = F.avg(energy).over(order.rowsBetween(-trailing, -1)), F.avg(energy).over(order.rowsBetween(0, leading - 1))
    scored = df.withColumn("ratio", F.try_divide(loud, F.greatest(quiet, F.lit(1e-6)))).withColumn("gain", F.when(F.col("ratio") >= ratio, loud - quiet))
    best = scored.withColumn("peak", F.max("gain").over(Window.partitionBy(key))).filter(F.col("gain") >= share * F.col("peak"))
    return best.groupBy(key).agg(F.min(frame).alias(frame))


def exponential_smoothing(df: DataFrame, key: str, order: str, value: str, alpha: float, out: str = "smooth") -> DataFrame:
    """WIN-27: s = alpha * v + (1 - alpha) * s, a recursion: one sorted group at a time, in Arrow batches."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        state, found = None, []
        for v in rows[value]:
            state = v if state is None else alpha * v + (1 - alpha) * state
            found.append(state)
        return rows.assign(**{out: found})

    return df.groupBy(key).applyInPandas(run, schema)


def greedy_match(pairs: DataFrame, group: str, left: str, right: str, order: list[str], ascending: list[bool]) -> DataFrame:
    """JOIN-16, JOIN-17: one-to-one pairs, each taken in order if neither side is taken. Candidates of one group (a frame, a clip) at a time."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*order, left, right], ascending=[*ascending, True, True])
        seen_left, seen_right, keep = set(), set(), []
        for a, b in zip(rows[left], rows[right], strict=True):
            keep.append(a not in seen_left and b not in seen_right)
            if keep[-1]:
                seen_left.add(a)
                seen_right.add(b)
        return rows[keep]

    return pairs.groupBy(group).applyInPandas(run, pairs.schema)


def associate(detections: DataFrame, clip: str, frame: str, x: str, y: str, side: str, reach: float = 6.0) -> DataFrame:
    """JOIN-19: track ids frame by frame: each detection, in order, takes the nearest free track of its side within reach, else a new one."""
    schema = T.StructType([*detections.schema.fields, T.StructField("track", T.LongType())])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([frame, x, y]).reset_index(drop=True)
        ids = np.zeros(len(rows), np.int64)
        last: dict[int, tuple[float, float, str]] = {}
        following = 1
        for _, part in rows.groupby(frame, sort=True):
            free, now = dict(last), {}
            for i, px, py, s in zip(part.index, part[x], part[y], part[side], strict=True):
                near = min(((np.hypot(px - q[0], py - q[1]), t) for t, q in free.items() if q[2] == s), default=(reach + 1, 0))
                if near[0] <= reach:
                    track = near[1]
                    del free[track]
                else:
                    track, following = following, following + 1
                now[track] = (px, py, s)
                ids[i] = track
            last = now
        return rows.assign(track=ids)

    return detections.groupBy(clip).applyInPandas(run, schema)
