"""Detections, tracks and registration as tables: filters, motion, appearance, formation and error measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def on_field(x: Column, y: Column, length: float = 120.0, width: float = 160 / 3, margin: float = 1.0) -> Column:
    """PRJ-13: within the field and a margin; hosted sources take a wider one."""
    return x.between(-margin, length + margin) & y.between(-margin, width + margin)


def not_official(name: Column, words: tuple[str, ...] = ("ref", "official", "umpire", "judge")) -> Column:
    """PRJ-16: the class name holds none of the words."""
    return ~reduce(lambda a, b: a | b, (F.lower(name).contains(w) for w in words))


def sideline_gate(boxes: DataFrame, frame: str, row: Column, size: Column, least: float, band: tuple[float, float], factor: float = 5.0) -> DataFrame:
    """PRJ-14: a size floor, a band of rows, and the residual of size on row within `factor` medians of its frame's line."""
    own = boxes.withColumns({"__r": row.cast("double"), "__s": size.cast("double")}).filter((F.col("__s") >= least) & F.col("__r").between(*band))
    fit = own.groupBy(frame).agg(F.regr_slope("__s", "__r").alias("__b"), F.regr_intercept("__s", "__r").alias("__a"), F.count(F.lit(1)).alias("__n"))
    off = own.join(fit, frame).withColumn("__e", F.abs(F.col("__s") - F.coalesce(F.col("__a") + F.col("__b") * F.col("__r"), F.col("__s"))))
    typical = off.groupBy(frame).agg(F.greatest(F.median("__e"), F.lit(1.0)).alias("__m"))
    return off.join(typical, frame).filter((F.col("__n") < 3) | (F.col("__e") <= factor * F.col("__m"))).drop("__r", "__s", "__a", "__b", "__n", "__e", "__m")


def drop_isolates(people: DataFrame, frame: str, key: str, x: str, y: str, suspect: str, reach: float = 8.0, others: int = 2, least: int = 8) -> DataFrame:
    """PRJ-15: suspects stay only among more than `others` bodies (self included) within +-reach; frames with fewer than `least` bodies stay whole. A frame has a few dozen bodies, so the pairs are joined within it."""
    a, b = people.alias("a"), people.select(F.col(frame).alias("__f"), F.col(x).alias("__x"), F.col(y).alias("__y")).alias("b")
    near = (F.col(f"a.{frame}") == F.col("__f")) & (F.abs(F.col(f"a.{x}") - F.col("__x")) <= reach) & (F.abs(F.col(f"a.{y}") - F.col("__y")) <= reach)
    counts = a.join(b, near).groupBy(F.col(f"a.{frame}").alias(frame), F.col(f"a.{key}").alias(key)).agg(F.count(F.lit(1)).alias("__near"))
    sized = people.withColumn("__all", F.count(F.lit(1)).over(Window.partitionBy(frame))).join(counts, [frame, key], "left")
    return sized.filter((F.col("__all") < least) | ~F.col(suspect) | (F.col("__near") > others)).drop("__all", "__near")


def without(frames: DataFrame, officials: DataFrame, keys: list[str]) -> DataFrame:
    """JOIN-24."""
    return frames.join(officials.select(*keys).distinct(), keys, "left_anti")


def motion_energy(points: DataFrame, clip: str, track: str, frame: str, x: str, y: str) -> DataFrame:
    """AGG-34, WIN-08: by frame the mean displacement of tracks seen in the frame before, less the camera's (their median)."""
    order = Window.partitionBy(clip, track).orderBy(frame)
    steps = points.withColumns({"__dx": F.col(x) - F.lag(x).over(order), "__dy": F.col(y) - F.lag(y).over(order), "__df": F.col(frame) - F.lag(frame).over(order)}).filter("__df = 1")
    camera = steps.groupBy(clip, frame).agg(F.median("__dx").alias("__mx"), F.median("__dy").alias("__my"))
    rest = steps.join(camera, [clip, frame])
    return rest.groupBy(clip, frame).agg(F.avg(F.hypot(F.col("__dx") - F.col("__mx"), F.col("__dy") - F.col("__my"))).alias("energy"), F.count(F.lit(1)).alias("tracks"))


def clip_quality(frames: DataFrame, clip: str, defenders: str, error: str, confidence: str, full: int = 11) -> DataFrame:
    """AGG-35: share of frames with a whole defense, median registration error, mean confidence."""
    return frames.groupBy(clip).agg(F.avg((F.col(defenders) >= full).cast("double")).alias("full_defense"), F.median(error).alias("error"), F.avg(confidence).alias("confidence"))


def track_report(points: DataFrame, clip: str, track: str, frame: str) -> DataFrame:
    """AGG-36, AGG-43: people by frame, spans of tracks, and the mean observed share."""
    frames = points.groupBy(clip, frame).agg(F.countDistinct(track).alias("p"))
    by_frame = frames.groupBy(clip).agg(F.avg("p").alias("mean_people"), F.min("p").alias("least_people"), F.max("p").alias("most_people"), F.count(F.lit(1)).alias("frames"))
    spans = points.groupBy(clip, track).agg(F.countDistinct(frame).alias("s")).join(by_frame.select(clip, "frames"), clip)
    share = F.col("s") / F.col("frames")
    tracks = spans.groupBy(clip).agg(F.count(F.lit(1)).alias("tracks"), F.median("s").alias("median_span"), F.max("s").alias("longest_span"), F.sum((share >= 0.5).cast("long")).alias("half_or_more"), F.sum((share < 0.1).cast("long")).alias("under_a_tenth"), F.avg(share).alias("continuity"))
    return by_frame.join(tracks, clip)


def registration_error(pairs: DataFrame, by: str, x: str, y: str, true_x: str, true_y: str) -> DataFrame:
    """AGG-26, OP-31: root mean squares across and along the field after the median offset, and whether both stay under 1.5 yards."""
    off = pairs.withColumns({"__x": F.col(x) - F.col(true_x), "__y": F.col(y) - F.col(true_y)})
    middle = off.groupBy(by).agg(F.median("__x").alias("__mx"), F.median("__y").alias("__my"))
    rest = off.join(middle, by)
    rms = lambda a, b: F.sqrt(F.avg(F.pow(F.col(a) - F.col(b), 2)))
    out = rest.groupBy(by).agg(rms("__x", "__mx").alias("downfield"), rms("__y", "__my").alias("lateral"), F.first("__mx").alias("offset_x"), F.first("__my").alias("offset_y"))
    return out.withColumn("usable", (F.col("downfield") < 1.5) & (F.col("lateral") < 1.5))


def smoothed_matrix(fits: DataFrame, clip: str, frame: str, matrix: str, good: str, last: int = 9) -> DataFrame:
    """WIN-12, STR-03: element-wise median of the last good fits; frames without one take the latest."""
    order = Window.partitionBy(clip).orderBy(frame)
    known = F.when(F.col(good), F.col(matrix))
    # nulls are left out of collect_list, so the last `last` of all good fits so far are the window
    recent = F.collect_list(known).over(order.rowsBetween(Window.unboundedPreceding, 0))
    held = fits.withColumn("__m", F.when(F.size(recent) > 0, F.slice(recent, F.greatest(F.size(recent) - last + 1, F.lit(1)), last)))
    middle = lambda a: (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2
    smooth = F.transform(F.sequence(F.lit(0), F.size(F.get("__m", F.lit(0))) - 1), lambda i: F.transform(F.array(F.array_sort(F.transform("__m", lambda m: F.get(m, i)))), middle)[0])
    return held.withColumn(matrix, F.when(F.col("__m").isNotNull(), smooth)).drop("__m")


def formation(points: DataFrame, by: list[str], depth: str, lateral: str) -> DataFrame:
    """AGG-39, AGG-40, AGG-41, WIN-20: spread and p90 - p10 of depths, and the five neighbours across that stand shallowest and widest: their score and median depth (the line)."""
    order = Window.partitionBy(*by).orderBy(lateral, depth).rowsBetween(0, 4)
    five = points.withColumn("__w", F.collect_list(F.struct(F.col(depth).alias("d"), F.col(lateral).alias("l"))).over(order)).filter(F.size("__w") == 5)
    depths = F.array_sort(F.transform("__w", lambda p: p["d"]))
    width = F.get("__w", F.lit(4))["l"] - F.get("__w", F.lit(0))["l"]
    score = F.get(depths, F.lit(4)) - F.get(depths, F.lit(0)) - 0.15 * F.least(width, F.lit(12.0))
    lines = five.withColumns({"__s": score, "__m": F.get(depths, F.lit(2))}).groupBy(*by).agg(F.min(F.struct("__s", "__m")).alias("__b"))
    sums = points.groupBy(*by).agg(F.count(F.lit(1)).alias("people"), F.stddev_pop(depth).alias("__sd"), F.percentile(depth, F.array(F.lit(0.1), F.lit(0.9))).alias("__p"))
    out = sums.join(lines, by, "left")
    return out.select(*by, "people", F.when(F.col("people") >= 8, F.col("__sd")).otherwise(F.lit(float("inf"))).alias("spread"), (F.col("__p")[1] - F.col("__p")[0]).alias("extent"), F.col("__b.__s").alias("line_score"), F.col("__b.__m").alias("line_depth"))


def refine_snap(frames: DataFrame, clip: str, frame: str, spread: str, count: str, looseness: float = 1.15, share: float = 0.6) -> DataFrame:
    """WIN-24: the last frame that is nearly as tight as the tightest one with enough people."""
    most = Window.partitionBy(clip)
    able = frames.withColumn("__c", F.max(count).over(most)).filter(F.col(count) >= share * F.col("__c")).withColumn("__t", F.min(spread).over(most))
    return able.filter(F.col(spread) <= looseness * F.col("__t")).groupBy(clip).agg(F.max(frame).alias(frame))


def ball_lateral(frames: DataFrame, by: str, name: str, y: str) -> DataFrame:
    """AGG-42: the ball's place if it was seen, else the median of everyone."""
    return frames.groupBy(by).agg(F.coalesce(F.avg(F.when(F.col(name) == "ball", F.col(y))), F.median(y)).alias("ball_y"))


def domain_gap(clean: DataFrame, film: DataFrame, key: str, truth: str, predicted: str) -> DataFrame:
    """AGG-19, JOIN-22, OP-03: accuracy on either side, agreement and drop over the plays of both."""
    both = clean.select(key, F.col(truth).alias("t"), F.col(predicted).alias("a")).join(film.select(key, F.col(predicted).alias("b")), key)
    share = lambda c: F.avg(c.cast("double"))
    out = both.agg(F.count(F.lit(1)).alias("n"), share(F.col("a") == F.col("t")).alias("clean"), share(F.col("b") == F.col("t")).alias("film"), share(F.col("a") == F.col("b")).alias("agreement"))
    return out.withColumn("drop", F.col("clean") - F.col("film"))


def disguise_summary(calls: DataFrame, team: str, kind: str = "kind") -> DataFrame:
    """AGG-20: calls by kind, and the share that disguised; 0 without calls."""
    count = lambda k: F.sum((F.col(kind) == k).cast("long")).alias(k)
    out = calls.groupBy(team).agg(F.count(F.lit(1)).alias("n"), *map(count, ("both", "family", "shell", "uncertain", "none")))
    return out.withColumn("rate", F.coalesce(F.try_divide(F.col("both") + F.col("family") + F.col("shell"), F.col("n")), F.lit(0.0)))


def mirror_scores(defenders: DataFrame, receivers: DataFrame, keys: list[str]) -> DataFrame:
    """JOIN-11, FN-MATH-15: each defender's best receiver by exp(-mean distance / 4) times the mean cosine of their velocities, over moments at which both move. Rows: keys (play), t, id, x, y, vx, vy; eleven a side, so pairs are joined within a moment."""
    a, b = defenders.alias("a"), receivers.alias("b")
    same = reduce(lambda p, q: p & q, (F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "t"]))
    speed = lambda s: F.hypot(F.col(f"{s}.vx"), F.col(f"{s}.vy"))
    moving = (speed("a") > 0.5) & (speed("b") > 0.5)
    cosine = F.when(moving, (F.col("a.vx") * F.col("b.vx") + F.col("a.vy") * F.col("b.vy")) / (speed("a") * speed("b")))
    pairs = a.join(b, same).groupBy(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a.id").alias("defender"), F.col("b.id").alias("receiver")).agg(F.avg(F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))).alias("d"), F.avg(cosine).alias("c"))
    scored = pairs.withColumn("score", F.exp(-F.col("d") / 4) * F.coalesce("c", F.lit(0.0)))
    return scored.groupBy(*keys, "defender").agg(F.max(F.struct("score", "receiver")).alias("m")).select(*keys, "defender", "m.receiver", "m.score")


def stitch_fragments(fragments: DataFrame, gap: float = 0.5, reach: float = 6.0, least: float = 0.90) -> DataFrame:
    """JOIN-18, SET-08, JOIN-27: track -> kept track. Rows: clip, track (long), team, start, end, sx, sy, ex, ey, look (unit vector).

    Candidates follow each other within the gap; an ordered union that never joins overlapping tracks is sequential, one clip at a time.
    """
    import numpy as np
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["start", "track"]).reset_index(drop=True)
        found = []
        for i, a in rows.iterrows():
            for j in rows.index[(rows["start"] > a["end"]) & (rows["start"] - a["end"] <= gap) & (rows["team"] == a["team"])]:
                b = rows.loc[j]
                alike = float(np.dot(a["look"], b["look"]))
                if np.hypot(b["sx"] - a["ex"], b["sy"] - a["ey"]) <= reach and alike >= least:
                    found.append((-alike, i, j))
        groups = {i: [i] for i in rows.index}
        owner = {i: i for i in rows.index}
        for _, i, j in sorted(found):
            a, b = owner[i], owner[j]
            clash = any(rows.at[p, "start"] <= rows.at[q, "end"] and rows.at[q, "start"] <= rows.at[p, "end"] for p in groups[a] for q in groups[b])
            if a == b or clash:
                continue
            keep, gone = min(a, b), max(a, b)
            groups[keep] += groups.pop(gone)
            for k in groups[keep]:
                owner[k] = keep
        return pd.DataFrame({"clip": rows["clip"], "track": rows["track"], "kept": [int(rows.at[owner[i], "track"]) for i in rows.index]})

    return fragments.groupBy("clip").applyInPandas(run, "clip long, track long, kept long")


def minimap(x: Column, y: Column, scale: float = 10.0) -> tuple[Column, Column]:
    """FN-MATH-14: pixels of the map as yards."""
    return x / scale, y / scale


def ramp(value: Column, low: float, high: float) -> Column:
    """FN-MATH-19: 0 at low, 1 at high."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))


def role_group(role: Column, table: dict[str, str]) -> Column:
    """FN-MATH-20: the group of a role, else the role in lower case, else unknown."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.lower(role)), F.lower(role), F.lit("unknown"))


def merged_probabilities(pairs: Column, aliases: dict[str, str]) -> Column:
    """FN-ARR-04: (name, probability) pairs as a map under alias names, the largest of each."""
    table = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    named = F.transform(pairs, lambda p: F.struct(F.coalesce(F.try_element_at(table, p["name"]), p["name"]).alias("name"), p["p"].alias("p")))
    names = F.array_distinct(F.transform(named, lambda p: p["name"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.array_max(F.transform(F.filter(named, lambda p: p["name"] == n), lambda p: p["p"]))))


def still_play(notes: Column) -> Column:
    """PRJ-23."""
    return F.coalesce(F.exists(notes, lambda n: F.lower(n).contains("still frame")), F.lit(False))


def caveats(borrowed: Column, plays: Column, usable_share: Column, held: Column) -> Column:
    """PRJ-21: the reasons to doubt a report, those that hold."""
    return F.array_compact(F.array(F.when(borrowed, "league rates are borrowed"), F.when(plays < 150, "fewer than 150 plays"), F.when(usable_share < 0.7, "under 70% of plays are usable"), F.when(held == 0, "no tell held up")))
