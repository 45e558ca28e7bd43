"""Pre-snap cues and post-snap features of play documents: arrays of players on one row, so no shuffle.

A play has players: array of (track_id, side, position, x: array, y: array) on a uniform grid of ten frames a second
with the snap at frame 20; x is yards past the line, y yards from the centre. Missing samples are null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import right_open

SNAP, RATE, FRAMES = 20, 10, 51

#: Yards past the line of a deep defender, of the box and half its width, of the line and of press, and yards from the centre of a receiver.
DEEP, BOX_X, BOX_Y, LINE, PRESS, WIDE = 10.0, 5.0, 8.0, 2.0, 3.0, 5.0

#: Edges and labels of the bands, an edge belongs to the upper one.
BANDS = {
    "deepest_depth_band": ("deepest_depth_n", [9, 12, 15, 19], ["<9", "9-12", "12-15", "15-19", "19+"]),
    "safety_depth_band": ("safety_depth_mean_n", [7, 10, 13, 16], ["<7", "7-10", "10-13", "13-16", "16+"]),
    "safety_split_band": ("safety_split_n", [2, 10, 18], ["stacked", "narrow", "wide", "very-wide"]),
    "field_safety_bias": ("field_safety_bias_n", [-2, 2], ["boundary", "balanced", "field"]),
    "corner_depth_band": ("corner_depth_mean_n", [3, 5.5, 8], ["press", "soft", "off", "deep-off"]),
    "corner_leverage": ("corner_leverage_mean_n", [-0.4, 0.4], ["inside", "head-up", "outside"]),
    "box_count_band": ("box_count_n", [6, 7, 8], ["light", "6", "7", "8+"]),
    "los_defenders_band": ("los_defender_count_n", [4, 5], ["3-", "4", "5+"]),
    "linebacker_depth_band": ("linebacker_depth_mean_n", [3.5, 5, 6.5], ["walked-up", "tight", "normal", "deep"]),
    "slot_defender_depth_band": ("slot_defender_depth_n", [3, 5, 7], ["creeping", "tight", "normal", "off"]),
    "defense_spread_band": ("defense_spread_n", [7, 10, 13], ["compressed", "normal", "wide", "very-wide"]),
    "distance_band": ("distance_n", [3, 7, 11], ["short", "medium", "long", "very-long"]),
    "field_zone": ("yardline_n", [20, 50, 80], ["backed-up", "own-territory", "plus-territory", "red-zone"]),
    "score_state": ("score_margin_n", [-8, -1, 8], ["trailing-big", "trailing", "close", "leading-big"]),
}
#: The signals in the order in which they are mined.
CUE_KEYS = [
    "shell", "deep_defender_count", "deepest_depth_band", "safety_depth_band", "safety_split_band", "late_rotation", "rotation_direction", "press_corners", "corner_leverage", "corner_depth_band", "box_count_band", "los_defenders_band",
    "slot_defender_depth_band", "defense_spread_band", "linebacker_depth_band", "motion_response", "field_safety_bias", "down", "distance_band", "field_zone", "hash_side", "personnel", "score_state",
]
#: The numbers beside them.
NUMERIC_CUE_KEYS = [
    "deep_defender_count_n", "deepest_depth_n", "safety_depth_mean_n", "safety_depth_max_n", "safety_split_n", "safety_y_asymmetry_n", "rotation_magnitude_n", "rotation_lateral_n", "rotation_depth_n", "press_corner_count_n", "corner_depth_mean_n", "corner_leverage_mean_n", "box_count_n",
    "los_defender_count_n", "slot_defender_depth_n", "defense_spread_n", "defense_width_n", "linebacker_depth_mean_n", "motion_response_n", "field_safety_bias_n", "defenders_observed_n", "down_n", "distance_n", "yardline_n", "score_margin_n",
]


def frame_at(t: float) -> int:
    """JOIN-14: the nearest frame of the grid, clamped."""
    return max(0, min(FRAMES - 1, round(t * RATE) + SNAP))


def resample_track(times: Column, values: Column, grid: Column, gap: float = 0.4, tolerance: float = 0.06) -> Column:
    """WIN-07 within one row: linear between known samples at most `gap` apart, null elsewhere; arrays in, array out."""
    pairs = F.filter(F.arrays_zip(times.alias("t"), values.alias("v")), lambda p: p["v"].isNotNull())

    def at(known: Column, t: Column) -> Column:
        a, b = F.element_at(F.filter(known, lambda p: p["t"] <= t), -1), F.get(F.filter(known, lambda p: p["t"] >= t), 0)
        share = F.try_divide(t - a["t"], b["t"] - a["t"])
        inner = F.when(b["t"] == a["t"], a["v"]).when(b["t"] - a["t"] <= gap, a["v"] + (b["v"] - a["v"]) * share)
        edge = F.when(a.isNull() & (b["t"] - t <= tolerance), b["v"]).when(b.isNull() & (t - a["t"] <= tolerance), a["v"])
        return F.coalesce(inner, edge)

    return F.transform(F.array(pairs), lambda known: F.transform(grid, lambda t: F.when(F.size(F.filter(known, lambda p: p["t"] <= t)) > 0, at(known, t)).otherwise(F.when(F.get(known, 0)["t"] - t <= tolerance, F.get(known, 0)["v"]))))[0]


def snapshot(players: Column, side: str, frame: int) -> Column:
    """OP-06, FN-ARR-01: (i, position, x, y) of a side's players seen at a frame, in list order."""
    at = F.transform(F.filter(players, lambda p: p["side"] == side), lambda p, i: F.struct(i.alias("i"), p["position"].alias("position"), F.get(p["x"], F.lit(frame)).alias("x"), F.get(p["y"], F.lit(frame)).alias("y")))
    return F.filter(at, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def mean(values: Column) -> Column:
    return F.try_divide(_sum(values), F.size(values))


def spread_pop(values: Column) -> Column:
    """TRAP-02: population deviation."""
    return F.transform(F.array(mean(values)), lambda m: F.sqrt(F.try_divide(_sum(F.transform(values, lambda v: (v - m) * (v - m))), F.size(values))))[0]


def count_if(array: Column, test) -> Column:
    return F.size(F.filter(array, test))


def xs(array: Column) -> Column:
    return F.transform(array, lambda p: p["x"])


def ys(array: Column) -> Column:
    return F.transform(array, lambda p: p["y"])


def travelled(now: Column, then: Column) -> Column:
    """JOIN-21, WIN-05: of players seen in both snapshots their places and displacement."""
    both = F.transform(now, lambda p: F.struct(p["i"].alias("i"), p["x"].alias("x"), p["y"].alias("y"), F.get(F.filter(then, lambda q: q["i"] == p["i"]), 0).alias("q")))
    both = F.filter(both, lambda p: p["q"].isNotNull())
    return F.transform(both, lambda p: F.struct(p["i"], p["x"], p["y"], (p["x"] - p["q"]["x"]).alias("dx"), (p["y"] - p["q"]["y"]).alias("dy"), F.sqrt(F.pow(p["x"] - p["q"]["x"], 2) + F.pow(p["y"] - p["q"]["y"], 2)).alias("d"), p["q"]["x"].alias("x0")))


def first_largest(array: Column, key) -> Column:
    """TRAP-36: of equal keys the first player in list order."""
    return F.aggregate(array, F.get(array, 0), lambda best, p: F.when(key(p) > key(best), p).otherwise(best))


def first_by(array: Column, key) -> Column:
    """The element with the smallest key, the first in order of equal ones; null of an empty array."""
    keyed = F.transform(array, lambda p, i: F.struct(key(p).alias("k"), i.alias("i"), p.alias("p")))
    return F.get(F.array_sort(keyed), 0)["p"]


def deepest_first(array: Column) -> Column:
    return F.transform(F.array_sort(F.transform(array, lambda p, i: F.struct((-p["x"]).alias("k"), i.alias("i"), p.alias("p")))), lambda q: q["p"])


def shell_label(n: Column) -> Column:
    return F.concat(F.when(n >= 3, "3+").otherwise(n.cast("string")), F.lit("-high"))


def geometric_shell(players: Column, frame: int) -> Column:
    """The shell that defenders seen at a frame make; null if none is seen."""
    seen = snapshot(players, "defense", frame)
    return F.when(F.size(seen) > 0, shell_label(count_if(seen, lambda p: p["x"] >= DEEP)))


def _corner(side: int) -> Column:
    """JOIN-12: the outermost defender of a side that is no safety, with the y of the receiver nearest to his own; null without either."""
    own = F.filter("__able", lambda p: (F.signum(p["y"]) == side) & (F.abs(p["y"]) >= 4))
    over = F.filter("__receivers", lambda y: F.signum(y) == side)
    corner = first_by(own, lambda p: -F.abs(p["y"]))
    target = F.transform(F.array(corner), lambda c: first_by(over, lambda y: F.abs(y - c["y"])))[0]
    return F.when((F.size(own) > 0) & (F.size(over) > 0), F.struct(corner["x"].alias("x"), (F.abs(corner["y"]) - F.abs(target)).alias("outside")))


def cues(plays: DataFrame, keep: list[str]) -> DataFrame:
    """AGG-30: the signals of the defense at the snap under CUE_KEYS, unknown where nothing is seen, and the numbers of NUMERIC_CUE_KEYS."""
    early = frame_at(-1.5)
    df = plays.withColumns({"__d": snapshot(F.col("players"), "defense", SNAP), "__e": snapshot(F.col("players"), "defense", early), "__o": snapshot(F.col("players"), "offense", SNAP), "__oe": snapshot(F.col("players"), "offense", early)})
    situation = lambda f: F.col(f"situation.{f}")
    number = lambda c: F.when(~F.isnan(c.cast("double")), c.cast("double"))
    df = df.withColumns({
        "__deep": F.filter("__d", lambda p: p["x"] >= DEEP), "__two": F.slice(deepest_first(F.col("__d")), 1, 2), "__wide": F.when(situation("ball_y_from_center") < 0, 1.0).otherwise(-1.0),
        "__receivers": F.array_sort(F.filter(ys(F.col("__o")), lambda y: F.abs(y) >= WIDE)), "__near": F.filter("__d", lambda p: p["x"] <= 14), "__moved": travelled(F.col("__d"), F.col("__e")),
        "down_n": F.when(situation("down") != 0, situation("down")).cast("double"), "distance_n": number(situation("distance")), "yardline_n": number(situation("yardline")), "score_margin_n": situation("score_margin").cast("double"),
    })
    # without the two deepest no safety is taken for a corner, whatever is played
    df = df.withColumn("__able", F.when(F.size("__near") >= 5, F.slice(deepest_first(F.col("__near")), 3, 1_000)).otherwise(F.col("__near")))
    n = F.size("__deep")
    some = F.when(n > 0, F.col("__deep")).otherwise(F.col("__two"))
    backers = F.filter("__d", lambda p: (p["x"] > LINE) & (p["x"] < DEEP) & (F.abs(p["y"]) <= BOX_Y))
    slots = F.filter("__receivers", lambda y: F.abs(y) < 12)
    df = df.withColumns({
        "__far": first_largest(F.filter("__moved", lambda p: F.greatest(p["x"], p["x0"]) >= 6), lambda p: p["d"]), "__motion": first_largest(travelled(F.col("__o"), F.col("__oe")), lambda p: F.abs(p["dy"])),
        "__corners": F.array_compact(F.array(_corner(-1), _corner(1))), "__slot": F.when(F.size(slots) > 0, F.when(F.abs(F.get(slots, 0)) < F.abs(F.element_at(slots, -1)), F.get(slots, 0)).otherwise(F.element_at(slots, -1))),
    })
    beside = F.filter("__d", lambda p: (F.abs(p["y"] - F.col("__slot")) <= 4) & (p["x"] <= 10))
    followers = F.filter("__moved", lambda p: (F.signum(p["dy"]) == F.signum(F.col("__motion.dy"))) & (F.abs(p["dy"]) >= 2) & (p["x"] <= 10))
    there = F.col("__motion").isNotNull() & (F.abs("__motion.dy") >= 3)
    all_y = ys(F.col("__d"))
    df = df.withColumns({
        "defenders_observed_n": F.size("__d").cast("double"), "deep_defender_count_n": n.cast("double"), "deepest_depth_n": F.array_max(xs(F.col("__d"))), "safety_depth_mean_n": mean(xs(some)), "safety_depth_max_n": F.array_max(xs(F.when(n > 0, F.col("__deep")).otherwise(F.col("__d")))),
        "safety_split_n": F.when(n > 1, F.array_max(ys(F.col("__deep"))) - F.array_min(ys(F.col("__deep")))).otherwise(0.0), "safety_y_asymmetry_n": F.coalesce(mean(ys(some)), F.lit(0.0)),
        "rotation_magnitude_n": F.coalesce("__far.d", F.lit(0.0)), "rotation_lateral_n": F.coalesce("__far.dy", F.lit(0.0)), "rotation_depth_n": F.coalesce("__far.dx", F.lit(0.0)),
        "press_corner_count_n": count_if(F.col("__corners"), lambda c: c["x"] <= PRESS).cast("double"), "corner_depth_mean_n": mean(F.transform("__corners", lambda c: c["x"])), "corner_leverage_mean_n": mean(F.transform("__corners", lambda c: c["outside"])),
        "box_count_n": count_if(F.col("__d"), lambda p: (p["x"] <= BOX_X) & (F.abs(p["y"]) <= BOX_Y)).cast("double"), "los_defender_count_n": count_if(F.col("__d"), lambda p: p["x"] <= LINE).cast("double"),
        "slot_defender_depth_n": F.when(F.col("__slot").isNotNull(), first_by(beside, lambda p: F.abs(p["y"] - F.col("__slot")))["x"]), "defense_spread_n": spread_pop(all_y), "defense_width_n": F.array_max(all_y) - F.array_min(all_y), "linebacker_depth_mean_n": mean(xs(backers)),
        "motion_response_n": F.when(there, F.coalesce(F.array_max(F.transform(followers, lambda p: F.abs(p["dy"]))), F.lit(0.0))),
    }).withColumn("field_safety_bias_n", F.col("safety_y_asymmetry_n") * F.col("__wide"))
    turn, side = F.col("rotation_depth_n"), F.col("rotation_lateral_n")
    presses = F.col("press_corner_count_n")
    labels = {
        "shell": shell_label(n),
        "deep_defender_count": F.when(n >= 3, "3+").otherwise(n.cast("string")),
        "late_rotation": F.when(F.col("rotation_magnitude_n") >= 2.5, "yes").otherwise("no"),
        "rotation_direction": F.when(F.col("rotation_magnitude_n") < 2.5, "none").when(F.abs(turn) > F.abs(side), F.when(turn < 0, "down").otherwise("back")).when(side * F.col("__wide") > 0, "to-field").otherwise("to-boundary"),
        "press_corners": F.when(presses <= 1, presses.cast("int").cast("string")).otherwise("2+"),
        "motion_response": F.when(~there | F.col("__motion").isNull(), "no-motion").when(F.col("motion_response_n") >= 0.55 * F.abs("__motion.dy"), "chased").otherwise("zone-bump"),
        "down": F.coalesce(F.col("down_n").cast("int").cast("string"), F.lit("unknown")),
        "hash_side": F.coalesce(F.when(situation("hash_side") != "", situation("hash_side")), F.lit("unknown")),
        "personnel": F.coalesce(F.when(situation("offense_personnel") != "", situation("offense_personnel")), F.lit("unknown")),
    } | {name: F.coalesce(right_open(F.col(number_), edges, names), F.lit("unknown")) for name, (number_, edges, names) in BANDS.items()}
    return df.withColumns(labels).select(*keep, *CUE_KEYS, *NUMERIC_CUE_KEYS)


#: What the defense did after the snap.
POSTSNAP_KEYS = [
    "deep_count_1s", "deep_count_25s", "depth_gain_mean", "depth_gain_max", "mirror_score_mean", "mirror_score_max", "man_distance_stability", "nearest_receiver_dist_mean", "zone_spacing_std", "deep_spread_25s", "underneath_count_25s", "pressure_count", "qb_converge_min_dist", "defense_spread_25s",
    "defense_depth_mean_25s", "widest_deep_y", "deep_pair_symmetry", "coverage_rotation_post",
]


def observed_fraction(track: Column) -> Column:
    """AGG-46: the share of a track's samples that were seen."""
    return F.try_divide(F.size(F.filter(track["x"], lambda v: v.isNotNull() & ~F.isnan(v))), F.size(track["x"]))


def velocity_at(track: Column, frame: int, half: int = 2) -> tuple[Column, Column]:
    """Central difference over `half` frames each way, in yards a second; 0 where an end is missing."""
    lo, hi = max(0, frame - half), min(FRAMES - 1, frame + half)
    dx, dy = (F.get(track[c], F.lit(hi)) - F.get(track[c], F.lit(lo)) for c in ("x", "y"))
    there = dx.isNotNull() & dy.isNotNull()
    seconds = (hi - lo) / RATE
    return F.when(there, dx / seconds).otherwise(0.0), F.when(there, dy / seconds).otherwise(0.0)


def _shadow(defender: Column, receivers: Column) -> Column:
    """The receiver whom a defender follows most: (score, distance, deviation); of equal scores the first in order, null without any."""

    def against(r: Column) -> Column:
        both = []
        for t in (0.5, 1.0, 1.5, 2.0, 2.5):
            f = frame_at(t)
            dx, dy = (F.get(defender[c], F.lit(f)) - F.get(r[c], F.lit(f)) for c in ("x", "y"))
            (ax, ay), (bx, by) = velocity_at(defender, f), velocity_at(r, f)
            one, two = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
            both.append(F.struct(F.sqrt(dx * dx + dy * dy).alias("far"), F.when((one > 0.5) & (two > 0.5), (ax * bx + ay * by) / (one * two)).alias("same")))
        seen = F.filter(F.array(*both), lambda p: p["far"].isNotNull())
        far = F.transform(seen, lambda p: p["far"])
        same = F.filter(F.transform(seen, lambda p: p["same"]), lambda v: v.isNotNull())
        return F.when(F.size(same) > 0, F.struct((F.exp(-mean(far) / 4.0) * mean(same)).alias("score"), mean(far).alias("far"), spread_pop(far).alias("sway")))

    return first_largest(F.filter(F.transform(receivers, against), lambda p: p.isNotNull() & (p["score"] > -1.0)), lambda p: p["score"])


def features(plays: DataFrame, keep: list[str]) -> DataFrame:
    """AGG-31: POSTSNAP_KEYS; all null without defenders, the passer's two without one in the list."""
    at = {name: frame_at(t) for name, t in (("0", 0), ("1", 1.0), ("15", 1.5), ("25", 2.5))}
    df = plays.withColumns({f"__d{k}": snapshot(F.col("players"), "defense", f) for k, f in at.items()})
    passers = F.filter("players", lambda p: (p["side"] == "offense") & (p["position"] == "QB"))
    passer = F.get(passers, 0)
    receivers = F.filter("players", lambda p: (p["side"] == "offense") & (p["position"].isNull() | p["position"].isin("WR", "TE", "RB")))
    defenders = F.filter("players", lambda p: p["side"] == "defense")
    df = df.withColumns({
        "__moved": travelled(F.col("__d25"), F.col("__d0")), "__back": F.filter("__d25", lambda p: p["x"] >= 14), "__shadows": F.filter(F.transform(defenders, lambda d: _shadow(d, receivers)), lambda s: s.isNotNull()),
        "__qx": F.get(passer["x"], F.lit(at["15"])), "__qy": F.get(passer["y"], F.lit(at["15"])), "__passers": F.size(passers),
    })
    df = df.withColumns({"__ys": F.array_sort(ys(F.col("__back"))), "__closing": F.filter(F.transform("__d15", lambda p: F.sqrt(F.pow(p["x"] - F.col("__qx"), 2) + F.pow(p["y"] - F.col("__qy"), 2))), lambda v: v.isNotNull())})
    deep = lambda k, x: count_if(F.col(f"__d{k}"), lambda p: p["x"] >= x).cast("double")
    shadow = lambda name: F.transform("__shadows", lambda s: s[name])
    back, first, last = F.col("__ys"), F.get("__ys", 0), F.element_at("__ys", -1)
    gaps = F.transform(F.sequence(F.lit(0), F.size(back) - 2), lambda i: F.get(back, i + 1) - F.get(back, i))
    two, one = F.size(back) >= 2, F.size(back) == 1
    out = {
        "deep_count_1s": deep("1", 12.0), "deep_count_25s": deep("25", 14.0), "depth_gain_mean": mean(F.transform("__moved", lambda p: p["dx"])), "depth_gain_max": F.array_max(F.transform("__moved", lambda p: p["dx"])),
        "mirror_score_mean": mean(shadow("score")), "mirror_score_max": F.array_max(shadow("score")), "man_distance_stability": mean(shadow("sway")), "nearest_receiver_dist_mean": mean(shadow("far")),
        "zone_spacing_std": F.when(two, spread_pop(gaps)), "deep_spread_25s": F.when(two, last - first).when(one, 0.0), "underneath_count_25s": count_if(F.col("__d25"), lambda p: (p["x"] >= 3) & (p["x"] < 14)).cast("double"),
        "pressure_count": F.when(F.col("__passers") > 0, count_if(F.col("__closing"), lambda v: v <= 4)).cast("double"), "qb_converge_min_dist": F.when(F.col("__passers") > 0, F.array_min("__closing")),
        "defense_spread_25s": spread_pop(ys(F.col("__d25"))), "defense_depth_mean_25s": mean(xs(F.col("__d25"))), "widest_deep_y": F.when(F.size(back) > 0, F.greatest(F.abs(first), F.abs(last))), "deep_pair_symmetry": F.when(two, F.abs(first + last)),
        "coverage_rotation_post": deep("25", 14.0) - deep("0", 10.0),
    }
    there = F.exists("players", lambda p: p["side"] == "defense")
    return df.select(*keep, *(F.when(there, out[n]).alias(n) for n in POSTSNAP_KEYS))


#: Shells that a look may turn into for the change to count as disguise.
TURNS = {"2-high": ("0-high", "1-high", "3+-high"), "1-high": ("2-high",), "0-high": ("2-high",)}


def disguise(plays: DataFrame, calls: DataFrame, families: dict[str, str], shells: dict[str, str], least_showed: float = 0.40, least_ran: float = 0.45, key: str = "play_id") -> DataFrame:
    """PRJ-17, JOIN-06, TRAP-31: calls (key, showed, showed_confidence, ran, ran_confidence) against the shells of their plays.

    families: of a coverage, man or zone; shells: the usual one of a coverage, where none is seen at 2.5 seconds. A family
    only differs where both calls are sure enough and the look was no 1-high one, which both families share. A shell only
    differs by one of TURNS, on plays with ten defenders or more.
    """
    own = plays.select(key, geometric_shell(F.col("players"), SNAP).alias("__s"), geometric_shell(F.col("players"), frame_at(2.5)).alias("__r"), F.col("quality.defenders_detected").alias("__n"))
    df = calls.join(own, key).withColumns({"showed_shell": F.coalesce("__s", F.lit("0-high")), "__seen": F.col("__r")})
    of = lambda table, c: F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col(c))
    turn = F.lit(False)
    for look, into in TURNS.items():
        turn = turn | ((F.col("showed_shell") == look) & F.col("__seen").isin(*into))
    shell = F.coalesce(turn & (F.col("__n") >= 10), F.lit(False))
    sure = (F.coalesce("showed_confidence", F.lit(0.0)) >= least_showed) & (F.coalesce("ran_confidence", F.lit(0.0)) >= least_ran)
    called = F.col("showed").isNotNull()
    man = lambda c: F.coalesce(of(families, c) == "man", F.lit(False))
    family = called & sure & (man("showed") != man("ran")) & (F.col("showed_shell") != "1-high")
    unsure = called & ~sure & (F.col("showed") != F.col("ran"))
    kind = F.when(family & shell, "both").when(family, "family").when(shell, "shell").when(unsure, "uncertain").otherwise("none")
    out = df.withColumns({"family_mismatch": family, "shell_mismatch": shell, "kind": kind, "disguised": kind.isin("both", "family", "shell")})
    return out.select(key, F.coalesce("showed", "showed_shell").alias("showed"), "ran", "showed_shell", F.coalesce("__seen", of(shells, "ran")).alias("ran_shell"), "kind", "disguised", "family_mismatch", "shell_mismatch", "showed_confidence", "ran_confidence")


def synthetic_plays(spark: SparkSession, weeks: int = 2, teams: int = 6, per_game: int = 10, seed: int = 7) -> DataFrame:
    """SRC-32: plays made by hash-seeded expressions: the same rows on any number of tasks."""
    unit = lambda *k: F.pmod(F.xxhash64(F.lit(seed), *k), F.lit(1_000_003)) / 1_000_003.0
    ids = spark.range(weeks * teams * per_game).select("id", (F.col("id") % teams).cast("int").alias("team"), (F.floor(F.col("id") / (teams * per_game)) + 1).cast("int").alias("week"))
    classes = ["Cover 0 Man", "Cover 1 Man", "Cover 2 Zone", "Cover 3 Zone", "Cover 4 Zone"]
    u = unit(F.col("id"), F.lit("coverage"))
    coverage = F.when(u < 0.06, classes[0]).when(u < 0.26, classes[1]).when(u < 0.42, classes[2]).when(u < 0.8, classes[3]).otherwise(classes[4])
    high = F.when(coverage == classes[0], 0).when(coverage.isin(classes[1], classes[3]), 1).otherwise(2)
    base = ids.select("id", "week", F.format_string("Team %d", "team").alias("defense_team"), coverage.alias("coverage"), high.alias("high"))

    def player(side: str, i: Column) -> Column:
        r = lambda tag: unit(F.col("id"), F.lit(side + tag), i)
        deep = (F.lit(side) == "defense") & (i < F.col("high"))
        x0 = F.when(F.lit(side) == "offense", -1.0 - 6 * r("x") * (i == 0).cast("int")).when(deep, 11 + 6 * r("x")).otherwise(1 + 6 * r("x"))
        y0 = (i - 5) * 3.2 + 2 * r("y") - 1
        vx = F.when(F.lit(side) == "offense", 2 * r("v")).otherwise(1.5 * r("v"))
        path = lambda start, v: F.transform(F.sequence(F.lit(0), F.lit(FRAMES - 1)), lambda f: F.round(start + v * F.greatest(f - SNAP, F.lit(0)) / RATE, 2).cast("double"))
        position = F.when(F.lit(side) == "offense", F.when(i == 0, "QB").when(i < 6, "OL").otherwise("WR")).otherwise(F.when(deep, "S").otherwise("LB"))
        return F.struct(F.format_string(f"{side[0].upper()}_%d", i).alias("track_id"), F.lit(side).alias("side"), position.alias("position"), path(x0, vx).alias("x"), path(y0, (r("w") - 0.5)).alias("y"))

    eleven = F.sequence(F.lit(0), F.lit(10))
    players = F.concat(F.transform(eleven, lambda i: player("offense", i)), F.transform(eleven, lambda i: player("defense", i)))
    situation = F.struct((F.col("id") % 4 + 1).cast("int").alias("down"), (1 + 12 * unit(F.col("id"), F.lit("d"))).alias("distance"), (99 * unit(F.col("id"), F.lit("z"))).alias("yardline"), (F.col("id") % 21 - 10).cast("int").alias("score_margin"), (6 * unit(F.col("id"), F.lit("b")) - 3).alias("ball_y_from_center"), F.when(F.col("id") % 3 == 0, "left").when(F.col("id") % 3 == 1, "right").alias("hash_side"), F.when(F.col("id") % 2 == 0, "11").otherwise("12").alias("offense_personnel"))
    return base.select(F.format_string("synthetic-%d", "id").alias("play_id"), "week", "defense_team", "coverage", situation.alias("situation"), players.alias("players"))


@dataclass(frozen=True)
class Profile:
    """A team of a made league: weights of coverages and planted signals (trait, coverage, probability)."""

    team: str
    bias: dict[str, float] = field(default_factory=dict)
    tells: tuple[tuple[str, str, float], ...] = ()


#: How often each coverage is played, how many defend deep in it, and how often a trait shows where nothing is planted.
LEAGUE_MIX = {"Cover 0 Man": 0.08, "Cover 1 Man": 0.24, "Cover 2 Zone": 0.18, "Cover 3 Zone": 0.32, "Cover 4 Zone": 0.18}
DEEP_IN = {"Cover 0 Man": 0, "Cover 1 Man": 1, "Cover 2 Zone": 2, "Cover 3 Zone": 1, "Cover 4 Zone": 2}
TRAITS = {"late_rotation": 0.25, "press_corners": 0.35, "deep_safeties": 0.3, "nickel_creep": 0.25, "heavy_box": 0.25}
#: The signals that show a trait.
TRAIT_CUES = {
    "late_rotation": {"late_rotation", "rotation_direction"}, "press_corners": {"press_corners", "corner_depth_band", "corner_leverage"}, "deep_safeties": {"safety_depth_band", "deepest_depth_band", "shell", "deep_defender_count"},
    "nickel_creep": {"slot_defender_depth_band", "los_defenders_band"}, "heavy_box": {"box_count_band", "linebacker_depth_band", "los_defenders_band", "safety_depth_band", "shell", "deep_defender_count"},
}
#: The last team has no planted signal: nothing should be found there.
LEAGUE = (
    Profile("Rollers", {"Cover 3 Zone": 1.2}, (("late_rotation", "Cover 3 Zone", 0.88), ("press_corners", "Cover 1 Man", 0.92))),
    Profile("Bailers", {"Cover 4 Zone": 1.6}, (("deep_safeties", "Cover 4 Zone", 0.92),)),
    Profile("Creepers", {"Cover 0 Man": 2.2}, (("nickel_creep", "Cover 0 Man", 0.95),)),
    Profile("Jammers", {"Cover 2 Zone": 1.5}, (("press_corners", "Cover 2 Zone", 0.9),)),
    Profile("Crowders", {"Cover 1 Man": 1.3}, (("heavy_box", "Cover 3 Zone", 0.9),)),
    Profile("Plain"),
)


def planted_plays(spark: SparkSession, league: tuple[Profile, ...] = LEAGUE, weeks: int = 10, per_week: int = 60, seed: int = 7) -> DataFrame:
    """SRC-32, OP-15, OP-16: a season of plays whose tracks show planted signals; every draw is a hash of the play's number, so rows are the same on any number of tasks and `weeks` and `per_week` scale them."""
    unit = lambda *k: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), *map(F.lit, k)), F.lit(1_000_003)) / 1_000_003.0
    n = len(league)
    base = spark.range(weeks * per_week * n).select("id", (F.col("id") % n).cast("int").alias("t"), (F.floor(F.col("id") / (per_week * n)) + 1).cast("int").alias("week"))
    names = F.array(*(F.lit(p.team) for p in league))
    coverage, chance = F.lit(None).cast("string"), {trait: F.lit(usual) for trait, usual in TRAITS.items()}
    u = unit("coverage")
    for i, p in enumerate(league):
        share = {c: v * p.bias.get(c, 1.0) for c, v in LEAGUE_MIX.items()}
        upto, drawn = 0.0, F.lit(list(share)[-1])
        steps = []
        for c, v in list(share.items())[:-1]:
            upto += v / sum(share.values())
            steps.append((upto, c))
        for edge, c in reversed(steps):
            drawn = F.when(u < edge, c).otherwise(drawn)
        coverage = F.when(F.col("t") == i, drawn).otherwise(coverage)
    played = base.withColumns({"coverage": coverage, "defense_team": F.get(names, F.col("t"))})
    for p in league:
        for trait, c, probability in p.tells:
            chance[trait] = F.when((F.col("defense_team") == p.team) & (F.col("coverage") == c), probability).otherwise(chance[trait])
    deep = F.lit(0)
    for c, k in DEEP_IN.items():
        deep = F.when(F.col("coverage") == c, k).otherwise(deep)
    played = played.withColumns({f"is_{trait}": unit(trait) < p for trait, p in chance.items()} | {"high": deep})
    flag = lambda trait: F.col(f"is_{trait}")
    r = lambda tag: unit(tag) - 0.5
    early = frame_at(-1.0)

    def track(name: str, side: str, position: str, x: Column, y: Column, dx: Column | float = 0.0, dy: Column | float = 0.0) -> Column:
        path = lambda start, off: F.concat(F.array_repeat(F.round(start + off, 3), early), F.array_repeat(F.round(start, 3), FRAMES - early))
        return F.struct(F.lit(name).alias("track_id"), F.lit(side).alias("side"), F.lit(position).alias("position"), path(x, F.lit(0.0) + dx).alias("x"), path(y, F.lit(0.0) + dy).alias("y"))

    press = F.when(flag("press_corners"), 1.6 + r("c")).otherwise(6.5 + 1.5 * r("c"))
    safety = F.when(flag("deep_safeties"), 15.0 + r("s")).otherwise(11.2 + r("s"))
    roll = F.when(flag("late_rotation"), 4.0 + r("m")).otherwise(0.4 * r("m"))
    box = flag("heavy_box")
    people = [track("O0", "offense", "QB", F.lit(-5.0), F.lit(0.0)), *(track(f"O{i}", "offense", "OL", F.lit(-1.0), F.lit(1.5 * (i - 3))) for i in range(1, 6)), *(track(f"O{k}", "offense", pos, F.lit(-1.0), F.lit(y)) for k, pos, y in ((6, "WR", 19.0), (7, "WR", -19.0), (8, "WR", 9.0), (9, "TE", -4.5), (10, "RB", 1.0)))]
    people += [
        track("D0", "defense", "CB", press, 19.0 + r("y0")), track("D1", "defense", "CB", press + 0.3 * r("c1"), -19.0 + r("y1")), track("D2", "defense", "NB", F.when(flag("nickel_creep"), 2.4 + 0.4 * r("n")).otherwise(5.8 + r("n")), 9.0 + r("y2")),
        track("D3", "defense", "S", F.when(F.col("high") >= 1, safety).otherwise(7.5 + r("s0")), F.when(F.col("high") >= 2, 8.0).otherwise(0.0) + 2 * r("y3"), 0.0, roll), track("D4", "defense", "S", F.when(box, 4.2 + 0.5 * r("b")).when(F.col("high") >= 2, safety + r("s4")).otherwise(7.0 + r("s5")), F.when(box, -6.0).otherwise(-9.5) + r("y4")),
        *(track(f"D{5 + i}", "defense", "LB", 4.3 + 0.8 * r(f"l{i}"), F.lit(4.0 * (i - 1)) + r(f"k{i}")) for i in range(3)), *(track(f"D{8 + i}", "defense", "DL", 1.0 + 0.4 * r(f"d{i}"), F.lit(3.0 * (i - 1))) for i in range(3)),
    ]
    situation = F.struct((1 + F.floor(4 * unit("down"))).cast("int").alias("down"), F.round(1 + 14 * unit("to go"), 1).alias("distance"), F.round(1 + 98 * unit("yard")).alias("yardline"), (F.floor(29 * unit("margin")) - 14).cast("int").alias("score_margin"), (6 * r("ball")).alias("ball_y_from_center"), F.when(unit("hash") < 0.5, "left").otherwise("right").alias("hash_side"), F.when(unit("people") < 0.6, "11").otherwise("12").alias("offense_personnel"))
    return played.select(F.format_string("planted-%d", "id").alias("play_id"), "week", "defense_team", "coverage", situation.alias("situation"), F.array(*people).alias("players"))
