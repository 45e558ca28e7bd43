"""Signal mining: which observed signals shift an entity's outcomes more than they shift its peers', tested and validated forward.

Rows are read once, into counts by (entity, signal, value, week); everything else is arithmetic on that table. Peers are
totals less an entity's own counts, folds of validation are running sums. What is expected of an entity after a signal is
its own base rate, moved by as much as the signal moves the peers' rate, so a general habit is not found once for each
signal. Rows of a null entity count among the peers; null and unknown values of a signal are not mined.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from ..functions.strings import mapped, percent
from .rates import class_sums, unpivot_classes

#: The signal that every row has: an entity's totals.
TOTAL = ""
#: Signal values that say nothing.
UNKNOWN = ("unknown", "nan")
#: Signals that name the situation and not what is shown.
SITUATION_CUES = ("down", "distance_band", "field_zone", "hash_side", "personnel", "score_state")
#: Signals that are another one's in other words.
FAMILIES = {"deep_defender_count": "shell", "safety_depth_band": "shell", "deepest_depth_band": "shell", "corner_depth_band": "press_corners", "rotation_direction": "late_rotation"}


#: How a signal's value is told.
PHRASES = {
    "shell": "the pre-snap shell is {value}", "deep_defender_count": "{value} defender(s) align deep", "deepest_depth_band": "the deepest defender is {value} yards off", "safety_depth_band": "the safeties average {value} yards deep", "safety_split_band": "the safety split is {value}",
    "late_rotation": "there is late rotation: {value}", "rotation_direction": "the late rotation goes {value}", "press_corners": "{value} corner(s) press", "corner_leverage": "the corners play {value} leverage", "corner_depth_band": "the corners align {value}", "box_count_band": "the box count is {value}",
    "los_defenders_band": "{value} defenders are on the line", "slot_defender_depth_band": "the slot defender is {value}", "defense_spread_band": "the defensive front is {value}", "linebacker_depth_band": "the linebackers are {value}", "motion_response": "the response to motion is {value}",
    "field_safety_bias": "the deep safety shades {value}", "down": "it is {value} down", "distance_band": "the distance is {value}", "field_zone": "the ball is in {value}", "hash_side": "the ball is on the {value} hash", "personnel": "the offense is in {value} personnel", "score_state": "the defense is {value}",
}


@dataclass(frozen=True)
class MiningParams:
    """OP-07. strength: of the prior, estimated where None; league_rates: a baseline of outcomes from elsewhere; quality: a
    column that must reach least_quality; use_recency: weight halves every half_life weeks before the entity's last."""

    least_support: int = 10
    least_lift: float = 0.10
    least_ratio: float = 2.5
    least_ratio_rate: float = 0.08
    least_rate: float = 0.0
    alpha: float = 0.10
    strength: float | None = None
    use_recency: bool = True
    half_life: float = 3.0
    most: int = 25
    situations: bool = True
    quality: str = "quality_score"
    least_quality: float = 0.0
    league_rates: Mapping[str, float] | None = None
    baseline_source: str = "observed"
    families: Mapping[str, str] = field(default_factory=lambda: FAMILIES)


def unpivot_cues(df: DataFrame, keep: list[str], cues: list[str], key: str = "cue_key", value: str = "cue_value", total: bool = False) -> DataFrame:
    """One row per known cue value: one pass for all cues instead of one grouping each; with total, one more under TOTAL."""
    pairs = [F.struct(F.lit(c).alias(key), F.col(c).cast("string").alias(value)) for c in cues]
    pairs += [F.struct(F.lit(TOTAL).alias(key), F.lit(TOTAL).alias(value))] if total else []
    return df.select(*keep, F.explode(F.array(*pairs)).alias("__c")).select(*keep, "__c.*").filter(F.col(value).isNotNull() & ~F.col(value).isin(*UNKNOWN))


def cue_counts(df: DataFrame, entity: str, outcome: str, cues: list[str], classes: list[str], week: str | None = None, params: MiningParams = MiningParams()) -> DataFrame:
    """entity, cue_key, cue_value, __week, n and c0..: the one pass over rows with an outcome."""
    cues = [c for c in cues if params.situations or c not in SITUATION_CUES]
    known = df.filter(F.col(outcome).isNotNull())
    if params.least_quality > 0 and params.quality in df.columns:
        known = known.filter(F.col(params.quality) >= params.least_quality)
    known = known.withColumn("__week", F.lit(None).cast("double") if week is None else F.col(week).cast("double"))
    long = unpivot_cues(known, [entity, outcome, "__week"], cues, total=True)
    return long.groupBy(entity, "cue_key", "cue_value", "__week").agg(F.count(F.lit(1)).alias("n"), *class_sums(outcome, classes))


def weighted_counts(counts: DataFrame, entity: str, classes: list[str], params: MiningParams = MiningParams(), current_week: float | None = None) -> DataFrame:
    """WIN-02, AGG-05: by entity, cue and value the counts n, c0.., their weights w, w0.. and the squared weights wsq."""
    k = range(len(classes))
    if params.use_recency:
        weeks = counts.filter((F.col("cue_key") == TOTAL) & F.col(entity).isNotNull()).groupBy(entity).agg(F.max("__week").alias("__last"), F.percentile("__week", 0.5, F.col("n")).alias("__usual"))
        last = F.col("__last") if current_week is None else F.when(F.col("__last").isNotNull(), F.lit(float(current_week)))
        counts = counts.join(weeks, entity, "left").withColumn("__w", stats.recency(F.col("__week"), last, params.half_life, F.col("__usual")))
    else:
        counts = counts.withColumn("__w", F.lit(1.0))
    w = F.col("__w")
    return counts.groupBy(entity, "cue_key", "cue_value").agg(F.sum("n").alias("n"), F.sum(F.col("n") * w).alias("w"), F.sum(F.col("n") * w * w).alias("wsq"), *(F.sum(f"c{i}").alias(f"c{i}") for i in k), *(F.sum(F.col(f"c{i}") * w).alias(f"w{i}") for i in k))


def cells(own: DataFrame, entity: str, outcome: str, classes: list[str], params: MiningParams = MiningParams(), by: list[str] = (), **carried: str) -> DataFrame:
    """JOIN-09, AGG-05..07: what is known of every entity, signal value and outcome that has enough rows on both sides.

    Gives n and k (raw), n_eff and rate (weighted), peer_n, peer_k, peer_rate, plays (of the entity), base and league (the
    outcome's share in all of the entity's and the peers' rows) and strength, a method-of-moments prior from how much the
    other entities differ after the signal: 20 with too few of them or a mean of 0 or 1, 50 without variance beyond
    chance, else within 2 and 100. carried: output name = prefix of further class columns.
    """
    k = range(len(classes))
    cue, mine = Window.partitionBy(*by, "cue_key", "cue_value"), Window.partitionBy(*by, entity)
    named = F.col(entity).isNotNull()
    peers = {"peer_n": F.sum("n").over(cue) - F.col("n"), "peers": F.count_if(named).over(cue) - 1, "named_n": F.sum(F.when(named, F.col("n"))).over(cue) - F.col("n")}
    for i in k:
        square = F.col(f"c{i}") * F.col(f"c{i}") / F.col("n")
        peers |= {f"p{i}": F.sum(f"c{i}").over(cue) - F.col(f"c{i}"), f"m{i}": F.sum(F.when(named, F.col(f"c{i}"))).over(cue) - F.col(f"c{i}"), f"s{i}": F.sum(F.when(named, square)).over(cue) - square}
    whole = lambda value: F.max(F.when(F.col("cue_key") == TOTAL, value)).over(mine)
    if params.league_rates is None:
        league = [whole(F.try_divide(F.col(f"p{i}"), F.col("peer_n"))) for i in k]
    else:
        rates = [float(params.league_rates.get(c, 0.0)) for c in classes]
        league = [F.lit(r / (sum(rates) or 1.0)) for r in rates]
    wide = own.withColumns(peers).filter(named)
    wide = wide.withColumns({"plays": whole(F.col("n")), **{f"b{i}": whole(F.col(f"w{i}") / F.col("w")) for i in k}, **{f"l{i}": league[i] for i in k}})
    n_eff = F.try_divide(F.col("w") * F.col("w"), F.col("wsq"))
    able = wide.filter(F.col("cue_key") != TOTAL).withColumn("n_eff", n_eff).filter((F.col("n") >= params.least_support) & (F.col("peer_n") >= params.least_support) & (F.col("n_eff") >= params.least_support - 1e-9))
    kept = [*by, entity, "cue_key", "cue_value", "n", "n_eff", "w", "plays", "peer_n", "peers", "named_n", *(c for c in ("test_n",) if c in own.columns)]
    long = unpivot_classes(able, [F.col(c) for c in kept], outcome, classes, k="c", own_w="w", peer_k="p", named_k="m", squares="s", base="b", league="l", **carried)
    mean = F.try_divide(F.col("named_k"), F.col("named_n"))
    between = F.try_divide(F.col("squares"), F.col("named_n")) - mean * mean - mean * (1 - mean) * F.col("peers") / F.col("named_n")
    estimated = F.when((F.col("peers") < 4) | mean.isNull() | (mean <= 0) | (mean >= 1), 20.0).when(between <= 1e-9, 50.0).otherwise(F.greatest(F.lit(2.0), F.least(F.lit(100.0), F.try_divide(mean * (1 - mean), between) - 1)))
    strength = estimated if params.strength is None else F.lit(float(params.strength))
    out = long.filter((F.col("k") > 0) | (F.col("peer_k") > 0)).withColumns({"rate": F.col("own_w") / F.col("w"), "peer_rate": F.col("peer_k") / F.col("peer_n"), "strength": strength})
    return out.drop("w", "own_w", "named_n", "named_k", "squares")


def effect_floor(rate: Column, expected: Column, lift: Column, params: MiningParams) -> Column:
    """PRJ-18: a large move, or a large ratio upward to a rate worth acting on, or one downward from such a rate."""
    up = rate >= F.greatest(params.least_ratio * expected, F.lit(params.least_ratio_rate))
    down = expected >= F.greatest(params.least_ratio * rate, F.lit(params.least_ratio_rate))
    return (F.abs(lift) >= params.least_lift) | F.when(lift > 0, up).otherwise((rate > 0) & down)


def tell_score(rate: Column, expected: Column, lift: Column, q: Column, n: Column, support: Column) -> Column:
    """FN-MATH-09: the move or, upward, the rate by a third of its doublings; times certainty, volume against 60 rows, the rate itself and how often the signal shows."""
    doublings = F.least(F.log2(rate / expected) / 3.0, F.lit(1.0))
    effect = F.when((lift > 0) & (expected > 1e-6) & (rate > expected), F.greatest(F.abs(lift), rate * doublings)).otherwise(F.abs(lift))
    certainty = 1.0 - F.least(q, F.lit(1.0))
    volume = F.log1p(n.cast("double")) / F.log1p(F.lit(60.0))
    absolute = F.when(lift > 0, rate).otherwise(1.0 - rate)
    return effect * (0.5 + 0.5 * certainty) * (0.4 + 0.6 * volume) * absolute * (0.5 + 0.5 * F.least(support * 4, F.lit(1.0)))


def candidates(found: DataFrame, entity: str, outcome: str, params: MiningParams = MiningParams(), by: list[str] = ()) -> DataFrame:
    """FN-MATH-05..09, WIN-01: cells with expected and shrunk rate, lift, interval, p, q over all of the entity's cells, score and significance."""
    trials, hits = F.rint("n_eff"), F.rint(F.col("rate") * F.col("n_eff"))
    expected = stats.transported(F.col("peer_rate"), F.col("league"), F.col("base"))
    out = found.withColumns({"n_cue": trials.cast("long"), "n_cue_outcome": hits.cast("long"), "expected": expected})
    shrunk = stats.posterior(F.col("n_cue_outcome"), F.col("n_cue"), stats.bounded(F.col("expected"), 1e-6), F.col("strength"))
    low, high = stats.wilson(F.col("n_cue_outcome"), F.col("n_cue"))
    p = stats.two_proportion_p(F.col("n_cue_outcome"), F.col("n_cue"), F.col("expected"), F.least("peer_n", "plays"))
    out = out.withColumns({"shrunk": shrunk, "ci_low": F.round(low, 4), "ci_high": F.round(high, 4), "p_value": p})
    out = out.withColumn("__q", stats.benjamini_hochberg(F.col("p_value"), [F.col("cue_key"), F.col("cue_value"), F.col(outcome)], [*by, entity]))
    four = lambda c: F.round(c, 4)
    out = out.select(
        *by, entity, "cue_key", "cue_value", outcome, F.when(F.col("cue_key").isin(*SITUATION_CUES), "situation").otherwise("alignment").alias("kind"), "n_cue", "n_cue_outcome",
        four(F.col("rate")).alias("raw_rate"), four(F.col("shrunk")).alias("shrunk_rate"), four(F.col("peer_rate")).alias("baseline_rate"), F.col("peer_n").alias("baseline_n"), four(F.col("base")).alias("team_base_rate"),
        four(F.col("expected")).alias("expected_rate"), four(F.col("shrunk") - F.col("expected")).alias("lift"), "ci_low", "ci_high", "p_value", F.round("__q", 5).alias("q_value"), (F.col("__q") <= params.alpha).alias("significant"),
        four(F.col("n") / F.col("plays")).alias("support"), F.round("strength", 2).alias("prior_strength"), F.lit(params.baseline_source).alias("baseline_source"), *(c for c in ("test_n", "test_hits") if c in found.columns),
    )
    return out.withColumn("score", four(tell_score(F.col("shrunk_rate"), F.col("expected_rate"), F.col("lift"), F.col("q_value"), F.col("n_cue"), F.col("support"))))


def family_best(tells: DataFrame, families: Mapping[str, str], entity: str, outcome: str, by: list[str] = ()) -> DataFrame:
    """SRT-02: of cues of one family with the same value and outcome the best score stays."""
    family = reduce(lambda acc, kv: acc.when(F.col("cue_key") == kv[0], kv[1]), families.items(), F.when(F.lit(False), "")).otherwise(F.col("cue_key"))
    order = Window.partitionBy(*by, entity, family, "cue_value", outcome).orderBy(F.col("score").desc(), "cue_key")
    return tells.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn")


def best_tells(found: DataFrame, entity: str, outcome: str, params: MiningParams = MiningParams(), by: list[str] = ()) -> DataFrame:
    """PRJ-19, SRT-01, SRT-02: significant candidates over the floors, one of each family, the best of each entity by rank."""
    wanted = F.col("significant") & effect_floor(F.col("shrunk_rate"), F.col("expected_rate"), F.col("lift"), params) & (F.col("shrunk_rate") >= params.least_rate)
    single = family_best(found.filter(wanted), params.families, entity, outcome, by)
    order = Window.partitionBy(*by, entity).orderBy(F.col("score").desc(), "cue_key", "cue_value", outcome)
    return single.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= params.most)


def mine(df: DataFrame, entity: str, outcome: str, cues: list[str], classes: list[str], week: str | None = None, params: MiningParams = MiningParams(), current_week: float | None = None) -> DataFrame:
    """The tells of every entity at once, best first by rank."""
    counts = cue_counts(df, entity, outcome, cues, classes, week, params)
    found = cells(weighted_counts(counts, entity, classes, params, current_week), entity, outcome, classes, params)
    return best_tells(candidates(found, entity, outcome, params), entity, outcome, params)


def mining_summary(df: DataFrame, entity: str, outcome: str, cues: list[str], classes: list[str], week: str | None = None, params: MiningParams = MiningParams()) -> DataFrame:
    """OP-09: for each entity its plays, cells tested, significant ones, tells, and what there is to say where there are none."""
    counts = cue_counts(df, entity, outcome, cues, classes, week, params)
    found = candidates(cells(weighted_counts(counts, entity, classes, params), entity, outcome, classes, params), entity, outcome, params)
    tested = found.groupBy(entity).agg(F.count(F.lit(1)).alias("n_tests"), F.count_if("significant").alias("n_significant"))
    kept = best_tells(found, entity, outcome, params).groupBy(entity).agg(F.count(F.lit(1)).alias("n_tells"))
    totals = counts.filter(F.col("cue_key") == TOTAL)
    everyone = totals.agg(F.sum("n").alias("others"))  # one row
    plays = totals.groupBy(entity).agg(F.sum("n").alias("n_plays")).crossJoin(F.broadcast(everyone)).withColumn("others", F.col("others") - F.col("n_plays")).filter(F.col(entity).isNotNull())
    out = plays.join(tested, entity, "left").join(kept, entity, "left").na.fill(0, ["n_tests", "n_significant", "n_tells"])
    note = F.when(F.col("others") == 0, "no other entity to compare with").when(F.col("n_tests") == 0, "no signal reached the least support").when(F.col("n_tells") == 0, "nothing passed the false discovery control and the effect floor")
    return out.withColumn("note", note).drop("others")


def forward_tells(df: DataFrame, entity: str, outcome: str, week: str, cues: list[str], classes: list[str], params: MiningParams = MiningParams(), least_weeks: int = 4) -> DataFrame:
    """WIN-15, JOIN-26: the tells that each fold mines on all weeks before its own, with what its own week says of them.

    A fold is a week that has at least least_weeks before it. Weekly counts are taken once; each cell's training sums and
    weights are running sums over the weeks, so the work is cells times weeks and rows are never read again.
    """
    k = range(len(classes))
    counts = cue_counts(df, entity, outcome, cues, classes, week, params).filter("__week is not null")
    weeks = counts.filter(F.col("cue_key") == TOTAL).agg(F.array_sort(F.collect_set("__week")).alias("weeks"))  # one row
    keys, sums = [entity, "cue_key", "cue_value"], ["n", *(f"c{i}" for i in k)]
    # every cell has a row in every week after its first
    grid = counts.groupBy(*keys).agg(F.min("__week").alias("since")).crossJoin(F.broadcast(weeks)).select(*keys, F.explode(F.filter("weeks", lambda x: x > F.col("since"))).alias("__week"), *(F.lit(0).cast("long").alias(c) for c in sums))
    dense = counts.select(*keys, "__week", *sums).unionByName(grid).repartition(*keys).groupBy(*keys, "__week").agg(*(F.sum(c).alias(c) for c in sums)).crossJoin(F.broadcast(weeks))
    nth = F.array_position("weeks", F.col("__week")) - 1
    dense = dense.withColumn("__nth", nth).withColumn("__last", F.when(F.col("__nth") > 0, F.get("weeks", (F.col("__nth") - 1).cast("int"))))
    half = params.half_life if params.use_recency else float("inf")
    # weights up to a factor of the fold, which brings them to 1 at its last week
    grown = dense.withColumn("__g", F.pow(F.lit(2.0), (F.col("__week") - F.col("weeks")[0]) / half))
    before = Window.partitionBy(*keys).orderBy("__week").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    scale = F.pow(F.lit(0.5), (F.col("__last") - F.col("weeks")[0]) / half)
    g = F.col("__g")
    own = grown.select(
        *keys, F.col("__week").alias("fold"), "__nth", F.col("n").alias("test_n"), *(F.col(f"c{i}").alias(f"t{i}") for i in k), upto(F.col("n")).cast("long").alias("n"), (upto(F.col("n") * g) * scale).alias("w"), (upto(F.col("n") * g * g) * scale * scale).alias("wsq"),
        *(upto(F.col(f"c{i}")).cast("long").alias(f"c{i}") for i in k), *((upto(F.col(f"c{i}") * g) * scale).alias(f"w{i}") for i in k),
    )
    own = own.filter((F.col("__nth") >= least_weeks) & (F.col("n") > 0))
    found = cells(own, entity, outcome, classes, params, ["fold"], test_hits="t")
    tests = own.filter((F.col("cue_key") == TOTAL) & (F.col("test_n") > 0)).select("fold", entity)
    return best_tells(candidates(found.join(tests, ["fold", entity], "left_semi"), entity, outcome, params, ["fold"]), entity, outcome, params, ["fold"])


def forward_validation(df: DataFrame, entity: str, outcome: str, week: str, cues: list[str], classes: list[str], params: MiningParams = MiningParams(), least_weeks: int = 4) -> DataFrame:
    """JOIN-10, JOIN-26, AGG-23: how the tells of all folds did in the weeks after; rates are those of the last fold that had rows to try, else of the first."""
    tried = forward_tells(df, entity, outcome, week, cues, classes, params, least_weeks)
    had = F.when(F.col("test_n") > 0, F.col("fold"))
    at = lambda c: F.coalesce(F.max_by(c, had), F.min_by(c, "fold"))
    out = tried.groupBy(entity, "cue_key", "cue_value", outcome).agg(F.sum("test_n").alias("trials"), F.sum("test_hits").alias("hits"), F.count_if(F.col("test_n") > 0).alias("folds"), F.min("fold").cast("long").alias("first_week"), at("shrunk_rate").alias("mined_rate"), at("expected_rate").alias("expected_rate"))
    low, high = stats.wilson(F.col("hits"), F.col("trials"))
    up = F.col("mined_rate") >= F.col("expected_rate")
    rate = F.try_divide("hits", "trials")
    return out.withColumns({"direction": F.when(up, 1).otherwise(-1), "holdout_rate": rate, "shrinkage": (F.col("mined_rate") - rate) * F.when(up, 1).otherwise(-1), "held_up": (F.col("trials") >= 5) & F.when(up, low > F.col("expected_rate")).otherwise(high < F.col("expected_rate"))})


def pooled_validation(found: DataFrame, by: list[str] = ()) -> DataFrame:
    """AGG-23: pooled hit rate by direction (a prediction and its opposite never mix), and the share that held up among those with five trials."""
    enough = F.col("trials") >= 5
    return found.groupBy(*by, "direction").agg(F.count(F.lit(1)).alias("tells"), F.try_divide(F.sum("hits"), F.sum("trials")).alias("hit_rate"), F.try_divide(F.sum(F.col("expected_rate") * F.col("trials")), F.sum("trials")).alias("expected_rate"), F.try_divide(F.count_if(enough & F.col("held_up")), F.count_if(enough)).alias("survival"))


def attach_validation(tells: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """JOIN-07: tells with what their validation says, where they were tried."""
    tried = found.filter("trials > 0").select(*keys, "trials", "hits", "holdout_rate", "held_up")
    line = F.when(F.col("trials").isNull(), "not yet tested out of sample").otherwise(F.format_string("held on %d of %d snaps since it was found", "hits", "trials"))
    return tells.join(tried, keys, "left").withColumns({"status": F.when(F.col("trials").isNull(), "untested").when(F.col("held_up"), "held").otherwise("faded"), "evidence_line": line})


def phrase(key: Column, value: Column) -> Column:
    """FN-STR-07: a signal in words; one without a phrase as `key is value`."""
    return F.replace(F.coalesce(mapped(key, PHRASES), F.concat(key, F.lit(" is {value}"))), F.lit("{value}"), value)


def description(entity: str, outcome: str) -> Column:
    """FN-STR-07: what a tell says, over the columns of best_tells."""
    whole = lambda c: percent(F.col(c))
    act = F.when(F.col("lift") > 0, "run").otherwise("avoid")
    parts = [F.lit("When "), phrase(F.col("cue_key"), F.col("cue_value")), F.lit(", "), F.col(entity), F.lit(" "), act, F.lit(" "), F.col(outcome), F.lit(" on "), whole("shrunk_rate"), F.lit(" of snaps, against "), whole("expected_rate"), F.lit(" expected from their own mix ("), whole("team_base_rate"), F.lit(" overall, league "), whole("baseline_rate"), F.lit(" after this look), n="), F.col("n_cue").cast("string")]
    return F.concat(*parts)
