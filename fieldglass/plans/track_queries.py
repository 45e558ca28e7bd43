"""Queries over plays that the engine makes itself, and models over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mining, models, rates, tracks
from .rate_queries import FORWARD, ONCE, SHOWN, tells_sql
from .tables import CUES, PRIORITIES, cue_table, longs, query, rounded, table


@query()
def play_cues(spark, d):
    """SRC-32, AGG-30, OP-05, OP-06: cues of made plays."""
    return tracks.cues(tracks.synthetic_plays(spark), ["play_id", "defense_team", "week", "coverage"])


@query()
def play_features(spark, d):
    """AGG-31."""
    return tracks.features(tracks.synthetic_plays(spark), ["play_id", "coverage"])


@query()
def planted_tells(spark, d):
    """OP-15, OP-16, OP-17: what mining finds in a made season with planted signals."""
    cues = tracks.cues(tracks.planted_plays(spark), ["play_id", "defense_team", "week", "coverage"])
    return rounded(mining.mine(cues, "defense_team", "coverage", tracks.CUE_KEYS, list(tracks.LEAGUE_MIX), "week", mining.MiningParams()))


@query()
def cue_tendency(spark, d):
    """AGG-01 over made plays by shell."""
    cues = tracks.cues(tracks.synthetic_plays(spark), ["play_id", "defense_team", "coverage"])
    return rounded(rates.tendency(cues, "defense_team", "coverage", ["shell"], ["Cover 0 Man", "Cover 1 Man", "Cover 2 Zone", "Cover 3 Zone", "Cover 4 Zone"], 3))


@query()
def forest_predictions(spark, d):
    """ML-03, ML-09: which return flag a line item gets, from its measures."""
    lc = cue_table(spark, d).select("flag", "l_quantity", "l_extendedprice", "l_discount", "status", "qty_band")
    model = models.train_classifier(lc, ["l_quantity", "l_extendedprice", "l_discount"], ["status", "qty_band"], "flag", trees=10, depth=4)
    out = models.predict(model, lc, ["l_quantity", "l_extendedprice", "l_discount"], ["status", "qty_band"])
    return out.groupBy("flag", "predicted").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query()
def embedding_clusters(spark, d):
    """ML-07."""
    return models.cluster(table(spark, d, "embeddings"), "embedding", 4).groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))


@query(FORWARD + f", once AS (WITH {tells_sql(ONCE, 0.02, 25)} SELECT * FROM tells) SELECT o.team, o.cue_key, o.cue_value, o.outcome, o.score, o.rank, trials, hits, round(holdout_rate, 6) AS holdout_rate, held_up, CASE WHEN trials IS NULL THEN 'untested' WHEN held_up THEN 'held' ELSE 'faded' END AS status, CASE WHEN trials IS NULL THEN 'not yet tested out of sample' ELSE 'held on ' || hits || ' of ' || trials || ' snaps since it was found' END AS evidence_line FROM once o LEFT JOIN (SELECT * FROM held WHERE trials > 0) h USING (team, cue_key, cue_value, outcome)")
def validated_tells(spark, d):
    """JOIN-07: mined cells with what later weeks say of them."""
    lc = cue_table(spark, d)
    tells = mining.mine(lc, "team", "outcome", CUES, PRIORITIES, "week", SHOWN).select("team", "cue_key", "cue_value", "outcome", "score", "rank")
    found = mining.forward_validation(lc, "team", "outcome", "week", CUES, PRIORITIES, SHOWN)
    return longs(rounded(mining.attach_validation(tells, found, ["team", "cue_key", "cue_value", "outcome"])), "rank")
