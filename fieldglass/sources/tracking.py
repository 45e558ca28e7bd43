"""Raw tracking tables: games, plays, weekly frames and coverage labels, built into play documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import FIELD_WIDTH, normalize_xy
from ..functions.strings import normalize_label, personnel_code
from ..operators.sequences import keep_one

GAMES = "gameId long, gameDate string, season int, week int, homeTeamAbbr string, visitorTeamAbbr string"
FRAMES = "gameId long, playId long, frameId int, event string, playDirection string, team string, nflId long, x double, y double, jerseyNumber int, position string"


def read_csv(spark: SparkSession, path: str, schema: str | None = None, separator: str = ",") -> DataFrame:
    """By header names, whatever their order; a schema casts and prunes."""
    raw = spark.read.option("header", True).option("sep", separator).csv(path)
    if schema is None:
        return raw
    kinds = [part.strip().split(" ") for part in schema.split(",")]
    there = {c.lower(): c for c in raw.columns}
    return raw.select(*((F.col(f"`{there[n.lower()]}`").try_cast(t) if n.lower() in there else F.lit(None).cast(t)).alias(n) for n, t in kinds))


def read_weeks(spark: SparkSession, paths: list[str], weeks: list[int] | None = None) -> DataFrame:
    """SRC-10: the weeks asked for, by the digits of the file name; other files are not opened."""
    import re

    wanted = [p for p in paths if weeks is None or int((re.findall(r"(\d+)\.csv", p) or ["-1"])[0]) in weeks]
    out = None
    for p in wanted:
        part = read_csv(spark, p, FRAMES)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], FRAMES) if out is None else out


def normalize_labels(raw: DataFrame, aliases: dict[str, str], vocabulary: list[str], order: Column | None = None) -> DataFrame:
    """SRC-11, SRC-12: headers in any case or snake case; unknown labels go; the first of a play in order stays."""
    names = {c.lower().replace("_", ""): c for c in raw.columns}
    typed = raw.select(F.col(names["gameid"]).try_cast("long").alias("gameId"), F.col(names["playid"]).try_cast("long").alias("playId"), normalize_label(F.col(names["coverage"]), aliases, vocabulary).alias("coverage"), (F.lit(0) if order is None else order).alias("__o"))
    return keep_one(typed.dropna(subset=["gameId", "playId", "coverage"]), ["gameId", "playId"], [F.col("__o"), F.col("coverage")]).drop("__o")


def game_season(date: Column, season: Column) -> Column:
    """FN-DT-01: the season, else the year of a month/day/year date, else 2018."""
    return F.coalesce(season, F.year(F.try_to_timestamp(date, F.lit("M/d/yyyy"))), F.lit(2018))


def build_plays(frames: DataFrame, plays: DataFrame, games: DataFrame, labels: DataFrame, labelled_only: bool = True) -> DataFrame:
    """PRJ-05, JOIN-01..04, OP-13: tracks relative to the ball at the first snap frame, ten frames a second.

    Frames shuffle once, by play. Plays, games and labels are dimensions of the frames; Spark broadcasts them by size.
    """
    key = ["gameId", "playId"]
    if labelled_only:
        frames = frames.join(labels.select(*key), key, "left_semi")
    snap = F.struct(F.col("frameId").alias("f"))
    starts = frames.filter("event = 'ball_snap'").groupBy(*key).agg(F.min(snap)["f"].alias("snap"))
    ball = frames.filter("team = 'football'").join(starts, key).filter("frameId = snap").groupBy(*key).agg(F.first("x").alias("bx"), F.first("y").alias("by"))
    context = plays.join(games, "gameId", "left").join(labels, key, "left")
    players = frames.filter("team <> 'football' and nflId is not null").join(starts, key).join(ball, key)
    x, y = normalize_xy(F.col("x"), F.col("y"), F.col("playDirection"))
    bx, by = normalize_xy(F.col("bx"), F.col("by"), F.col("playDirection"))
    moved = players.select(*key, "team", "nflId", "jerseyNumber", "position", ((F.col("frameId") - F.col("snap")) / 10.0).alias("t"), (x - bx).alias("x"), (y - F.lit(FIELD_WIDTH / 2)).alias("y"), (by - F.lit(FIELD_WIDTH / 2)).alias("ball_y"))
    tracks = moved.groupBy(*key, "team", "nflId").agg(F.first("jerseyNumber").alias("jersey"), F.first("position").alias("position"), F.first("ball_y").alias("ball_y"), F.array_sort(F.collect_list(F.struct("t", "x", "y"))).alias("path"))
    joined = tracks.join(context, key)
    home = F.col("team") == "home"
    offense = F.when(home, F.col("homeTeamAbbr")).otherwise(F.col("visitorTeamAbbr")) == F.col("possessionTeam")
    player = F.struct(F.format_string("%s_%d", F.when(offense, "O").otherwise("D"), "nflId").alias("track_id"), F.when(offense, "offense").otherwise("defense").alias("side"), "jersey", "position", "path")
    margin = F.when(F.col("possessionTeam") == F.col("homeTeamAbbr"), F.col("preSnapVisitorScore") - F.col("preSnapHomeScore")).otherwise(F.col("preSnapHomeScore") - F.col("preSnapVisitorScore"))
    defense = F.when(F.col("possessionTeam") == F.col("homeTeamAbbr"), F.col("visitorTeamAbbr")).otherwise(F.col("homeTeamAbbr"))
    return joined.groupBy(*key).agg(
        F.first("week").alias("week"), F.first(game_season(F.col("gameDate"), F.col("season"))).alias("season"), F.first(defense).alias("defense_team"), F.first("possessionTeam").alias("offense_team"), F.first("coverage").alias("coverage"),
        F.first("down").alias("down"), F.first("yardsToGo").alias("distance"), F.first(margin).alias("score_margin"), F.first(personnel_code(F.col("personnelO"))).alias("offense_personnel"), F.first("ball_y").alias("ball_y_from_center"), F.array_sort(F.collect_list(player)).alias("players"),
    ).withColumn("play_id", F.format_string("bdb-%d-%d", "gameId", "playId"))


def league_rates(plays: DataFrame, outcome: str, classes: list[str]) -> DataFrame:
    """AGG-04, SRC-22: shares of the classes, alike for all without plays."""
    n = F.sum(F.when(F.col(outcome).isin(classes), 1).otherwise(0))
    shares = [F.coalesce(F.try_divide(F.sum((F.col(outcome) == c).cast("int")), n), F.lit(1 / len(classes))).alias(c) for c in classes]
    return plays.agg(*shares)


def label_summary(labels: DataFrame, games: DataFrame) -> DataFrame:
    """SRC-14: how many plays have a label, and which weeks they are from, in one row."""
    weeks = labels.join(games.select("gameId", "week").dropDuplicates(["gameId"]), "gameId", "left")
    return weeks.agg(F.count(F.lit(1)).alias("n_labeled"), F.array_sort(F.collect_set(F.col("week").try_cast("int"))).alias("weeks"))


def save_league_rates(plays: DataFrame, outcome: str, classes: list[str], path: str) -> None:
    """SRC-22: one row of shares as JSON."""
    league_rates(plays, outcome, classes).coalesce(1).write.mode("overwrite").json(path)


def load_league_rates(spark: SparkSession, path: str, classes: list[str]) -> dict[str, float] | None:
    """SRC-22: the shares, brought to a total of 1 again over the classes; None where nothing is stored or the total is not positive."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    rows = spark.read.schema(", ".join(f"`{c}` double" for c in classes)).json(path).limit(1).collect()
    found = {c: max(0.0, rows[0][c] or 0.0) for c in classes} if rows else {}
    total = sum(found.values())
    return {c: v / total for c, v in found.items()} if total > 0 else None
