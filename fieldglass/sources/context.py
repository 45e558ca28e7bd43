"""Play context from several exports, in one shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import success
from ..functions.strings import normalize_team, personnel_code, slug
from ..operators.sequences import keep_one

#: Fixed shape.
CONTEXT = {"play_id": "string", "season": "bigint", "week": "bigint", "defense_team": "string", "offense_team": "string", "down": "bigint", "quarter": "bigint", "distance": "double", "yardline": "double", "clock_seconds": "double", "score_margin": "double", "yards_gained": "double", "epa": "double", "offense_personnel": "string", "play_type": "string", "success": "boolean", "coverage": "string", "coverage_source": "string", "source": "string"}


def first_of(rows: DataFrame, *names: str) -> Column:
    """The first of several columns that is there and known."""
    there = [F.col(f"`{n}`") for n in names if n in rows.columns]
    return F.coalesce(*there) if there else F.lit(None)


def to_play_context(rows: DataFrame, source: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """PRJ-01: all columns, cast (bad numbers become null), teams normalised, success filled in."""
    typed = rows.select(*((F.col(n).try_cast(t) if n in rows.columns else F.lit(None).cast(t)).alias(n) for n, t in CONTEXT.items()))
    teams = {n: normalize_team(F.col(n), aliases or {}) for n in ("defense_team", "offense_team")}
    filled = F.coalesce("success", success(F.col("down"), F.col("distance"), F.col("yards_gained")))
    return typed.withColumns(teams | {"source": F.coalesce("source", F.lit(source)), "success": filled}).select(*CONTEXT)


def from_play_by_play(rows: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """PRJ-03, SRC-15: margin from the defense's side."""
    f = lambda *n: first_of(rows, *n)
    renamed = rows.select(F.concat_ws("-", f("game_id"), f("play_id").cast("string")).alias("play_id"), f("season").alias("season"), f("week").alias("week"), f("defteam").alias("defense_team"), f("posteam").alias("offense_team"), f("down").alias("down"), f("qtr").alias("quarter"), f("ydstogo").alias("distance"), f("yardline_100").alias("yardline"), f("quarter_seconds_remaining").alias("clock_seconds"), (-f("score_differential").cast("double")).alias("score_margin"), f("yards_gained").alias("yards_gained"), f("epa").alias("epa"), personnel_code(f("offense_personnel").cast("string"), F.lit(None).cast("string")).alias("offense_personnel"), f("play_type").alias("play_type"))
    return to_play_context(renamed, "pbp", aliases)


def from_college(rows: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """PRJ-02, FN-DT-02: names differ by endpoint version; the clock is minutes and seconds."""
    f = lambda *n: first_of(rows, *n)
    clock = f("clock.minutes", "clock_minutes").cast("double") * 60 + F.coalesce(f("clock.seconds", "clock_seconds").cast("double"), F.lit(0.0))
    renamed = rows.select(f("id", "play_id").cast("string").alias("play_id"), f("season", "year").alias("season"), f("week").alias("week"), f("defense", "defense_team").alias("defense_team"), f("offense", "offense_team").alias("offense_team"), f("down").alias("down"), f("period", "quarter").alias("quarter"), f("distance").alias("distance"), f("yardsToGoal", "yards_to_goal", "yardline").alias("yardline"), clock.alias("clock_seconds"), (f("defenseScore", "defense_score").cast("double") - f("offenseScore", "offense_score").cast("double")).alias("score_margin"), f("yardsGained", "yards_gained").alias("yards_gained"), f("ppa", "epa").alias("epa"), f("playType", "play_type").alias("play_type"))
    return to_play_context(renamed, "college", aliases)


def merge_context(parts: list[DataFrame]) -> DataFrame:
    """SET-01, SET-02: all parts; of equal ids a labelled row, then the earlier part."""
    tagged = [p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return keep_one(both, ["play_id"], [F.col("coverage").isNull().cast("int"), F.col("__part")]).drop("__part")


#: Fixed aliases of per-snap headers, by canonical name.
HEADERS = {"play_id": ["play_id", "playid", "pff_playid"], "game_id": ["game_id", "gameid", "pff_gameid"], "coverage": ["coverage", "coverage_scheme", "pass_coverage", "pff_passcoverage"], "defense_team": ["defense", "defense_team", "def_team"], "offense_team": ["offense", "offense_team", "off_team"], "week": ["week"], "season": ["season", "year"], "player": ["player", "player_name"], "snaps": ["snaps", "snap_counts_coverage"], "grade": ["grade", "grades_coverage_defense"]}


def sniff(columns: list[str]) -> tuple[str, float, dict[str, str]]:
    """SRC-20, TRAP-19: kind of an export by its header, confidence, and which column is which (the first alias in order)."""
    canon = {c.strip().lower().replace(" ", "_").replace("-", "_"): c for c in columns}
    found = {k: next(canon[a] for a in aliases if a in canon) for k, aliases in HEADERS.items() if any(a in canon for a in aliases)}
    if "play_id" in found and "coverage" in found:
        return "per_snap", 0.95, found
    if "coverage" in found and "snaps" in found:
        return "coverage_summary", 0.8 if "defense_team" in found else 0.6, found
    if "player" in found and "grade" in found:
        return "player_grades", 0.8, found
    return "unknown", 0.2, found


def coverage_rates(rows: DataFrame, keys: list[str], snaps: str = "snaps") -> DataFrame:
    """AGG-10: snaps by the keys there are; null keys stay."""
    return rows.groupBy(*[k for k in keys if k in rows.columns]).agg(F.sum(F.col(snaps).try_cast("double")).alias("snaps"))


def usable_window(rows: DataFrame, entity: str, cuts: DataFrame, week: str = "week") -> DataFrame:
    """PRJ-12, JOIN-25, TRAP-28, SET-07: an entity with a cut keeps rows from that week; others keep all. cuts: entity, cut (one per entity)."""
    return rows.join(cuts, entity, "left").filter(F.col("cut").isNull() | F.coalesce(F.col(week) >= F.col("cut"), F.lit(False))).drop("cut")


def report_slug(name: Column) -> Column:
    """SRC-27."""
    return slug(name)


def drop_folder(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """SRC-21: every CSV and TSV under a folder, renamed by its header and put together by kind, with _source_file; unknown kinds go.

    One read for each distinct header, not for each file: files of one header are one input.
    """
    found: dict[str, DataFrame] = {}
    for suffix, sep in (("csv", ","), ("tsv", "\t")):
        options = {"recursiveFileLookup": "true", "pathGlobFilter": f"*.{{{suffix},{suffix.upper()}}}", "sep": sep}
        lines = spark.read.options(recursiveFileLookup="true", pathGlobFilter=options["pathGlobFilter"], wholetext="false").text(path)
        # the first line of each file: the smallest place in it
        heads = lines.select(F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).filter("block = 0").groupBy("file").agg(F.first("value").alias("head"))
        files: dict[str, list[str]] = {}
        for r in heads.collect():  # one short row for each export file
            files.setdefault(r["head"], []).append(r["file"])
        for names in files.values():
            rows = spark.read.option("header", True).option("sep", sep).csv(sorted(names))
            kind, _, mapping = sniff(rows.columns)
            if kind == "unknown":
                continue
            rows = rows.select(*(F.col(f"`{c}`").alias(next((k for k, v in mapping.items() if v == c), c)) for c in rows.columns), F.col("_metadata.file_name").alias("_source_file"))
            found[kind] = rows if kind not in found else found[kind].unionByName(rows, allowMissingColumns=True)
    return found


def from_per_snap(rows: DataFrame, source: str, labels: Column, aliases: dict[str, str] | None = None) -> DataFrame:
    """PRJ-04: per-snap rows under the names of HEADERS as play context; labels: the normalised coverage of a row. Without a play id the game's stands in."""
    f = lambda *n: first_of(rows, *n)
    own = F.coalesce(F.nullif(f("play_id").cast("string"), F.lit("")), f("game_id").cast("string"), F.lit("None"))
    named = rows.select(F.concat(F.lit(f"{source}-"), own).alias("play_id"), f("season").alias("season"), f("week").alias("week"), f("defense_team", "team").alias("defense_team"), f("offense_team", "opponent").alias("offense_team"), f("down").alias("down"), f("distance").alias("distance"), f("yards_gained").alias("yards_gained"), f("epa").alias("epa"), labels.alias("coverage"), F.when(labels.isNotNull(), source).alias("coverage_source"), F.lit(source).alias("source"))
    return to_play_context(named, source, aliases)


def through_week(rows: DataFrame, last: float, week: str = "week") -> DataFrame:
    """PRJ-11: rows up to a week; weeks that are no numbers go."""
    return rows.filter(F.col(week).cast("string").try_cast("double") <= last)
