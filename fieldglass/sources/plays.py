"""Play documents: JSON or Parquet trees by source, missing numbers as nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: SRC-01: the fields of a play that operators read; others are ignored by the reader.
PLAY = """play_id string, source string, season int, week int, game_id string, defense_team string, offense_team string, coverage string,
play_direction string, snap_frame_in_video int, video_fps double, origin_x double, origin_y double, homography array<array<double>>,
situation struct<down:int,distance:double,yardline:double,quarter:int,seconds_remaining:double,score_margin:int,offense_personnel:string,ball_y_from_center:double,hash_side:string,league:string,pre_snap_motion_yards:double,motion_at_snap:boolean>,
quality struct<defenders_detected:int,offense_detected:int,mean_detection_conf:double,registration_error_yd:double,frames_with_full_defense:double,notes:array<string>,score:double,usable:boolean>,
time_grid array<double>, players array<struct<track_id:string,side:string,jersey:int,position:string,role:string,is_ball_carrier:boolean,x:array<double>,y:array<double>>>"""

#: Fixed order: the first source with plays is the default.
PRIORITY = ("bdb", "bdb2025", "film", "pff", "hudl", "synthetic")


def known(value: Column) -> Column:
    """TRAP-01: NaN as null."""
    return F.when(~F.isnan(value), value)


def load_plays(spark: SparkSession, path: str, limit: int | None = None, recursive: bool = False, name: str = "*.json") -> DataFrame:
    """SRC-01, FN-ARR-09: one play per file, without predictions.json, NaN as null; limit takes the first files by name."""
    read = spark.read.schema(PLAY).option("multiLine", True).option("allowNonNumericNumbers", True).option("pathGlobFilter", name).option("recursiveFileLookup", recursive)
    plays = read.json(path).withColumn("__file", F.col("_metadata.file_name")).filter("__file <> 'predictions.json' and play_id is not null")
    plays = plays.orderBy("__file").limit(limit) if limit else plays
    clean = F.transform("players", lambda p: p.withField("x", F.transform(p["x"], known)).withField("y", F.transform(p["y"], known)))
    return plays.withColumn("players", clean).drop("__file")


def _source_path(spark: SparkSession, path: str, source: str) -> tuple:
    """The file system and the folder of one source."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/source={source}")
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def save_plays(plays: DataFrame, path: str, key: str = "play_id") -> None:
    """SRC-02: stores plays by source; a stored play of the same source and id is replaced, all others stay. Of equal new ids the one with the greatest hash stays.

    Only the sources that the new plays have are read and written again, beside the stored files until all is written.
    """
    spark = plays.sparkSession
    nth = F.row_number().over(Window.partitionBy("source", key).orderBy(F.xxhash64(*plays.columns).desc()))
    new = plays.withColumn("__nth", nth).filter("__nth = 1").drop("__nth")
    for source in sorted(r[0] for r in plays.select("source").distinct().collect() if r[0] is not None):  # a handful
        system, folder = _source_path(spark, path, source)
        part = new.filter(F.col("source") == source).drop("source")
        following = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_next-{source}")
        if system.exists(folder):
            old = spark.read.parquet(folder.toString())
            part = old.join(part.select(key), key, "left_anti").unionByName(part, allowMissingColumns=True)
        part.write.mode("overwrite").parquet(following.toString())
        system.delete(folder, True)
        system.rename(following, folder)
    spark.catalog.refreshByPath(path)


def clear_plays(spark: SparkSession, path: str, source: str) -> bool:
    """SRC-03: deletes the stored plays of a source; its predictions, which lie elsewhere, stay. Whether there were any."""
    system, folder = _source_path(spark, path, source)
    there = system.exists(folder)
    if there:
        system.delete(folder, True)
        spark.catalog.refreshByPath(path)
    return there


def source_counts(plays: DataFrame) -> DataFrame:
    """AGG-38."""
    return plays.groupBy("source").agg(F.count(F.lit(1)).alias("plays"))


def resolve_source(plays: DataFrame, wanted: str = "auto") -> DataFrame:
    """SRC-04, SRC-05: all, one by name, or for auto the first of the priority that has plays. The filter prunes partitions."""
    if wanted == "all":
        return plays
    if wanted != "auto":
        return plays.filter(F.col("source") == wanted)
    there = {r[0] for r in plays.select("source").distinct().collect()}  # a handful of sources
    first = next((s for s in PRIORITY if s in there), None)
    return plays.filter(F.col("source") == first) if first else plays.limit(0)


def merge_predictions(old: DataFrame, new: DataFrame, key: str = "play_id") -> DataFrame:
    """SRC-23: new rows replace those of their key, others stay: an anti-join, no sort of both."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def restore(new: DataFrame, old: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """PRJ-24: known old values win over new ones."""
    kept = old.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    return new.join(kept, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*(f"__{c}" for c in columns))


def upsert_labels(manifest: DataFrame, label: DataFrame, clip: str = "clip_id", start: str = "start_frame") -> DataFrame:
    """SRC-24: labels (clip, start, ..) into each clip's nested plays, one per start, in order."""
    nested = [f.name for f in manifest.schema["plays"].dataType.elementType.fields]
    held = manifest.select(clip, F.explode("plays").alias("p")).select(clip, "p.*").join(label.select(clip, start), [clip, start], "left_anti")
    both = held.unionByName(label.select(clip, *nested))
    plays = both.groupBy(clip).agg(F.array_sort(F.collect_list(F.struct(start, *(n for n in nested if n != start)))).alias("__plays"))
    ordered = F.transform("__plays", lambda p: F.struct(*(p[n].alias(n) for n in nested)))
    return manifest.join(plays, clip, "left").withColumn("plays", F.coalesce(ordered, F.col("plays"))).drop("__plays")
