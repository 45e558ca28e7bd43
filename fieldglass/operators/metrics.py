"""Classification, calibration, detection and tracking metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def confusion(df: DataFrame, truth: str, predicted: str, classes: list[str]) -> DataFrame:
    """AGG-14: every pair of classes, zeros included, in one grouping."""
    sums = df.groupBy(truth).agg(*(F.sum(F.when(F.col(predicted) == c, 1).otherwise(0).cast("long")).alias(f"c{i}") for i, c in enumerate(classes)))
    dims = df.sparkSession.createDataFrame([(c,) for c in classes], f"`{truth}` string")
    wide = dims.join(sums, truth, "left")
    each = F.explode(F.array(*(F.struct(F.lit(c).alias(predicted), F.coalesce(F.col(f"c{i}"), F.lit(0).cast("long")).alias("n")) for i, c in enumerate(classes)))).alias("e")
    return wide.select(truth, each).select(truth, "e.*")


def accuracy_summary(df: DataFrame, truth: str, ranked: str, families: dict[str, str] | None = None) -> DataFrame:
    """AGG-15: accuracy, top-2, family accuracy, majority share and lift in one row. ranked: array of classes, best first."""
    first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    right, two = (first == F.col(truth)).cast("int"), ((first == F.col(truth)) | F.coalesce(second == F.col(truth), F.lit(False))).cast("int")
    family = lambda c: F.try_element_at(F.create_map(*(F.lit(x) for kv in (families or {"": ""}).items() for x in kv)), c)
    by = df.filter(F.col(truth).isNotNull()).groupBy(truth).agg(F.count(F.lit(1)).alias("n"), F.sum(right).alias("hit"), F.sum(two).alias("hit2"), F.sum((family(first) == family(F.col(truth))).cast("int")).alias("hitf"))
    total = F.sum("n")
    return by.agg(total.alias("n"), (F.sum("hit") / total).alias("accuracy"), (F.sum("hit2") / total).alias("top2"), (F.sum("hitf") / total).alias("family_accuracy"), (F.max("n") / total).alias("majority"), (F.sum("hit") / total - F.max("n") / total).alias("lift"))


def f1_by_class(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """AGG-16: precision, recall and F1 of every class that is true or predicted somewhere; undefined ones count as 0."""
    sides = df.select(F.explode(F.array(F.struct(F.col(truth).alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(truth) == F.col(predicted)).cast("int").alias("tp")), F.struct(F.col(predicted).alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("tp")))).alias("s")).select("s.*").filter("class is not null")
    sums = sides.groupBy("class").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("tp").alias("tp"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.select("class", F.col("t").alias("support"), share(F.col("tp"), F.col("p")).alias("precision"), share(F.col("tp"), F.col("t")).alias("recall"), share(2 * F.col("tp"), F.col("t") + F.col("p")).alias("f1"))


def log_loss(df: DataFrame, p_true: Column, clip: float = 1e-15) -> DataFrame:
    """AGG-17."""
    return df.agg((-F.avg(F.ln(F.greatest(F.lit(clip), F.least(F.lit(1.0), p_true))))).alias("log_loss"))


def calibration(df: DataFrame, confidence: Column, right: Column, bins: int = 10) -> DataFrame:
    """AGG-18, OP-03: equal bins over [0, 1], the last one closed: count, mean confidence, accuracy and gap."""
    which = F.least(F.lit(bins - 1), F.floor(confidence * bins)).cast("int")
    sums = df.groupBy(which.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("confidence"), F.avg(right.cast("double")).alias("accuracy"))
    return sums.withColumn("gap", F.col("confidence") - F.col("accuracy"))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs("gap")) / F.sum("n")).alias("ece"))


def precision_recall(df: DataFrame, score: str, positive: Column, truths: int | Column, key: str, by: list[str] = (), ranges: int = 256) -> DataFrame:
    """WIN-16: the curve by falling score (ties by key), with the precision envelope and the recall step of each row.

    Scores fall into ranges of about equal size; what stands before and after a range comes from one small row for each,
    so no task sorts all rows of a class. Null scores come last.
    """
    by = list(by)
    grid = F.percentile_approx(score, F.array(*(F.lit(i / ranges) for i in range(1, ranges))), 10_000)
    cuts = df.groupBy(*by).agg(grid.alias("__cuts"))
    placed = df.join(cuts, by) if by else df.crossJoin(F.broadcast(cuts))  # one row
    place = F.when(F.col(score).isNull(), ranges + 1).otherwise(F.size(F.filter("__cuts", lambda c: c > F.col(score))))
    placed = placed.withColumns({"__tp": positive.cast("long"), "__range": place}).drop("__cuts")
    falling = Window.partitionBy(*by).orderBy("__range")
    earlier, later = falling.rowsBetween(Window.unboundedPreceding, -1), falling.rowsBetween(1, Window.unboundedFollowing)
    sums = placed.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__n"), F.sum("__tp").alias("__t"))
    before = sums.select(*by, "__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__t0"))
    down = Window.partitionBy(*by, "__range").orderBy(F.col(score).desc(), key)
    flagged = placed.join(before, [*by, "__range"]).withColumn("__rn", F.row_number().over(down) + F.col("__n0")).withColumn("tp", F.sum("__tp").over(down.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__t0"))
    total = F.lit(truths) if isinstance(truths, int) else truths
    curve = flagged.withColumn("precision", F.col("tp") / F.col("__rn")).withColumn("recall", F.coalesce(F.try_divide(F.col("tp"), total), F.lit(0.0)))
    after = curve.groupBy(*by, "__range").agg(F.max("precision").alias("__best")).select(*by, "__range", F.max("__best").over(later).alias("__after"))
    up = Window.partitionBy(*by, "__range").orderBy(F.col("__rn").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = curve.join(after, [*by, "__range"]).withColumns({"envelope": F.greatest(F.max("precision").over(up), F.col("__after")), "step": F.col("__tp") / total})
    return out.drop("__tp", "__rn", "__range", "__n0", "__t0", "__after")


def average_precision(curve: DataFrame, by: list[str] = ()) -> DataFrame:
    return curve.groupBy(*by).agg(F.coalesce(F.sum(F.col("step") * F.col("envelope")), F.lit(0.0)).alias("ap"))


def detection_summary(matched: DataFrame, by: list[str], predicted: Column, truth: Column, iou: Column) -> DataFrame:
    """AGG-24: pooled counts: rows hold a match, or only one side of it."""
    both = predicted & truth
    count = lambda c: F.sum(c.cast("long"))
    sums = matched.groupBy(*by).agg(count(both).alias("tp"), count(predicted & ~truth).alias("fp"), count(truth & ~predicted).alias("fn"), F.avg(F.when(both, iou)).alias("mean_iou"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn")), "f1": share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def tracking_summary(matches: DataFrame, frames: DataFrame, clip: str = "clip", frame: str = "frame", truth: str = "truth", track: str = "track") -> DataFrame:
    """AGG-25, WIN-13, WIN-14: id switches, fragments and mostly tracked truths by clip.

    matches: one row per matched (frame, truth, track); frames: all (frame, truth) there are.
    """
    by_track = Window.partitionBy(clip, track).orderBy(frame)
    switches = matches.withColumn("__s", (F.lag(truth).over(by_track) != F.col(truth)).cast("long")).groupBy(clip).agg(F.coalesce(F.sum("__s"), F.lit(0)).alias("id_switches"))
    seen = frames.join(matches.select(clip, frame, truth, F.lit(1).alias("__m")), [clip, frame, truth], "left")
    by_truth = Window.partitionBy(clip, truth).orderBy(frame)
    lost = seen.withColumn("__f", (F.lag("__m").over(by_truth).isNotNull() & F.col("__m").isNull()).cast("long"))
    spans = lost.groupBy(clip, truth).agg(F.sum("__f").alias("f"), (F.count("__m") / F.count(F.lit(1))).alias("share"))
    sums = spans.groupBy(clip).agg(F.count(F.lit(1)).alias("truths"), F.sum("f").alias("fragments"), F.avg((F.col("share") >= 0.8).cast("double")).alias("mostly_tracked"))
    return sums.join(switches, clip, "left").withColumn("id_switches", F.coalesce("id_switches", F.lit(0)))


def gates(metrics: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """ML-10, SRT-10: a score for each criterion and the weakest one, over one row of metrics. limits: name = (good, best)."""
    from ..functions.stats import criterion_score

    each = F.array(*(F.struct(criterion_score(F.col(n), good, best).alias("score"), F.lit(n).alias("criterion")) for n, (good, best) in limits.items()))
    return metrics.select(F.explode(each).alias("g"), F.array_min(each)["criterion"].alias("weakest")).select("g.criterion", "g.score", "weakest")
