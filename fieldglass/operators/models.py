"""Outcome classifiers and groupings on pyspark.ml: multiclass forests and boosted trees, importances, k-means."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a missing number; trees split it off.
MISSING = -99.0


def usable_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """ML-02, SET-05: columns with any known value, to be remembered with the model."""
    counts = df.agg(*(F.count(c).alias(c) for c in columns)).first()
    return [c for c in columns if counts[c]]


def class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """AGG-32, OP-04: the root of the inverse frequency, 1 on average over classes."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    rows = counts.collect()  # one per class
    total = sum(r["__n"] for r in rows)
    raw = {r[label]: (total / max(1, r["__n"])) ** 0.5 for r in rows}
    mean = sum(raw.values()) / max(1, len(raw))
    table = F.create_map(*(F.lit(x) for k, v in raw.items() for x in (k, v / mean)))
    return df.withColumn(out, F.try_element_at(table, F.col(label)))


def train_classifier(df: DataFrame, numbers: list[str], categories: list[str], label: str, kind: str = "forest", trees: int = 60, depth: int = 8, seed: int = 7) -> PipelineModel:
    """ML-01, ML-03: "forest", or "boosted" (one against the rest, since boosted trees are binary)."""
    numbers = usable_columns(df, numbers)
    filled = df.fillna(MISSING, numbers).fillna("unknown", categories)
    index = [StringIndexer(inputCol=c, outputCol=f"{c}__i", handleInvalid="keep") for c in categories]
    target = StringIndexer(inputCol=label, outputCol="__label", handleInvalid="skip", stringOrderType="alphabetAsc")
    vector = VectorAssembler(inputCols=[*numbers, *(f"{c}__i" for c in categories)], outputCol="__features", handleInvalid="keep")
    if kind == "forest":
        last = RandomForestClassifier(labelCol="__label", featuresCol="__features", numTrees=trees, maxDepth=depth, minInstancesPerNode=8, weightCol="weight", seed=seed, maxBins=64)
        filled = class_weight(filled, label)
    else:
        last = OneVsRest(classifier=GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, maxBins=64), labelCol="__label", featuresCol="__features")
    return Pipeline(stages=[*index, target, vector, last]).fit(filled)


def predict(model: PipelineModel, df: DataFrame, numbers: list[str], categories: list[str]) -> DataFrame:
    """ML-09, WIN-18: rows with the predicted class, its confidence, the runner-up and all probabilities (forests)."""
    labels = next(s.labels for s in model.stages if getattr(s, "getOutputCol", lambda: "")() == "__label")
    inner = PipelineModel([s for s in model.stages if getattr(s, "getOutputCol", lambda: "")() != "__label"])
    names = F.array(*(F.lit(x) for x in labels))
    scored = inner.transform(df.fillna(MISSING, numbers).fillna("unknown", categories))
    if "probability" not in scored.columns:
        return scored.withColumn("predicted", F.get(names, F.col("prediction").cast("int"))).select(*df.columns, "predicted")
    ranked = F.reverse(F.array_sort(F.transform(vector_to_array("probability"), lambda p, i: F.struct(p.alias("p"), (-i).alias("i")))))
    best = lambda k: F.get(names, -F.get(F.col("__r"), F.lit(k))["i"])
    out = scored.withColumn("__r", ranked)
    return out.select(*df.columns, best(0).alias("predicted"), F.get("__r", F.lit(0))["p"].alias("confidence"), best(1).alias("runner_up"), F.map_from_arrays(names, vector_to_array("probability")).alias("probabilities"))


def importances(model: PipelineModel) -> list[tuple[str, float]]:
    """ML-04, SRT-08: features by falling importance."""
    forest = next(s for s in model.stages if hasattr(s, "featureImportances"))
    vector = next(s for s in model.stages if isinstance(s, VectorAssembler))
    return sorted(zip(vector.getInputCols(), forest.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def permutation_importance(model: PipelineModel, df: DataFrame, numbers: list[str], categories: list[str], label: str, seed: int = 3, bucket: int = 10_000) -> DataFrame:
    """ML-04: the loss of accuracy when a column's values are dealt to other rows, within hashed buckets of about `bucket` rows, so no task orders all rows."""
    from pyspark.sql.window import Window

    right = lambda frame: predict(model, frame, numbers, categories).agg(F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("a")).first()["a"]
    whole, rows = right(df), []
    own = F.xxhash64(*df.columns)
    keyed = df.withColumn("__b", F.pmod(own, F.lit(max(1, df.count() // bucket))))
    keyed = keyed.withColumn("__k", F.row_number().over(Window.partitionBy("__b").orderBy(own)))
    for c in [*numbers, *categories]:
        other = keyed.select("__b", F.row_number().over(Window.partitionBy("__b").orderBy(F.xxhash64("__k", F.lit(seed)), "__k")).alias("__k"), F.col(c).alias("__v"))
        rows.append((c, whole - right(keyed.join(other, ["__b", "__k"]).withColumn(c, F.col("__v")).drop("__v", "__b", "__k"))))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def cluster(df: DataFrame, vector: str, k: int, seed: int = 5) -> DataFrame:
    """ML-07, VIS-08: k-means over an array column."""
    from pyspark.ml.functions import array_to_vector

    ready = df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(ready).transform(ready).drop("__v")


def nearest_side(x: Column, centres: list[list[float]]) -> Column:
    """VIS-07: the index of the nearest of a few centres."""
    away = [F.aggregate(F.zip_with(x, F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) for c in centres]
    return F.array_position(F.array(*away), F.least(*away)).cast("int") - 1
