"""Connected components of a graph that no machine needs to hold: alternating large and small stars over edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of each batch as stars around the smallest id of each of its trees: redundant edges go before any shuffle."""
    for batch in batches:
        a, b = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
        left, right = index[: len(a)], index[len(a) :]
        root = np.arange(len(nodes))
        while len(left):
            low = np.minimum(root[left], root[right])
            high = np.maximum(root[left], root[right])
            if (low == high).all():
                break
            np.minimum.at(root, high, low)
            while (root != root[root]).any():
                root = root[root]
        own = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], ["u", "v"])


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: two long columns without nulls. Returns id and component, its smallest id, for every id of an edge."""
    a, b = edges.columns
    now = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").mapInArrow(_forest, "u long, v long"), "edges")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    last = mark(now)
    while last[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours move to the smallest one of the neighbourhood
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "large")
        # small star: smaller neighbours, and the node itself, move to the smallest
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = written(small, "small")
        found = mark(now)
        if found == last:
            break
        last = found
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
