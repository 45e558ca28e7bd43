"""A warehouse of Parquet tables under one root, with SQL over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequences import keep_one

TABLES = ("plays", "cues", "features", "predictions", "tells", "context")


class Warehouse:
    def __init__(self, spark: SparkSession, root: str, tables: tuple[str, ...] = TABLES):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables

    def path(self, name: str) -> str:
        """SRC-07: unknown names raise KeyError."""
        if name not in self.tables:
            raise KeyError(name)
        return f"{self.root}/{name}.parquet"

    def exists(self, name: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def read(self, name: str, schema: str = "play_id string") -> DataFrame:
        return self.spark.read.parquet(self.path(name)) if self.exists(name) else self.spark.createDataFrame([], schema)

    def write(self, name: str, frame: DataFrame, mode: str = "replace", key: str = "play_id") -> None:
        """SRC-06, TRAP-17: replace; or append, where the new row of a key wins if both sides have the key column."""
        target = self.path(name)
        if mode == "append" and self.exists(name):
            if key not in frame.columns:
                frame.write.mode("append").parquet(target)
                return
            old = self.spark.read.parquet(target)
            if key in old.columns:
                both = old.withColumn("__new", F.lit(0)).unionByName(frame.withColumns({"__new": F.lit(1), "__row": F.monotonically_increasing_id()}), allowMissingColumns=True)
                frame = keep_one(both, [key], [F.col("__new").desc(), F.col("__row").desc()]).drop("__new", "__row")
            # never overwrite what is being read: write beside it, then swap
            frame.write.mode("overwrite").parquet(f"{target}.next")
            self._swap(f"{target}.next", target)
            return
        frame.write.mode("overwrite").parquet(target)

    def _swap(self, new: str, target: str) -> None:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        a, b, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (new, target, f"{target}.before"))
        system = a.getFileSystem(conf)
        # a whole copy is there at every moment: under its name, or as .before or .next
        system.delete(aside, True)
        system.rename(b, aside)
        system.rename(a, b)
        system.delete(aside, True)
        self.spark.catalog.refreshByPath(target)

    def query(self, sql: str) -> DataFrame:
        """SRC-08: every stored table is a view of its name."""
        for name in self.tables:
            if self.exists(name):
                self.read(name).createOrReplaceTempView(name)
        return self.spark.sql(sql)

    def summary(self) -> DataFrame:
        """SRC-09: rows and columns of each table; counts come from Parquet footers."""
        found = None
        for name in self.tables:
            if self.exists(name):
                frame = self.read(name)
                row = frame.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows", F.lit(len(frame.columns)).cast("long").alias("columns"))
                found = row if found is None else found.unionByName(row)
        return self.spark.createDataFrame([], "table string, rows long, columns long") if found is None else found
