"""Sessions with the settings that the operators expect; a cluster's own settings win."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "fieldglass", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=DEFAULTS | conf)
    return (builder.master(master) if master else builder).getOrCreate()


def share_path(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package wherever the driver was started; clusters get it by --py-files."""
    root, environment = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    found = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if root not in found:
        environment["PYTHONPATH"] = ":".join([root, *found])
