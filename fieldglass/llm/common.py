"""What the corpus operators share: table access, written intermediates, stable hashing."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..session import share_path

_LIBC = ctypes.CDLL(None) if sys.platform == "linux" else None
if not hasattr(_LIBC, "malloc_trim"):
    _LIBC = None


def fresh(name: str, taken: list[str]) -> str:
    """A name, and with it a prefix, that no column has."""
    while any(c.lower().startswith(name.lower()) for c in taken):
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_path(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A session of one machine may do without and gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="fieldglass-"))
    return context.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written as Parquet in the shared folder and read again: lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fieldglass/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*frames: DataFrame | None) -> None:
    """Delete the files behind frames from written() that nothing will read again."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()} if df is not None else ():
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def sent(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """df for a join with something large: to be broadcast if it has `rows` rows at most, else Spark's own choice. For written tables of a few numbers."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: What a scan and a batch for a Python worker hold at once: by Spark's defaults 4,096 and 10,000 rows, however long their texts.
SMALL_BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": "3900000b"}


def small_batches(spark: SparkSession) -> None:
    """From now on this session reads and sends texts in SMALL_BATCHES; settings of its own win. Batches never change results."""
    own = spark.conf.getAll
    for key, value in SMALL_BATCHES.items():
        if key not in own:
            spark.conf.set(key, value)


def trim() -> None:
    """Give a Python worker's free memory back to the machine: idle workers stay, and an executor holds several."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of plans that are written and gone; they count as disk until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def crc_mod_py(value, n: int) -> int:
    return zlib.crc32(("" if value is None else str(value)).encode()) % n


def bounded_sample(df: DataFrame, key: str, n: int, base: DataFrame | None = None) -> list[Row]:
    """The n rows with the smallest hash of their key: the same ones each time.

    Tasks send only rows under a hash threshold that the count of `base` (or df) sets to hold a few times n rows; should
    a filter leave fewer, the threshold rises until n are found or all rows are in. What reaches the driver stays near n.
    """
    total = max(1, (df if base is None else base).select(key).count())
    share = min(1.0, 4 * n / total)
    hashed = F.xxhash64(F.col(key).cast("string"))
    while True:
        within = df if share >= 1 else df.filter(hashed <= int(-(2**63) + share * (2**64 - 1)))
        rows = within.orderBy(hashed, key).limit(n).collect()
        if len(rows) >= n or share >= 1:
            return rows
        share = min(1.0, 8 * share)
