"""Tables and files in the folder that all executors and the driver share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset (tests), below a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            root = "file://" + tempfile.mkdtemp(prefix="spark-")
            spark.conf.set("spark.checkpoint.dir", root)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, packed: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts its lineage.

    packed: for narrow rows, of which a table has few bytes; not more files than two for each core."""
    path = shared_dir(df.sparkSession, name)
    if packed:
        df = df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def told_apart(rows: DataFrame, name: str, *of: str) -> DataFrame:
    """``rows`` whose 64-bit ``name`` is one for each value of ``of``: of n values about n * n / 2**65 pairs share a hash, and are told apart by a second one.

    Runs a pass that finds those names; there are next to none, so they are broadcast."""
    second = F.xxhash64(F.lit(1), *of)
    twice = rows.select(name, second.alias("_o")).groupBy(name).agg(F.min("_o").alias("_a"), F.max("_o").alias("_b")).filter("_a <> _b").select(name, "_a")
    twice = stored(twice, "names", packed=True)
    if twice.isEmpty():
        return rows
    return rows.join(F.broadcast(twice), name, "left").withColumn(name, F.when(F.col("_a") != second, F.xxhash64(name, second)).otherwise(F.col(name))).drop("_a")


def released(run: Callable) -> Callable:
    """``run`` for mapInArrow, before and after which the worker gives unused memory back, Arrow's and the C library's: workers live on, idle, while tasks of other stages need it."""

    def give_back() -> None:
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    def whole(batches):
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def fold(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n))
