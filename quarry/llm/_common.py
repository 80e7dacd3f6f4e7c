"""What the operators share: a place for intermediate tables, and small helpers."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that one vectorised step takes at a time.
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        folder = tempfile.mkdtemp(prefix="quarry-")
        sc.setCheckpointDir(folder)
    return folder


_written: list[tuple[SparkSession, str]] = []
_inside: ContextVar[list | None] = ContextVar("quarry_tables", default=None)


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there.

    The files outlive any executor and go with the scope of settled(), or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quarry-{uuid.uuid4().hex}"
    own = _inside.get()
    (_written if own is None else own).append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, written; every other table that it wrote is deleted then."""
    own: list = []
    token = _inside.set(own)
    try:
        out = make()
    finally:
        _inside.reset(token)
    try:
        return materialise(out)
    finally:
        _delete(own)


def _delete(tables: list) -> None:
    while tables:
        spark, path = tables.pop()
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: its folder goes with it
            return


def drop_written() -> None:
    """Delete every table that materialise() wrote."""
    _delete(_written)


atexit.register(drop_written)


def release() -> None:
    """Give freed memory back to the system: Python workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def trim(spark: SparkSession) -> None:
    """Let executors give unused heap back to the system: a JVM keeps what it once took until a full collection.

    A task for each core, so that idle executors all get one; a local session has one JVM.
    """
    sc = spark.sparkContext
    n = 1 if re.match(r"local($|\[)", sc.master) else sc.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def mix64(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def row_count(df: DataFrame) -> int:
    return df.select(F.lit(1)).count()
