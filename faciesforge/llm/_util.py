"""Shared plumbing of the training-data operators: scratch tables and table reading."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that setting is absent and everything runs on this machine (tests, a laptop) a temporary
    folder is made and recorded in the session, so that later calls find the same one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="faciesforge-")
        atexit.register(shutil.rmtree, made, True)
        root = "file://" + made
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/faciesforge/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str, few_files: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back.

    This cuts the lineage at a copy every executor can reach, so that a lost executor
    costs a re-read and never a recomputation of what stands before.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if few_files:  # of a table that is small for its partitions: as many files as keep every core busy
        df = df.coalesce(max(8, 2 * spark.sparkContext.defaultParallelism))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this application (call when its results are written)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/faciesforge/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_HELD: list = [None, None]


def held(key, build: Callable):
    """What a worker keeps from task to task: one object, built anew when another key is asked for.

    Workers outlive operators. Holding one thing at a time keeps their memory that of the
    operator at work; a task that keeps nothing asks with ``None``.
    """
    if _HELD[0] != key:
        _HELD[:] = [None, None]  # the old one goes before the new one comes
        give_back()
        _HELD[:] = [key, build()]
    return _HELD[1]


def give_back() -> None:
    """Return freed memory to the machine, which counts what a worker's allocators keep as the worker's."""
    gc.collect()
    trim()


def trim() -> None:
    """The same for what is freed already, a matter of milliseconds."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not the GNU C library


#: Bytes of rows that a Python worker gets at a time; rows of long texts come in fewer to a batch.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Have Arrow batches of texts bounded by their bytes, unless the session has them smaller already."""
    digits, unit = re.fullmatch(r"(-?\d+)([a-z]*)", spark.conf.get(_BATCH).lower()).groups()
    now = int(digits) << {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30}[unit]
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


def values(column: pa.Array, step: int = 512) -> Iterator:
    """A column's values as Python objects, some at a time."""
    for i in range(0, len(column), step):
        yield from column.slice(i, step).to_pylist()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
