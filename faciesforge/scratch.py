"""Tables in the folder that driver and executors share, to cut lineage at."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where none is set and all runs on this machine, one is made and recorded."""
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


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: what follows can be redone from the table, wherever executors are lost."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Latest:
    """``cut`` for a table that takes the place of its last one, which is deleted once the new one is written: steps that go on
    for long hold two of their tables and not all. What was made from the last one has to be written by then."""

    def __init__(self, name: str):
        self.name, self.path = name, None

    def __call__(self, df: DataFrame) -> DataFrame:
        path = scratch_path(df.sparkSession, self.name)
        df.write.parquet(path)
        if self.path is not None:
            _delete(df.sparkSession, self.path)
        self.path = path
        return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def many_tasks(spark: SparkSession) -> int:
    """Tasks for rows that are few bytes and much work each, some for each core; a plan would deal them by bytes to one or two."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def drop(spark: SparkSession) -> None:
    """Delete this application's tables in that folder, once its results are written."""
    _delete(spark, f"{shared_dir(spark)}/faciesforge/{spark.sparkContext.applicationId}")


#: Bytes of rows that a Python worker gets at a time where rows can be whole files.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Have Arrow batches bounded by their bytes, unless the session has them smaller already."""
    digits, unit = re.fullmatch(r"(-?\d+)([a-z]*)", spark.conf.get(_BATCH).lower()).groups()
    now = int(digits) << {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30}[unit]
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")
