"""Delimited text whose separator has to be found out, and the sinks of tables as text and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATORS = (",", "\t", ";", "|")
SAMPLE_LINES = 50


def detect_separator(lines: list[str]) -> str:
    """The one separator of the first line; else the one with the best mean / (1 + variance) of its count over the lines; else a comma."""
    lines = [x.lstrip("﻿") for x in lines if x.strip()][:SAMPLE_LINES]
    if not lines:
        return ","
    first = [s for s in SEPARATORS if s in lines[0]]
    if len(first) == 1:
        return first[0]

    def score(s: str) -> float:
        counts = [x.count(s) for x in lines]
        mean = sum(counts) / len(counts)
        return mean / (1 + sum((c - mean) ** 2 for c in counts) / len(counts))

    best = max(SEPARATORS, key=score)
    return best if score(best) > 0 else ","


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """All columns text, missing values '', quoted fields, a header line; the separator is looked for in the first lines."""
    sample = [r[0] for r in spark.read.text(path).limit(SAMPLE_LINES).collect()]  # the limit is the sample
    df = spark.read.csv(path, sep=detect_separator(sample), header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8")
    clean = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    return clean.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in clean.columns])


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "errorifexists") -> None:
    """These columns in this order, missing ones and nulls as ''."""
    have = set(df.columns)
    df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in columns]).write.mode(mode).csv(path, header=True, emptyValue="")


def write_parts(df: DataFrame, path: str, rows: int = 1000, mode: str = "errorifexists") -> None:
    """Snappy Parquet files of at most so many rows."""
    df.write.mode(mode).option("maxRecordsPerFile", rows).option("compression", "snappy").parquet(path)


class CsvSink:
    """A folder of text that grows by whole tables, as from ``foreachBatch``: a header in each part, nulls as ''.

    A batch is written beside the table first, then moved into it under names that hold its number, then noted. One that is
    noted is not written again, in this process or another; of one that broke off, what has been moved is replaced. The
    first batch (of a new folder, or number 0) replaces what is there if ``overwrite`` is asked for; later batches of a
    stream that starts again never do.
    """

    def __init__(self, path: str, columns: list[str], overwrite: bool = False):
        self.path, self.columns, self.overwrite = path.rstrip("/"), columns, overwrite

    def __call__(self, df: DataFrame, batch: int | None = None) -> None:
        if batch is None:
            write_csv(df, self.path, self.columns, "overwrite" if self.overwrite else "append")
            self.overwrite = False
            return
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        noted = hadoop(f"{self.path}/_batches/{batch:012d}")
        if fs.exists(noted):
            self.overwrite = False
            return
        if self.overwrite and (batch == 0 or not fs.exists(hadoop(f"{self.path}/_batches"))):
            fs.delete(hadoop(self.path), True)
        self.overwrite = False
        for old in fs.globStatus(hadoop(f"{self.path}/batch-{batch:012d}-*")) or []:
            fs.delete(old.getPath(), False)
        beside = f"{self.path}/_writing-{batch:012d}"
        write_csv(df, beside, self.columns, "overwrite")
        for k, part in enumerate(fs.globStatus(hadoop(f"{beside}/part-*"))):
            if not fs.rename(part.getPath(), hadoop(f"{self.path}/batch-{batch:012d}-{k:05d}.csv")):
                raise OSError(f"cannot move {part.getPath()}")
        fs.delete(hadoop(beside), True)
        fs.mkdirs(noted.getParent())
        fs.create(noted, True).close()


def write_alignment(edges: DataFrame, path: str) -> None:
    """Aligned edges as text without their paths, and the packed paths of those that are OK as two tables beside it."""
    from .paths import pack

    rest = [c for c in edges.columns if c not in ("ii", "jj")]
    write_csv(edges, f"{path}/dtw_edges", rest, "overwrite")
    index, points = pack(edges.filter("upper(status) = 'OK' and size(ii) > 0"))
    index.write.mode("overwrite").parquet(f"{path}/dtw_paths/index")
    points.write.mode("overwrite").parquet(f"{path}/dtw_paths/points")
