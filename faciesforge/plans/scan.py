"""The index of wells from a manifest and a folder of LAS files.

The folder is listed without reading it; sizes and missing files come from the listing. Files
within the size limit are read where they lie and scanned in Arrow batches: a file gives one
small row, whatever its length, and only those rows are joined to the manifest. Whatever is
wrong with a file is a status, so one bad file never stops the scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headers as H
from ..kernels import traces
from ..operators import curves
from ..scratch import bounded_batches, cut
from ..sources import las

# What the columns of a scanned file say about how it was read.
ENGINE, MODE, DEPTH_SOURCE = "text", "stream_text", "ASCII(~A)"
SCANNED = "name string, error string, stage string, wrapped boolean, mnemonics array<string>, depth string, curve string, candidates string, n_total long, n_finite long, depth_min double, depth_max double, p01 double, p50 double, p99 double"


@dataclass(frozen=True)
class Scan:
    family: str = "GR"
    min_finite: int = 200
    most_mb: float = 512
    #: Samples that percentiles are estimated from.
    reservoir: int = 20_000
    percentiles: tuple[float, float, float] = (1.0, 50.0, 99.0)


def file_name(path: Column) -> Column:
    """The last part of a path or URL, '' for none."""
    return F.trim(F.element_at(F.split(F.coalesce(F.trim(path), F.lit("")), "/"), -1))


def listing(spark: SparkSession, root: str, name: Column | None = None) -> DataFrame:
    """(name, path, size) of the files of a folder, which are not read; of files of one name the first path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", name is not None).load(root).select("path", F.col("length").alias("size"))
    files = files.withColumn("name", file_name(F.col("path")) if name is None else name)
    return files.groupBy("name").agg(F.min(F.struct("path", "size")).alias("f")).select("name", "f.path", "f.size")


def scanned_file(raw: bytes, s: Scan) -> tuple:
    """What a file's row says, after its name."""
    rest: list = [None] * 13
    try:
        text = raw.decode(errors="replace")
        head = las.parse_header(text)
    except Exception as e:  # noqa: BLE001  whatever it is, the file's status says so
        return (f"{type(e).__name__}: {e}", "header", *rest[:12])
    names = [m for m, *_ in head.curves]
    at, curve = las.find_curve(head, las.DEPTH_NAMES), las.find_curve(head, ("GR",), (s.family,))
    same = " ".join(m for m in names if las.canonical(m) == las.canonical(s.family))
    found = [head.wrap, names, names[at] if at >= 0 else None, names[curve] if curve >= 0 else None, same]
    if at < 0 or curve < 0:
        return (None, None, *found, *rest[:7])
    try:
        number = lambda t: math.nan if (x := las.number(t)) == head.null_value else x
        pairs = [(number(r[at]), number(r[curve])) for r in las.rows(text, len(names), head.wrap) if len(r) > max(at, curve)]
        depth, value = np.array(pairs, float).reshape(-1, 2).T
        depth, good = depth[np.isfinite(depth)], value[np.isfinite(value)]
        few = np.percentile(traces.reservoir(good, s.reservoir), s.percentiles).tolist() if len(good) else [None] * 3
        ends = [float(depth.min()), float(depth.max())] if len(depth) and len(good) else [None, None]
    except Exception as e:  # noqa: BLE001
        return (f"{type(e).__name__}: {e}", "stream", *found, *rest[:7])
    return (None, None, *found, len(value), len(good), *ends, *few)


def scanned(spark: SparkSession, root: str, s: Scan, name: Column | None = None) -> DataFrame:
    """A row for each file of the folder that is not too large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, number, count = pa.string(), pa.float64(), pa.int64()
        kinds = (text, text, text, pa.bool_(), pa.list_(text), text, text, text, count, count, *[number] * 5)
        for batch in batches:
            rows = [(n, *scanned_file(raw.as_py() or b"", s)) for n, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in SCANNED.split(", ")])

    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", name is not None).load(root)
    files = files.filter(F.col("length") <= int(s.most_mb * 1024 * 1024))  # told from the listing, before anything is read
    return files.select((file_name(F.col("path")) if name is None else name).alias("name"), "content").mapInArrow(run, SCANNED).dropDuplicates(["name"])


def indexed(manifest: DataFrame, root: str, s: Scan = Scan(), name: Column | None = None) -> DataFrame:
    """A row for each row of ``manifest`` (texts ``URL``, ``API``, ``API_NUM_NODASH``, ``KGS_ID``, ``Latitude``, ``Longitude``): its well, file,
    status with the reason, and what the file's depths and curve are.

    A file is found by the last part of the URL, or by ``name``, which names a file of the folder by its ``path``. Samples
    equal to the file's null value count neither as depths nor as values. Missing columns of the manifest are empty. A file without
    bytes is in no listing of Spark's, so it counts as missing.
    """
    spark = manifest.sparkSession
    text = lambda c: F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) if c in manifest.columns else F.lit("")
    given = lambda c: F.when(c != "", c)
    wells = manifest.select(F.coalesce(given(H.api_nodash(text("API"), text("API_NUM_NODASH"))), given(text("KGS_ID")), text("API")).alias("well_id"), text("URL").alias("url"), file_name(text("URL")).alias("name"), H.to_float(text("Latitude")).alias("lat"), H.to_float(text("Longitude")).alias("lon"))
    files = cut(listing(spark, root, name), "listing")
    facts = cut(scanned(spark, root, s, name), "scanned")
    rows = wells.join(files, "name", "left").join(facts, "name", "left")
    mb = F.col("size") / float(1024 * 1024)
    rows = rows.withColumns({
        "exists": F.col("path").isNotNull() & (F.col("name") != ""), "too_large": F.coalesce(mb > s.most_mb, F.lit(False)), "header_ok": ~F.col("stage").eqNullSafe("header"),
        "has_depth": F.col("depth").isNotNull(), "has_gr": F.col("curve").isNotNull(), "stream_ok": ~F.col("stage").eqNullSafe("stream"),
    })
    rows = curves.keep_status(rows, s.min_finite)
    # The reasons' texts.
    reason = (
        F.when(F.col("status") == "MISSING_LAS", "LAS path missing or file not found")
        .when(F.col("status") == "SKIP_TOO_LARGE", F.concat(F.lit("LAS size "), F.format_string("%.2f", mb), F.lit(f" MB > max_las_mb {s.most_mb:g}")))
        .when(F.col("status").isin("HEADER_FAIL", "STREAM_FAIL"), F.col("error"))
        .when(F.col("status") == "NO_DEPTH", "No DEPT/MD curve found in header (~C)")
        .when(F.col("status") == "NO_GR", "No GR-family curve found in header (~C)")
        .when(F.col("status") == "INSUFFICIENT_GR", F.concat(F.lit("GR finite samples "), F.col("n_finite").cast("string"), F.lit(f" < min_finite {s.min_finite}")))
        .otherwise("")
    )
    read = F.col("status").isin("OK", "INSUFFICIENT_GR")
    of_read = lambda c: F.when(read, F.col(c)).alias(c)
    return rows.select(
        "well_id", "url", F.col("path").alias("las_path"), "status", reason.alias("reason"), "lat", "lon", F.lit(ENGINE).alias("engine_used"), "wrapped", mb.alias("las_size_mb"),
        F.when(read, DEPTH_SOURCE).alias("depth_source"), of_read("depth_min"), of_read("depth_max"), F.col("curve").alias("gr_mnemonic_used"), F.col("candidates").alias("gr_candidates"),
        of_read("n_total"), of_read("n_finite"), F.when(read, F.col("n_finite") / F.greatest(F.lit(1), F.col("n_total"))).alias("finite_frac"), of_read("p01"), of_read("p50"), of_read("p99"), F.lit(MODE).alias("mode"),
    )


def samples_of(kept: DataFrame, root: str, family: str = "GR", name: Column | None = None) -> DataFrame:
    """(well_id, row, depth, value) of the curve of each row of ``indexed`` that is kept, read from its file."""
    spark = kept.sparkSession
    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", name is not None).load(root)
    files = files.join(kept.select(F.col("las_path").alias("path")).distinct(), "path", "left_semi").select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    chosen = kept.select("well_id", F.col("las_path").alias("path"), F.col("gr_mnemonic_used").alias("mnemonic"))
    return las.curve_samples(files, ("GR", family)).join(chosen, ["path", "mnemonic"]).select("well_id", "row", "depth", "value")
