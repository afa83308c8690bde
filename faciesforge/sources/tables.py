"""Readers of well, pick and edge tables, with the coercions that their files need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import headers as H


def column_named(df: DataFrame, *names: str) -> str | None:
    """The first of the names that the table has, whatever its case."""
    have = {c.strip().upper(): c for c in df.columns}
    return next((have[n.upper()] for n in names if n.upper() in have), None)


def read_wells(spark: SparkSession, path: str) -> DataFrame:
    """A wells table (Parquet file or folder of parts) with numeric ``lat`` and ``lon``; rows without either go."""
    df = spark.read.parquet(path)
    lat, lon = column_named(df, "lat", "latitude"), column_named(df, "lon", "longitude", "lng")
    if lat is None or lon is None:
        raise ValueError(f"no coordinates among {df.columns}")
    number = lambda c: H.to_float(F.col(f"`{c}`").cast("string"))
    out = df.withColumn("_lat", number(lat)).withColumn("_lon", number(lon)).drop(lat, lon)
    return out.withColumnsRenamed({"_lat": "lat", "_lon": "lon"}).filter("lat is not null and lon is not null")


def coordinate_mode(df: DataFrame) -> str:
    if column_named(df, "lat", "latitude") and column_named(df, "lon", "longitude"):
        return "latlon"
    return "xy" if column_named(df, "x") and column_named(df, "y") else ""


def clean_picks(picks: DataFrame, sigma: float = 5.0) -> DataFrame:
    """``(well_id, top_name, depth, sigma_m)``: blank ids and depths that are no numbers go, a missing sigma is ``sigma``."""
    given = F.col("sigma_m") if "sigma_m" in picks.columns else F.lit(None).cast("double")
    out = picks.withColumn("depth", F.col("depth").cast("string").try_cast("double")).withColumn("sigma_m", F.coalesce(F.when(~F.isnan(given), given), F.lit(sigma)))
    return out.filter((F.trim(F.col("well_id").cast("string")) != "") & F.col("depth").isNotNull() & ~F.isnan("depth")).select("well_id", "top_name", "depth", "sigma_m")


def read_picks(spark: SparkSession, path: str) -> DataFrame:
    return clean_picks(spark.read.parquet(path))


def long_wells(df: DataFrame, curves: list[str]) -> DataFrame:
    """``(well_id, x, y, md, curve columns...)`` to ``(well_id, canonical, raw, md, value)``: of raw curves with one canonical
    name each well gives the one with most finite samples, the first in the table on a tie."""
    value = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("raw"), F.col(f"`{c}`").cast("double").alias("value")) for i, c in enumerate(curves)]))
    long = df.select("well_id", "md", value.alias("c")).select("well_id", "md", "c.*").withColumn("canonical", H.norm_mnemonic(F.col("raw")))
    good = F.count(F.when(~F.isnan("value") & (F.abs("value") < F.lit(float("inf"))), 1)).over(Window.partitionBy("well_id", "canonical", "place"))
    best = F.max(F.struct(F.col("good"), -F.col("place"))).over(Window.partitionBy("well_id", "canonical"))
    out = long.withColumn("good", good).withColumn("best", best)
    return out.filter(F.col("place") == -F.col("best.col2")).select("well_id", "canonical", "raw", "md", "value")


def subset(df: DataFrame, wanted: DataFrame, keys: tuple[str, ...] = ("well_id", "api_num_nodash", "api", "kgs_id", "url")) -> DataFrame:
    """Rows any of whose identifiers is in the filter table's column of that name."""
    shared = [k for k in keys if k in df.columns and k in wanted.columns]
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    hits = [rows.select("_row", F.col(k).cast("string").alias("v")).join(wanted.select(F.trim(F.col(k).cast("string")).alias("v")).filter("v <> ''").distinct(), "v", "left_semi").select("_row") for k in shared]
    if not hits:
        return df.limit(0)
    found = hits[0]
    for h in hits[1:]:
        found = found.union(h)
    return rows.join(found.distinct(), "_row", "left_semi").drop("_row")


def las_basenames(spark: SparkSession, path: str) -> DataFrame | None:
    """(name): the file names of a wells table's ``las_path``, of which alone that column is read; None without such a table or column."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    df = spark.read.parquet(path)
    column = column_named(df, "las_path")
    if column is None:
        return None
    return df.select(F.element_at(F.split(F.trim(F.col(column)), "[/\\\\]"), -1).alias("name")).filter("name <> ''").distinct()


def wells_with_logs(df: DataFrame, curves: list[str], log_cols: list[str] | None = None) -> DataFrame:
    """(well_id, x, y, canonical, raw, md, values): each well's best curve for each canonical name as arrays by depth, or for the wanted names alone."""
    missing = [c for c in ("well_id", "x", "y", "md") if c not in df.columns]
    if missing:
        raise ValueError(f"no {missing} among {df.columns}")
    long = long_wells(df, curves)
    if log_cols is not None:
        long = long.filter(F.col("canonical").isin([H.canonical_name(c) for c in log_cols]))
    logs = long.groupBy("well_id", "canonical", "raw").agg(F.array_sort(F.collect_list(F.struct("md", "value"))).alias("p"))  # a well's samples
    place = df.groupBy("well_id").agg(F.first("x").alias("x"), F.first("y").alias("y"))
    return logs.join(place, "well_id").select("well_id", "x", "y", "canonical", "raw", F.transform("p", lambda q: q["md"]).alias("md"), F.transform("p", lambda q: q["value"]).alias("values"))


def canonical_logs(logs: DataFrame) -> DataFrame:
    """``logs(well_id, name, place, values)`` by canonical name; of a well's several the one with more finite samples, the first on a tie."""
    finite = F.size(F.filter("values", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))))
    rows = logs.withColumn("canonical", H.norm_mnemonic(F.col("name"))).filter("canonical <> ''")
    return rows.groupBy("well_id", "canonical").agg(F.max_by(F.struct("name", "values"), F.struct(finite, -F.col("place"))).alias("s")).select("well_id", "canonical", "s.name", "s.values")


def prefiltered(rows: DataFrame, files: DataFrame, root: str, max_mb: float, max_curves: int = 0, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows whose file may be read, with ``las_path``, and how many rows came to which reason.

    ``files(path, size[, n_curves])`` lists what is there; a URL's file is looked for under ``root``. In order: not among the ``allowed(name)``,
    missing, too large, a bad header, too many curves.
    """
    out = rows.withColumn("las_path", H.url_to_path(F.col("url"), root)).withColumn("_name", F.element_at(F.split("las_path", "/"), -1))
    listed = files.select(F.col("path").alias("las_path"), F.col("size").alias("_size"), (F.col("n_curves") if max_curves else F.lit(1)).alias("_curves"))
    out = out.join(listed, "las_path", "left")
    if allowed is not None:
        out = out.join(allowed.select(F.col("name").alias("_name"), F.lit(True).alias("_allowed")).distinct(), "_name", "left")
    reason = F.when(F.col("_allowed").isNull(), "not_allowed") if allowed is not None else F.when(F.lit(False), "")
    reason = reason.when(F.col("_size").isNull(), "missing").when(F.col("_size") > max_mb * 2**20, "too_large")
    if max_curves:
        reason = reason.when(F.coalesce("_curves", F.lit(0)) <= 0, "bad_header").when(F.col("_curves") > max_curves, "too_many_curves")
    told = out.withColumn("_reason", reason.otherwise("kept"))
    return told.filter("_reason = 'kept'").drop("_name", "_size", "_curves", "_allowed", "_reason"), told.groupBy(F.col("_reason").alias("reason")).agg(F.count("*").alias("n"))


def well_to_cell(spark: SparkSession, path: str, wells: DataFrame, cell_km: float, lat0: float, rebuild: bool = False) -> DataFrame:
    """The table of wells and their cells: read if it has been written to its end, else built and written."""
    from ..operators import grid

    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if rebuild or not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        grid.assign(wells, cell_km, lat0).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def curve_index(manifest: DataFrame, headers: DataFrame, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One row a URL with its status, one row a URL and curve, and the curves that the header rules object to.

    ``headers(path, mnemonics, units, descriptions)``, as ``las.headers`` gives it; a URL without a header is MISSING, one without curves EMPTY.
    """
    rows = manifest.withColumn("las_path", H.url_to_path(F.col("url"), root)).join(headers.withColumnRenamed("path", "las_path"), "las_path", "left")
    status = F.when(F.col("mnemonics").isNull(), "MISSING").when(F.size("mnemonics") == 0, "EMPTY").otherwise("OK")
    wells = rows.select(*manifest.columns, "las_path", status.alias("status"), F.coalesce(F.when(F.col("mnemonics").isNotNull(), F.size("mnemonics")), F.lit(0)).alias("n_curves"))
    each = rows.filter(F.size("mnemonics") > 0).select("url", "las_path", F.posexplode(F.arrays_zip("mnemonics", "units", "descriptions")).alias("place", "c"))
    curves = each.select("url", "las_path", "place", F.col("c.mnemonics").alias("mnemonic"), F.col("c.units").alias("unit"), F.col("c.descriptions").alias("descr"))
    curves = curves.withColumn("mnemonic_n", H.norm_mnemonic(F.col("mnemonic"))).withColumn("unit_n", H.norm_unit(F.col("unit"))).withColumn("key", H.canon_key(F.col("mnemonic"), F.col("unit")))
    hits = curves.select("*", F.explode(H.quarantine_hits(F.col("mnemonic_n"), F.col("unit_n"), F.col("descr"))).alias("hit")).select("url", "place", "mnemonic", "unit", "descr", "hit.severity", "hit.reason")
    return wells, curves, hits


def with_curve_stats(hits: DataFrame, stats: DataFrame) -> DataFrame:
    """Quarantined curves with the statistics of their (las_path, mnemonic); those are looked up once for each, however many hits there are."""
    return hits.join(stats, ["las_path", "mnemonic"], "left")
