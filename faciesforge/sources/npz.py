"""NumPy archives of stacked arrays as tables: rows keyed by ids, ragged paths, shifts.

A single archive is for what one reader can open. ``NpzDataSource`` (``spark.read.format("npz")`` and
``df.write.format("npz")``) keeps a table as a folder of archives, one for each partition, each of which is read
and written in a task of its own; nothing passes through the driver but the files' names.
"""

from __future__ import annotations

import io
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType


def _load(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    raw = spark.read.format("binaryFile").load(path).select("content").first()
    if raw is None:
        raise FileNotFoundError(path)
    with np.load(io.BytesIO(bytes(raw[0])), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


def _save(spark: SparkSession, path: str, arrays: dict[str, np.ndarray]) -> None:
    """Write an archive through Hadoop's file systems, under a name of its own until it is whole."""
    held = io.BytesIO()
    np.savez_compressed(held, **arrays)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    final, part = fs_path(path), fs_path(path + ".part")
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(bytearray(held.getvalue()))
    out.close()
    fs.delete(final, False)
    if not fs.rename(part, final):
        raise OSError(f"cannot write {path}")


def read_stacked(spark: SparkSession, path: str, key: str, columns: tuple[str, ...]) -> DataFrame:
    """A row for each entry of ``key``: the other arrays' rows, as arrays or numbers. All must have as many rows."""
    z = _load(spark, path)
    missing = [c for c in (key, *columns) if c not in z]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    ids = z[key].reshape(-1)
    wrong = [c for c in columns if len(z[c]) != len(ids)]
    if wrong:
        raise ValueError(f"{wrong} are not as long as {key}")
    data = {key: ids.tolist()} | {c: list(z[c]) if z[c].ndim > 1 else z[c].tolist() for c in columns}
    kind = lambda a: ("long" if a.dtype.kind in "iub" else "double" if a.dtype.kind == "f" else "string") if a.ndim == 1 else ("array<long>" if a.dtype.kind in "iub" else "array<double>")
    schema = ", ".join(f"`{c}` {kind(z[c] if c != key else ids)}" for c in (key, *columns))
    rows = [tuple(v.tolist() if isinstance(v, np.ndarray) else v for v in r) for r in zip(*data.values(), strict=True)]
    return spark.createDataFrame(rows, schema)


def write_stacked(df: DataFrame, path: str, key: str, columns: tuple[str, ...]) -> None:
    """The inverse of ``read_stacked`` for a table of representatives, whose number is a setting; ascending by the key."""
    rows = df.select(key, *columns).orderBy(key).toPandas()
    number = lambda v: np.array([np.nan if x is None else x for x in v], float)
    stacked = {c: np.stack([number(v) for v in rows[c]]) if len(rows) and isinstance(rows[c].iloc[0], (list, np.ndarray)) else rows[c].to_numpy() for c in columns}
    ids = rows[key].to_numpy()
    _save(df.sparkSession, path, {key: ids.astype(str) if ids.dtype == object else ids} | stacked)


def read_ragged(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, ii, jj) of an archive with ``src``, ``dst``, ``ptr`` and the tie points ``ii`` and ``jj`` end to end."""
    z = _load(spark, path)
    ptr = z["ptr"].astype(np.int64)
    if len(ptr) != len(z["src"]) + 1 or len(z["ii"]) != len(z["jj"]) or (len(ptr) and ptr[-1] != len(z["ii"])):
        raise ValueError(f"{path}: bounds do not fit the tie points")
    part = lambda c, k: z[c][ptr[k] : ptr[k + 1]].astype(int).tolist()
    rows = [(int(s), int(d), part("ii", k), part("jj", k)) for k, (s, d) in enumerate(zip(z["src"], z["dst"], strict=True))]
    return spark.createDataFrame(rows, "src long, dst long, ii array<int>, jj array<int>")


def write_ragged(paths: DataFrame, path: str) -> None:
    rows: pd.DataFrame = paths.select("src", "dst", "ii", "jj").filter(F.size("ii") > 0).orderBy("src", "dst").toPandas()
    flat = lambda c: np.concatenate([np.asarray(v, np.int32) for v in rows[c]]) if len(rows) else np.empty(0, np.int32)
    ptr = np.r_[0, np.cumsum([len(v) for v in rows.ii])].astype(np.int64)
    _save(paths.sparkSession, path, {"src": rows.src.to_numpy(np.int64), "dst": rows.dst.to_numpy(np.int64), "ptr": ptr, "ii": flat("ii"), "jj": flat("jj")})


def read_named(spark: SparkSession, path: str) -> DataFrame:
    """(id, values) of an archive with an array for each id: shifts, one number or one for each sample."""
    return spark.createDataFrame([(k, np.asarray(v, float).reshape(-1).tolist()) for k, v in sorted(_load(spark, path).items())], "id string, `values` array<double>")


def write_named(df: DataFrame, path: str, key: str, column: str) -> None:
    rows = df.select(F.col(key).cast("string").alias("k"), F.col(column).alias("v")).toPandas()
    _save(df.sparkSession, path, {k: np.array([np.nan if x is None else x for x in v], float) for k, v in zip(rows.k, rows.v, strict=True)})


def rows_by_place(matrix: np.ndarray, axis: np.ndarray) -> np.ndarray:
    """A matrix with wells as rows and the axis as columns, turned if it lies the other way."""
    matrix = np.asarray(matrix, float)
    if matrix.ndim != 2 or len(axis) not in matrix.shape:
        raise ValueError(f"no axis of {len(axis)} in {matrix.shape}")
    return matrix if matrix.shape[1] == len(axis) else matrix.T


# ---- a table as a folder of archives -------------------------------------------------------------

MANIFEST = "_archives.json"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + posixpath.abspath(path.removeprefix("file:")))


def packed_columns(table: pa.Table) -> dict[str, np.ndarray]:
    """A table's columns as arrays without objects: a list is its numbers end to end with bounds, a missing value has its place in ``.null``."""
    out = {}
    for name, column in zip(table.column_names, table.columns, strict=True):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        if column.null_count:
            out[f"{name}.null"] = np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False))
        if pa.types.is_list(column.type):
            out[f"{name}.ptr"] = np.r_[0, np.cumsum(pc.fill_null(column.value_lengths(), 0).to_numpy())].astype(np.int64)
            flat = column.flatten()
            if flat.null_count and not pa.types.is_floating(flat.type):
                raise ValueError(f"{name} holds missing elements, which only lists of floating-point numbers can")
            out[name] = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False) if pa.types.is_floating(flat.type) else flat.to_numpy(zero_copy_only=False)
        elif pa.types.is_string(column.type):
            out[name] = np.array([v.encode() for v in pc.fill_null(column, "").to_pylist()], "S") if len(column) else np.empty(0, "S1")
            out[f"{name}.size"] = np.array([len(v.encode()) for v in pc.fill_null(column, "").to_pylist()], np.int64)
        else:
            zero = pa.scalar(False if pa.types.is_boolean(column.type) else 0).cast(column.type)
            out[name] = pc.fill_null(column, zero).to_numpy(zero_copy_only=False)
    return out


def unpacked_columns(z: dict[str, np.ndarray], schema: pa.Schema, rows: int) -> pa.RecordBatch:
    """The inverse of ``packed_columns`` for the columns of ``schema``."""
    columns = []
    for field in schema:
        if field.name not in z:
            raise ValueError(f"archive lacks {field.name!r}")
        null = np.zeros(rows, bool)
        null[z.get(f"{field.name}.null", np.empty(0, int))] = True
        mask = pa.array(null) if null.any() else None
        if pa.types.is_list(field.type):
            columns.append(pa.ListArray.from_arrays(pa.array(z[f"{field.name}.ptr"], pa.int32()), pa.array(z[field.name], field.type.value_type), mask=mask))
        elif pa.types.is_string(field.type):
            text = [bytes(v).ljust(n, b"\0").decode() for v, n in zip(z[field.name].tolist(), z[f"{field.name}.size"].tolist(), strict=True)]
            columns.append(pa.array(text, pa.string(), mask=null))
        else:
            columns.append(pa.array(z[field.name], field.type, mask=null))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


@dataclass
class _Written(WriterCommitMessage):
    file: str | None
    rows: int


class _Archive(InputPartition):
    def __init__(self, file: str, rows: int):
        self.file, self.rows = file, rows


class _NpzWriter(DataSourceArrowWriter):
    """Each task writes archives of at most ``rows`` rows beside the table; the driver's commit notes their names, which makes them the table."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.most = options["path"], overwrite, int(options.get("rows", 100_000))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _place(self.path)
        store.create_dir(root, recursive=True)
        files, held, n = [], [], 0

        def close() -> None:
            nonlocal held, n
            raw = io.BytesIO()
            np.savez_compressed(raw, **packed_columns(pa.Table.from_batches(held)))
            files.append((f"part-{uuid.uuid4().hex}.npz", n))
            with store.open_output_stream(f"{root}/{files[-1][0]}") as f:
                f.write(raw.getvalue())
            held, n = [], 0

        for batch in iterator:
            for at in range(0, batch.num_rows, self.most):
                some = batch.slice(at, self.most)
                if n and n + some.num_rows > self.most:
                    close()
                held.append(some)
                n += some.num_rows
        if n:
            close()
        return _Written(json.dumps(files), sum(k for _, k in files))

    def commit(self, messages: list) -> None:
        store, root = _place(self.path)
        store.create_dir(root, recursive=True)
        before = [] if self.overwrite else _noted(store, root)
        files = before + [tuple(f) for m in messages if m is not None for f in json.loads(m.file)]
        part = f"{root}/{MANIFEST}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as f:
            f.write(json.dumps(files).encode())
        store.move(part, f"{root}/{MANIFEST}")
        self._drop(store, root, {f for f, _ in files})

    def abort(self, messages: list) -> None:
        store, root = _place(self.path)
        for m in messages:
            for file, _ in json.loads(m.file) if m is not None else ():
                store.delete_file(f"{root}/{file}")

    def _drop(self, store: fs.FileSystem, root: str, kept: set[str]) -> None:
        """What an overwritten table has left."""
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(root)):
                if info.base_name.startswith("part-") and info.base_name not in kept:
                    store.delete_file(info.path)


def _noted(store: fs.FileSystem, root: str) -> list[tuple[str, int]]:
    if store.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.NotFound:
        return []
    with store.open_input_stream(f"{root}/{MANIFEST}") as f:
        return [tuple(x) for x in json.loads(f.read())]


class _NpzReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, to_arrow_schema(schema)

    def partitions(self) -> list[InputPartition]:
        store, root = _place(self.path)
        return [_Archive(*f) for f in _noted(store, root)]

    def read(self, partition: _Archive) -> Iterator[pa.RecordBatch]:
        if partition is None or not getattr(partition, "file", None):
            return
        store, root = _place(self.path)
        with store.open_input_file(f"{root}/{partition.file}") as f, np.load(io.BytesIO(f.read()), allow_pickle=False) as z:
            names = [k for k in z.files if k.split(".")[0] in self.schema.names]  # only the members of columns that are asked for
            yield unpacked_columns({k: z[k] for k in names}, self.schema, partition.rows)


class NpzDataSource(DataSource):
    """``spark.dataSource.register(NpzDataSource)``; ``df.write.format("npz").mode(...).save(path)`` and
    ``spark.read.format("npz").schema(...).load(path)``.

    Numbers, booleans, texts and lists of numbers. A row order by key comes from ``repartitionByRange`` and
    ``sortWithinPartitions`` before writing. Archives that no commit has noted are no part of the table, so a task that ran
    twice, or a job that broke off, leaves nothing to read. For paths that workers can open (local, shared, object stores).
    """

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        raise ValueError("a schema has to be given, as archives do not tell lists from numbers")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _NpzReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        from_arrow_schema(to_arrow_schema(schema))  # refuses what Arrow cannot hold, before any task runs
        return _NpzWriter(self.options, overwrite)
