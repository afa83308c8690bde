"""LAS 2.0 files as tables.

A file is one row of text; parsing turns it into a header row or into long curve samples
inside Arrow batches, so files are spread over the cluster and nothing about one is held
longer than it takes. ``LasDataSource`` offers the same as a Spark data source,
``spark.read.format("las")``.
"""

from __future__ import annotations

import fnmatch
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.headers import ALIAS_OF
from ..kernels import traces

DEPTH_NAMES = ("DEPT", "DEPTH", "MD", "TVD", "Z")
LINE = re.compile(r"^\s*([^.\s]*)\s*\.(\S*)\s*(.*?)\s*(?::\s*(.*))?$")
HEADER = "path string, wrap boolean, null_value double, mnemonics array<string>, units array<string>, descriptions array<string>"
SAMPLES = "path string, row long, mnemonic string, depth double, value double"


@dataclass
class Header:
    wrap: bool = False
    null_value: float | None = None
    #: (mnemonic, unit, description) in the order of the columns.
    curves: list[tuple[str, str, str]] = field(default_factory=list)


def canonical(mnemonic: str) -> str:
    """The canonical name of a raw mnemonic, as ``functions.headers.norm_mnemonic`` has it."""
    token = re.sub(r":\d+$", "", re.sub(r"[^A-Z0-9_:/\-]+", "", re.sub(r"\s+", "", mnemonic).upper()))
    return ALIAS_OF.get(token, token)


def number(token: str) -> float:
    try:
        x = float(token)
    except ValueError:
        return math.nan
    return x if math.isfinite(x) else math.nan


def parse_header(text: str) -> Header:
    """Sections up to ``~A``: WRAP from ~V or ~W, NULL from ~W, curves from ~C. Comments and blank lines go."""
    out, section = Header(), ""
    for line in text.splitlines():
        s = line.strip()
        if not s or s.startswith("#"):
            continue
        if s.startswith("~"):
            section = s[1:2].upper()
            if section == "A":
                break
            continue
        m = LINE.match(s)
        if not m:
            continue
        name, unit, value, descr = m[1].strip(), m[2], m[3], m[4] or ""
        if section in "VW" and name.upper() == "WRAP":
            out.wrap = (value or unit).strip().upper().startswith("Y")
        elif section == "W" and name.upper() == "NULL":
            x = number((value or unit).split()[0]) if (value or unit).split() else math.nan
            out.null_value = None if math.isnan(x) else x
        elif section == "C" and name:
            out.curves.append((name, unit, descr))
    return out


def rows(text: str, n_curves: int, wrapped: bool) -> Iterator[list[str]]:
    """Token rows of the ~A section; commas are spaces. Wrapped tokens are cut every ``n_curves``, an unfinished row goes."""
    inside, held = False, []
    for line in text.splitlines():
        s = line.strip()
        if s.upper().startswith("~A"):
            inside = True
        elif inside and s and not s.startswith("#"):
            if s.startswith("~"):
                inside = False
                continue
            tokens = s.replace(",", " ").split()
            if not wrapped:
                yield tokens
                continue
            held += tokens
            while len(held) >= n_curves > 0:
                yield held[:n_curves]
                held = held[n_curves:]


def find_curve(header: Header, wanted: tuple[str, ...], fallback: tuple[str, ...] = ()) -> int:
    """Column of the first curve of the wanted families, in header order, else of the fallbacks; -1 if there is none."""
    for family in (wanted, fallback):
        names = {canonical(w) for w in family}
        for i, (m, *_) in enumerate(header.curves):
            if canonical(m) in names:
                return i
    return -1


def samples(text: str, wanted: tuple[str, ...] | None = None) -> Iterator[tuple[int, str, float | None, float | None]]:
    """(row, mnemonic, depth, value) of all curves but the depth, or of those of the wanted families; null markers, bad numbers and short rows give nothing."""
    header = parse_header(text)
    at = find_curve(header, DEPTH_NAMES)
    if at < 0:
        return
    names = {canonical(w) for w in wanted} if wanted else None
    picked = [(i, m) for i, (m, *_) in enumerate(header.curves) if i != at and (names is None or canonical(m) in names)]
    clean = lambda x: None if math.isnan(x) or x == header.null_value else x
    for r, tokens in enumerate(rows(text, len(header.curves), header.wrap)):
        if len(tokens) < len(header.curves):
            continue
        depth = clean(number(tokens[at]))
        for i, m in picked:
            yield r, m, depth, clean(number(tokens[i]))


def parse_meta(text: str) -> Header:
    """The header as identity inference reads it: WRAP from ~V alone, mnemonics in upper case without white space."""
    out, section = parse_header(text), ""
    out.wrap = False
    for line in text.splitlines():
        s = line.strip()
        if s.startswith("~"):
            section = s[1:2].upper()
            if section == "A":
                break
        elif section == "V" and (m := LINE.match(s)) and m[1].upper() == "WRAP":
            out.wrap = (m[3] or m[2]).strip().upper().startswith("Y")
    out.curves = [("".join(n.split()).upper(), u, d) for n, u, d in out.curves]
    return out


def well_fields(text: str, wanted: tuple[str, ...] = ("UWI", "API", "WELL", "WELLNAME", "LEASE", "FLD", "LOC", "LAT", "LON", "COMP")) -> dict[str, str]:
    """Values of the ~W section by their names."""
    out, section = {}, ""
    for line in text.splitlines():
        s = line.strip()
        if s.startswith("~"):
            section = s[1:2].upper()
            if section == "A":
                break
        elif section == "W" and not s.startswith("#") and (m := LINE.match(s)) and m[1].upper() in wanted:
            out[m[1].upper()] = (f"{m[2]} {m[3]}" if m[2] and m[3] else m[3] or m[2]).strip()
    return out


def column_values(text: str, column: int, n_curves: int, wrapped: bool, null_value: float | None) -> Iterator[float]:
    """One column of all ~A sections: a wrapped file's tokens are cut every ``n_curves``, other rows that are short go; null markers
    and bad numbers are NaN. Only white space parts tokens here."""
    inside, held = False, []
    for line in text.splitlines():
        s = line.strip()
        if s.startswith("~"):
            inside = s[1:2].upper() == "A"
            continue
        if not inside or not s or s.startswith("#"):
            continue
        tokens = s.split()
        if wrapped:
            held += tokens
            whole = len(held) // n_curves * n_curves
            found, held = [held[i : i + n_curves] for i in range(0, whole, n_curves)], held[whole:]
        else:
            found = [tokens] if len(tokens) >= n_curves else []
        for row in found:
            x = number(row[column])
            yield math.nan if null_value is not None and x == null_value else x


@dataclass
class Read:
    """A file read whole: its header, which way of reading worked, and a column of numbers for each curve."""

    header: Header
    engine: str
    columns: np.ndarray


def read_whole(text: str, prefer_fast: bool = True, ignore_data: bool = False) -> Read:
    """All columns of a file. An unwrapped file is read as one block of numbers if it is one; a wrapped one, or one with odd tokens or
    short rows, token by token. Raises for a file without curves or, unless its data are ignored, without rows."""
    head = parse_header(text)
    n = len(head.curves)
    if not n:
        raise ValueError("wrapped file without curves" if head.wrap else "no curves")
    if ignore_data:
        return Read(head, "header", np.empty((n, 0)))
    block = re.split(r"(?mi)^\s*~A.*$", text, maxsplit=1)
    data, engine = None, "normal"
    if prefer_fast and not head.wrap and len(block) == 2 and not re.search(r"(?m)^\s*[~#]", block[1]):
        try:
            flat = np.array(block[1].replace(",", " ").split(), float)
            lines = [x for x in block[1].splitlines() if x.strip()]
            if len(flat) and len(flat) == n * len(lines) and all(len(x.replace(",", " ").split()) == n for x in lines):
                data, engine = flat.reshape(-1, n).T, "fast"
        except ValueError:
            pass
    if data is None:
        found = [[number(t) for t in r[:n]] for r in rows(text, n, head.wrap) if len(r) >= n]
        data = np.array(found, float).reshape(-1, n).T
    if not data.shape[1]:
        raise ValueError("no rows of data")
    data = np.where(np.isfinite(data), data, np.nan)
    if head.null_value is not None:
        data = np.where(data == head.null_value, np.nan, data)
    return Read(head, engine, data)


def best_curve(read: Read, wanted: tuple[str, ...]) -> int:
    """Column of the curve of the wanted families with most finite samples, the first on a tie; without one, of those whose name begins
    with a wanted name; -1 if there is none."""
    names = {canonical(w) for w in wanted if canonical(w)}
    raw = [w.strip().upper() for w in wanted if w.strip()]
    hits = [i for i, (m, *_) in enumerate(read.header.curves) if canonical(m) in names] or [i for i, (m, *_) in enumerate(read.header.curves) if m.strip().upper().startswith(tuple(raw))]
    return max(hits, key=lambda i: (int(np.isfinite(read.columns[i]).sum()), -i), default=-1)


def canonical_logs(logs: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Curves by canonical names; of several for one name the one with more finite samples, the first on a tie."""
    out: dict[str, np.ndarray] = {}
    for raw, x in logs.items():
        name = canonical(raw)
        if name and (name not in out or np.isfinite(x).sum() > np.isfinite(out[name]).sum()):
            out[name] = x
    return out


def well_arrays(read: Read, n: int, wanted: tuple[str, ...] = ("GR",), normalise_first: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(depths, x): a file's best curve by depth, filled, normalised and made even; or made even before it is normalised."""
    curve, at = best_curve(read, wanted), best_curve(read, ("DEPT", "DEPTH", "MD", "TVD"))
    if curve < 0 or at < 0:
        raise ValueError("no such curve" if curve < 0 else "no depth")
    d, v = read.columns[at], read.columns[curve]
    d, v = d[np.isfinite(d)], v[np.isfinite(d)]
    order = np.argsort(d, kind="stable")
    d, v = d[order], v[order]
    good = np.isfinite(v)
    if good.sum() < 2 or d[-1] <= d[0]:
        raise ValueError("too few samples")
    v = np.interp(np.arange(len(v)), np.flatnonzero(good), v[good])
    last = np.r_[d[1:] != d[:-1], True]
    z = np.linspace(d[0], d[-1], n)
    return z, np.interp(z, d[last], traces.scaled(v)[last]) if normalise_first else traces.scaled(np.interp(z, d[last], v[last]))


RESAMPLED = "path string, status string, x array<double>, top double, base double, n_finite long, step double"


def resampled_curves(files: DataFrame, n: int, wanted: tuple[str, ...] = ("GR",), max_rows: int = 0, **settings) -> DataFrame:
    """Each of ``files(path, text)`` as ``n`` even samples of its curve, rows read in the file's order (``kernels.traces.resampled``)."""

    def one(path: str, text: str) -> tuple:
        none = (None,) * 5
        head = parse_header(text)
        at, curve = find_curve(head, DEPTH_NAMES), find_curve(head, ("GR",), wanted)
        if at < 0 or curve < 0:
            return path, "FAIL: no curves" if not head.curves else "FAIL: no depth" if at < 0 else "FAIL: no such curve", *none
        clean = lambda x: math.nan if x == head.null_value else x
        pairs = []
        for k, r in enumerate(rows(text, len(head.curves), head.wrap)):
            if max_rows and k >= max_rows:
                return path, "FAIL: too many rows", *none
            if len(r) > max(at, curve):
                pairs.append((clean(number(r[at])), clean(number(r[curve]))))
        try:
            t = traces.resampled(*(np.array(pairs, float).reshape(-1, 2).T), n, **settings)
        except traces.TraceError as e:
            return path, f"FAIL: {e}", *none
        return path, "OK", t.x.tolist(), t.top, t.base, t.n_finite, None if math.isnan(t.step) else t.step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.int64(), pa.float64())
        for batch in batches:
            got = [one(p, t or "") for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            cols = list(zip(*got, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in RESAMPLED.split(", ")])

    return files.select("path", "text").mapInArrow(run, RESAMPLED)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file a row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def headers(files: DataFrame) -> DataFrame:
    """A header row for each of ``files(path, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_header(t or "") for t in batch.column(1).to_pylist()]
            text = pa.list_(pa.string())
            cols = [batch.column(0), pa.array([h.wrap for h in found], pa.bool_()), pa.array([h.null_value for h in found], pa.float64())]
            cols += [pa.array([[c[k] for c in h.curves] for h in found], text) for k in range(3)]
            yield pa.RecordBatch.from_arrays(cols, ["path", "wrap", "null_value", "mnemonics", "units", "descriptions"])

    return files.select("path", "text").mapInArrow(run, HEADER)


def curve_samples(files: DataFrame, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """Long samples of ``files(path, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0), batch.column(1), strict=True):  # a text at a time
                yield sample_batch(path.as_py(), text.as_py() or "", wanted)

    return files.select("path", "text").mapInArrow(run, SAMPLES)


def sample_batch(path: str, text: str, wanted: tuple[str, ...] | None) -> pa.RecordBatch:
    """A file's long samples."""
    cols = list(zip(*samples(text, wanted), strict=True)) or [()] * 4
    kinds = (pa.int64(), pa.string(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([path] * len(cols[0]), pa.string()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["path", "row", "mnemonic", "depth", "value"])


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    """Files are listed with their sizes and gathered to partitions of about so many bytes, so that many small files are few tasks
    and a large one is a task of its own."""

    def __init__(self, options: dict):
        self.options = options

    def _store(self) -> tuple[fs.FileSystem, str]:
        path = self.options["path"]
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))

    def partitions(self) -> list[InputPartition]:
        store, path = self._store()
        folder, _, pattern = path.rpartition("/")
        if store.get_file_info(path).type == fs.FileType.Directory:
            folder, pattern = path, "*.las"
        found = store.get_file_info(fs.FileSelector(folder or ".", allow_not_found=True))
        match = lambda name: fnmatch.fnmatchcase(name, pattern) or (pattern == "*.las" and name.lower().endswith(".las"))
        files = sorted((f.path, f.size or 0) for f in found if f.is_file and match(f.base_name))
        most, out, held = int(self.options.get("partitionBytes", 32 << 20)), [], 0
        for file, size in files:
            if not out or held + size > most:
                out.append(_Files([]))
                held = 0
            out[-1].paths.append(file)
            held += size + 4096  # opening a file costs something too
        return out

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        wanted = tuple(w for w in self.options.get("curves", "").split(",") if w) or None
        store, _ = self._store()
        for path in getattr(partition, "paths", None) or ():
            with store.open_input_stream(path) as f:
                yield sample_batch(path, f.read().decode(errors="replace"), wanted)


class LasDataSource(DataSource):
    """``spark.dataSource.register(LasDataSource)``, then ``spark.read.format("las").option("curves", "GR").load(path)``.

    ``path`` is a folder, a file or a pattern of names in a folder, local or in a store that PyArrow opens by its URI; ``curves``
    are the families that are read, as a file's other columns are never turned into rows; ``partitionBytes`` sizes the tasks.
    ``read_text`` with ``curve_samples`` reads any store that Spark reads.
    """

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SAMPLES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
