"""Best-fit packing of token sequences by minimum bin slack.

A piece is all that matters of a document here: an integer length between 1 and the
capacity. However many documents there are, there are at most ``capacity`` different
lengths, so the packing itself is decided on the histogram of lengths (a few thousand
counters, the only thing that reaches the driver) and then dealt out to the pieces.

For each bin the largest length that is left opens it; a subset-sum dynamic programme over
bitsets (bit ``s`` of an integer: some combination has sum ``s``) finds the combination of
the other available lengths that leaves the least slack, and it is removed. While the
counters allow the same combination again, it is the fullest one again, so it is taken as
often as they allow at once. The number of different combinations is bounded by the
capacity and not by the corpus.

Defined results: a null text is an empty document, which is the end id alone; documents of
equal id are packed one by one, each row for itself; an empty table gives no rows; a null
id stays null; other columns of documents are ignored, whatever their names, and those of
items (``pack``) are kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import bounded_batches, cut, table, values
from .tokens import encoder

CAPACITY = 2048
#: Lengths are told apart up to here.
LONGEST = 1 << 20
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
#: Pieces that a worker gathers before it hands them on.
OUT_ROWS = 4_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_points(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of a document of ``n`` ids: all are full but, maybe, the first."""
    if n <= capacity:
        return [0]
    return [0, *range(n % capacity or capacity, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, keep_ids: bool = False, specials: bool = True, number: bool = False, thrifty: bool = False) -> DataFrame:
    """(doc_id, text) to pieces of at most ``capacity`` ids, with their checksum and, if asked for, the ids and the numbers that packing needs.

    ``specials``: the tokenizer's special strings in a text are their ids, as the library has it; else they are ordinary text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer, specials, thrifty), np.array([end_id], "<u4").tobytes()
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        n = 6 if keep_ids else 5

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:n], kinds[:n], strict=True)], names[:n])

        for batch in batches:
            rows: list[tuple] = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), enc.encoded(values(batch.column(1).cast(pa.binary()))), strict=True):
                raw += end
                starts = cut_points(len(raw) // 4, capacity)
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(raw) // 4], strict=True)):
                    part = raw[4 * a : 4 * b]
                    rows.append((doc_id, k, a, b - a, zlib.crc32(part), part if keep_ids else None))
                if len(rows) >= OUT_ROWS:
                    yield out(rows)
                    rows = []
            yield out(rows)

    bounded_batches(docs.sparkSession)
    schema = PIECES + (", ids binary" if keep_ids else "")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    if number:
        return docs.mapInArrow(lambda batches: numbered(run(batches), "__part", "__place"), schema + ", __part int, __place long")
    return docs.mapInArrow(run, schema)


def fullest(counts: np.ndarray, lengths: list[int], room: int) -> dict[int, int]:
    """Length -> copies of the combination with the largest sum within ``room``.

    ``lengths``: those with a positive count, from large to small.
    """
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for n in lengths:
        if n > room:
            continue
        left, k = min(int(counts[n]), room // n), 1
        while left:  # copies 1, 2, 4, ... so that any number up to the count can be made up
            take = min(k, left)
            steps.append((n, take, reach))
            reach |= (reach << (n * take)) & full
            left, k = left - take, 2 * k
        if reach >> room:
            break
    total, chosen = reach.bit_length() - 1, {}
    for n, take, before in reversed(steps):
        if not (before >> total) & 1:
            total -= n * take
            chosen[n] = chosen.get(n, 0) + take
    return chosen


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, first bin, bins, offset), sorted, and the number of bins.

    A row says: of the pieces with this length, the copies from the first rank on go to so
    many bins from the first bin on, one to each, at this offset.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        counts[n] = c
    ranks, rows, bins = np.zeros(capacity + 1, np.int64), [], 0
    lengths = [n for n in range(capacity, 0, -1) if counts[n]]
    while lengths:
        opens = lengths[0]
        counts[opens] -= 1
        chosen = fullest(counts, lengths, capacity - opens)
        counts[opens] += 1
        chosen[opens] = chosen.get(opens, 0) + 1
        times, offset = min(int(counts[n]) // k for n, k in chosen.items()), 0
        for n, k in sorted(chosen.items(), reverse=True):
            for _ in range(k):
                rows.append((n, ranks[n], bins, times, offset))
                ranks[n] += times
                offset += n
            counts[n] -= times * k
        bins += times
        if any(not counts[n] for n in chosen):
            lengths = [n for n in lengths if counts[n]]
    out = np.array(rows, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))], bins


def numbered(batches: Iterator[pa.RecordBatch], part: str, place: str) -> Iterator[pa.RecordBatch]:
    """The rows of a task with its number and their rank among its rows of the same length.

    Tasks count for themselves, so that no length, however frequent, is gathered anywhere.
    """
    met, task = np.zeros(1, np.int64), TaskContext.get().partitionId()
    for batch in batches:
        length = batch.column(batch.schema.get_field_index("length"))
        length = np.clip(pc.fill_null(length, 0).to_numpy(), 0, LONGEST)  # what is no length is told by the histogram
        if len(length) and length.max() >= len(met):
            met = np.r_[met, np.zeros(int(length.max()) + 1 - len(met), np.int64)]
        order = np.argsort(length, kind="stable")
        first = np.r_[True, length[order][1:] != length[order][:-1]] if len(order) else np.empty(0, bool)
        run = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        rank = np.empty(len(order), np.int64)
        rank[order] = run
        rank += met[length]
        met += np.bincount(length, minlength=len(met))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(order), task, np.int32)), pa.array(rank)], [*batch.schema.names, part, place])


def fields_of(frame: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)


def private(columns: list[str], name: str) -> str:
    """A name that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows with a ``length`` from 1 to ``capacity`` get ``sequence_id`` and ``offset``; columns of these names, in whatever case, are
    replaced, all others kept. A row without such a length raises ``ValueError``."""
    part, place = private(items.columns, "__part"), private(items.columns, "__place")
    return _placed(cut(items.mapInArrow(lambda batches: numbered(batches, part, place), f"{fields_of(items)}, `{part}` int, `{place}` long"), "items"), part, place, capacity)


def _placed(items: DataFrame, part: str, place: str, capacity: int) -> DataFrame:
    """Pack a written table of numbered rows."""
    counts = cut(items.groupBy("length", part).agg(F.count("*").alias("n")), "lengths", few_files=True)
    clipped = F.when(F.col("length").between(1, capacity), F.col("length")).otherwise(F.greatest(F.least("length", F.lit(capacity + 1)), F.lit(0))).alias("length")
    histogram = {r[0]: r[1] for r in counts.groupBy(clipped).agg(F.sum("n")).collect()}  # at most ``capacity`` rows and three
    if wrong := [n for n in histogram if n is None or not 1 <= n <= capacity]:
        raise ValueError(f"lengths have to be from 1 to {capacity}, not {wrong[:5]}")
    rows, _ = plan(histogram, capacity)
    stride = 1 << 44
    keys = rows[:, 0] * stride + rows[:, 1]
    kept = [c for c in items.columns if c.lower() not in (part, place, "sequence_id", "offset")]
    rank = private(items.columns, "__rank")
    # the pieces of this length in the tasks before: a row for each task and length, so that a frequent length is many keys
    before = Window.partitionBy("length").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("length", part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(rank))
    ranked = items.join(shift.hint("merge"), ["length", part]).select(*[F.col(f"`{c}`") for c in kept], (F.col(rank) + F.col(place)).alias(rank))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, at_rank = batch.column(batch.schema.get_field_index("length")).to_numpy().astype(np.int64), batch.column(len(kept)).to_numpy()
            at = rows[np.searchsorted(keys, length * stride + at_rank, "right") - 1] if len(rows) else rows
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(at[:, 2] + at_rank - at[:, 1]), pa.array(at[:, 4])], [*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(put, f"{fields_of(ranked.drop(rank))}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, keep_ids: bool = False, specials: bool = True, thrifty: bool = False) -> DataFrame:
    """Tokenise whole documents, cut the long ones and pack all pieces. The texts are read once.

    ``thrifty``: with less memory in each worker and some more time; results are the same.
    """
    return _placed(cut(pieces(docs, tokenizer, end_id, capacity, keep_ids, specials, True, thrifty), "pieces"), "__part", "__place", capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces that kept their ids, as whole sequences: ``sequence_id, ids`` (little-endian unsigned 32-bit)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most ``capacity`` ids in all
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return pack_documents(table(spark, sf_dir, "documents"), path(TOKENIZER))
