"""Token-ID files: frequency-ranked ids in a byte-aligned variable-length code.

A block holds the ids of some consecutive documents. Its distinct ids are ranked by how
often the block holds them, and each id is written as its rank in one to four bytes, little
end first; two bits for each id say how many, four of them to a control byte, and the
control bytes stand apart from the data. A reader looks each control byte up in a table of
four lengths, adds the lengths up to places, gathers the bytes and maps ranks back to ids.

Ranks are by the block's own counts, which codes a little better than the corpus's and needs no
second pass. Layout of a block, little-endian: ``FTK1``; documents, ids, distinct ids as unsigned 32-bit;
distinct ids by rank, unsigned 32-bit; for each document its id (signed 64-bit), whether it
has one (a byte) and its count of ids (unsigned 32-bit); control bytes; data bytes; the
crc32 of all before. Files are the partitions of a Parquet table of blocks, so that any
store that Spark writes to can hold them: documents are range-partitioned and sorted by id,
the file's number follows the range, and a block knows how many ids of its file precede it.
A writer holds one block at a time.

Defined results: a null text is the end id alone; null document ids come first; repeated
rows are kept, next to each other; an empty table gives a table without blocks; other columns
are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import bounded_batches, scratch_path, table, values
from .tokens import encoder

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
MAGIC = b"FTK1"
#: Ids after which a block is closed (a longer document has a block of its own).
BLOCK_IDS = 2_000_000
#: Bytes of text that a file is to hold.
FILE_BYTES = 64 << 20
#: Ids below this are counted in a table, others by sorting.
TABLE = 1 << 22
#: A control byte's four lengths.
LENGTHS = np.array([[(b >> 2 * i & 3) + 1 for i in range(4)] for b in range(256)], np.uint8)
BLOCKS = "file int, block int, base long, n long, data binary"


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    v = ranks.astype("<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]].tobytes()
    four = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    four[: len(v)] = code
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), data


def unpack_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    lengths = LENGTHS[control].ravel()[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    out = data[starts].astype(np.uint32)
    for k in range(1, 4):
        long = np.flatnonzero(lengths > k)
        out[long] |= data[starts[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def data_bytes(control: np.ndarray, n: int) -> int:
    return int(LENGTHS[control].ravel()[:n].sum(dtype=np.int64))


def write_block(doc_ids: list[int | None], texts: list[bytes]) -> bytes:
    """``texts``: each document's ids as little-endian unsigned 32-bit."""
    ids = np.frombuffer(b"".join(texts), "<u4")
    if len(ids) and ids.max() < TABLE:  # a vocabulary's ids are counted and ranked by table
        counts = np.bincount(ids)
        known = np.flatnonzero(counts)
        by_rank = np.lexsort((known, -counts[known]))
        rank = np.zeros(len(counts), np.uint32)
        rank[known[by_rank]] = np.arange(len(known), dtype=np.uint32)
        ranks = rank[ids]
    else:
        known, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
        by_rank = np.lexsort((known, -counts))
        rank = np.empty(len(known), np.uint32)
        rank[by_rank] = np.arange(len(known), dtype=np.uint32)
        ranks = rank[inverse]
    control, data = pack_ranks(ranks)
    body = b"".join(
        (
            MAGIC,
            struct.pack("<III", len(texts), len(ids), len(known)),
            known[by_rank].astype("<u4").tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            bytes(d is not None for d in doc_ids),
            np.array([len(t) // 4 for t in texts], "<u4").tobytes(),
            control,
            data,
        )
    )
    return body + struct.pack("<I", zlib.crc32(body))


def read_block(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their counts of ids, and all ids (unsigned 32-bit)."""
    if raw[:4] != MAGIC or zlib.crc32(memoryview(raw)[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError("not a whole block of token ids")
    docs, n, known = struct.unpack_from("<III", raw, 4)
    at = 16

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    ids, doc_ids, has, counts = take("<u4", known), take("<i8", docs), take("u1", docs), take("<u4", docs)
    control = take("u1", -(-n // 4))
    data = take("u1", data_bytes(control, n))
    return [d if h else None for d, h in zip(doc_ids.tolist(), has.tolist(), strict=True)], counts, ids[unpack_ranks(control, data, n)]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS, files: int | None = None, specials: bool = True) -> None:
    """Encode whole texts of ``docs(doc_id, text)`` and write their blocks in ascending order of id.

    Without a number of ``files`` there is one for each ``FILE_BYTES`` of text, and as many as the
    session has shuffle partitions at least. ``specials``: see ``tokens``.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not files:
        size = ready.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, file = encoder(tokenizer, specials), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        held: tuple[list, list] = ([], [])
        size = base = number = 0

        def close() -> pa.RecordBatch:
            nonlocal held, size, base, number
            row = [file, number, base, size, write_block(*held)]
            held, base, number, size = ([], []), base + size, number + 1, 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["file", "block", "base", "n", "data"])

        for batch in batches:
            texts = enc.encoded(values(batch.column(1).cast(pa.binary())))
            for doc_id, ids in zip(batch.column(0).to_pylist(), texts, strict=True):
                if held[0] and size + len(ids) // 4 + 1 > block_ids:
                    yield close()
                held[0].append(doc_id)
                held[1].append(ids + end)
                size += len(ids) // 4 + 1
        if held[0]:
            yield close()

    # rows that share an id and a text differ in their number, so that no range has to hold them all
    tied = ready.select("*", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    by = ("doc_id", "h", "row")
    tied.repartitionByRange(files, *by).sortWithinPartitions(*by).mapInArrow(run, BLOCKS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document in the files."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    before, total = {}, 0
    for file, n in sorted(blocks.groupBy("file").agg(F.sum("n")).collect()):  # a number a file
        before[file], total = total, total + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc_ids, counts, ids = read_block(raw)
                ends = np.cumsum(counts, dtype=np.int64)
                flat, cuts = ids.astype("<u4").tobytes(), (4 * ends).tolist()
                parts = [flat[a:b] for a, b in zip([0, *cuts], cuts)]  # noqa: B905
                cols = [pa.array(doc_ids, pa.int64()), pa.array(ends - counts + base + before[file]), pa.array(counts.astype(np.int64)), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    cols, names = [*cols, pa.array(parts, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return blocks.select("file", "base", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if keep_ids else ""))


def op4_token_binary(spark, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    out = scratch_path(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), out, path(TOKENIZER))
    return read_tokens(spark, out)
