"""Exact top-k search by a three-phase uniform threshold.

A score is an inner product, the sum of one partial score for each of ``LISTS`` runs of
dimensions; those are the score lists. Phase one gathers from each chunk of the candidates the
entries that lead its first list and totals just those. The k-th best total among different
candidates seen so is a cutoff that no answer can fall below. Phase two sends each query's
cutoff to all chunks. An answer must reach the cutoff divided by the number of lists in some
list; and as no list gives more than the product of the norms of both parts, an entry whose
lists so far leave the rest more than that to make up cannot be one. So the lists are gone
through in turn and only sufficient entries are kept; phase three resolves the remaining
lists of these, entry by entry, to exact totals, and the best k stay.

Candidates are packed into chunks where they lie, queries into blocks; both are written tables
and each chunk meets each block in one join, by pairs of chunk and block. Scores are exact integers.

Defined results: vectors that are null, or hold null or non-finite components, take no part,
nor do rows with null id; vectors meet those of their own length only; rows that share an id
count as one, with their best score; ties go to the smaller id; scores beyond the range of a
long are its ends; a query without candidates has no rows, and so has an empty table; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import bounded_batches, cut, table

LISTS = 8
#: Candidates of a chunk and queries of a block, at most.
CHUNK, BLOCK = 4096, 1024
#: Entries of a local score list that phase one gathers for each one wanted; more of them give a higher cutoff.
LEADERS = 16
#: While this share of a chunk's entries can still be answers, a list is computed for all of them.
DENSE = 0.25
#: Integers up to here are exact as doubles; larger ones are Python integers.
EXACT = 2**53
_LONG = 2**63 - 1
#: Entries found that make a task keep only the best of each query so far.
HELD = 500_000
HITS = "query_id long, vec_id long, score long"
PACKED = "dims int, n int, ids binary, x binary"


def usable(vector: str = "embedding") -> Column:
    v = F.col(vector)
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def of_length(ids: pa.Array, lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, matrix) of the vectors of each length."""
    sizes, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
    ids, starts = ids.to_numpy(), np.cumsum(sizes) - sizes
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        yield n, ids[at], flat[starts[at][:, None] + np.arange(n)]


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(256 x): as doubles if all fit a double exactly, else as Python integers."""
    scaled = np.floor(256.0 * x)
    if np.isfinite(scaled).all() and (not scaled.size or np.abs(scaled).max() < EXACT):
        return scaled
    return np.array([int(256 * int(v)) if abs(v) >= EXACT else int(np.floor(256.0 * v)) for v in x.ravel().tolist()], object).reshape(x.shape)


def _integers(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def exactly(q: np.ndarray, y: np.ndarray) -> bool:
    """Whether inner products of these are exact as doubles."""
    return q.dtype != object and y.dtype != object and (not q.size or not y.size or float(np.abs(q).max()) * float(np.abs(y).max()) * q.shape[1] < EXACT)


def lists_of(dims: int) -> list[slice]:
    at = [dims * i // LISTS for i in range(LISTS + 1)]
    return [slice(a, b) for a, b in zip(at[:-1], at[1:], strict=True) if b > a] or [slice(0, 0)]


def longs(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64) if x.dtype != object else np.array([max(-_LONG - 1, min(_LONG, int(v))) for v in x], np.int64)


def best(q: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best different ids of each query, ties to the smaller id."""
    order = np.lexsort((~s, ids, q))  # ~s sorts as -s does, without overflow
    q, ids, s = q[order], ids[order], s[order]
    fresh = np.r_[True, (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])] if len(q) else np.zeros(0, bool)
    q, ids, s = q[fresh], ids[fresh], s[fresh]
    order = np.lexsort((ids, ~s, q))
    q, ids, s = q[order], ids[order], s[order]
    starts = np.searchsorted(q, q)  # the place of each query's first row
    keep = np.arange(len(q)) - starts < k
    return q[keep], ids[keep], s[keep]


Hits = tuple[np.ndarray, np.ndarray, np.ndarray]
"""Query places, candidate places, exact totals."""


def leading(q: np.ndarray, y: np.ndarray, same: np.ndarray, k: int) -> tuple[Hits, int]:
    """Phase one: the entries of each query that lead the first list, ``LEADERS`` times ``k``, totalled; and how many partial scores that took."""
    parts = lists_of(q.shape[1])
    if not exactly(q, y):
        q, y, parts = _integers(q), _integers(y), [slice(0, q.shape[1])]
    first = (q[:, parts[0]] @ y[:, parts[0]].T).astype(np.float64)
    first[same] = -np.inf
    top = np.argpartition(-first, min(LEADERS * k, first.shape[1]) - 1, axis=1)[:, : LEADERS * k]
    a, c = np.nonzero(np.isfinite(np.take_along_axis(first, top, axis=1)))
    b = top[a, c]
    return (a, b, (q[a] * y[b]).sum(axis=1) if len(a) else np.empty(0)), first.size + len(a) * (len(parts) - 1)


def sufficient(q: np.ndarray, y: np.ndarray, same: np.ndarray, cutoff: np.ndarray) -> tuple[Hits, int]:
    """Phases two and three: the entries whose total reaches their query's cutoff; and how many partial scores that took."""
    if not exactly(q, y):
        total = _integers(q) @ _integers(y).T
        a, b = np.nonzero(np.asarray(total >= cutoff[:, None], bool) & ~same)
        return (a, b, total[a, b]), total.size
    parts, computed = lists_of(q.shape[1]), 0
    norms = [np.array([np.sqrt(np.einsum("ij,ij->i", v[:, p], v[:, p])) for p in parts]) for v in (q, y)]
    rest = lambda at, of: norms[of][at:]
    total, alive = np.zeros((len(q), len(y))), None
    for at, p in enumerate(parts):
        if alive is None:  # for all entries
            total += q[:, p] @ y[:, p].T
            computed += total.size
            if at == 0:
                total[same] = -np.inf
            # what the lists to come can give at most, with room for rounding
            most = rest(at + 1, 0).T @ rest(at + 1, 1) if at + 1 < len(parts) else 0.0
            fits = total + most * (1 + 1e-9) + 1e-3 >= cutoff[:, None]
            if at + 1 == len(parts) or np.count_nonzero(fits) <= DENSE * fits.size:
                alive = np.nonzero(fits & np.isfinite(total))
                total = total[alive]
        else:  # for those left, one by one
            a, b = alive
            total = total + np.einsum("ij,ij->i", q[a][:, p], y[b][:, p])
            computed += len(a)
            most = np.einsum("ji,ji->i", rest(at + 1, 0)[:, a], rest(at + 1, 1)[:, b]) if at + 1 < len(parts) else 0.0
            fits = total + most * (1 + 1e-9) + 1e-3 >= cutoff[a]
            alive, total = (a[fits], b[fits]), total[fits]
    a, b = alive
    keep = total >= cutoff[a]
    return (a[keep], b[keep], total[keep]), computed


def packed(vectors: DataFrame, most: int, extra: str | None = None) -> DataFrame:
    """(dims, n, ids, x[, extra]): up to ``most`` usable vectors of one length to a row, where they lie, as little-endian numbers."""
    names = ["dims", "n", "ids", "x"] + (["extra"] if extra else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}

        def row(n: int, parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            whole = [np.concatenate(c) for c in zip(*parts, strict=True)]
            cells = [n, len(whole[0]), whole[0].astype("<i8").tobytes(), whole[1].astype("<f8").tobytes()] + ([whole[2].astype("<f8").tobytes()] if extra else [])
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds[: len(cells)], strict=True)], names)

        for batch in batches:
            place = pa.array(np.arange(batch.num_rows, dtype=np.int64))
            more = batch.column(2).to_numpy(zero_copy_only=False) if extra else None
            for n, at, x in of_length(place, batch.column(1)):
                ids = batch.column(0).to_numpy()[at]
                for i in range(0, len(ids), most):
                    part = (ids[i : i + most], x[i : i + most]) + ((more[at][i : i + most],) if extra else ())
                    have = held.setdefault(n, [])
                    if have and sum(len(h[0]) for h in have) + len(part[0]) > most:
                        yield row(n, held.pop(n))
                        have = held.setdefault(n, [])
                    have.append(part)
        for n, parts in held.items():
            yield row(n, parts)

    columns = ["vec_id", "embedding"] + ([extra] if extra else [])
    return vectors.select(*columns).mapInArrow(run, PACKED + (", extra binary" if extra else ""))


def blocks(queries: DataFrame, name: str, extra: str | None = None) -> DataFrame:
    """The queries, packed evenly and written. Rows that are alike are one; those that only share an id are dealt apart."""
    parts = max(1, -(-queries.count() // BLOCK))
    return cut(packed(queries.repartition(parts, F.xxhash64("vec_id", "embedding")), BLOCK, extra), name)


def unpacked(dims: int, ids: bytes, x: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, "<i8")
    return own, np.frombuffer(x, "<f8").reshape(len(own), dims)


def meetings(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Each chunk with each block of queries of its length: chunk columns, then block columns after ``q_``.

    The stated set of queries in blocks against all rows: rows here are pairs of a chunk and a block. The
    condition is written so that it is no key, as all rows would share it; Spark sends the blocks to every task
    if they are below its broadcast limit, and else pairs partitions of chunks with partitions of blocks.
    """
    q = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    return chunks.join(q, F.col("dims") - F.col("q_dims") == 0)


def scored(chunks: DataFrame, queries: DataFrame, pick: Callable[..., tuple[Hits, int]], k: int) -> DataFrame:
    """``pick``'s entries of every meeting, as far as they are among a task's best ``k`` of their query."""
    extra = "extra" in queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[Hits] = []
        last, size = None, 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("dims", "ids", "x", "q_ids", "q_x", *(["q_extra"] if extra else []))), strict=True):
                dims, ids, x, q_ids, q_x, *cutoffs = (v.as_py() for v in row)
                own, y = unpacked(dims, ids, x)
                if last is None or last[0] != ids:
                    last = (ids, quantised(y))
                names, q = unpacked(dims, q_ids, q_x)
                bar = (np.frombuffer(cutoffs[0], "<f8"),) if extra else (k,)
                (a, b, s), _ = pick(quantised(q), last[1], names[:, None] == own[None, :], *bar)
                found.append(best(names[a], own[b], longs(s), k))
                size += len(found[-1][0])
                if size > HELD:
                    found = [best(*(np.concatenate(c) for c in zip(*found, strict=True)), k)]
                    if len(found[0][0]) > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.pop()], ["query_id", "vec_id", "score"])
                    size = sum(len(f[0]) for f in found)
        if found:
            done = best(*(np.concatenate(c) for c in zip(*found, strict=True)), k)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in done], ["query_id", "vec_id", "score"])

    bounded_batches(chunks.sparkSession)
    return meetings(chunks, queries).mapInArrow(run, HITS)


def ready(df: DataFrame) -> DataFrame:
    return df.filter(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` different candidates of each query."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of ``queries(vec_id, embedding)`` the best ``k`` of ``vectors``."""
    chunks, queries = cut(packed(ready(vectors), CHUNK), "chunks"), ready(queries).distinct()
    seen = ranked(scored(chunks, blocks(queries, "queries"), leading, k), k)
    # a score at the end of a long's range may stand for one beyond, and one that no double holds is no safe bar: rounded down
    bar = F.when(F.abs("score") < EXACT, F.col("score").cast("double")).otherwise(F.lit(float("-inf")))
    cutoff = seen.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), bar.alias("cutoff"))
    told = queries.join(cutoff, "vec_id", "left").select("vec_id", "embedding", F.coalesce("cutoff", F.lit(float("-inf"))).alias("cutoff"))
    return ranked(scored(chunks, blocks(cut(told, "told"), "cutoffs", "cutoff"), sufficient, k), k)


def op1_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
