"""Approximate nearest neighbours by vantage-point trees, one for each shard of the vectors.

Nearness is the inner product. Within a shard each vector gets one more component that
brings all of them to the shard's largest norm; a query gets zero there, and then a larger
inner product is a smaller Euclidean distance, which obeys the triangle inequality. A node
splits its vectors at the median distance from a vantage point. A search keeps the distance
``t`` of its k-th nearest so far and leaves a side out if ``factor`` times the least distance
that the inequality allows there is beyond ``t``: factor one is exact, larger ones prune
more. Queries go down a tree together; each starts in the leaf nearest to it. The k best of all
these leaves give each query a cutoff, which all trees are told before they are searched. How much
may be pruned depends on the vectors (the bounds bite more the lower their intrinsic dimension is),
so each search takes, shard by shard, the largest of ``FACTORS`` whose recall on a bounded sample
of its queries, held against the exact search, is at least ``RECALL``. What counts there are the rows
that reach their query's cutoff: a shard is near to some queries only, and those decide. Near a
vantage point (one that is itself within ``t``) the inequality says most and errs most when relaxed;
sides are left out there by the exact bound alone.

Distances are taken on the shard's own scale, a power of two, and each query is made as long as the
shard's longest vector, so that neither tiny nor huge vectors lose digits and a factor means the same
for all queries; scores are those of the vectors as given.

Shards are cut from the stream of rows where they lie (``SHARD_ROWS`` at most), so that
every row is indexed, memory is bounded and nothing is shuffled. The index is a written
table of plain numbers, and so are the queries, in blocks; each tree meets each block in one join.

Defined results: vectors that are null, zero, or hold null or non-finite components take no
part, nor do rows with null id; vectors meet those of their own length only; rows that share
an id count as one, with their best score; ties go to the smaller id; scores beyond doubles
are infinite, found by their true order and ranked by id; a query without candidates has no rows, and so has an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import bounded_batches, table
from ._util import cut as written
from .topk import blocks, meetings, of_length, ranked, unpacked, usable

SHARD_ROWS, LEAF_ROWS = 8192, 96
#: Factors to choose from; none of them reaching ``RECALL`` on a sample in a shard, the search there is exact. Queries are drawn
#: ``SAMPLE`` at a time until ``ENOUGH`` rows that count are found; a shard that has fewer for a block of queries is searched exactly.
FACTORS, RECALL, SAMPLE, ENOUGH = (5.0, 4.0, 3.0, 2.5, 2.0, 1.5, 1.25), 0.98, 128, 512
#: Scores are compared while searching in steps of this share of their vectors' sizes, so that equal vectors tie in spite of rounding.
STEP = 2.0**-38
HITS = "query_id long, vec_id long, score double"
TREE = "dims int, n int, ids binary, x binary, norm2 double, points binary, nodes binary"
#: A node: vantage point, inner and outer child, first row and the one after the last; distances that bound the sides.
NODE = np.dtype([("v", "<i4"), ("inner", "<i4"), ("outer", "<i4"), ("a", "<i4"), ("b", "<i4"), ("inside", "<f8"), ("outside", "<f8")])
#: Pairs found that a task holds before it hands on the best of each query.
HELD = 500_000


def exponents(x: np.ndarray) -> np.ndarray:
    """The power of two that each row's largest component lies below."""
    return np.frexp(np.abs(x).max(axis=1, initial=0.0))[1]


@dataclass
class Tree:
    ids: np.ndarray
    x: np.ndarray
    #: From here on all is on the shard's own scale, by which its largest component lies between a half and one.
    #: Largest squared norm; vantage points; the nodes: (vantage row, median distance, inner child, outer child, first row, last row).
    norm2: float
    extra: np.ndarray
    nodes: list[tuple[int, float, int, int, int, int]]

    def __post_init__(self) -> None:
        own = exponents(self.x)
        self.top = top = int(own.max(initial=0) if (self.x != 0).any() else 0)
        self.y = np.ldexp(self.x, -top)
        self.step = np.ldexp(STEP, np.maximum(own - top, -900))


def build(ids: np.ndarray, x: np.ndarray, leaf: int = LEAF_ROWS) -> Tree:
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    y = np.ldexp(x, -int(exponents(x).max()))
    n2 = np.einsum("ij,ij->i", y, y)
    norm2 = float(n2.max())
    full = np.c_[y, np.sqrt(np.maximum(norm2 - n2, 0.0))]
    rng, nodes, place = np.random.default_rng(len(ids)), [], np.arange(len(ids))
    todo = [(0, len(ids), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        at = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = at
        nodes.append([-1, 0.0, -1, -1, a, b])
        if b - a > leaf:
            rows = place[a:b]
            v = int(rows[rng.integers(len(rows))])
            d = np.sqrt(np.maximum(((full[rows] - full[v]) ** 2).sum(axis=1), 0.0))
            mid = float(np.median(d))
            inner = d <= mid
            if inner.all():
                inner = d < mid
            if inner.any() and not inner.all():
                m = int(inner.sum())
                place[a:b] = np.r_[rows[inner], rows[~inner]]
                # the bounds hold whatever the median: the inner side lies within, the outer beyond
                nodes[at][:2] = [v, float(d[inner].max())]
                nodes[at].append(float(d[~inner].min()))
                todo += [(a + m, b, at, 1), (a, a + m, at, 0)]
    vantage = {n[0] for n in nodes if n[0] >= 0}
    points = np.array([full[v] for v in sorted(vantage)]) if vantage else np.empty((0, full.shape[1]))
    where = {v: i for i, v in enumerate(sorted(vantage))}
    done = [(where.get(n[0], -1), n[1], n[2], n[3], n[4], n[5], n[6] if len(n) > 6 else 0.0) for n in nodes]
    return Tree(ids[place], x[place], norm2, points, done)


def stored(tree: Tree) -> list:
    """A tree's row of ``TREE``."""
    nodes = np.array([(v, inner, outer, a, b, inside, outside) for v, inside, inner, outer, a, b, outside in tree.nodes], NODE)
    return [tree.x.shape[1], len(tree.ids), tree.ids.astype("<i8").tobytes(), tree.x.astype("<f8").tobytes(), tree.norm2, tree.extra.astype("<f8").tobytes(), nodes.tobytes()]


def restored(dims: int, ids: bytes, x: bytes, norm2: float, points: bytes, nodes: bytes) -> Tree:
    rows = [(v, inside, inner, outer, a, b, outside) for v, inner, outer, a, b, inside, outside in np.frombuffer(nodes, NODE).tolist()]
    return Tree(*unpacked(dims, ids, x), norm2, np.frombuffer(points, "<f8").reshape(-1, dims + 1), rows)


class Search:
    """The k nearest in one tree for a block of queries, as far as they reach their query's ``cutoff``, a score."""

    def __init__(self, tree: Tree, ids: np.ndarray, q: np.ndarray, k: int, factor: float, cutoff: np.ndarray | None = None):
        self.tree, self.ids, self.given, self.k, self.factor = tree, ids, q, k, factor
        own = exponents(q)
        q = np.ldexp(q, -own[:, None])
        # a query's scale does not change its order, but says how tight the bounds are: all are as long as the shard's longest
        stretch = np.sqrt(tree.norm2 / np.einsum("ij,ij->i", q, q))
        self.q = q = q * stretch[:, None]
        self.q2 = np.einsum("ij,ij->i", q, q)
        self.bar = np.full(len(q), -np.inf)
        if cutoff is not None:  # on the scale of the search, with room for rounding; none where the score left the range of doubles
            good = np.isfinite(cutoff) & (np.abs(cutoff) > 1e-290)
            with np.errstate(over="ignore"):
                bar = np.ldexp(np.where(good, cutoff, 0.0), -(own + tree.top)) * stretch - 1e-9 * np.sqrt(self.q2 * tree.norm2)
            self.bar[good] = bar[good]
        self.score = np.full((len(q), k), -np.inf)
        self.row = np.full((len(q), k), -1)
        self.home = np.full(len(q), -1)
        points = tree.extra
        self.reach = np.sqrt(np.maximum(self.q2[:, None] + (points**2).sum(axis=1) - 2 * q @ points[:, : q.shape[1]].T, 0.0)) if len(points) else None

    def run(self, leaves: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query ids, row ids, scores); of ``leaves``, those that are found where each query starts."""
        self._walk(seed=True)
        if not leaves:
            self._walk(seed=False)
        a, b = np.nonzero(self.row >= 0)
        rows = self.row[a, b]
        # the score itself, in double precision and in one order of addition for equal vectors
        with np.errstate(over="ignore", invalid="ignore"):
            return self.ids[a], self.tree.ids[rows], np.einsum("ij,ij->i", self.given[a], self.tree.x[rows])

    def _walk(self, seed: bool) -> None:
        nodes, todo = self.tree.nodes, [(0, np.arange(len(self.q)), None)]
        while todo:
            at, who, bound = todo.pop()
            if bound is not None:  # the k-th nearest may have come closer since this side was put off
                who = who[bound <= self._limit(who)]
            if not len(who):
                continue
            v, inside, inner, outer, a, b, outside = nodes[at]
            if v < 0:
                if not seed:
                    who = who[self.home[who] != at]
                else:
                    self.home[who] = at
                if len(who):
                    self._leaf(who, a, b)
                continue
            d = self.reach[who, v]
            low = np.maximum(d - inside, 0.0), np.maximum(outside - d, 0.0)
            near = low[0] <= low[1]
            if seed:
                todo += [(outer, who[~near], None), (inner, who[near], None)]
            else:
                relaxed = np.where(d > self._limit(who), self.factor, 1.0)
                todo += [(outer, who, relaxed * low[1]), (inner, who, relaxed * low[0])]

    def _limit(self, who: np.ndarray) -> np.ndarray:
        worst = np.maximum(self.score[who, -1], self.bar[who])
        with np.errstate(invalid="ignore"):
            t = np.sqrt(np.maximum(self.q2[who] + self.tree.norm2 - 2 * worst, 0.0))
        return np.where(np.isfinite(worst), t * (1 + 1e-7) + 1e-6, np.inf)

    def _leaf(self, who: np.ndarray, a: int, b: int) -> None:
        ids = self.tree.ids[a:b]
        new = np.rint(self.q[who] @ self.tree.y[a:b].T / self.tree.step[a:b]) * self.tree.step[a:b]
        new[self.ids[who][:, None] == ids[None, :]] = -np.inf
        better = (new >= np.maximum(self.score[who, -1], self.bar[who])[:, None]) & np.isfinite(new)
        hit = better.any(axis=1)
        who, new = who[hit], np.where(better, new, -np.inf)[hit]
        if not len(who):
            return
        score = np.c_[self.score[who], new]
        row = np.c_[self.row[who], np.broadcast_to(np.arange(a, b), new.shape)]
        tie = np.where(row >= 0, self.tree.ids[np.maximum(row, 0)], np.iinfo(np.int64).max)
        order = np.lexsort((tie, -score), axis=-1)
        score, row, tie = (np.take_along_axis(m, order, axis=1) for m in (score, row, tie))
        if self.repeats:  # of rows that share an id the best one counts
            first = np.ones(tie.shape, bool)
            for r in range(len(tie)):
                first[r] = False
                first[r, np.unique(tie[r], return_index=True)[1]] = True
            score = np.where(first, score, -np.inf)
            order = np.lexsort((tie, -score), axis=-1)
            score, row = (np.take_along_axis(m, order, axis=1) for m in (score, row))
        good = np.isfinite(score[:, : self.k])
        self.score[who] = np.where(good, score[:, : self.k], -np.inf)
        self.row[who] = np.where(good, row[:, : self.k], -1)

    @property
    def repeats(self) -> bool:
        if not hasattr(self, "_repeats"):
            self._repeats = len(np.unique(self.tree.ids)) < len(self.tree.ids)
        return self._repeats


Hits = tuple[np.ndarray, np.ndarray, np.ndarray]


def factor_for(tree: Tree, ids: np.ndarray, q: np.ndarray, cutoff: np.ndarray, k: int, want: set[tuple[int, int]]) -> float:
    """The largest factor that finds ``RECALL`` of what the exact search finds for these queries in this tree."""

    def found(factor: float) -> set[tuple[int, int]]:
        a, b, _ = Search(tree, ids, q, k, factor, cutoff).run()
        return set(zip(a.tolist(), b.tolist(), strict=True))

    return next((f for f in FACTORS if len(found(f) & want) >= RECALL * len(want)), 1.0)


def searched(tree: Tree, ids: np.ndarray, q: np.ndarray, cutoff: np.ndarray, k: int) -> Hits:
    """What a search by the tree's own factor finds; the queries that were sampled for it keep their exact answers."""
    order, done, want, at = np.random.default_rng(len(ids)).permutation(len(ids)), [], set(), 0
    while at < len(order) and len(want) < ENOUGH:
        part = order[at : at + SAMPLE]
        done.append(Search(tree, ids[part], q[part], k, 1.0, cutoff[part]).run())
        want |= set(zip(done[-1][0].tolist(), done[-1][1].tolist(), strict=True))
        at += SAMPLE
    if at < len(order):
        some = order[:at][np.isin(ids[order[:at]], [a for a, _ in want])]
        rest = order[at:]
        done.append(Search(tree, ids[rest], q[rest], k, factor_for(tree, ids[some], q[some], cutoff[some], k, want), cutoff[rest]).run())
    return tuple(np.concatenate(c) for c in zip(*done, strict=True))


def ready(vectors: DataFrame) -> DataFrame:
    good = usable() & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull()
    return vectors.filter(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def index(vectors: DataFrame, shard_rows: int = SHARD_ROWS, leaf: int = LEAF_ROWS) -> DataFrame:
    """The tree of each shard, a row of ``TREE`` each; every usable row is in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.float64(), pa.binary(), pa.binary()]

        def shard(n: int) -> pa.RecordBatch:
            parts = held.pop(n)
            row = stored(build(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), leaf))
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, kinds, strict=True)], [c.split()[0] for c in TREE.split(", ")])

        for batch in batches:
            for n, ids, x in of_length(batch.column(0), batch.column(1)):
                for i in range(0, len(ids), shard_rows):
                    part = ids[i : i + shard_rows], x[i : i + shard_rows]
                    if sum(len(p[0]) for p in held.get(n, ())) + len(part[0]) > shard_rows:
                        yield shard(n)
                    held.setdefault(n, []).append(part)
        for n in list(held):
            yield shard(n)

    return ready(vectors).mapInArrow(run, TREE)


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries that may be among the ``k`` best different ids of a query: those of the best score of their id."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    pair = np.lexsort((np.arange(len(query)), ids, query))  # the first of an id is its best
    again = np.zeros(len(query), bool)
    again[pair[1:]] = (query[pair[1:]] == query[pair[:-1]]) & (ids[pair[1:]] == ids[pair[:-1]])
    query, ids, score = query[~again], ids[~again], score[~again]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], ids[keep], score[keep]


def met(trees: DataFrame, queries: DataFrame, k: int, pick: Callable[[Tree, np.ndarray, np.ndarray, np.ndarray], Hits]) -> DataFrame:
    """``pick``'s hits of every tree with every block of queries, as far as they are among a task's best ``k`` of their query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size, last = [], 0, (None, None)

        def out(hits) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in hits], ["query_id", "vec_id", "score"])

        for batch in batches:
            names = [c.split()[0] for c in TREE.split(", ") if not c.startswith("n ")] + ["q_ids", "q_x", "q_extra"]
            for row in zip(*(batch.column(c) for c in names), strict=True):
                *cells, q_ids, q_x, cutoff = (v.as_py() for v in row)
                if last[0] != cells[1]:
                    last = cells[1], restored(*cells)
                ids, q = unpacked(cells[0], q_ids, q_x)
                found.append(pick(last[1], ids, q, np.frombuffer(cutoff, "<f8")))
                size += len(found[-1][0])
                if size > HELD:
                    found = [best(*(np.concatenate(c) for c in zip(*found, strict=True)), k)]
                    if len(found[0][0]) > HELD // 2:
                        yield out(found.pop())
                    size = sum(len(f[0]) for f in found)
        if found:
            yield out(best(*(np.concatenate(c) for c in zip(*found, strict=True)), k))

    return ranked(meetings(trees, queries).mapInArrow(run, HITS), k)


def search(trees: DataFrame, queries: DataFrame, k: int, factor: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each of ``queries(vec_id, embedding)``; ``trees`` is a written index.

    Without a ``factor`` each shard gets its own by ``factor_for``.
    """
    bounded_batches(trees.sparkSession)
    queries = ready(queries).distinct()
    none = F.lit(float("-inf"))
    leads = met(trees, blocks(queries.withColumn("cutoff", none), "queries", "cutoff"), k, lambda tree, ids, q, cutoff: Search(tree, ids, q, k, 1.0).run(leaves=True))
    cutoff = leads.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("cutoff"))
    told = written(queries.join(cutoff, "vec_id", "left").withColumn("cutoff", F.coalesce("cutoff", none)), "told")
    pick = lambda tree, ids, q, cutoff: Search(tree, ids, q, k, factor, cutoff).run() if factor else searched(tree, ids, q, cutoff, k)
    return met(trees, blocks(told, "cutoffs", "cutoff"), k, pick)


def op10_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(written(index(vectors), "vantage-point-trees"), vectors.filter(F.col("vec_id") % 20 == 0), 20)
