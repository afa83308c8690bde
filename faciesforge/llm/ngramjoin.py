"""Jaccard join of documents on sets of word n-grams by vertical partitioning.

N-grams have a global order, that of their 64-bit hashes, which is cut into fragments; each
set is cut at the same boundaries into segments. Two steps use the fragments:

* Candidates. Sets that link differ in at most ``d`` n-grams, a number that follows from the
  larger size, so of more than ``d`` fragments one holds the same segment in both. Each set is
  filed under a key for each of its segments; equal keys meet. A common passage alone makes no
  candidates, as the rest of a segment differs. Sets with so many empty segments that only
  those could be equal are filed under further, independent cuts of the order as well, in the
  end under the n-grams of their prefix: no link is lost, and nothing is capped.
* Overlaps. Pairs of candidates whose sizes, or the parities of whose n-grams in buckets, show that
  they differ in too many go. Of each other pair the segments of one fragment are compared by
  themselves; a partial overlap is a row, and the sum over the fragments decides exactly.

Equal sets are one node. The least node of a bucket is its pivot: each node meets the least of
its pivots first, then, of those pivots that it is not together with yet, the most similar one.
In large buckets whose members are in several components even then each node meets the most
similar one of another component, round after round. What is still apart is looked through
pair by pair, large buckets in tasks for two bounded parts each, which hold sizes and parities
but no sets and give the pairs of different components that can still link. So a group of near
copies costs its size, mostly, and no group has to fit a task. Components are stars over
written tables.

Defined results: null texts and those without words have the empty set and are linked with
nothing, not even each other; texts with fewer words than an n-gram have one, the whole
sequence; a row with null id gets the component of its set and is never the smallest id, and
alone its component is null; repeated rows and ids are answered row by row; an empty table
gives no rows; other columns are ignored. N-grams and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import bounded_batches, cut, held, table
from .simhash import components, signed

GRAM = 4
#: Sets link when 100 times their intersection is at least this many times their union.
PERCENT = 85
#: Fragments in which overlaps are counted, as a power of two.
FRAGMENT_BITS = 3
#: Independent cuts of the order before the prefix is used.
CUTS = 3
#: Members up to which a bucket is looked through pair by pair, and of a part of a larger one.
SMALL_BUCKET, PART_SETS = 24, 1000
#: How often large buckets are looked through for the nearest of each node before they are for all pairs.
ROUNDS = 3
#: So many candidates or pairs of them (a few numbers each) are sent to all tasks; more are joined by a shuffle.
BROADCAST_NODES = 1_000_000
SEED = 42
WORDS_HELD, PIECE = 300_000, 1 << 20
MIX = np.random.default_rng(SEED).integers(0, 2**64, 8, np.uint64) | np.uint64(1)
SPACE = re.compile(rb"[\x20\x09-\x0d]")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX[0]
    x = (x ^ (x >> np.uint64(29))) * MIX[1]
    return x ^ (x >> np.uint64(32))


class Words(dict):
    """Hashes of words met before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


def word_hashes(raw: bytes, known: Words) -> np.ndarray:
    """The hash of each word of a UTF-8 text; a very long text is split a piece at a time."""
    out, at = [], 0
    while at < len(raw):
        end = SPACE.search(raw, at + PIECE)
        end = end.start() if end else len(raw)
        words = raw[at:end].lower().split()  # on bytes both mind ASCII alone
        out.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def grams(raw: bytes, known: Words, gram: int = GRAM) -> np.ndarray:
    """The different n-grams of a text in their global order."""
    w = word_hashes(raw, known)
    k = min(gram, len(w))
    if not k:
        return w
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = (mixed(h) ^ w[i : i + n]) * MIX[2]
    return np.unique(mixed(h))


def node_of(h: np.ndarray) -> int | None:
    return signed(xxhash.xxh64_intdigest(h.tobytes(), SEED)) if len(h) else None


def difference(size: int, percent: int) -> int:
    """In how many n-grams two linked sets differ at most, the larger one of which has so many."""
    return 2 * size * (100 - percent) // (100 + percent)


def bits_for(d: int) -> int:
    """Fragments, as a power of two: more than ``d`` by enough that empty segments hardly matter."""
    return (d + d // 16).bit_length()


def segments(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(fragment, where it begins) of the segments of an ordered set that are not empty."""
    f = h >> np.uint64(64 - bits) if bits else np.zeros(len(h), np.uint64)
    starts = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
    return f[starts], starts


def keys(h: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The keys that a set is filed under: two sets that link share one."""
    m = len(h)
    if not m:
        return h
    largest = m * 100 // percent  # of what it may link with
    wanted = list(range(bits_for(difference(m, percent)), bits_for(difference(largest, percent)) + 1))
    out, order = [], h
    for i in range(CUTS):
        again = []
        for bits in wanted:
            fragment, starts = segments(order, bits)
            content = np.add.reduceat(mixed(order + MIX[3]), starts)
            out.append(mixed(content ^ mixed(fragment * MIX[4] + np.uint64(bits << 8 | i))))
            most = min(difference(largest, percent), (1 << bits) - 1)
            if len(starts) <= most:  # so that all equal segments may be empty ones
                again.append(bits)
        wanted = again
        if not wanted:
            break
        order = np.sort(mixed(h ^ MIX[5 + i]))
    if wanted:
        out.append(mixed(h[: m - -(-m * percent // 100) + 1] ^ MIX[4]))
    return np.unique(np.concatenate(out))


def parities(h: np.ndarray) -> np.ndarray:
    """Bits that tell for two to four times as many buckets of n-grams as there are n-grams (a power of two, 64 at least) whether a set
    has an odd number in each: two sets differ in at least as many n-grams as bits."""
    buckets = max(64, 2 << (len(h) - 1).bit_length())
    odd = np.bincount((h & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def filed(docs: DataFrame, gram: int, percent: int) -> DataFrame:
    """(doc_id, n, node, bits, keys): a set's size, number, parities and keys; copies that a task has met before bring no bits and keys again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met = held("n-gram words", Words), set()
        for batch in batches:
            n, node, bits, under = [], [], [], []
            for raw in batch.column(1).cast(pa.binary()):
                h = grams(raw.as_py() or b"", known, gram)
                at = node_of(h)
                n.append(len(h))
                node.append(at)
                bits.append(None if at in met or at is None else parities(h))
                under.append(None if at in met else keys(h, percent).view(np.int64))
                met.add(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(under, pa.list_(pa.int64()))], ["doc_id", "n", "node", "bits", "keys"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, node long, bits array<long>, keys array<long>")


def cut_sets(docs: DataFrame, some: DataFrame, gram: int) -> DataFrame:
    """(node, n, fragment, grams) of the sets of ``some(node, doc_id)``, from the texts read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held("n-gram words", Words)
        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                h = grams(raw.as_py() or b"", known, gram)
                if node_of(h) != at:
                    continue  # a row of the same id with another text
                fragment, starts = segments(h, FRAGMENT_BITS)
                parts = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(h)], pa.int32()), pa.array(h.view(np.int64)))
                columns = [pa.array(np.full(len(starts), x, np.int64)) for x in (at, len(h))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(fragment.astype(np.int32)), parts], ["node", "n", "fragment", "grams"])

    some = sent(some.withColumnRenamed("doc_id", "id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id_here"), "text").join(some, F.col("id_here").eqNullSafe(F.col("id"))).select("node", "text")
    found = texts.mapInArrow(run, "node long, n long, fragment int, grams array<long>").withColumn("copy", F.monotonically_increasing_id())
    found = cut(found, "sets")
    # rows repeated with id and text come more than once; only their numbers are compared
    again = found.groupBy("node", "fragment").agg(F.count("*").alias("copies"), F.min("copy").alias("first")).filter("copies > 1")
    again = sent(cut(again.select("node", "fragment", "first"), "copies", few_files=True))
    return found.join(again, ["node", "fragment"], "left").filter("first is null or copy = first").select("node", "n", "fragment", "grams")


def sent(few: DataFrame) -> DataFrame:
    """A written table to be joined: sent to all tasks if it has up to ``BROADCAST_NODES`` rows, else shuffled."""
    return F.broadcast(few) if few.count() <= BROADCAST_NODES else few


def differing() -> Column:
    """In how many n-grams the sets of ``bits`` and ``bits_other`` surely differ; null where one has more than twice the buckets."""
    folded = lambda x, y: F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, 1, F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(x))
    differ = F.aggregate(F.zip_with(folded("bits", "bits_other"), folded("bits_other", "bits"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, x: a + x)
    return F.when(F.greatest(F.size("bits"), F.size("bits_other")) <= 2 * F.least(F.size("bits"), F.size("bits_other")), differ)


def may_link(percent: int) -> Column:
    """Whether pairs with ``n``, ``other`` and ``differ`` can link. Sizes that link differ by less than half."""
    sizes = F.least("n", "other") * 100 >= F.greatest("n", "other") * percent
    return sizes & (F.col("differ") * (100 + percent) <= (F.col("n") + F.col("other")) * (100 - percent))


def overlapping(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b, n, other)``, a written table, that link: partial overlaps, a row for each fragment, are summed."""
    ends = sent(cut(pairs.select(F.col("b").alias("node")).distinct(), "ends", few_files=True))
    two = sets.join(ends, "node", "left_semi").select(F.col("node").alias("b"), "fragment", F.col("grams").alias("theirs"))
    one = sets.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("mine"))
    partial = one.join(sent(pairs), "a").join(two, ["b", "fragment"])
    partial = partial.select("a", "b", "n", "other", F.size(F.array_intersect("mine", "theirs")).alias("common"))
    summed = partial.groupBy("a", "b", "n", "other").agg(F.sum("common").alias("common"))
    return summed.filter(F.col("common") * (100 + percent) >= (F.col("n") + F.col("other")) * percent).select("a", "b")


def may_link_here(rows: pa.Table, percent: int, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs among ``rows(node, n, root, bits)`` of different components that can link (``may_link``): all, or for each node the one
    that differs least."""
    node, first = np.unique(rows.column("node").to_numpy(), return_index=True)
    n, root = rows.column("n").to_numpy()[first], rows.column("root").to_numpy()[first]
    bits = rows.column("bits").combine_chunks().take(pa.array(first))
    wide = bits.value_lengths().to_numpy()
    by_width = {w: np.flatnonzero(wide == w) for w in np.unique(wide).tolist()}
    words = {w: bits.take(pa.array(at)).flatten().to_numpy().view(np.uint64).reshape(-1, w) for w, at in by_width.items()}
    least, best = np.full(len(node), np.iinfo(np.int64).max), np.full(len(node), -1)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for w, at in by_width.items():
        for other in (w, 2 * w):  # sizes that link differ by less than half
            there = by_width.get(other)
            if there is None:
                continue
            theirs = words[other] if other == w else words[other][:, :w] ^ words[other][:, w:]
            for i, mine in zip(at.tolist(), words[w], strict=True):
                differ = np.bitwise_count(theirs ^ mine).sum(axis=1, dtype=np.int64)
                near = (differ * (100 + percent) <= (n[i] + n[there]) * (100 - percent)) & (np.minimum(n[i], n[there]) * 100 >= np.maximum(n[i], n[there]) * percent)
                good = near & (root[there] != root[i]) & ((there > i) | (other != w))
                found, differ = there[good], differ[good]
                if not nearest:
                    a.append(np.full(len(found), node[i]))
                    b.append(node[found])
                elif len(found):
                    k = int(differ.argmin())
                    if differ[k] < least[i]:
                        least[i], best[i] = differ[k], found[k]
                    closer = differ < least[found]
                    least[found[closer]], best[found[closer]] = differ[closer], i
    if nearest:
        has = np.flatnonzero(best >= 0)
        return node[has], node[best[has]]
    return np.concatenate(a), np.concatenate(b)


def linked(docs: DataFrame, marked: DataFrame, gram: int, percent: int) -> DataFrame:
    """(a, b): links between different sets; their components are those of all links."""
    nodes = cut(marked.filter("node is not null").groupBy("node").agg(F.max("n").alias("n"), F.min("doc_id").alias("doc_id"), F.max("bits").alias("bits")), "nodes", few_files=True)
    bucket = Window.partitionBy("key")
    met = marked.filter("keys is not null").select("node", F.explode("keys").alias("key")).repartition("key")
    met = met.withColumn("pivot", F.min("node").over(bucket)).withColumn("last", F.max("node").over(bucket)).filter("pivot < last")
    met = cut(met.select("key", "node", "pivot").distinct(), "candidates")
    some = cut(met.select("node").distinct().join(nodes, "node").select("node", "doc_id"), "some", few_files=True)
    sets = cut_sets(docs, some, gram)
    size = cut(nodes.join(some.select("node"), "node", "left_semi").select("node", "n", "bits"), "sizes", few_files=True)

    def possible(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs(a, b)`` that can link."""
        sized = pairs.join(size.toDF("a", "n", "bits"), "a").join(size.toDF("b", "other", "bits_other"), "b")
        return sized.withColumn("differ", differing()).filter(may_link(percent)).select("a", "b", "n", "other", "differ")

    def links_of(pairs: DataFrame) -> DataFrame:
        """Links of pairs that can link."""
        return cut(overlapping(cut(pairs.select("a", "b", "n", "other"), "pairs", few_files=True), sets, percent), "links", few_files=True)

    def labelled(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The candidates with the root of their component, and the keys of buckets that hold several."""
        roots = cut(components(links), "roots", few_files=True)
        out = cut(met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "labelled")
        keys = out.groupBy("key").agg(F.count("*").alias("members"), F.min("root").alias("low"), F.max("root").alias("high"), F.bit_xor(F.xxhash64("node")).alias("who"))
        return out, keys.filter("low <> high")

    # each node with the least of its pivots
    links = links_of(possible(met.groupBy("node").agg(F.min("pivot").alias("pivot")).filter("node <> pivot").toDF("a", "b")))

    # in buckets of several components: each node with the pivot that differs least, of those that it is not together with
    told, several = labelled(links)
    apart = told.join(several.select("key"), "key", "left_semi")
    of_pivot = apart.filter("node = pivot").select("key", F.col("root").alias("other"))
    pairs = possible(apart.join(of_pivot, "key").filter("root <> other").select("node", "pivot").distinct().toDF("a", "b"))
    links = links.union(links_of(pairs.groupBy("a").agg(F.min_by(F.struct("b", "n", "other"), F.struct("differ", "b")).alias("p")).select("a", "p.*")))

    def within_large(left: DataFrame, nearest: bool) -> DataFrame:
        """Pairs of different components in the buckets of ``left`` that are too large to be joined with themselves."""
        large = left.filter(F.col("members") > SMALL_BUCKET)
        parts = large.groupBy("key").agg(F.ceil(F.count("*") / PART_SETS).cast("int").alias("parts"))
        dealt = large.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("node", "root", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))

        def every_two(rows: pa.Table) -> pa.Table:
            a, b = may_link_here(rows, percent, nearest)
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        found = dealt.join(size, "node").select("key", "i", "j", "node", "n", "root", "bits").groupBy("key", "i", "j").applyInArrow(every_two, "a long, b long")
        return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mixed_buckets() -> DataFrame:
        """The members of buckets that hold several components, written; buckets of the same sets are one."""
        told, several = labelled(links)
        several = several.groupBy("who", "members").agg(F.min("key").alias("key"))
        return cut(told.join(several.select("key", "members"), "key").select("key", "node", "root", "members"), "mixed")

    # in large buckets each node with the one that differs least, as long as that brings components together
    for _ in range(ROUNDS):
        left = mixed_buckets()
        if left.filter(F.col("members") > SMALL_BUCKET).isEmpty():
            break
        more = links_of(possible(within_large(left, True)))
        links = links.union(more)
        if more.isEmpty():
            break

    # what is left, pair by pair
    left = mixed_buckets()
    small = left.filter(F.col("members") <= SMALL_BUCKET)
    two = small.select("key", F.col("node").alias("b"), F.col("root").alias("root_b"))
    pairs = small.select("key", F.col("node").alias("a"), "root").join(two, "key").filter("a > b and root <> root_b").select("a", "b")
    return links.union(links_of(possible(pairs.union(within_large(left, False)).distinct())))


def jaccard_join(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: the size of its set and the smallest id reachable by links."""
    marked = cut(filed(docs, gram, percent), "filed")
    stars = components(linked(docs, marked, gram, percent)).toDF("node", "root")
    nodes = marked.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"))
    rooted = cut(nodes.join(stars, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root")), "rooted", few_files=True)
    low = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    placed = marked.filter("node is not null").join(rooted.join(low, "root").select("node", "component_id"), "node")
    alone = marked.filter("node is null").withColumn("component_id", F.col("doc_id"))
    return placed.select("doc_id", "n", "component_id").union(alone.select("doc_id", "n", "component_id")).withColumnRenamed("n", "n_shingles")


def op13_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
