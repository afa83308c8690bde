"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. If two fingerprints differ in at most
four bits, some segment differs in at most one, and then the two share the segment with
one bit taken out. So every fingerprint is indexed under the 64 keys (bit taken out, rest
of its segment); equal keys meet in an equality self-join over a sorted index, and each
meeting is verified on the full fingerprints. Nothing is capped: no link is lost.

Texts with one fingerprint are one node from the start (grouping is pre-aggregated), so
copies never multiply. A bucket gives every link of a small group once, and a spanning
forest of the links of a large one, found breadth first against the shrinking rest, so a
dense group of near copies costs its size and not its square. Buckets with more than
``HOT_BUCKET`` different fingerprints are told by counts before anything is gathered, and
split: the bits that their members need not share are cut into five bands, one of which
linked fingerprints share, and so on until no bucket is too large or so few bits are left
that none can be. Components come from alternating large-star and small-star
steps over tables; links, components and fingerprints never reach the driver.

Defined results: null and empty texts have no word and fingerprint zero; texts with fewer
words than a shingle have one shingle, the whole sequence; a row with null id gets the
fingerprint and component of its text and is never the smallest id; repeated rows are
answered row by row; an empty table gives no rows; other columns are ignored.

``deduplicate``, the pipeline's stage, does not work on fingerprints: near copies of five-word
shingles with a Jaccard similarity of 0.8 differ in up to 13 bits, too many to index. It finds
candidates by bands of minima over the sets and verifies them on the sets themselves (``similar``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import bounded_batches, cut, give_back, held, table, values

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: (lowest bit, bits) of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Up to this size a bucket gives all its links, beyond it a spanning forest of them.
SMALL_BUCKET = 24
HOT_BUCKET = 100_000
#: So many hot keys (8 bytes each) are sent to all tasks; more are joined by a shuffle.
BROADCAST_KEYS = 500_000
#: For deduplication: words of a shingle, and the Jaccard similarity of near copies as a fraction.
WORDS, SIMILARITY = 5, (4, 5)
#: Keys of a set and minima in each: two sets of similarity 0.8 share none with probability 6e-5, of 0.9 with 5e-11.
BANDS, BAND_ROWS = 32, 6
MIX = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * BAND_ROWS), np.uint64) | np.uint64(1)
#: Sets, and bytes of their texts, that one task of deduplication compares.
GROUP_SETS, GROUP_BYTES = 250, 8 << 20
#: The column of row numbers while rows are deduplicated.
ROW = "__row"
#: Shingles whose bits are held at a time, so that a very long text needs no more memory.
BLOCK = 255 * 256


def bit_counts(digests: list[bytes]) -> np.ndarray:
    """How many of the 8-byte digests have each bit set, the highest bit first."""
    bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8)).reshape(-1, 64)
    total = np.zeros(64, np.int64)
    whole = len(bits) // 255 * 255
    if whole:
        total += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return total + bits[whole:].sum(axis=0, dtype=np.int64)


def digests(raw: bytes, shingle: int) -> Iterator[list[bytes]]:
    """The digests of a UTF-8 text's word shingles, repeats included, ``BLOCK`` at a time."""
    words = raw.lower().split()  # on bytes both mind ASCII alone
    if not words:
        return
    k = min(shingle, len(words))
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    first, last = np.r_[0, ends[: len(words) - k]].tolist(), (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    for i in range(0, len(first), BLOCK):
        yield [digest(joined[a:b], SEED) for a, b in zip(first[i : i + BLOCK], last[i : i + BLOCK], strict=True)]


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a UTF-8 text over its word shingles, repeats included."""
    total, n = np.zeros(64, np.int64), 0
    for some in digests(raw, shingle):
        total, n = total + bit_counts(some), n + len(some)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(None, lambda: None)
        for batch in batches:
            texts = values(batch.column(1).cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t or b"", shingle) for t in texts], pa.int64())], ["doc_id", "fp"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: What the members of a bucket may differ in, by the number of its path; at first, of its segment.
Paths = list[int]
FULL = (1 << 64) - 1


def variants(nodes: DataFrame) -> DataFrame:
    """(key, path, fp) for each of the 64 ways to take one bit out of one segment; the path is the segment."""
    keys = []
    for at, (low, n) in enumerate(SEGMENTS):
        segment = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << n) - 1))
        keys += [F.struct(segment.bitwiseAND(F.lit(((1 << n) - 1) ^ (1 << i))).bitwiseOR(F.lit((low + i) << 22)).cast("long").alias("key"), F.lit(at).alias("path")) for i in range(n)]
    return nodes.select(F.explode(F.array(*keys)).alias("x"), "fp").select("x.key", "x.path", "fp")


def bands_of(free: int, bands: int) -> list[int]:
    """The set bits of ``free`` cut into even bands."""
    bits = [i for i in range(64) if free >> i & 1]
    return [sum(1 << i for i in bits[len(bits) * j // bands : len(bits) * (j + 1) // bands]) for j in range(bands)]


def finer(rows: DataFrame, paths: Paths, bands: int) -> tuple[DataFrame, Paths]:
    """Rows of hot buckets under a key for each band of the bits that their bucket leaves free."""
    cuts = [bands_of(free, bands) for free in paths]
    masks = F.expr("array(" + ",".join("array(" + ",".join(f"CAST('{signed(m)}' AS BIGINT)" for m in c) + ")" for c in cuts) + ")")
    shared = F.transform(F.element_at(masks, F.col("path") + 1), lambda m, j: F.struct(F.xxhash64("key", j, F.col("fp").bitwiseAND(m)).alias("key"), (F.col("path") * bands + j).alias("path")))
    return rows.select(F.explode(shared).alias("x"), "fp").select("x.key", "x.path", "fp"), [free & ~m for free, c in zip(paths, cuts, strict=True) for m in c]


def first_meeting(x: np.ndarray) -> np.ndarray:
    """For differences of linked fingerprints: the taken-out bit of the first key they share."""
    out = np.full(len(x), -1, np.int64)
    for low, n in SEGMENTS:
        part = (x >> np.uint64(low)) & np.uint64((1 << n) - 1)
        few = np.bitwise_count(part)
        at = np.where(few == 0, 0, np.log2(np.maximum(part, np.uint64(1)).astype(np.float64)).astype(np.int64)) + low
        out = np.where((out < 0) & (few <= 1), at, out)
    return out


def forest(f: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of the links among different fingerprints, as (members, their parent) arrays."""
    rest = f
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            parent = queue.pop()
            near = np.bitwise_count(rest ^ parent) <= most
            if near.any():
                found, rest = rest[near], rest[~near]
                yield found, np.full(len(found), parent)
                queue.extend(found)


class Bucketed:
    """Links within the groups of equal key of a stream sorted by key."""

    def __init__(self, most: int, once: bool):
        self.most, self.once = most, once

    def groups(self, key: np.ndarray, f: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[edge, len(key)])
        for s, n in zip(edge[size > SMALL_BUCKET], size[size > SMALL_BUCKET], strict=True):
            yield from forest(np.unique(f[s : s + n]), self.most)
        keep = np.repeat((size > 1) & (size <= SMALL_BUCKET), size)
        key, f = key[keep], f[keep]
        for lag in range(1, min(SMALL_BUCKET, len(key))):
            i = np.flatnonzero(key[lag:] == key[:-lag])
            if not len(i):
                break
            x = f[i] ^ f[i + lag]
            good = np.bitwise_count(x) <= self.most
            i, x = i[good], x[good]
            if self.once:
                good = first_meeting(x) == key[i] >> 22
                i = i[good]
            yield f[i], f[i + lag]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a, b in self.groups(key, f) if len(key) else ():
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []  # the group at the end of what came so far
        for batch in batches:
            if not batch.num_rows:
                continue
            key, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if held and held[0][0][0] != key[0]:
                yield from out(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
                held = []
            cut_at = int(np.searchsorted(key, key[-1]))
            if cut_at:
                yield from out(np.concatenate([*(x[0] for x in held), key[:cut_at]]), np.concatenate([*(x[1] for x in held), f[:cut_at]]))
                held = []
            held.append((key[cut_at:], f[cut_at:]))
        if held:
            yield from out(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))


def links(nodes: DataFrame, most: int = MAX_BITS, hot: int = HOT_BUCKET) -> DataFrame:
    """(a, b): links between the different fingerprints of a written table; their components are those of all links."""
    if most >= 2 * len(SEGMENTS):
        raise ValueError(f"{len(SEGMENTS)} segments find differences of up to {2 * len(SEGMENTS) - 1} bits")
    hot = max(hot, 1 << most + 2)  # below that a bucket may have no bits left for all bands
    rows, paths, level, found = variants(nodes), [FULL ^ ((1 << n) - 1 << low) for low, n in SEGMENTS], 0, None
    many = nodes.count() > hot  # else no bucket can be hot
    while True:
        cold, split = rows, None
        # a bucket's members share all but its free bits and, once, the bit taken out
        if many and max(f.bit_count() for f in paths) + 1 >= hot.bit_length():
            keys = cut(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("key"), "hot-keys", few_files=True)
            n = keys.count()
            if n:
                known = F.broadcast(keys) if n < BROADCAST_KEYS else keys
                cold, split = rows.join(known, "key", "left_anti"), rows.join(known, "key", "left_semi")
        met = cold.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(Bucketed(most, level == 0), "a long, b long")
        met = cut(met, "links")
        found = met if found is None else found.union(met)
        if split is None:
            return found
        finest, paths = finer(split, paths, most + 1)
        rows, level = cut(finest, "finer"), level + 1


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges(a, b)``: stars around the smallest node of each component.

    Alternating large-star and small-star steps; each is two grouped minima and joins, and
    is written before the next, until nothing changes.
    """
    mark = None
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars", few_files=True)
    while True:
        seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == mark or not seen[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
        edges = cut(small.select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).filter("a <> b").distinct(), "stars", few_files=True)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most: int = MAX_BITS, hot: int = HOT_BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) for each row: the smallest id reachable over links of at most ``most`` bits."""
    marked = cut(fingerprints(docs, shingle), "fingerprints")
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    stars = components(links(nodes, most, hot)).withColumnRenamed("node", "fp")
    rooted = nodes.join(stars, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    low = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return marked.join(rooted.join(low, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def shingles(raw: bytes, shingle: int) -> np.ndarray:
    """The different shingles of a text, as sorted numbers."""
    parts = [np.unique(np.frombuffer(b"".join(some), np.uint64)) for some in digests(raw, shingle)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate([np.empty(0, np.uint64), *parts]))


def band_keys(h: np.ndarray) -> list[int]:
    """A key for each band of least mixed shingles; a text without words has none."""
    if not len(h):
        return []
    low = np.full(len(MIX[0]), 2**64 - 1, np.uint64)
    for i in range(0, len(h), 1024):
        low = np.minimum(low, (h[i : i + 1024] * MIX[0][:, None] + MIX[1][:, None]).min(axis=1))
    return [signed(xxhash.xxh64_intdigest(x.tobytes(), j)) for j, x in enumerate(low.reshape(BANDS, -1))]


def sketches(rows: DataFrame, shingle: int) -> DataFrame:
    """(row, node, size, keys): a number that tells sets of shingles apart, the text's bytes, and the set's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(None, lambda: None)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            sets = (shingles(t, shingle) for t in texts)
            found = [(signed(xxhash.xxh64_intdigest(h.tobytes(), SEED)), band_keys(h)) for h in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array(list(map(len, texts)), pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.int64()))], [ROW, "node", "size", "keys"])

    bounded_batches(rows.sparkSession)
    return rows.select(ROW, "text").mapInArrow(run, f"{ROW} long, node long, size long, keys array<long>")


def near(one: np.ndarray, other: np.ndarray) -> bool:
    """Whether two sets of shingles have a Jaccard similarity of ``SIMILARITY``."""
    part, whole = SIMILARITY
    return (part + whole) * len(np.intersect1d(one, other, assume_unique=True)) >= part * (len(one) + len(other))


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """For each of some sets that are not empty the first of its component; sets of ``SIMILARITY`` or more are linked."""
    size = np.array([len(h) for h in sets])
    codes, starts = np.unique(np.concatenate(sets), return_inverse=True)[1], np.r_[0, np.cumsum(size)[:-1]]
    root, rest, has = np.arange(len(sets)), np.arange(len(sets)), np.zeros(codes.max() + 1, np.int32)
    part, whole = SIMILARITY
    while len(rest):
        first, queue, rest = rest[0], [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            mine = codes[starts[at] : starts[at] + size[at]]
            has[mine] = 1
            common = np.add.reduceat(has[codes], starts)[rest].astype(np.int64)
            has[mine] = 0
            close = (part + whole) * common >= part * (size[at] + size[rest])
            found, rest = rest[close], rest[~close]
            root[found] = first
            queue.extend(found)
    return root


def parts_of(n: Column, size: Column) -> Column:
    """Into how many parts so many sets of so many bytes are dealt, each of which one task compares."""
    return F.greatest(F.lit(1), F.ceil(n / GROUP_SETS), F.ceil(size / GROUP_BYTES)).cast("int")


def dealt_by(sets: DataFrame, group: str) -> DataFrame:
    """``sets(node, size, group)``, a written table, with the ``part`` of its group that each set is dealt to, of ``parts``.

    Only groups of several parts are looked up, so that a hot one is not gathered to be told its number.
    """
    several = cut(sets.groupBy(group).agg(parts_of(F.count("*"), F.sum("size")).alias("parts")).filter("parts > 1"), "parts", few_files=True)
    found = sets.join(several, group, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return found.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))


def similar(rows: DataFrame, shingle: int = WORDS) -> DataFrame:
    """(row, root) for each of ``rows(row, text)``: components of texts whose shingle sets have a Jaccard similarity of ``SIMILARITY`` or more.

    Equal sets are one node, and nodes that share a key are candidates; the least node of a bucket is its pivot. First each
    node is compared with the least of its pivots, which brings a group of near copies together whatever its size; then,
    in buckets that still hold several components, nodes with the pivots that they are not yet together with. Only buckets
    that are mixed even so are left: in those every two sets are compared, a large bucket by pairs of parts. Sets are dealt
    to parts of a bounded number, so no group has to meet in one task, and no link between candidates is lost.
    """
    marked = cut(sketches(rows, shingle), "sketches")
    nodes = cut(marked.groupBy("node").agg(F.min(F.struct(ROW, "size", "keys")).alias("x")).select("node", f"x.{ROW}", "x.size", "x.keys"), "nodes")
    met = nodes.select("node", F.explode("keys").alias("key"))
    buckets = met.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    met = cut(met.join(buckets.hint("merge"), "key"), "candidates")

    # the texts of candidates alone; the whole table is read for them once. Joins that bring texts are by merging at
    # every size, as a broadcast would only ever serve small tables
    some = cut(met.select("node").distinct().join(nodes.select("node", ROW), "node"), "some")
    texts = cut(some.join(rows.select(ROW, "text").hint("merge"), ROW).select("node", "text"), "texts")

    def with_pivot(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf["pivot"].iloc[0]
        mine = shingles(pdf.text[pdf.node == at].iloc[0].encode(), shingle)
        found = [n for n, t in zip(pdf.node, pdf.text, strict=True) if n != at and near(mine, shingles(t.encode(), shingle))]
        if len(pdf) > GROUP_SETS // 2:
            give_back()
        return pd.DataFrame({"a": np.array(found, np.int64), "b": at})

    def linked_pairs(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs(node, pivot)`` that are similar."""
        pairs = cut(pairs.join(nodes.select("node", "size"), "node"), "pairs")
        dealt = dealt_by(pairs, "pivot").select("node", "pivot", "part")
        both = dealt.withColumn("node", F.explode(F.array("node", "pivot"))).distinct()
        return cut(both.join(texts.hint("merge"), "node").groupBy("pivot", "part").applyInPandas(with_pivot, "a long, b long"), "similar", few_files=True)

    def labelled(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The candidates with the root of their component, and the keys of buckets that hold several."""
        roots = cut(components(links), "roots", few_files=True)
        out = cut(met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "labelled")
        return out, out.groupBy("key").agg(F.first("n").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.bit_xor(F.xxhash64("node")).alias("who")).filter("low <> high")

    links = linked_pairs(met.groupBy("node").agg(F.min("pivot").alias("pivot")).filter("node <> pivot"))
    told, mixed = labelled(links)
    apart = told.join(mixed.select("key"), "key", "left_semi")
    of_pivot = apart.filter("node = pivot").select("key", F.col("root").alias("other"))
    links = links.union(linked_pairs(apart.join(of_pivot, "key").filter("root <> other").select("node", "pivot").distinct()))
    told, mixed = labelled(links)
    mixed = mixed.filter("n > 2").groupBy("who", "n").agg(F.min("key").alias("key"))  # buckets of the same sets are one
    left = cut(told.join(mixed.select("key"), "key", "left_semi").select("key", "node").join(nodes.select("node", "size"), "node"), "left")
    left = dealt_by(left, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("node", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))

    def every_two(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        node = pdf.node.to_numpy()
        out = pd.DataFrame({"a": node, "b": node[linked([shingles(t.encode(), shingle) for t in pdf.text])]}).query("a != b")
        if len(pdf) > GROUP_SETS // 2:
            give_back()
        return out

    more = cut(left.join(texts.hint("merge"), "node").groupBy("key", "i", "j").applyInPandas(every_two, "a long, b long"), "similar", few_files=True)
    final = components(links.union(more)).toDF("node", "root")
    return marked.select(ROW, "node").join(final, "node", "left").select(ROW, F.coalesce("root", "node").alias("root"))


def deduplicate(docs: DataFrame, shingle: int = WORDS) -> DataFrame:
    """One row of ``docs`` for each component of similar texts: that of the smallest id, null ids last, and of repeated ids the first.

    Rows are told apart by a number that is written with them, so neither null nor repeated ids matter. All columns are kept,
    one of the number's name too.
    """
    taken = {c: f"{c}_of_docs{i}" for i, c in enumerate(docs.columns) if c.lower() == ROW}
    rows = cut(docs.withColumnsRenamed(taken).withColumn(ROW, F.monotonically_increasing_id()), "rows")
    return survivors(rows, similar(rows, shingle)).withColumnsRenamed({v: k for k, v in taken.items()})


def survivors(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The best row of each root of ``found(row, root)``, without its number."""
    i = F.col("doc_id").cast("long")
    best = rows.select(ROW, i.alias("doc_id")).join(found, ROW).groupBy("root").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", ROW)).alias("best"))
    return rows.join(best.select(F.col("best")[ROW].alias(ROW)), ROW, "left_semi").drop(ROW)


def op7_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
