"""How the sources of a language differ in their words: audit by dense term blocks.

Texts are read once. Each task counts the terms of the texts it holds by (lang, source), so
what is shuffled are counts and not words. Terms of too few documents of their language go;
the rest are dealt to blocks of a bounded number, and a task has one block of one language: a
dense int64 tile of counts, a row a group and a column a term. From it come the tile of
probabilities, the divergence of every two groups summed over the block's terms (all pairs at
once by broadcasting, some columns at a time), and each group's best terms as a heap of a
bounded size. Partial pair matrices are summed over the blocks and heaps merged.

All numbers are integers; probabilities, in units of 1e-9, are divided three decimal digits
at a time, so that nothing is rounded or overflows up to 9e15 occurrences.

Defined results: null text, lang and source are empty strings; every (lang, source) that
occurs is a group, also without terms; equal values are ranked by UTF-8; repeated rows and ids
count row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import bounded_batches, cut, held, table

#: Documents of its language that a term has to be in.
MIN_DOCS = 10
#: Ranks of terms that are reported.
TOP = 10
#: One in fixed-point probabilities, as a power of 1000.
SCALE_STEPS = 3
#: Cells of a tile (groups times terms); of a pair matrix, and of what is held while pairs are compared.
TILE_CELLS, PAIR_CELLS = 1 << 16, 1 << 20
#: Different (lang, source, term) that a task counts before it hands them on.
HELD_TERMS = 200_000
#: So many languages (a row of three numbers each) are sent to all tasks; more are joined by a shuffle.
BROADCAST_LANGS = 10_000
#: Bytes that separate terms become spaces; A-Z become a-z; bytes of other characters stay.
SEPARATORS = bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
TO_TERMS = bytes.maketrans(SEPARATORS + bytes(range(0x41, 0x5B)), b" " * len(SEPARATORS) + bytes(range(0x61, 0x7B)))


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(TO_TERMS).split()


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term, as each task has them; a row with null term says that the group is there."""
    schema = "lang string, source string, term string, n long, docs long"

    def flushed(groups: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            found = list(n)
            for i in range(0, len(found) + 1, 50_000):
                some = found[i : i + 50_000]
                rows = [None, *some] if i == 0 else some
                columns = [pa.array([lang] * len(rows)), pa.array([source] * len(rows)), pa.array([t and t.decode() for t in rows], pa.string()), pa.array([n[t] if t else 0 for t in rows], pa.int64()), pa.array([docs[t] if t else 0 for t in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(None, lambda: None)
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            lang, source = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for g, raw in zip(zip(lang, source, strict=True), batch.column(2).cast(pa.binary()), strict=True):
                n, docs = groups.setdefault(g, (Counter(), Counter()))
                here = Counter(terms(raw.as_py()))
                before = len(n)
                for t, c in here.items():
                    n[t] += c
                    docs[t] += 1
                size += len(n) - before
                if size > HELD_TERMS:
                    yield from flushed(groups)
                    groups, size = {}, 0
        yield from flushed(groups)

    bounded_batches(docs.sparkSession)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*named).mapInArrow(run, schema)


def kept_cells(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, term, n) of the terms that their language keeps, and a row with null term for each group."""
    cells = counted(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    every = cells.withColumn("docs", F.sum("docs").over(Window.partitionBy("lang", "term")))
    return every.filter((F.col("docs") >= min_docs) | F.isnull("term")).select("lang", "source", "term", "n")


def share(count: np.ndarray, total: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(1e9 * (count + 2) / (total + 2 v)), exact in int64."""
    whole = total + 2 * v
    q, r = np.divmod(count + 2, whole)
    for _ in range(SCALE_STEPS):
        d, r = np.divmod(r * 1000, whole)
        q = q * 1000 + d
    return q + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); probabilities are at most 1e9 + 1, so the square fits."""
    d = p - q
    return d * d // (p + q)


def pair_sums(some: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The divergence of each row of ``some`` and each of ``p``, summed over the columns; some rows and columns at a time."""
    g, t = p.shape
    out = np.zeros((len(some), g), np.int64)
    wide = max(1, min(t, PAIR_CELLS // g))
    tall = max(1, PAIR_CELLS // (g * wide))
    for at in range(0, t, wide):
        here = slice(at, at + wide)
        for i in range(0, len(some), tall):
            out[i : i + tall] += gap(some[i : i + tall, None, here], p[None, :, here]).sum(axis=2)
    return out


def tile_rows(groups: pa.Table, cells: pa.Table, top: int) -> pa.Table:
    """Of a block: (source, part, item, value) of the partial pair matrix and of the best terms, for the groups of the task's strip."""
    groups = groups.sort_by("source").combine_chunks()
    sources, total, v = groups.column("source").combine_chunks(), groups.column("total").to_numpy(), groups.column("v")[0].as_py()
    mine = np.flatnonzero(groups.column("mine").to_numpy())
    coded = cells.column("term").combine_chunks().dictionary_encode()
    names = coded.dictionary
    count = np.zeros((len(sources), len(names)), np.int64)
    np.add.at(count, (pc.index_in(cells.column("source").combine_chunks(), sources).to_numpy(), coded.indices.to_numpy()), cells.column("n").to_numpy())
    p, q = share(count, total[:, None], v), share(count.sum(axis=0), total.sum(), v)
    sums = pair_sums(p[mine], p)
    i, j = np.nonzero(mine[:, None] != np.arange(len(sources)))
    parts = [(sources.take(pa.array(mine[i])), "pair", sources.take(pa.array(j)), sums[i, j])]
    order = np.argsort(np.array([x.encode() for x in names.to_pylist()], object), kind="stable")  # ties go to the smaller UTF-8
    for k in mine:
        value = np.where((count[k] > 0) & (p[k] > q), gap(p[k], q), -1)[order]
        best = np.argsort(-value, kind="stable")[:top]
        best = best[value[best] >= 0]
        parts.append((pa.array([sources[k].as_py()] * len(best), pa.string()), "term", names.take(pa.array(order[best])), value[best]))
    return pa.concat_tables([pa.table([a, pa.array([part] * len(a), pa.string()), item, pa.array(x)], ["source", "part", "item", "value"]) for a, part, item, x in parts])


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, tile_cells: int = TILE_CELLS, pair_cells: int = PAIR_CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank): each group against the other sources of its language (``pair``) and its most telling terms (``term``)."""
    cells = cut(kept_cells(docs, min_docs), "cells")
    groups = cut(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), "groups", few_files=True)
    terms_of = cells.filter("term is not null").groupBy("lang", "term").agg(F.lit(1)).groupBy("lang").agg(F.count("*").alias("v"))
    # as many blocks of terms as keep a tile of all the language's groups within bounds, and strips of groups a pair matrix
    g, v = F.col("g"), F.col("v")
    langs = groups.groupBy("lang").agg(F.count("*").alias("g")).join(terms_of, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    least_one = lambda c: F.greatest(F.lit(1), F.ceil(c)).cast("int")
    langs = cut(langs.withColumns({"blocks": least_one(v * g / tile_cells), "strips": least_one(g * g / pair_cells)}), "langs", few_files=True)
    if langs.count() <= BROADCAST_LANGS:
        langs = F.broadcast(langs)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = ["lang", "block", "strip"]
    dealt = cells.filter("term is not null").join(langs.select("lang", "blocks", "strips"), "lang")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")).withColumn("strip", each("strips")).select(*at, "source", "term", "n")
    rows_of = groups.join(langs, "lang").withColumn("block", each("blocks")).withColumn("strip", each("strips"))
    rows_of = rows_of.select(*at, "source", "total", "v", (F.pmod(F.xxhash64("source"), F.col("strips")) == F.col("strip")).cast("int").alias("mine"))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        found = tile_rows(left, right, top)
        return found.add_column(0, "lang", pa.array([left.column("lang")[0].as_py()] * len(found), pa.string()))

    schema = "lang string, source string, part string, item string, value long"
    tiles = rows_of.groupBy(*at).cogroup(dealt.groupBy(*at)).applyInArrow(tile, schema)
    merged = tiles.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))  # a term is in one block
    ranked = merged.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = rf"""WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
words AS (SELECT r, lang, source, unnest(words) AS term FROM docs),
terms AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
sizes AS (SELECT lang, count(*) AS v FROM terms GROUP BY lang),
found AS (SELECT lang, source, term, count(*) AS n FROM words JOIN terms USING (lang, term) GROUP BY ALL),
sources AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM sources LEFT JOIN found USING (lang, source) GROUP BY ALL),
shares AS (SELECT lang, source, term, coalesce(n, 0) AS n, CAST(1 + 1000000000 * CAST(coalesce(n, 0) + 2 AS HUGEINT) // (total + 2 * v) AS HUGEINT) AS p
FROM totals JOIN terms USING (lang) JOIN sizes USING (lang) LEFT JOIN found USING (lang, source, term)),
lang_total AS (SELECT lang, sum(total) AS total FROM totals GROUP BY lang),
whole AS (SELECT lang, term, CAST(1 + 1000000000 * CAST(sum(n) + 2 AS HUGEINT) // (any_value(total) + 2 * any_value(v)) AS HUGEINT) AS q
FROM found JOIN sizes USING (lang) JOIN lang_total USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every_pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
best AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM every_pair UNION ALL SELECT * FROM best))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}"""
