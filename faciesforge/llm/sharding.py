"""Sharding by sampled splitters.

Records are ordered by a key (hash of the text, id, row number), so equal texts stand
together and the order has nothing to do with how the input was dealt. A sample of keys,
drawn in proportion to each record's share of bytes and rows, gives quantile boundaries for
many more ranges than shards. Exact counts then show which ranges are overfull, and those
are subdivided by samples of their own until none is, and those of more records than a task
should order once more. Ranges in key order, with their exact bytes and rows, give each record
its exact place in the whole, and the place gives the shard: by bytes (law ``bytes``: sizes differ by one record at most) or by count (law
``rows``). A group of equal texts that a boundary between shards of law ``bytes`` falls into goes
to the side with more of it, unless it holds over a hundredth of a shard's bytes; a larger one
is cut there. Ranges cut any group, so no task gets more than a range.

Everything is DataFrame functions. The texts are read once, to a written table of keys and
sizes; what reaches the driver are samples and totals of a fixed number of first ranges.

Defined results: a null text has size 1 and no checksum, and counts as a text of its own
for grouping; repeated rows and repeated or null ids are placed row by row; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import cut, table

SHARDS = 16
#: Ranges aimed at, sampled keys for each, and how many times the mean makes a range overfull.
RANGES, SAMPLES, OVERFULL = 1024, 16, 2.0
#: Records of a range; ranges of more are cut again by splitters of their own, so that no task orders many more.
RANGE_ROWS = 1_000_000
#: Rounds of subdivision; each makes an overfull range smaller many times over.
ROUNDS = 8
KEY = ("h", "doc_id", "row")
#: What equal texts share, and the share of a shard's bytes up to which a group of them is not cut between shards.
GROUP, CUT_SHARE = ("h", "size", "text_crc32"), 0.01


def keyed(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, h, row): what placing needs of each record."""
    raw = F.col("text").cast("binary")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64("text").alias("h"),
        (F.monotonically_increasing_id() if row is None else row).alias("row"),
    )


def key() -> Column:
    return F.struct(*KEY)


def _structs(names: tuple[str, ...], rows: list[tuple]) -> str:
    """SQL for an array of structs of longs; one text is planned far faster than its parts as columns."""
    cell = lambda v: "CAST(NULL AS BIGINT)" if v is None else f"CAST('{v}' AS BIGINT)"
    return "array(" + ",".join("named_struct(" + ",".join(f"'{n}',{cell(v)}" for n, v in zip(names, r, strict=True)) + ")" for r in rows) + ")"


def range_of(splitters: list[tuple]) -> Column:
    """The number of splitters that are not above the key, found in two steps over blocks of them."""
    if not splitters:
        return F.lit(0)
    step = max(1, int(len(splitters) ** 0.5))
    blocks = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    at_or_below = lambda a: F.size(F.filter(a, lambda s: s <= key()))
    block = at_or_below(F.expr(_structs(KEY, [b[0] for b in blocks])))
    inner = F.expr("array(" + ",".join(_structs(KEY, b) for b in blocks) + ")")
    return F.when(block == 0, 0).otherwise((block - 1) * step + at_or_below(F.element_at(inner, F.greatest(block, F.lit(1))))).cast("int")


def _drawn(rows: DataFrame, weight: Column, seed: int) -> DataFrame:
    """Keys with the whole number of times that each is drawn; ``weight`` is the expected number."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *KEY), 11) / F.lit(float(1 << 53))
    return rows.withColumn("times", F.floor(weight + u)).filter("times > 0")


def _quantiles(drawn: list[tuple[tuple, int]], parts: int) -> list[tuple]:
    """Up to ``parts - 1`` different boundaries of equal shares of the drawn keys."""
    low = lambda k: tuple((v is not None, v or 0) for v in k)  # noqa: E731  nulls come first, as in Spark
    drawn = sorted(drawn, key=lambda d: low(d[0]))
    total, run, out = sum(t for _, t in drawn), 0, []
    for k, t in drawn:
        if run > 0 and run * parts >= (len(out) + 1) * total and len(out) < parts - 1:
            out.append(k)
        run += t
    return list(dict.fromkeys(out))


def splitters(rows: DataFrame, total_rows: int, total_bytes: int, ranges: int = RANGES) -> list[tuple]:
    """Boundaries between ranges none of which holds much more than its share of bytes or of rows."""
    share = 0.5 * F.col("size") / float(total_bytes) + F.lit(0.5 / total_rows)
    draw = lambda frame, weight, seed: [(tuple(r[c] for c in KEY), r["times"]) for r in _drawn(frame, weight, seed).select(*KEY, "times").collect()]
    ranges = max(1, min(ranges, total_rows))
    bounds = _quantiles(draw(rows, share * float(ranges * SAMPLES), 1), ranges)
    for seed in range(2, ROUNDS + 2):
        dealt = rows.withColumn("range", range_of(bounds))
        load = F.greatest(F.sum("size") / float(total_bytes), F.count("*") / float(total_rows)) * float(ranges)
        over = {r["range"]: r["load"] for r in dealt.groupBy("range").agg(load.alias("load"), F.count("*").alias("n")).filter((F.col("load") > OVERFULL) & (F.col("n") > 1)).collect()}
        if not over:
            break
        drawn = dealt.filter(F.col("range").isin(sorted(over)))
        found: dict[int, list] = {}
        for r in _drawn(drawn, share * float(ranges * SAMPLES), seed).select(*KEY, "times", "range").collect():
            found.setdefault(r["range"], []).append((tuple(r[c] for c in KEY), r["times"]))
        more = [k for at, keys in found.items() for k in _quantiles(keys, int(over[at]) + 1)]
        low = lambda k: tuple((v is not None, v or 0) for v in k)
        grown = sorted({*bounds, *more}, key=low)
        if grown == bounds:
            break  # what is left is single records
        bounds = grown
    return bounds


def assign(rows: DataFrame, shards: int = SHARDS, law: str = "bytes", ranges: int = RANGES, keep_groups: bool = True) -> DataFrame:
    """``rows`` (a written table from ``keyed``) with ``shard`` and ``slot``."""
    if law not in ("bytes", "rows"):
        raise ValueError(f"no law {law!r}")
    n, size = rows.agg(F.count("*"), F.sum("size")).first()
    if not n:
        return rows.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    bounds = splitters(rows, n, size, ranges)
    weight, total = (F.col("size"), size) if law == "bytes" else (F.lit(1).cast("long"), n)
    dealt = subdivided(rows.withColumn("range", range_of(bounds)).withColumn("weight", weight))
    # what stands before each range: a row for each of them, far fewer than records
    order = Window.orderBy("range", "sub")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("range", "sub").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    nothing = F.lit(0).cast("long")
    totals = cut(totals.withColumn("rows_before", F.coalesce(F.sum("n").over(upto), nothing)).withColumn("weight_before", F.coalesce(F.sum("w").over(upto), nothing)), "ranges", few_files=True)
    inner = Window.partitionBy("range", "sub").orderBy(*KEY)
    ahead = F.coalesce(F.sum("weight").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the shard that the record's middle falls into, so that the share each gets is off by half a record at either end
    middle = F.col("weight_before") + F.col("ahead") + F.floor((F.col("weight") - F.lit(1)) / 2).cast("long")
    shard = F.least(F.floor(middle * shards / F.lit(total)), F.lit(shards - 1)).cast("int")

    def placed(frame: DataFrame) -> DataFrame:
        out = frame.withColumn("ahead", ahead).withColumn("inner", F.row_number().over(inner) - 1)
        out = out.join(totals.select("range", "sub", "rows_before", "weight_before"), ["range", "sub"])
        return out.withColumn("place", F.col("inner") + F.col("rows_before")).withColumn("shard", shard)

    # shards begin in ranges across which the share changes, or next to them
    share = lambda w: F.floor(w * shards / F.lit(total))
    crosses = share(F.col("weight_before")) != share(F.col("weight_before") + F.col("w"))
    marked = totals.withColumn("crosses", crosses | (F.col("rows_before") == 0))
    beside = F.coalesce(F.lag("crosses").over(order), F.lit(False)) | F.coalesce(F.lead("crosses").over(order), F.lit(False))
    near = marked.withColumn("beside", beside).filter("crosses or beside").select("range", "sub")  # three for each shard at most
    first = placed(dealt.join(F.broadcast(near), ["range", "sub"], "left_semi")).groupBy("shard").agg(F.min_by(F.struct("place", *GROUP), "place").alias("r")).select("shard", "r.*").collect()
    start = {r["shard"]: r["place"] for r in first}
    if keep_groups and law == "bytes":
        start = whole_groups(start, [r for r in first if r["shard"] > 0], dealt, placed, total / shards * CUT_SHARE)
    for s in reversed(range(shards)):  # a shard without records begins where the next one does
        start.setdefault(s, start.get(s + 1, n))
    starts = F.array(*[F.lit(start[s]).cast("long") for s in range(shards)])
    own = F.size(F.filter(starts, lambda s: s <= F.col("place"))) - 1
    return placed(dealt).drop("shard").withColumn("shard", own.cast("int")).withColumn("slot", (F.col("place") - F.element_at(starts, F.col("shard") + 1)).cast("long")).select(*rows.columns, "shard", "slot")


def whole_groups(start: dict[int, int], first: list, dealt: DataFrame, placed: Callable[[DataFrame], DataFrame], most: float) -> dict[int, int]:
    """First places of shards, moved to the nearer end of the group of equal texts that they fall into, if it weighs at most ``most``.

    ``first`` are the first records of shards, so there is a group to look at for each shard at most.
    """
    hashes = F.col("h").isin(sorted({r["h"] for r in first}))
    ranges = dealt.filter(hashes).select("range", "sub").distinct()
    groups = placed(dealt.join(ranges, ["range", "sub"], "left_semi")).filter(hashes).groupBy(*GROUP).agg(F.min("place").alias("a"), F.max("place").alias("b"), F.sum("weight").alias("w"), F.count("*").alias("n"))
    found = {tuple(r[c] for c in GROUP): r for r in groups.collect()}
    out = dict(start)
    for r in first:
        g = found[tuple(r[c] for c in GROUP)]
        # equal texts stand together, unless another text has the same hash
        if g["a"] < r["place"] and g["w"] <= most and g["b"] - g["a"] + 1 == g["n"]:
            out[r["shard"]] = g["a"] if r["place"] - g["a"] <= g["b"] + 1 - r["place"] else g["b"] + 1
    return out


def subdivided(dealt: DataFrame) -> DataFrame:
    """``dealt`` with ``sub``: ranges of more than ``RANGE_ROWS`` records are cut at sampled splitters of their own, however many it takes.

    The splitters of a range are one row of a table that has a row a range, so its size follows the number of ranges asked for.
    """
    held = {r["range"]: r["n"] for r in dealt.groupBy("range").agg(F.count("*").alias("n")).collect()}  # the ranges of ``splitters``
    parts = {k: -(-n // RANGE_ROWS) for k, n in held.items() if n > RANGE_ROWS}
    if not parts:
        return dealt.withColumn("sub", F.lit(0))
    spark = dealt.sparkSession
    asked = spark.createDataFrame([(k, int(p), p * SAMPLES / held[k]) for k, p in sorted(parts.items())], "range int, parts int, chance double")
    drawn = _drawn(dealt.join(F.broadcast(asked), "range"), F.col("chance"), 77)
    keys = drawn.groupBy("range", "parts").agg(F.array_sort(F.collect_list(key())).alias("keys"))  # SAMPLES for each part, about
    at = F.transform(F.sequence(F.lit(1), F.col("parts") - 1), lambda i: F.element_at("keys", F.greatest(F.lit(1), F.floor(i * F.size("keys") / F.col("parts")).cast("int"))))
    cuts = cut(keys.select("range", F.array_distinct(at).alias("cuts")), "cuts", few_files=True)
    here = dealt.join(cuts, "range", "left")
    return here.withColumn("sub", F.coalesce(F.size(F.filter("cuts", lambda c: c <= key())), F.lit(0))).drop("cuts")


def shard_documents(docs: DataFrame, shards: int = SHARDS, law: str = "bytes") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of ``docs(doc_id, text)``."""
    return assign(cut(keyed(docs), "keys"), shards, law).drop("h", "row")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, law: str = "bytes") -> None:
    """Write all columns of ``docs`` with ``shard`` and ``slot`` to one folder a shard, each in many files."""
    clash = [c for c in docs.columns if c.lower() in ("shard", "slot")]
    if clash:
        raise ValueError(f"columns {clash} are taken by the shards")
    number = "__row"
    while number in {c.lower() for c in docs.columns}:
        number += "_"
    kept = cut(docs.withColumn(number, F.monotonically_increasing_id()), "documents")
    found = assign(cut(keyed(kept, F.col(number)), "keys"), shards, law)
    kept.join(found.select(F.col("row").alias(number), "shard", "slot"), number).drop(number).write.partitionBy("shard").parquet(path)


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    found = shard_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
