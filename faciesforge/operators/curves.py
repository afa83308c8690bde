"""Curve vocabularies, summaries, statistics and identity decisions over header tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import headers as H
from ..functions.scoring import range_score

# Canonical mnemonic, unit, range of the median, range of the 95th percentile, largest share of negatives, largest share of zeros, log-skewed.
SIGNATURES = [
    ("GR", "GAPI", (0.0, 200.0), (0.0, 400.0), 0.02, 0.35, False),
    ("CALI", "IN", (4.0, 25.0), (4.0, 40.0), 0.01, None, False),
    ("DCAL", "IN", (-5.0, 10.0), (-10.0, 20.0), None, None, False),
    ("MCAL", "IN", (4.0, 25.0), (4.0, 40.0), None, None, False),
    ("RHOB", "G/CC", (1.6, 3.2), (1.3, 3.5), 0.001, None, False),
    ("DT", "US/FT", (35.0, 180.0), (20.0, 260.0), 0.01, None, False),
    ("RES", "OHM-M", (0.05, 5000.0), (0.05, 50000.0), 0.001, None, True),
]
# Units and the signatures they point to.
UNIT_FAMILIES = [(("GAPI", "CPS", "CPM"), ("GR",)), (("IN", "MM"), ("CALI", "DCAL", "MCAL")), (("G/CC", "KG/M3"), ("RHOB",)), (("US/FT", "US"), ("DT",)), (("OHM-M", "OHM", "MMHO/M", "MMHO"), ("RES",))]


def canonical(headers: DataFrame) -> DataFrame:
    """``headers(file, mnemonic, unit, descr)`` with ``mnemonic_n``, ``unit_n`` and ``canon_key``."""
    return headers.withColumn("mnemonic_n", H.norm_mnemonic(F.col("mnemonic"))).withColumn("unit_n", H.norm_unit(F.col("unit"))).withColumn("canon_key", F.concat_ws("|", "mnemonic_n", "unit_n"))


def vocabulary(headers: DataFrame, mnemonic: str = "mnemonic", unit: str = "unit") -> DataFrame:
    """How often each (mnemonic, unit) occurs; nulls are a value of their own."""
    return headers.groupBy(F.col(mnemonic).alias("mnemonic"), F.col(unit).alias("unit")).agg(F.count("*").alias("n"))


def file_summary(canon: DataFrame) -> DataFrame:
    """Curves, different canonical mnemonics and the sorted keys of each file."""
    return canon.groupBy("file").agg(F.count("*").alias("n_curves"), F.countDistinct("mnemonic_n").alias("n_unique_canon"), F.array_join(F.array_sort(F.collect_set("canon_key")), " ").alias("canon_keys"))


def quarantine(canon: DataFrame) -> DataFrame:
    """A row for each hit, with the rank that orders a report."""
    hit = F.explode(H.quarantine_hits(F.col("mnemonic_n"), F.col("unit_n"), F.col("descr"))).alias("hit")
    return canon.select("file", "mnemonic_n", "unit_n", hit).select("file", "mnemonic_n", "unit_n", "hit.severity", "hit.reason", H.severity_rank(F.col("hit.severity")).alias("severity_rank"))


def statistics(values: DataFrame, by: list[str]) -> DataFrame:
    """Exact statistics of ``value``: counts, range, spread, shares of zero, negative and missing values, percentiles.

    Percentiles are exact over all rows: what a reservoir would estimate.
    """
    v, share = F.col("value"), lambda c: F.avg(F.when(F.col("value").isNotNull(), c.cast("double")))
    p = lambda q: F.percentile("value", q)
    return values.groupBy(*by).agg(
        F.count("*").alias("n"), F.count(v).alias("n_finite"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.var_pop(v).alias("var"),
        share(v == 0).alias("frac_zero"), share(v < 0).alias("frac_neg"), F.avg(v.isNull().cast("double")).alias("frac_nan"),
        p(0.01).alias("p01"), p(0.05).alias("p05"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"),
    )


def _capped(share: Column, most: float | None) -> Column:
    return F.lit(1.0) if most is None else F.when(share <= most, 1.0).otherwise(F.exp(-2.0 * (share - most) / most))


def signature_score(sig: tuple) -> Column:
    """How well statistics fit a signature, 0 to 1."""
    _, _, mid, high, neg, zero, skewed = sig
    score = 0.45 * range_score(F.col("p50"), *mid) + 0.35 * range_score(F.col("p95"), *high)
    if skewed:
        ratio = (F.col("p99") + 1e-9) / (F.col("p50") + 1e-9)
        score = score + F.when((F.col("p50") > 0) & (F.col("p99") > 0), F.least(F.lit(0.1), F.greatest(F.lit(0.0), (F.log10(ratio) - 0.5) / 2 * 0.1))).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score * _capped(F.col("frac_neg"), neg) * _capped(F.col("frac_zero"), zero)))


def identity(stats: DataFrame) -> DataFrame:
    """``stats`` (with ``mnemonic_n``, ``unit_n``) with inferred mnemonic and unit, confidence, basis and decision."""
    unit, name = F.col("unit_n"), F.col("mnemonic_n")
    fit = {s[0]: signature_score(s) for s in SIGNATURES}
    on_unit = {s[0]: F.when(unit == "", 0.6).when(unit == s[1], 1.0).otherwise(0.2) for s in SIGNATURES}
    pick = lambda score, s: F.struct(score.alias("score"), F.lit(-[x[0] for x in SIGNATURES].index(s)).alias("place"), F.lit(s).alias("m"), F.lit(next(x[1] for x in SIGNATURES if x[0] == s)).alias("u"))
    out = stats.withColumn("by_value", F.greatest(*[pick(fit[s[0]], s[0]) for s in SIGNATURES]))
    family = lambda names: F.greatest(*[pick(0.8 * fit[n] + 0.2 * on_unit[n], n) for n in names]) if len(names) > 1 else pick(0.8 * fit[names[0]] + 0.2 * on_unit[names[0]], names[0])
    out = out.withColumn("by_unit", F.coalesce(*[F.when(unit.isin(*units), family(names)) for units, names in UNIT_FAMILIES]))
    out = out.withColumn("by_name", F.coalesce(*[F.when(name == s[0], pick(0.75 * fit[s[0]] + 0.25 * on_unit[s[0]], s[0])) for s in SIGNATURES if s[0] != "RES"]))
    unit_wins = F.coalesce(F.col("by_unit.score") > F.col("by_value.score") + 0.05, F.lit(False))
    first = F.when(unit_wins, F.col("by_unit")).otherwise(F.col("by_value"))
    name_wins = F.coalesce(F.col("by_name.score") >= first["score"] - 0.02, F.lit(False))
    known = (F.col("n_finite") >= 20) & (F.col("var") > 0)
    conf = F.when(known, F.greatest(first["score"], F.when(name_wins, F.col("by_name.score")))).otherwise(0.0)
    best = F.when(name_wins, F.col("by_name")).otherwise(first)
    basis = F.when(~known, "no_stats").when(name_wins, "mnemonic_values").when(unit_wins, "unit_values").otherwise("values_only")
    decision = F.when(conf >= 0.85, "AUTO_FIX").when(conf >= 0.6, "SUGGEST").otherwise("NO_ACTION")
    keep = [c for c in stats.columns]
    return out.select(*keep, F.when(known, best["m"]).otherwise(name).alias("inferred_mnemonic"), F.when(known, best["u"]).otherwise(unit).alias("inferred_unit"), conf.alias("confidence"), basis.alias("basis"), F.when(known, decision).otherwise("NO_ACTION").alias("decision"))


def best_confidence(decisions: DataFrame) -> DataFrame:
    """Of several decisions for one (file, mnemonic, unit) the most confident."""
    keys = ["file", "mnemonic_n", "unit_n"]
    rest = [F.col(c) for c in decisions.columns if c not in keys]
    return decisions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "confidence").alias("d")).select(*keys, "d.*")


def keep_status(rows: DataFrame, least: int = 200) -> DataFrame:
    """``status``: the first check that a row fails, in order, else OK; from boolean columns and a count."""
    c = F.col
    status = (
        F.when(~c("exists"), "MISSING_LAS").when(c("too_large"), "SKIP_TOO_LARGE").when(~c("header_ok"), "HEADER_FAIL").when(~c("has_depth"), "NO_DEPTH")
        .when(~c("has_gr"), "NO_GR").when(~c("stream_ok"), "STREAM_FAIL").when(c("n_finite") < least, "INSUFFICIENT_GR").otherwise("OK")
    )
    return rows.withColumn("status", status)


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))
