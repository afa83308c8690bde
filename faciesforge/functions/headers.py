"""Curve mnemonics, units and identifiers as Column expressions.

All of it is built-in functions, so that it stays inside generated code; alias tables are
map literals of a fixed size.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical mnemonic and the spellings that stand for it.
MNEMONICS = {
    "DEPT": ["DEPTH", "DPTH", "DEPT"],
    "MD": ["MD"],
    "TVD": ["TVD"],
    "GR": ["GAM", "GAMMA", "GAMMARAY", "GAMMA_RAY", "GAMMA-RAY", "CGR", "SGR", "GR"],
    "SP": ["SP"],
    "RHOB": ["RHOB", "DEN", "RHO", "RHOZ", "ZDEN"],
    "RHOC": ["RHOC"],
    "DRHO": ["DRHO"],
    "NPHI": ["NPHI", "TNPH", "TNPHI"],
    "NPOR": ["NPOR"],
    "CNPOR": ["CNPOR"],
    "DPHI": ["DPHI", "PHID", "PHIE"],
    "DPOR": ["DPOR"],
    "SPOR": ["SPOR"],
    "CALI": ["CALI", "CALIPER"],
    "DCAL": ["DCAL"],
    "MCAL": ["MCAL"],
    "DT": ["DT"],
    "DTC": ["DTC", "DTCO"],
    "DTS": ["DTS"],
    "PE": ["PE", "PEF"],
}
# Mnemonics that stand for themselves.
PLAIN_MNEMONICS = ["ILD", "ILM", "LLD", "LLS", "RILD", "RILM", "RLL3", "RT", "RXO", "RXRT", "RXORT", "CILD", "CILM", "CLL3"]
# Canonical unit and the spellings that stand for it.
UNITS = {
    "FT": ["F", "FT", "FEET"],
    "M": ["M", "METERS", "METRES"],
    "GAPI": ["GAPI", "API", "API-GR"],
    "CPS": ["CPS"],
    "CPM": ["CPM"],
    "MV": ["MV", "MILLIVOLTS"],
    "V": ["V"],
    "G/CC": ["G/CC", "GM/CC", "G/C3", "GM/C3", "G/CM3", "GM/CM3"],
    "KG/M3": ["KG/M3"],
    "US/FT": ["USEC/FT", "US/FT", "US/F"],
    "US": ["USEC", "US"],
    "IN": ["IN", "INCH", "INCHES"],
    "MM": ["MM"],
    "OHM-M": ["OHM-M", "OHMM", "OHM/M", "OHM.M"],
    "OHM": ["OHMS", "OHM"],
    "MMHO/M": ["MMHO/M", "MMHOS/M", "MMHO-M"],
    "MMHO": ["MMHO"],
    "PU": ["PU", "PERC", "PERCENT", "%", "V/V", "VV", "FRAC", "DEC", "DECP", "CFCF"],
    "": ["NONE"],
}
# Units that a mnemonic may have.
ALLOWED_UNITS = {
    "DEPT": ["FT", "M", ""],
    "MD": ["FT", "M", ""],
    "TVD": ["FT", "M", ""],
    "GR": ["GAPI", "CPS", "CPM", ""],
    "SP": ["MV", "V", ""],
    "RHOB": ["G/CC", "KG/M3", ""],
    "RHOC": ["G/CC", "KG/M3", ""],
    "DRHO": ["G/CC", "KG/M3", ""],
    "DT": ["US/FT", ""],
    "DTC": ["US/FT", ""],
    "DTS": ["US/FT", ""],
    "CALI": ["IN", "MM", ""],
    "DCAL": ["IN", "MM", ""],
    "MCAL": ["IN", "MM", ""],
    "PE": [""],
    "NPHI": ["PU", ""],
    "NPOR": ["PU", ""],
    "CNPOR": ["PU", ""],
    "DPHI": ["PU", ""],
    "DPOR": ["PU", ""],
    "SPOR": ["PU", ""],
    "ILD": ["OHM-M", "OHM", ""],
    "ILM": ["OHM-M", "OHM", ""],
    "LLD": ["OHM-M", "OHM", ""],
    "LLS": ["OHM-M", "OHM", ""],
    "RILD": ["OHM-M", "OHM", ""],
    "RILM": ["OHM-M", "OHM", ""],
    "RLL3": ["OHM-M", "OHM", ""],
    "RT": ["OHM-M", "OHM", ""],
    "RXO": ["OHM-M", "OHM", ""],
    "RXRT": ["OHM-M", "OHM", ""],
    "RXORT": ["OHM-M", "OHM", ""],
    "CILD": ["MMHO/M", "MMHO", ""],
    "CILM": ["MMHO/M", "MMHO", ""],
    "CLL3": ["MMHO/M", "MMHO", ""],
}
# Mnemonic and unit that cannot go together.
IMPOSSIBLE = [("DCAL", "GAPI"), ("MCAL", "GAPI"), ("CALI", "GAPI"), ("DEPT", "GAPI"), ("DEPT", "MV"), ("GR", "IN"), ("GR", "OHM-M")]
# Reasons of the rules that put curves in quarantine (a mnemonic, a unit where they stand).
IMPOSSIBLE_REASON = "Impossible mnemonic+unit: {} with {}"
NOT_ALLOWED_REASON = "Unit not allowed for mnemonic: {} has {}"
UNKNOWN_REASON = "Unknown mnemonic"
GAMMA_REASON = "Gamma ray curve carrying resistivity/caliper units."
CALIPER_REASON = "Caliper mnemonic but description suggests gamma ray."
# Texts that mean no number.
NO_NUMBER = ["", "NA", "N/A", "NULL", "NONE", "NAN"]

ALIAS_OF = {a: m for m, aliases in MNEMONICS.items() for a in aliases} | {m: m for m in PLAIN_MNEMONICS}
UNIT_OF = {a: u for u, aliases in UNITS.items() for a in aliases}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _cleaned(c: Column, bad: str) -> Column:
    return F.regexp_replace(F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")), bad, "")


def norm_mnemonic(c: Column) -> Column:
    """White space and stray characters out, upper case, ``:1`` suffix off, aliases to canonical; null to ''."""
    token = F.regexp_replace(_cleaned(c, r"[^A-Z0-9_:/\-]+"), r":\d+$", "")
    return F.coalesce(F.try_element_at(_map(ALIAS_OF), token), token)


def norm_unit(c: Column) -> Column:
    r"""As ``norm_mnemonic`` with ``\`` to ``/`` and ``% . /`` kept."""
    token = F.regexp_replace(F.translate(F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")), "\\", "/"), r"[^A-Z0-9_/.\-%]+", "")
    return F.coalesce(F.try_element_at(_map(UNIT_OF), token), token)


def canon_key(mnemonic: Column, unit: Column) -> Column:
    return F.concat(norm_mnemonic(mnemonic), F.lit("|"), norm_unit(unit))


def aliases_for(canonical: str) -> list[str]:
    """The canonical mnemonic first, then its other spellings in order."""
    rest = [a for a in MNEMONICS.get(canonical, []) if a != canonical]
    return [canonical, *rest]


def qc_mnemonic(c: Column) -> Column:
    """``norm_mnemonic`` as the header check has it, which knows letters, digits and ``_ / . -`` alone: the colon of ``GR:1`` goes and its 1 stays."""
    token = F.regexp_replace(_cleaned(c, r"[^A-Z0-9_/.\-]+"), r":\d+$", "")
    return F.coalesce(F.try_element_at(_map(ALIAS_OF), token), token)


def qc_unit(c: Column) -> Column:
    """``norm_unit`` as the header check has it: ``%`` goes before aliases are looked up."""
    token = _cleaned(c, r"[^A-Z0-9_/.\-]+")
    return F.coalesce(F.try_element_at(_map(UNIT_OF), token), token)


def qc_key(mnemonic: Column, unit: Column) -> Column:
    return F.concat(qc_mnemonic(mnemonic), F.lit("|"), qc_unit(unit))


def raw_for(mnemonics: Column, canonical: str) -> Column:
    """The raw mnemonic for a canonical one: that of the same name, else one without a suffix, else the shortest, else the first."""
    ranked = F.filter(F.transform(mnemonics, lambda m, i: F.struct((F.upper(F.trim(m)) != canonical).alias("other"), m.contains(":").alias("suffix"), F.length(F.trim(m)).alias("n"), i.alias("i"), m.alias("m"), norm_mnemonic(m).alias("c"))), lambda s: s["c"] == canonical)
    return F.array_min(ranked)["m"]


def raw_preferred(mnemonics: Column, preferred: list[str]) -> Column:
    """``raw_for`` the first of the preferred names that is there."""
    return F.coalesce(*[raw_for(mnemonics, canonical_name(p)) for p in preferred])


def raw_in_family(mnemonics: Column, canonical: str) -> Column:
    """The first raw mnemonic of the first family member, in the family's order, that is there."""
    names = list(dict.fromkeys(canonical_name(a) for a in aliases_for(canonical_name(canonical))))
    first = lambda n: F.get(F.filter(mnemonics, lambda m: norm_mnemonic(m) == n), 0)
    return F.coalesce(*map(first, names))


def all_in_family(mnemonics: Column, canonical: str) -> Column:
    """Every raw mnemonic whose canonical name is one of the family's."""
    names = list(dict.fromkeys(canonical_name(a) for a in aliases_for(canonical_name(canonical))))
    return F.filter(mnemonics, lambda m: norm_mnemonic(m).isin(names))


def column_for(mnemonics: Column, wanted: str) -> Column:
    """Position (from 0) of a curve, null if there is none: the same name; the only one of its canonical name; of the family
    the one that begins with the name, else the first; any that begins with the name."""
    bare, name = re.sub(r"\s+", "", wanted).upper(), canonical_name(wanted)
    family = list(dict.fromkeys(canonical_name(a) for a in aliases_for(name)))
    raw = F.transform(mnemonics, lambda m: F.upper(F.regexp_replace(m, r"\s+", "")))
    first = lambda test: F.array_min(F.filter(F.transform(raw, lambda m, i: F.when(test(m), i)), lambda i: i.isNotNull()))
    same = F.filter(F.transform(raw, lambda m, i: F.when(norm_mnemonic(m) == name, i)), lambda i: i.isNotNull())
    kin = lambda m: norm_mnemonic(m).isin(family)
    return F.coalesce(first(lambda m: m == bare), F.when(F.size(same) == 1, F.array_min(same)), first(lambda m: kin(m) & m.startswith(bare)), first(kin), first(lambda m: m.startswith(bare)))


def canonical_name(text: str) -> str:
    """``norm_mnemonic`` of a Python text."""
    token = re.sub(r":\d+$", "", re.sub(r"[^A-Z0-9_:/\-]+", "", re.sub(r"\s+", "", text).upper()))
    return ALIAS_OF.get(token, token)


def url_to_path(url: Column, root: str) -> Column:
    """The place of a URL's file under a folder; null for a URL without a file name."""
    name = F.trim(basename(F.coalesce(url, F.lit(""))))
    return F.when(name != "", F.concat(F.lit(root.rstrip("/") + "/"), name))


def cache_key(path: Column, n: int) -> Column:
    """A name for a file's stored vector: base name, length and 8 hex digits of the path's md5."""
    return F.concat(stem(path), F.lit(f"_{n}_"), F.substring(F.md5(path), 1, 8))


def has_depth_axis(mnemonics: Column) -> Column:
    """Whether an array of raw mnemonics holds a depth curve."""
    return F.exists(mnemonics, lambda m: norm_mnemonic(m).isin("DEPT", "DEPTH", "MD"))


def resolve_curve(mnemonics: Column, wanted: list[str], exact_first: bool = True) -> Column:
    """Position (from 0) of the first curve that matches, in the order of ``wanted``; -1 if none does."""
    tries = []
    for name in wanted:
        if exact_first:
            tries.append(F.array_position(F.transform(mnemonics, lambda m: F.upper(F.trim(m))), name))
        tries.append(F.array_position(F.transform(mnemonics, norm_mnemonic), name))
    return F.coalesce(*[F.when(t > 0, t) for t in tries], F.lit(0)).cast("int") - 1


def to_float(c: Column) -> Column:
    """Trimmed text to a finite double: thousands commas go; blanks, NA words and nan are null."""
    text = F.trim(c)
    number = F.regexp_replace(text, ",", "").try_cast("double")
    return F.when(~F.upper(text).isin(NO_NUMBER) & ~F.isnan(number), number)


def api_nodash(api: Column, explicit: Column) -> Column:
    given = F.trim(F.coalesce(explicit, F.lit("")))
    return F.when(given != "", given).otherwise(F.regexp_replace(F.coalesce(api, F.lit("")), r"[^0-9]", ""))


def stable_hash32(c: Column) -> Column:
    """The first 8 hex digits of md5 as an unsigned 32-bit integer."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")


def basename(url: Column) -> Column:
    """The last path segment of a URL, without query and fragment."""
    return F.element_at(F.split(F.regexp_replace(F.trim(url), r"[?#].*$", ""), "/"), -1)


def select_well_id(nodash: Column, api: Column, kgs_id: Column, url: Column, lat: Column, lon: Column) -> Column:
    """The first identifier at hand; of a row without any, a hash of its place."""
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    place = F.concat(F.lit("xy"), stable_hash32(F.format_string("%.6f_%.6f", lat, lon)).cast("string"))
    return F.coalesce(some(nodash), some(api), some(kgs_id), some(F.regexp_replace(basename(url), r"\.[^.]*$", "")), place)


def stem(path: Column) -> Column:
    """A path's file name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def file_key(path: Column) -> Column:
    """Cleaned base name and ten hex digits of the path's sha1."""
    return F.concat(F.regexp_replace(stem(path), r"[^A-Za-z0-9._-]+", "_"), F.lit("_"), F.substring(F.sha1(path), 1, 10))


def allowed_units(mnemonic: Column) -> Column:
    """The units that a canonical mnemonic may have; null for one without a list."""
    table = F.create_map(*[x for m, units in ALLOWED_UNITS.items() for x in (F.lit(m), F.array(*[F.lit(u) for u in units]))])
    return F.try_element_at(table, mnemonic)


def quarantine_hits(mnemonic: Column, unit: Column, descr: Column) -> Column:
    """Array of (severity, reason) for a canonical mnemonic and unit: none, one or several."""
    hit = lambda when, severity, reason: F.when(when, F.struct(F.lit(severity).alias("severity"), reason.alias("reason")))
    told = lambda text: F.format_string(text.replace("{}", "%s"), mnemonic, unit)
    impossible = reduce(lambda a, b: a | b, [(mnemonic == m) & (unit == u) for m, u in IMPOSSIBLE])
    allowed, text = allowed_units(mnemonic), F.lower(F.trim(F.coalesce(descr, F.lit(""))))
    hits = F.array(
        hit(impossible, "ERROR", told(IMPOSSIBLE_REASON)),
        hit(allowed.isNotNull() & ~F.array_contains(allowed, unit), "WARN", told(NOT_ALLOWED_REASON)),
        hit(allowed.isNull(), "INFO", F.lit(UNKNOWN_REASON)),
        hit((mnemonic == "GR") & unit.isin("OHM-M", "IN"), "ERROR", F.lit(GAMMA_REASON)),
        hit(mnemonic.isin("CALI", "DCAL", "MCAL") & (text.contains("gamma") | text.contains("gr")) & (unit == "GAPI"), "ERROR", F.lit(CALIPER_REASON)),
    )
    return F.filter(hits, lambda h: h.isNotNull())


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "ERROR", 0).when(severity == "WARN", 1).when(severity == "INFO", 2).otherwise(9)
