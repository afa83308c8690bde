"""Fill-in-middle by escaped marker injection.

A text is a row of units (a run of A-Z and a-z, or any other single code point). A delimiter
that the text may hold itself is escaped first; then ``regexp_replace`` appends the bare
delimiter after every unit, so that counting delimiters counts units and ``substring_index``
gives the first or the last k units. The three parts are unescaped and put together again
around the markers; ``restored`` undoes that from output and form alone. All of it is
functions of one row: there is no shuffle, and no key can be hot.

Where a text is cut depends on its id and the seed only (SHA-256 of ``seed:id``), so rows can
be dealt in any way and a lost task gives the same rows again.

Defined results: a null text is the empty text; a text that is empty or holds a marker stays
plain; a null id is hashed as if it had no digits; repeated rows are answered row by row; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import table

#: Markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: The delimiter, the escape character, and what they become: an escape character and a digit.
DELIMITER, ESCAPE = "\u0001", "\u0002"
ESCAPED = {ESCAPE: ESCAPE + "0", DELIMITER: ESCAPE + "1"}
#: A unit of an escaped text: an escape sequence is one, as what it stands for is no letter.
ESCAPED_UNIT = f"[A-Za-z]+|{ESCAPE}[01]|[^A-Za-z]"
#: Out of a hundred texts so many are rearranged, and of those so many begin with the suffix.
RATE, SUFFIX_FIRST = 90, 20


def escaped(text: Column) -> Column:
    for plain, code in ESCAPED.items():
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPED.items()):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def draws(doc_id: Column, seed: int) -> list[Column]:
    """The first four groups of eight hexadecimal digits as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("long").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def assembled(form: Column, prefix: Column, middle: Column, suffix: Column, plain: Column) -> Column:
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "plain", plain).when(form == "psm", psm).otherwise(spm)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. No part holds a marker, nor can a cut beside one make another."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    after = lambda mark: F.substring_index(head, mark, -1)
    between = lambda first, then: F.substring_index(F.substring_index(head, first, -1), then, 1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, after(SUFFIX))
    spm = F.concat(after(PREFIX), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, text, n, form, prefix, middle, suffix, output) for each row of ``docs(doc_id, text)``; parts are null if plain."""
    text = F.coalesce("text", F.lit(""))
    h = draws(F.col("doc_id"), seed)
    marked = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        F.regexp_replace(escaped(text), ESCAPED_UNIT, "$0" + DELIMITER).alias("marked"),
        *[x.alias(f"h{i}") for i, x in enumerate(h, 1)],
    )
    counted = marked.withColumn("n", (F.length("marked") - F.length(F.replace("marked", F.lit(DELIMITER), F.lit("")))).cast("long"))
    cuts = [F.col(c) % (F.col("n") + 1) for c in ("h1", "h2")]
    plain = (F.col("n") == 0) | F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE) | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    ranked = counted.select("*", F.least(*cuts).cast("int").alias("a"), F.greatest(*cuts).cast("int").alias("b"), form.alias("form"))
    first = F.call_function("substring_index", "marked", F.lit(DELIMITER), F.col("b"))  # the units up to the middle's last
    part = lambda units: F.when(F.col("form") != "plain", unescaped(F.replace(units, F.lit(DELIMITER), F.lit(""))))
    at = lambda units, k: F.call_function("substring_index", units, F.lit(DELIMITER), k)
    parts = ranked.select(
        "*",
        part(at(F.col("marked"), F.col("a"))).alias("prefix"),
        part(at(first, F.col("a") - F.col("b"))).alias("middle"),
        part(at(F.col("marked"), (F.col("b") - F.col("n") - 1).cast("int"))).alias("suffix"),
    )
    return parts.select("doc_id", "text", "n", "form", "prefix", "middle", "suffix", assembled(F.col("form"), F.col("prefix"), F.col("middle"), F.col("suffix"), F.col("text")).alias("output"))


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    found = fill_in_middle(table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return found.select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(back, 256).alias("restored_sha256"),
    )


ORACLE = f"""WITH hashed AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
units AS (SELECT doc_id, text, CASE WHEN text = '' THEN [] ELSE regexp_extract_all(text, '{UNIT}') END AS u, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM hashed),
cuts AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
sha256(text) AS restored_sha256 FROM parts"""
