"""URL filtering by pattern rules that are indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` together with the literal tokens that
every match must hold as whole tokens. It is filed under the one of them that is rarest
among the URLs at hand (counted over all rows, for the tokens that rules name). A URL looks
up its own tokens, which gives a few candidate rules, and only those run their expressions;
rules without a token are candidates of every URL. The longest matching rule decides.

Everything is DataFrame functions. Up to ``INLINE_RULES`` rules the index is a map literal
inside the projection, so URLs are judged where they are read, without a shuffle. Longer
lists are a table: URL tokens are joined with it (the hot tokens of both sides dealt out by
a salt), and the best rule of each URL is an aggregate that is combined before its shuffle.

Defined results: a null URL, or one without ``://``, has empty host and path; no rule fits
an empty host; of matching rules of one length the first in the list wins; repeated rows and
repeated or null page ids are judged row by row; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import cut, table

#: Rules that are put into the plan itself; about a few MB of literals at most.
INLINE_RULES = 2_000
SALT = 32
ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = re.compile(r"[a-z0-9]+")
#: The verdict for a URL that no rule fits.
DEFAULT = ALLOW


@dataclass(frozen=True)
class Rule:
    verdict: str
    #: What is reported, and what its length is measured on.
    name: str
    #: Java regular expression over host + path.
    pattern: str
    #: Lower-case tokens [a-z0-9]+ that each match holds as whole tokens.
    tokens: tuple[str, ...]


def prefix_rule(verdict: str, rule: str) -> Rule:
    """``host/path``: fits the host and its subdomains where the URL's path starts with the rule's path."""
    whole = _TOKEN.findall(rule.translate(str.maketrans(_UPPER, _LOWER)))
    if whole and re.search(r"[A-Za-z0-9]$", rule):
        whole.pop()  # it may go on in the URL
    return Rule(verdict, rule, r"^(?:[^/]*\.)?" + "".join(re.sub(r"([^A-Za-z0-9_])", r"\\\1", c) for c in rule), tuple(whole))


def wildcard_rule(verdict: str, rule: str) -> Rule:
    """A literal text with ``*`` for anything, found anywhere in host + path."""
    parts = rule.split("*")
    body = ".*".join("".join(re.sub(r"([^A-Za-z0-9_])", r"\\\1", c) for c in part) for part in parts)
    tokens = []
    for part in parts:
        low = part.translate(str.maketrans(_UPPER, _LOWER))
        tokens += [m[0] for m in _TOKEN.finditer(low) if m.start() > 0 and m.end() < len(low)]
    return Rule(verdict, rule, "(?s)" + body, tuple(tokens))


RULES = (
    prefix_rule(ALLOW, "org/"),
    prefix_rule(BLOCK, "example.org/es/"),
    prefix_rule(BLOCK, "example.org/en/1"),
    prefix_rule(ALLOW, "com/fr/"),
    prefix_rule(BLOCK, "com/de/"),
)


def lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def tokens(site: Column) -> Column:
    """The distinct tokens of host + path, and the empty one under which rules without a token are filed."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(lower(site), F.lit("[a-z0-9]+"), 0)))


def token_counts(sites: DataFrame, wanted: set[str]) -> dict[str, int]:
    """How many of the URLs hold each of the wanted tokens; as many rows as the rules name tokens."""
    if not wanted:
        return {}
    named = F.array(*[F.lit(t) for t in sorted(wanted)])
    return {r[0]: r[1] for r in sites.select(F.explode(F.array_intersect(tokens(F.col("__site")), named)).alias("t")).groupBy("t").count().collect()}


def index(rules: tuple[Rule, ...], counts: dict[str, int]) -> dict[str, list[int]]:
    """Token -> places of the rules filed under it."""
    out: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        rarest = min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default="")
        out.setdefault(rarest, []).append(i)
    return out


def _key(i: int, rule: Rule) -> tuple[int, int]:
    return len(rule.name), -i


def _inline(sites: DataFrame, rules: tuple[Rule, ...], filed: dict[str, list[int]]) -> DataFrame:
    kind = "array<struct<size:int,place:int,rule:string,verdict:string,pattern:string>>"
    lit = lambda i: F.struct(F.lit(len(rules[i].name)).alias("size"), F.lit(-i).alias("place"), F.lit(rules[i].name).alias("rule"), F.lit(rules[i].verdict).alias("verdict"), F.lit(rules[i].pattern).alias("pattern"))
    entries = [x for t, places in sorted(filed.items()) for x in (F.lit(t), F.array(*[lit(i) for i in places]))]
    if not entries:
        return sites.withColumn("__best", F.lit(None).cast("struct<size:int,place:int,rule:string,verdict:string,pattern:string>"))
    lookup = F.create_map(*entries)
    candidates = F.flatten(F.transform(tokens(F.col("__site")), lambda t: F.coalesce(F.try_element_at(lookup, t), F.array().cast(kind))))
    return sites.withColumn("__best", F.array_max(F.filter(candidates, lambda r: F.regexp_like(F.col("__site"), r["pattern"]))))


def _joined(sites: DataFrame, rules: tuple[Rule, ...], filed: dict[str, list[int]]) -> DataFrame:
    """The same by a join of tokens; ``sites`` has a ``__row`` that tells its rows apart."""
    spark = sites.sparkSession
    rows = [(t, *_key(i, rules[i]), rules[i].name, rules[i].verdict, rules[i].pattern) for t, places in filed.items() for i in places]
    listed = spark.createDataFrame(rows, "token string, size int, place int, rule string, verdict string, pattern string")
    listed = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    asked = sites.select("__row", "__site", F.explode(tokens(F.col("__site"))).alias("token"), F.pmod(F.xxhash64("__row"), F.lit(SALT)).cast("int").alias("salt"))
    met = asked.join(listed, ["token", "salt"]).filter(F.regexp_like("__site", F.col("pattern")))
    best = met.groupBy("__row").agg(F.max(F.struct("size", "place", "rule", "verdict")).alias("__best"))
    return sites.join(best, "__row", "left")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = DEFAULT, inline: int = INLINE_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages(page_id, url)``."""
    host, path = host_and_path(F.col("url"))
    sites = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("__site", F.concat("host", "path"))
    filed = index(rules, token_counts(sites, {t for r in rules for t in r.tokens}))
    if len(rules) <= inline:
        judged = _inline(sites, rules, filed)
    else:
        judged = _joined(cut(sites.withColumn("__row", F.monotonically_increasing_id()), "sites"), rules, filed)
    return judged.select("page_id", "host", "path", F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select(F.col("page_id").cast("long").alias("page_id"), "host", "path", "rule", "verdict")


ORACLE = """
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
s AS (SELECT page_id, translate(coalesce(raw, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM b),
r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                            ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) v(verdict, h, p)),
best AS (SELECT s.page_id, max_by(r.h || r.p, length(r.h || r.p)) AS rule, max_by(r.verdict, length(r.h || r.p)) AS verdict
         FROM s JOIN r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p) GROUP BY s.page_id)
SELECT s.page_id, s.host, s.path, best.rule, coalesce(best.verdict, 'allow') AS verdict FROM s LEFT JOIN best USING (page_id)
"""
