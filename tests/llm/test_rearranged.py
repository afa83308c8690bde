"""Fill-in-middle, source divergence and the n-gram join against plain Python, and on awkward tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faciesforge.llm import divergence, middle, ngramjoin
from faciesforge.llm._util import cut
from faciesforge.llm.queries import oracle_sql, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n string, node string, keys string, form string, term string, block int, key long, prefix string, marked string"
LONG = "Erth and the ination, of it. " * 20_000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again", "en", "a"),
    (2, None, "en", None),
    (3, "", None, "b"),
    (4, "   \n\t ", "de", "a"),
    (5, "The quick brown fox jumps over the lazy dog AGAIN", "en", "b"),
    (5, "The quick brown fox jumps over the lazy dog AGAIN", "en", "b"),
    (None, "der schnelle Fuchs", "de", "a"),
    (None, "der schnelle Fuchs springt über den faulen Hund", "de", "b"),
    (7, LONG, "en", "a"),
    (8, "12 34 !!", "fr", "a"),
    (9, "日本語   naïve don't <|endoftext|>", None, None),
    (10, "a <P>b", "en", "c"),
    (11, "\u0001\u0002\u0001x\u00020 \u00021y$0\\1\x00", "en", "c"),
    (12, "<P<S<M>😀é", "en", "a"),
    (13, "one two", "en", "a"),
    (14, "ONE two", "en", "b"),
] + [(20 + i, f"<{'ab' * i} {i}😀\u0001> {'x ' * i}", "en", "abc"[i % 3]) for i in range(40)]


def frame(spark, rows, name):
    return cut(spark.createDataFrame([(i, t, lang, source, None, "1", "2", "3", "4", "5", 6, 7, "8", "9") for i, t, lang, source in rows], SCHEMA), name)


@pytest.fixture(scope="module")
def awkward(spark):
    return frame(spark, ROWS, "awkward")


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [], "empty")


# ---- fill-in-middle -----------------------------------------------------------------------------


def rearranged(doc_id, text, seed=1, rate=90, spm=20):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("options", [{}, {"seed": 7, "rate": 100, "suffix_first": 50}, {"seed": 3, "rate": 0}])
def test_parts_and_round_trip(awkward, options):
    rows = middle.fill_in_middle(awkward, **options).withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    got = Counter((r["doc_id"], r["n"], r["form"], r["prefix"], r["middle"], r["suffix"], r["output"]) for r in rows)
    args = [options.get("seed", 1), options.get("rate", 90), options.get("suffix_first", 20)]
    assert got == Counter((i, *rearranged(i, t, *args)) for i, t, *_ in ROWS)
    assert all(r["back"] == r["text"] for r in rows)


def test_middle_of_an_empty_table(empty):
    assert middle.fill_in_middle(empty).count() == 0


def test_middle_plan_has_neither_shuffle_nor_python(spark):
    plan = middle.op11_fill_in_middle(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


# ---- source divergence ----------------------------------------------------------------------------


def plain_audit(rows, min_docs, top):
    groups, docs_of = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower)
        groups[lang or "", source or ""].update(words)
        docs_of[lang or ""].update(set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, c in docs_of[lang].items() if c >= min_docs)
        v, mine = len(kept), {s: c for (at, s), c in groups.items() if at == lang}
        p = {}
        for s, c in [*mine.items(), (None, sum(mine.values(), Counter()))]:
            total = sum(c[t] for t in kept)
            p[s] = {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * v) for t in kept}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in mine:
            pairs = [("pair", o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in mine if o != s]
            best = [("term", t, f(p[s][t], p[None][t])) for t in kept if mine[s][t] > 0 and p[s][t] > p[None][t]]
            for found, most in ((pairs, len(pairs)), (best, top)):
                for rank, (part, item, value) in enumerate(sorted(found, key=lambda x: (-x[2], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


@pytest.mark.parametrize("tile_cells,pair_cells,held_terms", [(1 << 20, 1 << 20, 200_000), (8, 4, 3)])
def test_audit_against_plain_python(spark, awkward, monkeypatch, tile_cells, pair_cells, held_terms):
    monkeypatch.setattr(divergence, "HELD_TERMS", held_terms)
    found = divergence.audit(awkward, 2, 3, tile_cells, pair_cells)
    got = [tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect()]
    want = plain_audit(ROWS, 2, 3)
    assert len(got) == len(want) and set(got) == want


def test_languages_joined_by_a_shuffle(awkward, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_LANGS", 0)
    assert {tuple(r) for r in divergence.audit(awkward, 2, 3).select("lang", "source", "part", "item", "value", "rank").collect()} == plain_audit(ROWS, 2, 3)


def test_audit_without_terms_and_without_rows(awkward, empty):
    rows = divergence.audit(awkward, 10_000).collect()
    assert {(r["part"], r["value"]) for r in rows} == {("pair", 0)}
    assert divergence.audit(empty).count() == 0


def test_shares_and_gaps_are_exact():
    rnd = np.random.default_rng(1)
    count = rnd.integers(0, 4 * 10**14, 500)
    total, v = np.int64(8 * 10**15), 3
    assert divergence.share(count, total, v).tolist() == [1 + 10**9 * (int(c) + 2) // (int(total) + 2 * v) for c in count]
    p = rnd.integers(1, 10**9 + 2, 500)
    assert divergence.gap(p, p[::-1]).tolist() == [(int(a) - int(b)) ** 2 // (int(a) + int(b)) for a, b in zip(p, p[::-1], strict=True)]


# ---- n-gram join ------------------------------------------------------------------------------------


def plain_join(rows, gram=4, percent=85):
    sets = []
    for _, text, *_ in rows:
        words = (text or "").encode().lower().split()
        k = min(gram, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links += a != b
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[root(i)] = min(low.get(root(i), r[0]), r[0])
    return Counter((r[0], len(s), low.get(root(i))) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), links


def near_copies(seed=5):
    """Texts of many sizes and copies of them with words changed, around the limit; families around one passage; a dense group."""
    rnd = np.random.default_rng(seed)
    word = lambda n: [f"w{x}" for x in rnd.integers(0, 5_000, n)]
    texts = []
    for n in [*range(1, 40), *rnd.integers(40, 700, 40)]:
        base = word(n)
        texts.append(base)
        for _ in range(3):
            copy = list(base)
            for at in rnd.integers(0, n, rnd.integers(0, 2 + n // 45)):
                copy[at] = f"x{rnd.integers(0, 5_000)}"
            texts.append(copy[: len(copy) - int(rnd.integers(0, 2 + n // 30))])
    passage, base = word(50), word(120)
    texts += [word(int(rnd.integers(0, 12))) + passage + word(int(rnd.integers(0, 12))) for _ in range(150)]
    for _ in range(150):
        copy = list(base)
        for at in rnd.integers(0, 120, 3):
            copy[at] = f"y{rnd.integers(0, 5_000)}"
        texts.append(copy)
    return [(i, " ".join(t), None, None) for i, t in enumerate(texts)]


def joined(df, **options):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngramjoin.jaccard_join(df, **options).collect())


@pytest.mark.parametrize("seed", [5, 6])
def test_join_against_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(ngramjoin, "PART_SETS", 40)
    rows = near_copies(seed)
    want, links = plain_join(rows)
    assert links > 300
    assert joined(frame(spark, rows, "near")) == want


def test_join_of_other_sizes_and_limits(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "SMALL_BUCKET", 2)
    monkeypatch.setattr(ngramjoin, "BROADCAST_NODES", 0)
    rows = near_copies(7)
    assert joined(frame(spark, rows, "near"), gram=2, percent=70) == plain_join(rows, 2, 70)[0]


def test_linked_sets_share_a_key():
    rnd = np.random.default_rng(2)
    for m in [*range(1, 60), 100, 400, 3000]:
        for percent in (85, 60):
            for _ in range(20):
                a = rnd.integers(0, 2**64, m, np.uint64)
                drop = rnd.integers(0, m * (100 - percent) // 100 + 1)
                add = rnd.integers(0, max(1, (m - drop) * 100 // percent - m + 1))
                a, b = np.unique(a), np.unique(np.r_[a[drop:], rnd.integers(0, 2**64, add, np.uint64)])
                if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
                    assert np.intersect1d(ngramjoin.keys(a, percent), ngramjoin.keys(b, percent)).size


def test_parities_never_exceed_the_difference():
    rnd = np.random.default_rng(4)
    fold = lambda x, n: x if len(x) == n else x[:n] ^ x[n:]
    for m in [1, 2, 63, 64, 65, 100, 1000]:
        a = np.unique(rnd.integers(0, 2**64, m, np.uint64))
        b = np.unique(np.r_[a[m // 8 :], rnd.integers(0, 2**64, m // 8, np.uint64)])
        x, y = ngramjoin.parities(a).view(np.uint64), ngramjoin.parities(b).view(np.uint64)
        n = min(len(x), len(y))
        assert np.bitwise_count(fold(x, n) ^ fold(y, n)).sum() <= len(np.setxor1d(a, b))


def test_sets_with_many_empty_segments_share_a_key():
    """Sets that sit in few segments of each cut fall back on their prefix."""
    rnd = np.random.default_rng(3)
    for m in (20, 60, 200):
        for _ in range(50):
            a = np.unique(rnd.integers(0, 2**40, m, np.uint64))  # all in the first segment
            b = np.unique(np.r_[a[1:], rnd.integers(0, 2**40, 1, np.uint64)])
            if 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)):
                assert np.intersect1d(ngramjoin.keys(a), ngramjoin.keys(b)).size


def test_join_on_awkward_rows(spark, awkward, empty):
    assert joined(awkward) == plain_join(ROWS)[0]
    assert ngramjoin.jaccard_join(empty).count() == 0


def test_long_texts_are_split_in_pieces(monkeypatch):
    whole = ngramjoin.grams(LONG.encode(), ngramjoin.Words())
    monkeypatch.setattr(ngramjoin, "PIECE", 1000)
    monkeypatch.setattr(ngramjoin, "WORDS_HELD", 3)
    assert (ngramjoin.grams(LONG.encode(), ngramjoin.Words()) == whole).all()


def test_pairs_of_a_part_that_can_link():
    rnd = np.random.default_rng(6)
    sets = [np.unique(rnd.integers(0, 2**64, n, np.uint64)) for n in (60, 66, 100, 500)]
    sets += [np.r_[s[len(s) // 40 :], rnd.integers(0, 2**64, 1 + len(s) // 40, np.uint64)] for s in sets]  # 66 has 128 buckets, 60 has 64
    sets = [np.unique(s) for s in [*sets, sets[0], np.r_[sets[0], rnd.integers(0, 2**64, 5, np.uint64)]]]
    root = [0, 1, 2, 3, 4, 1, 6, 7, 8, 9]  # 1 and 5 are together
    rows = pa.table({"node": pa.array(range(10), pa.int64()), "n": pa.array([len(s) for s in sets]), "root": pa.array(root, pa.int64()), "bits": pa.array([ngramjoin.parities(s).tolist() for s in sets], pa.list_(pa.int64()))})
    of = lambda nearest: [tuple(x.tolist()) for x in np.stack(ngramjoin.may_link_here(rows, 85, nearest), axis=1)]
    got = {tuple(sorted(p)) for p in of(False)}
    jaccard = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
    want = {(i, j) for i in range(10) for j in range(i + 1, 10) if root[i] != root[j] and jaccard(sets[i], sets[j])}
    assert want <= got and len(got) <= len(want) + 2 and {(0, 9), (2, 6), (3, 7)} <= want and (1, 5) not in got
    best = dict(of(True))
    assert len(best) == len(of(True)) == len({i for p in got for i in p}) and best[0] == 8 and best[8] == 0 and best[2] == 6


def test_join_query_on_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngramjoin.op13_ngram_jaccard(spark, "/root/testdata/sf0.001").collect())
    assert got == plain_join(rows)[0]


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_source_divergence"])
def test_queries_against_sql(spark, duck, name):
    df, want = queries()[name](spark, "/root/testdata/sf0.01"), duck.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert Counter(tuple(r) for r in df.select(*want.columns).collect()) == Counter(want.fetchall())
