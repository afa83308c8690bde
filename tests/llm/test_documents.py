"""The document operators against brute force and their defined results on awkward tables."""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections import Counter
from itertools import groupby

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from faciesforge.llm import langid, packing, quality, sentencepiece_fst, sharding, simhash, tokenfile, tokens, urls
from faciesforge.llm._util import cut, scratch_path
from faciesforge.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, ids string, rank int, fp string, size string, length string, x string, component_id string, score string"
LONG = "Erth and the ination of it. " * 20_000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, "   \n\t ", "de"),
    (5, "the quick brown fox jumps over the lazy dog again", "en"),
    (5, "the quick brown fox jumps over the lazy dog again", "en"),
    (None, "der schnelle Fuchs", "de"),
    (7, LONG, "en"),
    (8, "12 34 !!", "fr"),
    (9, "日本語 \u00a0 naïve don't <|endoftext|>", None),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, lang, None, None, 1, "a", 2, "b", "c", "d", "e", "f", "g") for i, t, lang in ROWS]
    return cut(spark.createDataFrame(rows, SCHEMA), "awkward")


@pytest.fixture(scope="module")
def empty(spark):
    return cut(spark.createDataFrame([], SCHEMA), "empty")


def plain_ids(name: str, text: str | None) -> list[int]:
    return Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ---- exact ids ------------------------------------------------------------------------


@pytest.mark.parametrize("specials", [True, False])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_memo_gives_the_ids_of_whole_texts(name, specials, monkeypatch):
    monkeypatch.setattr(tokens, "STRETCH", 40)
    monkeypatch.setattr(tokens, "GROUP_BYTES", 20_000)
    rnd = np.random.default_rng(3)
    parts = ["a", "B", "the", " ", "  ", "\n", "\t", "\r\n", ".", ",", "'s", "'", "é", "E\u0301", "J\u030c", "\u00a0", "\u2003", "12", "!", "日本", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "endoftext|>", ">", "\u0338", "💙", "ß", "İ", "—", "\x1c", "\x02", "Σ", "x" * 80, "don't", "ﬁ", "가", "\u1100\u1161", "_", "\x00"]
    texts = ["".join(rnd.choice(parts, rnd.integers(0, 25))) for _ in range(4000)] + [t or "" for _, t, _ in ROWS]
    got = Encoder(public_tokenizers.path(name), 500, specials).encode([t.encode() for t in texts])
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = not specials
    want = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    assert got == want


# ---- packing ----------------------------------------------------------------------------


def best_fill(counts: dict[int, int], room: int) -> int:
    sums = {0}
    for n, c in counts.items():
        for _ in range(c):
            sums |= {s + n for s in sums if s + n <= room}
    return max(sums)


def test_fullest_combination_is_the_fullest():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        counts = np.zeros(41, np.int64)
        for n in rnd.integers(1, 41, 6):
            counts[n] += rnd.integers(1, 4)
        room = int(rnd.integers(1, 60))
        lengths = [n for n in range(40, 0, -1) if counts[n]]
        chosen = packing.fullest(counts, lengths, room)
        assert all(k <= counts[n] for n, k in chosen.items())
        assert sum(n * k for n, k in chosen.items()) == best_fill({n: int(counts[n]) for n in lengths}, room)


def test_plan_places_every_piece_once():
    rows, bins = packing.plan({2048: 3, 1000: 5, 1024: 4, 24: 7, 1: 9}, 2048)
    fill = np.zeros(bins, int)
    placed = {}
    for length, first, at, times, _ in rows.tolist():
        fill[at : at + times] += length
        placed.setdefault(length, []).append((first, first + times))
    assert fill.max() <= 2048 and fill.sum() == 3 * 2048 + 5000 + 4096 + 168 + 9
    for spans in placed.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))  # noqa: B905


def check_packed(rows, docs, capacity=2048):
    for _, group in groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in group:
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    want = []
    for doc_id, text in docs:
        ids = plain_ids("byte_bpe_50k.json", text) + [0]
        starts = packing.cut_points(len(ids), capacity)
        want += [(doc_id, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True))]
    key = lambda t: tuple((x is not None, x or 0) for x in t)
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows], key=key) == sorted(want, key=key)


def test_packing_awkward(awkward, empty):
    tokenizer = public_tokenizers.path(packing.TOKENIZER)
    rows = packing.pack_documents(awkward, tokenizer).collect()
    check_packed(rows, [(i, t) for i, t, _ in ROWS])
    assert packing.pack_documents(empty, tokenizer).count() == 0


def test_packed_sequences_hold_the_ids(awkward):
    packed = packing.pack_documents(awkward, public_tokenizers.path(packing.TOKENIZER), keep_ids=True)
    kept = cut(packed, "packed")
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(kept).collect()}
    for r in kept.collect():
        part = whole[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])]
        assert zlib.crc32(bytes(part)) == r["ids_crc32"]


def test_pack_keeps_clashing_columns_and_splits_one_length(spark):
    names = ["length", "bucket", "place", "shift", "rank", "n", "__part", "__place", "__rank", "sequence_id", "offset"]
    items = spark.range(0, 3000, 1, 7).select(F.lit(700).cast("long").alias("length"), *[F.lit(i).alias(c) for i, c in enumerate(names) if i])
    rows = packing.pack(items.union(items.limit(1).withColumn("length", F.lit(5).cast("long")))).collect()
    assert len(rows) == 3001 and set(rows[0].asDict()) == set(names)
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 3001 and len({r["sequence_id"] for r in rows}) == 1500
    assert all(r["bucket"] == 1 and r["__part"] == 6 and r["__rank"] == 8 for r in rows)
    assert {r["offset"] for r in rows if r["length"] == 700} <= {0, 700} and len({r["offset"] for r in rows}) == 3


def test_packing_is_near_the_bound(spark):
    rows = packing.op2_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    bins = len({r["sequence_id"] for r in rows})
    assert bins <= 1.01 * -(-sum(r["length"] for r in rows) // 2048) + 1


# ---- token files --------------------------------------------------------------------------


def test_variable_length_code_round_trip():
    rnd = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (2 ** rnd.uniform(0, 32, n) - 1).astype(np.uint32)
        control, data = tokenfile.pack_ranks(v)
        assert (tokenfile.unpack_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == v).all()
        assert tokenfile.data_bytes(np.frombuffer(control, np.uint8), n) == len(data)


def test_frequent_ids_take_one_byte():
    ids = np.array([40_000] * 900 + list(range(1000, 1300)), "<u4").tobytes()
    raw = tokenfile.write_block([7], [ids])
    docs, counts, back = tokenfile.read_block(raw)
    assert docs == [7] and counts.tolist() == [1200] and back.astype("<u4").tobytes() == ids
    assert len(raw) < 300 * 4 + 1200 + 300 + 100 + 1200 // 4


def test_damaged_block_is_refused():
    raw = bytearray(tokenfile.write_block([1], [b"\x01\0\0\0"]))
    raw[20] ^= 1
    with pytest.raises(ValueError):
        tokenfile.read_block(bytes(raw))


@pytest.mark.parametrize("block_ids", [50, 2_000_000])
def test_token_files(spark, awkward, block_ids):
    path = scratch_path(spark, "tokens")
    tokenfile.write_tokens(awkward, path, public_tokenizers.path(tokenfile.TOKENIZER), block_ids=block_ids, files=3)
    rows = sorted(tokenfile.read_tokens(spark, path, keep_ids=True).collect(), key=lambda r: r["start"])
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in rows]
    assert order == sorted(order) and len(rows) == len(ROWS)
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    want = sorted(crc(plain_ids(tokenfile.TOKENIZER, t) + [1]) for _, t, _ in ROWS)
    assert sorted(r["ids_crc32"] for r in rows) == want and sorted(zlib.crc32(bytes(r["ids"])) for r in rows) == want


def test_token_files_of_nothing(spark, empty):
    path = scratch_path(spark, "tokens")
    tokenfile.write_tokens(empty, path, public_tokenizers.path(tokenfile.TOKENIZER))
    assert tokenfile.read_tokens(spark, path).count() == 0


# ---- near-duplicates ------------------------------------------------------------------------


def plain_fingerprint(text: str | None) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    k = min(4, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids: list, f: np.ndarray) -> list:
    up = list(range(len(f)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 4):
            a, b = root(i), root(i + 1 + int(j))
            up[max(a, b)] = min(a, b)
    roots = [root(i) for i in range(len(f))]
    low = {}
    for i, r in zip(ids, roots, strict=True):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return [low.get(r) for r in roots]


def test_fingerprints_by_definition():
    texts = [t for _, t, _ in ROWS if t is not LONG] + ["A b C d E", "a B c D e", "é É x", "a\u00a0b c", "one two three", "a " * 300]
    for t in texts:
        assert simhash.fingerprint((t or "").encode()) % 2**64 == plain_fingerprint(t)


@pytest.mark.parametrize("hot", [100_000, 30])
def test_links_lose_nothing(spark, hot):
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 2**63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rnd.choice(64, rnd.integers(0, 7), replace=False))) for b in base for _ in range(3)]
    dense = [base[0] ^ np.uint64(sum(1 << int(k) for k in rnd.choice(64, 2, replace=False))) for _ in range(150)]
    f = np.unique(np.array([*base, *near, *dense, 0, 3, 2**64 - 1], np.uint64))
    nodes = cut(spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long"), "nodes")
    stars = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes, 4, hot)).collect()}
    want = plain_components(list(range(len(f))), f)
    groups: dict = {}
    for x, w in zip(f.view(np.int64).tolist(), want, strict=True):
        groups.setdefault(w, set()).add(stars.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


def test_no_finer_bucket_holds_a_hot_one(spark):
    rnd = np.random.default_rng(6)
    f = np.unique(rnd.integers(0, 2**63, 3000, dtype=np.uint64) << np.uint64(21) | np.uint64(12345))  # one first segment
    f = np.unique(np.r_[f, f[:40] ^ np.uint64(1 << 30 | 1 << 50), f[40:50] ^ np.uint64(0b1111 << 30)])
    nodes = cut(spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long"), "nodes")
    rows = simhash.variants(nodes).filter("path = 0")
    sizes = lambda d: max(r["count"] for r in d.groupBy("key").count().collect())
    assert sizes(rows) == len(f)
    paths = [simhash.FULL ^ ((1 << n) - 1 << low) for low, n in simhash.SEGMENTS]
    split, paths = simhash.finer(rows, paths, 5)
    assert sizes(split) < len(f) / 20 and all(33 <= p.bit_count() <= 36 for p in paths)
    stars = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes, 4, 64)).collect()}
    want = plain_components(list(range(len(f))), f)
    groups: dict = {}
    for x, w in zip(f.view(np.int64).tolist(), want, strict=True):
        groups.setdefault(w, set()).add(stars.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups) < len(f) - 40


def test_near_duplicates_awkward(awkward, empty):
    rows = simhash.near_duplicates(awkward).collect()
    texts = sorted(((i is not None, i or 0, t or "") for i, t, _ in ROWS))
    assert len(rows) == len(ROWS)
    ids, f = [i if known else None for known, i, _ in texts], np.array([plain_fingerprint(t) for *_, t in texts], np.uint64)
    want = sorted((i or 0, int(x), c or 0) for i, x, c in zip(ids, f, plain_components(ids, f), strict=True))
    assert sorted((r["doc_id"] or 0, r["fp"] % 2**64, r["component_id"] or 0) for r in rows) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_query_against_brute_force(spark):
    rows = simhash.op7_simhash_near_dedup(spark, "/root/testdata/sf0.001").collect()
    f = np.array([int(r["fingerprint"], 16) for r in rows], np.uint64)
    assert [r["component_id"] for r in rows] == plain_components([r["doc_id"] for r in rows], f)


def test_deduplicate_keeps_one(awkward, empty):
    kept = simhash.deduplicate(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 7, 8, 9]
    assert simhash.deduplicate(empty).count() == 0


def test_deduplicate_by_text_whatever_the_ids(spark):
    texts = [" ".join(f"{w}{i}" for i in range(40)) for w in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (9, texts[3]), (None, texts[3]), (8, texts[4]), (None, texts[4]), (5, texts[4]), (9, texts[5])]
    kept = simhash.deduplicate(cut(spark.createDataFrame(rows, "doc_id long, text string"), "docs")).collect()
    want = [(None, 0), (None, 1), (7, 2), (7, 3), (5, 4), (9, 5)]
    assert sorted((texts.index(r["text"]), r["doc_id"] or 0) for r in kept) == [(t, i or 0) for i, t in want]


def test_deduplicate_by_similarity_of_five_words(spark):
    rnd, rows = np.random.default_rng(4), []
    for i in range(40):
        words = [f"w{x}" for x in rnd.integers(0, 5000, 200)]
        other = lambda n, i=i, words=words: " ".join(f"other{i}" if n and k % (190 // n) == 10 and k // (190 // n) < n else w for k, w in enumerate(words))
        rows += [(10 * i, other(0)), (10 * i + 1, other(4)), (10 * i + 2, other(5))]  # 176 of 216 shingles and 171 of 221 in common with the first
    sets = [simhash.shingles(t.encode(), 5) for _, t in rows]
    similarity = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert all(similarity(sets[i], sets[i + 1]) >= 0.8 > max(similarity(sets[i], sets[i + 2]), similarity(sets[i + 1], sets[i + 2])) for i in range(0, len(sets), 3))
    kept = simhash.deduplicate(cut(spark.createDataFrame(rows, "doc_id long, text string"), "docs"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in rows if i % 10 != 1)


@pytest.mark.parametrize("sets", [3, 250])
def test_similar_against_brute_force(spark, monkeypatch, sets):
    """Chains and dense groups, in parts of few sets too."""
    monkeypatch.setattr(simhash, "GROUP_SETS", sets)
    rnd, rows = np.random.default_rng(12), []
    for i in range(6):
        words = [f"w{x}" for x in rnd.integers(0, 9000, 120)]
        for step in range(14):  # each differs from the last a little, so that the ends of a chain are far apart
            words = list(words)
            if i % 2:
                words[int(rnd.integers(0, 120))] = f"n{i}_{step}"
            rows.append(" ".join(words if i % 2 else [*words[: 119 - step % 5], "end"]))
    rows += ["", "one", "one", None] + [" ".join(f"z{j}" for j in range(k)) for k in range(30, 60)]
    docs = cut(spark.createDataFrame([(k, t) for k, t in enumerate(rows)], f"{simhash.ROW} long, text string"), "docs")
    got: dict = {}
    for r in simhash.similar(docs).collect():
        got.setdefault(r["root"], set()).add(r[simhash.ROW])
    sets_of = [set(simhash.shingles((t or "").encode(), 5).tolist()) for t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets_of[i] == sets_of[j] or 5 * len(sets_of[i] & sets_of[j]) >= 4 * len(sets_of[i] | sets_of[j]):
                up[root(i)] = root(j)
    want: dict = {}
    for i in range(len(rows)):
        want.setdefault(root(i), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


# ---- languages ---------------------------------------------------------------------------------


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.op9_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_awkward(awkward, empty):
    model = langid.learn(langid.training_rows(awkward))
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.predict(awkward, model).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (8, "und")} <= got
    assert all(p in (*model.languages, "und") for _, p in got)
    assert langid.predict(empty, model).count() == 0
    none = langid.learn(langid.training_rows(empty))
    assert {r["lang_pred"] for r in langid.predict(awkward, none).collect()} == {"und"}
    kept = langid.accept(awkward, model)
    assert kept.columns == awkward.columns and not {2, 3, 4, 8} & {r["doc_id"] for r in kept.collect()}


def test_numbers_are_no_letters():
    model = langid.model_of(["a"], {"wort": np.zeros(1)}, {"w": np.zeros(1)})
    said, sure = langid.Scorer(model).answers(iter(["\u00b2 \u00bd", "\u2460", "\u2167 12 _", "x\u00b2", "\u4e00", None, ""]))
    assert said == ["und", "und", "und", "a", "a", "und", "und"] and [s > 0 for s in sure] == [s == "a" for s in said]


def plain_language(docs, texts):
    """Words first, then ever shorter n-grams, straight from the definition."""
    words, grams = {}, {}
    split = lambda t: [w for w in re.findall(r"\w+", re.sub(r"[\d_]", " ", t.lower())) if w.isalpha()]
    for lang, text in docs:
        for w in split(text):
            words.setdefault(lang, Counter())[w] += 1
            for i in range(len(w) + 1):
                for k in range(1, 5):
                    if i + k <= len(w) + 2:
                        grams.setdefault((lang, k), Counter())[f"<{w}>"[i : i + k]] += 1
    langs = sorted(words)
    log = lambda c, x: math.log(c[x] / c.total()) if c[x] else None
    word = {w: [log(words[a], w) for a in langs] for a in langs for w in words[a]}
    gram = {g: [log(grams[a, len(g)], g) for a in langs] for (a, _), c in grams.items() for g in c}
    for table in (word, gram):
        low = [min((v[i] for v in table.values() if v[i] is not None)) - math.log(2) for i in range(len(langs))]
        for v in table.values():
            v[:] = [low[i] if x is None else x for i, x in enumerate(v)]

    def score(w):
        if w in word:
            return word[w]
        total, marked = [0.0] * len(langs), f"<{w}>"
        for i in range(len(w) + 1):
            g, down = marked[i : i + 4], 0
            while g not in gram and len(g) > 1:
                g, down = g[:-1], down + 1
            total = [t + x + down * math.log(0.4) for t, x in zip(total, gram.get(g, [-14.0] * len(langs)), strict=True)]
        return [t / (len(w) + 1) for t in total]

    for text in texts:
        rows = [score(w) for w in split(text)]
        if not rows:
            yield "und", 0.0
            continue
        mean = [sum(c) / len(rows) for c in zip(*rows, strict=True)]
        best = max(range(len(langs)), key=lambda i: (mean[i], -i))
        yield langs[best], 1 / sum(math.exp(m - mean[best]) for m in mean)


def test_language_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    learnt = [(r["lang"], r["text"]) for r in docs if r["lang"] and r["text"] and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.op9_language_id(spark, "/root/testdata/sf0.001").collect()}
    for r, (lang, score) in zip(docs, plain_language(learnt, [r["text"] or "" for r in docs]), strict=True):
        assert got[r["doc_id"]][0] == lang and abs(got[r["doc_id"]][1] - score) < 1e-9


def test_unseen_words_back_off():
    x = lambda *v: np.log(np.array(v))
    model = langid.model_of(["a", "b"], {"wort": x(0.9, 0.1)}, {"t": x(0.5, 0.5), "th": x(0.1, 0.9), "<": x(0.5, 0.5)})
    s = langid.Scorer(model)
    assert s.means(["wort"])[0].argmax() == 0
    assert s.means(["th"])[0].argmax() == 1
    assert s.means(["12"])[0] is None


FOREIGN = {
    "it": "nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita ahi quanto a dir qual era e cosa dura esta selva selvaggia e aspra e forte che nel pensier rinova la paura",
    "fi": "mieleni minun tekevi aivoni ajattelevi lahteani laulamahan saa mua sanelemahan sukuvirtta suoltamahan lajivirtta laulamahan sanat suussani sulavat puhe'et putoelevat kielelleni kerkiavat hampahilleni hajoovat",
    "pl": "litwo ojczyzno moja ty jesteś jak zdrowie ile cię trzeba cenić ten tylko się dowie kto cię stracił dziś piękność twą w całej ozdobie widzę i opisuję bo tęsknię po tobie",
    "id": "aku mau hidup seribu tahun lagi kalau sampai waktuku ku mau tak seorang kan merayu tidak juga kau tak perlu sedu sedan itu aku ini binatang jalang dari kumpulannya terbuang",
    "tr": "korkma sönmez bu şafaklarda yüzen al sancak sönmeden yurdumun üstünde tüten en son ocak o benim milletimin yıldızıdır parlayacak o benimdir o benim milletimindir ancak",
    "nl": "wilhelmus van nassouwe ben ik van duitsen bloed den vaderland getrouwe blijf ik tot in den dood een prinse van oranje ben ik vrij onverveerd den koning van hispanje heb ik altijd geëerd",
    "vi": "trăm năm trong cõi người ta chữ tài chữ mệnh khéo là ghét nhau trải qua một cuộc bể dâu những điều trông thấy mà đau đớn lòng",
}
PLAIN = [
    "it was a bright cold day in april and the clocks were striking thirteen as the old man walked slowly home",
    "es war einmal ein kleines haus am rande des waldes in dem eine alte frau mit ihrer katze wohnte",
    "le petit chat dort sur la table de la cuisine pendant que la pluie tombe dehors",
    "la casa vieja estaba cerca del rio y los niños jugaban todas las tardes en la calle",
    "and the",
    "ja",
]


def test_language_stage_drops_what_is_in_no_learnt_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.learn(langid.training_rows(docs))
    rnd = np.random.default_rng(3)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    gibberish = [" ".join("".join(rnd.choice(letters, rnd.integers(2, 10))) for _ in range(n)) for n in (50, 500) for _ in range(30)]
    texts = [*FOREIGN.values(), *gibberish, *PLAIN]
    made = cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "made")
    assert {r["text"] for r in langid.accept(made, model).collect()} == set(PLAIN)
    assert langid.accept(docs, model).count() >= 0.999 * docs.count()


# ---- quality ------------------------------------------------------------------------------------


def test_quality_separates(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.op6_quality_classifier(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95


def test_discriminant_by_definition():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(500, 3))
    model = quality.Discriminant(0.5, np.zeros(3), np.ones(3), np.array([[0.0, 0, 0], [1, 0, 0]]), np.stack([np.eye(3), np.eye(3)]), np.zeros(2))
    want = 1 / (1 + np.exp(-(x[:, 0] - 0.5)))
    assert np.allclose(model.scores(x), want)


def test_quality_query_against_brute_force(spark):
    """Shrunken class covariances and Mahalanobis distances straight from their definitions."""
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    x = {i: np.array(quality.statistics((t or "").encode())) for i, t in docs.items()}
    learnt = [i for i in docs if marks.get(i) in (0, 1) and zlib.crc32(str(i).encode()) % 5]
    rows = np.array([x[i] for i in learnt])
    y = np.array([marks[i] for i in learnt])
    centre, scale = rows.mean(axis=0), rows.std(axis=0)
    scale[scale < 1e-9] = 1
    z = (rows - centre) / scale
    own = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum((y == c).mean() * own[c] for c in (0, 1))
    shrunk = [0.8 * own[c] + 0.15 * pooled + 0.05 * np.diag(np.diag(pooled)) + 1e-3 * np.eye(len(centre)) for c in (0, 1)]

    def density(v, c):
        d = v - z[y == c].mean(axis=0)
        return math.log((y == c).mean()) - 0.5 * np.linalg.slogdet(shrunk[c])[1] - 0.5 * d @ np.linalg.solve(shrunk[c], d)

    for r in quality.op6_quality_classifier(spark, sf).collect():
        v = (x[r["doc_id"]] - centre) / scale
        want = 1 / (1 + math.exp(min(700, density(v, 0) - density(v, 1))))
        assert abs(r["score"] - want) < 1e-6 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_quality_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (7, 1), (8, 0), (99, 1), (9, 0)], "doc_id long, quality int")
    stats = cut(quality.with_statistics(awkward), "statistics")
    scores = [r["score"] for r in quality.predict(stats, quality.learn(stats, labels)).collect()]
    assert len(scores) == len(ROWS) and all(0 <= s <= 1 for s in scores)
    none = quality.learn(stats, labels.limit(0))
    assert {r["score"] for r in quality.predict(stats, none).collect()} == {0.5}
    assert quality.accept(empty, labels).count() == 0
    assert quality.accept(awkward, labels).columns == awkward.columns


# ---- sharding -------------------------------------------------------------------------------------


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_ranges_cut_again_place_alike(spark, law, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    hot = spark.range(600).selectExpr("100000 + id AS doc_id", "'one text that a third of all rows hold' AS text")
    rows = cut(sharding.keyed(docs.union(hot)), "keys")
    want = sorted(tuple(r) for r in sharding.assign(rows, 16, law).collect())
    monkeypatch.setattr(sharding, "RANGE_ROWS", 7)
    assert sorted(tuple(r) for r in sharding.assign(rows, 16, law, 4).collect()) == want
    held = sharding.subdivided(rows.withColumn("range", F.lit(0))).groupBy("sub").count().collect()
    assert len(held) > 60 and max(r["count"] for r in held) < 40


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_sharding(spark, awkward, empty, law):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    hot = spark.range(600).selectExpr("100000 + id AS doc_id", "'one text that a third of all rows hold' AS text")
    rows = sharding.shard_documents(docs.select("doc_id", "text").union(hot), 16, law).collect()
    assert len(rows) == docs.count() + 600
    sizes, counts = [0] * 16, [0] * 16
    for r in rows:
        sizes[r["shard"]] += r["size"]
        counts[r["shard"]] += 1
    for s in range(16):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    if law == "rows":
        assert max(counts) - min(counts) <= 1
    else:
        assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)
    small = sharding.shard_documents(awkward, 4, law).collect()
    assert len(small) == len(ROWS) and {r["size"] for r in small if r["doc_id"] == 2} == {1}
    assert sharding.shard_documents(empty, 4, law).count() == 0


def test_sharding_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    keys = [tuple(r) for r in sharding.keyed(docs).select("h", "doc_id", "row", "size", "text_crc32").collect()]
    total, before, want, slots = sum(k[3] for k in keys), 0, {}, Counter()
    for h, doc_id, row, size, crc32 in sorted(keys):
        shard = min(15, (before + (size - 1) // 2) * 16 // total)
        want[doc_id] = (size, crc32, "bytes", shard, slots[shard], None)
        slots[shard] += 1
        before += size
    got = {r["doc_id"]: tuple(r)[1:] for r in sharding.op5_sharding(spark, sf).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert got == want and all(got[i][0] == len(t) + 1 and (got[i][1] is None or got[i][1] == zlib.crc32(t)) for i, t in texts.items())


def test_equal_texts_stay_in_a_shard(spark):
    rows = sharding.op5_sharding(spark, "/root/testdata/sf0.1").collect()
    shards, weight, share = {}, Counter(), sum(r["size"] for r in rows) / 16
    for r in rows:
        shards.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
        weight[r["text_crc32"], r["size"]] += r["size"]
    assert all(len(at) == 1 or weight[g] > share / 100 for g, at in shards.items())
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 0.03 * share


def test_columns_of_the_names_in_use_are_kept(spark, awkward):
    docs = awkward.withColumn("__ROW", F.lit("mine"))
    out = simhash.deduplicate(docs)
    assert out.columns == docs.columns and {r["__ROW"] for r in out.collect()} == {"mine"}
    path = scratch_path(spark, "shards")
    sharding.write_shards(docs.drop("shard"), path, 2)
    assert {r["__ROW"] for r in spark.read.parquet(path).collect()} == {"mine"}
    items = spark.createDataFrame([(5, "a", "b", "c"), (9, "a", "b", "c")], "length int, Sequence_ID string, OFFSET string, __Part string")
    packed = packing.pack(items, 10)
    assert sorted(packed.columns) == ["__Part", "length", "offset", "sequence_id"] and {r["__Part"] for r in packed.collect()} == {"c"}


@pytest.mark.parametrize("length", [None, 0, -3, 11, 2**40])
def test_rows_without_a_length_are_refused(spark, length):
    items = spark.createDataFrame([(5,), (length,), (9,)], "length long")
    with pytest.raises(ValueError, match="lengths have to be from 1 to 10"):
        packing.pack(items, 10)


def test_written_shards_hold_every_row(spark, awkward):
    path = scratch_path(spark, "shards")
    sharding.write_shards(awkward.drop("shard"), path, 3)
    back = spark.read.parquet(path)
    assert back.count() == len(ROWS) and back.select("shard", "slot").distinct().count() == len(ROWS)
    with pytest.raises(ValueError):
        sharding.write_shards(awkward, path)


# ---- urls -----------------------------------------------------------------------------------------


URLS = ["https://Example.ORG/es/1?x#y", "http://example.org/en/17", "http://notexample.org/es/", "ftp://a.com/fr/x", "http://com/de/", "nothing", None, "", "http://a.org", "http://a.org/", "x://a.b.example.org/en/2?://c.com/de/", "http://ÉXAMPLE.org/es/", "http://example.org/es", "a://" + "b" * 50_000 + ".org/"]


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = __import__("re").split("[/?#]", rest)[0]
    path = __import__("re").split("[?#]", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in urls.RULES if (host == (h := r.name.split("/", 1)[0]) or host.endswith("." + h)) and path.startswith("/" + r.name.split("/", 1)[1])]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


@pytest.mark.parametrize("inline", [1000, 0])
def test_url_rules(spark, inline):
    pages = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in enumerate(URLS)] + [(None, URLS[0], "", "", ""), (3, URLS[3], "", "", "")], "page_id long, url string, host string, path string, rule string")
    rows = urls.judge(cut(pages, "pages"), inline=inline).collect()
    assert len(rows) == len(URLS) + 2
    want = {(i, *plain_verdict(u)) for i, u in enumerate(URLS)} | {(None, *plain_verdict(URLS[0]))}
    assert {tuple(r) for r in rows} == want
    assert urls.judge(pages.limit(0), inline=inline).count() == 0


def test_rules_are_filed_under_their_rarest_token():
    rules = (urls.wildcard_rule("block", "/ads/banner*/x/"), urls.prefix_rule("allow", "example.org/en/1"), urls.Rule("block", "digits", r"\d{5}", ()))
    filed = urls.index(rules, {"ads": 50, "x": 2, "example": 9, "org": 90, "en": 30})
    assert filed == {"x": [0], "example": [1], "": [2]}


# ---- SentencePiece -----------------------------------------------------------------------------------


def test_pieces_are_those_of_the_library():
    import sentencepiece

    path = public_tokenizers.path(sentencepiece_fst.MODEL)
    ours, theirs = sentencepiece_fst.transducer(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = np.random.default_rng(4)
    parts = list("abcdefgh .,'\n▁é日 ()<>0123") + ["the ", "print(", "  ", "don't ", "\t", "http://a.b/c", "ing", "🎉", "\x00", "x" * 40]
    texts = ["".join(rnd.choice(parts, rnd.integers(0, 50))) for _ in range(1500)] + [t or "" for _, t, _ in ROWS if t is not LONG]
    for t in texts:
        ids = np.frombuffer(ours.encode(t), "<u4").tolist()
        assert ids == theirs.encode(t)
        assert ours.decode(np.array(ids, "<u4").tobytes()) == theirs.decode(ids)


def test_sentencepiece_query_against_the_library(spark):
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece_fst.MODEL))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in sentencepiece_fst.op8_sentencepiece(spark, "/root/testdata/sf0.001").collect():
        ids = theirs.encode(texts[r["doc_id"]])
        assert (r["n_pieces"], r["ids_crc32"], r["decoded_crc32"]) == (len(ids), crc(ids), zlib.crc32(theirs.decode(ids).encode()))


def test_sentencepiece_awkward(awkward, empty):
    path = public_tokenizers.path(sentencepiece_fst.MODEL)
    rows = sentencepiece_fst.encode_documents(awkward, path, keep=True).collect()
    assert len(rows) == len(ROWS) and all(r["round_trip"] for r in rows)
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in rows)
    assert sentencepiece_fst.encode_documents(empty, path).count() == 0


def field(number: int, value) -> bytes:
    """One field of a protocol-buffer message."""

    def varint(n: int) -> bytes:
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def model_file(pieces, trainer: dict, normaliser: bytes) -> bytes:
    rows = b"".join(field(1, field(1, p.encode()) + field(2, float(s)) + field(3, k)) for p, s, k in pieces)
    return rows + field(2, b"".join(field(n, v) for n, v in trainer.items())) + field(3, normaliser)


WHOLE = field(3, 1) + field(4, 0) + field(5, 1)


def held_against_the_library(raw: bytes, texts: list[str], decoding: bool = True):
    import sentencepiece

    ours, theirs = sentencepiece_fst.Transducer(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    for t, got in zip(texts, ours.encode_all(texts), strict=True):
        ids = np.frombuffer(got, "<u4").tolist()
        assert ids == theirs.encode(t), t
        if decoding:
            assert ours.decode(got) == theirs.decode(ids)


def unigram_pieces(fallback: bool):
    rnd = np.random.default_rng(9)
    chars = "abcdefgh.é0"
    pieces = [("<unk>", 0, 2), ("<s>", 0, 3)] + ([(f"<0x{b:02X}>", 0, 6) for b in range(256)] if fallback else [])
    words = {"".join(rnd.choice(list(chars), rnd.integers(1, 5))) for _ in range(400)} | set(chars)
    words |= {"\u2581" + w for w in list(words)[:150]} | {"\u2581", "\u2581\u2581", "and"}
    return pieces + [(w, -float(rnd.uniform(1, 12)), 1) for w in sorted(words)]


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_models(fallback):
    rnd = np.random.default_rng(6)
    texts = ["".join(rnd.choice(list("abcdefgh.é0  \u2581xß日🎉\n"), rnd.integers(0, 40))) for _ in range(1500)]
    own = [("<sep>", 0, 4), ("ab cd".replace(" ", ""), 0, 4)]
    for pieces in (unigram_pieces(fallback), unigram_pieces(fallback) + own):
        held_against_the_library(model_file(pieces, {3: 1} | ({35: 1} if fallback else {}), WHOLE), texts + ["<sep>a <sep>", "xabcdx abcd"])


def test_character_map():
    import sentencepiece

    spec = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    (inner,) = [v for k, v in sentencepiece_fst._fields(spec.serialized_model_proto()) if k == 3]
    rules = dict(sentencepiece_fst._fields(inner))[2]
    rnd = np.random.default_rng(7)
    texts = ["".join(rnd.choice(list("abcé ①ｱﾄﾞﬁ\u3000\t\n½ 가\u1100\u1161\u0301e"), rnd.integers(0, 30))) for _ in range(1500)]
    for trims in (0, 1):
        raw = model_file(unigram_pieces(True), {3: 1, 35: 1}, field(2, rules) + field(3, 1) + field(4, trims) + field(5, 1))
        held_against_the_library(raw, texts, decoding=False)
        sentencepiece_fst.Transducer(raw)


def test_user_pieces_of_a_byte_pair_model():
    with open(public_tokenizers.path(sentencepiece_fst.MODEL), "rb") as f:
        fields = list(sentencepiece_fst._fields(f.read()))
    own = {"\u2581the", "ing", "<", "ab"}
    out = b""
    for number, value in fields:
        if number == 1:
            d = dict(sentencepiece_fst._fields(value))
            if d[1].decode() in own:
                value = field(1, d[1]) + field(2, 0.0) + field(3, 4)
        out += field(number, value)
    rnd = np.random.default_rng(8)
    texts = ["".join(rnd.choice(["the", " ", "ing", "<", "cab", "bing", "x", "é", "\n", "  "], rnd.integers(0, 25))) for _ in range(800)]
    held_against_the_library(out, texts)


def test_weights_decide_the_path():
    pieces = [("<unk>", 0, 2), ("a", -1, 1), ("b", -1, 1), ("c", -1, 1), ("ab", -1.5, 1), ("bc", -3, 1), ("abc", -9, 1)]
    for better, want in ((-9.0, ["ab", "c"]), (-0.5, ["abc"])):
        m = sentencepiece_fst.Transducer(model_file(pieces[:-1] + [("abc", better, 1)], {3: 1}, field(3, 0) + field(4, 0) + field(5, 1)))
        assert [m.pieces[i][0] for i in np.frombuffer(m.encode("abc"), "<u4")] == want