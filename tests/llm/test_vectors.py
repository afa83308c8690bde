"""Vector search against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from faciesforge.llm import ann, topk
from faciesforge.llm._util import cut

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int, query_id string"


def table(spark, rows):
    return cut(spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], 1, 2.0, 3, "x") for i, v in rows], SCHEMA), "vectors")


def awkward_rows():
    rnd = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rnd.integers(-3, 4, 6)]) for i in range(300)]
    rows += [(i, [1.0, 2, 3, 4, 5, 6]) for i in range(300, 400)]  # many copies, many ties
    rows += [(400, None), (450, [1.0, None, 1, 1, 1, 1]), (500, [float("nan")] * 6), (550, [float("inf"), 0, 0, 0, 0, 0]), (600, [0.0] * 6), (650, [1.0, 2.0]), (660, [3.0, 1.0]), (None, [1.0] * 6)]
    return rows + [rows[5], rows[100], (100, [9.0, 9, 9, 9, 9, 9])]


def brute(rows, step, k, quantise, zero):
    good = [(i, [np.float64(np.float32(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))]
    good = [(i, [int(np.floor(256 * x)) for x in v] if quantise else v) for i, v in good]
    out = {}
    for q, v in good:
        if q % step == 0:
            for c, w in good:
                if c != q and len(w) == len(v):
                    s = sum(a * b for a, b in zip(v, w, strict=True))
                    out[q, c] = max(out.get((q, c), s), s)
    by = {}
    for (q, c), s in out.items():
        by.setdefault(q, []).append((-s, c))
    return sorted((q, r + 1, c, -s) for q, hits in by.items() for r, (s, c) in enumerate(sorted(hits)[:k]))


def test_topk_is_exact(spark, monkeypatch):
    rows = awkward_rows()
    v = table(spark, rows)
    want = brute(rows, 50, 5, True, True)
    got = lambda: sorted(tuple(r) for r in topk.search(v, v.filter("vec_id % 50 = 0"), 5).select("query_id", "rank", "vec_id", "score").collect())
    assert got() == want
    for name, n in (("BLOCK", 3), ("CHUNK", 50), ("HELD", 20)):
        monkeypatch.setattr(topk, name, n)
    assert got() == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # partitions of chunks against partitions of blocks
    assert got() == want
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert topk.search(v.limit(0), v.limit(0), 5).count() == 0
    assert topk.search(v.filter("vec_id = 50"), v.filter("vec_id = 50"), 5).count() == 0


@pytest.mark.parametrize("falling", [False, True])
def test_cutoff_spares_partial_scores(falling):
    rnd = np.random.default_rng(2)
    x = rnd.standard_normal((32_768, 64)) * (0.9 ** np.arange(64) if falling else 1.0)
    y = topk.quantised(x / np.linalg.norm(x, axis=1, keepdims=True))
    q, computed, seen, got = y[:100], 0, [[] for _ in range(100)], []
    same = np.arange(100)[:, None] == np.arange(len(y))[None, :]
    for i in range(0, len(y), topk.CHUNK):
        (a, b, s), n = topk.leading(q, y[i : i + topk.CHUNK], same[:, i : i + topk.CHUNK], 5)
        computed += n
        for at, v in zip(a.tolist(), s.tolist(), strict=True):
            seen[at].append(v)
    cutoff = np.array([sorted(v)[-5] for v in seen])
    for i in range(0, len(y), topk.CHUNK):
        (a, b, s), n = topk.sufficient(q, y[i : i + topk.CHUNK], same[:, i : i + topk.CHUNK], cutoff)
        computed += n
        got += zip(a.tolist(), (b + i).tolist(), s.tolist(), strict=True)
    total = q @ y.T
    total[same] = -np.inf
    want = np.nonzero(total >= cutoff[:, None])
    assert sorted(got) == sorted(zip(*(w.tolist() for w in want), total[want].tolist(), strict=True))
    assert computed < (0.5 if falling else 1.0) * topk.LISTS * total.size


def test_topk_beyond_doubles(spark):
    rows = [(0, [3e38, 1.0]), (1, [3e38, 1.0]), (2, [1e15, 1.0]), (3, [-3e38, 1.0]), (4, [0.5, -0.001])]
    v = table(spark, rows)
    got = [(r["vec_id"], r["score"]) for r in topk.search(v, v.filter("vec_id = 0"), 5).orderBy("rank").collect()]
    assert [g[0] for g in got] == [1, 2, 4, 3] and got[0][1] == 2**63 - 1 and got[3][1] == -(2**63)


def test_topk_query_matches_sql(spark, duck):
    want = sorted(duck.sql(topk.ORACLE).fetchall())
    assert sorted(tuple(r) for r in topk.op1_exact_topk(spark, "/root/testdata/sf0.01").collect()) == want


def test_factor_one_is_exact(spark, monkeypatch):
    rows = awkward_rows()
    v = table(spark, rows)
    want = brute(rows, 20, 20, False, False)
    for shard in (64, 8192):
        trees = cut(ann.index(v, shard, 16), "trees")
        assert trees.agg({"n": "sum"}).first()[0] == sum(1 for i, x in rows if i is not None and x and all(c is not None and np.isfinite(c) for c in x) and any(x))
        got = sorted(tuple(r) for r in ann.search(trees, v.filter("vec_id % 20 = 0"), 20, 1.0).select("query_id", "rank", "vec_id", "score").collect())
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(ann, "HELD", 50)
    assert ann.search(trees, v.filter("vec_id % 20 = 0"), 20, 1.0).count() == len(want)
    assert ann.search(cut(ann.index(v.limit(0)), "trees"), v.limit(0), 20).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    found = {}
    for r in ann.op10_nearest_neighbours(spark, d).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hits, total = hits + len(best & found[q]), total + 20
    assert hits / total >= 0.95


@pytest.mark.parametrize("dims", [3, 6, 8, 12, 24, 64])
def test_recall_at_low_intrinsic_dimension(spark, dims):
    rnd = np.random.default_rng(dims)
    x = rnd.standard_normal((4000, dims)) @ rnd.standard_normal((dims, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    v = table(spark, list(enumerate(x.tolist()))).coalesce(1)
    found = {}
    for r in ann.search(cut(ann.index(v), "trees"), v.filter("vec_id % 20 = 0"), 20).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    s = x[::20].astype(float) @ x.T.astype(float)
    s[np.arange(len(s)), np.arange(0, len(x), 20)] = -np.inf
    best = np.argsort(-s, axis=1)[:, :20]
    assert sum(len(found[20 * i] & set(b.tolist())) for i, b in enumerate(best)) / best.size >= 0.9


DOUBLES = "vec_id long, embedding array<double>"


@pytest.mark.parametrize("scale", [1e-140, 1e-9, 1e-7, 1.0, 1e150, "mixed"])
def test_factor_one_is_exact_at_every_scale(spark, scale):
    rnd = np.random.default_rng(9)
    x = rnd.standard_normal((1500, 16))
    x[100:140] = x[100]  # ties
    x = x * (10.0 ** rnd.integers(-12, 12, 1500)[:, None] if scale == "mixed" else scale)
    ids = np.r_[np.arange(1480), np.arange(0, 100, 5)]  # repeated ids
    v = spark.createDataFrame(list(zip(ids.tolist(), x.tolist(), strict=True)), DOUBLES).coalesce(1)
    got = {}
    for r in ann.search(cut(ann.index(v, 512, 16), "trees"), v.filter("vec_id % 20 = 0"), 10, 1.0).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    for q in range(0, 1480, 20):
        score = np.max([x @ x[i] for i in np.flatnonzero(ids == q)], axis=0)
        best = {}
        for i, s in zip(ids.tolist(), score.tolist(), strict=True):
            if i != q:
                best[i] = max(best.get(i, -np.inf), s)
        want = sorted(best, key=lambda i: (-best[i], i))[:10]
        found = np.array(sorted(got[q].values(), reverse=True))
        assert np.allclose(found, [best[i] for i in want], rtol=1e-10, atol=0) and len(set(got[q]) ^ set(want)) <= 2 * sum(100 <= i < 140 for i in want)


def test_huge_vectors_are_found_in_their_true_order(spark):
    x = np.random.default_rng(10).standard_normal((600, 8))
    v = spark.createDataFrame(list(enumerate((x * 1e160).tolist())), DOUBLES).coalesce(1)
    for factor in (1.0, None):
        found = {}
        for r in ann.search(cut(ann.index(v), "trees"), v.filter("vec_id % 20 = 0"), 10, factor).collect():
            found.setdefault(r["query_id"], set()).add(r["vec_id"])
        s = x[::20] @ x.T
        s[np.arange(len(s)), np.arange(0, 600, 20)] = -np.inf
        hits = [len(found[20 * i] & set(np.argsort(-row)[:10].tolist())) for i, row in enumerate(s)]
        assert sum(hits) >= (10 if factor else 9.5) * len(hits)


@pytest.mark.parametrize("length", [0.3, 1.0, 7.0])
def test_a_factor_means_the_same_at_every_length_of_a_query(length):
    rnd = np.random.default_rng(11)
    x = rnd.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree, ids = ann.build(np.arange(6000), x), np.arange(0, 6000, 20)
    a, b, score = ann.Search(tree, ids, length * x[ids], 20, 3.0).run()
    s = x[ids] @ x.T
    s[np.arange(len(ids)), ids] = -np.inf
    kth = np.sort(s, axis=1)[:, -20]
    found = np.bincount(a // 20, weights=score >= length * kth[a // 20] - 1e-9, minlength=len(ids)) / 20
    assert found.mean() >= 0.98 and (found >= 0.9).mean() >= 0.98
    # a cutoff leaves all that reach it, at factor one exactly that
    a, b, _ = ann.Search(tree, ids, length * x[ids], 20, 1.0, length * kth).run()
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted((ids[i], j) for i, j in zip(*np.nonzero(s >= kth[:, None] - 1e-12), strict=True))
