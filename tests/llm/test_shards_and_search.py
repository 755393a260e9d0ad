"""Nearest neighbours and Hilbert sharding against brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuspack.llm.hilbert import hilbert_index, levels, shard_by_hilbert, write_shards
from corpuspack.llm.vptree import Router, Tree, nearest


def test_tree_is_exact_at_factor_one_and_close_above():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(3000, 8))
    points[100:120] = points[7]  # ties
    ids = np.arange(3000) * 3
    tree = Tree.build(ids, points)
    queries, own = points[:150], ids[:150]
    found, far = tree.search(own, queries, 10)
    d = np.sqrt(((queries[:, None] - points[None]) ** 2).sum(-1))
    d[np.arange(150), np.arange(150)] = np.inf
    want = [sorted(zip(row, ids))[:10] for row in d]
    assert [[i for _, i in w] for w in want] == found.tolist()
    loose, _ = tree.search(own, queries, 10, factor=1.3)
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(loose, found)])
    assert 0.9 <= recall <= 1
    few = Tree.build(ids[:3], points[:3]).search(own[:2], queries[:2], 10)
    assert (few[0] >= 0).sum(1).tolist() == [2, 2]


@pytest.mark.parametrize("shard_rows,block", [(20_000, 2000), (40, 7)])
def test_nearest(spark, shard_rows, block):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)], "x") for i in range(200)]
    rows += [(200 + i, rows[0][1], "x") for i in range(3)]
    rows += [(300, None, "x"), (310, [0.0] * 6, "x"), (320, [float("nan")] * 6, "x"), (None, [1.0] * 6, "x"), (330, [1.0, 2.0], "x"), (340, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = {}
    for r in nearest(df, df.where("vec_id % 10 = 0"), 10, 1.0, shard_rows, block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = {i: np.array(v, dtype=float) for i, v, _ in rows if i is not None and v and len(v) == 6 and np.isfinite(v).all() and any(v)}
    assert set(got) == {i for i in good if i % 10 == 0}
    for q, hits in got.items():
        want = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q)[:10]
        assert [(n + 1, i) for n, (_, i) in enumerate(want)] == [(n, i) for n, i, _ in hits]
        assert np.allclose([s for *_, s in hits], [s for s, _ in want], rtol=1e-14)
    assert nearest(df.limit(0), df.limit(0)).count() == 0


def test_nearest_for_repeated_query_ids_and_clusters(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 5)) * 40
    rows = [(i, (centres[i % 12] + rng.normal(size=5)).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = rows[:40:4] + [rows[8], (8, rows[9][1]), (9999, rows[5][1])]
    got = {}
    for r in nearest(df, spark.createDataFrame(asked, df.schema), 10, 1.0, 50).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    want = {}
    for q, v in asked:
        near = sorted((float(np.linalg.norm(np.array(v) - np.array(w))), i) for i, w in rows if i != q)[:10]
        want.setdefault(q, []).extend((n + 1, i, round(d, 9)) for n, (d, i) in enumerate(near))
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}


def test_router_rules_regions_out():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 5)) * 40
    points = np.concatenate([c + rng.normal(size=(100, 5)) for c in centres])
    router = Router(points[::3], 12)
    home, passed = router.place(points)
    router.bounds = {(a, c): (lo, hi) for a, c, lo, hi in passed}
    rows, regions = router.reach(points[:50], np.full(50, 3.0), 1.0)
    assert set(zip(range(50), home[:50])) <= set(zip(rows, regions)) and len(rows) < 50 * 12 / 3
    for q in range(50):  # every point within the distance lies in a region that the query reaches
        near = np.linalg.norm(points - points[q], axis=1) <= 3
        assert set(home[near]) <= set(regions[rows == q])


def test_hilbert_index_walks_the_grid(spark):
    for n, bits in ((2, 3), (3, 2)):
        side = 1 << bits
        df = spark.range(side**n)
        axes = [(F.floor(F.col("id") / side**i) % side).cast("int") for i in range(n)]
        rows = sorted(df.select(hilbert_index(axes, bits).alias("h"), *[a.alias(f"a{i}") for i, a in enumerate(axes)]).collect())
        assert [r[0] for r in rows] == list(range(side**n))
        for a, b in zip(rows, rows[1:]):  # neighbours on the curve differ by one step of one axis
            assert sum(abs(x - y) for x, y in zip(a[1:], b[1:])) == 1


def test_levels_keep_the_order(spark):
    rows = [(x,) for x in "a" * 50 + "b" * 5 + "c" * 30 + "d" * 15] + [(None,)]
    df = spark.createDataFrame(rows, "lang string")
    assert {r.lang: r.level for r in levels(df, "lang", 10).collect()} == {"a": 1, "b": 6, "c": 6, "d": 9}
    assert levels(df.limit(0), "lang", 10).count() == 0


def placed_by_hand(rows, shards):
    """Shard of each text: groups in the order of the curve, each where its middle byte falls."""
    size = {t: len((t or "").encode()) + 1 for t, _ in rows}
    total, at, out = sum(size[t] * n for (t, _), n in rows.items()), 0, {}
    for (t, _), n in sorted(rows.items(), key=lambda x: x[0][1]):
        out[t] = min(int((at + size[t] * n / 2) * shards / total), shards - 1)
        at += size[t] * n
    return out


def test_shards_by_hand(spark):
    rng = random.Random(4)
    texts = ["x" * rng.randint(0, 900) + str(i) for i in range(120)]
    rows = [(i, rng.choice(texts), rng.choice("abc"), rng.choice(["en", "de", None])) for i in range(500)]
    got = shard_by_hilbert(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), shards=5).collect()
    text = {i: t for i, t, _, _ in rows}
    order = {}
    for n, r in enumerate(sorted(got, key=lambda r: (r.shard, r.slot))):  # the order that the slots say
        order.setdefault(text[r.doc_id], n)
    counts = {}
    for t in text.values():
        counts[t] = counts.get(t, 0) + 1
    want = placed_by_hand({(t, order[t]): n for t, n in counts.items()}, 5)
    assert {text[r.doc_id]: r.shard for r in got} == want


def test_shards(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 300) + str(i), rng.choice("abc"), rng.choice(["en", "de", None])) for i in range(400)]
    rows += [(1000 + i, "the same text", rng.choice("abcdef"), "en") for i in range(60)]
    rows += [(2000, None, None, None), (2001, None, "a", "en"), (2002, "", "a", "en"), (2003, "é" * 4000, "a", "en"), (2003, "é" * 4000, "a", "en"), (None, "n", "a", "en")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, lang string, shard int")
    got = shard_by_hilbert(df).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and all(r.grown_shard is None for r in got)
    text = {r[0]: r[1] for r in rows}
    shards, of_text = {}, {}
    for r in got:
        t = text[r.doc_id]
        assert r.size == len((t or "").encode()) + 1 and r.text_crc32 == (None if t is None else zlib.crc32(t.encode()))
        shards.setdefault(r.shard, []).append(r)
        of_text.setdefault(t, set()).add(r.shard)
    assert sorted(shards) == list(range(8)) and all(len(s) == 1 for s in of_text.values())
    for s in shards.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
        curve = [r.hilbert for r in sorted(s, key=lambda r: r.slot)]
        assert curve == sorted(curve)
    sizes = [sum(r.size for r in s) for s in shards.values()]
    group = max(sum(r.size for r in got if text[r.doc_id] == t) for t in set(text.values()))
    assert max(sizes) - min(sizes) <= 2 * group
    assert shard_by_hilbert(df.limit(0)).count() == 0
    odd = df.withColumn("group", F.lit("g")).withColumn("nth", F.lit(3)).withColumn("id", F.lit("i"))  # nulls, repeats and clashing names
    write_shards(odd, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    of = lambda d: sorted(map(str, ((r.doc_id, r.text, r.source, r.lang, r.group, r.nth, r.id) for r in d.collect())))
    assert of(back) == of(odd)
    places = sorted((r.shard, r.slot) for r in back.collect())
    assert places == sorted((r.shard, r.slot) for r in got)
