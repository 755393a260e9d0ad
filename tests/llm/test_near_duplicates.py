"""Embedding and SimHash near-duplicates against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpuspack.llm.components import connected_components
from corpuspack.llm.embed_dedup import learn, near_vectors, plan, plan_tables
from corpuspack.llm.simhash import anchors, fingerprint, first_of_groups, shingle_hashes, simhash_groups


def least_reachable(ids, linked):
    label = dict(zip(ids, ids))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == least_reachable(sorted({x for e in real for x in e}), real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text, k):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for text in ["", " \n", "One", "one TWO", "ÄB c\x0bd\x1ce é", "a b c d e f g a b c", "  x y z"]:
        for k in (1, 3, 5):
            assert fingerprint(text.encode(), k) == brute_fingerprint(text, k)
    assert fingerprint(None, 3) == 0


def test_every_pair_within_three_bits_meets_at_a_home(spark):
    rng = random.Random(3)
    fps, pairs = [], []
    for _ in range(150):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, 3)):
            b ^= 1 << bit
        pairs.append((a, b))
        fps += [a, b]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    at = {}
    for r in anchors(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect():
        at.setdefault(r.fp, {}).setdefault(r.anchor, r.home)
    for a, b in pairs:
        a, b = at[signed(a)], at[signed(b)]
        assert any(x in b and (a[x] or b[x]) for x in a)


@pytest.mark.parametrize("block", [4096, 3])
def test_simhash_groups(spark, block):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(220)) for _ in range(6)]
    texts = list(base)
    for t in base:
        for _ in range(5):
            w = t.split()
            w[rng.randrange(len(w))] = "other"
            texts.append(" ".join(w))
    texts += [base[0]] * 4 + [base[1].upper(), "", None, " ", "one two", "long " * 30_000]
    ids = list(range(10, 10 + len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, "x") for i, t in zip(ids, texts)] + [(ids[0], texts[0], "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = simhash_groups(df, 3, block).collect()
    assert len(got) == len(rows)
    fp = {i: brute_fingerprint(t, 3) for i, t, _ in rows}
    linked = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3]
    want = least_reachable(sorted(fp), linked)
    assert len(set(want.values())) < len(fp) - 8
    assert all(r.component_id == want[r.doc_id] and r.fingerprint == f"{fp[r.doc_id]:016x}" for r in got)
    assert simhash_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4096, 3])
def test_first_of_groups(spark, block):
    """Copies with edits over a text of 300 words: those at 0.8 or more go, at 0.9 almost all do; others stay."""
    rng = random.Random(17)
    words = [f"w{i}" for i in range(3000)]
    rows, base = [], {}
    for k in range(40):
        text = [rng.choice(words) for _ in range(300)]
        rows.append((len(rows), " ".join(text), k))
        for edits in (1, 3, 6, 40):
            w = list(text)
            for at in rng.sample(range(300), edits):
                w[at] = "other"
            base[len(rows)] = (len(rows) - 1 if edits == 1 else base[len(rows) - 1][0], edits)
            rows.append((len(rows), " ".join(w), k))
    rows += [(9000, None, 0), (9001, "", 0), (9002, "one two", 0), (9003, "One  two", 0), (9004, "one three", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    kept = {r.doc_id for r in first_of_groups(df, 5, 0.8, block).collect()}
    sets = [set(shingle_hashes((t or "").encode(), 5).tolist()) for _, t, _ in rows]
    at = {i: n for n, (i, _, _) in enumerate(rows)}
    near = lambda a, b: len(sets[at[a]] & sets[at[b]]) >= 0.8 * len(sets[at[a]] | sets[at[b]])
    for i, (of, edits) in base.items():
        assert i in kept or any(near(i, j) for j in at if j < i and j != i)
        if edits == 40:
            assert i in kept
    gone = [edits for i, (_, edits) in base.items() if i not in kept]
    assert gone.count(1) == 40 and gone.count(3) >= 36 and gone.count(6) >= 25
    assert {9000, 9002, 9004} <= kept and not {9001, 9003} & kept and all(k % 5 or k in kept for k in range(200))
    assert first_of_groups(df.limit(0)).count() == 0


def test_pairs_at_the_similarity(spark):
    """Of pairs at 0.8 to 0.85, with words changed here and there or a part put in, at the end or taken off, 0.9 are found."""
    rng = random.Random(23)
    words, odds = [f"w{i}" for i in range(20_000)], [1 / (i + 3) for i in range(20_000)]
    sets = lambda t: set(shingle_hashes(t.encode(), 5).tolist())
    rows = []
    for k in range(160):
        n = (80, 200, 400, 2500)[k % 4]
        text = rng.choices(words, odds, k=n)
        while True:
            w, new = list(text), rng.choices(words, odds, k=round(n * rng.uniform(0.1, 0.26)))
            at = (rng.randrange(n), n, None, 0)[k // 4 % 4]
            if at is None:
                for i in rng.sample(range(n), max(1, round(n * rng.uniform(0.015, 0.03)))):
                    w[i] = rng.choice(words)
            elif at:
                w[at:at] = new
            else:
                w = w[len(new):]
            a, b = sets(" ".join(text)), sets(" ".join(w))
            if 0.8 <= len(a & b) / len(a | b) < 0.85:
                break
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(w))]
    kept = {r.doc_id for r in first_of_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {2 * k for k in range(160)} <= kept
    assert sum(2 * k + 1 not in kept for k in range(160)) >= 0.9 * 160


@pytest.mark.parametrize("block", [4096, 7])
def test_farther_candidates_are_verified(spark, block):
    """Families whose members are all near in bits, some of them similar: groups are those of brute force."""
    rng = random.Random(29)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for _ in range(6):
        family = [[rng.choice(words) for _ in range(250)]]
        for _ in range(24):
            w = list(rng.choice(family))
            for at in rng.sample(range(250), rng.choice((2, 4, 7, 9))):
                w[at] = rng.choice(words)
            family.append(w)
        rows += [(len(rows) + i, " ".join(w)) for i, w in enumerate(family)]
    sets = {i: set(shingle_hashes(t.encode(), 5).tolist()) for i, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = least_reachable(sorted(sets), linked)
    kept = {r.doc_id for r in first_of_groups(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
    firsts = set(want.values())
    assert len(firsts) > 12 and firsts <= kept and len(kept - firsts) <= 3


def test_equal_fingerprints_of_other_sets(spark):
    """Texts with the same pairs of words but other shingles stay apart; columns may have any name."""
    rows = [(1, "a b a b a b a b"), (2, "a b a b"), (3, "a b a b a b"), (4, "A b a B")]
    df = spark.createDataFrame([(i, t, "x", 1, "y", 2, 3) for i, t in rows], "doc_id long, text string, _id string, _hash int, _text string, _n int, node int")
    got = first_of_groups(df).collect()
    assert {r.doc_id for r in got} == {1, 2} and all(r[2:] == ("x", 1, "y", 2, 3) for r in got)


def test_plan_tables_and_rotation():
    for bits in (3, 8, 13):
        tables = plan_tables(bits, 0.93)
        assert (1 - (1 - np.arccos(0.93) / np.pi) ** bits) ** tables <= 0.005 < (1 - (1 - np.arccos(0.93) / np.pi) ** bits) ** (tables - 1)
    rng = np.random.default_rng(1)
    sample = rng.normal(size=(500, 16))
    sample /= np.linalg.norm(sample, axis=1)[:, None]
    codes = learn(sample, 8, 4)
    turn = codes.rotations[:, :16]
    assert np.allclose(turn.T @ turn, np.eye(16), atol=1e-8) and codes.keys(sample).max() < 256


def links_by_hand(rows, threshold=0.93):
    """Links of each row, by its place, and the ids' components, over rows of ``(vec_id, vector, label)``."""
    good = [(k, np.array(v, dtype=float) / np.abs(v).max()) for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    linked = [(k, m) for k, a in good for m, b in good if k < m and rows[k][2] == rows[m][2] and len(a) == len(b) and cos(a, b) >= threshold]
    count = [0] * len(rows)
    for k, m in linked:
        count[k] += 1
        count[m] += 1
    ids = sorted({r[0] for r in rows if r[0] is not None})
    return count, least_reachable(ids, [(rows[k][0], rows[m][0]) for k, m in linked])


@pytest.mark.parametrize("rows", [
    [(i, [1.0, 0.01 * i, 0.0], "b") for i in range(6)],
    [(1, [1.0, 0.0, 0.0], "b"), (1, [1.0, 0.001, 0.0], "b"), (2, [1.0, 0.0, 0.001], "b")],
    [(5, [1.0, 2.0], "x"), (4, [1.0, 2.0], "x"), (3, [1.0, 2.0], "x"), (2, [1.0, 2.0], "y"), (9, [2.0, 4.0], "x"), (1, [1.0, 2.0, 0.0], "x"), (0, [1.0, 2.0, 0.1], "x")],
    [(i, [1e300 * (1 + i % 2), 1e300], "x") for i in range(4)] + [(7, [], "x"), (8, [1.0], "x"), (6, [-1.0], "x"), (10, [3.0], "x")],
], ids=["tight", "repeated ids", "equal and several lengths", "huge"])
def test_near_vectors_of_small_tables(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label string, n int")
    got = sorted(tuple(r) for r in near_vectors(df, 0.93).collect())
    count, component = links_by_hand(rows)
    assert got == sorted((i, n, component[i], component[i] == i) for (i, _, _), n in zip(rows, count))


@pytest.mark.parametrize("block", [2048, 5])
def test_near_vectors(spark, block):
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            centre = rng.normal(size=12)
            for _ in range(rng.integers(1, 9)):
                v = centre + rng.normal(size=12) * rng.choice([0.0, 0.05, 0.12, 0.3])
                rows.append((n, [float(np.float32(x)) for x in v], label, "extra"))
                n += 1
    for bad in (None, [0.0] * 12, [float("nan")] + [1.0] * 11, [None] + [1.0] * 11, [float("inf")] * 12, [], [1.0] * 5):
        rows.append((n, bad, 0, "extra"))
        n += 1
    rows.append((None, rows[0][1], 0, "extra"))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string")
    got = {r.vec_id: r for r in near_vectors(df, 0.93, block=block, aim=0.99999).collect()}
    count, want = links_by_hand([r[:3] for r in rows])
    assert sum(count) > 40 and len(got) == len(rows)
    for (i, *_), n in zip(rows, count):
        if i is not None:
            assert got[i].n_links == n and got[i].component_id == want[i] and got[i].kept == (want[i] == i)
    assert got[None].n_links == 0 and got[None].component_id is None and not got[None].kept
    assert near_vectors(df.limit(0)).count() == 0


def test_recall_on_the_given_vectors(spark):
    """Of all links of the smallest table, against brute force."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    v = np.array([r.embedding for r in rows], dtype=float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    label = np.array([r.label for r in rows])
    for threshold in (0.93, 0.4):  # none of these pairs reaches the first; the planted ones below do
        want = (v @ v.T >= threshold) & (label[:, None] == label[None])
        total = int(want.sum()) - len(v)
        got = near_vectors(df, threshold).agg(F.sum("n_links")).first()[0]
        assert 0.9 * total <= got <= total


def planted(rng, length, n, d=64):
    """Unit vectors around a mean of about ``length``, one after the other in pairs of cosine 0.93 to 0.95."""
    common = rng.normal(size=d)
    u = rng.normal(size=(n, d))
    u = u / np.linalg.norm(u, axis=1)[:, None] * np.sqrt(1 - length**2) + length * common / np.linalg.norm(common)
    u /= np.linalg.norm(u, axis=1)[:, None]
    w = rng.normal(size=(n, d))
    w -= (w * u).sum(1)[:, None] * u
    w /= np.linalg.norm(w, axis=1)[:, None]
    cos = rng.uniform(0.9301, 0.95, size=n)[:, None]
    return np.stack([u, cos * u + np.sqrt(1 - cos**2) * w], axis=1).reshape(-1, d)


@pytest.mark.parametrize("length, largest", [(0.0, 5_000), (0.7, 5_000), (0.8, 5_000), (0.9, 5_000), (0.8, 100_000)])
def test_planted_pairs_meet_around_any_mean(length, largest):
    v = planted(np.random.default_rng(11), length, 2_500)
    codes = plan(v, np.zeros(len(v), dtype=int), largest, 0.93)
    keys = codes.keys(v)
    assert (keys[::2] == keys[1::2]).any(1).mean() >= 0.99
    if length < 0.9:  # not all vectors at once
        assert codes.bits > 0


@pytest.mark.parametrize("length", [0.0, 0.8])
def test_links_of_vectors_with_a_common_direction(spark, length):
    v = planted(np.random.default_rng(12), length, 2_500).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    v = v.astype(float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    want = int((v @ v.T >= 0.93).sum()) - len(v)
    got = near_vectors(df, 0.93).agg(F.sum("n_links")).first()[0]
    assert want >= 5_000 and 0.99 * want <= got <= want


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_the_given_labels_go_through_codes(spark, sf):
    """Pairs at the threshold planted into the given vectors are found by codes that leave most pairs apart."""
    path = f"/root/testdata/sf{sf}/embeddings.parquet"
    rows = spark.read.parquet(path).collect()
    rng = np.random.default_rng(4)
    v = np.array([r.embedding for r in rows], dtype=float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    w = rng.normal(size=v.shape)
    w -= (w * v).sum(1)[:, None] * v
    w /= np.linalg.norm(w, axis=1)[:, None]
    near = 0.9301 * v + np.sqrt(1 - 0.9301**2) * w
    label = [r.label for r in rows]
    largest = max(label.count(x) for x in set(label))
    codes = plan(v, label, largest, 0.93)
    mine, theirs = codes.keys(v), codes.keys(near)
    assert codes.bits >= 4 and codes.tables > 1 and (mine == theirs).any(1).mean() >= 0.98
    apart = ~(mine[:, None] == mine[None]).any(2) if len(v) < 1000 else ~(mine[:500, None] == mine[None, :500]).any(2)
    assert apart.mean() > 0.5
    every = [(r.vec_id, x.tolist(), r.label) for r, x in zip(rows, v)] + [(1_000_000 + r.vec_id, x.tolist(), r.label) for r, x in zip(rows, near)]
    got = near_vectors(spark.createDataFrame(every, "vec_id long, embedding array<double>, label int"), 0.93)
    found = got.where("vec_id >= 1000000 and component_id = vec_id - 1000000").count()
    assert found >= 0.98 * len(rows)


def test_few_links_stay_in_one_partition_and_texts_are_shuffled_once(spark):
    links = spark.createDataFrame([(i, i // 2) for i in range(1, 300)], "a long, b long").repartition(7)
    component = connected_components(links)
    assert component.rdd.getNumPartitions() == 1
    assert {(r.node, r.component) for r in component.collect()} == {(i, 0) for i in range(300)}
    docs = spark.createDataFrame([(i if i % 3 else None, f"some words of text {i // 2} and more of them") for i in range(60)], "doc_id long, text string")
    said = first_of_groups(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in said[said.index("Window [") : said.index("Join [")]
