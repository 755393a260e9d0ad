"""I-Match fingerprints, importance resampling and hard negatives against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuspack.llm import bond, imatch
from corpuspack.llm.imatch import ImatchOptions, edit_robustness, fingerprints
from corpuspack.llm.resampling import ResampleOptions, feature_buckets, resample, resampled_documents
from corpuspack.llm.selection import cutoff, first_ranked

NAMES = ("score", "rank", "k0", "fingerprint", "term", "n", "part", "edge", "_at", "label2", "block", "share", "v", "width")


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(1, 120)) for _ in range(150)] + [None, "", "!!!", "ÄÖ ünï 東京 x", "A" * 5000, "same text here", "same text here", "w1 " * 40_000]
    found = [(i * 3, t) for i, t in enumerate(texts)]
    return found + [(None, "no id at all"), (6, "an id that repeats"), (6, found[2][1])]


def table(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.select("*", *[F.lit(1).alias(n) for n in NAMES]).repartition(5)


# --- selection ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("k", [0, 1, 7, 500, 999, 1000, 5000])
def test_first_ranked(spark, k):
    rng = random.Random(k)
    rows = [(rng.randrange(40), i) for i in range(990)] + [(0, 0)] * 10
    df = spark.createDataFrame(rows, "a long, b long").repartition(7)
    got = [(r.a, r.b, r["rank"]) for r in first_ranked(df, ["a", "b"], k).collect()]
    want = sorted(rows)
    assert len(got) == 1000 and sorted((r[2], r[0], r[1]) for r in got if r[2]) == [(i + 1, *x) for i, x in enumerate(want[:k])]
    assert cutoff(df, ["a", "b"], k) == (want[k - 1] if 0 < k <= 1000 else None)


# --- importance resampling ---------------------------------------------------------------------------------


def words_of(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features_of(text):
    w = words_of(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(docs, target, percent=5, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for x in texts for f in features_of(x)) for texts in ([d[1] for d in docs], target))
    gain = [math.floor(1000 * math.log(((t[b] + 1) * float(s.total() + 10_000)) / ((s[b] + 1) * float(t.total() + 10_000)))) for b in range(10_000)]
    out = []
    for i, text in docs:
        f = features_of(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    free = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for n, r in enumerate(free[: percent * len(free) // 100]):
        r[4] = n + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("percent", [5, 60, 100])
def test_resample(spark, rows, percent):
    target = [prose(random.Random(9), 50, 60), None, "", "東京 x"]
    got = resample(table(spark, rows), spark.createDataFrame([(t, 1) for t in target], "text string, n long"), ResampleOptions(percent=percent))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_resample(rows, target, percent)


def test_resample_of_nothing(spark, rows):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample(none, none).count() == 0
    assert resample(table(spark, rows), none).count() == len(rows)
    drawn = resampled_documents(table(spark, rows[:100]), table(spark, rows[50:60]).select("text"), ResampleOptions(percent=10))
    assert set(NAMES) < set(drawn.columns) and drawn.count() == sum(r[4] is not None for r in plain_resample(rows[:100], [r[1] for r in rows[50:60]], 10))


def test_pieces_of_a_text_have_the_features_of_the_whole(monkeypatch):
    from corpuspack.llm import words

    text = prose(random.Random(1), 3000).encode()
    whole = Counter(b for _, of in feature_buckets(text, 1000) for b in of.tolist())
    monkeypatch.setattr(words, "PIECE", 17)
    parts = list(feature_buckets(text, 1000))
    assert len(parts) > 100 and whole == Counter(b for _, of in parts for b in of.tolist()) and sum(n for n, _ in parts) == 3000


# --- fingerprints ------------------------------------------------------------------------------------------


def test_edits_are_the_next_documents_start(spark, rows):
    found = [r for r in rows if r[0] != 6] + [(6, "just once, and then no more of it")]
    got = {r.doc_id: r for r in edit_robustness(table(spark, found)).collect()}
    order = sorted(found, key=lambda r: (r[0] is None, r[0] or 0))
    assert len(got) == len(found)
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        put = len(text) // 4
        edited = text[: len(text) - put] + following[:put]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if edited == text:
            assert r.edited_fingerprint == r.fingerprint and r.near_edited == 1
    by_text = {}
    for i, text in found:
        by_text.setdefault(text or "", set()).add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and len(set.union(*by_text.values())) == len(by_text)
    long = [r for r in got.values() if 200 < r.n_chars < 5000]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.95 * len(long)
    assert sum(r.near_edited for r in long) / len(long) > 3 * sum(r.near_next for r in long) / len(long)


def test_lexicon_is_the_band(spark, rows):
    texts = [t or "" for _, t in rows]
    df = Counter(w for t in texts for w in (set(words_of(t)) or {None}))
    import xxhash

    options = ImatchOptions(least_idf=1.0, most_idf=3.5)
    want = sorted(xxhash.xxh3_64_intdigest(w.encode()) for w, n in df.items() if w and 1.0 <= math.log(len(texts) / n) <= 3.5)
    assert imatch.lexicon(table(spark, rows), options).tolist() == want
    thin = imatch.lexicon(table(spark, rows), ImatchOptions(1.0, 3.5, max_terms=50)).tolist()
    assert 0 < len(thin) <= 50 and set(thin) < set(want)


def test_terms_of_the_band_that_are_not_sent_count_too(spark, rows):
    docs = table(spark, [r for r in rows if r[0] is not None])
    whole, thin = ImatchOptions(1.0, 3.5), ImatchOptions(1.0, 3.5, max_terms=50)
    few, rest = imatch.band_of(docs, thin)
    assert sorted([*few.tolist(), *(r.term % 2**64 for r in rest.collect())]) == imatch.lexicon(docs, whole).tolist()
    said = lambda options: sorted(map(str, edit_robustness(docs, options).collect()))
    assert said(thin) == said(whole)
    said = lambda options: sorted(map(str, fingerprints(docs, options).collect()))
    assert said(thin) == said(whole)


def test_edited_texts_are_not_stored_on_the_way(spark, rows):
    plan = edit_robustness(table(spark, rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan.lower()
    nulls = [(None, f"text {i} without an id") for i in range(40)]
    got = edit_robustness(table(spark, nulls)).collect()
    assert len(got) == 40 and len({r.edited_sha256 for r in got}) == 40


def test_fingerprints_of_odd_tables(spark, rows):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert edit_robustness(none).count() == 0 and fingerprints(none).count() == 0
    one = edit_robustness(spark.createDataFrame([(5, "the only text there is")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    repeated = edit_robustness(table(spark, rows))
    assert repeated.count() == len(rows)
    said = fingerprints(table(spark, rows))
    assert said.count() == len(rows) and said.columns.count("fingerprint") == 1 and set(NAMES) <= set(said.columns)


# --- hard negatives ----------------------------------------------------------------------------------------


def plain_negatives(rows, anchors, k=5, m=10):
    seen, out = {}, []
    for i, label, x in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v = [math.floor(256 * c) for c in x]
        seen[i] = min(seen.get(i, (label, v)), (label, v))
    score = lambda a, b: sum(p * q for p, q in zip(a, b))
    for a in sorted(set(anchors) & seen.keys()):
        label, v = seen[a]
        near = sorted((-score(v, w), i) for i, (other, w) in seen.items() if i != a and other == label and len(w) == len(v))[:k]
        for s, p in near:
            far = sorted((-score(v, w), i) for i, (other, w) in seen.items() if other != label and len(w) == len(v) and 30 * -s <= 100 * score(v, w) <= 90 * -s)[:m]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i) in enumerate(far)]
    return sorted(out)


@pytest.mark.parametrize("block,width", [(4096, 24), (7, 24), (50, 3)])
def test_hard_negatives(spark, monkeypatch, block, width):
    monkeypatch.setattr(bond, "BLOCK_ROWS", block)
    monkeypatch.setattr(bond, "BATCH_ROWS", 3)
    monkeypatch.setattr(bond, "GROUP_BATCHES", 2)
    rng = random.Random(width)
    centre = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    rows = []
    for i in range(260):
        c = centre[rng.randrange(4)]
        rows.append((i, rng.choice([0, 0, 0, 1, 2]), [x + rng.gauss(0, 0.6) for x in c]))
    rows += [(i, i % 3, centre[0]) for i in range(300, 340)]  # ties
    rows += [(400, None, centre[1]), (None, 1, centre[1]), (402, 1, None), (403, 1, [float("nan")] * width), (404, 1, [None, *centre[1][1:]]), (405, 1, [float("inf")] * width)]
    rows += [(406, 1, []), (407, 2, []), (408, 1, centre[1] + [1.0]), (409, 2, centre[1] + [1.0]), (410, 1, centre[1] + [1.0]), (411, 1, [0.0] * width), (20, 2, centre[2]), (20, 2, centre[2])]
    anchors = [i for i in range(0, 420, 10)] + [408, 406, 9999]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("block", F.lit("x")).repartition(3)
    asked = spark.createDataFrame([(a,) for a in [*anchors, None, 10, 10]], "vec_id long")
    got = sorted(tuple(r) for r in bond.hard_negatives(vectors, asked).collect())
    assert got == plain_negatives(rows, anchors) and len(got) > 200
    assert bond.hard_negatives(vectors.limit(0), asked).count() == 0


def test_the_scan_drops_candidates_before_all_dimensions_are_read():
    import numpy as np

    rng = np.random.default_rng(0)
    scale = 256 * 0.9 ** np.arange(64)
    v = np.floor(rng.normal(size=(2000, 64)) * scale)
    block = bond.Block({"ids": np.arange(2000).tobytes(), "of": np.zeros(2000, np.int64).tobytes(), "vectors": v.tobytes(), "width": 64})
    left = []

    def alive(low, high):
        keep = high >= bond._kth(low, 5)
        left.append(int(keep.sum()))
        return keep

    block.scan(v[0], np.arange(1, 2000), alive)
    assert left == sorted(left, reverse=True) and left[-1] < 100 and left[3] < 1500
