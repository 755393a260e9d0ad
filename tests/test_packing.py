"""Packing against a plain sequential statement of the rules, and round trips over awkward texts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuspack.functions import text as T
from corpuspack.operators import packing as P
from corpuspack.operators.codebook import decode
from corpuspack.operators.paging import line_pages, paginate

LOG = "\n".join(f"2026-01-01T00:00:0{i % 10}Z INFO svc=api{i % 3} path=/v1/users method=GET status=200 msg=ok" for i in range(30)) + "\n"
AWKWARD = [
    "", "a", "xyz unique once only", LOG, "ERROR timeout retry=true queue=default\n" * 20 + "INFO status=200 msg=ok\n" * 20,
    "⟦A⟧ taken already " * 12, "<<PDA>> and ⟧ " * 15, "one line\r\nanother line here\r\n" * 9, "part\x1cof\x85a line that repeats " * 8,
    "no break space here " * 10, "é ½ \U0001f600 astral words here " * 12, " leading and trailing  ", "\n\n\n", "a b a b a b a b a b a b",
]


def rows(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")


def expected_dictionary(text, min_freq=3, max_ngram=10, limit=256, use_chars=False):
    """The chosen patterns, from counting everything and choosing one by one."""
    units, score = text.split(), lambda c, n: (c - 1) * (n - 6) - 6

    def best(found, need, most):
        counts = Counter(found)
        order = list(counts)  # first seen first; sorting is stable
        kept = [p for p in order if counts[p] >= need and score(counts[p], len(p)) > 0]
        kept.sort(key=lambda p: (score(counts[p], len(p)), len(p), counts[p]), reverse=True)
        return [(p, counts[p]) for p in kept[:most]]

    grams = [" ".join(units[i : i + n]) for n in range(min(max_ngram, len(units)), 1, -1) for i in range(len(units) - n + 1)]
    groups = [best([g for g in grams if len(g) >= 8], min_freq, 500), best([x for x in text.splitlines() if len(x) >= 16], max(2, min_freq - 1), 300)]
    if use_chars:
        groups.append(best([text[i : i + n] for n in (32, 24, 16, 12) for i in range(0, len(text) - n + 1, max(1, n // 4))], min_freq, 200))
    merged = {}
    for group in groups:
        for p, c in group:
            merged[p] = max(c, merged.get(p, 0))
    order = sorted(merged, key=lambda p: (score(merged[p], len(p)), len(p), merged[p]), reverse=True)
    pre, suf = ("<<PD", ">>") if "⟦" in text or "⟧" in text else ("⟦", "⟧")
    chosen = []
    for p in order:
        n = len(chosen)
        size = len(pre) + len(suf) + (1 if n < 26 else 2 if n < 702 else 3)
        if n < limit and pre not in p and suf not in p and merged[p] * (len(p) - size) - (size + len(p) + 8) > 0:
            chosen.append(p)
    return chosen


def test_dictionary_as_chosen_one_by_one(spark):
    rng = random.Random(4)
    words = ["alpha", "be", "gamma delta", "x", "status=200", "⟦", "end\n", "request_id=abc12345"]
    texts = AWKWARD + [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(25)]
    texts.append(" ".join(f"some{i}pattern other{i}pattern" for i in range(60) for _ in range(4)))  # names of two letters
    for chars in (False, True):
        found = P.build_dictionary(rows(spark, texts), ["id"], P.FlatOptions(use_char_ngrams=chars)).orderBy("id", "ord").collect()
        by = {i: [] for i in range(len(texts))}
        for r in found:
            by[r.id].append(r.pattern)
        for i, text in enumerate(texts):
            assert by[i] == expected_dictionary(text, use_chars=chars), (chars, text[:60])


def test_flat_round_trip(spark):
    packed = P.flat_pack(rows(spark, AWKWARD), ["id"], P.FlatOptions(min_freq=2))
    got = {r.id: r for r in packed.withColumn("back", decode(F.col("encoded"), F.col("dictionary"))).collect()}
    assert {i: r.back for i, r in got.items()} == dict(enumerate(AWKWARD))
    assert got[2].encoded == AWKWARD[2] and not got[2].dictionary
    assert got[5].meta_style == "ascii" and got[3].dictionary_entries > 0
    assert got[3].compressed_tokens < got[3].original_tokens


def test_literal_only_drops_what_never_occurs(spark):
    text = "one two\nthree four " * 9
    found = P.build_dictionary(rows(spark, [text]), ["id"], P.FlatOptions(literal_only=True)).collect()
    assert found and all(r.pattern in text for r in found)


def test_hierarchical_round_trip(spark):
    texts = [LOG * 5, '{"event":"login","user":"ann","ok":true}\n' * 40, "", "short"]
    options = P.HierarchicalOptions(page_size=800)
    pages = P.encode_pages(rows(spark, texts), ["id"], options)
    assert {r.id: r.text for r in P.hierarchical_unpack(pages, ["id"]).collect()} == dict(enumerate(texts))
    packed = {r.id: r for r in P.hierarchical_pack(rows(spark, texts), ["id"], options, pages).collect()}
    assert packed[0].n_pages == -(-len(texts[0]) // 800) and packed[0].packed_prompt.startswith("HIERARCHICAL PAGEINDEX")
    assert packed[0].page_index.startswith('[{"page_id": 0, "fingerprint": "L800|')
    assert packed[2].n_pages == 1 and packed[0].local_dict_total > 0


def test_pages(spark):
    texts = ["", "a", "abcd", "abcde", "😀" * 9]
    got = paginate(rows(spark, texts), ["id"], 4).orderBy("id", "page_id").collect()
    assert [(r.id, r.page_id, r.text) for r in got] == [(i, p, t[p * 4 : p * 4 + 4]) for i, t in enumerate(texts) for p in range(max(1, -(-len(t) // 4)))]
    with pytest.raises(ValueError):
        paginate(rows(spark, texts), ["id"], 0)


def test_line_pages(spark):
    texts = ["", "ab\ncd\nef", "abcdef\ngh\n", "a\n\n\nb\n"]
    got = {}
    for r in line_pages(rows(spark, texts), ["id"], 4).orderBy("id", "page_id").collect():
        got.setdefault(r.id, []).append(r.text)
    assert got == {1: ["ab\ncd\n", "ef"], 2: ["abcdef\n", "gh\n"], 3: ["a\n\n\n", "b\n"]}


def test_text_functions_as_python_has_them(spark):
    texts = [t for t in AWKWARD if t] + ["a\x0bb\x0cc\x1dd\x1ee f\r\ng\rh", "　x y ", "tail\n"]
    df = rows(spark, texts).select("id", "text", T.units(F.col("text")).alias("u"), T.lines(F.col("text")).alias("l"), T.strip(F.col("text")).alias("s"), T.token_estimate(F.col("text")).alias("n"))
    for r in df.collect():
        assert r.u == r.text.split() and r.l == r.text.splitlines() and r.s == r.text.strip() and r.n == (len(r.text) + 3) // 4


def test_template_and_fingerprint(spark):
    import hashlib

    a, b = rows(spark, ["\n id 12 ABCDEFab\nx", " id 7 ffffffff\nx"]).select(T.template_id(F.col("text")).alias("t"), T.page_fingerprint(F.col("text")).alias("f")).collect()
    assert a.t == hashlib.sha1(b"\n id # #hex#\nx").hexdigest()[:16]
    assert a.t != b.t and b.f == hashlib.sha1(b" id 7 ffffffff\nx").hexdigest()[:12] + "|id 7 ffffffff"
    T.register(spark)
    assert spark.sql("select token_est('abcde'), template_id('id 5')").first() == (2, hashlib.sha1(b"id #").hexdigest()[:16])


def test_packing_shuffles_the_texts_once(spark, tmp_path):
    """Miners, styles and encoding start from one shuffle; nothing is computed from a text ahead of it."""
    path = str(tmp_path / "t")
    rows(spark, [LOG] * 20).write.parquet(path)
    packed = P.flat_pack(spark.read.parquet(path), ["id"], P.FlatOptions(use_char_ngrams=True)).select("id", "packed_prompt")
    packed.collect()
    plan = packed._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    shuffles = [x for x in plan.split("\n") if "Exchange" in x and "BroadcastExchange" not in x]
    assert sum("ReusedExchange" not in x for x in shuffles) == 1 and len(shuffles) >= 4
    below = plan.split("REPARTITION_BY_COL")[-1]
    assert "split(" not in below.split("FileScan")[0]


def test_occurrences_never_become_rows(spark):
    """The miners give a text's patterns as rows, not each place where they stand."""
    from corpuspack.operators.mining import mine_chars, mine_ngrams

    for mined in (mine_ngrams(rows(spark, [LOG]), ["id"]), mine_chars(rows(spark, [LOG]), ["id"])):
        plan = mined._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate ") == 1 and "posexplode(_found" in plan
        assert 0 < mined.count() <= 500
