"""Scopes of many rows: one dictionary over them, and sums over keys and ids of any kind."""

import random

import pytest
from pyspark.sql import functions as F

from corpuspack.operators import budget as B
from corpuspack.operators import packing as P
from corpuspack.operators import scope as S
from corpuspack.operators.mining import mine_lines, mine_ngrams
from corpuspack.operators.running import join_on, sums_before


def made_pages(seed, n=120):
    rng = random.Random(seed)
    stock = ["the quick brown fox jumps over", "status=200 msg=ok retry=none", "a line that is there again and again", "x", "⟦odd⟧" if seed == 2 else "even", ""]
    rows = []
    for i in range(n):
        key = rng.choice(["a", "a", "b", None])
        lines = [" ".join(rng.choice(stock) if rng.random() < 0.3 else f"w{rng.randrange(60)}" for _ in range(rng.randrange(9))) for _ in range(rng.randrange(8))]
        rows.append((key, i * 7 - 300, "\n".join(lines)))
    return [*rows, ("one", 5, "alone " * 40), ("none", 1, ""), ("a", 10**15, "far\x85out status=200 msg=ok retry=none"), ("b", -(2**62), None)]


@pytest.mark.parametrize("seed,part_chars,sent", [(0, 300, 0), (1, 1 << 20, 10**6), (2, 900, 10**6)])
def test_a_dictionary_over_rows_is_that_of_the_joined_text(spark, monkeypatch, seed, part_chars, sent):
    monkeypatch.setattr(S, "SENT_PATTERNS", sent)
    monkeypatch.setattr(S, "SENT_SCOPES", sent)
    rows = made_pages(seed)
    pages = spark.createDataFrame(rows, "k string, page_id long, text string").repartition(3)
    joined = {}
    for k, _, t in sorted((r for r in rows if r[2] is not None), key=lambda r: r[1]):
        joined.setdefault(k, []).append(t)
    whole = spark.createDataFrame([(k, "\n".join(v)) for k, v in joined.items()], "k string, text string")
    options = S.ScopeOptions(part_chars=part_chars)
    entries = S.scope_dictionary(pages, ["k"], options)
    got = sorted((str(r.k), r.ord, r.meta, r.pattern, r.cnt) for r in entries.collect())
    want = sorted((str(r.k), r.ord, r.meta, r.pattern, r.cnt) for r in P.build_dictionary(whole, ["k"], P.FlatOptions()).collect())
    assert got == want and {x[0] for x in got} >= {"a", "b", "None"}
    if seed == 0:
        encoded = S.encode_scopes(pages, entries, ["k"])
        back = {(r.k, r.page_id): r.text for r in S.decode_scopes(encoded, entries, ["k"]).collect()}
        assert back == {(k, i): t for k, i, t in rows if t is not None}
        assert encoded.where("coded and length(encoded) < 60").count() and encoded.agg(F.sum(F.length("encoded"))).first()[0] < 0.8 * sum(len(r[2] or "") for r in rows)


def test_patterns_reach_across_short_pages(spark):
    words = [f"unit{i % 5}" for i in range(200)]
    pages = spark.createDataFrame([(1, i, w) for i, w in enumerate(words)], "k int, page_id long, text string").repartition(4)
    one = spark.createDataFrame([(1, "\n".join(words))], "k int, text string")
    fields = ["src", "pattern", "cnt", "len", "score", "rank"]
    got = sorted(tuple(r) for r in S.scope_patterns(pages, ["k"], S.ScopeOptions(part_chars=100)).select(fields).collect())
    want = mine_ngrams(one, ["k"], max_len=10).unionByName(mine_lines(one, ["k"]))
    assert got == sorted(tuple(r) for r in want.select(fields).collect()) and got
    none = spark.createDataFrame([], "k int, page_id long, text string")
    assert S.scope_dictionary(none, ["k"]).count() == 0


def test_no_value_holds_more_than_a_page(spark):
    pages = spark.createDataFrame([("s", i, f"page {i % 9} says the same thing " * 30) for i in range(200)], "k string, page_id long, text string")
    stored, scopes = S._dealt(pages, ["k"], S.ScopeOptions(part_chars=5000))
    longest = pages.agg(F.max(F.length("text"))).first()[0]
    assert stored.agg(F.max(F.length("text"))).first()[0] == longest and scopes.first().parts > 20
    assert stored.groupBy("part").agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0] < 6 * 5000


# --- running sums ------------------------------------------------------------------------------------------


def test_sums_over_null_keys_hashed_ids_and_outliers(spark):
    rng = random.Random(5)
    ids = [rng.randrange(-(2**63), 2**63) for _ in range(400)] + [2**63 - 1, -(2**63)]
    rows = [("h", i, 1 + i % 7) for i in ids] + [(None, i, 2) for i in range(300)] + [("o", i, 3) for i in range(2000)] + [("o", 10**15, 3)]
    df = spark.createDataFrame(rows, "k string, i long, n long")
    seen, got = {}, {(r.k, r.i): r.s for r in sums_before(df, ["k"], "i", {"s": F.col("n")}).collect()}
    assert len(got) == len(rows)
    for k, i, n in sorted(rows, key=lambda r: r[1]):
        assert got[k, i] == seen.get(k, 0)
        seen[k] = seen.get(k, 0) + n
    many = sums_before(df.where("k = 'o'").repartition(2), ["k"], "i", {"s": F.lit(1)})
    assert many.where("i = 1999").first().s == 1999


def test_budgets_keep_pages_without_a_source(spark):
    rows = [(None, 2**62 + i, "page of no source " * 9) for i in range(5)] + [("a", -(2**62) + i, f"page {i} of a source " * 9) for i in range(5)]
    pages = spark.createDataFrame(rows, "source string, page_id long, text string")
    cold = B.cut(B.cold_rows(pages, ["source"], B.BudgetOptions(min_freq=2)))
    assert cold.count() == 10 and cold.where("source is null and size(local_dictionary) > 0").count() == 5
    assert B.input_cap(cold, ["source"], 10**9).count() == 10 and B.input_cap(cold, ["source"], 1).count() == 2
    assert B.hot_pages(cold, ["source"], 1.0).where("hot").count() == 10
    assert sorted((str(r.source), r["rank"], r["count"]) for r in B.templates(cold, ["source"]).collect()) == [("None", 0, 5), ("a", 0, 5)]
    packed = {r.source: r for r in B.budget_pack(cold, ["source"]).collect()}
    assert {k: r.n_pages for k, r in packed.items()} == {None: 5, "a": 5} and all(r.global_dict_size > 0 for r in packed.values())
    flat = {r.source: r for r in P.flat_pack(pages.groupBy("source").agg(F.concat_ws("\n", F.collect_list("text")).alias("text")), ["source"]).collect()}
    assert flat[None].dictionary_entries > 0


def test_join_on_null_keys(spark):
    a = spark.createDataFrame([(None, 1, "x"), ("k", None, "y"), ("m", 2, "z")], "k string, n int, v string")
    b = spark.createDataFrame([(None, 1, "p"), ("k", None, "q")], "k string, n int, w string")
    assert sorted(map(str, (tuple(r) for r in join_on(a, b, ["k", "n"]).collect()))) == sorted(map(str, [(None, 1, "x", "p"), ("k", None, "y", "q")]))
    assert join_on(a, b, ["k", "n"], "left").count() == 3


@pytest.mark.parametrize("sent", [100_000, 0])
def test_budgets_keep_no_texts(spark, monkeypatch, sent):
    """What a pack keeps between its steps has no text of a page but the dictionary; the input cap keeps nothing where it cuts nothing."""
    from corpuspack.operators import running

    pages = spark.createDataFrame([("ab"[i % 2], i, f"page {i} of a source says the same " * 9) for i in range(24)], "source string, page_id long, text string")
    cold = B.cut(B.cold_rows(pages, ["source"]))
    options = B.BudgetOptions(hot_page_fraction=0.5, max_global_dict=8)
    want = B.budget_pack(cold, ["source"], options).orderBy("source").collect()
    kept, cut = [], B.cut
    for of in (B, running):
        monkeypatch.setattr(of, "cut", lambda df: kept.append(set(df.columns)) or cut(df))
    monkeypatch.setattr(B, "SENT_PAGES", sent)
    assert B.budget_pack(cold, ["source"], options).orderBy("source").collect() == want and [r.hot_pages for r in want] == [6, 6]
    assert not any(c & {"encoded", "exemplar", "body", "yes", "no", "local_dictionary"} for c in kept)


def test_short_pages_ask_for_more_than_the_next(spark):
    texts = ["a b", "c", "", "d " * 30, "e f g", "h"]
    pages = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "k string, page_id long, text string")
    stored, _ = S._dealt(pages, ["k"], S.ScopeOptions(max_ngram=5))
    after = [" ".join(texts[i + 1 :]).split()[:4] for i in range(len(texts))]
    assert {r.page_id: list(r.ahead) for r in stored.collect()} == dict(enumerate(after))
    assert all(f.endswith(".zstd.parquet") for f in stored.inputFiles())


def test_dictionaries_go_to_the_pages(spark, tmp_path):
    spark.createDataFrame([("s", i, f"page {i} says it") for i in range(9)], "k string, page_id long, text string").write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    entries = spark.createDataFrame([("s", 0, "⟦A⟧", "says it", 9)], "k string, ord int, meta string, pattern string, cnt long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        encoded = S.encode_scopes(pages, entries, ["k"])
        assert "Exchange hashpartitioning" not in encoded._jdf.queryExecution().executedPlan().toString()
        assert encoded.where("coded").count() == 9
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
