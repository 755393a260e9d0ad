"""Budgeted packs, cold stores, recall, compaction, streaming and the facade."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpuspack.functions.session import shared_dir
from corpuspack.operators import budget as B
from corpuspack.operators import compaction as C
from corpuspack.operators import evaluate as E
from corpuspack.operators import recall as R
from corpuspack.plans.facade import PromptMemory
from corpuspack.sources import tables
from corpuspack.streaming.ingest import finalise, ingest_pages


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(42)
    lines = ["GET /users/{} took {} ms and was answered", "queue {} is waiting for worker {} again", "level={} count={} state=ready region=north"]

    def page(i):
        own = [rng.choice(lines).format(rng.randint(1, 50), rng.randint(1, 200)) for _ in range(30)]
        return "\n".join(own) + "\n" + ("UNIQUE_MARKER zebra\n" if i == 3 else "")

    shared_dir(spark)
    return spark.createDataFrame([(i, page(i), 1) for i in range(20)], "page_id long, text string, scope int").checkpoint()


@pytest.fixture(scope="module")
def rows(pages):
    return B.cold_rows(pages, ["scope"]).checkpoint()


def test_pages_come_back(pages, rows):
    want = {r.page_id: r.text for r in pages.collect()}
    assert {r.page_id: r.text for r in B.decoded_pages(rows).collect()} == want
    assert B.decoded_texts(rows, ["scope"]).first().text == "".join(want[i] for i in sorted(want))
    assert B.decoded_page(rows, 3).first().text == want[3] and B.decoded_page(rows, 99).first() is None


@pytest.mark.parametrize("budget", [100, 3000, 4200, 1_000_000])
def test_budget(rows, budget):
    options = B.BudgetOptions(output_token_budget=budget, hot_page_fraction=0.5)
    got = B.budget_pack(rows, ["scope"], options).first()
    assert got.prompt_tokens_est == (len(got.packed_prompt) + 3) // 4
    assert got.prompt_fits_budget == (got.prompt_tokens_est <= budget) and got.n_pages == 20
    assert got.hot_pages + got.cold_pages == 20
    index = json.loads(got.packed_prompt.split("PAGE_INDEX:\n")[1].split("\n")[0])
    assert [x["page_id"] for x in index if x["in_prompt"]] == got.hot_ids
    if budget == 1_000_000:
        assert got.hot_pages == 10
    elif got.hot_pages < 10:  # one more hot page would not have fitted
        more = B.budget_pack(rows, ["scope"], B.BudgetOptions(hot_page_fraction=0.5)).first()
        bodies = more.packed_prompt.split("HOT_ENCODED_PAGES:\n")[1].split("\n<<<PAGE ")
        assert got.prompt_tokens_est + (len(bodies[got.hot_pages]) + 8) // 4 > budget


def test_input_cap_and_hot_pages(spark):
    rng = random.Random(1)
    for _ in range(6):
        ids = [(1, i, f"t{rng.randint(0, 5)}", rng.randint(1, 9)) for i in range(rng.randint(1, 20))]
        df = spark.createDataFrame(ids, "scope int, page_id long, template_id string, original_tokens_est long")
        kept, total = [], 0
        for _, i, _, n in ids:
            kept.append(i)
            total += n
            if total >= 25:
                break
        assert sorted(r.page_id for r in B.input_cap(df, ["scope"], 25).collect()) == kept
        want, shown, n = [], set(), max(1, int(len(ids) * 0.4))
        for _, i, t, _ in ids:
            if len(want) < n and (t not in shown or len(shown) == len({x[2] for x in ids})):
                want.append(i)
                shown.add(t)
        want += [i for _, i, _, _ in ids if i not in want][: n - len(want)]
        assert sorted(r.page_id for r in B.hot_pages(df, ["scope"], 0.4).where("hot").collect()) == sorted(want)


def test_recall(rows):
    hits = R.recall(rows, [5, "3", 5], "zebra  unique_marker", 2).orderBy("ord").collect()
    assert [(h.page_id, h.score) for h in hits] == [(5, 1.0), (3, 1.0), (5, 1.0)]
    hits = R.recall(rows, None, "ZEBRA", 5).collect()
    assert [h.page_id for h in hits] == [3] and hits[0].score == 1.0
    text = R.fragment(R.recall(rows, [3])).first()
    assert text.packed_fragment.startswith("RECALLED_PAGES (lossless from cold_store):\nn_hits=1\n\n<<<PAGE 3 score=1.0>>>\n")
    assert R.recall(rows, None, "!", 5).count() == 0
    for bad in (lambda: R.recall(rows), lambda: R.recall(rows, [1], method="other"), lambda: R.keyword_search(rows, "x", -1)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        R.recall(rows, [77])
    with pytest.raises(NotImplementedError):
        R.recall(rows, [1], method="embedding")


TOOL = "\n".join(['tool_result status=200 request_id=abc123 latency_ms=12 {"ok": true, "rows": [4, 5, 6]}'] * 100)


def talk(spark, *messages):
    return spark.createDataFrame([(1, i, r, c) for i, (r, c) in enumerate(messages)], "conv_id int, turn long, role string, content string")


def test_merge_keeps_outer_white_space(spark):
    merged = C.merge_turns(talk(spark, ("user", " a \n"), ("user", "  "), ("user", "\nb "), ("tool", "c"), ("user", "d")), ["conv_id"]).orderBy("turn").collect()
    assert [(r.role, r.content) for r in merged] == [("user", " a\n\nb "), ("tool", "c"), ("user", "d")]


def test_bulky_turns_are_encoded(spark):
    messages = talk(spark, ("system", "S"), ("user", "q"), ("tool", TOOL), ("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"))
    done = C.compact_messages(messages, ["conv_id"], C.CompactOptions(mode="lossless_dict", keep_last_n=3))
    got, refs = done.summary.first(), done.cold_refs.collect()
    assert got.compacted_tokens_est < got.original_tokens_est and got.mode == "lossless_dict"
    assert [r.kind for r in refs] == ["dict_encoded"] and refs[0].ref_id == "c0"
    assert TOOL in [r.content for r in C.expand_messages(done, ["conv_id"]).collect()]
    stubs = C.compact_messages(messages, ["conv_id"], C.CompactOptions(mode="lossy_stub", keep_last_n=3))
    assert "[cold_ref:c0] [compacted stub: ~" in stubs.summary.first().packed_prompt
    with pytest.raises(ValueError):
        C.compact_messages(messages, ["conv_id"], C.CompactOptions(mode="other"))


@pytest.mark.parametrize("budget", [10, 60, 120, 100_000])
def test_eviction_one_by_one(spark, budget):
    rng = random.Random(budget)
    turns = [(("user", "assistant")[i % 2], "word " * rng.randint(1, 60)) for i in range(9)]
    done = C.compact_messages(talk(spark, ("system", "S"), *turns), ["conv_id"], C.CompactOptions(budget=budget, keep_last_n=2))

    def stub(i, c):
        line = c.strip()
        line = line if len(line) <= 240 else line[:239] + "…"
        return f"[cold_ref:c{i}] [compacted stub: ~{(len(c) + 3) // 4} tokens, 1 lines; recoverable detail omitted] {line}"

    now = [("system", "S"), *turns]
    pack = lambda: "\n\n".join(f"<<<{r.upper()}>>>\n{c}" for r, c in now)
    for i in range(7):
        if (len(pack()) + 3) // 4 <= budget:
            break
        now[i + 1] = (now[i + 1][0], stub(i, now[i + 1][1]))
    assert done.summary.first().packed_prompt == pack()
    back = C.expand_messages(done, ["conv_id"]).orderBy("ord").collect()
    assert [(r.role, r.content) for r in back] == [("system", "S"), *turns]


def test_conditions(spark):
    goal = "GOAL: ship the release. CONSTRAINT: must not exceed 5 dollars"
    traces = talk(spark, ("system", "careful"), ("user", goal), ("assistant", "PLAN: go"), ("tool", TOOL), ("user", "CONSTRAINT: cannot delete rows"), ("tool", TOOL), ("user", "and?"), ("assistant", "OUTCOME: shipped"))
    gold = spark.createDataFrame([(1, "goal", "Ship  the release"), (1, "constraint", "cannot delete rows"), (1, "outcome", "shipped")], "conv_id int, type string, phrase string")
    scored = E.score_conditions(E.run_conditions(traces, ["conv_id"], 1500), gold, traces, ["conv_id"])
    by = {r.condition: r for r in scored.collect()}
    assert set(by) == set(E.CONDITIONS) and by["raw"].gold_phrase_recall_visible == 1.0 and by["compress"].lossless_exact
    assert by["lossy_truncate"].mid_constraint_recall_visible == 0.0 and by["protect_compact"].mid_constraint_recall_visible == 1.0
    assert by["compact"].gold_phrase_recall_restored == 1.0
    assert E.summarise(scored).count() == 5
    labels = spark.createDataFrame([(1, "goal", "we ship the release soon"), (1, "goal", "unrelated")], "conv_id int, type string, label string")
    ranked = gold.withColumn("ord", F.lit(0))
    got = {r.type: (r.tp, r.fp, r.fn) for r in E.label_matches(labels, ranked, ["conv_id"]).collect()}
    assert got == {"goal": (1, 1, 0), "constraint": (0, 0, 1), "outcome": (0, 0, 1)}


def test_conditions_keep_figures_and_not_texts(spark, monkeypatch):
    words = ["GOAL: ship it", "must not exceed", "alpha beta gamma delta", "result: done", "x"]
    traces = spark.createDataFrame([(c, i, "user" if i % 2 else "assistant", " ".join(words[(c * i + j) % 5] for j in range(12))) for c in range(4) for i in range(9)], "conv_id int, turn int, role string, content string")
    gold = spark.createDataFrame([(0, "goal", "ship it"), (0, "constraint", "must not exceed alpha"), (0, "constraint", None), (1, "goal", ""), (1, "goal", "no such thing here at all"), (2, "outcome", "X alpha  beta")], "conv_id int, type string, phrase string")
    conditions = C.cut(E.run_conditions(traces, ["conv_id"], 60))
    kept, cut = [], E.cut
    monkeypatch.setattr(E, "cut", lambda df: kept.append(df.columns) or cut(df))
    shown = lambda: sorted(map(str, E.score_conditions(conditions, gold, traces, ["conv_id"]).collect()))
    few = shown()
    assert len(few) == 20 and not any("text" in c for columns in kept for c in columns)
    monkeypatch.setattr(E, "LISTED", 1)  # traces with more phrases are joined by pairs of words
    assert shown() == few


def test_stream_into_a_cold_store(spark, pages, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "cold")
    plain = pages.select("page_id", "text")
    plain.where("page_id < 8").write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(plain.schema).parquet(source)
        ingest_pages(stream, path, str(tmp_path / "at")).awaitTermination()
        plain.where("page_id >= 8").write.mode("append").parquet(source)
    stored = tables.read_cold_store(spark, path)
    want = {r.page_id: r.text for r in plain.collect()}
    assert {r.page_id: r.text for r in B.decoded_pages(stored).collect()} == want
    assert finalise(spark, path).first().n_pages == 20


def test_files_and_facade(spark, pages, tmp_path):
    path = tmp_path / "a.txt"
    path.write_bytes(b"one\r\ntwo \xff\n" * 30)
    text = tables.read_texts(spark, str(path)).first().text
    assert text == "one\r\ntwo �\n" * 30
    messages = tmp_path / "m.json"
    messages.write_text(json.dumps({"messages": [{"role": "user", "content": "hi"}, {"content": [{"type": "text", "text": "x"}, {"type": "text", "text": "y"}]}]}))
    got = tables.read_messages(spark, str(messages)).orderBy("turn").collect()
    assert [(r.role, r.content) for r in got] == [("user", "hi"), ("user", "x\ny")]
    memory = PromptMemory(spark, cold_store=str(tmp_path / "cold"), page_chars=500)
    packed = memory.compress(spark.createDataFrame([(1, text)], "id long, text string"), ["id"], "budgeted")
    assert packed.first().prompt_fits_budget and memory.recall([0]).count() == 1
    assert memory.pack_files(str(path)).count() == 1
    flat = memory.compress(spark.createDataFrame([(1, text)], "id long, text string"), ["id"])
    tables.write_packed(flat.drop("text"), str(tmp_path / "packed"))
    back = tables.read_packed(spark, str(tmp_path / "packed")).first()
    assert back.encoded == flat.first().encoded and len(back.dictionary) == flat.first().dictionary_entries
    with pytest.raises(ValueError):
        memory.compress(pages, ["page_id"], "other")
