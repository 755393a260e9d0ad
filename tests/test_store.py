"""Stored packs, the command line, streams under an input budget, and reports."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpuspack import __main__ as cli
from corpuspack.functions.session import shared_dir
from corpuspack.operators import budget as B
from corpuspack.operators import evaluate as E
from corpuspack.operators.compaction import Compacted, expand_messages, expand_recursive
from corpuspack.operators.mining import mine_chars, mine_lines, mine_ngrams
from corpuspack.operators.recall import recall_by_ids
from corpuspack.operators.running import sums_before
from corpuspack.sources import tables
from corpuspack.streaming.ingest import ingest_pages, template_stream

TEXT = "".join(f"worker {i % 7} of the east region has finished job number {i % 11} in time\n" for i in range(120))


def stored_text(spark, path):
    return "".join(p.read_text() for p in sorted(Path(path).glob("part-*")))


@pytest.fixture()
def source(tmp_path):
    path = tmp_path / "in.txt"
    path.write_text(TEXT)
    return str(path)


@pytest.mark.parametrize("command,kind", [("compress", "flat"), ("hierarchical", "hierarchical"), ("scale-compress", "budgeted")])
def test_every_kind_comes_back(spark, source, tmp_path, command, kind, capsys):
    out, back = str(tmp_path / "out"), str(tmp_path / "back")
    args = ["--page-chars", "900"] if command == "scale-compress" else []
    assert cli.run(spark, cli.parser().parse_args([command, "--file", source, "--out", out, *args])) == 0
    assert tables.kind_of(spark, out) == kind
    assert cli.run(spark, cli.parser().parse_args(["decompress", "--file", out, "--out", back])) == 0
    assert stored_text(spark, back) == TEXT
    assert cli.run(spark, cli.parser().parse_args(["metrics", "--file", out])) == 0
    said = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert any("token" in k for k in said)
    if kind == "budgeted":
        index = tables.read_page_index(spark, f"{out}/page_index")
        assert index.count() == spark.read.parquet(f"{out}/cold_store").count() > 1 and "encoded" not in index.columns
        assert stored_text(spark, f"{out}/prompts").startswith("BUDGETED") and tables.kind_of(spark, f"{out}/cold_store") == "cold_store"
        got = str(tmp_path / "fragment")
        assert cli.run(spark, cli.parser().parse_args(["recall", "--store", f"{out}/cold_store", "--page-id", "0", "--out", got])) == 0
        assert "<<<PAGE 0 score=1.0>>>" in stored_text(spark, got)


def test_metrics_of_a_text_and_errors(spark, source, capsys):
    assert cli.run(spark, cli.parser().parse_args(["metrics", "--file", source])) == 0
    assert json.loads(capsys.readouterr().out)["chars"] == len(TEXT)
    with pytest.raises(ValueError):
        cli.restored(spark, source + ".none")
    assert cli.main(["suite"]) == 0


def test_options_have_short_names_and_defaults(capsys):
    args = cli.parser().parse_args(["compress", "-f", "in.txt"])
    assert (args.file, args.out, args.min_freq) == ("in.txt", "packed", 3)
    assert cli.parser().parse_args(["recall", "--store", "s", "-o", "x"]).out == "x" and cli.parser().parse_args(["compact", "-f", "m"]).out == "compacted"
    with pytest.raises(SystemExit) as end:
        cli.main(["--version"])
    assert end.value.code == 0 and capsys.readouterr().out.startswith("corpuspack ")


def test_compact_command(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps([{"role": "user", "content": "hello there"}, {"role": "assistant", "content": "hi"}]))
    out = str(tmp_path / "out")
    assert cli.run(spark, cli.parser().parse_args(["compact", "--file", str(path), "--out", out])) == 0
    assert json.loads(spark.read.text(f"{out}/summary").first().value)["n_input_messages"] == 2


def test_lookups_reach_the_scan(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"page {i} says what it says") for i in range(50)], "page_id long, text string")
    tables.write_cold_store(B.cold_rows(pages, []), str(tmp_path / "c"))
    rows = tables.read_cold_store(spark, str(tmp_path / "c"))
    for found in (recall_by_ids(rows, [7, "9"]), B.decoded_page(rows, 7)):
        plan = found._jdf.queryExecution().toString()
        assert "page_id" in plan.split("PushedFilters: [")[1].split("]")[0].replace("IsNotNull(page_id)", "")
    tables.write_cold_store(B.cold_rows(pages, []), str(tmp_path / "j"), "json")
    back = B.decoded_pages(tables.read_cold_store(spark, str(tmp_path / "j"), "json")).orderBy("page_id").collect()
    assert [r.text for r in back] == [r.text for r in pages.orderBy("page_id").collect()]


def test_mining_shuffles_texts_alone(spark):
    texts = spark.createDataFrame([(1, TEXT)], "id long, text string")
    for mined in (mine_ngrams(texts, ["id"]), mine_lines(texts, ["id"]), mine_chars(texts, ["id"])):
        plan = mined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(id") == plan.count("Exchange ") == 1


def test_references_within_references(spark):
    shared_dir(spark)
    messages = spark.createDataFrame([(1, 0, "[cold_ref:c0] outer"), (1, 1, "plain")], "conv_id int, ord int, content string").withColumn("role", F.lit("user"))
    payload = "struct<encoded:string,dictionary:array<struct<ord:int,meta:string,pattern:string>>,packed_prompt:string,original:string>"
    refs = spark.createDataFrame([(1, "c0", "[cold_ref:c1] inner"), (1, "c1", "the text")], "conv_id int, ref_id string, original string")
    none = F.lit(None).cast("string")
    refs = refs.select("conv_id", "ref_id", F.lit("summary_stub").alias("kind"), F.lit("").alias("preview"), F.struct(none, F.lit(None).cast("array<struct<ord:int,meta:string,pattern:string>>"), none, "original").cast(payload).alias("payload"))
    done = Compacted(messages, refs, messages)
    once, all_ = ({r.ord: r.content for r in f(done, ["conv_id"]).collect()} for f in (expand_messages, expand_recursive))
    assert once == {0: "[cold_ref:c1] inner", 1: "plain"} and all_ == {0: "the text", 1: "plain"}


def test_sums_before(spark):
    rows = [("a", i, i % 5, "x") for i in range(0, 20_000, 3)] + [("b", -5, 2, "y"), ("b", 10**15, 3, "z"), ("c", 1, 1, "w")]
    df = spark.createDataFrame(rows, "k string, i long, n long, _slice string")
    df = df.withColumnRenamed("_slice", "note")
    seen = {}
    got = {(r.k, r.i): (r.s, r.c) for r in sums_before(df, ["k"], "i", {"s": F.col("n"), "c": F.lit(1)}).collect()}
    for k, i, n, _ in rows:
        s, c = seen.get(k, (0, 0))
        assert got[k, i] == (s, c)
        seen[k] = (s + n, c + 1)
    assert sums_before(df.limit(0), ["k"], "i", {"s": F.col("n")}).count() == 0


def test_phrases_of_any_length(spark):
    texts = ["the quick brown fox jumps over it", "a fox", "", None, "xquick brown foxes jump overnight", "ab" * 3000 + " fox jumps"]
    phrases = ["quick brown fox jumps", "fox", "", None, "ick brown foxes jump ove", "b fox", "jumps over it", "fox", "ab ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    gold = spark.createDataFrame([("t" if i % 2 else "u", p) for i, p in enumerate(phrases)], "type string, phrase string")
    got = {(r.id, r.type): (r.hit, r.total) for r in E.phrase_coverage(df, gold, ["id"]).collect()}
    fold = lambda x: " ".join(x.lower().split())
    for i, t in enumerate(texts):
        for kind in "tu":
            mine = [p for n, p in enumerate(phrases) if (n % 2 == 1) == (kind == "t")]
            if t is not None:
                assert got[i, kind] == (sum(p is not None and fold(p) in fold(t) for p in mine), len(mine)), (t, kind)
    plan = E.phrase_coverage(df, gold, ["id"])._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_stream_stops_at_the_input_budget(spark, tmp_path):
    shared_dir(spark)
    plain = spark.createDataFrame([(i, f"page {i} " + "word " * 40) for i in range(12)], "page_id long, text string")
    source, path = str(tmp_path / "in"), str(tmp_path / "cold")
    options = B.BudgetOptions(input_token_budget=300)
    for part in ("page_id < 4", "page_id between 4 and 7", "page_id > 7"):
        plain.where(part).coalesce(1).write.mode("append").parquet(source)
        ingest_pages(spark.readStream.schema(plain.schema).parquet(source), path, str(tmp_path / "at"), options).awaitTermination()
    stored = tables.read_cold_store(spark, path)
    want, spent = [], 0
    for r in plain.orderBy("page_id").collect():
        if spent >= 300:
            break
        want.append(r.page_id)
        spent += (len(r.text) + 3) // 4
    assert sorted(r.page_id for r in stored.collect()) == want


def test_template_stream(spark, tmp_path):
    plain = spark.createDataFrame([(i, f"page {i}") for i in range(5)] + [(9, "other")], "page_id long, text string")
    plain.write.parquet(str(tmp_path / "in"))
    stream = template_stream(spark.readStream.schema(plain.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("templates").outputMode("complete").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["count"], r.exemplar) for r in spark.table("templates").collect()) == [(1, "other"), (5, "page 0")]


def test_report(spark, tmp_path):
    rows = [(c, 2, 10.0, 5.0, 2.0, 1.0, 1.0, 1.0, mid, 0.95) for c, mid in (("raw", 1.0), ("compress", 0.2), ("compact", 0.3), ("lossy_truncate", 0.1), ("protect_compact", 1.0))]
    names = "condition string, n long, avg_tokens_before double, avg_tokens_after double, avg_token_ratio double, lossless_exact_rate double, avg_gold_phrase_recall_visible double, avg_gold_phrase_recall_restored double, avg_mid_constraint_recall_visible double, avg_typology_jaccard double"
    E.write_report(spark.createDataFrame(rows, names), str(tmp_path / "r"))
    text = stored_text(spark, str(tmp_path / "r" / "markdown"))
    assert text.count("\n- ") == 4 and "| compact | 2 | 10.000 |" in text and spark.read.json(str(tmp_path / "r" / "json")).count() == 5
    paths = [(["a", "b"], ["a", "b", "c"], 0.6667), ([], [], 1.0), (["a"], [], 0.0), ([], ["a"], 0.0), (["c", "A", "b"], ["b", "c", "b"], 1.0), (["A"], ["a"], 0.0), (None, ["a"], 0.0), (None, None, 1.0)]
    got = spark.createDataFrame(paths, "f array<string>, x array<string>, want double").select("want", E.layer_path_match(F.col("f"), F.col("x")).alias("is")).collect()
    assert [r["is"] for r in got] == [r.want for r in got]


def test_micro_precision_and_recall_as_counted_one_by_one(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(14)]
    phrase = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(1, n)))
    gold = [(c, t, i, phrase(6)) for c in range(12) for t in "gco" for i in range(rng.randrange(4))]
    labels = [(c, t, phrase(9)) for c in range(13) for t in "gco" for _ in range(rng.randrange(4))]
    matches = E.label_matches(spark.createDataFrame(labels, "c int, type string, label string"), spark.createDataFrame(gold, "c int, type string, ord int, phrase string"), ["c"])
    got = {r.c: (r.tp, r.fp, r.fn, r.micro_precision, r.micro_recall) for r in E.micro_precision_recall(matches, ["c"]).collect()}
    want = {}
    for c in range(13):
        tp = fp = fn = 0
        for t in "gco":
            g = [x[3] for x in gold if x[:2] == (c, t)]
            hit, wrong = set(), 0
            for label in (x[2] for x in labels if x[:2] == (c, t)):
                at = next((j for j, x in enumerate(g) if x in label or label in x or (len(x) > 12 and x[:20] in label)), None)
                hit, wrong = (hit, wrong + 1) if at is None else (hit | {at}, wrong)
            tp, fp, fn = tp + len(hit), fp + wrong, fn + len(g) - len(hit)
        want[c] = (tp, fp, fn, round(tp / (tp + fp), 4) if tp + fp else 1.0, round(tp / (tp + fn), 4) if tp + fn else 1.0)
    assert {c: got.get(c, (0, 0, 0, 1.0, 1.0)) for c in want} == want
    cover = spark.createDataFrame([(1, 3, 4), (2, 0, 0)], "c int, hit long, total long")
    assert [tuple(r) for r in E.proxy_precision_recall(cover, ["c"]).orderBy("c").collect()] == [(1, 0.75, 0.75), (2, 1.0, 1.0)]


def test_phrases_that_share_their_second_and_third_word(spark):
    texts = [(i, " ".join(["so", "of", "the", f"thing{i}", f"name{i % 50}", "end"])) for i in range(400)]
    phrases = [("t", f"x of the thing{i} name{i % 50} y") for i in range(300)] + [("t", f"so of the thing{i} name{i % 50} end") for i in range(200)]
    df, gold = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(phrases, "type string, phrase string")
    assert {r.id: r.hit for r in E.phrase_coverage(df, gold, ["id"]).collect()} == {i: int(i < 200) for i in range(400)}
    # a phrase meets the texts of its rarest pair alone: one each, though all share a pair
    seen = []
    real = E.join_on
    E.join_on = lambda left, right, keys, how="inner": seen.append(real(left, right, keys, how)) or seen[-1]
    try:
        E.phrase_coverage(df, gold, ["id"]).count()
    finally:
        E.join_on = real
    met = [d for d in seen if {"id", "_k", "_p", "times"} <= set(d.columns) and "_c" not in d.columns]
    assert len(met) == 1 and met[0].groupBy("_k").count().agg(F.max("count")).first()[0] <= 2
    nulls = spark.createDataFrame([(None, "one two three four five")], "id long, text string")
    assert [tuple(r) for r in E.phrase_coverage(nulls, spark.createDataFrame([("t", "one two three four")], "type string, phrase string"), ["id"]).collect()] == [(None, "t", 1, 1, 1.0)]
