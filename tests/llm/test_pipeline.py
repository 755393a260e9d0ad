"""The pipeline's stages, each on its own input, and the registered queries with SQL."""

import duckdb
import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from corpuspack.llm import common, line_templates, mixing, queries, simhash
from tests.test_queries import compare

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    common.shared_dir(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, "12 34 !!", "en", "s", 8), (9002, None, None, "s", None), (9003, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(extra).checkpoint()
    known = corpus_pipeline.language_id(spark, docs, SF).checkpoint()
    assert known.columns == docs.columns
    gone = docs.join(known, "doc_id", "left_anti")
    assert {9001, 9002, 9003} <= {r.doc_id for r in gone.collect()} and gone.count() <= 6
    lines = corpus_pipeline.line_dedup(spark, known, SF).checkpoint()
    assert lines.columns == docs.columns and lines.count() == known.count() and lines.where("n_chars <> length(text)").count() == 0
    one = corpus_pipeline.near_dedup(spark, lines, SF).checkpoint()
    sets = {r.doc_id: set(simhash.shingle_hashes((r.text or "").encode(), 5).tolist()) for r in lines.collect()}
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    kept = {r.doc_id for r in one.collect()}
    assert len(kept) == one.count()
    for i in set(sets) - kept:  # what goes has a near text with a smaller id
        assert any(alike(sets[i], sets[j]) for j in sets if j < i)
    assert not any(alike(sets[i], sets[j]) for i in kept for j in kept if j < i)  # these tables' copies are close
    mixed = corpus_pipeline.mixing(spark, one, SF).checkpoint()
    assert mixed.columns == docs.columns and mixed.join(one, "doc_id", "left_anti").count() == 0
    tokens = corpus_pipeline.sentencepiece(spark, mixed, SF)
    judge = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in mixed.collect()}
    rows = tokens.collect()
    assert len(rows) == mixed.count() and all(r.ids == judge.encode(texts[r.doc_id]) and r.round_trip for r in rows)


def test_near_dedup_with_null_and_repeated_ids(spark):
    text = [" ".join(f"w{n}x{i}" for i in range(60)) for n in range(6)]
    rows = [(1, text[0]), (1, text[1]), (1, text[1]), (2, text[1]), (None, text[0]), (None, text[2]), (None, text[2]), (None, text[3]), (3, text[3]), (None, text[4]), (4, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    want = [(1, text[0]), (1, text[1]), (3, text[3]), (4, None), (None, text[2]), (None, text[4])]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, want))


def test_stages_on_odd_tables(spark):
    """Nulls in any column, repeated rows and ids, very long and empty texts, columns with clashing names, an empty table."""
    text = "the house is in the garden and it is old and the tree is by the water, and the light was "
    rows = [(1, text + "green", "en", "a", 5, "x"), (1, text + "green", "en", "a", 5, "x"), (None, text + "red and blue", None, None, None, None),
            (None, None, "en", "a", None, None), (4, "", None, "b", 0, None), (5, text * 3000, "en", "b", 9, "x"), (6, "12 34", "en", "b", 5, "x"),
            (7, "el perro y la casa de la luz en la calle de agua", "es", "b", 5, None), (7, "otro texto que no es el de antes y no se repite", "es", None, 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string")
    docs = docs.select("*", F.lit(1).alias("score"), F.lit(2).alias("copies"), F.lit("z").alias("fp"))
    columns = list(corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).toPandas()
        assert len(stage(spark, docs.limit(0), SF).take(1)) == 0, name
        if name == "sentencepiece":
            assert len(out) == len(rows) and out.round_trip.all()
            continue
        assert list(out.columns) == columns, name
        kept = out.text.map(lambda t: None if t is None else t[:40]).tolist()
        if name == "language_id":
            assert len(out) == 6 and out.lang.notna().all()
        elif name == "line_dedup":
            assert len(out) == len(rows)
        elif name == "near_dedup":
            assert len(out) == 6 and kept.count(text[:40]) == 2  # copies and a near copy are one, null and empty texts are
        else:
            assert set(out.text.dropna()) <= {r[1] for r in rows}


def test_clashing_names(spark):
    """Columns that operators use names like keep their values."""
    text = ["the first line of a text that is here twice over\nown words", "the first line of a text that is here twice over\nother words", "alone"]
    names = ["_id", "_th", "_drop", "_parts", "_ka", "_kb", "_copies", "_n", "_text", "_hash", "id", "th", "drop", "parts", "row", "ka", "kb", "dealt", "n", "nth", "node", "first"]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(text)], "doc_id long, text string, lang string, source string")
    docs = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    for f in (line_templates.drop_recurring_lines, line_templates.drop_recurring_passages, simhash.first_of_groups, mixing.mixed_documents):
        got = f(docs).collect()
        assert len(got) >= 2 and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names), f
        if f in (line_templates.drop_recurring_lines, line_templates.drop_recurring_passages):
            assert {r.text for r in got} == {text[0], "other words", "alone"}


def test_passages_that_two_documents_share(spark):
    said = lambda tag, n=12: " ".join(f"{tag}{chr(97 + i)}" for i in range(n)) + "."
    passage = " ".join(said(f"p{chr(97 + i)}") for i in range(5))
    rows = [(1, f"{said('own')} {passage}\nshort line"), (2, f"Other {said('word')} {passage} {said('tail')}\n\nlast"), (3, passage), (4, f"{said('alone')}\n"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, SF).collect()}
    assert got == {1: rows[0][1], 2: f"Other {said('word')} {said('tail')}\n\nlast", 3: "", 4: rows[3][1], None: None}


def test_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "sentencepiece"]
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.where("round_trip").count() == out.count()


def test_queries_with_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    for name, sql in queries.oracle_sql().items():
        compare(queries.queries()[name](spark, SF).toPandas(), con.execute(sql).fetchdf())


def test_toxic_documents_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op10_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null"), "doc_id")
    counts = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    hit, missed, false = (counts.get(k, 0) for k in ((1, 1), (1, 0), (0, 1)))
    # 0.82 and 0.02 as measured with the few hundred toxic documents here to learn from; 0.96 and 0.014 at ten times as many
    assert hit / (hit + missed) >= 0.8 and false / (false + counts[0, 0]) <= 0.03
    assert got.agg(F.min("score"), F.max("score")).first()[0] >= 0


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op4_language_id(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    assert np.isclose(got.where("lang = lang_pred").count() / got.count(), 1, atol=0.02)
