"""Sketches stored a batch against exact counts."""

from pyspark.sql import functions as F

from corpuspack.operators.sketches import TRACKED, add_batches, batch_sketches, distinct_counts, heavy_hitters

SF = "/root/testdata/sf0.01"


def test_batches_merge_to_the_counts_of_all_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = str(tmp_path / "sketches")
    words = docs.select("lang", "source", F.explode(F.split(F.lower("text"), r"\s+")).alias("word"))
    for source in [r.source for r in docs.select("source").distinct().collect()]:  # one batch after the other
        add_batches(batch_sketches(words.where(F.col("source").eqNullSafe(source)), ["lang"], "source", F.col("word")), path)
    stored = spark.read.parquet(path)
    exact = {r.lang: (r.n, r.d) for r in words.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("word").alias("d")).collect()}
    got = {r.lang: (r.n, r.n_distinct) for r in distinct_counts(stored, ["lang"]).collect()}
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in exact.items()}
    for lang, (_, d) in exact.items():
        assert abs(got[lang][1] - d) <= 0.05 * d + 1
    counts = {(r.lang, r.word): r["count"] for r in words.groupBy("lang", "word").count().collect()}
    found = heavy_hitters(stored, ["lang"], 20).collect()
    for r in found:
        assert counts[r.lang, r.item] <= r["count"] <= counts[r.lang, r.item] + 3.5 / TRACKED * exact[r.lang][0]
    for lang, (n, _) in exact.items():
        mine = {r.item: r["count"] for r in found if r.lang == lang}
        sure = min(mine.values())
        for (of, word), c in counts.items():  # what is missing cannot be more frequent than the least that is there
            assert of != lang or word in mine or c <= sure


def test_few_items_are_exact_and_nulls_are_counted_apart(spark):
    rows = [("a", 1, "x"), ("a", 1, "x"), ("a", 2, "y"), ("a", 2, None), (None, 1, "z"), (None, None, "z")]
    df = spark.createDataFrame(rows, "k string, b int, v string")
    stored = batch_sketches(df, ["k"], "b", F.col("v"))
    assert stored.count() == 4
    assert {(r.k, r.n, r.n_distinct) for r in distinct_counts(stored, ["k"]).collect()} == {("a", 4, 2), (None, 2, 1)}
    assert {(r.k, r.item, r["count"]) for r in heavy_hitters(stored, ["k"], 5).collect()} == {("a", "x", 2), ("a", "y", 1), (None, "z", 2)}
    assert distinct_counts(batch_sketches(df.limit(0), ["k"], "b", F.col("v")), ["k"]).count() == 0
