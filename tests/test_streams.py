"""Streams: pages stored once, templates in keyed state, and pages that a caller's code supplies."""

import pytest
from pyspark.sql import functions as F

from corpuspack.functions import text as T
from corpuspack.functions.session import shared_dir
from corpuspack.operators import budget as B
from corpuspack.sources import tables
from corpuspack.sources.pages import PageReader, register_pages
from corpuspack.streaming.ingest import ingest_pages
from corpuspack.streaming.state import PROVIDER, ranked_templates, template_state

SCHEMA = "page_id long, text string, at timestamp"


def batches(spark, path, rows):
    spark.createDataFrame(rows, "page_id long, text string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("event_time", [None, "at"])
def test_a_page_is_stored_once(spark, tmp_path, event_time):
    shared_dir(spark)
    source, path = str(tmp_path / "in"), str(tmp_path / "cold")
    first = [(i, f"page {i} says this", "2026-01-01 00:00:00") for i in range(6)]
    replayed = first + [(6, "new", "2026-01-01 00:10:00"), (6, "newer", "2026-01-01 00:10:00"), (None, "no id", "2026-01-01 00:10:00"), (8, None, "2026-01-01 00:10:00")]
    late = [(2, "page 2 again, hours later", "2026-01-01 09:00:00"), (7, "seven", "2026-01-01 09:00:00")]
    for rows in (first, replayed, late):
        batches(spark, source, rows)
        ingest_pages(spark.readStream.schema(SCHEMA).parquet(source), path, str(tmp_path / "at"), event_time=event_time).awaitTermination()
    stored = tables.read_cold_store(spark, path)
    text = sorted((r.page_id, r.text) for r in B.decoded_pages(stored).collect())
    assert [p for p, _ in text] == list(range(8)) and text[2][1] == "page 2 says this" and text[7][1] == "seven"
    assert text[6][1] in ("new", "newer") and stored.agg(F.sum("original_tokens_est")).first()[0] == sum((len(t) + 3) // 4 for _, t in text)


def test_templates_in_state_survive_a_restart(spark, tmp_path):
    shared_dir(spark)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        source, out = str(tmp_path / "in"), str(tmp_path / "out")
        texts = [(i, f"kind {'abc'[i * i % 3]} number {i}" if i % 5 else "the same", "2026-01-01 00:00:00") for i in range(40)]

        def write(batch, number):
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        for part in (texts[20:30], texts[:20], texts[30:]):  # a restart each time
            batches(spark, source, part)
            stream = template_state(spark.readStream.schema(SCHEMA).parquet(source))
            stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
        got = ranked_templates(spark.read.parquet(out).drop("batch"))
        whole = spark.createDataFrame(texts, SCHEMA.replace("timestamp", "string")).select(F.lit(1).alias("scope"), "page_id", F.col("text").alias("exemplar"), T.template_id(F.col("text")).alias("template_id"))
        fields = ["template_id", "count", "first", "exemplar", "rank"]
        assert sorted(tuple(r) for r in got.select(fields).collect()) == sorted(tuple(r) for r in B.templates(whole, ["scope"]).select(fields).collect())
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_supplied_pages_in_batches(spark):
    register_pages(spark)
    pages = spark.read.format("corpuspack_pages").option("provider", "tests.page_provider:Fixed").option("partitionPages", 7).load()
    plain = [(i * 3, f"page {i} of those supplied " * 5) for i in range(25)]
    assert pages.rdd.getNumPartitions() == 4 and sorted(tuple(r) for r in pages.collect()) == plain
    for where in ("page_id = 9", "page_id in (3, 6, 100)", "page_id > 60 and text like '%2%'", "page_id >= 3 and page_id < 12", "page_id <= 0", "page_id <> 3"):
        want = spark.createDataFrame(plain, "page_id long, text string").where(where)
        assert sorted(map(tuple, pages.where(where).collect())) == sorted(map(tuple, want.collect())), where
    from pyspark.sql.datasource import EqualTo, Not

    reader = PageReader({"provider": "tests.page_provider:Fixed"})
    assert len(list(reader.pushFilters([EqualTo(("page_id",), 9), Not(EqualTo(("page_id",), 3)), EqualTo(("text",), "x")]))) == 2
    assert [p for part in reader.partitions() for p, _ in reader.read(part)] == [9]


def test_supplied_pages_as_a_stream_that_stops(spark, tmp_path):
    shared_dir(spark)
    register_pages(spark)
    there, path = tmp_path / "there", str(tmp_path / "cold")
    for n in (9, 9, 15):
        there.write_text(str(n))
        source = spark.readStream.format("corpuspack_pages").option("provider", "tests.page_provider:Growing").option("there", str(there)).option("partitionPages", 4).load()
        ingest_pages(source, path, str(tmp_path / "at")).awaitTermination()
        stored = B.decoded_pages(tables.read_cold_store(spark, path))
        assert sorted(tuple(r) for r in stored.collect()) == [(i * 3, f"page {i} of those supplied " * 5) for i in range(n)]
