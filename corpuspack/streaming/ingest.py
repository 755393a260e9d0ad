"""Pages as a stream into a cold store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators.budget import BudgetOptions, budget_pack, cold_rows, input_cap
from ..sources.tables import COLD_STORE, exists, read_cold_store


def ingest_pages(
    pages: DataFrame, path: str, checkpoint: str, options: BudgetOptions = BudgetOptions(), once: bool = True, event_time: str | None = None, late: str = "1 hour"
) -> StreamingQuery:
    """Starts a query that encodes the pages of a stream ``(page_id, text)`` and keeps them at ``path``.

    Pages are encoded one by one, so a micro-batch needs nothing of the others.  Each is
    written to a folder of its own number: a batch that is run again after a failure
    replaces what it wrote.  With ``once`` the query ends when all that is there has been taken.

    A page is stored once: of rows of a batch that share an id the least text stays, and ids that earlier
    batches stored are left out, however late they come again.  With ``event_time``, a column of the stream, repeats
    within ``late`` are already dropped by the stream's state, before they cost a look at the store.  Null ids and null texts are no pages.

    What earlier batches stored counts against the input budget; a batch takes its pages,
    in order, up to and with the one that reaches it, and later batches take none.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, spent, stored = batch.sparkSession, 0, None
        if exists(spark, path):
            stored = spark.read.schema(f"{COLD_STORE}, batch int").parquet(path).where(F.col("batch") != number)
            spent = stored.agg(F.sum("original_tokens_est")).first()[0] or 0  # of the counts alone
        pages = batch.where("text is not null and page_id is not null").groupBy("page_id").agg(F.min("text").alias("text"))
        if stored is not None:
            pages = pages.join(stored.select("page_id"), "page_id", "left_anti")  # of the ids alone
        sized = pages.select("page_id", F.lit(1).alias("scope"), T.token_estimate(F.col("text")).alias("original_tokens_est"))
        taken = input_cap(sized, ["scope"], options.input_token_budget - spent).select("page_id")
        rows = cold_rows(pages.join(taken, "page_id", "left_semi"), [], options)
        rows.drop("exemplar").write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    if event_time:
        pages = pages.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["page_id"])
    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def template_stream(pages: DataFrame) -> DataFrame:
    """Running counts and the first page of each template of a stream of pages; for update or complete mode."""
    named = pages.select(T.template_id(F.col("text")).alias("template_id"), "page_id", F.left("text", F.lit(2000)).alias("exemplar"))
    return named.groupBy("template_id").agg(F.count(F.lit(1)).alias("count"), F.min_by("exemplar", "page_id").alias("exemplar"))


def finalise(spark, path: str, options: BudgetOptions = BudgetOptions()) -> DataFrame:
    """The prompt over everything that a stream has put into a cold store."""
    from ..operators.codebook import decode

    rows = read_cold_store(spark, path).withColumn("exemplar", F.left(decode(F.col("encoded"), F.col("local_dictionary")), F.lit(2000)))
    return budget_pack(rows.withColumn("scope", F.lit(1)), ["scope"], options).drop("scope")
