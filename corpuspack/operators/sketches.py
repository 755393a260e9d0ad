"""Mergeable sketches of a corpus, stored a batch: distinct counts and heavy hitters without reading the batches again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Logarithm of the buckets of a distinct count: the standard error is about 1.04 / sqrt(2^LG_BUCKETS), 1.6 %.
LG_BUCKETS = 12
#: Items that a heavy-hitter sketch tracks.  Counts are exact while there are fewer than three quarters as many.
TRACKED = 4096


def batch_sketches(rows: DataFrame, keys: Sequence[str], batch: str, item: Column, tracked: int = TRACKED) -> DataFrame:
    """``(keys, batch, n, distinct, frequent)``: one row of sketches for each batch of each key.

    ``n`` counts the rows, ``distinct`` is a HyperLogLog sketch of ``item`` and ``frequent`` a sketch of its most
    frequent values; null items count in ``n`` alone.  Sketches have a bounded size and are made before the shuffle in part, so
    a hot key is no large group.  Null keys and batches are values of their own.
    """
    text = item.cast("string")
    return rows.select(*keys, batch, text.alias("_item")).groupBy(*keys, batch).agg(
        F.count(F.lit(1)).alias("n"),
        F.hll_sketch_agg("_item", F.lit(LG_BUCKETS)).alias("distinct"),
        F.expr(f"approx_top_k_accumulate(_item, {int(tracked)}) FILTER (WHERE _item IS NOT NULL)").alias("frequent"),
    )


def add_batches(sketches: DataFrame, path: str) -> None:
    """Appends the sketches of new batches to the table at ``path``."""
    sketches.write.mode("append").parquet(path)


def merged(stored: DataFrame, keys: Sequence[str], tracked: int = TRACKED) -> DataFrame:
    """``(keys, n, distinct, frequent)``: the sketches of all batches of each key in one."""
    return stored.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.hll_union_agg("distinct").alias("distinct"),
        F.expr(f"approx_top_k_combine(frequent, {int(tracked)})").alias("frequent"),
    )


def distinct_counts(stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, n, n_distinct)``: rows, and about how many distinct items, over all batches."""
    totals = stored.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct").alias("distinct"))
    return totals.select(*keys, "n", F.hll_sketch_estimate("distinct").alias("n_distinct"))


def heavy_hitters(stored: DataFrame, keys: Sequence[str], k: int, tracked: int = TRACKED) -> DataFrame:
    """``(keys, item, count)``: about the ``k`` most frequent items of each key and how often they came, over all batches.

    A count is too high by at most 3.5 / ``tracked`` of all items, and never too low.
    """
    best = merged(stored, keys, tracked).select(*keys, F.explode(F.expr(f"approx_top_k_estimate(frequent, {int(k)})")).alias("_top"))
    return best.select(*keys, F.col("_top.item").alias("item"), F.col("_top.count").alias("count"))
