"""Importance resampling towards a target distribution, over hashed runs of words.

Every run of one to three words falls into one of a fixed number of buckets by its
crc32.  A bucket's gain is the log ratio of its share in the target and in the documents; a
document's weight is the sum of gains over its features, and noise from its id turns the
highest weights into a draw without replacement.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch_path
from .selection import first_ranked
from .words import utf8, words_in_pieces


@dataclass(frozen=True)
class ResampleOptions:
    buckets: int = 10_000
    #: Draw this percentage of the documents that have so many words at least.
    percent: int = 5
    least_words: int = 20
    seed: int = 42


def feature_buckets(text: bytes, buckets: int) -> Iterator[tuple[int, object]]:
    """For each piece of a text, its number of words and the buckets of all runs of one to three words that end in it."""
    from zlib import crc32

    import numpy as np

    before: list[bytes] = []
    for new in words_in_pieces(text):
        words, old = before + new, len(before)
        behind = [b" " + w for w in words]
        one = list(map(crc32, words))
        # crc32 goes on from where the shorter run's ended
        two = list(map(crc32, behind[1:], one))
        three = list(map(crc32, behind[2:], two))
        ends = one[old:] + two[max(old - 1, 0) :] + three[max(old - 2, 0) :]
        yield len(new), np.array(ends, dtype=np.uint32) % buckets
        before = words[-2:]


def bucket_counts(texts: DataFrame, buckets: int) -> dict[int, int]:
    """How many features of all ``texts`` fall into each bucket; summed in the tasks first."""

    def count(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        found = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in utf8(batch.column(0)):
                for _, of in feature_buckets(text, buckets):
                    found += np.bincount(of, minlength=buckets)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(found[some])], names=["bucket", "n"])

    counted = texts.select("text").where("text is not null").mapInArrow(count, "bucket int, n long")
    return {r.bucket: r.n for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # a row a bucket


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """The gain of each bucket in thousandths, rounded down, with one added to each count."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    ratio = lambda b: ((target.get(b, 0) + 1) * s_all) / ((source.get(b, 0) + 1) * t_all)
    return [math.floor(1000 * math.log(ratio(b))) for b in range(buckets)]


def weighed(docs: DataFrame, gain: list[int]) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` of every document, from its whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # a number a bucket
    rows = docs.select("doc_id", "text")

    def weigh(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        value = np.array(sent.value, dtype=np.int64)
        for batch in batches:
            out = np.zeros((3, batch.num_rows), dtype=np.int64)
            for i, text in enumerate(utf8(batch.column(1))):
                for n, of in feature_buckets(text, len(value)):
                    out[:, i] += n, len(of), value[of].sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise of an id in thousandths, rounded down; a null id counts as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, options: ResampleOptions = ResampleOptions()) -> DataFrame:
    """Every document's ``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank``: its place in the draw, null if it isn't drawn.

    Both tables have ``text``; other columns, whatever their names, are not looked at.  The draw takes
    ``percent`` of the documents of ``least_words`` words or more, highest scores
    first, ties to the smaller ``doc_id``, null ids last.  Null and empty texts have no features: weight 0, not drawn.
    Rows that repeat an id are documents of their own.  An empty target, or an empty table, gives every bucket
    what its count alone says; no rows give none.
    """
    gain = gains(bucket_counts(docs, options.buckets), bucket_counts(target, options.buckets), options.buckets)
    score = (F.col("weight") + noise(F.col("doc_id"), options.seed)).alias("score")
    scored = cut(weighed(docs, gain).select("*", score))
    free = scored.where(F.col("n_words") >= options.least_words)
    k = options.percent * free.count() // 100
    key = [(-F.col("score")).alias("k0"), F.col("doc_id").isNull().cast("int").alias("k1"), F.coalesce("doc_id", F.lit("0").cast(docs.schema["doc_id"].dataType)).alias("k2"), F.col("n_features").alias("k3")]
    ranked = first_ranked(free.select("*", *key), ["k0", "k1", "k2", "k3"], k)
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(F.col("n_words") < options.least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, "rank").unionByName(rest)


def resampled_documents(docs: DataFrame, target: DataFrame, options: ResampleOptions = ResampleOptions()) -> DataFrame:
    """The documents that :func:`resample` draws, with all their columns.  Ids have to be unique; null ids are left out."""
    path = scratch_path(docs.sparkSession, "drawn")
    resample(docs, target, options).where("rank is not null and doc_id is not null").select(F.col("doc_id").alias("_drawn")).write.parquet(path)
    drawn = docs.sparkSession.read.parquet(path)
    return docs.join(drawn, docs["doc_id"] == drawn["_drawn"], "left_semi")
