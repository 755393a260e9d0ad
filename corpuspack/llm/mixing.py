"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, word_count

#: Slices of a source's ranking: their totals are summed first, then each is ranked on its own.
SLICES = 4096
#: Tables of so many sources are broadcast; larger ones are joined by shuffling.
FEW_SOURCES = 10_000


def source_targets(sources: DataFrame, weights: Sequence[float], max_repeat: float) -> DataFrame:
    """Adds ``target`` words to ``(source, source_size)``: weights dealt to the sources by code point, null last.

    All targets sum to the size of all sources.  A target stops at ``max_repeat``
    times its source's size and the excess is shared out again by weight until
    none is above, in closed form: with the sources ordered by cap / weight, the
    water level is the largest of (total - caps before) / (weights from here on).
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    dealt = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("weight", F.get(dealt, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(max_repeat))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", left / F.sum("weight").over(onward))
    level = F.max("level").over(everything)
    return levels.withColumn("target", F.least("cap", F.col("weight") * level)).select("source", "source_size", "target")


def uniform(doc_id: Column, seed: int) -> Column:
    """A number between 0 and 1, exclusive, from the id and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    max_repeat: int = 3,
    seed: int = 1,
    weight: str | None = None,
    keep: Sequence[Column] = (),
) -> DataFrame:
    """How often each document goes into the mix.

    Returns ``(doc_id, size, source_size, target, taken, source, copies)``, one
    row for each row of ``docs``: its words, its source's words and target, and
    ``copies * size`` words that the mix takes of it.  ``keep`` adds columns of ``docs``.

    A document is expected ``target / source_size`` times, times its value of the
    column ``weight`` over the source's mean of it (if given), ``max_repeat`` at
    most.  The whole part are certain copies.  The fraction ``p`` is its inclusion
    probability for one more: documents are ranked by Pareto order sampling, by the
    odds of a random number over the odds of ``p``, and taken in that order up to
    the document whose middle passes what the target still lacks.  So the sample's
    size in words is fixed.  One document a source is then added or left out, the one
    that best fills the gap that this cut leaves, if any makes it smaller.

    The random number comes from ``doc_id`` and ``seed``; reruns agree.  Ranks are
    cut in slices and summed per slice before any row is ranked, so a hot source is
    spread over ``SLICES`` groups.  Only the table of sources is ordered as a whole.

    A null source is a source of its own; null and empty texts have size 0 and take
    no words; a weight that is null or not positive counts as 0; rows that repeat a
    ``doc_id`` share their rank and are taken one after the other.  An empty table
    gives an empty result; further columns are ignored.
    """
    source = F.col("source").cast("string")
    own = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight else F.lit(1.0)
    thin = cut(docs.select(
        "doc_id", source.alias("source"), word_count(F.col("text")).alias("size"), own.alias("own"),
        uniform(F.col("doc_id"), seed).alias("u"), *keep,
    ))
    kept = [c for c in thin.columns if c not in ("doc_id", "source", "size", "own", "u")]
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("skey")
    sizes = thin.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.try_divide(F.sum(F.col("own") * F.col("size")), F.sum("size")).alias("mean")
    )
    targets = source_targets(sizes, weights, max_repeat)
    targets = targets.select(key, "source_size", "target").join(sizes.select(key, "mean"), "skey")
    targets = cut(targets)
    # a row a source: broadcast if there are few, so that no task gets all rows of a hot one
    few = targets.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    hinted = F.broadcast if few else lambda df: df

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    if weight:
        rate = F.when(F.col("mean") > 0, rate * F.col("own") / F.col("mean")).otherwise(rate)
    rows = thin.withColumn("skey", key).join(hinted(targets), "skey").withColumn("rate", F.least(rate, F.lit(float(max_repeat))))
    rows = rows.withColumn("sure", F.floor("rate")).withColumn("p", F.col("rate") - F.col("sure"))
    odds = F.col("u") / (1 - F.col("u"))
    rows = rows.withColumn("rank_by", F.when(F.col("p") > 0, odds / (F.col("p") / (1 - F.col("p")))))
    place = F.coalesce(F.col("rank_by") / (1 + F.col("rank_by")), F.col("u"))
    rows = rows.withColumn("slice", F.least(F.floor(place * SLICES), F.lit(SLICES - 1)))
    rows = rows.withColumn("open", F.when(F.col("p") > 0, F.col("size")).otherwise(0))

    slices = rows.groupBy("skey", "slice").agg(
        F.sum("open").alias("open"), F.sum(F.col("sure") * F.col("size")).alias("sure"), F.first("target").alias("target")
    )
    of_source = Window.partitionBy("skey")
    before = of_source.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(
        "skey", "slice",
        F.coalesce(F.sum("open").over(before), F.lit(0)).alias("slices_before"),
        (F.col("target") - F.sum("sure").over(of_source)).alias("lacking"),
    )
    in_slice = Window.partitionBy("skey", "slice").orderBy(F.asc_nulls_last("rank_by"), "doc_id", "size")
    ahead = F.coalesce(F.sum("open").over(in_slice.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = rows.join(slices, ["skey", "slice"]).withColumn("ahead", F.col("slices_before") + ahead)
    more = (F.col("p") > 0) & (F.col("ahead") + F.col("size") / 2 <= F.col("lacking"))
    ranked = cut(ranked.withColumn("more", more))

    gaps = ranked.groupBy("skey").agg((F.max("lacking") - F.sum(F.when(F.col("more"), F.col("size")).otherwise(0))).alias("gap"))
    misses = F.abs(F.col("size") - F.abs("gap"))
    fits = ranked.where("p > 0").join(hinted(gaps), "skey").where(F.col("more") == (F.col("gap") < 0)).groupBy("skey")
    fits = fits.agg(F.min(F.struct(misses.alias("misses"), "rank_by", "doc_id", "size")).alias("fit"), F.first("gap").alias("gap"))
    fits = fits.where(F.col("fit.misses") < F.abs("gap")).select("skey", "fit")
    turned = (F.col("p") > 0) & (F.col("rank_by") == F.col("fit.rank_by")) & F.col("doc_id").eqNullSafe(F.col("fit.doc_id")) & (F.col("size") == F.col("fit.size"))
    one_more = F.col("more") != F.coalesce(turned, F.lit(False))
    copies = (F.col("sure") + F.when(one_more, 1).otherwise(0)).cast("long")
    return ranked.join(hinted(fits), "skey", "left").select(
        "doc_id", ranked["size"], "source_size", "target", (copies * ranked["size"]).alias("taken"), "source", copies.alias("copies"), *kept
    )


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` as the mix takes them: documents of 0 copies go, others are repeated; all columns stay, whatever their names.

    Parameters as for :func:`mix_sources`.  Decisions are joined back by id, source
    and a hash of the text; rows that agree in these share out their copies.
    """
    a, b = F.xxhash64("doc_id", "source").alias("ka"), F.xxhash64("text", F.lit(17)).alias("kb")
    decided = mix_sources(docs, keep=(a, b), **parameters).groupBy("ka", "kb")
    decided = decided.agg(F.sort_array(F.collect_list("copies"), asc=False).alias("dealt")).where("dealt[0] > 0")
    met = docs.select(F.struct("*").alias("row"), a, b).join(decided, ["ka", "kb"])
    nth = F.row_number().over(Window.partitionBy("ka", "kb").orderBy(F.lit(1)))
    met = met.withColumn("n", F.get("dealt", nth - 1)).where("n > 0")
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("row.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':1'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM d GROUP BY source),
f AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap,
         (sum(source_size) OVER ()::DOUBLE
          - coalesce(sum(source_size * 3.0::DOUBLE) OVER (ORDER BY source_size * 3.0::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY source_size * 3.0::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
t AS (SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM f),
r AS (
  SELECT d.*, t.source_size, t.target,
         floor(CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END) AS sure,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END - floor(CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END) AS p
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank_by, target - sum(sure * size) OVER (PARTITION BY source) AS lacking FROM r),
w AS (
  SELECT *, coalesce(sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank_by ASC NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS ahead
  FROM q),
m AS (SELECT *, p > 0 AND ahead + size / 2.0::DOUBLE <= lacking AS more FROM w),
g AS (SELECT *, lacking - coalesce(sum(size) FILTER (more) OVER (PARTITION BY source), 0)::DOUBLE AS gap FROM m),
b AS (
  SELECT source, min({'misses': abs(size - abs(gap)), 'rank_by': rank_by, 'doc_id': doc_id}) AS fit, any_value(gap) AS gap
  FROM g WHERE p > 0 AND more = (gap < 0) GROUP BY source),
c AS (
  SELECT g.*, (sure + CASE WHEN more <> coalesce(p > 0 AND abs(b.fit.misses) < abs(b.gap) AND g.doc_id = b.fit.doc_id, false) THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM g LEFT JOIN b ON g.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM c
"""
