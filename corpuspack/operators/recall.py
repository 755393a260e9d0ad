"""Fetching pages back from a cold store, by id or by keyword."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .budget import decoded_pages

HIT = ("page_id", "score", "text", "fingerprint", "template_id")


def unique_pages(rows: DataFrame) -> DataFrame:
    """The store with each ``page_id`` once; of rows that share one, the one with the smallest fingerprint."""
    first = F.row_number().over(Window.partitionBy("page_id").orderBy("fingerprint", "encoded"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def recall_by_ids(rows: DataFrame, page_ids: Sequence[int | str]) -> DataFrame:
    """A hit for each id asked for, in order and as often as it was; ``score`` 1.

    Ids may be numbers or strings that stand for them.  ``KeyError`` if one isn't stored.
    """
    spark = rows.sparkSession
    number = {str(p): int(p) for p in page_ids if isinstance(p, int) or str(p).strip().lstrip("-").isdigit()}
    asked = spark.createDataFrame([(i, str(p), number.get(str(p))) for i, p in enumerate(page_ids)], "ord int, asked string, page_id long")
    wanted = sorted({str(p) for p in page_ids})
    # the ids as numbers, on the column as it is stored: the filter reaches the scan
    found = unique_pages(rows.where(F.col("page_id").isin(sorted(set(number.values())))))
    met = F.broadcast(asked).join(found, "page_id")
    there = {r.asked for r in met.select("asked").distinct().collect()}  # as many rows as ids were asked for
    if missing := [w for w in wanted if w not in there]:
        raise KeyError(f"page_id {missing[0]!r} not found")
    text = decoded_pages(met, ["ord"])
    return text.select("ord", "page_id", F.lit(1.0).alias("score"), "text", F.lit("").alias("fingerprint"), F.lit("").alias("template_id"))


def keyword_scores(rows: DataFrame, query: str, keys: Sequence[str] = ()) -> DataFrame:
    """The pages with a positive score: occurrences of the query's tokens in the text, and 2 for each token named in fingerprint or template id."""
    tokens = T.query_tokens(F.lit(query))
    pages = rows.select(*keys, "page_id", "fingerprint", "template_id", "encoded", "local_dictionary")
    text = decoded_pages(pages.select("*"), [*keys, "fingerprint", "template_id"])
    low = text.withColumn("_low", F.lower("text")).withColumn("_blob", F.lower(F.concat_ws(" ", F.coalesce("fingerprint", F.lit("")), F.coalesce("template_id", F.lit("")))))
    each = F.transform(tokens, lambda t: T.occurrences(F.col("_low"), t).cast("double") + F.when(F.contains(F.col("_blob"), t), 2.0).otherwise(0.0))
    score = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    return low.withColumn("score", score).where("score > 0").select(*keys, *HIT)


def keyword_search(rows: DataFrame, query: str, top_k: int = 5) -> DataFrame:
    """The ``top_k`` best pages for a query, ties in page order; none for a query without tokens."""
    if top_k < 0:
        raise ValueError("top_k must not be negative")
    return keyword_scores(rows, query).orderBy(F.desc("score"), "page_id").limit(top_k)


def recall(rows: DataFrame, page_ids: Sequence[int | str] | None = None, query: str | None = None, top_k: int = 5, method: str = "keyword") -> DataFrame:
    """Hits ``(ord, page_id, score, text, fingerprint, template_id)``: the ids asked for, then the keyword hits that aren't among them."""
    if method == "embedding":
        raise NotImplementedError("recall by embeddings needs an encoder; only keywords are supported")
    if method != "keyword":
        raise ValueError(f"unknown method {method!r}")
    if not page_ids and not query:
        raise ValueError("page_ids or a query is needed")
    by_id = recall_by_ids(rows, page_ids) if page_ids else None
    if not query:
        return by_id
    ranked = keyword_search(rows, query, top_k)
    order = F.row_number().over(Window.orderBy(F.desc("score"), "page_id"))  # at most top_k rows
    words = ranked.select((order + (len(page_ids) if page_ids else 0)).alias("ord"), *HIT)
    if by_id is None:
        return words
    seen = by_id.select(F.col("page_id").cast("string").alias("_seen")).distinct()
    return by_id.unionByName(words.join(F.broadcast(seen), F.col("page_id").cast("string") == F.col("_seen"), "left_anti"))


def fragment(hits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One ``packed_fragment`` of the hits in order, with ``n_hits`` and ``tokens_est``; empty if there are none."""
    header = F.concat(F.lit("<<<PAGE "), F.col("page_id").cast("string"), F.lit(" score="), F.format_string("%.1f", "score"), F.lit(">>>"))
    part = F.concat(header, F.lit("\n"), T.rstrip(F.col("text")), F.lit("\n"))
    packed = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_hits"), F.sort_array(F.collect_list(F.struct("ord", part.alias("part")))).alias("parts"))
    body = F.array_join(F.transform("parts", lambda p: p["part"]), "\n")
    head = F.concat(F.lit("RECALLED_PAGES (lossless from cold_store):\nn_hits="), F.col("n_hits").cast("string"), F.lit("\n\n"))
    whole = F.when(F.col("n_hits") > 0, F.concat(head, body)).otherwise("")
    return packed.select(*keys, "n_hits", whole.alias("packed_fragment")).withColumn("tokens_est", T.token_estimate(F.col("packed_fragment")))
