"""A directory as a tree of sheets, for scopes with more pages than one value can list."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.session import cut
from .packing import in_order
from .running import join_on, sums_before


def _number(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("null"))


def _quoted(name: str) -> Column:
    return F.when(F.col(name).isNull(), "null").otherwise(T.json_text(F.col(name)))


def page_line() -> Column:
    """What a sheet says of a page."""
    return F.concat(
        F.lit('{"page_id": '), _number("page_id"), F.lit(', "template_id": '), _quoted("template_id"),
        F.lit(', "fingerprint": '), _quoted("fingerprint"), F.lit(', "tokens_est": '), _number("original_tokens_est"), F.lit("}"),
    )


def sheet_line() -> Column:
    """What a sheet says of a sheet beneath it."""
    return F.concat(
        F.lit('{"sheet": "'), F.col("level").cast("string"), F.lit("/"), F.col("node").cast("string"), F.lit('", "pages": ['), _number("first_page"), F.lit(", "), _number("last_page"),
        F.lit('], "n_pages": '), F.col("n_pages").cast("string"), F.lit(', "tokens_est": '), _number("tokens_est"), F.lit("}"),
    )


def directory_tree(rows: DataFrame, keys: Sequence[str], fanout: int = 256) -> DataFrame:
    """The directory of ``rows(keys, page_id, template_id, fingerprint, original_tokens_est)`` as sheets of ``fanout`` lines at most.

    Returns ``(keys, level, node, root, first_page, last_page, n_pages, tokens_est, sheet)``.  Sheets of level 0 list pages,
    those of level n + 1 list the sheets of level n with their range of pages and their summed tokens; ``node`` counts
    from 0 in the order of pages, so ``(level, node)`` stands in ``(level + 1, node div fanout)``.  The one sheet of a scope's last level is its ``root``.

    Each level is made from the one beneath, which is ``fanout`` times as long, and no group has more than ``fanout``
    rows, however many pages a scope has.  Null keys are a scope; null pages come first; rows of the same page stand side by side.
    The driver learns the number of pages of the largest scope, nothing else.
    """
    if fanout < 2:
        raise ValueError("a sheet needs two lines at least")
    keys = list(keys)
    pages = rows.select(*keys, "page_id", F.col("original_tokens_est").cast("long").alias("tokens_est"), page_line().alias("line"))
    sizes = cut(pages.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_scope")))
    placed = sums_before(pages.withColumn("_at", F.struct("page_id", "line")), keys, "_at", {"place": F.lit(1).cast("long")})
    beneath = join_on(placed, sizes, keys).select(
        *keys, "n_scope", "place", F.col("page_id").alias("first_page"), F.col("page_id").alias("last_page"), F.lit(1).cast("long").alias("n_pages"), "tokens_est", "line"
    )
    largest = sizes.agg(F.max("n_scope")).first()[0] or 0
    levels, reach = [], fanout
    while not levels or largest > reach // fanout:
        node = ((F.col("place") - F.pmod("place", F.lit(fanout))) / fanout).cast("long")
        sheets = beneath.groupBy(*keys, "n_scope", node.alias("node")).agg(
            F.min("first_page").alias("first_page"), F.max("last_page").alias("last_page"), F.sum("n_pages").alias("n_pages"),
            F.sum("tokens_est").alias("tokens_est"), F.array_join(in_order(F.col("place"), F.col("line")), "\n").alias("sheet"),
        )
        sheets = cut(sheets.withColumn("level", F.lit(len(levels))).withColumn("root", F.col("n_scope") <= reach))
        levels.append(sheets)
        beneath = sheets.where(~F.col("root")).withColumn("place", F.col("node")).withColumn("line", sheet_line())
        reach *= fanout
    return reduce(DataFrame.unionByName, levels).select(*keys, "level", "node", "root", "first_page", "last_page", "n_pages", "tokens_est", "sheet")


def shown_sheets(tree: DataFrame, keys: Sequence[str], token_budget: int) -> DataFrame:
    """The sheets that ``token_budget`` has room for, with ``entry``, their text under a heading, and ``at``, their order in a prompt.

    From the root down, level by level, in the order of pages; the first that doesn't fit ends the list, so a sheet
    is shown only beneath a shown one.  Entries are counted with a line end each.
    """
    heading = F.concat(F.lit("<<<SHEET "), F.col("level").cast("string"), F.lit("/"), F.col("node").cast("string"), F.lit(">>>\n"))
    entries = tree.withColumn("entry", F.concat(heading, "sheet")).withColumn("at", F.struct((-F.col("level")).alias("up"), "node"))
    size = F.length("entry") + 1
    counted = sums_before(entries, list(keys), "at", {"_upto": size})
    return counted.where(F.floor((F.col("_upto") + size + 3) / 4) <= token_budget).drop("_upto")


def sheets_of_page(tree: DataFrame, page_id) -> DataFrame:
    """The sheets that lead to a page, one a level of each scope: a filter on their ranges."""
    return tree.where((F.col("first_page") <= F.lit(page_id)) & (F.col("last_page") >= F.lit(page_id)))
