"""Choosing a codebook by windows, and encoding and decoding with it by column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import join_on

# Brackets of meta tokens (fixed values): the usual ones, and those for texts that hold one of them.
PREFIX, SUFFIX = "⟦", "⟧"
ASCII_PREFIX, ASCII_SUFFIX = "<<PD", ">>"

EMPTY = "array<struct<ord:int,meta:string,pattern:string>>"


def meta_style(text: Column, style: str = "auto") -> Column:
    """``unicode`` or ``ascii``: which brackets the meta tokens of a text get."""
    if style == "auto":
        return F.when(F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)), "ascii").otherwise("unicode")
    return F.lit("unicode" if style == "unicode" else "ascii")


def meta_token(ordinal: Column, style: Column) -> Column:
    """The name of an entry: A to Z, AA to ZZ, AAA and so on, in brackets."""

    def letter(i: Column) -> Column:
        return F.chr(F.lit(65) + F.pmod(i, F.lit(26)))

    low, mid = ordinal, F.floor(ordinal / 26) - 1
    high = F.floor(mid / 26) - 1
    name = F.when(ordinal < 26, letter(low)).when(ordinal < 702, F.concat(letter(mid), letter(low)))
    name = name.otherwise(F.concat(letter(high), letter(mid), letter(low)))
    ascii_name = F.concat(F.lit(ASCII_PREFIX), name, F.lit(ASCII_SUFFIX))
    return F.when(style == "unicode", F.concat(F.lit(PREFIX), name, F.lit(SUFFIX))).otherwise(ascii_name)


def select_dictionary(candidates: DataFrame, styles: DataFrame, keys: Sequence[str], max_size: int = 256) -> DataFrame:
    """The entries ``(keys, ord, meta, pattern, cnt)`` that pay for themselves, in candidate order.

    ``styles`` has the keys and ``style``.  An entry's cost depends on the length of its
    name and so on how many came before.  Since what passes with a longer name passes with
    a shorter one, the running choice falls into tiers: the first 26 that pass with one
    letter; behind the last of them up to 676 that pass with two; behind these, three.
    """
    keys = list(keys)
    rows = join_on(candidates, styles, keys)
    ascii_ = F.col("style") != "unicode"
    bracket = [F.when(ascii_, b).otherwise(a) for a, b in ((PREFIX, ASCII_PREFIX), (SUFFIX, ASCII_SUFFIX))]
    rows = rows.where(~F.contains("pattern", bracket[0]) & ~F.contains("pattern", bracket[1]))
    frame = F.when(ascii_, 6).otherwise(2)

    def passes(letters: int) -> Column:
        size = frame + letters
        return F.col("cnt") * (F.col("len") - size) - (size + F.col("len") + 8) > 0

    so_far = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.where(passes(1)).withColumn("c1", F.count(F.lit(1)).over(so_far))
    first = F.col("c1") <= 26
    rows = rows.withColumn("c2", F.count(F.when(~first & passes(2), 1)).over(so_far))
    second = ~first & passes(2) & (F.col("c2") <= 676)
    third = ~first & (F.col("c2") > 676) & passes(3)
    chosen = rows.where(first | second | third).withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy("rank")) - 1)
    return chosen.where(F.col("ord") < max_size).select(*keys, "ord", meta_token(F.col("ord"), F.col("style")).alias("meta"), "pattern", "cnt")


def dictionary_arrays(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a scope: its entries in order, as ``dictionary``."""
    return entries.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "meta", "pattern"))).alias("dictionary"))


def encode(text: Column, dictionary: Column) -> Column:
    """Replaces each pattern by its meta token, longest patterns first, then in order."""
    order = F.array_sort(F.transform(dictionary, lambda e: F.struct((-F.length(e["pattern"])).alias("by"), e["ord"].alias("ord"), e["pattern"].alias("from"), e["meta"].alias("to"))))
    return F.aggregate(order, text, lambda acc, e: F.when(e["from"] == "", acc).otherwise(F.replace(acc, e["from"], e["to"])))


def decode(encoded: Column, dictionary: Column) -> Column:
    """Replaces each meta token by its pattern, longest tokens first, then in order."""
    order = F.array_sort(F.transform(dictionary, lambda e: F.struct((-F.length(e["meta"])).alias("by"), e["ord"].alias("ord"), e["meta"].alias("from"), e["pattern"].alias("to"))))
    return F.aggregate(order, encoded, lambda acc, e: F.replace(acc, e["from"], e["to"]))
