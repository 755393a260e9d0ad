"""Joins on keys that may be null, and running sums over groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import cut


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Joins on equal keys, of which null equals null; the keys come from ``left``.

    Keys that can't be null, such as a struct of all keys, are joined plainly: rows that are dealt by them stay where they are.
    """
    theirs = {k: f"_right_{k}" for k in keys}
    named = right.select(*[F.col(k).alias(n) for k, n in theirs.items()], *[c for c in right.columns if c not in theirs])
    null = lambda k: left.schema[k].nullable or right.schema[k].nullable
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) if null(k) else F.col(k) == F.col(n) for k, n in theirs.items()])
    return left.join(named, same, how).drop(*theirs.values())


def sums_before(rows: DataFrame, keys: Sequence[str], order: str, sums: Mapping[str, Column]) -> DataFrame:
    """``rows`` with a column for each of ``sums``: its total over the rows of the same ``keys`` with a smaller ``order``.

    ``order`` doesn't repeat within the keys; it may be of any type that sorts, and null comes first.  Null keys
    are a group like any other.  The rows are dealt by ranges of keys and ``order`` that follow the data, and kept; totals of each range's
    keys are summed first, then each range on its own.  A hot key is as many groups as it has ranges, however its
    ``order`` is spread.
    """
    keys = list(keys)
    held = {name: f"_held_{name}" for name in sums}
    rows = rows.select("*", *[value.alias(held[name]) for name, value in sums.items()])
    dealt = cut(rows.repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy(*keys, "_range").agg(*[F.sum(h).alias(h) for h in held.values()])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    opens = totals.select(*keys, "_range", *[F.coalesce(F.sum(h).over(earlier), F.lit(0)).alias(f"_open{h}") for h in held.values()])
    within = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    met = join_on(dealt, opens, [*keys, "_range"])
    found = [(F.col(f"_open{h}") + F.coalesce(F.sum(h).over(within), F.lit(0))).alias(name) for name, h in held.items()]
    return met.select(*[c for c in rows.columns if c not in held.values()], *found)
