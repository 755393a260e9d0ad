"""The k first rows of a table of any size: weighted median of medians, then a sort of the winners alone."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut


def cutoff(rows: DataFrame, key: Sequence[str], k: int) -> tuple | None:
    """The ``k``-th least value of ``key`` (columns that are never null) in ``rows``; None if there are fewer than ``k``.

    Each round is one pass in which every partition gives the medians of its keys on both sides of
    the pivot, and how many there are; nothing is shuffled, and three rows a partition reach the driver.  The median of
    those medians, each weighted by its partition's remaining keys, is the next pivot: at least a quarter of
    what remains lies on either side of it, so a quarter goes each round whatever the order of the rows.  ``rows`` is read once a round:
    give a checkpointed table.
    """
    fields = [rows.schema[c] for c in key]
    schema = T.StructType([T.StructField("side", T.IntegerType()), T.StructField("n", T.LongType()), *fields])
    values = F.struct(*key)

    def literal(found: tuple) -> Column:
        return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(found, fields)])

    def medians(batches) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        for side in (-1, 0, 1):
            of = table.filter(pc.equal(table["side"], side)).select(list(key))
            if of.num_rows:
                first = pc.sort_indices(of, sort_keys=[(c, "ascending") for c in key])[(of.num_rows - 1) // 2].as_py()
                row = of.slice(first, 1).combine_chunks()
                sizes = {"side": pa.array([side], pa.int32()), "n": pa.array([of.num_rows], pa.int64())}
                yield pa.RecordBatch.from_pydict(sizes | {c: row.column(c).chunk(0) for c in key})

    if k <= 0:
        return None
    low = high = pivot = None
    while True:
        left = rows.select(*key)
        if low is not None:
            left = left.where(values > literal(low))
        if high is not None:
            left = left.where(values < literal(high))
        side = F.lit(1) if pivot is None else F.when(values < literal(pivot), -1).when(values == literal(pivot), 0).otherwise(1)
        said = left.select(side.cast("int").alias("side"), *key).mapInArrow(medians, schema).collect()
        before, equal = (sum(r.n for r in said if r.side == s) for s in (-1, 0))
        if pivot is None:
            go = 1
        elif k <= before:
            high, go = pivot, -1
        elif k <= before + equal:
            return pivot
        else:
            low, go, k = pivot, 1, k - before - equal
        pivot = _weighted_median([(tuple(r[c] for c in key), r.n) for r in said if r.side == go])
        if pivot is None:
            return None


def _weighted_median(found: list[tuple[tuple, int]]) -> tuple | None:
    half, passed = sum(n for _, n in found) / 2, 0
    for value, n in sorted(found):
        passed += n
        if passed >= half:
            return value
    return None


def first_ranked(rows: DataFrame, key: Sequence[str], k: int, rank: str = "rank") -> DataFrame:
    """``rows`` with ``rank``: 1 to ``k`` for the ``k`` first by ``key``, null for the others.

    Only the winners are sorted; their ranks are their places in sorted partitions of
    which the sizes are known.  Of rows with equal keys at the cutoff as many win as are still free.  With fewer
    than ``k`` rows all win.  ``rows`` is read several times: give a checkpointed table.
    """
    none = F.lit(None).cast("long").alias(rank)
    if k <= 0:
        return rows.select("*", none)
    last = cutoff(rows, key, k)
    fields = [rows.schema[c] for c in key]
    wins = F.lit(True) if last is None else F.struct(*key) <= F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(last, fields)])
    won = cut(rows.where(wins).orderBy(*key).select(F.monotonically_increasing_id().alias("_at"), F.struct("*").alias("_row")))
    part = F.shiftright("_at", 33)
    opens, total = [], 0
    for r in sorted(won.groupBy(part.alias("part")).count().collect()):  # a row a partition
        opens.append((r.part, total))
        total += r["count"]
    opens = rows.sparkSession.createDataFrame(opens, "_part long, _open long")
    placed = won.join(F.broadcast(opens), part == F.col("_part"))
    place = F.col("_open") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = placed.select("_row.*", F.when(place <= k, place).alias(rank))
    return ranked if last is None else ranked.unionByName(rows.where(~wins).select("*", none))
