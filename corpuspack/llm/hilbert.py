"""Sharding along a Hilbert curve over several metadata dimensions.

Groups of equal texts are points of a grid: size, source and language, quantised.
They are ordered along the Hilbert curve of the grid and the order is cut in runs
of nearly equal bytes, so that a shard covers a compact region of every dimension
and a reader can skip files by any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Bits of each dimension of the grid.
BITS = 5
#: Slices of a grid cell, by the hash of a text, and of a group of equal texts, by the hash of an id.
SLICES = 64


def hilbert_index(coordinates: list[Column], bits: int = BITS) -> Column:
    """Position on the Hilbert curve of a point with the given coordinates, each of ``bits`` bits.

    Skilling's transform: the coordinates are turned, from the highest bit down, into
    the axes of the sub-cube they lie in; their Gray code, interleaved, is the index.
    Each step is kept in a struct, so that no expression is written out twice.
    """
    n = len(coordinates)
    state = F.struct(*[c.cast("int").alias(f"x{i}") for i, c in enumerate(coordinates)])

    def turn(q: int):
        def step(x: Column) -> Column:
            p = q - 1
            now = [x[f"x{i}"] for i in range(n)]
            for i in range(n):
                high = now[i].bitwiseAND(F.lit(q)) != 0
                t = now[0].bitwiseXOR(now[i]).bitwiseAND(F.lit(p))
                first = F.when(high, now[0].bitwiseXOR(F.lit(p))).otherwise(now[0].bitwiseXOR(t))
                other = F.when(high, now[i]).otherwise(now[i].bitwiseXOR(t))
                now[0], now[i] = first, (first if i == 0 else other)
            return F.struct(*[c.alias(f"x{i}") for i, c in enumerate(now)])

        return step

    def with_state(s: Column, f) -> Column:
        return F.transform(F.array(s), f)[0]

    q = 1 << (bits - 1)
    while q > 1:
        state = with_state(state, turn(q))
        q >>= 1

    def gray(x: Column) -> Column:
        now = [x["x0"]]
        for i in range(1, n):
            now.append(x[f"x{i}"].bitwiseXOR(now[i - 1]))
        t = F.lit(0)
        q = 1 << (bits - 1)
        while q > 1:
            t = t.bitwiseXOR(F.when(now[n - 1].bitwiseAND(F.lit(q)) != 0, q - 1).otherwise(0))
            q >>= 1
        return F.struct(*[c.bitwiseXOR(t).alias(f"x{i}") for i, c in enumerate(now)])

    def interleave(x: Column) -> Column:
        index = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for i in range(n):
                index = index * 2 + F.shiftright(x[f"x{i}"], b).bitwiseAND(F.lit(1))
        return index

    return with_state(with_state(state, gray), interleave)


def levels(rows: DataFrame, column: str, top: int) -> DataFrame:
    """``(column, level)``: the values of a column that aren't null, cut in up to ``top`` levels from 1 on of about equal numbers of rows.

    Values keep their order, so a run of levels is a range of values.  Only the table of distinct values is ordered as a whole.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = 1 + F.floor(before * top / F.sum("count").over(Window.partitionBy()))
    return counts.select(column, F.least(level, F.lit(top)).cast("int").alias("level"))


def shard_by_hilbert(docs: DataFrame, shards: int = 8, bits: int = BITS, slices: int = SLICES) -> DataFrame:
    """Puts every document into one of ``shards`` runs of the Hilbert order.

    Returns ``(doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert)``, one
    row for each row of ``docs``.  The law is ``bytes``: the sizes (UTF-8 bytes of the
    text, none for null, plus 1) of the shards are nearly equal.  Equal texts are
    one group, placed by the least of its members' source and language coordinates, and share
    a shard; a group goes to the run that holds its middle byte, so a shard's size
    misses its share by half a group at either end, at most.  ``slot`` counts a
    shard's rows from 0 along the curve.  ``grown_shard`` is null under this law.

    Offsets are sums over grid cells and slices of them, and within a group over
    slices of ids; no task orders a cell or a group of copies as a whole.  Only
    the table of cells, with ``2^(3 * bits) * slices`` rows at most, is summed in one place.

    Null sources and languages are a coordinate of their own; null texts are one group;
    rows that repeat a ``doc_id`` each have a slot.  An empty table gives an
    empty result; other columns are ignored.
    """
    columns = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "hilbert")
    return _placed(docs, shards, bits, slices).select(*columns)


def _group(text: Column) -> Column:
    """What equal texts share."""
    return F.coalesce(F.md5(F.encode(text, "UTF-8")), F.lit("null"))


def _placed(docs: DataFrame, shards: int, bits: int, slices: int) -> DataFrame:
    """The rows of :func:`shard_by_hilbert` with their ``group``."""
    text = F.col("text")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    top = (1 << bits) - 1

    thin = cut(docs.select(
        "doc_id", size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        _group(text).alias("group"),
        F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int").alias("slice"), F.col("source").cast("string"), F.col("lang").cast("string"),
    ))
    graded = thin.select("group", "slice", "size", "source", "lang")
    for c in ("source", "lang"):
        graded = graded.join(levels(graded, c, top), c, "left").withColumn(f"_{c}", F.coalesce("level", F.lit(0))).drop("level")  # 0 is for null
    parts = cut(graded.groupBy("group", "slice").agg(
        F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.min("_source").alias("source"), F.min("_lang").alias("lang")
    ))
    groups = parts.groupBy("group").agg(F.sum("n").alias("n"), F.max("size").alias("size"), F.min("source").alias("source"), F.min("lang").alias("lang"))
    magnitude = F.least(F.floor(F.log2("size") * 2), F.lit(top))  # half octaves
    groups = groups.select(
        "group", "n", (F.col("n") * F.col("size")).alias("bytes"),
        hilbert_index([magnitude, F.col("source"), F.col("lang")], bits).alias("hilbert"),
        F.when(F.col("group") == "null", 0).otherwise(F.pmod(F.conv(F.substring("group", 1, 8), 16, 10).cast("long"), F.lit(slices))).alias("part"),
    )
    groups = cut(groups)
    cells = groups.groupBy("hilbert", "part").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    along = Window.orderBy("hilbert", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(
        "hilbert", "part", F.coalesce(F.sum("bytes").over(along), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(along), F.lit(0)).alias("rows_before"), F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("hilbert", "part").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.join(starts, ["hilbert", "part"]).select(
        "group", "hilbert", "n",
        (F.col("bytes_before") + F.coalesce(F.sum("bytes").over(inside), F.lit(0)) + F.col("bytes") / 2).alias("middle"),
        (F.col("rows_before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("row"), "total",
    )
    shard = F.least(F.floor(F.col("middle") * shards / F.col("total")), F.lit(shards - 1)).cast("int")
    placed = cut(placed.select("group", "hilbert", "row", shard.alias("shard")))
    opens = placed.groupBy("shard").agg(F.min("row").alias("opens"))  # a row a shard
    of_group = Window.partitionBy("group").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.select("group", "slice", F.coalesce(F.sum("n").over(of_group), F.lit(0)).alias("ahead"))
    where = ahead.join(placed, "group").join(F.broadcast(opens), "shard")
    in_slice = Window.partitionBy("group", "slice").orderBy(F.asc_nulls_first("doc_id"))
    out = thin.join(where, ["group", "slice"])
    slot = F.col("row") - F.col("opens") + F.col("ahead") + F.row_number().over(in_slice) - 1
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "hilbert", "group",
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, file_rows: int = 1_000_000) -> None:
    """Writes ``docs`` as Parquet, a folder for each shard, rows in curve order, so that files can be skipped by any dimension.

    Every row is written once: those with a null ``doc_id`` and those that repeat one too.  Columns
    that are already called ``shard``, ``slot`` or ``hilbert`` are replaced; others may have any name.
    """
    nth = F.row_number().over(Window.partitionBy("id", "group").orderBy(F.lit(1)))  # rows of one id and text share out their slots
    placed = _placed(docs, shards, BITS, SLICES).select(F.col("doc_id").alias("id"), "group", "shard", "slot", "hilbert").withColumn("nth", nth)
    row = F.struct("*").alias("row")
    rows = docs.drop("shard", "slot", "hilbert").select(row, F.col("doc_id").alias("id"), _group(F.col("text")).alias("group")).withColumn("nth", nth)
    r, p = rows.alias("r"), placed.alias("p")
    same = (F.col("r.group") == F.col("p.group")) & (F.col("r.nth") == F.col("p.nth")) & F.col("r.id").eqNullSafe(F.col("p.id"))
    named = r.join(p, same).select("r.row.*", "p.shard", "p.slot", "p.hilbert")
    dealt = named.repartition("shard", F.floor(F.col("slot") / file_rows)).sortWithinPartitions("shard", "slot")
    dealt.write.mode("overwrite").partitionBy("shard").parquet(path)
