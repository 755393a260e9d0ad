"""Hard negatives by a vertical scan: dimensions are read one after the other, and what is still to come bounds every score.

Vectors are stored in blocks, each dimension of a block in one piece with its least and greatest
component.  For an anchor the dimensions are read in descending magnitude of its own
components; after each few the scores so far, and the least and most that the remaining dimensions can add,
shrink the set of candidates, until what is left is resolved exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path

#: Vectors of a block and anchors of a batch, at most; fewer where vectors are so long that a block would have more bytes than this.
BLOCK_ROWS, BATCH_ROWS, BLOCK_BYTES = 4096, 256, 1 << 22
#: Batches of anchors that meet a block in one task's group, about.
GROUP_BATCHES = 32
#: Dimensions read between two looks at the bounds.
STEP = 8
#: Greatest sum of squares of a vector's whole numbers, for which every score and partial score is exact in a double.
MOST_SQUARES = float(1 << 52)


@dataclass(frozen=True)
class MiningOptions:
    positives: int = 5
    negatives: int = 10
    #: A negative's score over the positive's, in percent: from and to.
    least_percent: int = 30
    most_percent: int = 90
    #: Components become floor(scale * x).
    scale: int = 256


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """``(vec_id, label, width, v)`` of the vectors that take part, each id once, with components in whole numbers."""
    x = F.col("embedding").cast("array<double>")
    good = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & good)
    rows = rows.withColumn("v", F.transform("x", lambda c: F.floor(c * scale).cast("double"))).drop("x")
    rows = rows.where(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c) <= MOST_SQUARES)
    once = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    return once.select("vec_id", "r.label", F.size("r.v").alias("width"), "r.v")


def _packed(rows: DataFrame, most_rows: int, name: str) -> DataFrame:
    """The rows in blocks of one vector length, near in label: ids, labels and vectors as binary, and the labels of each block."""
    more = [c for c in ("positive", "score") if c in rows.columns]  # lists of one length a row

    def pack(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        at, held = TaskContext.get().partitionId() << 32, {}

        def block(width, tables):
            nonlocal at
            table = pa.concat_tables(tables).combine_chunks()
            take = lambda c: table.column(c).combine_chunks() if isinstance(table.column(c), pa.ChunkedArray) else table.column(c)
            labels = take("label").to_numpy()
            out = {name: at, "width": width, "n": table.num_rows, "labels": np.unique(labels).tolist(), "ids": take("vec_id").to_numpy().tobytes(),
                   "of": labels.tobytes(), "vectors": take("v").flatten().to_numpy().astype(np.float64).tobytes()}
            out |= {c: pa.array(take(c)).flatten().to_numpy().tobytes() for c in more}
            at += 1
            return pa.RecordBatch.from_pylist([out], schema=pa.schema([
                (name, pa.int64()), ("width", pa.int32()), ("n", pa.int32()), ("labels", pa.list_(pa.int64())),
                *[(c, pa.binary()) for c in ("ids", "of", "vectors", *more)],
            ]))

        def limit(width):
            return max(1, min(most_rows, BLOCK_BYTES // (8 * max(1, width))))

        for batch in batches:
            table = pa.Table.from_batches([batch])
            widths = table.column("width").to_numpy()
            for width in np.unique(widths).tolist():
                part = table.filter(pa.array(widths == width))
                while part.num_rows:
                    tables = held.setdefault(width, [])
                    free = limit(width) - sum(t.num_rows for t in tables)
                    tables.append(part.slice(0, free))
                    part = part.slice(free)
                    if sum(t.num_rows for t in tables) == limit(width):
                        yield block(width, held.pop(width))
        for width, tables in held.items():
            yield block(width, tables)

    spread = [F.col("width"), F.col("label"), F.xxhash64("vec_id")]
    path = scratch_path(rows.sparkSession, name)
    schema = f"{name} long, width int, n int, labels array<long>, ids binary, of binary, vectors binary{''.join(f', {c} binary' for c in more)}"
    rows.repartitionByRange(*spread).sortWithinPartitions(*spread).mapInArrow(pack, schema).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


class Block:
    """Vectors of one length by dimension, with what each can contribute."""

    def __init__(self, row: dict):
        import numpy as np

        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["of"], np.int64)
        self.columns = np.ascontiguousarray(np.frombuffer(row["vectors"]).reshape(len(self.ids), row["width"]).T)
        none = np.zeros(row["width"])
        self.least, self.most = (self.columns.min(1), self.columns.max(1)) if len(self.ids) else (none, none)

    def scan(self, anchor, candidates, alive):
        """The candidates that ``alive`` keeps to the end, and their scores.

        ``alive(low, high)`` says which candidates may still matter, given bounds of their scores.
        """
        import numpy as np

        order = np.argsort(-np.abs(anchor), kind="stable")
        given = anchor[order]
        ends = np.stack([given * self.least[order], given * self.most[order]])
        # what the dimensions from each on can add; their sums may be rounded, scores themselves are exact
        to_come = np.cumsum(np.stack([ends.min(0), ends.max(0)])[:, ::-1], axis=1)[:, ::-1]
        slack = np.abs(ends).sum() * 2.0**-40
        score = np.zeros(len(candidates))
        for at in range(0, len(order), STEP):
            some = order[at : at + STEP]
            whole = len(candidates) == len(self.ids)
            score = score + given[at : at + STEP] @ (self.columns[some] if whole else self.columns[some[:, None], candidates])
            if at + STEP < len(order):
                low, high = to_come[:, at + STEP]
                keep = alive(score + (low - slack), score + (high + slack))
                candidates, score = candidates[keep], score[keep]
                if not len(candidates):
                    break
        return candidates, score.astype(np.int64)

    def best(self, candidates, score, k: int):
        import numpy as np

        first = np.lexsort((self.ids[candidates], -score))[:k]
        return self.ids[candidates[first]], score[first]


def _kth(values, k: int) -> float:
    import numpy as np

    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -math.inf


def positives_in(block: Block, anchor_id, label, vector, k: int):
    """The ``k`` best rows of an anchor's own label in a block."""
    import numpy as np

    candidates = np.flatnonzero((block.labels == label) & (block.ids != anchor_id))
    return block.best(*block.scan(vector, candidates, lambda low, high: high >= _kth(low, k)), k)


def negatives_in(block: Block, label, vector, windows, k: int):
    """For each window ``(from, to)`` of scores the ``k`` best rows of other labels in a block that lie in it."""
    import numpy as np

    def alive(low, high):
        keep = np.zeros(len(low), dtype=bool)
        for lo, hi in windows:
            inside = (low >= lo) & (high <= hi)
            keep |= (high >= max(lo, _kth(low[inside], k))) & (low <= hi)
        return keep

    candidates, score = block.scan(vector, np.flatnonzero(block.labels != label), alive)
    for lo, hi in windows:
        some = (score >= lo) & (score <= hi)
        yield block.best(candidates[some], score[some], k)


def _meetings(batches: DataFrame, blocks: DataFrame, pairs: DataFrame, work, schema: str) -> DataFrame:
    """What ``work`` (a block's row, a batch's row) yields for all ``pairs(batch, block)``.

    A group has one block and about :data:`GROUP_BATCHES` batches, whose sizes are bounded.
    """
    groups = max(1, -(-batches.select("batch").count() // GROUP_BATCHES))
    dealt = pairs.withColumn("share", F.pmod(F.xxhash64("batch"), F.lit(groups)).cast("int"))
    sent = dealt.join(batches.drop("labels"), "batch")
    copies = dealt.select("block", "share").distinct().join(blocks.drop("labels"), "block")

    def meet(left, right):
        import pyarrow as pa

        rows = []
        for row in left.to_pylist():
            block = Block(row)
            for other in right.to_pylist():
                rows += work(block, other)
        return pa.Table.from_pylist(rows, schema=pa.schema([(c.split()[0], pa.int64()) for c in schema.split(", ")]))

    # both stem from the pairs: new names for the columns of one side
    copies = copies.select(F.col("block").alias("at"), F.col("share").alias("part"), *[c for c in blocks.columns if c not in ("block", "labels")])
    return copies.groupBy("at", "part").cogroup(sent.groupBy("block", "share")).applyInArrow(meet, schema)


def _anchors_of(row: dict):
    import numpy as np

    vectors = np.frombuffer(row["vectors"]).reshape(row["n"], row["width"])
    return zip(np.frombuffer(row["ids"], np.int64).tolist(), np.frombuffer(row["of"], np.int64).tolist(), vectors)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, options: MiningOptions = MiningOptions()) -> DataFrame:
    """For every anchor and each of its best positives the best rows of other labels whose score lies in a window below the positive's.

    ``vectors`` has ``vec_id``, ``label`` and ``embedding``, ``anchors`` the ``vec_id`` of some of them.  Scores are inner
    products of ``floor(scale * x)``; higher come first, ties to the smaller ``vec_id``.  Returns ``anchor_id``, ``positive_id``, ``rank``
    (from 1), ``negative_id``, ``positive_score`` and ``negative_score``: the first ``negatives`` rows of another label with
    ``least_percent * positive_score <= 100 * negative_score <= most_percent * positive_score``, for the first ``positives`` other rows of the anchor's label.

    Every anchor is held against all rows of its vector length, in blocks; within a block the scan drops candidates by bounds, so results are exact.
    Null ids and labels, null vectors and null or non-finite components take no part, nor do vectors whose whole numbers have squares that sum to over 2^52.
    Of rows that repeat an id the least one by label and vector counts.  Anchors that aren't among the vectors, have no positives or nothing in the
    window, and empty tables, give no rows.  Other columns are ignored.
    """
    keep = options.positives
    rows = usable(vectors, options.scale)
    blocks = _packed(rows, BLOCK_ROWS, "block")
    asked = rows.join(anchors.select(F.col("vec_id").cast("long")).where("vec_id is not null").distinct(), "vec_id", "left_semi")
    first = _packed(asked, BATCH_ROWS, "batch")

    def positive(block, row):
        for anchor_id, label, vector in _anchors_of(row):
            for other, score in zip(*(x.tolist() for x in positives_in(block, anchor_id, label, vector, keep))):
                yield {"anchor_id": anchor_id, "vec_id": other, "score": score}

    # an anchor goes to the blocks of its label only
    pairs = first.select("batch", "width", F.explode("labels").alias("label")).join(blocks.select("block", "width", F.explode("labels").alias("label")), ["width", "label"])
    near = _meetings(first, blocks, pairs.select("batch", "block").distinct(), positive, "anchor_id long, vec_id long, score long")
    placed = near.withColumn("_n", F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("_n") <= keep)
    placed = placed.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("p"))
    # lists of one length: what is missing has no id
    padded = lambda c: F.transform(F.sequence(F.lit(0), F.lit(keep - 1)), lambda i: F.coalesce(F.get("p", i)[c], F.lit(-(1 << 62))))
    wanted = asked.join(placed.select(F.col("anchor_id").alias("vec_id"), padded("vec_id").alias("positive"), padded("score").alias("score")), "vec_id")
    second = _packed(wanted, BATCH_ROWS, "batch")

    def negative(block, row):
        import numpy as np

        found, scores = (np.frombuffer(row[c], np.int64).reshape(row["n"], keep).tolist() for c in ("positive", "score"))
        for (anchor_id, label, vector), of, reached in zip(_anchors_of(row), found, scores):
            some = [(p, s) for p, s in zip(of, reached) if s > -(1 << 62)]
            windows = [(-(-options.least_percent * s // 100), options.most_percent * s // 100) for _, s in some]
            for (p, s), (ids, best) in zip(some, negatives_in(block, label, vector, windows, options.negatives)):
                for other, score in zip(ids.tolist(), best.tolist()):
                    yield {"anchor_id": anchor_id, "positive_id": p, "positive_score": s, "negative_id": other, "negative_score": score}

    # a block of one label has nothing for anchors of that label alone
    alike = (F.size("labels") == 1) & (F.size("theirs") == 1) & (F.get("labels", F.lit(0)) == F.get("theirs", F.lit(0)))
    pairs = second.select("batch", "width", F.col("labels").alias("theirs")).join(blocks.select("block", "width", "labels"), "width").where(~alike)
    far = _meetings(second, blocks, pairs.select("batch", "block"), negative, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= options.negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
d AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM d WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN d USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
