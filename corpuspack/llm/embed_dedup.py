"""Embedding near-duplicates by iterative quantisation.

Rotations are learned for balanced binary codes (ITQ).  A vector's code, the bits of all rotations, is cut into
substrings, each filed in a table of its own: a multi-index of the code, in which vectors meet that
agree in a whole substring.  What meets is compared by cosine on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, merge_labels, sorted_runs, split_hot
from .components import connected_components

#: Vectors that the rotations are learned from, at most: those with the smallest hash.
TRAIN_ROWS = 20_000
#: Members of a table's bucket that are compared in one group.
BLOCK = 2048
#: Aimed share of the pairs exactly at the threshold that meet in some table; closer pairs meet more surely.
AIM = 0.995
#: Parts of the sample's mean that may be taken off before coding; 0 keeps the angles of the vectors themselves.
CENTRES = (1.0, 0.75, 0.5, 0.25, 0.0)
#: What filing a vector in one more table costs, counted in comparisons of two vectors.
FILED = 200
#: Whole labels are compared where no code parts the vectors: where all tables together would compare every pair more than so many times.
TOO_DEAR = 2.0
#: Bits of a key, at least and at most; vectors of one length that the rotations are learned from, at least.
SHORTEST_KEY, LONGEST_KEY, LEAST_SAMPLE = 4, 24, 50
#: Vectors of the sample that plans are compared on.
TRIED = 4_000


@dataclass
class Codes:
    """What the tasks need to file a vector: what is taken off, the rotations and the tables' bits."""

    mean: object  # (d,)
    rotations: object  # (d, bits)
    tables: int
    bits: int

    def bits_of(self, units):
        return (units - self.mean) @ self.rotations > 0

    def keys(self, units):
        """The bucket of each unit vector (row) in each table, as an array (rows, tables)."""
        import numpy as np

        ones = self.bits_of(units)
        weights = np.int64(1) << np.arange(self.bits, dtype=np.int64)
        return ones[:, : self.tables * self.bits].reshape(len(units), self.tables, self.bits) @ weights


def valid(vectors: DataFrame) -> DataFrame:
    """``(vec_id, grp, v, k1, k2)`` of all rows; all but ``vec_id`` are null where a row can't be linked.

    That takes an id, a label, and a vector that is neither null nor zero and holds only
    finite components.  ``grp`` stands for the label, of any type, and the vector's
    length; ``k1`` and ``k2`` for these and the components.  ``v`` is as precise as the column.
    """
    held = vectors.schema["embedding"].dataType.elementType
    v = F.col("embedding") if isinstance(held, T.FloatType) else F.col("embedding").cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    good = good & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = vectors.select(F.col("vec_id").cast("long"), "label", v.alias("v"))
    rows = rows.select("vec_id", "label", F.when(F.coalesce(good, F.lit(False)), F.col("v")).alias("v"))
    grp = F.when(F.col("v").isNotNull(), F.xxhash64("label", F.size("v")))
    rows = rows.select("vec_id", grp.alias("grp"), "v")
    some = F.col("v").isNotNull()
    return rows.select("*", F.when(some, F.xxhash64("grp", "v")).alias("k1"), F.when(some, F.xxhash64("v", F.lit(1))).alias("k2"))


def to_units(v):
    """The rows as unit vectors in double precision; scaled by the largest component first, so that huge ones don't overflow."""
    import numpy as np

    v = v.astype(np.float64)
    v = v / np.abs(v).max(1)[:, None]
    return v / np.linalg.norm(v, axis=1)[:, None]


def learn(sample, bits: int, tables: int, rounds: int = 30, seed: int = 7, centre=None) -> Codes:
    """ITQ on the rows of ``sample`` (unit vectors): as many rotations as ``tables`` of ``bits`` need.

    Each rotation starts from another random one and alternates between the
    nearest binary codes and the rotation that fits them best (orthogonal
    Procrustes), on the principal axes of the sample around ``centre`` (its mean
    if not given).  With no bits all vectors have one key.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    mean = sample.mean(0) if centre is None else centre
    centred = sample - mean
    d = sample.shape[1]
    if not bits:
        return Codes(mean, np.zeros((d, 0)), tables, bits)
    _, axes = np.linalg.eigh(centred.T @ centred)
    projected = centred @ axes
    found = []
    for _ in range(-(-bits * tables // d)):
        turn, _ = np.linalg.qr(rng.normal(size=(d, d)))
        for _ in range(rounds):
            codes = np.where(projected @ turn >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(projected.T @ codes)
            turn = left @ right
        found.append(axes @ turn)
    return Codes(mean, np.concatenate(found, axis=1), tables, bits)


def plan_tables(bits: int, threshold: float, aim: float = AIM, norms=(1.0,), most: int = 1 << 20) -> int | None:
    """Tables of keys of ``bits`` bits that let a pair at the threshold miss all of them with probability ``1 - aim``.

    Each bit differs with the probability angle / pi.  The angle is the widest that the
    pair's distance can have where the shorter one of its centred vectors has one of the
    ``norms``; the probability is their mean.  None if ``most`` tables don't do.
    """
    import numpy as np

    half = math.sqrt(max(0.0, (1 - threshold) / 2))  # of the distance of two unit vectors
    angle = 2 * np.arcsin(np.minimum(1.0, half / np.maximum(np.asarray(norms, dtype=float), 1e-12)))
    misses = np.log1p(-np.minimum((1 - angle / math.pi) ** bits, 1 - 1e-12))

    def enough(tables: int) -> bool:
        return np.exp(misses * tables).mean() <= 1 - aim

    if not enough(most):
        return None
    low, high = 0, most
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if enough(middle) else (middle, high)
    return high


def plan(sample, labels, largest: int, threshold: float, aim: float = AIM) -> Codes:
    """The cheapest codes that let a pair at the threshold meet with the probability ``aim``.

    Short keys need few tables, long ones leave few vectors in a bucket; how full buckets
    get is measured on the ``sample`` (unit vectors, with their ``labels``).  Taking its
    mean off balances the codes but widens angles, so it asks for more tables; without it
    buckets are fuller where vectors share a direction.  Parts of the mean are tried.  Labels of every size go
    through codes; where the vectors are so alike that none parts them there are no bits at all: one table of whole labels, which misses nothing.
    """
    import numpy as np

    mean = sample.mean(0)
    best, chosen = math.inf, (0, 1, mean)
    tried, tried_labels = sample[:TRIED], np.unique(np.asarray(labels)[:TRIED], return_inverse=True)[1]
    pairs = lambda keys: float((n := np.unique(keys, return_counts=True)[1].astype(float)) @ (n - 1))
    together = max(1.0, pairs(tried_labels))
    for part in CENTRES:
        centre = part * mean
        norms = np.linalg.norm(sample - centre, axis=1)
        ones = learn(tried, sample.shape[1], 1, rounds=10, centre=centre).bits_of(tried)
        for bits in range(min(SHORTEST_KEY, ones.shape[1]), min(LONGEST_KEY, ones.shape[1]) + 1):
            tables = plan_tables(bits, threshold, aim, norms)
            if tables is None or tables * FILED >= best:
                break  # longer keys need more tables
            keys = ones[:, :bits] @ (np.int64(1) << np.arange(bits, dtype=np.int64)) + (tried_labels.astype(np.int64) << LONGEST_KEY)
            # at least what balanced bits would leave: a sample can't show less than one pair
            full = max(pairs(keys) / together, 2.0**-bits)
            cost = tables * (FILED + full * largest)
            if cost < best and tables * full <= TOO_DEAR:
                best, chosen = cost, (bits, tables, centre)
    bits, tables, centre = chosen
    return learn(sample, bits, tables, centre=centre)


def near_vectors(
    vectors: DataFrame, threshold: float = 0.93, train_rows: int = TRAIN_ROWS, block: int = BLOCK, aim: float = AIM
) -> DataFrame:
    """Near-duplicates among vectors of equal label and length.

    Returns ``(vec_id, n_links, component_id, kept)``, one row for each row of
    ``vectors``: how many other vectors of the label have a cosine of at least
    ``threshold`` (in double precision, on the original vectors, among the pairs
    that meet in a table), the smallest ``vec_id`` reachable over such links, and
    whether that is the row itself.

    Equal vectors of a label are one vertex with their number, however many there are.
    Pairs are never listed.  A pair is counted in the first table where its
    vectors meet, inside the task that compares the bucket; a bucket gives a count
    for each member and links that only span it.  Hot buckets are split in blocks.

    Rows whose label is null, and vectors that are null, empty, zero or hold null or
    non-finite components, have no links and stand for themselves.  Labels may be of any
    type; vectors may differ in length, and then are not compared.  Rows that repeat a
    ``vec_id`` count as one vector each and get their own vector's links, but are one
    node where components are reached.  A null ``vec_id`` has no links and a null
    ``component_id``.  An empty table gives an empty result; other columns are ignored.
    """
    import numpy as np

    rows = valid(vectors)
    held = rows.schema["v"].dataType.elementType
    kind = np.dtype("<f4" if isinstance(held, T.FloatType) else "<f8")
    known = rows.where("v is not null").groupBy("k1", "k2")
    vertices = cut(known.agg(F.any_value("grp").alias("grp"), F.any_value("v").alias("v"), F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n")))
    grps = vertices.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.any_value(F.size("v")).alias("width"))
    largest = dict(grps.groupBy("width").agg(F.max("n")).collect())  # a row a vector length
    picked = vertices.select("v", "grp", "k1", "k2").orderBy("k1", "k2").limit(train_rows).select("v", "grp").collect()
    codes = {}
    for width, most in largest.items():
        of = [r for r in picked if len(r[0]) == width]
        sample = np.array([r[0] for r in of], dtype=float).reshape(len(of), width)
        # lengths that the sample has hardly any of are filed in one table of whole labels
        codes[width] = plan(to_units(sample), [r[1] for r in of], most, threshold, aim) if len(of) >= LEAST_SAMPLE else Codes(np.zeros(width), np.zeros((width, 0)), 1, 0)

    def file(batches) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            lengths = pc.list_value_length(batch.column("v"))
            for width in pc.unique(lengths).to_pylist():
                of = codes[width]
                chosen = batch.filter(pc.equal(lengths, width))
                for at in range(0, chosen.num_rows, 2000):
                    part = chosen.slice(at, 2000)
                    v = part.column("v").flatten().to_numpy().astype(kind, copy=False).reshape(-1, width)
                    packed = pa.array([row.tobytes() for row in v], pa.binary())
                    filed = of.keys(to_units(v))
                    for t in range(of.tables):
                        yield pa.record_batch({
                            "grp": part.column("grp"), "tab": pa.array(np.full(len(v), t, dtype=np.int32)), "key": pa.array(filed[:, t]),
                            "first": part.column("first"), "k1": part.column("k1"), "n": part.column("n"), "vec": packed,
                        })

    filed = vertices.select("grp", "v", "first", "k1", "n").mapInArrow(file, "grp long, tab int, key long, first long, k1 long, n long, vec binary")
    keys = ["grp", "tab", "key"]
    groups = split_hot(filed, keys, "k1", block)
    runs = [*keys, "bi", "bj"]

    def compare(batches) -> Iterator:
        import pyarrow as pa

        def stretch(table, starts, width):
            """Of runs of one vector length: how many vectors each row is linked to, and the least row of its component."""
            of = codes[width]
            tab, own, weight = (table.column(c).to_numpy() for c in ("tab", "own", "n"))
            split = table.column("bi").to_numpy() != table.column("bj").to_numpy()
            unit = to_units(np.frombuffer(b"".join(table.column("vec").to_pylist()), dtype=kind).reshape(-1, width))
            places = of.keys(unit)
            counts, labels = np.zeros(len(unit), dtype=np.int64), np.arange(len(unit))
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
                t = tab[lo]
                for at in range(lo, hi, 512):  # a stripe of rows against the group: bounded memory
                    to = min(at + 512, hi)
                    near = unit[at:to] @ unit[lo:hi].T >= threshold
                    near[np.arange(to - at), np.arange(at - lo, to - lo)] = False
                    if split[lo]:
                        near &= own[at:to, None] != own[None, lo:hi]
                    i, j = np.nonzero(near)
                    if not len(i):
                        continue
                    i, j = i + at, j + lo
                    if t:  # counted in the first table where the pair meets
                        fresh = ~(places[i, :t] == places[j, :t]).any(1)
                        i, j = i[fresh], j[fresh]
                    np.add.at(counts, i, weight[j])
                    merge_labels(labels, i, j)
            hit = np.flatnonzero(counts)
            first = table.column("first").to_numpy()
            return pa.record_batch({
                "first": pa.array(first[hit]), "k1": pa.array(table.column("k1").to_numpy()[hit]), "n": pa.array(counts[hit]),
                "to": pa.array(first[labels[hit]]),
            })

        for table, starts in sorted_runs(batches, runs):
            sizes = np.array([len(x) for x in table.column("vec").to_pylist()]) // kind.itemsize
            ends = [*(i for i in range(1, len(starts) - 1) if sizes[starts[i]] != sizes[starts[i] - 1]), len(starts) - 1]
            for a, b in zip([0, *ends], ends):  # almost always one
                yield stretch(table.slice(starts[a], starts[b] - starts[a]), starts[a : b + 1] - starts[a], int(sizes[starts[a]]))

    met = groups.repartition(*runs).sortWithinPartitions(*runs).select(*runs, "first", "k1", "n", "vec", "own")
    found = cut(met.mapInArrow(compare, "first long, k1 long, n long, to long"))
    counted = found.groupBy("first", "k1").agg(F.sum("n").alias("others"))
    component = connected_components(found.select("first", "to").distinct(), "first", "to").withColumnRenamed("node", "first")
    of_vertex = vertices.select("k1", "k2", "first", "n").join(counted, ["first", "k1"], "left").join(component, "first", "left")
    of_vertex = cut(of_vertex.select(
        "k1", "k2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "first").alias("component_id")
    ))
    out = rows.select("vec_id", "k1", "k2").join(of_vertex, ["k1", "k2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, least(a, min(b)) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(vec_id = coalesce(component_id, vec_id), false) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
