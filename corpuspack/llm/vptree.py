"""Nearest neighbours by vantage-point trees, one per shard, with relaxed pruning.

Shards are regions: the leaves of a small vantage-point tree over a sample, the router,
which keeps how far the vectors of each region lie from its vantage points.  A query goes
to its own region first, and with the distance found there only to regions that the
triangle inequality doesn't rule out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Vectors of a shard, about; each shard has one tree.
SHARD_ROWS = 20_000
#: Queries of a block, about; a shard's tree is sent once for each block of the queries that need it.
QUERY_BLOCK = 10_000
LEAF = 64
#: Vectors that the router is built on, at most: those with the smallest hash.
ROUTER_ROWS = 20_000


@dataclass
class Tree:
    """A vantage-point tree over the rows of ``points``; nodes are in depth-first order."""

    ids: object
    points: object
    #: node: (row of the vantage point, inner child, outer child, inner bounds, outer bounds), or (first row, last row) of a leaf
    nodes: list

    @staticmethod
    def build(ids, points, leaf: int = LEAF, seed: int = 5) -> Tree:
        """The vantage point of a node is the row farthest from a random one; its median distance splits the others."""
        import numpy as np

        rng = np.random.default_rng(seed)
        order, nodes = np.arange(len(ids)), []
        todo = [(0, len(ids), None)]
        while todo:
            lo, hi, parent = todo.pop()
            if parent is not None:
                nodes[parent[0]][parent[1]] = len(nodes)
            if hi - lo <= leaf:
                nodes.append([lo, hi])
                continue
            rows = order[lo:hi]
            far = distances(points[rows], points[rows[rng.integers(len(rows))]][None])[:, 0].argmax()
            rows[[0, far]] = rows[[far, 0]]
            d = distances(points[rows[1:]], points[rows[0]][None])[:, 0]
            middle = len(d) // 2
            split = np.argpartition(d, middle)
            rows[1:], d = rows[1:][split], d[split]
            node = [lo, None, None, (d[:middle].min(), d[:middle].max()), (d[middle:].min(), d[middle:].max())]
            nodes.append(node)
            todo += [(lo + 1 + middle, hi, (len(nodes) - 1, 2)), (lo + 1, lo + 1 + middle, (len(nodes) - 1, 1))]
        return Tree(ids[order], points[order], nodes)

    def search(self, query_ids, queries, k: int, factor: float = 1.0, within=None):
        """For each query its ``k`` nearest rows: ``(ids, distances)``, nearest first, ties to smaller ids; -1 and inf where there are fewer.

        A query's own id is no neighbour, nor is a row farther than ``within`` (one number a query).  A child is skipped by the triangle
        inequality if its shell is farther than the k-th distance so far over
        ``factor``: 1 is exact, more prunes more and may miss some.
        All queries go down the tree together, each with its own bound.
        """
        import numpy as np

        n = len(queries)
        best_d, best_i = np.full((n, k), np.inf), np.full((n, k), -1, dtype=np.int64)
        within = np.full(n, np.inf) if within is None else within

        def offer(active, lo, hi):
            d = distances(queries[active], self.points[lo:hi])
            d[self.ids[None, lo:hi] == query_ids[active, None]] = np.inf
            d[d > within[active, None]] = np.inf
            some = d.min(1) <= best_d[active, -1]
            active, d = active[some], d[some]
            if len(active):
                every_d = np.concatenate([best_d[active], d], axis=1)
                every_i = np.concatenate([best_i[active], np.broadcast_to(self.ids[lo:hi], d.shape)], axis=1)
                first = np.lexsort((every_i, every_d), axis=1)[:, :k]
                best_d[active] = np.take_along_axis(every_d, first, 1)
                best_i[active] = np.where(np.isinf(best_d[active]), -1, np.take_along_axis(every_i, first, 1))

        def visit(at, active):
            """Depth first; of each node the child on the query's side comes first."""
            stack = [(at, active, None)]
            while stack:
                at, active, shell = stack.pop()
                if shell is not None:
                    to, (least, most) = shell
                    gap = np.maximum(np.maximum(least - to, to - most), 0) * factor
                    active = active[gap <= np.minimum(best_d[active, -1], within[active]) * (1 + 1e-9)]
                if not len(active):
                    continue
                node = self.nodes[at]
                if len(node) == 2:
                    offer(active, *node)
                    continue
                lo, inner, outer, inside, outside = node
                offer(active, lo, lo + 1)
                to = distances(queries[active], self.points[lo : lo + 1])[:, 0]
                near = to <= (inside[1] + outside[0]) / 2
                for a, t, first, second in ((active[near], to[near], (inner, inside), (outer, outside)), (active[~near], to[~near], (outer, outside), (inner, inside))):
                    if len(a):
                        stack.append((second[0], a, (t, second[1])))
                        stack.append((first[0], a, (t, first[1])))

        if len(self.ids) and n:
            visit(0, np.arange(n))
        return best_i, best_d


def distances(a, b):
    """Euclidean distances of the rows of ``a`` to those of ``b``, from the differences, in double precision."""
    import numpy as np

    out = np.empty((len(a), len(b)))
    step = max(1, 2_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        gap = a[i : i + step, None, :] - b[None]
        out[i : i + step] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
    return out


class Router:
    """A tree over a sample whose leaves are regions, numbered from 0."""

    def __init__(self, points, regions: int):
        import numpy as np

        self.tree = Tree.build(np.arange(len(points)), points, leaf=max(1, -(-len(points) // max(1, regions)))) if regions > 1 and len(points) > 1 else None
        leaves = [i for i, node in enumerate(self.tree.nodes) if len(node) == 2] if self.tree else []
        self.region = {node: i for i, node in enumerate(leaves)}
        #: (node, child): least and greatest distance of the region's vectors from the node's vantage point
        self.bounds: dict[tuple[int, int], tuple[float, float]] = {}

    def place(self, points):
        """The region of each point, and for each ``(node, child)`` that points pass their least and greatest distance."""
        import numpy as np

        home, passed = np.zeros(len(points), dtype=np.int32), []
        todo = [(0, np.arange(len(points)))] if self.tree else []
        while todo:
            at, rows = todo.pop()
            node = self.tree.nodes[at]
            if len(node) == 2:
                home[rows] = self.region[at]
                continue
            lo, inner, outer, inside, outside = node
            to = distances(points[rows], self.tree.points[lo : lo + 1])[:, 0]
            near = to <= (inside[1] + outside[0]) / 2
            for child, side in ((inner, near), (outer, ~near)):
                if side.any():
                    passed.append((at, child, float(to[side].min()), float(to[side].max())))
                    todo.append((child, rows[side]))
        return home, passed

    def reach(self, points, within, factor: float):
        """Pairs of point and region that may hold something as near as ``within``: ``(rows, regions)``."""
        import numpy as np

        found, todo = [], [(0, np.arange(len(points)))] if self.tree else []
        if not self.tree:
            return np.arange(len(points)), np.zeros(len(points), dtype=np.int32)
        while todo:
            at, rows = todo.pop()
            node = self.tree.nodes[at]
            if len(node) == 2:
                found.append((rows, np.full(len(rows), self.region[at], dtype=np.int32)))
                continue
            to = distances(points[rows], self.tree.points[node[0] : node[0] + 1])[:, 0]
            for child in node[1:3]:
                if (shell := self.bounds.get((at, child))) is not None:  # else no vector is there
                    gap = np.maximum(np.maximum(shell[0] - to, to - shell[1]), 0) * factor
                    left = rows[gap <= within[rows] * (1 + 1e-9)]
                    if len(left):
                        todo.append((child, left))
        rows, regions = zip(*found) if found else ([np.zeros(0, dtype=int)], [np.zeros(0, dtype=np.int32)])
        return np.concatenate(rows), np.concatenate(regions)


def _points(column, rows: int):
    """Vectors of one length as an array."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(rows, -1)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` for every row of ``queries``, both ``(vec_id, embedding)``.

    Returns ``(query_id, rank, vec_id, score)``: rank from 1, score the Euclidean
    distance of the original vectors in double precision, ties to smaller ids; all
    candidates where there are fewer than ``k``.  Rows of a query's own id are no
    candidates.  ``factor`` 1 finds exactly the nearest; above, regions and subtrees are
    skipped sooner (see :meth:`Tree.search`).

    Vectors are dealt to regions of about ``shard_rows`` by the router; larger regions are
    split by hash.  Each shard builds one tree, kept in a checkpoint.  A query first
    searches one shard of its own region; the distance of the k-th row found there bounds
    the second search, in the regions within that distance.  A shard and a block of queries
    have a bounded size.  Where all vectors lie about equally far apart no region can be
    ruled out, and an exact search has to go everywhere.

    Null ids and vectors that are null, zero or hold null or non-finite components take
    no part; nor do vectors of another length than the query, with which no distance is
    defined.  Rows that repeat an id are candidates each, and each row of ``queries`` gets
    its own ranks.  Empty tables give an empty result; other columns are ignored.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def usable(df):
        v = F.col("embedding").cast("array<double>")
        good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & good).withColumn("width", F.size("v"))

    base, asked = usable(vectors), cut(usable(queries).withColumn("q", F.monotonically_increasing_id()))
    sizes = dict(base.groupBy("width").count().collect())  # a row a vector length
    sampled = base.select("v", F.xxhash64("vec_id", F.lit(9)).alias("h"), "vec_id").orderBy("h", "vec_id").limit(ROUTER_ROWS).collect()
    routers = {w: Router(np.array([r[0] for r in sampled if len(r[0]) == w]).reshape(-1, w), -(-n // shard_rows)) for w, n in sizes.items()}

    def by_width(batch):
        widths = batch.column("width")
        for w in pc.unique(widths).to_pylist():
            if w in routers:
                part = batch.filter(pc.equal(widths, w))
                yield w, part, _points(part.column("v"), part.num_rows)

    def shells(batches) -> Iterator:
        for batch in batches:
            for w, _, points in by_width(batch):
                passed = routers[w].place(points)[1]
                at, child, least, most = zip(*passed) if passed else ((), (), (), ())
                yield pa.record_batch({
                    "width": pa.array([w] * len(at), pa.int32()), "at": pa.array(at, pa.int32()), "child": pa.array(child, pa.int32()),
                    "least": pa.array(least, pa.float64()), "most": pa.array(most, pa.float64()),
                })

    def place(batches) -> Iterator:
        for batch in batches:
            for w, part, points in by_width(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(routers[w].place(points)[0])], names=[*part.schema.names, "region"])

    if any(r.tree for r in routers.values()):  # two rows a region
        edges = base.mapInArrow(shells, "width int, at int, child int, least double, most double")
        for r in edges.groupBy("width", "at", "child").agg(F.min("least").alias("least"), F.max("most").alias("most")).collect():
            routers[r.width].bounds[r.at, r.child] = (r.least, r.most)

    placed = base.mapInArrow(place, "vec_id long, v array<double>, width int, region int")
    filled = placed.groupBy("width", "region").count().withColumn("subs", F.ceil(F.col("count") / (2 * shard_rows)).cast("int")).drop("count")
    shards = placed.join(filled, ["width", "region"]).withColumn("sub", F.pmod(F.xxhash64("vec_id", "v"), "subs").cast("int"))
    keys = ["width", "region", "sub"]

    def build(key, table):
        ids = table.column("vec_id").to_numpy()
        points = _points(table.column("v"), len(ids))
        order = np.argsort(ids, kind="stable")
        tree = pickle.dumps(Tree.build(ids[order], points[order]))
        return pa.table({**{n: pa.array([x.as_py()], pa.int32()) for n, x in zip(keys, key)}, "tree": pa.array([tree], pa.binary())})

    trees = cut(shards.groupBy(*keys).applyInArrow(build, "width int, region int, sub int, tree binary"))

    def home(batches) -> Iterator:
        for batch in batches:
            for w, part, points in by_width(batch):
                where = pa.array(routers[w].place(points)[0])
                yield pa.RecordBatch.from_arrays([*part.columns, where, pa.array(np.full(len(points), np.inf))], names=[*part.schema.names, "region", "within"])

    def reach(batches) -> Iterator:
        for batch in batches:
            for w, part, points in by_width(batch):
                rows, regions = routers[w].reach(points, part.column("within").to_numpy(), factor)
                for at in range(0, len(rows), 5000):  # a query may need very many regions
                    some = part.take(pa.array(rows[at : at + 5000]))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(regions[at : at + 5000])], names=[*some.schema.names, "region"])

    def search(_, built, wanted):
        if not built.num_rows or not wanted.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        tree = pickle.loads(built.column("tree")[0].as_py())
        q, ids = wanted.column("q").to_numpy(), wanted.column("vec_id").to_numpy()
        found, far = tree.search(ids, _points(wanted.column("v"), len(ids)), k, factor, wanted.column("within").to_numpy())
        hit = ~np.isinf(far)
        every = np.nonzero(hit)[0]
        return pa.table({"q": pa.array(q[every]), "query_id": pa.array(ids[every]), "vec_id": pa.array(found[hit]), "score": pa.array(far[hit])})

    def searched(routed):
        """What the routed queries find: each shard's queries in blocks, and its tree once for each."""
        routed = cut(routed)
        blocks = routed.groupBy(*keys).count().withColumn("blocks", F.ceil(F.col("count") / query_block).cast("int")).drop("count")
        sent = routed.join(blocks, keys).withColumn("block", F.pmod(F.xxhash64("q"), "blocks").cast("int"))
        copies = trees.join(blocks, keys).select(*keys, "tree", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        dealt = [*keys, "block"]
        sent = sent.select(*dealt, "q", "vec_id", "v", "within")
        return cut(copies.groupBy(*dealt).cogroup(sent.groupBy(*dealt)).applyInArrow(search, "q long, query_id long, vec_id long, score double"))

    columns = "vec_id long, v array<double>, width int, q long"
    own = asked.mapInArrow(home, f"{columns}, region int, within double").withColumn("sub", F.lit(0))
    near = searched(own)
    bound = near.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).alias("within"))
    bound = asked.join(bound, "q", "left").select("vec_id", "v", "width", "q", F.coalesce("within", F.lit(float("inf"))).alias("within"))
    wide = bound.mapInArrow(reach, f"{columns}, within double, region int").join(filled, ["width", "region"])
    wide = wide.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).drop("subs")
    wide = wide.join(own.select("q", *keys), ["q", *keys], "left_anti")
    best = near.union(searched(wide)).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id")))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.v, c.v) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
