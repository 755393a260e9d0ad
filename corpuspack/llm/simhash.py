"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits.  Two fingerprints that differ in at most three bits
agree in all but at most one bit of one of their 32-bit halves.  The anchors of
a half are the code words of the perfect (31, 26) Hamming code over its low 31
bits: every half lies within distance 1 (the covering radius) of exactly one
anchor, its home.  A half is replicated to every anchor within distance 2, the
radius plus the one bit that may differ, so it meets its near-duplicates at
their home.  Only anchors that are the home of some fingerprint are compared.
The halves only bring candidates together; all 64 bits decide.

Groups by similarity (:func:`first_of_groups`) take twice as wide a fingerprint of pairs of
words, compare at every anchor within distance 2 and at the anchors of segments of the
text, and verify what is near by the sets of shingles, until no candidate is left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, gathered, merge_labels, sorted_runs, split_hot
from .components import connected_components

#: Bits in which linked fingerprints may differ.  The cover above is made for it.
THRESHOLD = 3
#: Members of an anchor that are compared in one group.
BLOCK = 4096
#: Words of 64 bits in a wide fingerprint, and how many of its 32-bit parts have anchors.
WIDE, PARTS = 2, 3
#: Words to a feature of a wide fingerprint.  A changed word changes two of these but five of the shingles.
FEATURE = 2
#: Segments of a text that have an anchor of their own.
SEGMENTS = 8
#: Bits by which fingerprints may differ beyond the average at the similarity asked for: two and a half standard deviations.
SLACK = 10
#: Bins of a sketch, a byte each; and by how many standard deviations its estimate may fall short of the similarity asked for.
BINS, SURE = 256, 3


def shingle_hashes(text: bytes | None, shingle: int, seed: int = 42):
    """XXH64 of a text's shingles of ``shingle`` words, repeats included, as an array.

    A-Z count as a-z.  A text of fewer words has them all as its one shingle; one of no
    words, and null, have none.
    """
    import numpy as np
    import xxhash

    words = (text or b"").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], dtype="<u8")
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    bounds = starts.tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[p : q - 1], seed) for p, q in zip(bounds, bounds[shingle:])], dtype="<u8")


def majority(hashes) -> bytes:
    """Eight bytes whose bits are set where over half of the hashes have them set; zeros for no hashes."""
    import numpy as np

    # how often each byte value stands at each of the eight places, and from that how often each bit is set
    places = hashes.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
    seen = np.bincount(places.ravel(), minlength=2048).reshape(8, 256)
    ones = seen @ np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.packbits((2 * ones.ravel() > len(hashes)).astype(np.uint8), bitorder="little").tobytes()


def fingerprint(text: bytes | None, shingle: int, seed: int = 42) -> int:
    """The SimHash of a text over :func:`shingle_hashes`, as unsigned number; 0 for a text of no words, and null."""
    return int.from_bytes(majority(shingle_hashes(text, shingle, seed)), "little")


def wide_fingerprint(text: bytes | None) -> bytes:
    """A SimHash of ``WIDE`` words of 64 bits over the set of runs of ``FEATURE`` words: the first of their hashes, the others of mixed ones."""
    import numpy as np

    hashes, found = np.unique(shingle_hashes(text, FEATURE)), []
    for _ in range(WIDE):
        found.append(majority(hashes))
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    return b"".join(found)


def segment_anchors(hashes):
    """The anchors of a text's segments: the homes of both halves of each segment's fingerprint, as signed numbers.

    A text is cut at the ``SEGMENTS - 1`` least hashes of its shingles, so that most cuts stay where they are
    when something is put in or taken out elsewhere.
    """
    import numpy as np

    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    least = np.argpartition(hashes, SEGMENTS - 2)[: SEGMENTS - 1] if len(hashes) >= SEGMENTS else np.arange(len(hashes))
    parts = [part for part in np.split(hashes, np.sort(least)) if len(part)]
    fps = np.frombuffer(b"".join(map(majority, parts)), dtype="<u8")
    low, high = (next(covering(fps >> np.uint64(32 * half)))[0].astype(np.int64) for half in (0, 1))
    return np.unique(low | (high << 32))


def sketch(distinct) -> bytes:
    """A byte for each bin of a set of sorted hashes: of the least hash that falls into it, 0 if none does."""
    import numpy as np

    if not len(distinct):
        return bytes(BINS)
    width = (1 << 64) // BINS
    edges = np.arange(BINS + 1).astype(object) * width
    opens = np.append(np.searchsorted(distinct, edges[:-1].astype(np.uint64)), len(distinct))
    least = distinct[np.minimum(opens[:-1], len(distinct) - 1)]
    return np.where(opens[1:] > opens[:-1], least % np.uint64(255) + np.uint64(1), np.uint64(0)).astype(np.uint8).tobytes()


def may_reach(similarity: float, sizes, sketches, i, j):
    """Which of the pairs ``(i, j)`` of sets may have this Jaccard similarity, by their sizes (exactly) and sketches.

    Of the bins that either set has, the share with the same least hash estimates the similarity.  Its deviation
    is that of as many draws without replacement from the union, which for short texts is hardly any.
    """
    import numpy as np

    a, b = sizes[i], sizes[j]
    passed = np.flatnonzero(np.minimum(a, b) >= similarity * np.maximum(a, b))
    for at in range(0, len(passed), 50_000):
        some = passed[at : at + 50_000]
        x, y = sketches[i[some]], sketches[j[some]]
        filled = np.maximum(((x | y) > 0).sum(1), 1)
        agree = ((x == y) & (x > 0)).sum(1)
        drawn = np.clip(1 - filled * (1 + similarity) / np.maximum(a[some] + b[some], 1), 0.1, 1)
        slack = SURE * np.sqrt(similarity * (1 - similarity) * drawn / filled)
        passed[at : at + 50_000] = np.where(agree >= (similarity - slack) * filled, some, -1)
    return passed[passed >= 0]


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``(doc_id, fp)``, a row for each document; ``fp`` has the fingerprint's bits as a signed long."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.record_batch({"doc_id": batch.column(0), "fp": pa.array(fps.view(np.int64))})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def wide_fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``(doc_id, text_hash, node, fp0, fp1, segments, size, sketch)``, a row for each document: what its text is known by.

    ``node`` is a hash of the set of its shingles, ``fp0`` and ``fp1`` are its wide fingerprint, ``segments``
    the anchors of its segments, ``size`` and ``sketch`` those of the set.
    """

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            nodes, fps, segments, sizes, sketches = [], [], [], [], []
            for text in batch.column(2):
                text = text.as_py()
                hashes = shingle_hashes(text, shingle)
                distinct = np.unique(hashes)
                nodes.append(xxhash.xxh64_intdigest(distinct.tobytes()))
                sizes.append(len(distinct))
                sketches.append(sketch(distinct))
                fps.append(wide_fingerprint(text))
                segments.append(segment_anchors(hashes))
            words = np.frombuffer(b"".join(fps), dtype="<i8").reshape(-1, WIDE)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), *map(pa.array, words.T.copy()),
                 pa.array(segments, pa.list_(pa.int64())), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary())],
                names=["doc_id", "text_hash", "node", "fp0", "fp1", "segments", "size", "sketch"],
            )

    source = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), F.col("text").cast("binary"))
    return source.mapInArrow(run, "doc_id long, text_hash long, node long, fp0 long, fp1 long, segments array<long>, size int, sketch binary")


def covering(half):
    """The anchors of each 32-bit half within distance 2, as ``(anchor, rows, home)`` arrays."""
    import numpy as np

    place = np.arange(1, 32, dtype=np.uint32)
    flip = np.zeros(32, dtype=np.uint32)  # the bit at place s; none at 0
    flip[1:] = np.uint32(1) << (place - 1)
    low = (half & np.uint64(0x7FFFFFFF)).astype(np.uint32)
    syndrome = np.zeros(len(low), dtype=np.uint32)
    for s in place:
        syndrome ^= np.where(low & flip[s], s, np.uint32(0))
    yield low ^ flip[syndrome], np.arange(len(low)), True
    for p in place:  # flips p and p ^ syndrome together also lead to a code word
        q = syndrome ^ p
        use = np.flatnonzero((syndrome != 0) & (q > p))
        if len(use):
            yield low[use] ^ flip[p] ^ flip[q[use]], use, False


def anchors(fps: DataFrame) -> DataFrame:
    """``(anchor, fp, home)``: each fingerprint at every anchor of its halves within distance 2."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fp = batch.column(0).to_numpy().astype(np.int64)
            for half in (0, 1):
                for word, rows, home in covering(fp.view(np.uint64) >> np.uint64(32 * half)):
                    yield pa.record_batch({
                        "anchor": pa.array(word.astype(np.int64) + (half << 31)), "fp": pa.array(fp[rows]), "home": pa.array(np.full(len(rows), home)),
                    })

    return fps.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def wide_anchors(nodes: DataFrame) -> DataFrame:
    """``(anchor, node)``: each node at every anchor of its parts within distance 2, and at those of its segments."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            words = np.column_stack([batch.column(i).to_numpy() for i in (1, 2)]).view(np.uint64)
            node = batch.column(0)

            def at(anchor, rows):
                return pa.RecordBatch.from_arrays([pa.array(anchor), node.take(pa.array(rows))], names=["anchor", "node"])

            for part in range(PARTS):
                for word, rows, _ in covering(words[:, part // 2] >> np.uint64(32 * (part % 2))):
                    yield at(word.astype(np.int64) + (part << 31), rows)
            of = batch.column(3)
            yield at(of.flatten().to_numpy(), np.repeat(np.arange(len(of)), np.diff(of.offsets.to_numpy())))

    return nodes.select("node", "fp0", "fp1", "segments").mapInArrow(run, "anchor long, node long")


def _near(table, starts, fp, bits: int) -> Iterator:
    """Pairs of rows within a run whose fingerprints (rows of 64-bit words) differ in ``bits`` bits or fewer: ``(i, j, differing)`` arrays."""
    import numpy as np

    own = table.column("own").to_numpy()
    split = table.column("bi").to_numpy() != table.column("bj").to_numpy()
    ends = np.repeat(starts[1:], np.diff(starts))
    rows, step = np.arange(len(fp)), 0
    while len(rows):
        step += 1
        rows = rows[rows + step < ends[rows]]
        i, j = rows, rows + step
        differing = np.bitwise_count(fp[i] ^ fp[j]).sum(1, dtype=np.int64)
        near = (differing <= bits) & (~split[i] | (own[i] != own[j]))
        yield i[near], j[near], differing[near]


def fingerprint_links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: links that connect all fingerprints of ``fps`` (distinct) that differ in at most three bits.

    Not all pairs: of the fingerprints that are connected within a group only
    the links to the least of them are given, one for each member at most.
    """
    groups = split_hot(anchors(fps), ["anchor"], "fp", block, at_least="homes >= 1")
    keys = ["anchor", "bi", "bj"]

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for table, starts in sorted_runs(batches, keys):
            fp = table.column("fp").to_numpy().view(np.uint64)
            labels, held = np.arange(len(fp)), []
            for i, j, _ in _near(table, starts, fp[:, None], THRESHOLD):
                held.append((i, j))
                if sum(len(i) for i, _ in held) > 1_000_000:
                    merge_labels(labels, *map(np.concatenate, zip(*held)))
                    held = []
            if held:
                merge_labels(labels, *map(np.concatenate, zip(*held)))
            linked = np.flatnonzero(labels != np.arange(len(fp)))
            if len(linked):
                signed = fp.view(np.int64)
                yield pa.record_batch({"a": pa.array(signed[linked]), "b": pa.array(signed[labels[linked]])})

    dealt = groups.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "fp", "own").mapInArrow(run, "a long, b long").distinct()


def candidates(members: DataFrame, bits: int, similarity: float, most: int) -> DataFrame:
    """The next ``most`` nearest candidates of each member within its group.

    ``members`` has ``(anchor, bi, bj, own, node, fp0, fp1, size, sketch)``, and where they come from an earlier call also
    ``label``, ``at`` and ``past``: a member's component and how far its candidates have been given.
    Candidates are of another component, differ in at most ``bits`` bits and may have this ``similarity``; they go by the number of bits
    and a hash.  Members with candidates come back with ``next``, ``at``, ``past`` and ``more``, whether there are further ones.
    """
    keys = ["anchor", "bi", "bj"]

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for table, starts in sorted_runs(batches, keys):
            node, *words = (table.column(c).to_numpy() for c in ("node", "fp0", "fp1"))
            seen = "label" in table.column_names
            label = table.column("label").to_numpy() if seen else node
            at = table.column("at").to_numpy() if seen else np.full(len(node), -1)
            past = table.column("past").to_numpy() if seen else node
            place = (node.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)  # one to one
            sizes = table.column("size").to_numpy().astype(np.int64)
            sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, BINS)
            more, held = np.zeros(len(node), dtype=bool), [np.zeros((3, 0), dtype=np.int64)]

            def best():
                row, other, differing = np.concatenate(held, axis=1)
                order = np.lexsort((place[other], differing, row))
                row, other, differing = row[order], other[order], differing[order]
                opens = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, dtype=np.int64)
                rank = np.arange(len(row)) - np.repeat(opens, np.diff(np.append(opens, len(row))))
                more[row[rank >= most]] = True
                return np.stack((row, other, differing))[:, rank < most]

            for i, j, differing in _near(table, starts, np.column_stack(words).view(np.uint64), bits):
                apart = np.flatnonzero(label[i] != label[j])
                apart = apart[may_reach(similarity, sizes, sketches, i[apart], j[apart])]
                i, j, differing = i[apart], j[apart], differing[apart]
                for row, other in ((i, j), (j, i)):
                    open_ = ((differing > at[row]) | (differing == at[row]) & (place[other] > past[row]))
                    held.append(np.stack((row[open_], other[open_], differing[open_])))
                if sum(h.shape[1] for h in held[1:]) > 1_000_000:
                    held = [best()]
            row, other, differing = best()
            if not len(row):
                continue
            last = np.flatnonzero(np.append(row[1:] != row[:-1], True))
            members = table.select([*keys, "own", "node", "fp0", "fp1", "size", "sketch"]).take(pa.array(row[last])).combine_chunks()
            given = pa.ListArray.from_arrays(pa.array(np.append(0, last + 1), pa.int32()), pa.array(node[other]))
            yield from members.append_column("next", given).append_column("at", pa.array(differing[last])).append_column(
                "past", pa.array(place[other[last]])).append_column("more", pa.array(more[row[last]])).to_batches()

    dealt = members.repartition(*keys).sortWithinPartitions(*keys)
    schema = "anchor long, bi int, bj int, own int, node long, fp0 long, fp1 long, size int, sketch binary, next array<long>, at long, past long, more boolean"
    return dealt.mapInArrow(run, schema)


def similar(links: DataFrame, docs: DataFrame, vertices: DataFrame, shingle: int, similarity: float, few: bool) -> DataFrame:
    """The ``links`` whose documents have at least this Jaccard similarity of their sets of shingles.

    ``vertices(node, first)`` names the document, ``docs`` has its text.  Only linked documents are read for it; where links
    are ``few``, they are sent to the tasks that read documents, and no text is shuffled.
    """
    sent = F.broadcast if few else (lambda df: df)
    linked = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    named = vertices.join(sent(linked), "node").select("node", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    texts = texts.join(sent(named), (F.col("text_hash") == F.col("first_hash")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).select("node", "text")

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    sets = cut(texts.mapInArrow(run, "node long, set array<long>").dropDuplicates(["node"]))
    of = lambda end: sets.select(F.col("node").alias(end), F.col("set").alias(f"set_{end}"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    near = both >= F.lit(similarity) * (F.size("set_a") + F.size("set_b") - both)
    return links.join(of("a"), "a").join(of("b"), "b").where(near).select("a", "b")


def components(vertices: DataFrame, links: DataFrame, key: str = "fp", few: bool = False) -> DataFrame:
    """``(key, first, component)`` for ``vertices(key, first)``: the least key that each one reaches over ``links``, which may be said to be ``few``."""
    component = connected_components(links).withColumnRenamed("node", key)
    group = vertices.join(F.broadcast(component) if few else component, key, "left")
    return group.select(key, "first", F.coalesce("component", key).alias("component"))


def similar_groups(docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float, block: int) -> DataFrame:
    """``(node, first, component)`` for ``nodes``: the least node that each one reaches over pairs of this similarity.

    The nearest candidate of every member of an anchor is verified first.  Later rounds take up members that have further
    candidates in other components than their own by then, eight times as many at once in each round, until there are none.
    So each candidate is verified or joined by others, but a group of copies with edits is not listed in pairs.
    """
    vertices = nodes.select("node", "first")
    members = split_hot(wide_anchors(nodes), ["anchor"], "node", block).join(nodes.select("node", "fp0", "fp1", "size", "sketch"), "node")
    bits, most, tested, good, group = differing_bits(similarity) + SLACK, 1, None, None, None

    while True:
        found, few = gathered(cut(candidates(members, bits, similarity, most)))
        # a pair that meets at several anchors is listed once
        each = found.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next"))
        ends = each.select("node", F.explode("next").alias("other"))
        links = ends.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        links, few_links = gathered(cut(links if tested is None else links.join(tested, ["a", "b"], "left_anti")))
        if group is None or not links.isEmpty():
            near = similar(links, docs, vertices, shingle, similarity, few_links)
            tested, good = (links, near) if tested is None else (tested.union(links), good.union(near))
            good, few_good = gathered(cut(good))
            group = cut(components(vertices, good, "node", few_good))
        open_ = found.where("more")
        if open_.isEmpty():
            return group
        open_ = open_.drop("next", "more")
        members = (F.broadcast(open_) if few else open_).join(group.select("node", F.col("component").alias("label")), "node")
        most *= 8


def differing_bits(similarity: float) -> int:
    """Bits of a wide fingerprint that differ, on average, where two equally large sets of shingles have this Jaccard similarity."""
    return math.ceil(64 * WIDE * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def first_of_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row for each group of near-duplicates, whatever ids the rows have.

    Near are texts with at least this Jaccard ``similarity`` of their sets of shingles of
    ``shingle`` words.  Pairs are looked for at the anchors of wide fingerprints and of
    segments, among those whose fingerprints differ in no more bits than such sets do, give
    or take, and whose sizes and sketches allow for it; the sets themselves decide, for every candidate (:func:`similar_groups`).
    Fingerprints find words changed here and there, segments what is put in or taken out
    in one place.  Texts of equal sets are one vertex.

    That with the smallest ``doc_id`` stays, null ids last; of rows that repeat the id,
    that with the smallest hash of its text.  Ids don't bring rows together: texts
    that are not near each other stay, also where they share an id or have none.  Null and
    empty texts are one group.  An empty table gives an empty result; all columns stay, whatever their names.
    """
    seen = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "fp0", "fp1", "segments", "size", "sketch")
    nodes = wide_fingerprints(docs, shingle).groupBy("node").agg(F.min(seen).alias("s"))
    nodes = cut(nodes.select("node", F.struct("s.none", "s.doc_id", "s.text_hash").alias("first"), "s.fp0", "s.fp1", "s.segments", "s.size", "s.sketch"))
    group = similar_groups(docs, nodes, shingle, similarity, block)
    first = group.groupBy("component").agg(F.min("first").alias("first"))
    # the join's keys are the window's, so that texts are shuffled once
    once = [F.col("hash"), F.col("id"), F.col("none")]
    first = first.select(F.col("first.text_hash").alias("hash"), F.coalesce("first.doc_id", F.lit(0)).alias("id"), F.col("first.doc_id").isNull().alias("none"))
    doc_id = F.col("doc_id").cast("long")
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("hash"), F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("none"))
    met = keyed.join(first, ["hash", "id", "none"], "left_semi")
    nth = F.row_number().over(Window.partitionBy(*once).orderBy("row"))  # equal rows stay once
    return met.withColumn("nth", nth).where("nth = 1").select("row.*")


def simhash_groups(docs: DataFrame, shingle: int = 3, block: int = BLOCK) -> DataFrame:
    """Each document's fingerprint and group.

    Returns ``(doc_id, fingerprint, component_id)``, one row for each row of
    ``docs``: the fingerprint as 16 lowercase hex digits and the smallest
    ``doc_id`` that is reachable over fingerprints differing in three bits or
    fewer.  Equal fingerprints are one vertex with its smallest document, so a
    group of exact copies costs no comparison however large it is.

    Null and empty texts have fingerprint zero and are linked like any other.  A
    null ``doc_id`` keeps its row and takes part in its group, but names no
    component unless all members' ids are null; then ``component_id`` is null.
    Repeated rows come back repeated.  An empty table gives an empty result;
    columns other than ``doc_id`` and ``text`` are ignored.
    """
    fps = cut(fingerprints(docs, shingle))
    vertices = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    group = components(vertices, fingerprint_links(vertices, block))
    least = group.groupBy("component").agg(F.min("first").alias("component_id"))
    named = group.join(least, "component").select("fp", "component_id")
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
