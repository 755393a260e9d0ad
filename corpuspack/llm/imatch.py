"""I-Match fingerprints: the terms of a document within a band of inverse document frequency, hashed over randomised lexicon subsets.

A document's signature is the hash of its sorted distinct terms in the band.  One edit of such a term
changes it, so the terms that fall into each of several random subsets of the lexicon are hashed as well:
subsets that an edit doesn't touch still agree.  Subsets are drawn at a rate that leaves about one term
of the document in each, and at a half and a quarter of it, so that documents of somewhat different size share a rate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .words import utf8, words_in_pieces

#: Terms that are sent to the tasks, at most; of a larger band a half by hash is sent, as often halved as needed, and the rest is joined.
MAX_TERMS = 1 << 20
SUBSETS = 32
#: Each rate is half the one before.
RATES = 3
_ODD = np.arange(1, 2 * SUBSETS, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
#: From so many terms in the band on a document is known by these, else by all of its terms alone.
LEAST_TERMS = 8


@dataclass(frozen=True)
class ImatchOptions:
    #: Least and greatest ln(documents / documents with the term): here terms of a thousandth to a fifth of the documents.
    least_idf: float = 1.6
    most_idf: float = 6.9
    max_terms: int = MAX_TERMS


def terms(text: bytes):
    """Sorted hashes of the distinct words of a text; of a text without words, that of the text itself."""
    import xxhash

    found = set()
    for words in words_in_pieces(text):
        found.update(words)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, found or {b" " + text}), dtype=np.uint64, count=len(found) or 1)
    hashed.sort()
    return hashed


def band_of(docs: DataFrame, options: ImatchOptions = ImatchOptions()):
    """The terms in the band, counted over all ``docs``: those that are sent to tasks, as sorted hashes, and a table ``(term)`` of all others, or None.

    A term of the band is in a share of exp(-most_idf) of the documents or more, so the band has at most exp(most_idf) times as many terms
    as a document has on average.  Beyond ``max_terms`` those that are sent are chosen by hash.
    """
    def count(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            every = [terms(t) for t in utf8(batch.column(0))]
            if every:
                term, n = np.unique(np.concatenate(every), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

    n_docs = docs.count()
    counted = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    idf = F.log(F.lit(float(n_docs)) / F.col("n"))
    band = cut(counted.where(idf.between(options.least_idf, options.most_idf)).select("term"))
    size, mask = band.count(), 0
    some = lambda: F.col("term").bitwiseAND(F.lit(mask)) == 0
    while size > options.max_terms:
        mask = 2 * mask + 1
        size = band.where(some()).count()
    found = np.array([r.term for r in band.where(some()).collect()], dtype=np.int64).view(np.uint64)  # max_terms at most
    found.sort()
    return found, band.where(~some()) if mask else None


def lexicon(docs: DataFrame, options: ImatchOptions = ImatchOptions()):
    """Sorted hashes of the terms in the band that are sent to tasks: all of them up to ``max_terms``."""
    return band_of(docs, options)[0]


def with_rest(rows: DataFrame, rest: DataFrame, texts) -> DataFrame:
    """``rows`` with ``more``: which terms of ``rest`` are in their texts.  ``texts`` gives those of a row of an Arrow batch; a row has its number in ``row``."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row, some in zip(batch.column(batch.schema.get_field_index("row")).to_pylist(), texts(batch)):
                found = np.unique(np.concatenate([terms(t) for t in some])).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), row)), pa.array(found)], names=["row", "term"])

    met = rows.mapInArrow(run, "row long, term long").join(rest, "term").groupBy("row").agg(F.collect_list("term").alias("more"))
    return rows.join(met, "row", "left")


def _more(batch) -> Iterator:
    """The column ``more`` of a batch, as hashes."""
    for terms_ in batch.column(batch.schema.get_field_index("more")):
        yield np.array(terms_.as_py() or [], dtype=np.int64).view(np.uint64)


def _rate(n: int) -> int:
    """The least r for which ``n`` terms at a rate of 2 to the -(r + 1) are one or fewer a subset."""
    return max(0, (n - 1).bit_length() - 1)


def _sections(every, band) -> dict:
    """By kind of terms (``a``ll, and ``b``and if there are enough) and rate: for each subset 16 bits of the hash of the terms that fall into it; 0 where none does."""
    n_band = int(np.count_nonzero(band))
    kinds = [("a", len(every)), ("b", n_band)][: 2 if n_band >= LEAST_TERMS else 1]
    lowest, out = min(_rate(n) for _, n in kinds), {}
    drawn = (every ^ (every >> np.uint64(29)))[:, None] * _ODD[None]
    drawn ^= drawn >> np.uint64(32)
    drawn *= np.uint64(0xD6E8FEB86659FD93)
    # a term is in a subset at rate r if the first r + 1 bits drawn for the two are 0
    term, subset = np.divmod(np.flatnonzero(drawn < np.uint64(1 << (63 - lowest))), SUBSETS)
    drawn = drawn[term, subset]
    value = drawn * np.uint64(0xA0761D6478BD642F)
    for kind, n in kinds:
        rate = _rate(n)
        # up to which rate a term stays in its subset
        stays = sum((drawn < np.uint64(1 << (63 - rate - i))).astype(np.int64) for i in range(RATES))
        slot = stays * SUBSETS + subset
        if kind == "b":
            some = band[term]
            slot, value = slot[some], value[some]
        total = np.zeros((RATES + 1) * SUBSETS, dtype=np.uint64)
        np.add.at(total, slot, value)
        filled = np.bincount(slot, minlength=len(total)).reshape(-1, SUBSETS)[::-1].cumsum(0)[::-1] > 0
        total = total.reshape(-1, SUBSETS)[::-1].cumsum(0)[::-1]
        short = np.where(filled, np.maximum(1, (total >> np.uint64(40)) & np.uint64(0xFFFF)), 0).astype(np.uint16)
        out |= {(kind, rate + i): short[i + 1] for i in range(RATES)}
    return out


class Fingerprint:
    """``signature``, the hash of the sorted terms, and ``sections``, the hashes of subsets.  Terms in ``lexicon`` or ``more`` are in the band."""

    def __init__(self, text: bytes, lexicon, more=None):
        import xxhash

        every = terms(text)
        if len(lexicon):
            band = lexicon[np.minimum(np.searchsorted(lexicon, every), len(lexicon) - 1)] == every
        else:
            band = np.zeros(len(every), dtype=bool)
        if more is not None:
            band |= np.isin(every, more)
        known = every[band] if band.sum() >= LEAST_TERMS else every
        self.signature = xxhash.xxh3_64_hexdigest(known.tobytes())
        self.sections = _sections(every, band)

    def __str__(self) -> str:
        return ".".join([self.signature, *(f"{k}{r}:{h.astype('>u2').tobytes().hex()}" for (k, r), h in self.sections.items())])

    def likeness(self, other: Fingerprint) -> float:
        """Of the subsets that either one has terms in, at rates that both have, the share in which they agree; band terms count if both have them."""
        if self.signature == other.signature:
            return 1.0
        shared = self.sections.keys() & other.sections.keys()
        agree = filled = 0
        for kind in "ba":
            for at in shared:
                if at[0] == kind:
                    a, b = self.sections[at], other.sections[at]
                    agree, filled = agree + int(((a == b) & (a > 0)).sum()), filled + int(((a > 0) | (b > 0)).sum())
            if filled:
                break
        return agree / filled if filled else 0.0


def fingerprints(docs: DataFrame, options: ImatchOptions = ImatchOptions()) -> DataFrame:
    """``docs`` with ``fingerprint``: signature and subset hashes as hexadecimal text.

    Equal texts have equal fingerprints.  Null texts count as empty; a text without words is known by itself.  All
    rows and columns stay; a column ``fingerprint`` is replaced.
    """
    few, rest = band_of(docs, options)
    sent = docs.sparkSession.sparkContext.broadcast(few)  # MAX_TERMS numbers at most
    plain = docs.drop("fingerprint")
    at = plain.columns.index("text")

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            said = [str(Fingerprint(t, sent.value)) for t in utf8(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string())], names=[*batch.schema.names, "fingerprint"])

    def finish(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            said = [str(Fingerprint(t, sent.value, more)) for t, more in zip(utf8(batch.column(0)), _more(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(said, pa.string())], names=["row", "fingerprint"])

    if rest is None:
        return plain.mapInArrow(run, _with(plain, "fingerprint string"))
    # a row's other columns go round the lookup, whatever their names
    rows = cut(plain.select(F.col("text"), F.monotonically_increasing_id().alias("row"), F.struct("*").alias("all")))
    said = with_rest(rows.select("text", "row"), rest, lambda batch: ([t] for t in utf8(batch.column(0))))
    said = said.select("text", "row", "more").mapInArrow(finish, "row long, fingerprint string")
    return rows.select("row", "all").join(said, "row").select("all.*", "fingerprint")


def _with(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), more])


RESULT = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def edit_robustness(docs: DataFrame, options: ImatchOptions = ImatchOptions(), replaced: int = 4) -> DataFrame:
    """How far each fingerprint withstands an edit, and how far it is from a neighbour's.

    The edited text has its last ``floor(n_chars / replaced)`` code points replaced by as many (or all) from the
    start of the next document's text, by ascending ``doc_id``; the first one follows the last.  Returns ``doc_id``, ``n_chars``,
    ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next``.

    Rows that repeat an id follow each other by a hash of their text; null ids come last.  Null texts are empty.  A single document is followed by itself.

    Ids alone are cut into ranges first, so that texts are shuffled once, to the range of their id, and the first document of a range
    also to the one before.  In a range each document meets its successor as the rows stream by; nothing is stored.
    """
    from hashlib import sha256

    few, rest = band_of(docs, options)
    sent = docs.sparkSession.sparkContext.broadcast(few)  # MAX_TERMS numbers at most
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def edit(text: bytes, following: bytes):
        text, following = text.decode("utf-8", "replace"), following.decode("utf-8", "replace")
        put = len(text) // replaced
        return len(text), (text[: len(text) - put] + following[:put]).encode("utf-8", "replace")

    def met(doc, following, more=None):
        doc_id, text, own = doc
        n, edited = edit(text, following[1])
        other = Fingerprint(edited, sent.value, more)
        return doc_id, n, sha256(edited).hexdigest(), str(own), str(other), own.likeness(other), own.likeness(following[2])

    def document(doc_id, text: bytes, more=None):
        return doc_id, text, Fingerprint(text, sent.value, more)

    def batch_of(rows, id_type):
        import pyarrow as pa

        kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=list(RESULT))

    def paired(batches, document) -> Iterator:
        """For each batch of ``(part, follows, doc_id, text)`` the pairs of a document and its successor that it completes."""
        at, last = None, None
        for batch in batches:
            pairs = []
            for part, follows, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), utf8(batch.column(3))):
                if part != at:
                    at, last = part, None
                elif last is None:
                    continue  # one of several that could follow the range's last
                doc = document(doc_id.as_py(), text)
                if last is not None:
                    pairs.append((last, doc))
                last = None if follows else doc
            if pairs:
                yield batch.column(2).type, pairs

    def stream(batches) -> Iterator:
        for id_type, pairs in paired(batches, document):
            yield batch_of([met(*pair) for pair in pairs], id_type)

    def texts_of_pairs(batches) -> Iterator:
        import pyarrow as pa

        for id_type, pairs in paired(batches, lambda *doc: doc):
            columns = zip(*[(i, a, b) for (i, a), (_, b) in pairs])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (id_type, pa.binary(), pa.binary()))], names=["doc_id", "text", "following"])

    def finish(batches) -> Iterator:
        for batch in batches:
            rows = [
                met(document(i.as_py(), a, more), document(None, b, more), more)
                for i, a, b, more in zip(batch.column(0), utf8(batch.column(1)), utf8(batch.column(2)), _more(batch))
            ]
            if rows:
                yield batch_of(rows, batch.column(0).type)

    dealt = in_ranges(docs)
    if rest is None:
        return dealt.mapInArrow(stream, schema)
    pairs = dealt.mapInArrow(texts_of_pairs, f"doc_id {kind}, text binary, following binary")
    rows = cut(pairs.withColumn("row", F.monotonically_increasing_id()))
    every = lambda batch: ([a, b, edit(a, b)[1]] for a, b in zip(utf8(batch.column(1)), utf8(batch.column(2))))
    return with_rest(rows, rest, every).select("doc_id", "text", "following", "more").mapInArrow(finish, schema)


def in_ranges(docs: DataFrame) -> DataFrame:
    """``(part, follows, doc_id, text)`` in ranges of ids, each in one partition and sorted.

    Behind a range, with ``follows``, stands the first document of the next one, and behind the last range that of the first.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash")).alias("key")
    keyed = docs.select(key, "doc_id", "text")
    ranges = keyed.select("key").repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    firsts = cut(ranges.groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("opens")))
    along = Window.orderBy("opens")  # a row a range
    spans = firsts.select("part", "opens", F.lead("opens").over(along).alias("ends"), F.min("opens").over(Window.partitionBy()).alias("least"))
    after = F.coalesce("ends", "least")
    places = spans.select("part", F.lit(False).alias("follows"), "opens", "ends").union(spans.select("part", F.lit(True), after, after))
    within = (F.col("key") >= F.col("opens")) & F.coalesce(F.col("key") < F.col("ends"), F.lit(True))
    met = keyed.join(F.broadcast(places), F.when(F.col("follows"), F.col("key").eqNullSafe(F.col("opens"))).otherwise(within))
    return met.repartitionByRange("part").sortWithinPartitions("part", "follows", "key").select("part", "follows", "doc_id", "text")
