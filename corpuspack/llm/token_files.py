"""Token ids as Parquet list columns.

Files hold one row for each document in ascending ``doc_id`` order: the id, the number
of tokens and the list of ids.  Numbers are delta-encoded and ids dictionary-encoded
(format version 2), row groups have a set size, and page indexes let a reader fetch the
tokens of a few documents, or the counts of all, without the rest.
"""

from __future__ import annotations

import functools
import os
import re
import string
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a row group and of a page, uncompressed; rows of a page.
ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 256 << 10, 2000
#: Parts of texts whose ids a worker remembers, about: half of them met lately, half before that.
REMEMBERED = 700_000
#: Parts longer than this aren't remembered, so that the memory has a bound in bytes; parts that are encoded as one text, such texts a call.
LONGEST, TOGETHER, CALL = 64, 200, 50
#: Bytes of texts that are taken apart at once (a longer text alone), so that a distinct part is looked up once for all of them.
AT_ONCE = 4 << 20

#: Marks; a run of them behind letters is a piece of its own. Letters up to this one are such in every Unicode version.
MARKS, LAST_LETTER = string.punctuation, "\u017f"
_MARKS = frozenset(MARKS)

_CUT = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)")
#: Two white spaces, or one that is neither a space nor a line end (as Python has it), for Arrow's expressions.
_UNEVEN = r"[ \n][ \n]|[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _even(texts):
    """Of each text, whether it has characters and all its white space is single spaces and line ends between others."""
    import pyarrow.compute as pc

    uneven = [pc.match_substring_regex(texts, _UNEVEN), pc.equal(pc.binary_length(texts), 0)]
    uneven += [f(texts, x) for f in (pc.starts_with, pc.ends_with) for x in (" ", "\n")]
    return pc.invert(functools.reduce(pc.or_, uneven))


class Encoder:
    """Encodes whole texts with a byte-level BPE file of the tokenizers library, each distinct part once.

    Its pre-tokeniser begins a new piece at a single space or line end between two
    characters that aren't white space, and no merge crosses pieces.  So a text may be
    cut there, and the ids of its parts, each with what it begins with, are the text's.
    Parts without an inner space are encoded many to a text, a space between them: the
    byte of a space stands only where a piece begins, so the pieces that begin with it
    show where each part does.  Letters with marks behind them are put together from both.

    The text ``<|endoftext|>`` is the added token of that name, as the library has it.

    A file of another kind (see :meth:`_can_cut`) is used on whole texts.
    """

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        #: ids of parts that follow a space or begin with a line end: those met lately, and those met before that
        self._recent: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._cuts = self._can_cut()
        names = self._tokenizer.get_vocab()
        self._opens = np.zeros(max(names.values()) + 1, dtype=bool)  # whether a piece begins with a space
        self._opens[[i for name, i in names.items() if name.startswith("\u0120")]] = True
        #: ids of runs of marks; none are taken off where an added token may begin in the letters before them
        self._marks: dict[str, bytes] = {}
        added = self._tokenizer.get_added_tokens_decoder().values()
        self._takes_off = not any(t.content.rstrip(MARKS).isalpha() and t.content[-1] in MARKS for t in added)

    def _can_cut(self) -> bool:
        """Whether the file is a byte-level BPE with the library's own pattern, no normaliser, and no added token with white space or options."""
        import json

        said = json.loads(self._tokenizer.to_str())
        before, model = said["pre_tokenizer"] or {}, said["model"]
        return (
            said["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") is True and before.get("add_prefix_space") is False
            and model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
            and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in said["added_tokens"])
        )

    def _whole(self, texts: list[str]) -> list[bytes]:
        said = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in said]

    def _stem(self, part: str) -> str:
        """The letters of a part that is letters and marks behind them, else the whole part."""
        stem = part.rstrip(MARKS)
        bare = stem[1:] if stem[:1] == "\n" else stem
        return stem if bare.isalpha() and (bare.isascii() or max(bare) <= LAST_LETTER) else part

    def _of_marks(self, run: str) -> bytes:
        if (ids := self._marks.get(run)) is None:
            ids = self._whole([run])[0]
            if len(run) <= LONGEST and len(self._marks) < 10_000:
                self._marks[run] = ids
        return ids

    def _ask(self, parts: list[str], plain: bool) -> Iterator[tuple[str, bytes]]:
        """Parts with their ids from the library."""
        import numpy as np

        alone = [p for p in parts if not plain or len(p) > LONGEST]
        parts = [p for p in parts if len(p) <= LONGEST] if plain else []
        rows = [(x[at : at + TOGETHER], skip) for x, skip in (
            ([p for p in parts if p[0] != "\n"], 0), ([p for p in parts if p[0] == "\n"], 4),  # these have no space before them
        ) for at in range(0, len(x), TOGETHER)]
        for at in range(0, len(rows), CALL):
            call = rows[at : at + CALL]
            said = self._tokenizer.encode_batch_fast([" " + " ".join(x) for x, _ in call], add_special_tokens=False)
            for (some, skip), found in zip(call, said):
                ids = np.array(found.ids, dtype="<u4")
                starts = np.flatnonzero(self._opens[ids])
                if len(starts) != len(some):
                    alone += some
                    continue
                raw, ends = ids.tobytes(), (4 * np.append(starts[1:], len(ids))).tolist()
                yield from zip(some, [raw[a:b] for a, b in zip((4 * starts + skip).tolist(), ends)])
        for at in range(0, len(alone), 2000):
            some = alone[at : at + 2000]
            yield from zip(some, self._whole([p if p.startswith("\n") else " " + p for p in some]))

    def _inner(self, parts: list[str], plain: bool = True) -> list[bytes]:
        """The ids of distinct parts that follow a space or begin with a line end; ``plain``: without inner white space."""
        recent, older = self._recent, self._older
        known = list(map(recent.get, parts))
        lacking = [p for p, ids in zip(parts, known) if ids is None]
        if not lacking:
            return known
        again = [*map(older.get, lacking)]
        found = {p: ids for p, ids in zip(lacking, again) if ids is not None}
        new = [p for p, ids in zip(lacking, again) if ids is None]
        put = []  # letters with marks: not remembered, as their letters are
        if plain and self._takes_off:
            put = [(p, stem) for p in new if p[-1] in _MARKS and (stem := self._stem(p)) is not p]
            stems = {stem for _, stem in put}.difference(recent, found)
            again = older.keys() & stems
            found.update(zip(again, map(older.__getitem__, again)))
            new = [*stems.difference(again, new), *(set(new).difference(p for p, _ in put) if put else new)]
        long = [p for p in new if len(p) > LONGEST]
        found.update(self._ask(new, plain))
        recent.update(found)
        found.update([(p, (recent.get(stem) or found[stem]) + self._of_marks(p[len(stem) :])) for p, stem in put])
        for p in long:
            del recent[p]
        learned = map(found.__getitem__, lacking)
        return [next(learned) if ids is None else ids for ids in known]

    def encode(self, texts, end: bytes = b""):
        """The ids of all texts (a list or an Arrow array) one after the other, each followed by ``end``, and the offsets of each text's ids, as arrays."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self._cuts:
            said = [ids + end for ids in self._whole(texts.to_pylist())]
            return np.frombuffer(b"".join(said), dtype="<u4"), np.append(0, np.cumsum([len(x) // 4 for x in said], dtype=np.int64))
        if len(self._recent) > REMEMBERED // 2:  # what isn't met again by the next time is forgotten
            self._older, self._recent = self._recent, {}
        iseven = _even(texts)
        even = iseven.to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.replace_substring(texts.filter(iseven), "\n", " \n"), " ")
        parts, starts = cut.flatten().dictionary_encode(), cut.offsets.to_numpy()
        del cut
        words = parts.dictionary.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist
        places = parts.indices.to_numpy()
        odd = [_CUT.split(t) for t in texts.filter(pc.invert(iseven)).to_pylist() if t]

        # what texts are put together from: inner parts, the parts that texts begin with, whole odd texts, and the end
        pieces = self._inner(words)
        openings, opening = np.unique(places[starts[:-1]], return_inverse=True)
        first = self._whole([words[i] for i in openings] + [x[0] for x in odd])
        more = list(set().union(*(x[1:] for x in odd)))
        get = dict(zip(more, self._inner(more, plain=False))).__getitem__
        whole = [f + b"".join(map(get, x[1:])) for f, x in zip(first[len(openings) :], odd)]
        pieces = pa.array([*pieces, *first[: len(openings)], *whole, end], pa.large_binary())

        # the pieces of each text, an end behind them
        counts = np.ones(len(texts), dtype=np.int64)
        counts[even] += np.diff(starts)
        isodd = ~even & (pc.binary_length(texts).to_numpy() > 0)
        counts[isodd] += 1
        bounds = np.concatenate([[0], np.cumsum(counts)])
        order = np.empty(bounds[-1], dtype=np.int64)
        inner = np.ones(len(order), dtype=bool)
        inner[bounds[1:] - 1] = False
        inner[bounds[:-1][isodd]] = False
        order[inner] = places
        order[bounds[:-1][even]] = len(words) + opening
        order[bounds[:-1][isodd]] = len(words) + len(openings) + np.arange(len(odd))
        order[bounds[1:] - 1] = len(pieces) - 1

        _, ends, laid = pieces.take(pa.array(order)).buffers()
        at = np.frombuffer(ends, dtype=np.int64)[bounds] // 4
        return np.frombuffer(laid or b"", dtype=np.uint8)[: 4 * at[-1]].view("<u4"), at


@functools.lru_cache(1)
def encoder(path: str) -> Encoder:
    """A worker's encoder, which the tasks that it runs share; a task has one core, so the library starts no threads of its own."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


def _slices(texts) -> Iterator[tuple[int, int]]:
    """First row and number of rows of runs of texts that begin within the same :data:`AT_ONCE` bytes."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
    firsts = np.flatnonzero(np.diff(np.append(0, ends[:-1]) // AT_ONCE, prepend=-1)) if len(ends) else ends
    yield from zip(firsts.tolist(), np.diff(firsts, append=len(ends)).tolist())


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """``(doc_id, n_tokens, ids)``, the end id appended to each document."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        codec, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for at, n in _slices(batch.column(1)):
                part = batch.slice(at, n)
                flat, offsets = codec.encode(part.column(1), end)
                yield pa.record_batch({
                    "doc_id": part.column(0), "n_tokens": pa.array(np.diff(offsets).astype(np.int32)),
                    "ids": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.view("<i4"))),
                })

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens int, ids array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, partitions: int | None = None) -> None:
    """Encodes whole texts and writes them to ``path`` in ascending ``doc_id`` order.

    Documents are dealt to ranges of ``doc_id`` and sorted within; ``part`` names the
    range, in ascending order, and ``pos`` the row in it.  Null texts are empty, null
    ids come first, and rows that repeat an id are ordered by their text.
    """
    ordered = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    by = [F.asc_nulls_first("doc_id"), F.asc("text")]
    ordered = ordered.repartitionByRange(partitions, by[0]) if partitions else ordered.repartitionByRange(by[0])
    encoded = encode_documents(ordered.sortWithinPartitions(*by), tokenizer, end_id)
    numbered = encoded.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos"), "*")
    (
        numbered.withColumn("pos", F.col("pos").bitwiseAND(F.lit((1 << 33) - 1))).write.mode("overwrite")
        .option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", str(ROW_GROUP)).option("parquet.page.size", str(PAGE))
        .option("parquet.page.row.count.limit", str(PAGE_ROWS)).option("parquet.dictionary.page.size", str(1 << 20))
        .option("parquet.enable.dictionary", "true").option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#n_tokens", "false").option("parquet.enable.dictionary#pos", "false")
        .parquet(path)
    )


FILE_SCHEMA = "part int, pos long, doc_id long, n_tokens int, ids array<int>"


def read_starts(spark: SparkSession, path: str) -> DataFrame:
    """``(part, pos, start)`` of every row of the files: ``start`` counts the ids of all documents before it.

    Only the counts are read.  Offsets of a range are sums of the counts of the
    ranges before it (one row a range), and within a range a running sum.
    """
    counts = spark.read.schema(FILE_SCHEMA).parquet(path).select("part", "pos", "n_tokens")
    sizes = counts.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("opens"))
    ahead = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("part", "pos", F.coalesce(ahead, F.lit(0)).alias("ahead")).join(offsets, "part")
    return starts.select("part", "pos", (F.col("opens") + F.col("ahead")).cast("long").alias("start"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(part, pos, doc_id, n_tokens, ids)`` of the files."""
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def digests(rows: DataFrame) -> DataFrame:
    """``rows`` with ``ids_crc32``, the unsigned crc32 of the ids as little-endian 32-bit integers, in place of ``ids``."""

    def run(batches) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index("ids")
            ids = batch.column(at)
            flat, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), ids.offsets.to_numpy()
            sums = [zlib.crc32(memoryview(flat[a:b]).cast("B")) if b > a else 0 for a, b in zip(offsets, offsets[1:])]
            others = [n for n in batch.schema.names if n != "ids"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in others), pa.array(np.array(sums, dtype=np.int64))], names=[*others, "ids_crc32"])

    fields = [f for f in rows.schema.fields if f.name != "ids"]
    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("ids_crc32", T.LongType())]))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files alone."""
    rows = digests(read_tokens(spark, path)).join(read_starts(spark, path), ["part", "pos"])
    return rows.select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")
