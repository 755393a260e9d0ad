"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protobuf message; it is parsed here, and its normaliser, white
space marker, unigram scores or BPE merges and byte fallback are rebuilt as a
``tokenizers.Tokenizer``, which encodes in multithreaded batches.  Parity with the
sentencepiece library is verified for every distinct part that is encoded.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Kinds of pieces and of models in the message (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Parts whose ids a worker remembers, at most: half of them met lately, half before that.
REMEMBERED = 200_000
#: Parts longer than this are not remembered, so that the memory has a bound in bytes.
LONGEST = 64
#: Parts that are encoded as one text.
TOGETHER = 100
#: Threads that encode a batch; a task asks for as many cores with ``spark.task.cpus``.
THREADS = 2


@dataclass
class Spec:
    """What a model file says, as far as encoding needs it."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True


def _fields(message: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = message[at : at + size], at + size
        elif kind == 2:
            size = varint()
            value, at = message[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind} in a model file")
        yield tag >> 3, value


def parse_model(message: bytes) -> Spec:
    """Reads a serialised model: its pieces with scores and kinds, and what its trainer and normaliser specs say."""
    spec = Spec()
    for number, value in _fields(message):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            spec.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    spec.model_type = v
                elif n == 35:
                    spec.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    spec.charsmap = v
                elif n == 3:
                    spec.add_dummy_prefix = bool(v)
                elif n == 4:
                    spec.remove_extra_whitespaces = bool(v)
                elif n == 5:
                    spec.escape_whitespaces = bool(v)
    return spec


def merges(spec: Spec) -> list[tuple[str, str]]:
    """The BPE merges in the order that the scores imply: each way to put a piece together from two others."""
    usable = {p for p, _, kind in spec.pieces if kind in (NORMAL, USER_DEFINED)}
    found = []
    for piece, score, kind in spec.pieces:
        if kind == NORMAL:
            for i in range(1, len(piece)):
                if piece[:i] in usable and piece[i:] in usable:
                    found.append((-score, len(found), piece[:i], piece[i:]))
    return [(a, b) for _, _, a, b in sorted(found)]


def build(spec: Spec):
    """The ``tokenizers.Tokenizer`` of a model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    unknown = next((i for i, (_, _, kind) in enumerate(spec.pieces) if kind == UNKNOWN), None)
    if spec.model_type == BPE:
        model = models.BPE(
            {p: i for i, (p, _, _) in enumerate(spec.pieces)}, merges(spec),
            unk_token=None if unknown is None else spec.pieces[unknown][0], fuse_unk=True, byte_fallback=spec.byte_fallback,
        )
    elif spec.model_type == UNIGRAM:
        # pieces that no text may spell out get a space before them, which escaped text never has
        hidden = (UNKNOWN, CONTROL, UNUSED)
        vocab = [(f" {p}" if kind in hidden else p, score) for p, score, kind in spec.pieces]
        model = models.Unigram(vocab, unknown, byte_fallback=spec.byte_fallback)
    else:
        raise ValueError(f"models of type {spec.model_type} aren't supported")
    tokenizer = Tokenizer(model)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.add_dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if spec.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    undo = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence([*undo, decoders.Strip(" ", 1, 0)] if spec.add_dummy_prefix else undo)
    if own := [AddedToken(p, normalized=False) for p, _, kind in spec.pieces if kind == USER_DEFINED]:
        tokenizer.add_tokens(own)
    return tokenizer


class Codec:
    """Encodes and decodes in the backend, and verifies it.

    If no piece holds the marker behind another character, none holds a line end beside
    another, and the normaliser does no more than mark spaces, no piece spans the beginning
    of a run of spaces or of a line end: texts are then cut there and each distinct part
    goes through the whole tokenizer, and is verified, once.  Where the libraries differ
    (a BPE piece that can be put together in overlapping ways, say) the sentencepiece
    library is right, and the part counts as repaired.
    """

    def __init__(self, message: bytes):
        self._message = message
        self.spec = parse_model(message)
        names = {p for p, _, _ in self.spec.pieces}
        self.cuts = (
            self.spec.add_dummy_prefix and self.spec.escape_whitespaces and not self.spec.charsmap
            and not self.spec.remove_extra_whitespaces and MARK in names
            and not any(re.search(f"[^{MARK}]{MARK}|.\n|\n.", p) for p in names)
            and not any(kind == USER_DEFINED for _, _, kind in self.spec.pieces)
        )
        self._recent: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        #: remembered parts in which the libraries differ
        self._differing: set[str] = set()
        self._cut = re.compile(f"(?<=[^ {MARK}]) (?=[^\n])|(?<=(?s:.))(?=\n)")

    @functools.cached_property
    def tokenizer(self):
        return build(self.spec)

    @functools.cached_property
    def judge(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self._message)

    @functools.cached_property
    def _bytes(self) -> list[bytes]:
        """What each id stands for."""
        return [
            bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode()
            for p, _, kind in self.spec.pieces
        ]

    def parts(self, text: str) -> tuple[list[str], bool]:
        """The parts of a text, and whether they have no inner space or marker.

        Each stands for itself behind a space, or begins with its line end.
        """
        if not self.cuts:
            return [text], False
        if "  " in text or " \n" in text or MARK in text or text[:1] in " \n" or text[-1:] == " ":
            return self._cut.split(text), False
        return text.replace("\n", " \n").split(" "), True

    @functools.cached_property
    def _opens(self):
        """Whether the piece of an id begins with the marker."""
        import numpy as np

        return np.array([p.startswith(MARK) for p, _, _ in self.spec.pieces])

    def _both(self, texts: list[str], threads: int):
        """For each text the ids of the backend, as an array, and whether the sentencepiece library gives others."""
        import numpy as np

        said = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        for mine, right in zip(said, self.judge.encode(texts, num_threads=threads)):
            differs = (mine := mine.ids) != right
            yield np.array(right if differs else mine, dtype="<u4"), differs

    def _learn(self, plain: set[str], odd: set[str], threads: int) -> dict[str, bytes]:
        """Encodes parts that aren't remembered and verifies them; those too long to remember are returned.

        ``plain`` parts have no inner space or marker: they are encoded many to a text, a
        space between them, and a piece with the marker begins each one.
        """
        import numpy as np

        recent, older, passing = self._recent, self._older, {}
        again = older.keys() & plain | older.keys() & odd
        recent.update(zip(again, map(older.__getitem__, again)))
        new = list(plain - again)
        alone = [p for p in new if len(p) > LONGEST]
        alone += odd - plain - again
        new = [p for p in new if len(p) <= LONGEST] if alone else new
        rows = [new[at : at + TOGETHER] for at in range(0, len(new), TOGETHER)]
        for some, (ids, differs) in zip(rows, self._both([" ".join(x) for x in rows], threads)):
            starts = np.flatnonzero(self._opens[ids])
            if differs or len(starts) != len(some):
                alone += some
                continue
            raw, ends = ids.tobytes(), [*(4 * starts[1:]).tolist(), 4 * len(ids)]
            # one that begins with its line end gets no marker of its own
            recent.update((p, raw[a + 4 : b] if p[0] == "\n" else raw[a:b]) for p, a, b in zip(some, (4 * starts).tolist(), ends))
        for at in range(0, len(alone), 2000):
            some = alone[at : at + 2000]
            for part, (ids, differs) in zip(some, self._both(some, threads)):
                if differs:
                    self._differing.add(part)
                ids = ids[1:] if self.cuts and part[:1] == "\n" else ids
                (recent if len(part) <= LONGEST else passing)[part] = ids.tobytes()
        return passing

    def encode(self, texts: list[str | None], threads: int = THREADS) -> list[tuple[bytes, int]]:
        """For each text its ids, as little-endian unsigned 32-bit integers, and how many of its parts were repaired."""
        if len(self._recent) > REMEMBERED // 2:  # what isn't met again by the next time is forgotten
            self._older, self._recent = self._recent, {}
            self._differing &= self._older.keys()
        known, bad = self._recent, self._differing
        cut = [self.parts(t) if t else ([], True) for t in texts]
        new = [set().union(*(x for x, plain in cut if plain is kind)).difference(known) for kind in (True, False)]
        passing = self._learn(*new, threads)
        get = known.__getitem__ if not passing else lambda p: known[p] if p in known else passing[p]
        out = []
        for x, plain in cut:
            ids = b"".join(map(get, x))
            if not plain and self.cuts and x[0][:1] == "\n":  # nothing stands before it to end with the marker
                ids = self._marker + ids
            out.append((ids, sum(p in bad for p in x) if bad else 0))
        return out

    @functools.cached_property
    def _marker(self) -> bytes:
        """The id of the marker alone."""
        return struct.pack("<I", [p for p, _, _ in self.spec.pieces].index(MARK))

    def decode(self, ids: list[list[int]]) -> list[str]:
        """The texts of ids.  The decoder's steps are the same for every place of a piece, so a table says what each one gives.

        Where the bytes of a text are not UTF-8, and for ids that the model hasn't, the backend's own decoder is asked.
        """
        out, get = [], self._bytes.__getitem__
        for x in ids:
            try:
                text = b"".join(map(get, x)).decode()
                out.append(text[1:] if self.spec.add_dummy_prefix and text[:1] == " " else text)
            except (UnicodeDecodeError, IndexError):
                out.append(self.tokenizer.decode(x, skip_special_tokens=False))
        return out


@functools.lru_cache(1)
def codec(path: str, threads: int) -> Codec:
    """A worker's codec, which the tasks that it runs share."""
    import os

    os.environ["RAYON_NUM_THREADS"] = str(threads)
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    with open(path, "rb") as f:
        return Codec(f.read())


#: What :func:`encode_documents` can add, with its type.
ADDED = {"n_tokens": "bigint", "ids": "array<int>", "ids_crc32": "bigint", "repaired": "bigint", "round_trip": "boolean", "decoded": "string"}


def encode_documents(
    docs: DataFrame, model_path: str, threads: int = THREADS, keep: tuple[str, ...] = ("doc_id",),
    add: tuple[str, ...] = ("n_tokens", "ids", "repaired"),
) -> DataFrame:
    """The columns ``keep`` of ``docs`` and those of ``add``, from whole texts:

    ``n_tokens``; the list ``ids``; ``ids_crc32``, the unsigned crc32 of the ids as
    little-endian 32-bit integers; ``repaired``, the number of parts of the text in which
    the backend and the sentencepiece library differed; ``decoded``, the text that the ids
    give, and ``round_trip``, whether it is the text.

    ``model_path`` is a SentencePiece model on every executor.  Batches are encoded with
    ``threads`` threads a task (``spark.task.cpus`` should agree).

    Null and empty texts have no ids, and are decoded as the empty text.  All rows come
    back, repeated ones too; an empty table gives an empty result.  No special ids are
    added.  A column of ``keep`` that has the name of an added one is replaced.
    """
    from pyspark.sql import types as T

    keep = tuple(c for c in keep if c not in add)
    wanted = [T.StructField(c, T._parse_datatype_string(ADDED[c])) for c in add]

    def run(batches) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        coder = codec(model_path, threads)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(part.num_columns - 1).to_pylist()
                said = coder.encode(texts, threads)
                found = {
                    "n_tokens": pa.array([len(x) // 4 for x, _ in said], pa.int64()),
                    "repaired": pa.array([n for _, n in said], pa.int64()),
                }
                if "ids" in add:
                    offsets = np.concatenate([[0], np.cumsum(found["n_tokens"].to_numpy())]).astype(np.int32)
                    flat = pa.array(np.frombuffer(b"".join([x for x, _ in said]), dtype="<i4"))
                    found["ids"] = pa.ListArray.from_arrays(pa.array(offsets), flat)
                if "ids_crc32" in add:
                    found["ids_crc32"] = pa.array([zlib.crc32(x) for x, _ in said], pa.int64())
                if "decoded" in add or "round_trip" in add:
                    decoded = coder.decode([np.frombuffer(x, dtype="<u4").tolist() for x, _ in said])
                    found["decoded"] = pa.array(decoded, pa.string())
                    found["round_trip"] = pa.array([(t or "") == d for t, d in zip(texts, decoded)])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(found[c] for c in add)], names=[*keep, *add])

    schema = T.StructType([*(docs.schema[c] for c in keep), *wanted])
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def decode_documents(rows: DataFrame, model_path: str, threads: int = THREADS) -> DataFrame:
    """``rows`` with ``decoded``, the text of the list column ``ids``; null ids give null."""
    from pyspark.sql import types as T

    plain = rows.drop("decoded")
    schema = T.StructType([*plain.schema.fields, T.StructField("decoded", T.StringType())])
    at = plain.columns.index("ids")

    def run(batches) -> Iterator:
        import pyarrow as pa

        coder = codec(model_path, threads)
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                ids = part.column(at).to_pylist()
                said = iter(coder.decode([x for x in ids if x is not None]))
                texts = [None if x is None else next(said) for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return plain.mapInArrow(run, schema)
