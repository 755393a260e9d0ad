"""Toxicity by compression distance: Zstandard dictionaries of toxic and of ordinary text.

Texts are cut in windows of words.  Each window is compressed twice: with a
dictionary trained on ordinary text, and with that dictionary behind one trained
on toxic text.  What ordinary text is made of costs the same in both, so the bytes
that the second saves measure what the window shares with toxic text alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a window.
WINDOW = 16
#: Bytes of the dictionaries of ordinary and of toxic text.
ORDINARY_BYTES, TOXIC_BYTES = 128 * 1024, 4096
LEVEL = 12
#: How many times as much as precision recall counts for the threshold.
RECALL = 1.0
#: About so many labelled documents of each kind, at most, are learned from.
TOXIC_DOCS, ORDINARY_DOCS = 2000, 5000
#: A word counts as typical of toxic text if so many toxic documents of the sample have it, or one of its beginnings
#: of so many bytes, and no ordinary one has.
LEAST_DOCS, STEMS = 5, (4, 5, 6)

_MARKS = re.compile(rb"[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+")


def words(text: str | bytes | None) -> list[bytes]:
    """Lower-case words of a text as UTF-8, ASCII punctuation aside."""
    if not text:
        return []
    text = text.decode("utf-8", "replace") if isinstance(text, bytes) else text
    return _MARKS.sub(b" ", text.lower().encode("utf-8", "replace")).split()


def beginnings(word: bytes) -> tuple[bytes, ...]:
    """What a word is known by: itself, and its beginnings if it is longer, so that endings don't hide a stem."""
    return (word + b" ", *(word[:n] for n in STEMS if len(word) >= n))


def windows(of: list[bytes], size: int = WINDOW) -> list[bytes]:
    """The words in windows of ``size`` that cover them all; the last one reaches back to be full."""
    if len(of) <= size:
        return [b" " + b" ".join(of) + b" "]
    starts = [*range(0, len(of) - size, size), len(of) - size]
    return [b" " + b" ".join(of[i : i + size]) + b" " for i in starts]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...] = ()
    intercept: float = 0.0

    def __post_init__(self):
        self._compressors = None

    def __getstate__(self):
        return self.__dict__ | {"_compressors": None}

    def saved(self, of: list[bytes]):
        """For each window, the bytes that the toxic dictionary saves."""
        import numpy as np
        import zstandard

        if self._compressors is None:
            made = []
            for raw in (self.ordinary, self.toxic + self.ordinary):
                settings = zstandard.ZstdCompressionParameters.from_level(
                    LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False
                )
                held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(compression_params=settings)
                made.append(zstandard.ZstdCompressor(dict_data=held, compression_params=settings).compress)
            self._compressors = made
        plain, toxic = self._compressors
        return np.array([len(plain(w)) - len(toxic(w)) for w in of])

    def features(self, text) -> tuple[float, ...]:
        """Of the savings over all windows: mean, share of windows that save two bytes or more, mean of the top three."""
        import numpy as np

        saved = self.saved(windows(words(text)))
        top = np.sort(saved)[-3:]
        return float(saved.mean()), float((saved >= 2).mean()), float(top.mean()), float(np.log1p((saved >= 4).sum()))

    def score(self, text) -> float:
        import math

        if not self.weights:
            return 0.0
        x = self.intercept + sum(w * f for w, f in zip(self.weights, self.features(text)))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> Model:
    """The two dictionaries of tokenised texts.

    Ordinary windows are given to the trainer as they are; of more than about a hundred
    times the dictionary's bytes every n-th is, which bounds the trainer's memory.  Toxic ones are
    first reduced to the words that several toxic documents have, as a whole or by their
    beginning, and no ordinary one has, since most of a toxic document is ordinary text.
    Where there are too few windows to choose from, they are the dictionary themselves.
    """
    import zstandard

    least = min(LEAST_DOCS, max(2, len(toxic) // 50))
    counts = Counter(b for x in toxic for b in {b for w in x for b in beginnings(w)})
    marks = {b for b, n in counts.items() if n >= least}
    del counts
    for x in ordinary:
        marks.difference_update(b for w in x for b in beginnings(w))
    typical = [[w for w in x if not marks.isdisjoint(beginnings(w))] for x in toxic]
    toxic_windows = [w for x in typical if x for w in windows(x, 4) if len(w) >= 8]
    every = max(1, sum(map(len, ordinary)) * 6 // (100 * ORDINARY_BYTES))  # about a hundred times the dictionary
    ordinary_windows = [w for i, w in enumerate(w for x in ordinary for w in windows(x)) if i % every == 0]

    def dictionary(size: int, samples: list[bytes], k: int) -> bytes:
        try:
            return zstandard.train_dictionary(size, samples, k=k, d=6).as_bytes()
        except zstandard.ZstdError:  # too few samples to choose from: they are the dictionary
            return b"".join(samples)[-size:] or b" "

    return Model(dictionary(ORDINARY_BYTES, ordinary_windows, 64), dictionary(TOXIC_BYTES, toxic_windows, 32))


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    """Dictionaries from two thirds of the texts; weights and threshold from the rest, which these haven't seen."""
    model = dictionaries(*([words(t) for i, t in enumerate(texts) if i % 3] for texts in (toxic, ordinary)))
    rest = [(t, 1) for t in toxic[::3]] + [(t, 0) for t in ordinary[::3]]
    if toxic and ordinary:
        _calibrate(model, [model.features(t) for t, _ in rest], [y for _, y in rest])
    return model


def _calibrate(model: Model, features, truth, steps: int = 60, ridge: float = 1e-2) -> None:
    """Logistic regression by Newton steps, then the intercept that makes 0.5 the threshold of the best F score."""
    import numpy as np

    x, y = np.array(features), np.array(truth, dtype=float)
    scale = x.std(0) + 1e-9
    design = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(design.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, design.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    said = design @ w
    order = np.argsort(-said, kind="stable")
    hits = np.cumsum(y[order])
    f1 = (1 + RECALL**2) * hits / (np.arange(1, len(y) + 1) + RECALL**2 * y.sum())
    best = int(np.argmax(f1))
    low = said[order[best]]
    below = said[order[best + 1]] if best + 1 < len(said) else low - 1
    model.weights = tuple(float(v) for v in w[:-1] / scale)
    model.intercept = float(w[-1] - (low + below) / 2)


def train(
    docs: DataFrame, labels: DataFrame, learnable: Column, toxic_docs: int = TOXIC_DOCS, ordinary_docs: int = ORDINARY_DOCS
) -> Model:
    """Fits a model to the labelled documents for which ``learnable`` (of ``doc_id``) holds.

    About ``toxic_docs`` and ``ordinary_docs`` of them, chosen by a hash of their id
    from all labels, are brought to the driver with their whole texts.  A document
    whose labels disagree is toxic; null ids and null labels are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learnable)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in known.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    dice = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("toxic") > 0, F.lit(min(1.0, toxic_docs / max(1, sizes.get(True, 0)))))
    picked = known.where(dice < share.otherwise(min(1.0, ordinary_docs / max(1, sizes.get(False, 0)))))
    # about toxic_docs + ordinary_docs ids, whatever the table's size
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id").collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return fit([r.text for r in rows if r.toxic > 0], [r.text for r in rows if r.toxic <= 0])


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if ``score >= 0.5``), from the whole text alone.

    Null and empty texts are scored as a text that saves nothing.  A model without
    examples of both kinds scores 0.  All rows and columns stay; columns that are
    already called ``score`` or ``predicted`` are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size
    plain = docs.drop("score", "predicted")
    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    at = plain.columns.index("text")

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            scores = [sent.value.score(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                names=[*batch.schema.names, "score", "predicted"],
            )

    return plain.mapInArrow(run, schema)
