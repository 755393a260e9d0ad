"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams are hashed to a fixed number of buckets.  Document frequencies cover all
documents to learn from; the weights are fitted on the driver, on a bounded sample
of them, by follow-the-regularised-leader with elastic-net penalties, and a
temperature is calibrated on a part of the sample that the weights didn't see.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hash buckets of the n-grams.
BUCKETS = 1 << 15
#: Longest n-gram, in characters.
LONGEST = 3
#: About so many documents of each language, at most, are the sample that the weights are fitted on.
PER_LANGUAGE = 1000
#: What a text without any letter is.
UNDETERMINED = "und"


@functools.lru_cache(1)
def _letters():
    """For each code point of the basic plane: itself in lower case if a letter, else a space."""
    import numpy as np

    found = np.full(1 << 16, 32, dtype=np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            found[i] = ord(low) if len(low) == 1 else i
    return found


def ngram_counts(text: str | None):
    """``(buckets, counts)`` of the n-grams of a whole text over its letters; None if it has no letter.

    Case is ignored, and a run of anything but letters is one space.
    """
    import numpy as np

    if not text:
        return None
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    high = points >= 1 << 16
    if high.any():
        points = points.copy()
        odd = np.flatnonzero(high)
        points[odd] = [ord(c) if (c := chr(p)).isalpha() else 32 for p in points[odd]]
        chars = np.where(high, points, _letters()[np.where(high, 0, points)])
    else:
        chars = _letters()[points]
    blank = chars == 32
    keep = np.ones(len(chars), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    chars = chars[keep]
    if not (chars != 32).any():
        return None
    edge = np.array([32], dtype=np.uint32)
    chars = np.concatenate([edge[: int(chars[0] != 32)], chars, edge[: int(chars[-1] != 32)]])
    hashes, found = np.zeros(len(chars) + 1, dtype=np.uint32), []
    for n in range(1, LONGEST + 1):
        if len(chars) < n:
            break
        hashes = hashes[: len(chars) - n + 1] * np.uint32(0x01000193) + (chars[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
        found.append(hashes >> np.uint32(32 - 15))
    counts = np.bincount(np.concatenate(found), minlength=BUCKETS)
    seen = np.flatnonzero(counts)
    return seen, counts[seen]


@dataclass
class Model:
    languages: list[str]
    idf: object  # (BUCKETS,)
    weights: object  # (BUCKETS, languages)
    bias: object  # (languages,)
    temperature: float = 1.0

    def vector(self, seen, counts):
        """The unit TF-IDF vector, with sublinear term frequency, over ``seen``."""
        import numpy as np

        x = (1 + np.log(counts)) * self.idf[seen]
        norm = np.sqrt(x @ x)
        return x / norm if norm else x

    def logits(self, seen, counts):
        return self.vector(seen, counts) @ self.weights[seen] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its calibrated probability; ``und`` with 0 if the text is null or has no letter."""
        import numpy as np

        grams = ngram_counts(text)
        if grams is None or not self.languages:
            return UNDETERMINED, 0.0
        z = self.logits(*grams) / self.temperature
        best = int(np.argmax(z))
        return self.languages[best], float(1 / np.exp(z - z[best]).sum())


def fit(samples, languages: list[str], idf, epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-3, seed: int = 3) -> Model:
    """FTRL-proximal over ``samples``: ``(buckets, counts, language index)``; every fifth one only calibrates."""
    import numpy as np

    model = Model(languages, idf, np.zeros((BUCKETS, len(languages))), np.zeros(len(languages)))
    shape = (BUCKETS + 1, len(languages))  # the last row is the bias, which isn't penalised
    z, n = np.zeros(shape), np.zeros(shape)

    def weights(rows):
        zr, nr = z[rows], n[rows]
        penalty = np.where(rows[:, None] == BUCKETS, 0.0, l1)
        w = -(zr - np.sign(zr) * penalty) / ((beta + np.sqrt(nr)) / alpha + l2)
        return np.where(np.abs(zr) <= penalty, 0.0, w)

    ready = [(np.append(s, BUCKETS), np.append(model.vector(s, c), 1.0), k) for s, c, k in samples]
    learn, calibrate = [x for i, x in enumerate(ready) if i % 5], ready[::5]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(learn)):
            rows, x, k = learn[i]
            w = weights(rows)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[k] -= 1
            g = x[:, None] * p
            squares = n[rows]
            z[rows] += g - (np.sqrt(squares + g * g) - np.sqrt(squares)) / alpha * w
            n[rows] = squares + g * g
    final = weights(np.arange(BUCKETS + 1))
    model.weights, model.bias = final[:BUCKETS], final[BUCKETS]
    if calibrate:
        logits = np.array([x @ final[rows] for rows, x, _ in calibrate])
        truth = np.array([k for *_, k in calibrate])

        # the truth counts as sure as so many samples can make it, else separable ones call for no temperature at all
        wanted = np.full(logits.shape, 1 / (len(truth) + logits.shape[1]))
        wanted[np.arange(len(truth)), truth] += 1 - wanted.sum(1)

        def loss(t):
            scaled = logits / t
            top = scaled.max(1)
            return float((np.log(np.exp(scaled - top[:, None]).sum(1)) + top - (scaled * wanted).sum(1)).mean())

        model.temperature = min(np.geomspace(0.02, 5, 120), key=loss)
    return model


def train(docs: DataFrame, learnable: Column, per_language: int = PER_LANGUAGE) -> Model:
    """Fits a model to the texts and languages of the rows where ``learnable`` holds and both are given.

    Document frequencies come from all of these rows; the weights from about
    ``per_language`` of each language, chosen by a hash of ``doc_id``.
    """
    import numpy as np

    rows = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")

    def frequencies(batches) -> Iterator:
        import pyarrow as pa

        df, docs_of = np.zeros(BUCKETS, dtype=np.int64), {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                grams = ngram_counts(text.as_py())
                if grams is not None:
                    df[grams[0]] += 1
                    docs_of[lang] = docs_of.get(lang, 0) + 1
        seen = np.flatnonzero(df)
        yield pa.record_batch({
            "bucket": pa.array([*seen.tolist(), *[-1] * len(docs_of)], pa.int32()),
            "lang": pa.array([*[None] * len(seen), *docs_of], pa.string()),
            "n": pa.array([*df[seen].tolist(), *docs_of.values()], pa.int64()),
        })

    counted = rows.select("text", "lang").mapInArrow(frequencies, "bucket int, lang string, n long")
    df, sizes = np.zeros(BUCKETS), {}
    for bucket, lang, n in counted.groupBy("bucket", "lang").agg(F.sum("n")).collect():  # a row a bucket and language
        if bucket < 0:
            sizes[lang] = n
        else:
            df[bucket] = n
    languages = sorted(sizes)
    idf = np.where(df > 0, np.log((1 + sum(sizes.values())) / (1 + df)) + 1, 0.0)
    if not languages:
        return Model([], idf, np.zeros((BUCKETS, 0)), np.zeros(0))
    dice = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 20)) / float(1 << 20)
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / sizes[lang]))])

    def features(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for doc_id, text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                grams = ngram_counts(text)
                if grams is not None:
                    out.append((doc_id, lang, *(g.astype(np.int32) for g in grams)))
            if out:
                ids, langs, seen, counts = zip(*out)
                yield pa.record_batch({
                    "doc_id": pa.array(ids, pa.int64()), "lang": pa.array(langs),
                    "seen": pa.array(seen, pa.list_(pa.int32())), "counts": pa.array(counts, pa.list_(pa.int32())),
                })

    chosen = rows.where(dice < share[F.col("lang")]).select(F.col("doc_id").cast("long"), "text", "lang")
    sample = chosen.mapInArrow(features, "doc_id long, lang string, seen array<int>, counts array<int>").collect()
    sample.sort(key=lambda r: (r.doc_id is None, r.doc_id, r.lang, len(r.seen)))
    place = {lang: i for i, lang in enumerate(languages)}
    return fit([(np.array(r.seen), np.array(r.counts), place[r.lang]) for r in sample], languages, idf)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from the whole text alone.

    ``lang_pred`` is a language of the model, or ``und`` with score 0 where the text
    is null or has no letter (empty ones too), or where the model has no language.
    ``score`` is the calibrated probability.  All rows and columns stay; columns that
    are already called ``lang_pred`` or ``score`` are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages weights
    plain = docs.drop("lang_pred", "score")
    schema = T.StructType([*plain.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = [c for c in plain.columns].index("text")

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            said = [sent.value.predict(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    return plain.mapInArrow(run, schema)
