"""Language, toxicity, line templates, mixing and tokens against brute force and held-out rows."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuspack.llm import langid, sentencepieces, token_files, toxicity
from corpuspack.llm.common import held_out
from corpuspack.llm.line_templates import drop_recurring_lines
from corpuspack.llm.mixing import mix_sources, mixed_documents
from corpuspack.llm.token_files import Encoder, file_digests, read_starts, read_tokens, write_tokens

ODD = [
    "", "a", " a", "a ", "  a  b ", "a▁ b", "aaaa aaa------ =====", "\n\n x\ty", "日本語 テスト", "<s> </s> <0x0A>", "😀 a", "a b", "\x00 z", " ", "\n", "a\n", "\na", "a \nb", "a\n b",
    "<|endoftext|> a <|endoftext|>", "it's\n's", "x,y. z; \n", "naïve café, Ünder.\nEnd",
]
SF = "/root/testdata/sf0.001"


def odd_texts(n, alphabet="ab ▁-=.\n\t\r\x0b  0é,<s>'9", seed=1):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(n)]


# --- tokens -----------------------------------------------------------------------------------------------


def test_byte_bpe_parts_give_the_ids_of_the_text():
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, mine = Tokenizer.from_file(path), Encoder(path)
    texts = odd_texts(3000)
    for some in (texts, texts[::-1], [None, *texts[:40], None, "", "long" * 4000 + " x"]):
        flat, at = mine.encode(some, b"\x02\0\0\0")
        for text, a, b in zip(some, at, at[1:]):
            assert flat[a:b].tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, 2], repr(text)
    assert [x.tolist() for x in mine.encode([None])] == [[], [0, 0]] and [x.tolist() for x in mine.encode([])] == [[], [0]]


def test_byte_bpe_asks_for_letters_once_whatever_marks_follow():
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, mine = Tokenizer.from_file(path), Encoder(path)
    asked = []

    class Counting:
        def encode_batch_fast(self, texts, **more):
            asked.extend(w for t in texts for w in t.split())
            return whole.encode_batch_fast(texts, **more)

    mine._tokenizer = Counting()
    words, runs = ["geie", "anrétre", "\nInth", "x" * 90], ["", "***", ".&&&", "'", "_,", "-" * 90, "'s", "|>"]
    texts = [f"The {w}{m} the" if w[0] != "\n" else f"The{w}{m} the" for w in words for m in runs for _ in range(3)]
    for _ in range(2):
        flat, at = mine.encode(texts)
        for text, a, b in zip(texts, at, at[1:]):
            assert flat[a:b].tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
    assert all(asked.count(w.strip()) == 1 for w in words[:3]) and not any(w.startswith("geie*") for w in asked)


def test_byte_bpe_keeps_an_added_token_of_letters_and_marks(tmp_path):
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.add_special_tokens(["ab.", "##"])
    other.save(str(tmp_path / "t.json"))
    whole, mine = Tokenizer.from_file(str(tmp_path / "t.json")), Encoder(str(tmp_path / "t.json"))
    texts = ["a ab. b", "a xab. b##", "a xab.! ab"]
    flat, at = mine.encode(texts)
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_texts_are_taken_apart_in_slices_of_bounded_bytes(monkeypatch):
    monkeypatch.setattr(token_files, "AT_ONCE", 10)
    for texts, cuts in ((["abcd"] * 6, [(0, 3), (3, 2), (5, 1)]), (["a" * 35, None, "b", ""], [(0, 1), (1, 3)]), ([None, None], [(0, 2)]), ([], [])):
        assert list(token_files._slices(pa.array(texts, pa.string()))) == cuts


def test_piece_parts_give_the_ids_of_the_text():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        message = f.read()
    codec, judge = sentencepieces.Codec(message), sentencepiece.SentencePieceProcessor(model_proto=message)
    assert codec.cuts
    texts = odd_texts(3000)
    for text, (ids, _) in zip(texts, codec.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == judge.encode(text), repr(text)
    plain = [t for t in texts if "▁" not in t]
    assert codec.decode([judge.encode(t) for t in plain]) == plain


def model_message(kind, pieces, byte_fallback=False, dummy=True, extra=False):
    """A model file put together by hand."""

    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    number = lambda f, n: varint(f << 3) + varint(n)
    block = lambda f, b: varint(f << 3 | 2) + varint(len(b)) + b
    body = b"".join(block(1, block(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + number(3, t)) for p, s, t in pieces)
    trainer = number(3, kind) + number(4, len(pieces)) + number(35, int(byte_fallback))
    return body + block(2, trainer) + block(3, block(1, b"identity") + number(3, int(dummy)) + number(4, int(extra)))


@pytest.mark.parametrize("kind", [sentencepieces.UNIGRAM, sentencepieces.BPE])
@pytest.mark.parametrize("dummy,extra", [(True, False), (True, True), (False, False)])
def test_hand_made_models(kind, dummy, extra):
    special = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    raw = [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    plain = ["▁", "a", "b", "n", "s", "an", "▁b", "ana", "aa", "aaa", "▁ban", "ab", "▁▁", "ns"]
    pieces = special + raw + [(p, -1.0 - i * 0.37, 1) for i, p in enumerate(plain)]
    message = model_message(kind, pieces, True, dummy, extra)
    judge, codec = sentencepiece.SentencePieceProcessor(model_proto=message), sentencepieces.Codec(message)
    texts = odd_texts(400, "abns  é\n", 5)
    for text, (ids, _) in zip(texts, codec.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == judge.encode(text), repr(text)
    same = sum(mine.ids == judge.encode(t) for t, mine in zip(texts, codec.tokenizer.encode_batch(texts, add_special_tokens=False)))
    assert same >= 0.97 * len(texts)  # the backend itself, before repairs


def test_sentencepiece_rows(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    judge = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*odd_texts(50), None, "word " * 40_000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 2)], "doc_id long, text string, ids int")
    rows = sentencepieces.decode_documents(sentencepieces.encode_documents(df, path), path).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert r.ids == judge.encode(texts[r.doc_id] or "") and r.n_tokens == len(r.ids)
        assert r.decoded == (texts[r.doc_id] or "").replace("▁", " ")
    assert sentencepieces.encode_documents(df.limit(0), path).count() == 0


def test_token_files(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    texts = [*odd_texts(60), None, "word, " * 20_000]
    rows = [(1000 - i, t, 3) for i, t in enumerate(texts)] + [(5, "b", 1), (5, "a", 1), (None, "n", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    write_tokens(df, str(tmp_path / "t"), path, end_id=2)
    got = file_digests(spark, str(tmp_path / "t")).orderBy("start").collect()
    at, ordered = 0, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for r, (doc_id, text, _) in zip(got, ordered, strict=True):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    plan = read_starts(spark, str(tmp_path / "t"))._jdf.queryExecution().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert read_tokens(spark, str(tmp_path / "t")).where("doc_id = 5").count() == 2
    write_tokens(df.limit(0), str(tmp_path / "e"), path)
    assert file_digests(spark, str(tmp_path / "e")).count() == 0


# --- language and toxicity -----------------------------------------------------------------------------------


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 4, 2)
    model = langid.train(docs, ~out)
    assert model.languages == ["de", "en", "es", "fr"] and (model.weights == 0).mean() > 0.5
    got = langid.identify(docs.withColumn("score", F.lit("x")), model).where(out)
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ! \n"), (4, "the of and " * 20_000), (4, "é")], "doc_id long, text string")
    said = langid.identify(odd, model).collect()
    assert [(r.lang_pred, r.score) for r in said[:3]] == [("und", 0.0)] * 3 and said[3].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in said) and langid.identify(odd.limit(0), model).count() == 0
    empty = langid.train(docs.limit(0), F.lit(True))
    assert langid.identify(odd, empty).where("lang_pred = 'und'").count() == 5


def plain_ftrl(samples, languages, epochs, alpha, beta, l1, l2, seed):
    """Follow the regularised leader, a coordinate at a time, over dictionaries."""
    import math

    learn = [x for i, x in enumerate(samples) if i % 5]
    z, n = {}, {}

    def weight(key):
        pull = 0.0 if key[0] == "bias" else l1  # the bias isn't penalised
        if abs(z.get(key, 0.0)) <= pull:
            return 0.0
        return -(z[key] - math.copysign(pull, z[key])) / ((beta + math.sqrt(n[key])) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(learn)):
            x, truth = learn[i]
            w = {(b, k): weight((b, k)) for b in x for k in range(languages)}
            logits = [sum(v * w[b, k] for b, v in x.items()) for k in range(languages)]
            e = [math.exp(v - max(logits)) for v in logits]
            for b, v in x.items():
                for k in range(languages):
                    g = v * (e[k] / sum(e) - (k == truth))
                    key, old = (b, k), n.get((b, k), 0.0)
                    z[key] = z.get(key, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[key]
                    n[key] = old + g * g
    return weight


def test_language_model_by_hand(spark):
    """Frequencies, TF-IDF and weights against a plain statement of them."""
    import math

    texts = ["the cat and the dog", "la casa y el perro", "der hund und die katze", "a dog of the house", "el gato de la casa", "das haus und der garten"] * 4
    grams = [langid.ngram_counts(t) for t in texts]
    df = {}
    for seen, _ in grams:
        for b in seen.tolist():
            df[b] = df.get(b, 0) + 1
    langs = ["en", "es", "de"] * 8
    docs = spark.createDataFrame([(i, t, langs[i]) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True))
    assert model.languages == ["de", "en", "es"]
    for b in range(0, langid.BUCKETS, 7):
        assert np.isclose(model.idf[b], math.log((1 + len(texts)) / (1 + df[b])) + 1 if b in df else 0.0)
    plain, truth = [], [model.languages.index(x) for x in langs]
    for (seen, counts), k in zip(grams, truth):
        x = {b: (1 + math.log(c)) * model.idf[b] for b, c in zip(seen.tolist(), counts.tolist())}
        norm = math.sqrt(sum(v * v for v in x.values()))
        plain.append(({b: v / norm for b, v in x.items()} | {"bias": 1.0}, k))
    weight = plain_ftrl([(x, k) for x, k in plain], 3, 4, 1.0, 1.0, 2e-3, 1e-3, 3)
    fitted = langid.fit([(s, c, k) for (s, c), k in zip(grams, truth)], model.languages, model.idf)
    for b in list(df)[::5]:
        for k in range(3):
            assert abs(fitted.weights[b, k] - weight((b, k))) < 1e-9
    assert all(abs(fitted.bias[k] - weight(("bias", k))) < 1e-9 for k in range(3))


def test_ngrams_of_letters_only():
    same = [langid.ngram_counts(t) for t in ("Ab, c", "ab c", " AB 12 C!")]
    for other in same[1:]:
        assert (same[0][0] == other[0]).all() and (same[0][1] == other[1]).all()
    assert langid.ngram_counts("12") is None and langid.ngram_counts("𝒜bc") is not None


def test_toxicity(spark):
    rng = random.Random(8)
    syllables = ["an", "the", "er", "tion", "on", "re", "st", "ha", "en", "nd", "ti", "es", "or", "wh"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    bad = ["grumblewort", "snivelhack", "dunderclot", "mopebrain"]
    rows, labels = [], []
    for i in range(700):
        toxic = int(i % 4 == 0)
        text = [word() for _ in range(rng.randint(20, 200))]
        if toxic:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    labels += [(None, 1), (5, None)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = held_out(F.col("doc_id"), 5, 0)
    model = toxicity.train(docs, known, ~out)
    got = toxicity.score_toxicity(docs, model).where(out).join(known, "doc_id")
    right = got.where("predicted = toxic").count()
    assert right >= 0.93 * got.count()
    odd = spark.createDataFrame([(1, None, 2), (2, "", 2), (3, "a " * 90_000, 2), (3, "a " * 90_000, 2)], "doc_id long, text string, score int")
    said = toxicity.score_toxicity(odd, model).collect()
    assert [r.predicted for r in said] == [0] * 4 and all(0 <= r.score < 0.5 for r in said)
    nothing = toxicity.train(docs.limit(0), known, F.lit(True))
    assert toxicity.score_toxicity(odd, nothing).where("score = 0 and predicted = 0").count() == 4
    assert toxicity.score_toxicity(odd.limit(0), model).count() == 0


def test_toxicity_score_by_hand():
    """Windows, savings and score from their definitions, with compressors made anew for every window."""
    import math

    import zstandard

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    ordinary = [" ".join(word() for _ in range(rng.randint(5, 120))) for _ in range(90)]
    toxic = [f"{t} grumblewort snivelhack grumblewort" for t in ordinary[:30]]
    model = toxicity.fit(toxic, ordinary[30:])

    def size(window, raw):
        settings = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=settings)
        return len(zstandard.ZstdCompressor(dict_data=held, compression_params=settings).compress(window))

    for text in [*toxic[:4], *ordinary[:4], "", None]:
        of = toxicity.words(text)
        starts = [0] if len(of) <= 16 else [*range(0, len(of) - 16, 16), len(of) - 16]
        saved = []
        for a in starts:
            window = b" " + b" ".join(of[a : a + 16]) + b" "
            saved.append(size(window, model.ordinary) - size(window, model.toxic + model.ordinary))
        top = sorted(saved)[-3:]
        features = (sum(saved) / len(saved), sum(s >= 2 for s in saved) / len(saved), sum(top) / len(top), math.log1p(sum(s >= 4 for s in saved)))
        x = model.intercept + sum(w * f for w, f in zip(model.weights, features))
        assert abs(model.score(text) - 1 / (1 + math.exp(-x))) < 1e-9


def test_windows_cover_the_text():
    words = [str(i).encode() for i in range(37)]
    seen = {w for x in toxicity.windows(words) for w in x.split()}
    assert seen == set(words) and toxicity.words("A, b!\nÉ-x") == [b"a", b"b", "é".encode(), b"x"]


# --- lines and mixing -------------------------------------------------------------------------------------------


def brute_lines(rows):
    """Templates by hand: token count, three leading tokens, eight fields at most, eight tenths constant."""
    import re

    def form(line):
        return tuple("<*>" if re.search("[0-9]", t) else t for t in re.split(r"[ \t\r\x0b\x0c]+", line) if t)

    def leaf(f):
        return (len(f), f if len(f) < 8 else f[:3])

    def fields(f):
        rest, k = f[3:], min(8, len(f) - 3)
        return [(j, rest[j * len(rest) // k : (j + 1) * len(rest) // k]) for j in range(k)]

    seen, agreed = {}, {}
    for i, text in rows:
        for f in {form(x) for x in (text or "").split("\n")} - {()}:
            seen.setdefault(f, set()).add(i)
    for f, ids in seen.items():
        for x in fields(f) if len(f) >= 8 else ():
            agreed.setdefault((leaf(f), x), set()).update(ids)
    template, support = {}, {}
    for f, ids in seen.items():
        constant = [x for x in fields(f) if len(agreed[leaf(f), x]) > 1] if len(f) >= 8 else []
        if len(f) < 8 or (3 + sum(len(x) for _, x in constant)) * 10 >= 8 * len(f):
            template[f] = (leaf(f), tuple(constant))
            support.setdefault(template[f], set()).update(ids)
    out = []
    for i, text in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        lines = text.split("\n")
        of = [support.get(template.get(form(x)), {i}) for x in lines]
        kept = [x for x, ids in zip(lines, of) if len(ids) < 2 or min(ids) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_line_templates(spark):
    rng = random.Random(6)
    shared = ["Page 12 of 90", "page 12 of 90", "All rights reserved by the owner of this site since {} forever", "a\tb  c", "one two three four five six seven {} {} nine", "one two three {} and more of the same old words of mine {}"]
    rows = []
    for i in range(40):
        lines = [rng.choice(shared).replace("Page 12", f"Page {rng.randint(1, 99)}").format(rng.choice("xyzabcdefgh"), rng.choice("uvw")) if rng.random() < 0.4 else f"only w{rng.random()}x words q{i} here r{rng.choice('abc')}" for _ in range(rng.randint(1, 7))]
        rows.append((i, rng.choice(["\n", "\n\n", "\r\n"]).join(lines)))
    rows += [(50, None), (51, ""), (52, "  \n "), (53, "Page 3 of 90 " * 8000), (54, "\n".join(f"line {chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600))), (55, "line aa\n\nline bc")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_lines string")
    got = drop_recurring_lines(df).select("doc_id", "text", "n_lines", "n_dropped").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute_lines(rows)
    assert sum(r.n_dropped for r in got) > 20
    every = drop_recurring_lines(df, keep_first=False).agg(F.sum("n_dropped")).first()[0]
    assert every > sum(r.n_dropped for r in got)
    assert drop_recurring_lines(df.limit(0)).count() == 0


def test_lines_of_repeated_and_null_ids(spark):
    rows = [(None, "same line"), (None, "same line"), (1, "same line"), (1, "same line"), (1, "other line"), (2, "own\nline here"), (2, "line here\nlast")]
    got = drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text, r.n_dropped) for r in got) == [(0, "", 1), (0, "", 1), (1, "other line", 0), (1, "same line", 0), (1, "same line", 0), (2, "line here\nlast", 0), (2, "own\nline here", 0)]


def test_fields_are_where_lines_differ(spark):
    """Lines of one template go though a word differs; unrelated lines that begin alike stay."""
    same = [f"user {n} has logged in to the main server of our site today" for n in ("anna", "bob", "carl", "dora")]
    same = [x.replace("user ", "the user ").replace(" has", " has now") for x in same]
    apart = ["the user who wrote this has never been heard of again", "the user who came later had nothing at all to add"]
    rows = list(enumerate([f"the one user {x[9:]}" for x in same] + apart))
    got = {r.doc_id: r.text for r in drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and [got[i] for i in (1, 2, 3)] == [""] * 3 and [got[i] for i in (4, 5)] == apart


def test_mixing(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(0, 400), rng.choice(["a", "a", "a", "a", "b", "c", "d", None]), 1.0) for i in range(400)]
    rows += [(900, None, "a", None), (901, "", "z", 1.0), (902, "q " * 30_000, "d", 1.0), (5, rows[5][1], rows[5][2], 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target double")
    got = mix_sources(df, seed=3).collect()
    assert len(got) == len(rows) and mix_sources(df, seed=3).exceptAll(mix_sources(df, seed=3)).count() == 0
    sizes, taken, target = {}, {}, {}
    for r in got:
        assert r.size == len((dict((x[0], x[1]) for x in rows)[r.doc_id] or "").split()) and r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(r.source_size == sizes[r.source] for r in got)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, open_, left = {}, set(order), float(sum(sizes.values()))
    while True:  # share out, stop those above, share the rest out again
        level = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if weight[s] * level > 3 * sizes[s]]
        if not above:
            break
        for s in above:
            want[s] = 3.0 * sizes[s]
            open_.remove(s)
            left -= want[s]
    want |= {s: weight[s] * level for s in open_}
    for s in order:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        largest = max(r.size for r in got if r.source == s)
        assert abs(taken[s] - target[s]) <= largest / 2 + 1
    # each copy of a source's document is as likely as its target says
    share = np.mean([sum(r.copies for r in mix_sources(df, seed=k).where("source = 'a'").collect()) for k in range(5)])
    n = sum(r.source == "a" for r in got)
    assert abs(share / n - target["a"] / sizes["a"]) < 0.15
    mixed = mixed_documents(df, seed=3)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in got)
    assert mix_sources(df.limit(0)).count() == 0 and mixed_documents(df.limit(0)).count() == 0
    weighed = mix_sources(df.withColumn("w", F.when(F.col("doc_id") % 2 == 0, 2.0).otherwise(0.5)), weight="w").where("source = 'a' and size > 0")
    by = {r.even: r.c for r in weighed.groupBy((F.col("doc_id") % 2 == 0).alias("even")).agg(F.avg("copies").alias("c")).collect()}
    assert by[True] > by[False]
