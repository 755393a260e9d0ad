"""Flat and hierarchical packing of texts behind dictionaries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .codebook import EMPTY, decode, dictionary_arrays, encode, meta_style, select_dictionary
from .mining import dealt, merge_candidates, mine_chars, mine_lines, mine_ngrams
from .paging import paginate
from .running import join_on


@dataclass(frozen=True)
class FlatOptions:
    min_freq: int = 3
    max_ngram: int = 10
    max_dict_size: int = 256
    use_line_patterns: bool = True
    use_char_ngrams: bool = False
    meta_style: str = "auto"
    #: Drop patterns that don't occur literally in the text, as n-grams across line ends don't.
    literal_only: bool = False


def candidates(corpus: DataFrame, keys: Sequence[str], options: FlatOptions) -> DataFrame:
    """All patterns worth an entry, merged, best first."""
    groups = [mine_ngrams(corpus, keys, max_len=options.max_ngram, min_freq=options.min_freq)]
    if options.use_line_patterns:
        groups.append(mine_lines(corpus, keys, min_freq=max(2, options.min_freq - 1)))
    if options.use_char_ngrams:
        groups.append(mine_chars(corpus, keys, min_freq=options.min_freq))
    found = merge_candidates(groups, keys)
    if options.literal_only:
        found = join_on(found, corpus.select(*keys, "text"), keys).where(F.contains("text", "pattern")).drop("text")
    return found


def build_dictionary(corpus: DataFrame, keys: Sequence[str], options: FlatOptions = FlatOptions()) -> DataFrame:
    """The entries ``(keys, ord, meta, pattern, cnt)`` of each scope of ``corpus(keys, text)``."""
    styles = dealt(corpus, keys).select(*keys, meta_style(F.col("text"), options.meta_style).alias("style"))
    return select_dictionary(candidates(corpus, keys, options), styles, keys, options.max_dict_size)


def dictionary_lines(dictionary: Column, indent: str = "  ") -> Column:
    return F.transform(dictionary, lambda e: F.concat(F.lit(indent), e["meta"], F.lit(" = "), T.one_line(e["pattern"])))


def system_dictionary(dictionary: Column) -> Column:
    """How a model is told of a dictionary (fixed wording)."""
    head = [
        "You are analyzing dictionary-encoded text. Meta-tokens expand via this dictionary.",
        "Treat each meta-token as exactly its expansion. Do not invent expansions.",
        "",
        "DICTIONARY:",
    ]
    return F.array_join(F.concat(F.array(*map(F.lit, head)), dictionary_lines(dictionary)), "\n")


def metrics(text: Column, encoded: Column, dictionary: Column, packed: Column) -> list[Column]:
    """Token figures of a packing."""
    plain = F.array_join(F.transform(dictionary, lambda e: F.concat(e["meta"], F.lit(" = "), e["pattern"])), "\n")
    original, total = T.token_estimate(text), T.token_estimate(packed)
    return [
        original.alias("original_tokens"), T.token_estimate(encoded).alias("compressed_tokens"),
        T.token_estimate(plain).alias("dictionary_tokens"), total.alias("packed_tokens"),
        T.ratio(total, original).alias("ratio"), T.factor(total, original).alias("compression_factor"),
        F.size(dictionary).cast("long").alias("dictionary_entries"),
    ]


def apply_dictionary(corpus: DataFrame, dictionaries: DataFrame, keys: Sequence[str], options: FlatOptions = FlatOptions()) -> DataFrame:
    """Encodes each text with its scope's array ``dictionary``; where decoding doesn't give it back it stays as it is."""
    met = join_on(corpus, dictionaries, keys, "left").withColumn("dictionary", F.coalesce("dictionary", F.array().cast(EMPTY)))
    met = met.withColumn("encoded", encode(F.col("text"), F.col("dictionary")))
    met = met.withColumn("exact", decode(F.col("encoded"), F.col("dictionary")) == F.col("text"))
    met = met.withColumn("dictionary", F.when(F.col("exact"), F.col("dictionary")).otherwise(F.array().cast(EMPTY)))
    met = met.withColumn("encoded", F.when(F.col("exact"), F.col("encoded")).otherwise(F.col("text"))).drop("exact")
    return met.withColumn("meta_style", meta_style(F.col("text"), options.meta_style))


def encode_texts(corpus: DataFrame, keys: Sequence[str], options: FlatOptions = FlatOptions()) -> DataFrame:
    """``(keys, text, dictionary, encoded, meta_style)``: every text of ``corpus(keys, text)`` behind a dictionary of its own.

    Keys are taken to be unique; null texts are left out.  The texts are shuffled once, by all keys
    together; mining, choice and encoding follow where they lie.
    """
    texts = corpus.where("text is not null").select(F.struct(*keys).alias("_scope"), "text")
    arrays = dictionary_arrays(build_dictionary(texts, ["_scope"], options), ["_scope"])
    return apply_dictionary(dealt(texts, ["_scope"]), arrays, ["_scope"], options).select("_scope.*", "text", "dictionary", "encoded", "meta_style")


def flat_pack(corpus: DataFrame, keys: Sequence[str], options: FlatOptions = FlatOptions()) -> DataFrame:
    """Packs every text of ``corpus(keys, text)`` behind a dictionary of its own, losslessly.

    Adds ``dictionary`` (ordered entries), ``encoded``, ``meta_style``, ``system_dictionary``,
    ``packed_prompt`` and the token figures.  Keys are taken to be unique; null texts are left out.
    """
    packed = encode_texts(corpus, keys, options)
    packed = packed.withColumn("system_dictionary", system_dictionary(F.col("dictionary")))
    packed = packed.withColumn("packed_prompt", F.concat("system_dictionary", F.lit("\n\nENCODED_BODY:\n"), "encoded"))
    return packed.select("*", *metrics(*map(F.col, ("text", "encoded", "dictionary", "packed_prompt"))))


@dataclass(frozen=True)
class HierarchicalOptions:
    page_size: int = 4000
    min_freq: int = 2
    max_local_dict: int = 64
    max_global_dict: int = 128


def encode_pages(corpus: DataFrame, keys: Sequence[str], options: HierarchicalOptions = HierarchicalOptions()) -> DataFrame:
    """The pages of each text, each behind its own dictionary: keys, ``page_id``, ``encoded``, ``local_dictionary``, ``original_chars``, ``fingerprint``."""
    pages = paginate(corpus, keys, options.page_size)
    local = FlatOptions(min_freq=options.min_freq, max_dict_size=options.max_local_dict)
    within = [*keys, "page_id"]
    encoded = encode_texts(pages, within, local)
    return encoded.select(
        *within, "encoded", F.col("dictionary").alias("local_dictionary"), T.length(F.col("text")).alias("original_chars"),
        T.hierarchical_fingerprint(F.col("text")).alias("fingerprint"),
    )


def in_order(order: Column, value: Column) -> Column:
    """Aggregate: the values of a group as an array, by ``order``."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])


def hierarchical_pack(corpus: DataFrame, keys: Sequence[str], options: HierarchicalOptions = HierarchicalOptions(), pages: DataFrame | None = None) -> DataFrame:
    """Packs each text in two levels: a dictionary for each page, then one over all encoded pages.

    One row a text: ``global_dictionary``, ``encoded_corpus``, ``page_index``, ``packed_prompt`` and
    token figures.  ``pages`` are those of :func:`encode_pages`, if they are at hand.
    """
    keys = list(keys)
    pages = encode_pages(corpus, keys, options) if pages is None else pages
    header = F.concat(F.lit("<<<PAGE "), F.col("page_id").cast("string"), F.lit(">>>\n"), F.col("encoded"))
    row = F.concat(
        F.lit('{"page_id": '), F.col("page_id").cast("string"), F.lit(', "fingerprint": '), T.json_text(F.col("fingerprint")),
        F.lit(', "original_chars": '), F.col("original_chars").cast("string"), F.lit(', "local_dict_size": '), F.size("local_dictionary").cast("string"), F.lit("}"),
    )
    own = F.concat(F.array(F.concat(F.lit("PAGE_"), F.col("page_id").cast("string"), F.lit("_DICT:"))), dictionary_lines(F.col("local_dictionary")))
    own = F.when(F.size("local_dictionary") > 0, own).otherwise(F.array().cast("array<string>"))
    at = F.col("page_id")
    level = pages.groupBy(*keys).agg(
        F.array_join(in_order(at, header), "\n\n").alias("text"), F.concat(F.lit("["), F.array_join(in_order(at, row), ", "), F.lit("]")).alias("page_index"),
        F.flatten(in_order(at, own)).alias("page_dicts"), F.count(F.lit(1)).alias("n_pages"),
        F.sum(F.size("local_dictionary")).alias("local_dict_total"), F.sum("original_chars").alias("original_chars"),
    )
    top = FlatOptions(min_freq=max(2, options.min_freq), max_dict_size=options.max_global_dict, use_char_ngrams=True)
    arrays = dictionary_arrays(build_dictionary(level.select(*keys, "text"), keys, top), keys)
    met = apply_dictionary(level, arrays, keys, top)
    parts = [  # headings and wording of the prompt (fixed values)
        F.array(F.lit("HIERARCHICAL PAGEINDEX DICTIONARY-ENCODED CORPUS"), F.lit("Decode order: expand GLOBAL_DICT, then each PAGE_n_DICT on that page body."), F.lit(""), F.lit("GLOBAL_DICT:")),
        dictionary_lines(F.col("dictionary")), F.array(F.lit(""), F.lit("PAGE_INDEX:"), F.col("page_index"), F.lit("")),
        F.col("page_dicts"), F.array(F.lit(""), F.lit("ENCODED_CORPUS:"), F.col("encoded")),
    ]
    met = met.withColumn("packed_prompt", F.array_join(F.concat(*parts), "\n"))
    original, packed = F.floor((F.col("original_chars") + 3) / 4), T.token_estimate(F.col("packed_prompt"))
    return met.select(
        *keys, F.col("dictionary").alias("global_dictionary"), F.col("encoded").alias("encoded_corpus"), "page_index", "packed_prompt",
        "original_chars", original.alias("original_tokens_est"), packed.alias("packed_tokens_est"), T.factor(packed, original).alias("compression_factor"),
        T.ratio(packed, original).alias("ratio"), "n_pages", F.lit(options.page_size).alias("page_size"),
        F.size("dictionary").cast("long").alias("global_dict_size"), F.col("local_dict_total").cast("long").alias("local_dict_total"),
    )


def hierarchical_unpack(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, text)``: the texts again, from the pages and their own dictionaries alone."""
    body = decode(F.col("encoded"), F.col("local_dictionary"))
    return pages.groupBy(*keys).agg(F.array_join(in_order(F.col("page_id"), body), "").alias("text"))


__all__ = [
    "FlatOptions", "HierarchicalOptions", "apply_dictionary", "build_dictionary", "candidates", "encode_pages", "encode_texts",
    "flat_pack", "hierarchical_pack", "hierarchical_unpack",
]
