"""Compacting message histories into a token budget, many conversations at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.session import cut
from .codebook import EMPTY, decode
from .packing import FlatOptions, flat_pack, in_order
from .running import join_on

MODES = ("auto", "lossless_dict", "lossy_stub")


@dataclass(frozen=True)
class CompactOptions:
    budget: int = 8000
    mode: str = "auto"
    keep_system: bool = True
    keep_last_n: int = 4
    min_freq: int = 2
    max_dict_size: int = 128


@dataclass(frozen=True)
class Compacted:
    """``messages(keys, ord, role, content)``, ``cold_refs(keys, ref_id, role, kind, original_tokens_est, preview, payload)`` and a row a conversation in ``summary``."""

    messages: DataFrame
    cold_refs: DataFrame
    summary: DataFrame


def flatten_blocks(blocks: Column) -> Column:
    """The text of a list of content blocks ``(type, text)``, one a line; blocks that aren't text are written as JSON."""
    return F.array_join(F.transform(blocks, lambda b: F.when(b["type"] == "text", F.coalesce(b["text"], F.lit(""))).otherwise(F.to_json(b))), "\n")


def normalise(messages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, turn, role, content)``: a missing role is ``user``, missing content empty."""
    return messages.select(*keys, "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("content", F.lit("")).alias("content"))


def merge_turns(messages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs of turns of one role as one turn, white space at the seams replaced by a blank line; ``turn`` is the run's first."""
    order = Window.partitionBy(*keys).orderBy("turn")
    change = F.coalesce((F.lag("role").over(order) != F.col("role")).cast("int"), F.lit(1))
    runs = messages.withColumn("_new", change).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = runs.groupBy(*keys, "_run", "role").agg(F.min("turn").alias("turn"), in_order(F.col("turn"), F.col("content")).alias("_all"))
    joined = F.aggregate(F.slice("_all", F.lit(2), F.size("_all")), F.get("_all", F.lit(0)), lambda acc, x: F.concat(T.rstrip(acc), F.lit("\n\n"), T.lstrip(x)))
    return grouped.select(*keys, "turn", "role", joined.alias("content"))


def message_text() -> Column:
    return F.concat(F.lit("<<<"), F.upper("role"), F.lit(">>>\n"), F.col("content"))


def pack_messages(messages: DataFrame, keys: Sequence[str], order: str = "turn") -> DataFrame:
    """``(keys, packed, n)``: the messages of each conversation as one text."""
    return messages.groupBy(*keys).agg(F.array_join(in_order(F.col(order), message_text()), "\n\n").alias("packed"), F.count(F.lit(1)).alias("n"))


def split_turns(merged: DataFrame, keys: Sequence[str], keep_system: bool, keep_last_n: int) -> DataFrame:
    """``merged`` with ``part``: 0 for system turns (kept in front), 2 for the last ``keep_last_n`` others (kept), 1 for those between."""
    system = (F.col("role") == "system") if keep_system else F.lit(False)
    back = F.row_number().over(Window.partitionBy(*keys, "_system").orderBy(F.desc("turn")))
    marked = merged.withColumn("_system", system).withColumn("_back", back)
    part = F.when(F.col("_system"), 0).when(F.col("_back") <= keep_last_n, 2).otherwise(1)
    return marked.withColumn("part", part).drop("_system", "_back")


def compact_messages(messages: DataFrame, keys: Sequence[str], options: CompactOptions = CompactOptions()) -> Compacted:
    """Shrinks each conversation of ``messages(keys, turn, role, content)`` towards ``budget`` tokens.

    System turns and the last turns stay.  A bulky repetitive turn between them becomes
    a dictionary-encoded one where that saves 8 % or more, or a one-line stub; then the
    oldest turns between become stubs until the budget is met.  What was replaced is in
    ``cold_refs``, numbered in that order.  How many turns have to go is read off a
    running sum of the change in length that each stub brings.
    """
    if options.mode not in MODES:
        raise ValueError(f"unknown mode {options.mode!r}")
    keys = list(keys)
    plain = normalise(messages, keys)
    turns = split_turns(merge_turns(plain, keys), keys, options.keep_system, options.keep_last_n)
    tokens = T.token_estimate(F.col("content"))
    turns = turns.withColumn("tok", tokens).withColumn("bulky", (F.col("part") == 1) & (tokens >= 120) & T.looks_repetitive(F.col("content")))

    bulky = turns.where("bulky").select(*keys, "turn", F.col("content").alias("text"))
    if options.mode == "lossy_stub":
        encoded = bulky.select(*keys, "turn", F.lit(None).cast(EMPTY).alias("dictionary"), F.lit(None).cast("string").alias("encoded"), F.lit(None).cast("string").alias("packed_prompt"), F.lit(None).cast("long").alias("packed_tokens"))
    else:
        encoded = flat_pack(bulky, [*keys, "turn"], FlatOptions(min_freq=options.min_freq, max_dict_size=options.max_dict_size))
        encoded = encoded.select(*keys, "turn", "dictionary", "encoded", "packed_prompt", "packed_tokens")
    turns = join_on(turns, encoded, [*keys, "turn"], "left")
    saves = F.coalesce((F.size("dictionary") > 0) & (F.col("packed_tokens") < F.col("tok") * 0.92), F.lit(False))
    action = F.when(F.col("bulky") & saves, "dict_encoded").when(F.col("bulky") & F.lit(options.mode != "lossless_dict"), "summary_stub")
    turns = turns.withColumn("action", action)
    so_far = Window.partitionBy(*keys).orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.withColumn("ref", F.when(F.col("action").isNotNull(), F.concat(F.lit("c"), (F.count("action").over(so_far) - 1).cast("string"))))
    shown = F.when(
        F.col("action") == "dict_encoded",
        F.concat(F.lit("[cold_ref:"), "ref", F.lit(" dict-encoded ~"), F.col("packed_tokens").cast("string"), F.lit(" tok; full lossless body in cold_refs]\n"), "packed_prompt"),
    ).when(F.col("action") == "summary_stub", F.concat(F.lit("[cold_ref:"), "ref", F.lit("] "), T.lossy_stub(F.col("content")))).otherwise(F.col("content"))
    turns = turns.withColumn("shown", shown)

    everything = Window.partitionBy(*keys)
    middle = Window.partitionBy(*keys, "part").orderBy("turn")
    turns = turns.withColumn("refs", F.count("action").over(everything)).withColumn("nth", F.row_number().over(middle) - 1)
    turns = turns.withColumn("late_ref", F.concat(F.lit("c"), (F.col("refs") + F.col("nth")).cast("string")))
    turns = turns.withColumn("stub", F.when(F.col("part") == 1, F.concat(F.lit("[cold_ref:"), "late_ref", F.lit("] "), T.lossy_stub(F.col("shown")))))
    # the text in all: headers of role and brackets, contents, and two line feeds between turns
    size = F.sum(F.length("role") + 7 + F.length("shown") + 2).over(everything) - 2
    before = F.coalesce(F.sum(F.length("stub") - F.length("shown")).over(middle.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.withColumn("over", F.floor((size + before + 3) / 4) > options.budget)
    # a turn goes if the text was over budget before each of those that go first, and before its own
    still = F.min(F.col("over").cast("int")).over(middle.rowsBetween(Window.unboundedPreceding, 0)) == 1
    turns = turns.withColumn("evicted", (F.col("part") == 1) & still)
    # messages, references and summary are all read off this table, which holds what was there before only where it was replaced
    dictionary = [F.when(F.col("action") == "dict_encoded", F.col(c)).alias(c) for c in ("encoded", "dictionary", "packed_prompt")]
    turns = turns.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy("part", "turn")) - 1)
    turns = cut(turns.select(
        *keys, "turn", "ord", "role", "action", "ref", "late_ref", "evicted", "tok", "shown", *dictionary,
        F.when(F.col("evicted"), F.col("stub")).alias("stub"), F.when(F.col("action").isNotNull(), F.col("content")).alias("content"),
    ))

    out = turns.select(*keys, "ord", "role", F.when(F.col("evicted"), F.col("stub")).otherwise(F.col("shown")).alias("content"))
    payload = "struct<encoded:string,dictionary:array<struct<ord:int,meta:string,pattern:string>>,packed_prompt:string,original:string>"

    def held(*fields: Column) -> Column:
        return F.struct(*[f.alias(n) for f, n in zip(fields, ("encoded", "dictionary", "packed_prompt", "original"))]).cast(payload)

    none, of_dict = F.lit(None), F.col("action") == "dict_encoded"
    first = turns.where("action is not null").select(
        *keys, F.col("ref").alias("ref_id"), "role", F.col("action").alias("kind"), F.col("tok").alias("original_tokens_est"),
        F.replace(F.left("content", F.lit(160)), F.lit("\n"), F.lit(" ")).alias("preview"),
        F.when(of_dict, held(F.col("encoded"), F.col("dictionary"), F.col("packed_prompt"), none)).otherwise(held(none, none, none, F.col("content"))).alias("payload"),
    )
    second = turns.where("evicted").select(
        *keys, F.col("late_ref").alias("ref_id"), "role", F.lit("summary_stub").alias("kind"), T.token_estimate(F.col("shown")).alias("original_tokens_est"),
        F.left("shown", F.lit(120)).alias("preview"), held(none, none, none, F.col("shown")).alias("payload"),
    )

    original = pack_messages(plain, keys).select(*keys, T.token_estimate(F.col("packed")).alias("original_tokens_est"), F.col("n").alias("n_input_messages"))
    named = F.when(F.max_by("action", F.when(F.col("action").isNotNull(), F.col("turn"))) == "dict_encoded", "lossless_dict").when(F.max("action").isNotNull(), "lossy_stub").otherwise("auto")
    counts = turns.groupBy(*keys).agg(
        named.alias("mode"), F.count(F.lit(1)).alias("n_output_messages"), (F.count("action") + F.count_if("evicted")).alias("n_cold_refs")
    )
    if options.mode != "auto":
        counts = counts.withColumn("mode", F.lit(options.mode))
    packed = pack_messages(out, keys, "ord").select(*keys, F.col("packed").alias("packed_prompt"))
    summary = join_on(join_on(packed, original, keys), counts, keys).withColumn("compacted_tokens_est", T.token_estimate(F.col("packed_prompt")))
    summary = summary.withColumn("fits_budget", F.col("compacted_tokens_est") <= options.budget)
    summary = summary.withColumn("compression_factor", F.round(T.factor(F.col("compacted_tokens_est"), F.col("original_tokens_est")), 4))
    return Compacted(out, first.unionByName(second), summary)


def expand_cold_ref(kind: Column, payload: Column, preview: Column) -> Column:
    """The text that a cold reference stands for; the preview if nothing else is held."""
    body = decode(payload["encoded"], F.coalesce(payload["dictionary"], F.array().cast(EMPTY)))
    return F.when(kind == "dict_encoded", body).otherwise(F.coalesce(payload["original"], preview))


def expand_messages(compacted: Compacted, keys: Sequence[str]) -> DataFrame:
    """``(keys, ord, role, content)``: the messages with what their cold references stand for, one level deep."""
    refs = compacted.cold_refs.select(*keys, F.col("ref_id").alias("_ref"), expand_cold_ref(F.col("kind"), F.col("payload"), F.col("preview")).alias("_text"))
    rows = compacted.messages.withColumn("_ref", F.nullif(F.regexp_extract("content", r"\[cold_ref:(c\d+)", 1), F.lit("")))
    met = join_on(rows, refs, [*keys, "_ref"], "left")
    return met.select(*keys, "ord", "role", F.coalesce("_text", "content").alias("content"))


def expand_recursive(compacted: Compacted, keys: Sequence[str], depth: int = 3) -> DataFrame:
    """As :func:`expand_messages`, again for references inside of what was expanded."""
    messages = compacted.messages
    for _ in range(depth):
        messages = expand_messages(Compacted(messages, compacted.cold_refs, compacted.summary), keys)
    return messages
