"""Comparing ways of fitting conversations into a budget by what they keep of known phrases."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.session import cut
from .codebook import decode
from .compaction import CompactOptions, compact_messages, expand_messages, pack_messages
from .packing import FlatOptions, flat_pack, in_order
from .running import join_on

KINDS = ("goal", "constraint", "outcome")
CONDITIONS = ("raw", "compress", "compact", "lossy_truncate", "protect_compact")


#: Characters that a phrase of few words is looked up by, at most.
HEAD = 8
#: Phrases of a trace that go to its texts as a list.
LISTED = 1000


def phrase_coverage(texts: DataFrame, gold: DataFrame, keys: Sequence[str], on: Sequence[str] = ()) -> DataFrame:
    """How many of the phrases ``gold(type, phrase)`` each text has, both folded: ``(keys, type, hit, total, recall)``.

    With ``on`` a text is held only against the phrases that agree in these keys.  A phrase
    of four words or more that stands in a text brings the words between its first and its last there as whole
    words, in pairs.  The pairs that phrases have are counted over all texts, and a phrase meets
    texts by the hash of the pair that fewest of them have; one with a pair that no text has meets none.
    A shorter phrase meets by its first characters.  What meets is then looked
    up in the text.  A group is a pair and the texts that have it, and no phrase has a pair that is rarer than its own.

    Equal phrases of a type count as often as they are given.  An empty phrase is in every
    text, a null one in none; null texts have no row, nor has a text without phrases.
    """
    on = list(on)
    folded = texts.where(F.col("text").isNotNull()).select(*keys, T.folded(F.col("text")).alias("_t"))
    phrases = gold.select(*on, "type", T.folded(F.col("phrase")).alias("_p"))
    totals = phrases.groupBy(*on, "type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("_p") == "").alias("empty"))
    each = phrases.where("_p <> ''").groupBy(*on, "type", "_p").agg(F.count(F.lit(1)).alias("times")).withColumn("_w", F.split("_p", " "))
    inner = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1))))
    short = each.where(F.size("_w") < 4).withColumn("_c", F.least(F.length("_p"), F.lit(HEAD))).withColumn("_k", F.xxhash64(F.left("_p", F.col("_c"))))
    long = cut(each.where(F.size("_w") >= 4).select(*on, "type", "_p", "times", inner(F.col("_w")).alias("_ks")))
    keyed = long.select("*", F.explode("_ks").alias("_k"))

    words = folded.select(*keys, F.split("_t", " ").alias("_w")).where(F.size("_w") >= 4)
    pairs = words.select(*keys, F.explode(F.element_at(F.transform(F.array("_w"), inner), 1)).alias("_k"))
    # of the pairs of the texts those that a phrase has, once a text
    met = cut(join_on(pairs, keyed.select(*on, "_k").distinct(), [*on, "_k"]))
    often = met.groupBy(*on, "_k").agg(F.count(F.lit(1)).alias("_n"))
    rare = join_on(keyed, often, [*on, "_k"]).groupBy(*on, "type", "_p", "times").agg(F.min(F.struct("_n", "_k"))["_k"].alias("_k"), (F.count(F.lit(1)) == F.size(F.first("_ks"))).alias("_all"))
    # the lengths that short phrases have, HEAD at most; without any, no text is cut
    sizes = F.broadcast(short.select("_c").distinct())
    starts = folded.select(*keys, "_t", F.explode(F.sequence(F.lit(1), F.lit(HEAD))).alias("_c")).join(sizes, "_c").where(F.length("_t") >= F.col("_c"))
    block = F.explode(F.sequence(F.lit(0), F.length("_t") - F.col("_c"), F.lit(1024))).alias("_b")
    blocks = starts.select(*keys, "_c", F.length("_t").alias("_n"), "_t", block).select(*keys, "_c", (F.col("_n") - F.col("_b")).alias("_n"), F.substring("_t", F.col("_b") + 1, F.lit(1024 + HEAD)).alias("_t"))
    snip = lambda x: F.transform(F.sequence(F.lit(1), F.least(x["n"] - x["c"] + 1, F.lit(1024))), lambda i: F.xxhash64(F.substring(x["t"], i, x["c"])))
    heads = F.element_at(F.transform(F.array(F.struct(F.col("_t").alias("t"), F.col("_n").alias("n"), F.col("_c").alias("c"))), snip), 1)
    heads = blocks.select(*keys, "_c", F.explode(F.array_distinct(heads)).alias("_k")).distinct()

    columns = [*dict.fromkeys([*keys, "type", "_p", "times"])]
    near = join_on(met, rare.where("_all"), [*on, "_k"]).select(*columns).union(join_on(heads, short, [*on, "_c", "_k"]).select(*columns)).distinct()
    hits = join_on(near, folded, keys).where(F.contains("_t", "_p")).groupBy(*keys, "type").agg(F.sum("times").alias("hit"))
    if on:
        every = join_on(folded.select(*keys), totals, on)
    else:  # a row a type: its name and two numbers
        types = [F.struct(F.lit(r.type).cast(gold.schema["type"].dataType).alias("type"), F.lit(r.total).alias("total"), F.lit(r.empty).alias("empty")) for r in totals.collect()]
        every = folded.select(*keys, F.inline(F.array(*types))) if types else folded.select(*keys).join(totals, F.lit(False))
    hit = F.col("empty") + F.coalesce("hit", F.lit(0))
    return join_on(every, hits, [*keys, "type"], "left").select(*keys, "type", hit.alias("hit"), "total", F.round(hit / F.col("total"), 4).alias("recall"))


def micro_recall(coverage: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, hits, total, micro_recall)`` over all types; 1 if there are no phrases."""
    sums = coverage.groupBy(*keys).agg(F.sum("hit").alias("hits"), F.sum("total").alias("total"))
    return sums.withColumn("micro_recall", F.when(F.col("total") > 0, F.round(F.col("hits") / F.col("total"), 4)).otherwise(1.0))


def label_matches(labels: DataFrame, gold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision and recall of ``labels(keys, type, label)`` against ``gold(keys, type, ord, phrase)``.

    A label hits the first phrase, by ``ord``, that it contains, that contains it, or of which it has the
    first 20 of more than 12 characters.  Returns keys, ``type``, ``tp`` (phrases hit), ``fp``, ``fn``, ``precision``, ``recall``.
    """
    on = [*keys, "type"]
    p = labels.select(*on, F.monotonically_increasing_id().alias("_i"), T.folded(F.col("label")).alias("_l"))
    g = gold.select(*on, "ord", T.folded(F.col("phrase")).alias("_g"))
    near = F.contains("_l", "_g") | F.contains("_g", "_l") | ((F.length("_g") > 12) & F.contains("_l", F.left("_g", F.lit(20))))
    first = p.join(g, on).where(near).groupBy(*on, "_i").agg(F.min("ord").alias("ord"))
    hit = first.groupBy(*on).agg(F.countDistinct("ord").alias("tp"), F.count(F.lit(1)).alias("good"))
    sizes = p.groupBy(*on).agg(F.count(F.lit(1)).alias("said")).join(g.groupBy(*on).agg(F.count(F.lit(1)).alias("gold")), on, "full").join(hit, on, "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("said", "gold", "tp", "good")]
    out = sizes.select(*on, *zero).withColumn("fp", F.col("said") - F.col("good")).withColumn("fn", F.col("gold") - F.col("tp"))
    share = lambda rest: F.when(F.col("tp") + F.col(rest) > 0, F.round(F.col("tp") / (F.col("tp") + F.col(rest)), 4)).otherwise(1.0)
    return out.select(*on, "tp", "fp", "fn", share("fp").alias("precision"), share("fn").alias("recall"))


def micro_precision_recall(matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, tp, fp, fn, micro_precision, micro_recall)`` over all types of :func:`label_matches`; 1 where there is nothing to divide by."""
    sums = matches.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    share = lambda rest: F.when(F.col("tp") + F.col(rest) > 0, F.round(F.col("tp") / (F.col("tp") + F.col(rest)), 4)).otherwise(1.0)
    return sums.withColumn("micro_precision", share("fp")).withColumn("micro_recall", share("fn"))


def proxy_precision_recall(coverage: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What stands in where there are no labels: the recall of phrases (:func:`phrase_coverage`), as precision too."""
    return micro_recall(coverage, keys).select(*keys, F.col("micro_recall").alias("micro_precision"), "micro_recall")


def typology_jaccard(a: Column, b: Column) -> Column:
    """Mean over the typologies of how alike the cue phrases of two texts are."""
    each = [F.round(T.jaccard(T.cues(a, k), T.cues(b, k)), 4) for k in KINDS]
    return F.round(reduce(lambda x, y: x + y, each) / len(each), 4)


def protect_sentences(texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, keep_blob, rest_blob, n_keep, n_rest)``: sentences of high value or of system and user turns, and the others."""
    parts = texts.select(*keys, T.sentences(F.col("text")).alias("_s"))
    worth = lambda s: s.rlike(T.HIGH_VALUE) | F.startswith(s, F.lit("<<<SYSTEM")) | F.startswith(s, F.lit("<<<USER"))
    parts = parts.select(*keys, F.filter("_s", worth).alias("keep"), F.filter("_s", lambda s: ~worth(s)).alias("rest"))
    return parts.select(*keys, F.array_join("keep", "\n").alias("keep_blob"), F.array_join("rest", "\n").alias("rest_blob"), F.size("keep").alias("n_keep"), F.size("rest").alias("n_rest"))


def run_conditions(traces: DataFrame, keys: Sequence[str], budget: int = 1200, keep_last_n: int = 3) -> DataFrame:
    """Every condition for every trace of ``traces(keys, turn, role, content)``.

    Returns keys, ``condition``, ``visible_text``, ``restored_text``, ``tokens_before``,
    ``tokens_after`` and ``lossless_exact``.  Truncation and protection get the size that compaction reached.
    """
    keys = list(keys)
    packed = pack_messages(traces, keys).select(*keys, F.col("packed").alias("text"))
    before = T.token_estimate(F.col("text"))

    def row(df: DataFrame, name: str, visible: Column, restored: Column, after: Column, exact: Column) -> DataFrame:
        return df.select(*keys, F.lit(name).alias("condition"), visible.alias("visible_text"), restored.alias("restored_text"), before.alias("tokens_before"), after.alias("tokens_after"), exact.alias("lossless_exact"))

    text = F.col("text")
    raw = row(packed, "raw", text, text, before, F.lit(True))
    flat = flat_pack(packed, keys, FlatOptions(min_freq=2, max_dict_size=128))
    flat = flat.withColumn("_back", decode(F.col("encoded"), F.col("dictionary")))
    compress = row(flat, "compress", F.col("packed_prompt"), F.col("_back"), T.token_estimate(F.col("packed_prompt")), F.col("_back") == text)

    done = compact_messages(traces, keys, CompactOptions(budget=budget, mode="lossless_dict", keep_last_n=keep_last_n))
    whole = expand_messages(done, keys).groupBy(*keys).agg(F.array_join(in_order(F.col("ord"), F.col("content")), "\n\n").alias("restored"))
    sizes = done.summary.select(*keys, F.col("packed_prompt").alias("visible"), "compacted_tokens_est")
    met = packed.join(sizes, keys).join(whole, keys)
    compact = row(met, "compact", F.col("visible"), F.col("restored"), F.col("compacted_tokens_est"), F.col("restored") == text)
    # the sizes alone are kept; texts are put together again
    allowed = cut(done.summary.select(*keys, F.greatest(F.lit(200), F.col("compacted_tokens_est")).cast("long").alias("allowed")))
    allowed = packed.join(allowed, keys)

    scope = Window.partitionBy(*keys)
    ends = traces.withColumn("_i", F.row_number().over(scope.orderBy("turn"))).withColumn("_n", F.count(F.lit(1)).over(scope))
    ends = ends.where("_n <= 4 or _i <= 2 or _i > _n - 2")
    short = pack_messages(ends, keys).select(*keys, F.col("packed").alias("_short"))
    ends = allowed.join(short, keys).withColumn("_cut", T.head_tail(F.col("_short"), F.col("allowed")))
    truncate = row(ends, "lossy_truncate", F.col("_cut"), F.col("_cut"), T.token_estimate(F.col("_cut")), F.col("_cut") == text)

    parts = protect_sentences(packed, keys)
    filler = flat_pack(parts.where(T.strip(F.col("rest_blob")) != "").select(*keys, F.col("rest_blob").alias("text")), keys, FlatOptions(min_freq=2, max_dict_size=128))
    filler = filler.select(*keys, "dictionary", decode(F.col("encoded"), F.col("dictionary")).alias("_rest"), F.col("packed_prompt").alias("_filler"), "packed_tokens")
    kept = allowed.join(parts, keys).join(filler, keys, "left")
    coded = F.coalesce(F.size("dictionary") > 0, F.lit(False))
    plain = F.concat("keep_blob", F.when(F.col("rest_blob") != "", F.concat(F.lit("\n"), "rest_blob")).otherwise(""))
    seen = F.when(coded, F.concat("keep_blob", F.lit("\n\n<<<COMPACTED_FILLER dict-encoded>>>\n"), "_filler")).otherwise(plain)
    back = F.when(coded, F.concat("keep_blob", F.lit("\n"), "_rest")).otherwise(plain)
    kept = kept.withColumn("_seen", seen).withColumn("_back", back)
    over = (T.token_estimate(F.col("_seen")) > F.col("allowed")) & F.col("_filler").isNotNull()
    omitted = F.concat("keep_blob", F.lit("\n\n[filler dict cold ~"), F.col("packed_tokens").cast("string"), F.lit(" tok omitted from hot set]"))
    kept = kept.withColumn("_exact", ~over & (~coded | (F.col("_rest") == F.col("rest_blob")))).withColumn("_seen", F.when(over, omitted).otherwise(F.col("_seen")))
    protect = row(kept, "protect_compact", F.col("_seen"), F.col("_back"), T.token_estimate(F.col("_seen")), F.col("_exact"))
    return reduce(DataFrame.unionByName, (raw, compress, compact, truncate, protect))


def score_conditions(conditions: DataFrame, gold: DataFrame, traces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row a trace and condition with ``token_ratio``, phrase recalls (visible, restored, constraints only) and ``mean_typology_jaccard``.

    A trace's phrases go to its texts as one list, and the texts become figures there. Traces with more than :data:`LISTED` phrases
    are kept and go through :func:`phrase_coverage`.
    """
    keys = list(keys)
    on = [*keys, "condition"]
    folded = gold.select(*keys, "type", T.folded(F.col("phrase")).alias("_p"))
    constraint = F.col("type") == "constraint"
    counted = folded.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_if(constraint).alias("_nc"))
    many = cut(counted.where(F.col("_n") > LISTED).select(*keys))
    few = join_on(folded, many.withColumn("_many", F.lit(True)), keys, "left").where("_many is null")
    lists = few.groupBy(*keys).agg(F.collect_list("_p").alias("_ps"), F.collect_list(F.when(constraint, F.col("_p"))).alias("_pc"))

    packed = pack_messages(traces, keys).select(*keys, *[T.cues(F.col("packed"), k).alias(f"_cues_{k}") for k in KINDS])
    known = join_on(join_on(packed, counted, keys, "left"), lists, keys, "left")
    structure = F.when(F.col("condition") == "compress", F.col("restored_text")).otherwise(F.col("visible_text"))

    def recall(column: str, phrases: str, total: str) -> Column:
        """Of the phrases in a list; null where phrases aren't listed."""
        hits = F.element_at(F.transform(F.array(T.folded(F.col(column))), lambda t: F.size(F.filter(phrases, lambda p: F.contains(t, p)))), 1)
        return F.when(F.col(column).isNotNull() & F.col(phrases).isNotNull() & (F.col(total) > 0), F.round(hits / F.col(total), 4))

    alike = [F.round(T.jaccard(F.col(f"_cues_{k}"), T.cues(structure, k)), 4) for k in KINDS]
    rows = conditions.join(known, keys).select(
        *on, "tokens_before", "tokens_after", F.round(T.factor(F.col("tokens_after"), F.col("tokens_before")), 4).alias("token_ratio"), "lossless_exact",
        F.round(reduce(lambda x, y: x + y, alike) / len(alike), 4).alias("mean_typology_jaccard"),
        recall("visible_text", "_ps", "_n").alias("gold_phrase_recall_visible"), recall("restored_text", "_ps", "_n").alias("gold_phrase_recall_restored"),
        recall("visible_text", "_pc", "_nc").alias("mid_constraint_recall_visible"),
    )
    if not many.isEmpty():
        marked, theirs = (join_on(x, many.withColumn("_many", F.lit(True)), keys) for x in (conditions, gold))
        marked = cut(marked.drop("_many"))
        for column, name, phrases in (
            ("visible_text", "gold_phrase_recall_visible", theirs), ("restored_text", "gold_phrase_recall_restored", theirs),
            ("visible_text", "mid_constraint_recall_visible", theirs.where(constraint)),
        ):
            cover = phrase_coverage(marked.select(*on, F.col(column).alias("text")), phrases.drop("_many"), on, keys)
            rows = join_on(rows, micro_recall(cover, on).select(*on, F.col("micro_recall").alias("_far")), on, "left")
            rows = rows.withColumn(name, F.coalesce(name, "_far")).drop("_far")
    return rows.fillna(1.0, [c for c in rows.columns if "recall" in c])


def summarise(scored: DataFrame) -> DataFrame:
    """Means by condition, to four digits."""
    mean = lambda c, n: F.round(F.avg(c), 4).alias(n)
    return scored.groupBy("condition").agg(
        F.count(F.lit(1)).alias("n"), mean("tokens_before", "avg_tokens_before"), mean("tokens_after", "avg_tokens_after"),
        mean("token_ratio", "avg_token_ratio"), mean(F.col("lossless_exact").cast("double"), "lossless_exact_rate"),
        mean("gold_phrase_recall_visible", "avg_gold_phrase_recall_visible"), mean("gold_phrase_recall_restored", "avg_gold_phrase_recall_restored"),
        mean("mid_constraint_recall_visible", "avg_mid_constraint_recall_visible"), mean("mean_typology_jaccard", "avg_typology_jaccard"),
    )


def layer_path_match(found: Column, expected: Column) -> Column:
    """The share of the distinct layers of an expected path that are among those found, to four digits, in whatever order; both are lists of names.

    Without an expected path 1 if nothing was found either, else 0; a null list is an empty one.
    """
    none = F.array().cast("array<string>")
    there, wanted = F.coalesce(found, none), F.array_distinct(F.coalesce(expected, none))
    share = F.round(F.size(F.array_intersect(wanted, there)) / F.size(wanted), 4)
    return F.when(F.size(wanted) > 0, share).when(F.size(there) == 0, 1.0).otherwise(0.0)


#: How far apart two recalls are for one to count as better; what counts as exact, and as alike.
MARGIN, EXACT, ALIKE = 0.05, 0.99, 0.9


def verdicts(summary: DataFrame) -> list[str]:
    """What the means of :func:`summarise` say, a row a condition, in a few sentences."""
    by = {r.condition: r.asDict() for r in summary.collect()}  # five conditions

    def of(condition: str, name: str) -> float:
        return by.get(condition, {}).get(name) or 0.0

    gap = of("compact", "avg_mid_constraint_recall_visible") - of("lossy_truncate", "avg_mid_constraint_recall_visible")
    said = ["Constraints: compaction keeps more of them in sight than truncation to the same size." if gap > MARGIN else
            "Constraints: truncation keeps more of them in sight than compaction; look at which turns were evicted." if gap < -MARGIN else
            "Constraints: compaction and truncation keep about as many in sight."]
    exact = of("compress", "lossless_exact_rate") >= EXACT
    said.append("Round trip: compression gives every text back." if exact else "Round trip: compression doesn't give every text back; look at the patterns mined.")
    if of("compress", "avg_typology_jaccard") >= ALIKE:
        said.append("Structure: what decompression gives back has the typology of the text.")
    if of("protect_compact", "avg_mid_constraint_recall_visible") > of("compact", "avg_mid_constraint_recall_visible") + MARGIN:
        said.append("Protection: sentences set aside keep more constraints in sight than compaction alone.")
    return said


def write_report(summary: DataFrame, path: str) -> None:
    """Writes the means as JSON lines to ``path/json``, and as a Markdown table with the verdicts to ``path/markdown``."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    rows = [r.asDict() for r in summary.orderBy("condition").collect()]
    names = summary.columns
    shown = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = [f"| {' | '.join(names)} |", f"|{' --- |' * len(names)}", *(f"| {' | '.join(shown(r[n]) for n in names)} |" for r in rows), "", *(f"- {v}" for v in verdicts(summary))]
    spark = summary.sparkSession
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/markdown")
