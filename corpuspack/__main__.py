"""Command line: ``python -m corpuspack COMMAND``; paths are whatever Spark reads and writes."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .functions import text as T
from .functions.session import cut
from .operators import packing as P
from .operators.budget import decoded_pages
from .operators.codebook import decode
from .operators.recall import fragment
from .plans.facade import PromptMemory
from .sources import tables


# Names of commands and options, and their defaults, are those of an interface (fixed values).
#: Where results go if it isn't said (folders, as Spark writes).
OUT = {"compress": "packed", "decompress": "decompressed", "hierarchical": "hierarchical_packed", "scale-compress": "budgeted_packed", "compact": "compacted"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpuspack", description=__doc__)
    top.add_argument("--version", action="version", version=f"corpuspack {__version__}")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str) -> argparse.ArgumentParser:
        one = sub.add_parser(name)
        if name not in ("recall", "suite"):
            one.add_argument("--file", "-f", required=True)
        if name in OUT:
            one.add_argument("--out", "-o", default=OUT[name])
        return one

    one = command("compress")
    one.add_argument("--min-freq", type=int, default=3)
    one.add_argument("--max-dict", type=int, default=256)
    one.add_argument("--no-lines", action="store_true")
    command("decompress")
    command("hierarchical").add_argument("--page-size", type=int, default=4000)
    command("metrics")
    one = command("scale-compress")
    one.add_argument("--input-budget", type=int, default=10_000_000)
    one.add_argument("--output-budget", type=int, default=1_000_000)
    one.add_argument("--page-chars", type=int, default=16_000)
    one = command("compact")
    one.add_argument("--budget", type=int, default=8000)
    one.add_argument("--mode", default="auto", choices=["auto", "lossless_dict", "lossy_stub"])
    one.add_argument("--keep-last", type=int, default=4)
    one = command("recall")
    one.add_argument("--store", required=True)
    one.add_argument("--page-id", action="append", default=[])
    one.add_argument("--page-ids", default="")
    one.add_argument("--query")
    one.add_argument("--top-k", type=int, default=5)
    one.add_argument("--method", default="keyword", choices=["keyword", "embedding"])
    one.add_argument("--out", "-o")
    command("suite")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "suite":
        print("compress: flat, hierarchical or budgeted packs; compact: message histories; recall: pages by id or keyword")
        return 0
    spark = SparkSession.builder.appName("corpuspack").getOrCreate()
    try:
        return run(spark, args)
    except (ValueError, KeyError, NotImplementedError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def restored(spark: SparkSession, path: str) -> DataFrame:
    """The texts of whatever is stored at ``path``, one column; of a cold store its pages, which are whole lines, in order."""
    kind = tables.kind_of(spark, path)
    if kind == "hierarchical":
        return P.hierarchical_unpack(tables.read_hierarchical(spark, path), ["path"]).orderBy("path").select("text")
    if kind == "flat":
        return tables.read_packed(spark, path).select(decode(F.col("encoded"), F.col("dictionary")).alias("value"))
    rows = spark.read.parquet(f"{path}/cold_store" if kind == "budgeted" else path)
    keys = [c for c in ("path",) if c in rows.columns]
    return decoded_pages(rows, keys).orderBy(*keys, "page_id").select("text")


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """Token figures: those of stored packs, measured again where a flat pack has none, or those of a text."""
    kind = tables.kind_of(spark, path)
    if kind == "cold_store":
        return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_pages"), F.sum("original_tokens_est").alias("original_tokens_est"))
    rows = spark.read.text(path if kind == "flat" else f"{path}/packs")
    fields = "encoded string, original_tokens long, packed_tokens long, compressed_tokens long, dictionary_tokens long, ratio double, compression_factor double, dictionary_entries long"
    fields += ", input_tokens_est long, prompt_tokens_est long, original_tokens_est long, packed_tokens_est long, n_pages long"
    packed = rows.select(F.from_json("value", fields).alias("r")).select("r.*")
    known = packed.where("original_tokens is not null or n_pages is not null").drop("encoded")
    if not known.isEmpty():
        return known
    if not packed.where("encoded is not null").isEmpty():
        both = tables.read_packed(spark, path).withColumn("text", decode(F.col("encoded"), F.col("dictionary")))
        return both.select(*P.metrics(F.col("text"), F.col("encoded"), F.col("dictionary"), F.concat(P.system_dictionary(F.col("dictionary")), F.lit("\n\nENCODED_BODY:\n"), "encoded")))
    text = F.col("text")
    return tables.read_texts(spark, path).select("path", T.token_estimate(text).alias("tokens_est"), T.length(text).alias("chars"))


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.command == "compress":
        options = P.FlatOptions(min_freq=args.min_freq, max_dict_size=args.max_dict, use_line_patterns=not args.no_lines)
        tables.write_packed(P.flat_pack(tables.read_texts(spark, args.file), ["path"], options).drop("text"), args.out)
    elif args.command == "decompress":
        # the writer ends each row with a line end: the one that the text has, or one more behind a text that has none
        texts = restored(spark, args.file).toDF("text").select(F.regexp_replace("text", r"\n\z", ""))
        texts.write.mode("overwrite").text(args.out)
    elif args.command == "hierarchical":
        options = P.HierarchicalOptions(page_size=args.page_size)
        pages = cut(P.encode_pages(tables.read_texts(spark, args.file), ["path"], options))
        tables.write_hierarchical(pages, P.hierarchical_pack(None, ["path"], options, pages), args.out)
    elif args.command == "metrics":
        for line in metrics(spark, args.file).toJSON().toLocalIterator():
            print(line)
    elif args.command == "scale-compress":
        memory = PromptMemory(spark, output_budget=args.output_budget, input_budget=args.input_budget, page_chars=args.page_chars, cold_store=f"{args.out}/cold_store")
        packed = cut(memory.pack_files(args.file))
        tables.write_page_index(spark.read.parquet(f"{args.out}/cold_store"), f"{args.out}/page_index")
        tables.write_prompts(packed, f"{args.out}/prompts")
        tables.write_packed(packed.drop("packed_prompt", "global_dictionary", "hot_ids"), f"{args.out}/meta", pretty=True)
        tables.write_packed(packed, f"{args.out}/packs")
    elif args.command == "compact":
        done = PromptMemory(spark).compact(tables.read_messages(spark, args.file), ["conv_id"], budget=args.budget, mode=args.mode, keep_last_n=args.keep_last)
        tables.write_packed(done.summary, f"{args.out}/summary")
        tables.write_packed(done.messages, f"{args.out}/messages")
        tables.write_packed(done.cold_refs, f"{args.out}/cold_refs")
    elif args.command == "recall":
        ids = [*args.page_id, *(x for x in args.page_ids.split(",") if x)]
        hits = PromptMemory(spark, cold_store=args.store).recall(ids, args.query, args.top_k, args.method)
        packed = fragment(hits)
        if args.out:
            tables.write_prompts(packed, args.out, "packed_fragment")
        else:
            print(packed.first().packed_fragment)
    return 0


if __name__ == "__main__":
    sys.exit(main())
