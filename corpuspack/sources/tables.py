"""Reading and writing texts, messages, cold stores and packed results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import scratch_path

ENTRY = "struct<ord:int,meta:string,pattern:string>"
COLD_STORE = f"page_id bigint, template_id string, fingerprint string, original_chars bigint, original_tokens_est bigint, encoded string, local_dictionary array<{ENTRY}>"
BLOCK = "struct<type:string,text:string>"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)`` of whole files, byte for byte: line ends stay, bytes that aren't UTF-8 are replaced."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """``(conv_id, turn, role, content)`` from JSON files: a list of messages each, or an object with ``messages``.

    ``conv_id`` is the file.  Content may be a string or a list of blocks; whatever else it is stays as its JSON.
    ``ValueError`` if a file has neither form.
    """
    files = read_texts(spark, path)
    listed = F.from_json("text", "array<string>")
    wrapped = F.from_json(F.get_json_object("text", "$.messages"), "array<string>")
    rows = files.select(F.col("path").alias("conv_id"), F.when(F.ltrim("text").startswith("["), listed).otherwise(wrapped).alias("m"))
    if bad := rows.where("m is null").select("conv_id").first():
        raise ValueError(f"no messages in {bad.conv_id}")
    each = rows.select("conv_id", F.posexplode("m").alias("turn", "m"))
    raw = F.get_json_object("m", "$.content")
    blocks = F.from_json(raw, f"array<{BLOCK}>")
    parts = F.array_join(F.transform(blocks, lambda b: F.when(b["type"] == "text", F.coalesce(b["text"], F.lit(""))).otherwise(F.to_json(b))), "\n")
    content = F.when(F.get(F.filter(blocks, lambda b: b["type"].isNotNull()), F.lit(0)).isNotNull(), parts).otherwise(F.coalesce(raw, F.lit("")))
    return each.select("conv_id", F.col("turn").cast("long"), F.coalesce(F.get_json_object("m", "$.role"), F.lit("user")).alias("role"), content.alias("content"))


def write_cold_store(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """Writes cold rows in ranges of ``page_id``, sorted, so that a lookup reads one file of Parquet, or as JSON lines.

    Key columns of the rows are kept, and in Parquet ``exemplar``, which a prompt over the store is made from.
    """
    spark, kept = rows.sparkSession, scratch_path(rows.sparkSession, "encoded")
    # ranges are sampled first: encode once; as Parquet, a third of a checkpoint
    (rows if form == "parquet" else rows.drop("exemplar")).write.option("compression", "zstd").parquet(kept)
    spark.read.parquet(kept).repartitionByRange("page_id").sortWithinPartitions("page_id").write.mode("overwrite").format(form).save(path)


def read_cold_store(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return spark.read.schema(COLD_STORE).format(form).load(path)


def page_index(rows: DataFrame) -> DataFrame:
    """The directory of a cold store: its rows, with their keys, without the bodies."""
    keys = [c for c in rows.columns if c not in ("encoded", "local_dictionary", "exemplar")]
    return rows.select(*keys, F.size("local_dictionary").cast("long").alias("local_dict_size"), F.length("encoded").cast("long").alias("encoded_chars"))


def write_page_index(rows: DataFrame, path: str) -> None:
    """Writes the directory in ranges of ``page_id``, sorted, as Parquet."""
    page_index(rows).repartitionByRange("page_id").sortWithinPartitions("page_id").write.mode("overwrite").parquet(path)


def read_page_index(spark: SparkSession, path: str) -> DataFrame:
    """A stored directory; filters on ``page_id`` reach the scan."""
    return spark.read.parquet(path)


def write_hierarchical(pages: DataFrame, packed: DataFrame, path: str) -> None:
    """Writes a hierarchical pack: ``pages`` (of ``encode_pages``) as Parquet, sorted, and the packed rows as JSON beside them."""
    pages.repartitionByRange("page_id").sortWithinPartitions("page_id").write.mode("overwrite").parquet(f"{path}/pages")
    write_packed(packed, f"{path}/packs")


def read_hierarchical(spark: SparkSession, path: str) -> DataFrame:
    """The pages of a stored hierarchical pack, which give the texts back."""
    return spark.read.parquet(f"{path}/pages")


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether there is a file or folder of this name or pattern, in whatever store it names."""
    there = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(there.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(there))


def kind_of(spark: SparkSession, path: str) -> str:
    """What was stored at ``path``: ``hierarchical``, ``budgeted``, ``cold_store`` or ``flat``; ``ValueError`` if there is nothing."""
    if not exists(spark, path):
        raise ValueError(f"nothing at {path}")
    if exists(spark, f"{path}/pages"):
        return "hierarchical"
    if exists(spark, f"{path}/cold_store"):
        return "budgeted"
    return "cold_store" if exists(spark, f"{path}/*.parquet") or exists(spark, f"{path}/batch=*/*.parquet") else "flat"


def write_packed(packed: DataFrame, path: str, pretty: bool = False) -> None:
    """Writes packed results as one JSON document a row."""
    packed.select(F.to_json(F.struct("*"), {"pretty": str(pretty).lower()}).alias("value")).write.mode("overwrite").text(path)


def write_prompts(packed: DataFrame, path: str, column: str = "packed_prompt") -> None:
    """Writes prompts as text."""
    packed.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """``(encoded, dictionary)`` of packed documents; a dictionary may be a list of entries or an object."""
    raw = spark.read.text(path).select(F.from_json("value", "encoded string, dictionary string").alias("r"))
    listed = F.from_json("r.dictionary", f"array<{ENTRY}>")
    pairs = F.map_entries(F.from_json("r.dictionary", "map<string,string>"))
    named = F.transform(pairs, lambda e, i: F.struct(i.cast("int").alias("ord"), e["key"].alias("meta"), e["value"].alias("pattern")))
    kept = F.when(F.startswith(F.col("r.dictionary"), F.lit("[")), listed).otherwise(named)
    return raw.select(F.coalesce("r.encoded", F.lit("")).alias("encoded"), F.coalesce(kept, F.array().cast(f"array<{ENTRY}>")).alias("dictionary"))
