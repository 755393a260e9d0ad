"""The registered queries over the driver's tables, with their SQL.

Every query covers its whole table.  Names carry the operator; the SQL enumerates
plainly what the operators reach by windows, pruning and shared passes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.session import cut, scratch_path
from ..operators import budget as B
from ..operators import compaction as C
from ..operators import evaluate as E
from ..operators import packing as P
from ..operators import recall as R
from ..operators.gram_index import keyword_scores_many, keyword_search_many, read_gram_index, recall_by_table, write_gram_index
from ..operators.mining import merge_candidates, mine_chars, mine_lines, mine_ngrams
from ..operators.paging import paginate
from ..operators.scope import ScopeOptions, encode_scopes, scope_dictionary
from ..sources import tables
from . import sql as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(oracle: str | None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = (f, oracle)
        return f

    return register


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """One row group of text is one task; mining multiplies its rows, so deal it out first."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))


def log_line() -> Column:
    """An event as a line of a log."""
    return F.concat(
        F.lit("2026-01-01T00:00:00Z INFO svc="), "event_type", F.lit(" user_id="), F.col("user_id").cast("string"), F.lit(" request_id="),
        F.col("event_id").cast("string"), F.lit(" status=200 latency_ms="), F.floor("value").cast("string"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(user_id, text)``: each user's events as a log."""
    lines = table(spark, sf_dir, "events").select("user_id", "event_id", log_line().alias("line"))
    return lines.groupBy("user_id").agg(F.array_join(P.in_order(F.col("event_id"), F.col("line")), "\n").alias("text"))


LOGS = """logs AS (
  SELECT user_id, string_agg('2026-01-01T00:00:00Z INFO svc=' || event_type || ' user_id=' || user_id || ' request_id=' || event_id || ' status=200 latency_ms=' || floor(value)::BIGINT, chr(10) ORDER BY event_id) AS text
  FROM events GROUP BY user_id)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))


# --- scans, pages, scalar functions -----------------------------------------------------------------


@query(f"""SELECT doc_id, length(text)::BIGINT AS n_code_points, {S.tokens('text')}::BIGINT AS tokens, len({S.units('text')})::BIGINT AS n_units,
       len({S.lines('text')})::BIGINT AS n_lines FROM documents""")
def token_estimate(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.length(text).alias("n_code_points"), T.token_estimate(text).alias("tokens"),
        F.size(T.units(text)).cast("long").alias("n_units"), F.size(T.lines(text)).cast("long").alias("n_lines"),
    )


@query(f"""SELECT lang, count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars_total, sum({S.tokens('text')})::BIGINT AS tokens,
       count(DISTINCT text) AS n_texts FROM documents GROUP BY lang""")
def corpus_totals(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hashed = docs.withColumn("h", F.sha2("text", 256))
    return hashed.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(T.length(F.col("text"))).alias("n_chars_total"),
        F.sum(T.token_estimate(F.col("text"))).alias("tokens"), F.countDistinct("h").alias("n_texts"),
    )


@query("""SELECT doc_id, (p0 // 500)::BIGINT AS page_id, substr(text, p0 + 1, 500) AS text
FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1, 0) + 1, 500)) AS p0 FROM documents)""")
def page_split(spark, sf_dir):
    return paginate(table(spark, sf_dir, "documents"), ["doc_id"], 500)


@query(f"""SELECT page_id, p0 // 800 AS part, 'L' || length(text) || '|' || left(coalesce({S.filled('text')}[1], ''), 80) AS fingerprint
FROM (SELECT page_id, p0, substr(html, p0 + 1, 800) AS text FROM (SELECT page_id, html, unnest(range(0, greatest(length(html) - 1, 0) + 1, 800)) AS p0 FROM pages))""")
def page_split_html(spark, sf_dir):
    source = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    cut = paginate(source, ["id"], 800)
    return cut.select(F.col("id").alias("page_id"), F.col("page_id").alias("part"), T.hierarchical_fingerprint(F.col("text")).alias("fingerprint"))


@query(f"SELECT doc_id, left(sha1(text), 12) || '|' || left(coalesce({S.filled('text')}[1], ''), 60) AS fingerprint FROM documents")
def page_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.page_fingerprint(F.col("text")).alias("fingerprint"))


@query(r"""WITH l AS (
  SELECT event_id, '2026-01-01T00:00:00Z INFO svc=' || event_type || ' user_id=' || user_id || ' request_id=' || event_id || ' status=200 latency_ms=' || floor(value)::BIGINT AS line FROM events),
t AS (SELECT event_id, line, left(sha1(regexp_replace(regexp_replace(line, '\d+', '#', 'g'), '[0-9a-fA-F]{8,}', '#hex#', 'g')), 16) AS template_id FROM l),
g AS (SELECT template_id, count(*) AS n, min(event_id) AS first, arg_min(line, event_id) AS exemplar FROM t GROUP BY template_id)
SELECT template_id, n, first, exemplar, '⟦T' || (row_number() OVER (ORDER BY n DESC, first) - 1) || '⟧' AS meta FROM g""")
def template_counts(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select(F.lit(1).alias("scope"), F.col("event_id").alias("page_id"), log_line().alias("exemplar"))
    ranked = B.templates(lines.withColumn("template_id", T.template_id(F.col("exemplar"))), ["scope"])
    return ranked.select("template_id", F.col("count").alias("n"), "first", "exemplar", F.concat(F.lit("⟦T"), F.col("rank").cast("string"), F.lit("⟧")).alias("meta"))


@query("""SELECT doc_id, CASE WHEN (length(text) + 3) // 4 > 100 AND 360 < length(text)
  THEN left(text, 200) || chr(10) || chr(10) || '…[TRUNCATED ' || (length(text) - 360) || ' chars]…' || chr(10) || chr(10) || right(text, 160) ELSE text END AS text FROM documents""")
def head_tail_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.head_tail(F.col("text"), F.lit(100)).alias("text"))


@query("""WITH RECURSIVE l AS (SELECT doc_id, text, CASE WHEN text LIKE '%' || chr(10) OR text = '' THEN s[:-2] ELSE s END AS l FROM (SELECT doc_id, text, string_split(text, chr(10)) AS s FROM documents)),
e AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) || CASE WHEN unnest(range(1, len(l) + 1)) < len(l) OR text LIKE '%' || chr(10) THEN chr(10) ELSE '' END AS line FROM l),
r AS (
  SELECT doc_id, i, line, 0 AS page, length(line) AS size FROM e WHERE i = 1
  UNION ALL SELECT e.doc_id, e.i, e.line, CASE WHEN size >= 1000 THEN page + 1 ELSE page END, CASE WHEN size >= 1000 THEN length(e.line) ELSE size + length(e.line) END FROM r JOIN e ON e.doc_id = r.doc_id AND e.i = r.i + 1)
SELECT doc_id::VARCHAR AS path, page::BIGINT AS page_id, string_agg(line, '' ORDER BY i) AS text FROM r GROUP BY doc_id, page""")
def line_pager_sql(spark, sf_dir):
    """The line pager as a table function, called from SQL."""
    T.register(spark)
    table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text").createOrReplaceTempView("corpuspack_texts")
    return spark.sql("SELECT path, page_id, text FROM line_pager(TABLE(corpuspack_texts) PARTITION BY (path), 1000)")


# --- mining and codebooks -----------------------------------------------------------------------------


@query(f"WITH {S.whole_lines('documents', 'doc_id', 'text', 2)} SELECT doc_id, pattern, cnt, len::BIGINT AS len, score::BIGINT AS score, rank::INT AS rank FROM lines")
def line_patterns(spark, sf_dir):
    return mine_lines(table(spark, sf_dir, "documents"), ["doc_id"], min_freq=2).drop("src")


@query(f"WITH {S.ngrams('documents', 'doc_id', 'text', 3, 10)} SELECT doc_id, pattern, cnt, len::BIGINT AS len, score::BIGINT AS score, rank::INT AS rank FROM ngrams")
def ngram_patterns(spark, sf_dir):
    return mine_ngrams(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], max_len=10, min_freq=3).drop("src")


@query(f"WITH {S.ngrams('pages', 'page_id', 'html', 3, 12)} SELECT page_id, pattern, cnt, len::BIGINT AS len, score::BIGINT AS score, rank::INT AS rank FROM ngrams")
def ngram_patterns_html(spark, sf_dir):
    return mine_ngrams(html(spark, sf_dir), ["page_id"], max_len=12, min_freq=3).drop("src")


@query(f"WITH {S.chars('pages', 'page_id', 'html', 3)} SELECT page_id, pattern, cnt, len::BIGINT AS len, score::BIGINT AS score, rank::INT AS rank FROM chars")
def char_ngrams(spark, sf_dir):
    return mine_chars(html(spark, sf_dir), ["page_id"], min_freq=3).drop("src")


_HTML_MERGED = ",".join([S.ngrams("pages", "page_id", "html", 3, 10), S.whole_lines("pages", "page_id", "html", 2), S.chars("pages", "page_id", "html", 3), S.merged("page_id", ["ngrams", "lines", "chars"])])


@query(f"WITH {_HTML_MERGED} SELECT page_id, pattern, cnt, len::BIGINT AS len, score::BIGINT AS score, rank::INT AS rank FROM merged")
def merged_candidates(spark, sf_dir):
    texts = html(spark, sf_dir)
    groups = [mine_ngrams(texts, ["page_id"], max_len=10), mine_lines(texts, ["page_id"]), mine_chars(texts, ["page_id"])]
    return merge_candidates(groups, ["page_id"])


@query(f"WITH {_HTML_MERGED}, {S.gated('pages', 'page_id', 'html', 256)} SELECT page_id, ord::INT AS ord, meta, pattern, cnt FROM entries")
def dictionary_select(spark, sf_dir):
    return P.build_dictionary(html(spark, sf_dir), ["page_id"], P.FlatOptions(use_char_ngrams=True))


_FLAT_DOCS = S.flat("documents", "doc_id", "text", 3, 10, 256)


@query(f"WITH {_FLAT_DOCS} SELECT doc_id, encoded, dictionary_entries::BIGINT AS dictionary_entries, system_dictionary || chr(10) || chr(10) || 'ENCODED_BODY:' || chr(10) || encoded AS packed_prompt FROM packed")
def flat_encode(spark, sf_dir):
    return P.flat_pack(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]).select("doc_id", "encoded", "dictionary_entries", "packed_prompt")


@query("SELECT page_id, html AS text FROM pages")
def flat_roundtrip(spark, sf_dir):
    from ..operators.codebook import decode

    packed = P.flat_pack(html(spark, sf_dir), ["page_id"])
    return packed.select("page_id", decode(F.col("encoded"), F.col("dictionary")).alias("text"))


@query(f"""WITH {S.flat("pages", "page_id", "html", 3, 10, 256)},
m AS (SELECT page_id, {S.tokens('text')} AS o, {S.tokens('encoded')} AS c, {S.tokens('plain')} AS d, {S.tokens("(system_dictionary || chr(10) || chr(10) || 'ENCODED_BODY:' || chr(10) || encoded)")} AS p, dictionary_entries FROM packed)
SELECT page_id, o::BIGINT AS original_tokens, c::BIGINT AS compressed_tokens, d::BIGINT AS dictionary_tokens, p::BIGINT AS packed_tokens,
       round({S.ratio('p', 'o')}, 6) AS ratio, round({S.factor('p', 'o')}, 6) AS compression_factor, dictionary_entries::BIGINT AS dictionary_entries FROM m""")
def compression_metrics(spark, sf_dir):
    packed = P.flat_pack(html(spark, sf_dir), ["page_id"])
    return packed.select(
        "page_id", "original_tokens", "compressed_tokens", "dictionary_tokens", "packed_tokens",
        F.round("ratio", 6).alias("ratio"), F.round("compression_factor", 6).alias("compression_factor"), "dictionary_entries",
    )


@query(f"""WITH {LOGS}, {S.flat("logs", "user_id", "text", 2, 10, 128)} SELECT user_id, encoded, dictionary_entries::BIGINT AS dictionary_entries FROM packed""")
def flat_encode_logs(spark, sf_dir):
    return P.flat_pack(logs(spark, sf_dir), ["user_id"], P.FlatOptions(min_freq=2, max_dict_size=128)).select("user_id", "encoded", "dictionary_entries")


@query(rf"""WITH {S.flat("pages", "page_id", "html", 3, 10, 256)}
SELECT page_id, encoded, text AS decoded, {S.tokens('encoded')}::BIGINT AS tokens, left(sha1(text), 12) || '|' || left(coalesce({S.filled('text')}[1], ''), 60) AS fingerprint,
       left(sha1(regexp_replace(regexp_replace(text, '\d+', '#', 'g'), '[0-9a-fA-F]{{8,}}', '#hex#', 'g')), 16) AS template FROM packed""")
def dictionary_sql(spark, sf_dir):
    """Encoding and decoding by dictionaries, estimates, fingerprints and templates by SQL functions."""
    T.register(spark)
    P.flat_pack(html(spark, sf_dir), ["page_id"]).select("page_id", "text", "dictionary").createOrReplaceTempView("corpuspack_packed")
    return spark.sql("""SELECT page_id, encoded, decode_dict(encoded, dictionary) AS decoded, token_est(encoded) AS tokens, page_fingerprint(text) AS fingerprint, template_id(text) AS template
      FROM (SELECT *, encode_dict(text, dictionary) AS encoded FROM corpuspack_packed)""")


# --- one dictionary for many rows ------------------------------------------------------------------------

_JOINED = "joined AS (SELECT source, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY source)"
_SCOPE = f"{_JOINED}, {S.flat('joined', 'source', 'text', 3, 10, 256)}"


def _source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page_id"), "text")


_SCOPE_OPTIONS = ScopeOptions(min_freq=3, max_dict_size=256)


@query(f"WITH {_SCOPE} SELECT source, ord::INT AS ord, meta, pattern, cnt FROM entries")
def scope_dictionary_select(spark, sf_dir):
    """The dictionary of all documents of a source, as of their joined text."""
    return scope_dictionary(_source_pages(spark, sf_dir), ["source"], _SCOPE_OPTIONS)


@query(f"WITH {_SCOPE} SELECT source, doc_id AS page_id, CASE WHEN there IS NULL THEN d.text ELSE {S.fold('d.text', 'there')} END AS encoded, there IS NOT NULL AS coded FROM documents d LEFT JOIN books USING (source)")
def scope_encode(spark, sf_dir):
    """Every document behind its source's dictionary."""
    pages = _source_pages(spark, sf_dir)
    return encode_scopes(pages, cut(scope_dictionary(pages, ["source"], _SCOPE_OPTIONS)), ["source"])


# --- hierarchical and budgeted packs ------------------------------------------------------------------


@query("SELECT doc_id, text FROM documents")
def hierarchical_roundtrip(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return P.hierarchical_unpack(P.encode_pages(docs, ["doc_id"], P.HierarchicalOptions(page_size=2000)), ["doc_id"])


@query(f"""WITH cut AS (
  SELECT page_id AS id, p0 // 800 AS page, page_id * 1000000 + p0 // 800 AS k, substr(html, p0 + 1, 800) AS text FROM (SELECT page_id, html, unnest(range(0, greatest(length(html) - 1, 0) + 1, 800)) AS p0 FROM pages)),
{S.nested("own", S.flat("cut", "k", "text", 2, 10, 64), f"SELECT k, encoded, dictionary_entries AS n, {S.LISTED} AS listed FROM packed")},
pg AS (SELECT id, page, text, encoded, n, listed, 'L' || length(text) || '|' || left(coalesce({S.filled('text')}[1], ''), 80) AS fp FROM cut JOIN own USING (k)),
lv AS (
  SELECT id, string_agg('<<<PAGE ' || page || '>>>' || chr(10) || encoded, chr(10) || chr(10) ORDER BY page) AS text, count(*) AS n_pages, sum(n) AS total, sum(length(text)) AS chars,
         '[' || string_agg('{{"page_id": ' || page || ', "fingerprint": ' || to_json(fp)::VARCHAR || ', "original_chars": ' || length(text) || ', "local_dict_size": ' || n || '}}', ', ' ORDER BY page) || ']' AS page_index,
         string_agg(CASE WHEN n > 0 THEN 'PAGE_' || page || '_DICT:' || listed || chr(10) ELSE '' END, '' ORDER BY page) AS dicts
  FROM pg GROUP BY id),
{S.nested("top", S.flat("lv", "id", "text", 2, 10, 128, True), f"SELECT id, encoded, dictionary_entries AS n, {S.LISTED} AS listed FROM packed")},
ou AS (SELECT lv.*, top.encoded, top.n, 'HIERARCHICAL PAGEINDEX DICTIONARY-ENCODED CORPUS' || chr(10) || 'Decode order: expand GLOBAL_DICT, then each PAGE_n_DICT on that page body.' || chr(10) || chr(10) || 'GLOBAL_DICT:' || top.listed || chr(10)
         || chr(10) || 'PAGE_INDEX:' || chr(10) || page_index || chr(10) || chr(10) || dicts || chr(10) || 'ENCODED_CORPUS:' || chr(10) || top.encoded AS packed_prompt FROM lv JOIN top USING (id)),
fi AS (SELECT *, (chars + 3) // 4 AS o, {S.tokens('packed_prompt')} AS p FROM ou)
SELECT id, encoded AS encoded_corpus, page_index, packed_prompt, chars::BIGINT AS original_chars, o::BIGINT AS original_tokens_est, p::BIGINT AS packed_tokens_est, round({S.factor('p', 'o')}, 6) AS compression_factor,
       round({S.ratio('p', 'o')}, 6) AS ratio, n_pages, 800::INT AS page_size, n::BIGINT AS global_dict_size, total::BIGINT AS local_dict_total FROM fi""")
def hierarchical_pack(spark, sf_dir):
    packed = P.hierarchical_pack(spread(html(spark, sf_dir)).withColumnRenamed("page_id", "id"), ["id"], P.HierarchicalOptions(page_size=800))
    # the dictionary is in the prompt as well
    return packed.drop("global_dictionary").withColumn("ratio", F.round("ratio", 6)).withColumn("compression_factor", F.round("compression_factor", 6))


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of their source, with what budgets look at."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "source", F.col("doc_id").alias("page_id"), T.template_id(text).alias("template_id"), T.token_estimate(text).alias("original_tokens_est"),
    )


_ROWS = r"""rows AS (
  SELECT source, doc_id AS page_id, left(sha1(regexp_replace(regexp_replace(text, '\d+', '#', 'g'), '[0-9a-fA-F]{8,}', '#hex#', 'g')), 16) AS template_id,
         (length(text) + 3) // 4 AS original_tokens_est FROM documents)"""


@query(f"""WITH {_ROWS},
f AS (SELECT *, min(page_id) OVER (PARTITION BY source, template_id) AS first, count(*) OVER (PARTITION BY source) AS n FROM rows),
m AS (SELECT *, page_id <> first AND page_id <= max(first) OVER (PARTITION BY source) AS late FROM f)
SELECT source, page_id, template_id FROM m QUALIFY row_number() OVER (PARTITION BY source ORDER BY late, page_id) <= greatest(1, floor(n * 0.25::DOUBLE))""")
def hot_pages(spark, sf_dir):
    return B.hot_pages(source_rows(spark, sf_dir), ["source"], 0.25).where("hot").select("source", "page_id", "template_id")


@query(f"""WITH {_ROWS}, c AS (SELECT *, coalesce(sum(original_tokens_est) OVER (PARTITION BY source ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM rows)
SELECT source, page_id, original_tokens_est::BIGINT AS original_tokens_est FROM c WHERE spent < 10000""")
def input_cap(spark, sf_dir):
    return B.input_cap(source_rows(spark, sf_dir), ["source"], 10_000).select("source", "page_id", "original_tokens_est")


def _files(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    """Names, times and sizes of a table's files, in whatever store they lie."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf_dir}/{name}.parquet").select("path", "modificationTime", "length")
    return tuple(sorted(tuple(map(str, r)) for r in found.collect()))


_STORED: dict[tuple, str] = {}


def _kept(spark: SparkSession, sf_dir: str, kind: str, write: Callable[[str], None]) -> str:
    """The path of what ``write`` makes of the documents: written again if their files have changed or it is gone."""
    key = (spark.sparkContext.applicationId, kind, _files(spark, sf_dir, "documents"))
    path = _STORED.get(key)
    if path is None or not tables.exists(spark, path):
        path = scratch_path(spark, kind)
        write(path)
        _STORED[key] = path
    return path


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cold store of all documents, one page each, as it is read back: sorted by ``page_id``."""
    docs = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page_id"), "text")
    return spark.read.parquet(_kept(spark, sf_dir, "cold", lambda path: tables.write_cold_store(B.cold_rows(docs, ["source"]), path)))


def gram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gram index of that store."""
    return read_gram_index(spark, _kept(spark, sf_dir, "grams", lambda path: write_gram_index(store(spark, sf_dir), path)))


_INPUT, _OUTPUT = 1 << 62, 20_000


def _index_row(flag: str) -> str:
    return f"""'{{"page_id": ' || page_id || ', "template_id": ' || to_json(template_id)::VARCHAR || ', "fingerprint": ' || to_json(fp)::VARCHAR || ', "tokens_est": ' || tok || ', "in_prompt": {flag}}}'"""


@query(rf"""WITH {S.nested("own", S.flat("documents", "doc_id", "text", 2, 10, 48), "SELECT doc_id, encoded FROM packed")},
rw AS (
  SELECT d.source, d.doc_id AS page_id, d.text, encoded, {S.tokens('d.text')} AS tok, left(sha1(d.text), 12) || '|' || left(coalesce({S.filled('d.text')}[1], ''), 60) AS fp,
         left(sha1(regexp_replace(regexp_replace(d.text, '\d+', '#', 'g'), '[0-9a-fA-F]{{8,}}', '#hex#', 'g')), 16) AS template_id FROM documents d JOIN own USING (doc_id)),
te AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, first) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n_templates FROM (
    SELECT source, template_id, count(*) AS n, min(page_id) AS first, left(arg_min(text, page_id), 2000) AS exemplar FROM rw GROUP BY source, template_id)),
bl AS (SELECT source, string_agg(exemplar, chr(10) ORDER BY rank) AS text FROM te WHERE rank < 128 GROUP BY source),
{S.nested("gl", S.flat("bl", "source", "text", 1, 10, 64), f"SELECT packed.source, dictionary_entries AS n_dict, {S.LISTED} AS listed, CASE WHEN dictionary_entries > 0 THEN there ELSE [] END AS there FROM packed LEFT JOIN books ON books.source = packed.source")},
cb AS (SELECT source, any_value(n_templates) AS n_templates, coalesce(string_agg(chr(10) || '  ⟦T' || rank || '⟧ → template ' || template_id || ' (count=' || n || ')', '' ORDER BY rank) FILTER (rank < 64 AND (n >= 2 OR n_templates <= 8)), '') AS codebook FROM te GROUP BY source),
f AS (SELECT *, min(page_id) OVER (PARTITION BY source, template_id) AS first, count(*) OVER (PARTITION BY source) AS n FROM rw),
m AS (SELECT *, page_id <> first AND page_id <= max(first) OVER (PARTITION BY source) AS late FROM f),
ho AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY late, page_id) <= greatest(1, floor(n * 0.2::DOUBLE)) AS hot FROM m),
bo AS (SELECT ho.*, CASE WHEN hot THEN '<<<PAGE ' || page_id || ' T=' || template_id || '>>>' || chr(10) || CASE WHEN n_dict > 0 THEN {S.fold('encoded', 'there')} ELSE encoded END END AS body FROM ho JOIN gl USING (source)),
ix AS (SELECT *, {_index_row('true')} AS yes, {_index_row('false')} AS no FROM bo),
su AS (
  SELECT *, sum(CASE WHEN hot THEN length(body) + 1 ELSE 0 END) OVER w AS upto, sum(hot::INT) OVER w AS nth, sum(hot::INT) OVER (PARTITION BY source) AS n_hot,
         sum(length(CASE WHEN hot THEN yes ELSE no END) + 2) OVER (PARTITION BY source) AS index_size, sum(tok) OVER (PARTITION BY source) AS streamed
  FROM ix WINDOW w AS (PARTITION BY source ORDER BY page_id ROWS UNBOUNDED PRECEDING)),
he AS (
  SELECT source, n_dict, n_templates, 'BUDGETED PAGEINDEX PACK' || chr(10) || 'input_tokens_est=' || streamed || ' input_budget={_INPUT} output_budget={_OUTPUT}' || chr(10)
         || 'Lossless full decode requires cold_store.jsonl + this pack.' || chr(10) || 'Prompt holds dictionaries, directory, and HOT pages only.' || chr(10) || chr(10) || 'GLOBAL_DICT:' || listed || chr(10) || chr(10)
         || 'TEMPLATE_CODEBOOK:' || codebook || chr(10) || chr(10) || 'PAGE_INDEX:' AS head
  FROM gl JOIN cb USING (source) JOIN (SELECT source, any_value(streamed) AS streamed FROM su GROUP BY source) USING (source)),
se AS (
  SELECT su.*, head, n_dict, n_templates,
         hot AND (length(head) + 1 + index_size + length(chr(10) || chr(10) || 'HOT_ENCODED_PAGES:') + length(chr(10) || chr(10) || 'COLD_STORE_REF: cold_store.jsonl') + n_hot - nth + upto + 3) // 4 <= {_OUTPUT} AS shown FROM su JOIN he USING (source)),
ou AS (
  SELECT source, any_value(head) || chr(10) || '[' || string_agg(CASE WHEN shown THEN yes ELSE no END, ', ' ORDER BY page_id) || ']' || chr(10) || chr(10) || 'HOT_ENCODED_PAGES:'
         || coalesce(string_agg(chr(10) || body, '' ORDER BY page_id) FILTER (shown), '') || chr(10) || chr(10) || 'COLD_STORE_REF: cold_store.jsonl' AS packed_prompt,
         any_value(streamed) AS streamed, count(*) AS n_pages, any_value(n_templates) AS n_templates, any_value(n_dict) AS n_dict, count(*) FILTER (shown) AS shown FROM se GROUP BY source)
SELECT source, packed_prompt, {S.tokens('packed_prompt')}::BIGINT AS prompt_tokens_est, {S.tokens('packed_prompt')} <= {_OUTPUT} AS prompt_fits_budget, streamed::BIGINT AS input_tokens_est,
       round({S.factor(S.tokens('packed_prompt'), 'streamed')}, 6) AS compression_factor_vs_prompt, n_pages, n_templates, n_dict::BIGINT AS global_dict_size, shown AS hot_pages, n_pages - shown AS cold_pages FROM ou""")
def budget_pack(spark, sf_dir):
    options = B.BudgetOptions(output_token_budget=_OUTPUT, input_token_budget=_INPUT, hot_page_fraction=0.2, max_global_dict=64)
    packed = B.budget_pack(store(spark, sf_dir), ["source"], options).drop("global_dictionary", "hot_ids")
    return packed.withColumn("compression_factor_vs_prompt", F.round("compression_factor_vs_prompt", 6))


@query("SELECT source, doc_id AS page_id, text FROM documents")
def cold_store_decode(spark, sf_dir):
    return B.decoded_pages(store(spark, sf_dir), ["source"])


# --- recall ---------------------------------------------------------------------------------------------


@query("""SELECT ord, doc_id AS page_id, 1.0::DOUBLE AS score, text FROM (VALUES (0, 7), (1, 3), (2, 7), (3, 100)) a(ord, id) JOIN documents ON doc_id = id""")
def recall_by_id(spark, sf_dir):
    return R.recall_by_ids(store(spark, sf_dir).drop("source"), [7, "3", 7, 100]).select("ord", "page_id", "score", "text")


_QUERY = "the licence de tion idiot"


def _scored(q: str) -> str:
    parts = [f"(length(l) - length(replace(l, '{t}', ''))) // {len(t)} + CASE WHEN contains(b, '{t}') THEN 2.0 ELSE 0.0 END" for t in q.split()]
    return rf"""scored AS (
  SELECT doc_id AS page_id, text, ({" + ".join(parts)})::DOUBLE AS score FROM (
    SELECT doc_id, text, lower(text) AS l,
           lower(left(sha1(text), 12) || '|' || left(coalesce({S.filled('text')}[1], ''), 60) || ' ' || left(sha1(regexp_replace(regexp_replace(text, '\d+', '#', 'g'), '[0-9a-fA-F]{{8,}}', '#hex#', 'g')), 16)) AS b
    FROM documents))"""


@query(f"WITH {_scored(_QUERY)} SELECT page_id, score, text FROM scored WHERE score > 0 ORDER BY score DESC, page_id LIMIT 20")
def keyword_topk(spark, sf_dir):
    return R.keyword_search(store(spark, sf_dir).drop("source"), _QUERY, 20).select("page_id", "score", "text")


@query(f"WITH {_scored(_QUERY)} SELECT page_id, score FROM scored WHERE score > 0")
def keyword_scores(spark, sf_dir):
    return R.keyword_scores(store(spark, sf_dir).drop("source"), _QUERY).select("page_id", "score")


@query(f"""WITH {_scored(_QUERY)},
k AS (SELECT page_id, score, row_number() OVER (ORDER BY score DESC, page_id) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 10)
SELECT ord::INT AS ord, doc_id AS page_id, 1.0::DOUBLE AS score FROM (VALUES (0, 7), (1, 3)) a(ord, id) JOIN documents ON doc_id = id
UNION ALL SELECT (rank + 2)::INT, page_id, score FROM k WHERE page_id NOT IN (7, 3)""")
def recall_union(spark, sf_dir):
    return R.recall(store(spark, sf_dir).drop("source"), [7, 3], _QUERY, 10).select("ord", "page_id", "score")


_MANY = rf"""q AS (
  SELECT item_id AS query_id, t, count(*) AS times FROM (
    SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 2)) AS t FROM benchmark) GROUP BY item_id, t),
d AS (
  SELECT doc_id, lower(text) AS l,
         lower(left(sha1(text), 12) || '|' || left(coalesce({S.filled('text')}[1], ''), 60) || ' ' || left(sha1(regexp_replace(regexp_replace(text, '\d+', '#', 'g'), '[0-9a-fA-F]{{8,}}', '#hex#', 'g')), 16)) AS b FROM documents),
s AS (
  SELECT t, doc_id, (length(l) - length(replace(l, t, ''))) // length(t) + CASE WHEN contains(b, t) THEN 2 ELSE 0 END AS s
  FROM (SELECT DISTINCT t FROM q), d WHERE contains(l, t) OR contains(b, t)),
m AS (SELECT query_id, doc_id AS page_id, sum(times * s)::DOUBLE AS score FROM q JOIN s USING (t) GROUP BY query_id, doc_id)"""


def _many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(f"WITH {_MANY} SELECT query_id, page_id, score FROM m")
def keyword_scores_by_index(spark, sf_dir):
    """Every benchmark text as a query over all documents."""
    return keyword_scores_many(gram_index(spark, sf_dir), store(spark, sf_dir).drop("source"), _many(spark, sf_dir))


@query(f"WITH {_MANY} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id)::INT AS rank, page_id, score FROM m QUALIFY rank <= 10")
def keyword_topk_by_index(spark, sf_dir):
    return keyword_search_many(gram_index(spark, sf_dir), store(spark, sf_dir).drop("source"), _many(spark, sf_dir), 10)


@query("SELECT conv_id AS request, turn AS ord, doc_id AS page_id, 1.0::DOUBLE AS score, d.text FROM conversations c JOIN documents d ON doc_id = conv_id + turn")
def recall_requests(spark, sf_dir):
    """Every turn asks for the page whose number is that of its conversation and its own together."""
    asked = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request"), F.col("turn").alias("ord"), (F.col("conv_id") + F.col("turn")).alias("page_id"))
    return recall_by_table(store(spark, sf_dir).drop("source"), asked)


# --- conversations --------------------------------------------------------------------------------------


_MERGED = f"""c AS (SELECT conv_id, turn, CASE WHEN turn % 4 < 2 THEN 'user' ELSE 'assistant' END AS role, text AS content FROM conversations),
i AS (SELECT *, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM i),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id, run ORDER BY turn DESC) AS b FROM r),
m AS (
  SELECT conv_id, min(turn) AS turn, any_value(role) AS role,
         string_agg(CASE WHEN a = 1 AND b = 1 THEN content WHEN a = 1 THEN regexp_replace(content, '{S.SPACE}+$', '') WHEN b = 1 THEN regexp_replace(content, '^{S.SPACE}+', '') ELSE {S.strip('content')} END, chr(10) || chr(10) ORDER BY turn) AS content
  FROM e GROUP BY conv_id, run)"""


@query(f"WITH {_MERGED} SELECT conv_id, turn, role, content FROM m")
def merge_turns(spark, sf_dir):
    # the table has no runs of one role: every turn is kept, two and two of them by one speaker
    speaker = F.when(F.col("turn") % 4 < 2, "user").otherwise("assistant")
    return C.merge_turns(turns(spark, sf_dir).withColumn("role", speaker), ["conv_id"])


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS back FROM conversations)
SELECT conv_id, turn, CASE WHEN role = 'system' THEN 0 WHEN back <= 2 THEN 2 ELSE 1 END::INT AS part FROM p""")
def protect_last_n(spark, sf_dir):
    return C.split_turns(turns(spark, sf_dir), ["conv_id"], True, 2).select("conv_id", "turn", "part")


_FILLED = f"list_filter({S.lines('text')}, lambda x: {S.strip('x')} <> '')"


@query(rf"""SELECT doc_id, length(text) >= 200 AND ((len({_FILLED}) >= 8 AND len(list_distinct({_FILLED}))::DOUBLE / greatest(len({_FILLED}), 1) < 0.55)
  OR (regexp_matches(text, '{T.RECOVERABLE}') AND {S.tokens('text')} >= 80)) AS repetitive FROM documents""")
def repetitive_turns(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.looks_repetitive(F.col("text")).alias("repetitive"))


@query(f"""WITH f AS (SELECT conv_id, turn, text, {S.filled('text')} AS l FROM conversations),
s AS (SELECT *, array_to_string(list_concat(l[1:2], CASE WHEN len(l) > 3 THEN l[-1:] ELSE [] END), ' | ') AS shown FROM f)
SELECT conv_id, turn, '[compacted stub: ~' || {S.tokens('text')} || ' tokens, ' || len(l) || ' lines; recoverable detail omitted] ' ||
  CASE WHEN length(shown) > 240 THEN left(shown, 239) || '…' ELSE shown END AS stub FROM s""")
def lossy_stub(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", T.lossy_stub(F.col("content")).alias("stub"))


def _evicting(budget: int, keep: int) -> str:
    stub = f"""'[compacted stub: ~' || {S.tokens('text')} || ' tokens, ' || len(l) || ' lines; recoverable detail omitted] ' || CASE WHEN length(shown) > 240 THEN left(shown, 239) || '…' ELSE shown END"""
    return f"""
p AS (SELECT conv_id, turn, role, text, {S.filled('text')} AS l, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS back FROM conversations),
q AS (SELECT *, CASE WHEN role = 'system' THEN 0 WHEN back <= {keep} THEN 2 ELSE 1 END AS part, array_to_string(list_concat(l[1:2], CASE WHEN len(l) > 3 THEN l[-1:] ELSE [] END), ' | ') AS shown FROM p),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, part ORDER BY turn) - 1 AS nth, sum(length(role) + 7 + length(text) + 2) OVER (PARTITION BY conv_id) - 2 AS size FROM q),
t AS (SELECT *, '[cold_ref:c' || nth || '] ' || {stub} AS stub FROM s),
v AS (SELECT *, size + coalesce(sum(length(stub) - length(text)) OVER (PARTITION BY conv_id, part ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS now FROM t),
w AS (SELECT *, part = 1 AND min(CASE WHEN (now + 3) // 4 > {budget} THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, part ORDER BY turn ROWS UNBOUNDED PRECEDING) = 1 AS evicted FROM v),
o AS (SELECT *, CASE WHEN evicted THEN stub ELSE text END AS final, row_number() OVER (PARTITION BY conv_id ORDER BY part, turn) - 1 AS ord FROM w)"""


_EVICT = C.CompactOptions(budget=150, keep_last_n=1)


@query(f"WITH {_evicting(150, 1)} SELECT conv_id, ord::INT AS ord, role, final AS content FROM o")
def evict_to_budget(spark, sf_dir):
    # no turn of the table is bulky and repetitive, so the SQL has eviction alone
    return C.compact_messages(turns(spark, sf_dir), ["conv_id"], _EVICT).messages


@query(f"""WITH {_evicting(150, 1)},
g AS (SELECT conv_id, string_agg('<<<' || upper(role) || '>>>' || chr(10) || final, chr(10) || chr(10) ORDER BY ord) AS packed_prompt, count(*) FILTER (evicted) AS n_cold_refs,
        string_agg('<<<' || upper(role) || '>>>' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS original FROM o GROUP BY conv_id)
SELECT conv_id, packed_prompt, n_cold_refs, {S.tokens('original')}::BIGINT AS original_tokens_est, {S.tokens('packed_prompt')}::BIGINT AS compacted_tokens_est, {S.tokens('packed_prompt')} <= 150 AS fits_budget FROM g""")
def compact_pack(spark, sf_dir):
    done = C.compact_messages(turns(spark, sf_dir), ["conv_id"], _EVICT)
    return done.summary.select("conv_id", "packed_prompt", "n_cold_refs", "original_tokens_est", "compacted_tokens_est", "fits_budget")


@query(f"WITH {_evicting(150, 1)} SELECT conv_id, ord::INT AS ord, role, text AS content FROM o")
def cold_ref_expand(spark, sf_dir):
    return C.expand_messages(C.compact_messages(turns(spark, sf_dir), ["conv_id"], _EVICT), ["conv_id"])


@query(rf"""WITH {LOGS}, {S.nested("fl", S.flat("logs", "user_id", "text", 2, 10, 128), f"SELECT user_id, text, dictionary_entries AS n, {S.PROMPT} AS p FROM packed")},
b AS (SELECT *, {S.tokens('text')} AS tok, {S.tokens('p')} AS ptok, length(text) >= 200 AND {S.tokens('text')} >= 120 AND ((len({_FILLED}) >= 8 AND len(list_distinct({_FILLED}))::DOUBLE / greatest(len({_FILLED}), 1) < 0.55)
  OR (regexp_matches(text, '{T.RECOVERABLE}') AND {S.tokens('text')} >= 80)) AS bulky FROM fl),
a AS (SELECT *, CASE WHEN NOT bulky THEN NULL WHEN n > 0 AND ptok < tok * 0.92::DOUBLE THEN 'lossless_dict' ELSE 'lossy_stub' END AS action FROM b),
h AS (SELECT *, CASE action WHEN 'lossless_dict' THEN '[cold_ref:c0 dict-encoded ~' || ptok || ' tok; full lossless body in cold_refs]' || chr(10) || p WHEN 'lossy_stub' THEN '[cold_ref:c0] ' || {S.stub('text')} ELSE text END AS shown,
             CASE WHEN action IS NULL THEN 0 ELSE 1 END AS refs FROM a),
k AS (SELECT *, chr(10) || chr(10) || '<<<ASSISTANT>>>' || chr(10) || 'Looking.' || chr(10) || chr(10) || '<<<USER>>>' || chr(10) || 'And now?' || chr(10) || chr(10) || '<<<ASSISTANT>>>' || chr(10) || 'Nothing.' || chr(10) || chr(10) || '<<<USER>>>' || chr(10) || 'Thanks.' AS rest FROM h),
o AS (SELECT *, '<<<USER>>>' || chr(10) || 'What happened?' || chr(10) || chr(10) || '<<<TOOL>>>' || chr(10) AS head, '<<<USER>>>' || chr(10) || '[cold_ref:c' || refs || '] ' || {S.stub("'What happened?'")} || chr(10) || chr(10) || '<<<TOOL>>>' || chr(10) AS stubbed,
             '[cold_ref:c' || (refs + 1) || '] ' || {S.stub('shown')} AS last FROM k),
e AS (SELECT *, CASE WHEN {S.tokens('(head || shown || rest)')} <= 2000 THEN 0 WHEN {S.tokens('(stubbed || shown || rest)')} <= 2000 THEN 1 ELSE 2 END AS gone FROM o),
q AS (SELECT *, CASE gone WHEN 0 THEN head || shown || rest WHEN 1 THEN stubbed || shown || rest ELSE stubbed || last || rest END AS packed_prompt, {S.tokens('(head || text || rest)')} AS was FROM e)
SELECT user_id, packed_prompt, was::BIGINT AS original_tokens_est, 6::BIGINT AS n_input_messages, coalesce(action, 'auto') AS mode, 6::BIGINT AS n_output_messages, (refs + gone)::BIGINT AS n_cold_refs,
       {S.tokens('packed_prompt')}::BIGINT AS compacted_tokens_est, {S.tokens('packed_prompt')} <= 2000 AS fits_budget, round({S.factor(S.tokens('packed_prompt'), 'was')}, 4) AS compression_factor FROM q""")
def compact_logs(spark, sf_dir):
    """Conversations with a bulky tool turn: what a user's log says, between a question and an answer."""
    log = logs(spark, sf_dir).select("user_id", F.lit(1).alias("turn"), F.lit("tool").alias("role"), F.col("text").alias("content"))
    ends = [(0, "user", "What happened?"), (2, "assistant", "Looking."), (3, "user", "And now?"), (4, "assistant", "Nothing."), (5, "user", "Thanks.")]
    rest = log.select("user_id", F.explode(F.array(*[F.struct(F.lit(t).alias("turn"), F.lit(r).alias("role"), F.lit(c).alias("content")) for t, r, c in ends])).alias("m"))
    return C.compact_messages(log.unionByName(rest.select("user_id", "m.*")), ["user_id"], C.CompactOptions(budget=2000)).summary


# --- evaluation -----------------------------------------------------------------------------------------


@query(f"""WITH d AS (SELECT doc_id, trim(regexp_replace(lower(text), '{S.SPACE}+', ' ', 'g')) AS t FROM documents),
b AS (SELECT item_id % 3 AS type, trim(regexp_replace(lower(text), '{S.SPACE}+', ' ', 'g')) AS p FROM benchmark)
SELECT doc_id, ('k' || type) AS type, count(*) FILTER (contains(t, p)) AS hit, count(*) AS total, round(count(*) FILTER (contains(t, p))::DOUBLE / count(*), 4) AS recall FROM d, b GROUP BY doc_id, type""")
def phrase_coverage(spark, sf_dir):
    gold = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("k"), (F.col("item_id") % 3).cast("string")).alias("type"), F.col("text").alias("phrase"))
    return E.phrase_coverage(table(spark, sf_dir, "documents").select("doc_id", "text"), gold, ["doc_id"])


@query("""WITH p AS (SELECT conv_id, list(DISTINCT role) AS raw, list(DISTINCT role) FILTER (length(text) <= 200) AS kept FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN kept IS NULL THEN 0.0::DOUBLE ELSE round(len(list_intersect(raw, kept))::DOUBLE / len(raw), 4) END AS layer_path_match FROM p""")
def layer_path_share(spark, sf_dir):
    """Which share of a conversation's roles is left if its turns of over 200 characters go."""
    paths = turns(spark, sf_dir).groupBy("conv_id").agg(F.collect_set("role").alias("raw"), F.collect_set(F.when(F.length("content") <= 200, F.col("role"))).alias("kept"))
    return paths.select("conv_id", E.layer_path_match(F.col("kept"), F.col("raw")).alias("layer_path_match"))


@query(f"""WITH g AS (SELECT conv_id, CASE WHEN role = 'user' THEN 'goal' ELSE 'outcome' END AS type, turn, {S.folded('text')} AS g FROM conversations),
l AS (SELECT conv_id, type, i, {S.folded('s')} AS l FROM (
  SELECT conv_id, CASE WHEN turn % 2 = 0 THEN 'goal' ELSE 'outcome' END AS type, turn * 100000 + unnest(range(len({S.sentences('text')}))) AS i, unnest({S.sentences('text')}) AS s FROM conversations)),
m AS (SELECT l.conv_id, type, i, min(turn) AS turn FROM l JOIN g USING (conv_id, type) WHERE contains(l, g) OR contains(g, l) OR (length(g) > 12 AND contains(l, left(g, 20))) GROUP BY l.conv_id, type, i),
t AS (
  SELECT conv_id, sum(tp) AS tp, sum(said - good) AS fp, sum(gold - tp) AS fn FROM (
    SELECT conv_id, type, coalesce(said, 0) AS said, coalesce(gold, 0) AS gold, coalesce(tp, 0) AS tp, coalesce(good, 0) AS good
    FROM (SELECT conv_id, type, count(*) AS said FROM l GROUP BY ALL) FULL JOIN (SELECT conv_id, type, count(*) AS gold FROM g GROUP BY ALL) USING (conv_id, type)
    LEFT JOIN (SELECT conv_id, type, count(DISTINCT turn) AS tp, count(*) AS good FROM m GROUP BY ALL) USING (conv_id, type)) GROUP BY conv_id)
SELECT conv_id, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, CASE WHEN tp + fp > 0 THEN round(tp::DOUBLE / (tp + fp), 4) ELSE 1.0 END AS micro_precision, CASE WHEN tp + fn > 0 THEN round(tp::DOUBLE / (tp + fn), 4) ELSE 1.0 END AS micro_recall FROM t""")
def label_micro(spark, sf_dir):
    """The sentences of even turns as goals, of odd ones as outcomes, against what the roles say."""
    talk = turns(spark, sf_dir)
    kind = F.when(F.col("turn") % 2 == 0, "goal").otherwise("outcome")
    labels = talk.select("conv_id", kind.alias("type"), F.explode(T.sentences(F.col("content"))).alias("label"))
    gold = talk.select("conv_id", F.when(F.col("role") == "user", "goal").otherwise("outcome").alias("type"), F.col("turn").alias("ord"), F.col("content").alias("phrase"))
    return E.micro_precision_recall(E.label_matches(labels, gold, ["conv_id"]), ["conv_id"])


_PACKED = """pk AS (SELECT conv_id, string_agg('<<<' || upper(role) || '>>>' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS t, count(*) AS n FROM conversations GROUP BY conv_id)"""


@query(f"WITH {_PACKED}, h AS (SELECT conv_id, t, {S.head_tail('t', '100')} AS c FROM pk) SELECT conv_id, {S.typology('t', 'c', T.CUES)} AS typology_jaccard FROM h")
def typology_jaccard(spark, sf_dir):
    whole = C.pack_messages(turns(spark, sf_dir), ["conv_id"]).select("conv_id", "packed")
    cut = T.head_tail(F.col("packed"), F.lit(100))
    return whole.select("conv_id", E.typology_jaccard(F.col("packed"), cut).alias("typology_jaccard"))


_PROTECTED = f"""{_PACKED}, se AS (SELECT conv_id, t, {S.sentences('t')} AS s FROM pk),
pr AS (SELECT conv_id, t, list_filter(s, lambda x: {S.worth('x', T.HIGH_VALUE)}) AS k, list_filter(s, lambda x: NOT {S.worth('x', T.HIGH_VALUE)}) AS r FROM se),
pt AS (SELECT conv_id, t, array_to_string(k, chr(10)) AS keep_blob, array_to_string(r, chr(10)) AS rest_blob, len(k)::INT AS n_keep, len(r)::INT AS n_rest FROM pr)"""


@query(f"WITH {_PROTECTED} SELECT conv_id, keep_blob, rest_blob, n_keep, n_rest FROM pt")
def protect_compact(spark, sf_dir):
    whole = C.pack_messages(turns(spark, sf_dir), ["conv_id"]).select("conv_id", F.col("packed").alias("text"))
    return E.protect_sentences(whole, ["conv_id"])


def gold_phrases(messages: DataFrame) -> DataFrame:
    """A conversation's user turns as its goals, its other turns as outcomes."""
    kind = F.when(F.col("role") == "user", "goal").otherwise("outcome")
    return messages.where("role <> 'system'").select("conv_id", kind.alias("type"), F.col("content").alias("phrase"))


@query(f"""WITH {_PROTECTED}, {_evicting(200, 3)},
{S.nested("cm", S.flat("pk", "conv_id", "t", 2, 10, 128), f"SELECT conv_id, {S.PROMPT} AS p FROM packed")},
fr AS (SELECT * FROM pt WHERE {S.strip('rest_blob')} <> ''),
{S.nested("fi", S.flat("fr", "conv_id", "rest_blob", 2, 10, 128), f"SELECT conv_id, dictionary_entries AS n, {S.PROMPT} AS p FROM packed")},
ev AS (SELECT conv_id, string_agg('<<<' || upper(role) || '>>>' || chr(10) || final, chr(10) || chr(10) ORDER BY ord) AS v, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS r FROM o GROUP BY conv_id),
al AS (SELECT conv_id, greatest(200, {S.tokens('v')}) AS allowed FROM ev),
en AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
sh AS (SELECT conv_id, string_agg('<<<' || upper(role) || '>>>' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS s FROM en WHERE n <= 4 OR i <= 2 OR i > n - 2 GROUP BY conv_id),
tr AS (SELECT conv_id, {S.head_tail('s', 'allowed')} AS v FROM sh JOIN al USING (conv_id)),
se2 AS (SELECT pt.*, allowed, coalesce(fi.n, 0) > 0 AS coded, fi.p AS filler, keep_blob || CASE WHEN rest_blob <> '' THEN chr(10) || rest_blob ELSE '' END AS plain FROM pt JOIN al USING (conv_id) LEFT JOIN fi USING (conv_id)),
vi AS (SELECT *, CASE WHEN coded THEN keep_blob || chr(10) || chr(10) || '<<<COMPACTED_FILLER dict-encoded>>>' || chr(10) || filler ELSE plain END AS v, CASE WHEN coded THEN keep_blob || chr(10) || rest_blob ELSE plain END AS r FROM se2),
ov AS (SELECT *, {S.tokens('v')} > allowed AND filler IS NOT NULL AS over FROM vi),
co AS (
  SELECT conv_id, 'raw' AS condition, t AS v, t AS r, {S.tokens('t')} AS after, true AS exact FROM pk
  UNION ALL SELECT conv_id, 'compress', p, t, {S.tokens('p')}, true FROM cm JOIN pk USING (conv_id)
  UNION ALL SELECT conv_id, 'compact', v, r, {S.tokens('v')}, r = t FROM ev JOIN pk USING (conv_id)
  UNION ALL SELECT conv_id, 'lossy_truncate', v, v, {S.tokens('v')}, v = t FROM tr JOIN pk USING (conv_id)
  UNION ALL SELECT conv_id, 'protect_compact', w, r, {S.tokens('w')}, NOT over FROM (
    SELECT *, CASE WHEN over THEN keep_blob || chr(10) || chr(10) || '[filler dict cold ~' || {S.tokens('filler')} || ' tok omitted from hot set]' ELSE v END AS w FROM ov)),
go AS (SELECT conv_id, {S.folded('text')} AS p FROM conversations WHERE role <> 'system'),
fo AS (SELECT *, {S.folded('v')} AS fv, {S.folded('r')} AS fr2 FROM co),
re AS (SELECT conv_id, condition, round(count(*) FILTER (contains(fv, p))::DOUBLE / count(*), 4) AS rv, round(count(*) FILTER (contains(fr2, p))::DOUBLE / count(*), 4) AS rr FROM fo JOIN go USING (conv_id) GROUP BY conv_id, condition),
sc AS (SELECT co.condition, {S.tokens('t')} AS before, after, round({S.factor('after', S.tokens('t'))}, 4) AS ratio, exact, coalesce(rv, 1.0::DOUBLE) AS rv, coalesce(rr, 1.0::DOUBLE) AS rr,
              {S.typology('t', "(CASE WHEN co.condition = 'compress' THEN r ELSE v END)", T.CUES)} AS ty FROM co JOIN pk USING (conv_id) LEFT JOIN re ON re.conv_id = co.conv_id AND re.condition = co.condition)
SELECT condition, count(*) AS n, round(avg(before), 4) AS avg_tokens_before, round(avg(after), 4) AS avg_tokens_after, round(avg(ratio), 4) AS avg_token_ratio, round(avg(exact::INT), 4) AS lossless_exact_rate,
       round(avg(rv), 4) AS avg_gold_phrase_recall_visible, round(avg(rr), 4) AS avg_gold_phrase_recall_restored, 1.0::DOUBLE AS avg_mid_constraint_recall_visible, round(avg(ty), 4) AS avg_typology_jaccard FROM sc GROUP BY condition""")
def condition_summary(spark, sf_dir):
    talk = turns(spark, sf_dir)
    scored = E.score_conditions(E.run_conditions(talk, ["conv_id"], budget=200), gold_phrases(talk), talk, ["conv_id"])
    return E.summarise(scored)
