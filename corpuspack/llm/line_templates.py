"""Line deduplication by a log-template tree, with DataFrame functions only.

The tree has a fixed depth: the number of tokens of a line, then its first ``LEADING``
tokens.  At a leaf its lines are merged by the tokens in which they agree: what follows
the leading tokens is cut in ``FIELDS`` fields at most, a field whose tokens another
document's line of the leaf has in the same place is constant, and the others are
variable and are generalised.  Tokens that hold a digit are variable from the outset.
A line whose constant tokens are at least ``AGREE`` of all belongs to the template of its
leaf and its constant fields; a template that recurs across documents is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch_path

#: Leading tokens that the tree looks at; fields that the rest of a line is cut in, at most.
LEADING, FIELDS = 3, 8
#: Lines of fewer tokens are only ever equal to others: no field of theirs varies but for digits.
SHORT = 8
#: Share of a line's tokens that must be constant, in tenths.
AGREE = 8

#: Lines of more tokens are also parsed sentence by sentence where passages are looked for.
LONG = 50
#: Where a sentence of a line ends, and the mark that is set there while a text is parsed.
SENTENCE, MARK = r"([.!?][ \t\r\x0B\x0C]+)", "\x01"

#: A token with a digit, and the white space inside a line (fixed values).
VARIABLE = r"(?<![^ \n\x01])[^ \n\x010-9]*[0-9][^ \n\x01]*"
BLANKS = r"[ \t\r\x0B\x0C]+"


def normalised(text: Column) -> Column:
    """A text with variable fields as ``<*>``, and with single spaces and none at the ends of lines."""
    spaced = F.regexp_replace(text, BLANKS, " ")
    return F.regexp_replace(F.regexp_replace(spaced, VARIABLE, "<*>"), r" ?\n ?", "\n")


def units(docs: DataFrame, sentences: bool = False) -> DataFrame:
    """``(doc_id, th, pos, part, n, h, leaf, fields)`` for each filled line of a text, as a table in the shared folder.

    ``th`` is the text's hash, ``pos`` the line, ``part`` -1, ``n`` the number of tokens,
    ``h`` the hash of the normalised line, ``leaf`` that of its place in the tree and
    ``fields`` those of what follows the leading tokens.  With ``sentences`` the sentences of
    long lines come as well, if they are not short; they have no ``leaf``.
    """
    text = F.col("text")
    if sentences:  # a text that has the mark already is parsed in lines alone
        text = F.when(F.contains(text, F.lit(MARK)), text).otherwise(F.regexp_replace(text, SENTENCE, f"$1{MARK}"))
    lines = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split(normalised(text), "\n")).alias("pos", "line"))
    if sentences:
        tokens = F.regexp_count("line", F.lit(" ")) + 1
        whole = F.array(F.struct(F.lit(-1).alias("part"), F.translate("line", MARK, "").alias("line")))
        parts = F.transform(F.split("line", MARK), lambda x, i: F.struct(i.alias("part"), x.alias("line")))
        lines = lines.select("doc_id", "th", "pos", F.inline(F.when(tokens > LONG, F.concat(whole, parts)).otherwise(whole)))
    else:
        lines = lines.withColumn("part", F.lit(-1))
    lines = lines.withColumn("line", F.trim("line")).where("line <> ''").withColumn("t", F.split("line", " ")).withColumn("n", F.size("t"))
    lines = lines.where((F.col("part") < 0) | (F.col("n") >= SHORT))
    rest, count = F.col("n") - LEADING, F.least(F.lit(FIELDS), F.col("n") - LEADING)
    bound = lambda j: F.floor(j * rest / count).cast("int")
    fields = F.transform(F.sequence(F.lit(0), count - 1), lambda j: F.hash(F.slice("t", bound(j) + LEADING + 1, bound(j + 1) - bound(j))))
    short = F.col("n") < SHORT
    leaf = F.when(short, F.xxhash64("n", "line")).otherwise(F.xxhash64("n", F.slice("t", 1, LEADING)))
    path = scratch_path(docs.sparkSession, "lines")
    lines.select(
        "doc_id", "th", "pos", "part", "n", F.xxhash64("line").alias("h"), F.when(F.col("part") < 0, leaf).alias("leaf"),
        F.when((F.col("part") < 0) & ~short, fields).alias("fields"),
    ).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


#: The documents of a group: least and greatest id, and whether one has none.
SPAN = (F.min, "lo"), (F.max, "hi"), (F.max, "none")


def _span(fresh: bool = False) -> list[Column]:
    """The aggregates of :data:`SPAN`, from ids if ``fresh`` and from spans otherwise."""
    of = {"lo": F.col("doc_id"), "hi": F.col("doc_id"), "none": F.col("doc_id").isNull()} if fresh else {c: F.col(c) for _, c in SPAN}
    return [f(of[c]).alias(c) for f, c in SPAN]


def _recurs() -> Column:
    """Whether a span has two documents or more; null ids are one document."""
    return F.coalesce((F.col("lo") != F.col("hi")) | F.col("none"), F.lit(False)) & F.col("lo").isNotNull()


def recurring(lines: DataFrame) -> DataFrame:
    """``(h, first)``: the lines whose template recurs across documents, and the least document that has it."""
    leaves = lines.where("leaf is not null").groupBy("leaf").agg(*_span(True), F.min("h").alias("h"), F.max("h").alias("other")).where(_recurs())
    leaves = cut(leaves.select("leaf", "h", F.col("lo").alias("first"), (F.col("h") != F.col("other")).alias("mixed")))
    same = leaves.where("not mixed").select("h", "first")

    mixed = lines.where("fields is not null").join(leaves.where("mixed").select("leaf"), "leaf")
    # by the line alone, which knows its leaf, so that a leaf of very many lines is dealt anew
    forms = cut(mixed.groupBy("h").agg(F.any_value("leaf").alias("leaf"), F.any_value("n").alias("n"), F.any_value("fields").alias("fields"), *_span(True)))
    placed = forms.select("leaf", "h", "n", "lo", "hi", "none", F.size("fields").alias("k"), F.posexplode("fields").alias("j", "field"))
    constant = placed.groupBy("leaf", "j", "field").agg(*_span()).where(_recurs()).select("leaf", "j", "field")
    rest = F.col("n") - LEADING
    size = F.floor((F.col("j") + 1) * rest / F.col("k")) - F.floor(F.col("j") * rest / F.col("k"))
    agreed = placed.join(constant, ["leaf", "j", "field"]).groupBy("leaf", "h").agg(
        F.any_value("n").alias("n"), *_span(), F.sum(size).alias("constant"),
        F.xxhash64(F.sort_array(F.collect_list(F.struct("j", "field")))).alias("fields"),  # FIELDS at most
    )
    agreed = cut(agreed.where((F.col("constant") + LEADING) * 10 >= F.col("n") * AGREE).select("leaf", "fields", "h", "lo", "hi", "none"))
    templates = agreed.groupBy("leaf", "fields").agg(*_span()).where(_recurs()).select("leaf", "fields", F.col("lo").alias("first"))
    return same.union(agreed.join(templates, ["leaf", "fields"]).select("h", "first"))


def _drops(lines: DataFrame, found: DataFrame, keep_first: bool) -> DataFrame:
    """``(id, th, drop, parts)``: which lines and parts a text is to lose."""
    # a table of its own, so that the join can split a line that very many documents share
    hit = lines.select("doc_id", "th", "pos", "part", "h").join(cut(found), "h")
    if keep_first:
        hit = hit.where(~F.col("doc_id").eqNullSafe(F.col("first")))
    return hit.groupBy(F.col("doc_id").alias("id"), "th").agg(
        F.collect_set(F.when(F.col("part") < 0, F.col("pos"))).alias("drop"),
        F.collect_set(F.when(F.col("part") >= 0, F.struct("pos", "part"))).alias("parts"),
    )


def _met(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """``(row, drop, parts)``: each row of ``docs`` as a struct, so that its columns may have any names."""
    on = F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("row.text") == F.col("th"))
    return docs.select(F.struct("*").alias("row")).join(drops, on, "left").select("row", "drop", "parts")


def _once(value: Column, f) -> Column:
    """``f`` of a value that is computed once; an expression in a lambda would be computed at every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _stay(lines: Column, drop: Column) -> Column:
    """The elements whose places aren't in ``drop``."""
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
    return _once(F.struct(lines.alias("lines"), places.alias("places")), lambda x: F.transform(x["places"], lambda i: F.get(x["lines"], i)))


def drop_recurring_lines(docs: DataFrame, keep_first: bool = True) -> DataFrame:
    """``docs`` without the lines whose template recurs in two documents or more.

    ``text`` has the remaining lines, and ``n_lines`` and ``n_dropped`` are added;
    all rows and other columns stay (columns of these two names are replaced).
    With ``keep_first`` the document with the smallest ``doc_id`` keeps its lines of
    a template, so that of a group of copies one stays whole.

    Lines end at ``\\n``.  Blank lines are never dropped.  Lines travel as hashes, and
    only places of lines come back to the documents.  Leaves, fields and templates are
    aggregated before the shuffle, and what joins on them are tables of their own, so a
    line or a leaf that very many documents share is split among tasks.

    A null text stays null, with 0 lines; an empty text is one blank line.  Rows that
    repeat a ``doc_id`` are one document, and keep their lines of a template together if
    the id is the smallest; null ids come last and are one document.  An empty table
    gives an empty result.
    """
    plain = docs.drop("n_lines", "n_dropped")
    lines = units(plain)
    met = _met(plain, _drops(lines, recurring(lines), keep_first))
    gone, own = F.coalesce(F.size("drop"), F.lit(0)).cast("long"), F.col("row.text")
    left = F.array_join(_stay(F.split(own, "\n"), F.col("drop")), "\n")
    text = F.when(F.col("drop").isNull(), own).otherwise(left)
    n_lines = F.coalesce(F.length(own) - F.length(F.replace(own, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    return met.select(*[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in plain.columns], n_lines.alias("n_lines"), gone.alias("n_dropped"))


def drop_recurring_passages(docs: DataFrame, keep_first: bool = True) -> DataFrame:
    """``docs`` without lines, and without sentences of long lines, that recur in two documents or more.

    As :func:`drop_recurring_lines`, but a line of more than ``LONG`` tokens is also
    parsed in sentences.  Those of ``SHORT`` tokens or more go where another document has
    the same one, variable tokens aside, as a sentence or as a line, so that a passage is
    found wherever it stands in a line.  What is left of a line stays one line; a line of
    which nothing is left goes.  No counts are added.
    """
    lines = units(docs, sentences=True)
    exact = lines.groupBy("h").agg(*_span(True)).where(_recurs()).select("h", F.col("lo").alias("first"))
    # a line can be in both tables: the template's first document is the lesser
    found = exact.unionByName(recurring(lines)).groupBy("h").agg(F.min("first").alias("first"))
    met = _met(docs, _drops(lines, found, keep_first))

    own = F.col("row.text")
    texts_own = F.contains(own, F.lit(MARK))  # then there are no parts, and the mark stays
    marked = F.split(F.when(texts_own, own).otherwise(F.regexp_replace(own, SENTENCE, f"$1{MARK}")), "\n")
    lost = F.array_distinct(F.transform("parts", lambda p: p["pos"]))

    def rest(x: Column, i: Column) -> Column:
        """A line without its lost parts; null if none is left of those that it had."""
        gone = F.transform(F.filter("parts", lambda p: p["pos"] == i), lambda p: p["part"])
        left = F.array_join(_stay(F.split(x, MARK), gone), "")
        return F.when(~F.array_contains(lost, i), F.translate(x, MARK, "")).when(left != "", left)

    split = F.when(texts_own, F.split(own, "\n")).otherwise(F.transform(marked, rest))
    left = F.array_join(F.filter(_stay(split, F.col("drop")), lambda x: x.isNotNull()), "\n")
    text = F.when(F.col("drop").isNull(), own).otherwise(left)
    return met.select(*[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, nullif(trim(norm), '') AS norm FROM (
    SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line, unnest(norms) AS norm FROM (
      SELECT doc_id, string_split(text, chr(10)) AS lines,
             string_split(regexp_replace(regexp_replace(regexp_replace(text, '[ \t\r\x0B\x0C]+', ' ', 'g'), '[^ \n]*[0-9][^ \n]*', '<*>', 'g'), ' ?\n ?', chr(10), 'g'), chr(10)) AS norms
      FROM documents))),
t AS (SELECT doc_id, i, norm, string_split(norm, ' ') AS t, len(string_split(norm, ' ')) AS n FROM l WHERE norm IS NOT NULL),
f AS (
  SELECT norm, any_value(n) AS n, any_value(t) AS t, min(doc_id) AS lo, max(doc_id) AS hi,
         any_value(CASE WHEN n < 8 THEN norm ELSE n || ' ' || array_to_string(t[1:3], ' ') END) AS leaf
  FROM t GROUP BY norm),
s AS (
  SELECT norm, n, leaf, lo, hi, j, ((j + 1) * (n - 3)) // k - (j * (n - 3)) // k AS size,
         array_to_string(t[4 + (j * (n - 3)) // k : 3 + ((j + 1) * (n - 3)) // k], ' ') AS field
  FROM (SELECT *, least(8, n - 3) AS k, unnest(range(0, least(8, n - 3))) AS j FROM f WHERE n >= 8)),
c AS (SELECT leaf, j, field FROM s GROUP BY leaf, j, field HAVING min(lo) <> max(hi)),
m AS (
  SELECT norm, lo, hi, leaf || chr(10) || string_agg(j || ' ' || field, chr(10) ORDER BY j) AS template
  FROM s JOIN c USING (leaf, j, field) GROUP BY norm, n, leaf, lo, hi HAVING (3 + sum(size)) * 10 >= n * 8
  UNION ALL SELECT norm, lo, hi, norm FROM f WHERE n < 8),
r AS (SELECT template, min(lo) AS first FROM m GROUP BY template HAVING min(lo) <> max(hi)),
k AS (
  SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (r.first IS NOT NULL AND r.first <> l.doc_id) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (r.first IS NULL OR r.first = l.doc_id), '') AS text
  FROM l LEFT JOIN m ON l.norm = m.norm LEFT JOIN r USING (template) GROUP BY l.doc_id)
SELECT d.doc_id, k.text, d.lang, d.source, d.n_chars, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_dropped, 0)::BIGINT AS n_dropped
FROM documents d LEFT JOIN k USING (doc_id)
"""
