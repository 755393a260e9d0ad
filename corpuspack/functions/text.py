"""Text expressions: whitespace units, lines, token estimates, fingerprints, templates, stubs.

All take and return columns and stay inside the JVM.  Character classes are spelled out,
since engines differ in what ``\\s`` and ``\\w`` mean.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Character classes (fixed values): Unicode white space, line boundaries, non-word characters.
SPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
NON_WORD = r"[^\p{L}\p{N}_]+"
DIGITS = r"\p{Nd}+"
HEX_RUN = r"(?i)[0-9a-f]{8,}"

#: What marks recoverable tool output (fixed pattern).
RECOVERABLE = r"(?i)(tool[_ ]?result|function[_ ]?response|observation|```json|status=\d{3}|request_id=|latency_ms=)"
#: What marks a sentence worth keeping (fixed pattern).
HIGH_VALUE = (
    r"(?i)\b(goal|constraint|must not|cannot|deadline|budget|require|outcome|result|objective|aim to|i want|i need)\b"
)
#: Cues of each typology (fixed patterns).
CUES = {
    "goal": r"(?i)\b(goal|i want|i need|aim to|objective|intend|purpose)\b[^\n]{0,80}",
    "constraint": r"(?i)\b(cannot|can't|must not|constraint|budget|deadline|require|only if|unless)\b[^\n]{0,80}",
    "outcome": r"(?i)\b(outcome|result|therefore|consequently|yields|leads to)\b[^\n]{0,80}",
}


def length(c: Column) -> Column:
    """Number of characters, as long."""
    return F.length(c).cast("long")


def units(c: Column) -> Column:
    """The runs of a text without white space, in order."""
    return F.filter(F.split(c, SPACE + "+"), lambda x: x != "")


def lines(c: Column) -> Column:
    """The lines of a text, without their ends; a final line end opens no further line."""
    parts = F.split(c, LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+$", "")


def filled_lines(c: Column) -> Column:
    """The stripped lines of a text that aren't blank."""
    return F.filter(F.transform(lines(c), strip), lambda x: x != "")


def first_line(c: Column, size: int) -> Column:
    """The first line that isn't blank, stripped and cut to ``size`` characters; empty if there is none."""
    return F.coalesce(F.substring(F.get(filled_lines(c), F.lit(0)), 1, size), F.lit(""))


def token_estimate(c: Column) -> Column:
    """Tokens of a text: a quarter of its characters, rounded up; 0 for an empty one."""
    return F.floor((length(c) + 3) / 4)


def ratio(packed: Column, original: Column) -> Column:
    return F.when(original > 0, 1 - packed / original).otherwise(0.0)


def factor(packed: Column, original: Column) -> Column:
    return F.when(packed > 0, original / packed).otherwise(0.0)


def savings(count: Column, size: Column) -> Column:
    """What a pattern saves in characters, with meta tokens of six."""
    return (count - 1) * (size - 6) - 6


def one_line(c: Column) -> Column:
    """A text with its line feeds written as ``\\n``."""
    return F.replace(c, F.lit("\n"), F.lit("\\n"))


def hierarchical_fingerprint(c: Column) -> Column:
    return F.concat(F.lit("L"), F.length(c), F.lit("|"), first_line(c, 80))


def page_fingerprint(c: Column) -> Column:
    return F.concat(F.left(F.sha1(F.encode(c, "UTF-8")), F.lit(12)), F.lit("|"), first_line(c, 60))


def template_id(c: Column) -> Column:
    """Hash of a text with digits, then long hexadecimal runs, masked; digits come first on purpose."""
    masked = F.regexp_replace(F.regexp_replace(c, DIGITS, "#"), HEX_RUN, "#hex#")
    return F.left(F.sha1(F.encode(masked, "UTF-8")), F.lit(16))


def looks_repetitive(c: Column) -> Column:
    """Whether a turn of 200 characters or more has mostly repeated lines, or recoverable content of 80 tokens or more."""
    filled = F.filter(lines(c), lambda x: strip(x) != "")
    many = (F.size(filled) >= 8) & (F.size(F.array_distinct(filled)) / F.greatest(F.size(filled), F.lit(1)) < 0.55)
    return (F.length(c) >= 200) & (many | (c.rlike(RECOVERABLE) & (token_estimate(c) >= 80)))


def lossy_stub(c: Column, preview: int = 240) -> Column:
    """A one-line stand-in for a turn: its size and its first two and last lines."""
    filled = filled_lines(c)
    tail = F.when(F.size(filled) > 3, F.slice(filled, -1, 1)).otherwise(F.array().cast("array<string>"))
    shown = F.array_join(F.concat(F.slice(filled, 1, 2), tail), " | ")
    shown = F.when(F.length(shown) > preview, F.concat(F.left(shown, F.lit(preview - 1)), F.lit("…"))).otherwise(shown)
    return F.concat(
        F.lit("[compacted stub: ~"), token_estimate(c).cast("string"), F.lit(" tokens, "), F.size(filled).cast("string"),
        F.lit(" lines; recoverable detail omitted] "), shown,
    )


def query_tokens(c: Column) -> Column:
    """The lower-case words of two characters or more of a query."""
    return F.filter(F.split(F.lower(c), NON_WORD), lambda x: F.length(x) >= 2)


def occurrences(text: Column, token: Column) -> Column:
    """How often ``token`` (not empty) occurs in ``text`` without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, token, F.lit("")))) / F.length(token)).cast("long")


def folded(c: Column) -> Column:
    """A text in lower case with single spaces, stripped."""
    return F.trim(F.regexp_replace(F.lower(c), SPACE + "+", " "))


def sentences(c: Column) -> Column:
    """A text split at white space behind an end of sentence or line."""
    return F.split(c, rf"(?<=[.!?\n]){SPACE}+")


def cues(c: Column, kind: str) -> Column:
    """The distinct folded phrases of a text that begin with a cue of ``kind``."""
    found = F.regexp_extract_all(c, F.lit(CUES[kind]), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: folded(F.left(x, F.lit(100)))))


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over that of the union; 1 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def head_tail(c: Column, budget: Column) -> Column:
    """A text cut to about ``budget`` tokens: half of the characters from the head, two fifths from the tail."""
    chars = F.greatest(F.lit(200), budget * 4)
    head, tail = F.floor(chars * 0.5).cast("int"), F.floor(chars * 0.4).cast("int")
    cut = F.concat(
        F.left(c, head), F.lit("\n\n…[TRUNCATED "), (F.length(c) - head - tail).cast("string"), F.lit(" chars]…\n\n"), F.right(c, tail)
    )
    return F.when((token_estimate(c) > budget) & (head + tail < F.length(c)), cut).otherwise(c)


def json_text(c: Column) -> Column:
    """A string as JSON, in quotes."""
    whole = F.to_json(F.struct(c.alias("s")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


_ENTRIES = "ARRAY<STRUCT<ord: INT, meta: STRING, pattern: STRING>>"


def register(spark: SparkSession) -> None:
    """Makes SQL functions of the session: ``token_est``, ``template_id``, ``page_fingerprint``, ``encode_dict``, ``decode_dict``, and the table function ``line_pager``.

    ``encode_dict(text, dictionary)`` and ``decode_dict(encoded, dictionary)`` take the entries of a dictionary as they are packed.
    ``line_pager(TABLE(texts) PARTITION BY (path), page_chars)`` gives ``path``, ``page_id`` and ``text`` of a table with ``path`` and ``text``.
    """
    from ..operators.paging import LinePager

    def folded_replace(name: str, take: str, give: str) -> str:
        order = f"array_sort(transform(d, e -> named_struct('by', -length(e.{take}), 'ord', e.ord, 'take', e.{take}, 'give', e.{give})))"
        return (
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING, d {_ENTRIES}) RETURNS STRING RETURN "
            f"aggregate({order}, t, (acc, e) -> CASE WHEN e.take = '' THEN acc ELSE replace(acc, e.take, e.give) END)"
        )

    # SQL user-defined functions are expanded by the optimiser; nothing runs outside the JVM
    shown = f"filter(transform(split(t, r'{LINE_BREAK}'), x -> regexp_replace(x, r'^{SPACE}+|{SPACE}+$', '')), x -> x <> '')"
    for sql in (
        "CREATE OR REPLACE TEMPORARY FUNCTION token_est(t STRING) RETURNS BIGINT RETURN (length(t) + 3) div 4",
        "CREATE OR REPLACE TEMPORARY FUNCTION template_id(t STRING) RETURNS STRING RETURN "
        r"left(sha1(encode(regexp_replace(regexp_replace(t, r'\p{Nd}+', '#'), r'(?i)[0-9a-f]{8,}', '#hex#'), 'UTF-8')), 16)",
        "CREATE OR REPLACE TEMPORARY FUNCTION page_fingerprint(t STRING) RETURNS STRING RETURN "
        f"concat(left(sha1(encode(t, 'UTF-8')), 12), '|', coalesce(substring(get({shown}, 0), 1, 60), ''))",
        folded_replace("encode_dict", "pattern", "meta"),
        folded_replace("decode_dict", "meta", "pattern"),
    ):
        spark.sql(sql)
    spark.udtf.register("line_pager", LinePager)
