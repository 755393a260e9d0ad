"""DuckDB SQL pieces that the catalogue's queries are held against."""

from __future__ import annotations

SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def units(t: str) -> str:
    return f"list_filter(string_split_regex({t}, '{SPACE}+'), lambda x: x <> '')"


def lines(t: str) -> str:
    parts = f"string_split_regex({t}, '{LINE_BREAK}')"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END)"


def strip(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def filled(t: str) -> str:
    return f"list_filter(list_transform({lines(t)}, lambda x: {strip('x')}), lambda x: x <> '')"


def tokens(t: str) -> str:
    return f"((length({t}) + 3) // 4)"


def ratio(packed: str, original: str) -> str:
    return f"(CASE WHEN {original} > 0 THEN 1 - {packed}::DOUBLE / {original} ELSE 0.0::DOUBLE END)"


def factor(packed: str, original: str) -> str:
    return f"(CASE WHEN {packed} > 0 THEN {original}::DOUBLE / {packed} ELSE 0.0::DOUBLE END)"


def _ranked(name: str, src: int, key: str, min_freq: int, limit: int, found: str) -> str:
    return f"""{name} AS (
  SELECT {key}, {src} AS src, pattern, cnt, len, score, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, len DESC, cnt DESC, {found}) AS rank
  FROM (SELECT *, (cnt - 1) * (len - 6) - 6 AS score FROM {name}_counted WHERE cnt >= {min_freq}) WHERE score > 0
  QUALIFY rank <= {limit})"""


def ngrams(source: str, key: str, text: str, min_freq: int, max_len: int, limit: int = 500) -> str:
    """CTEs up to ``ngrams``: the n-grams of each text of ``source``, all lengths counted in full."""
    ahead = ", ".join(f"lead(u, {k}) OVER w AS u{k}" for k in range(1, max_len))
    each = " UNION ALL ".join(
        f"SELECT {key}, i, {n} AS n, u || {' || '.join(f"' ' || u{k}" for k in range(1, n))} AS pattern FROM ngrams_ahead WHERE u{n - 1} IS NOT NULL"
        for n in range(2, max_len + 1)
    )
    return f"""
ngrams_units AS (SELECT {key}, unnest({units(text)}) AS u, unnest(range(len({units(text)}))) AS i FROM {source}),
ngrams_ahead AS (SELECT {key}, i, u, {ahead} FROM ngrams_units WINDOW w AS (PARTITION BY {key} ORDER BY i)),
ngrams_all AS ({each}),
ngrams_counted AS (
  SELECT {key}, pattern, count(*) AS cnt, length(pattern) AS len, min(-n * 100000000 + i) AS found FROM ngrams_all WHERE length(pattern) >= 8 GROUP BY {key}, pattern),
{_ranked("ngrams", 0, key, min_freq, limit, "found")}"""


def whole_lines(source: str, key: str, text: str, min_freq: int, limit: int = 300) -> str:
    return f"""
lines_all AS (SELECT {key}, unnest({lines(text)}) AS pattern, unnest(range(len({lines(text)}))) AS i FROM {source}),
lines_counted AS (SELECT {key}, pattern, count(*) AS cnt, length(pattern) AS len, min(i) AS found FROM lines_all WHERE length(pattern) >= 16 GROUP BY {key}, pattern),
{_ranked("lines", 1, key, min_freq, limit, "found")}"""


def chars(source: str, key: str, text: str, min_freq: int, limit: int = 200) -> str:
    return f"""
chars_all AS (
  SELECT {key}, a, p, substr({text}, p + 1, n) AS pattern
  FROM (SELECT {key}, {text}, a, n, unnest(range(0, length({text}) - n + 1, greatest(1, n // 4))) AS p
        FROM {source}, (VALUES (0, 32), (1, 24), (2, 16), (3, 12)) w(a, n) WHERE length({text}) >= n)),
chars_counted AS (SELECT {key}, pattern, count(*) AS cnt, length(pattern) AS len, min(a * 100000000 + p) AS found FROM chars_all GROUP BY {key}, pattern),
{_ranked("chars", 2, key, min_freq, limit, "found")}"""


def merged(key: str, groups: list[str]) -> str:
    every = " UNION ALL ".join(f"SELECT * FROM {g}" for g in groups)
    return f"""
merged AS (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, len DESC, cnt DESC, place) AS rank FROM (
    SELECT *, (cnt - 1) * (len - 6) - 6 AS score FROM (
      SELECT {key}, pattern, max(cnt) AS cnt, max(len) AS len, min(src * 10000 + rank) AS place FROM ({every}) GROUP BY {key}, pattern)))"""


def gated(source: str, key: str, text: str, max_size: int, candidates: str = "merged") -> str:
    """The chosen entries as ``entries``, by the tiers of name lengths."""

    def passes(letters: int) -> str:
        size = f"(frame + {letters})"
        return f"(cnt * (len - {size}) - ({size} + len + 8) > 0)"

    return f"""
styles AS (SELECT {key}, CASE WHEN contains({text}, '⟦') OR contains({text}, '⟧') THEN 'ascii' ELSE 'unicode' END AS style FROM {source}),
framed AS (
  SELECT *, CASE WHEN style = 'unicode' THEN '⟦' ELSE '<<PD' END AS pre, CASE WHEN style = 'unicode' THEN '⟧' ELSE '>>' END AS suf,
         CASE WHEN style = 'unicode' THEN 2 ELSE 6 END AS frame FROM {candidates} JOIN styles USING ({key})),
tier1 AS (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY rank) AS c1 FROM framed WHERE NOT contains(pattern, pre) AND NOT contains(pattern, suf) AND {passes(1)}),
tier2 AS (
  SELECT *, count(*) FILTER (c1 > 26 AND {passes(2)}) OVER (PARTITION BY {key} ORDER BY rank ROWS UNBOUNDED PRECEDING) AS c2 FROM tier1),
entries AS (
  SELECT {key}, ord, pre || CASE WHEN ord < 26 THEN chr((65 + ord)::INT) ELSE chr((65 + ord // 26 - 1)::INT) || chr((65 + ord % 26)::INT) END || suf AS meta, pattern, cnt
  FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY rank) - 1 AS ord FROM tier2
        WHERE c1 <= 26 OR ({passes(2)} AND c2 <= 676) OR (c2 > 676 AND {passes(3)}))
  WHERE ord < {max_size})"""


def fold(text: str, pairs: str) -> str:
    """``text`` with the replacements of a list of ``(f, t)`` made one after the other."""
    return f"list_reduce({pairs}, lambda a, e: {{'f': replace(a.f, e.f, e.t), 't': ''}}, {{'f': {text}, 't': ''}}).f"


def encoded(source: str, key: str, text: str) -> str:
    """``packed``: every text with its dictionary, its encoding and its token figures."""
    head = "'You are analyzing dictionary-encoded text. Meta-tokens expand via this dictionary.' || chr(10) || 'Treat each meta-token as exactly its expansion. Do not invent expansions.' || chr(10) || chr(10) || 'DICTIONARY:'"
    return f"""
books AS (
  SELECT {key}, list({{'f': pattern, 't': meta}} ORDER BY length(pattern) DESC, ord) AS there, list({{'f': meta, 't': pattern}} ORDER BY length(meta) DESC, ord) AS back,
         string_agg(meta || ' = ' || pattern, chr(10) ORDER BY ord) AS plain, string_agg(chr(10) || '  ' || meta || ' = ' || replace(pattern, chr(10), '\\n'), '' ORDER BY ord) AS listed, count(*) AS n
  FROM entries GROUP BY {key}),
tried AS (
  SELECT s.{key}, s.{text} AS text, b.*, CASE WHEN b.n IS NULL THEN s.{text} ELSE {fold(f"s.{text}", "b.there")} END AS enc
  FROM {source} s LEFT JOIN (SELECT {key} AS k, * EXCLUDE ({key}) FROM books) b ON s.{key} = b.k WHERE s.{text} IS NOT NULL),
checked AS (SELECT *, n IS NOT NULL AND {fold("enc", "back")} = text AS good FROM tried),
packed AS (
  SELECT {key}, text, CASE WHEN good THEN enc ELSE text END AS encoded, CASE WHEN good THEN plain ELSE '' END AS plain, CASE WHEN good THEN n ELSE 0 END AS dictionary_entries,
         {head} || CASE WHEN good THEN listed ELSE '' END AS system_dictionary FROM checked)"""


def flat(source: str, key: str, text: str, min_freq: int, max_ngram: int, max_size: int, with_chars: bool = False) -> str:
    """All CTEs of a flat packing, up to ``packed``."""
    parts = [ngrams(source, key, text, min_freq, max_ngram), whole_lines(source, key, text, max(2, min_freq - 1))]
    groups = ["ngrams", "lines"]
    if with_chars:
        parts.append(chars(source, key, text, min_freq))
        groups.append("chars")
    return ",".join([*parts, merged(key, groups), gated(source, key, text, max_size), encoded(source, key, text)])


def folded(t: str) -> str:
    return f"trim(regexp_replace(lower({t}), '{SPACE}+', ' ', 'g'))"


def sentences(t: str) -> str:
    """A text cut behind ends of sentences and lines, where white space follows."""
    return rf"string_split(regexp_replace({t}, '([.!?\n]){SPACE}+', '\1' || chr(1), 'g'), chr(1))"


def worth(x: str, high_value: str) -> str:
    return f"(regexp_matches({x}, '{high_value}') OR starts_with({x}, '<<<SYSTEM') OR starts_with({x}, '<<<USER'))"


def cues(t: str, pattern: str) -> str:
    pattern = pattern.replace("'", "''")
    return f"list_distinct(list_transform(regexp_extract_all({t}, '{pattern}', 0), lambda x: {folded('left(x, 100)')}))"


def jaccard(a: str, b: str) -> str:
    both = f"len(list_distinct(list_concat({a}, {b})))"
    return f"(CASE WHEN {both} = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / {both} END)"


def typology(a: str, b: str, patterns: dict[str, str]) -> str:
    each = [f"round({jaccard(cues(a, p), cues(b, p))}, 4)" for p in patterns.values()]
    return f"round(({' + '.join(each)}) / {len(each)}, 4)"


def head_tail(t: str, budget: str) -> str:
    chars = f"greatest(200, {budget} * 4)"
    head, tail = f"floor({chars} * 0.5::DOUBLE)::INT", f"floor({chars} * 0.4::DOUBLE)::INT"
    cut = f"left({t}, {head}) || chr(10) || chr(10) || '…[TRUNCATED ' || (length({t}) - {head} - {tail}) || ' chars]…' || chr(10) || chr(10) || right({t}, {tail})"
    return f"(CASE WHEN {tokens(t)} > {budget} AND {head} + {tail} < length({t}) THEN {cut} ELSE {t} END)"


def stub(t: str) -> str:
    """The one-line stand-in for a turn."""
    shown = f"array_to_string(list_concat({filled(t)}[1:2], CASE WHEN len({filled(t)}) > 3 THEN {filled(t)}[-1:] ELSE [] END), ' | ')"
    return f"('[compacted stub: ~' || {tokens(t)} || ' tokens, ' || len({filled(t)}) || ' lines; recoverable detail omitted] ' || CASE WHEN length({shown}) > 240 THEN left({shown}, 239) || '…' ELSE {shown} END)"


def nested(name: str, ctes: str, select: str) -> str:
    """A table from CTEs of its own, so that a packing can stand in a query more than once."""
    return f"{name} AS (WITH {ctes} {select})"


PROMPT = "(system_dictionary || chr(10) || chr(10) || 'ENCODED_BODY:' || chr(10) || encoded)"
#: The dictionary's lines, each behind a line feed.
LISTED = "substr(system_dictionary, position('DICTIONARY:' IN system_dictionary) + 11)"
