"""Building blocks of the SQL that results are checked against.

The engine that runs it has no lookaround, so patterns there consume what must follow a match.
"""

from docloom.functions import fixed

STOPS = ", ".join(f"'{w}'" for w in fixed.STOP_WORDS)


def stem(word: str) -> str:
    def cut(end: str, rest: str) -> str:
        base = f"left({word}, length({word}) - {len(end)})"
        twin = f"length({base}) > 3 AND right({base}, 1) = left(right({base}, 2), 1) AND NOT contains('aeiouls', right({base}, 1))"
        return f"CASE WHEN ends_with({word}, '{end}') AND length({word}) >= {len(end) + 3} THEN CASE WHEN {twin} THEN left({base}, length({base}) - 1) ELSE {base} END ELSE {rest} END"

    out = word
    for end in ("s", "es", "ed", "ing"):
        out = cut(end, out)
    return f"CASE WHEN length({word}) > 4 AND regexp_full_match({word}, '[a-z]+') THEN {out} ELSE {word} END"


def terms(source: str, key: str, body: str, name: str = "terms") -> str:
    """CTEs that end in ``name`` (key, term), a row for each occurrence."""
    return f"""
{name}_tok AS (SELECT {key}, unnest(regexp_extract_all(lower({body}), '[a-z0-9]+(?:[-_./#][a-z0-9]+)*#?')) AS tok FROM {source}),
{name}_parts AS (SELECT {key}, tok, list_filter(regexp_split_to_array(tok, '[-_./#]'), lambda x: x <> '') AS parts FROM {name}_tok WHERE tok NOT IN ({STOPS})),
{name}_raw AS (
  SELECT {key}, tok AS w, true AS st FROM {name}_parts
  UNION ALL SELECT {key}, unnest(list_filter(parts, lambda x: x NOT IN ({STOPS}))), true FROM {name}_parts WHERE len(parts) > 1
  UNION ALL SELECT {key}, array_to_string(parts, ''), false FROM {name}_parts WHERE len(parts) > 1
  UNION ALL SELECT {key}, unnest([regexp_extract(tok, '^[a-z]+'), regexp_extract(tok, '[0-9]+$')]), false FROM {name}_parts WHERE len(parts) = 1 AND regexp_full_match(tok, '[a-z]+[0-9]+')
),
{name} AS (SELECT {key}, CASE WHEN st THEN {stem("w")} ELSE w END AS term FROM {name}_raw)"""


IDENTIFIER = r"\b((?:[A-Z][A-Z0-9]*(?:[-_][A-Z0-9#]+)+#?|[A-Z]{1,4}[0-9]{2,}[A-Z0-9]*|V?[0-9]+\.[0-9]+(?:\.[0-9]+)+))(?:[^A-Z0-9]|$)"


def identifiers(body: str) -> str:
    """Letters beyond ASCII are part of words, so they stand as a lower-case letter here."""
    return rf"regexp_extract_all(regexp_replace(upper(replace({body}, 'ß', 'ss')), '[^\x00-\x7F\P{{L}}]', 'x', 'g'), '{IDENTIFIER.replace('V?', '')}', 1)"


def norm_value(value: str) -> str:
    return rf"regexp_replace(upper({value}), '[\s\-.·_]', '', 'g')"


def one(v: object) -> str:
    """A literal."""
    if v is None:
        return "NULL"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(one, v)) + "]"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def bm25(tf: str, totals: str, idf: str, asked: str, key: str) -> str:
    k1, b = fixed.BM25_K1, fixed.BM25_B
    return f"""SELECT a.qid, t.{key}, sum(i.idf * t.tf * ({k1} + 1) / (t.tf + {k1} * (1 - {b} + {b} * t.length / n.mean_length))) AS score
FROM (SELECT DISTINCT qid, term FROM {asked}) a JOIN {tf} t USING (term) JOIN {idf} i USING (term) CROSS JOIN {totals} n GROUP BY a.qid, t.{key}"""


def bm25_tables(source: str, key: str, body: str) -> str:
    """CTEs tf, totals and idf of a table's texts."""
    return f"""{terms(source, key, body)},
lens AS (SELECT {key}, count(*) AS length FROM terms GROUP BY {key}),
tf AS (SELECT {key}, term, count(*) AS tf, any_value(length) AS length FROM terms JOIN lens USING ({key}) GROUP BY {key}, term),
totals AS (SELECT (SELECT count(*) FROM {source}) AS n, coalesce((SELECT count(*) FROM terms) / (SELECT count(*) FROM {source})::DOUBLE, 1.0) AS mean_length),
idf AS (SELECT term, count(*) AS df, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf CROSS JOIN totals GROUP BY term, n)"""
