"""Normalisation, tokens, identifiers and file-name rules as native column expressions.

Nulls count as empty strings.  Where a class must be Unicode-aware the pattern says ``(?U)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import fixed

ColumnLike = Column | str

#: Blanks as ``str.strip`` and ``\\s`` understand them.
BLANK = fixed.BLANK


def column(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def known(c: ColumnLike) -> Column:
    return F.coalesce(column(c).cast("string"), F.lit(""))


def strip(c: ColumnLike) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(known(c), rf"(?U)^{BLANK}+|{BLANK}+$", "")


def single_spaced(c: ColumnLike) -> Column:
    return F.regexp_replace(known(c), rf"(?U){BLANK}+", " ")


def clean_cell(c: ColumnLike) -> Column:
    """A table cell: stripped, ``5.0`` as ``5``, runs of blanks as one space."""
    return single_spaced(F.regexp_replace(strip(c), r"(?U)^(-?\d+)\.0$", "$1"))


def norm_value(c: ColumnLike) -> Column:
    """A value as it is compared: upper case, without blanks and ``- . · _``."""
    return F.regexp_replace(F.upper(known(c)), rf"(?U){BLANK}|[-.·_]", "")


def score_norm(c: ColumnLike) -> Column:
    """A transcription as it is scored: upper case, without space, tab, line ends and ``- . · _``."""
    return F.translate(F.upper(known(c)), " \t\r\n-.·_", "")


def is_stop(c: Column) -> Column:
    return c.isin(fixed.STOP_WORDS)


def _without_twin(cut: Column) -> Column:
    """The last of two equal letters dropped, from words of more than three letters."""
    twin = (F.length(cut) > 3) & (F.substring(cut, -1, 1) == F.substring(cut, -2, 1)) & ~F.substring(cut, -1, 1).isin(*"aeiouls")
    return F.when(twin, F.substring(cut, F.lit(1), F.length(cut) - 1)).otherwise(cut)


def stem(c: ColumnLike) -> Column:
    """Words of more than four letters without one of ``ing ed es s``, where three letters stay.

    A letter that was doubled before the ending is single, but for vowels, ``l`` and ``s``.
    """
    word = column(c)
    out = word
    for end in ("s", "es", "ed", "ing"):
        out = F.when(word.endswith(end) & (F.length(word) >= len(end) + 3), _without_twin(F.substring(word, F.lit(1), F.length(word) - len(end)))).otherwise(out)
    return F.when((F.length(word) > 4) & word.rlike(r"^\p{L}+$"), out).otherwise(word)


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _with_parts(token: Column) -> Column:
    """A token's terms: its stem; of compounds the parts' stems and the parts joined; of letters and digits both."""
    parts = F.filter(F.split(token, "[-_./#]"), lambda p: p != "")
    compound = F.concat(F.transform(F.filter(parts, lambda p: ~is_stop(p)), stem), F.array(F.array_join(parts, "")))
    halves = F.array(F.regexp_extract(token, r"^[a-z]+", 0), F.regexp_extract(token, r"\d+$", 0))
    more = F.when(F.size(parts) > 1, compound).when(token.rlike(r"^[a-z]+[0-9]+$"), halves).otherwise(F.array().cast("array<string>"))
    # Most tokens are plain words, which need none of this.
    return F.when(F.translate(token, _LETTERS, "") == "", F.array(stem(token))).otherwise(F.concat(F.array(stem(token)), more))


def words(c: ColumnLike) -> Column:
    """Tokens of a text but stop words, with repeats; each stands for the terms that :func:`terms_of` gives."""
    return F.filter(F.regexp_extract_all(F.lower(known(c)), F.lit(fixed.TOKEN), F.lit(0)), lambda t: ~is_stop(t))


def terms_of(token: ColumnLike) -> Column:
    """The terms of one token."""
    return _with_parts(column(token))


def term_count(found: ColumnLike) -> Column:
    """How many terms tokens stand for; few have more than one."""
    several = F.filter(column(found), lambda t: t.rlike(r"[^a-z]"))
    return F.size(column(found)) + F.aggregate(several, F.lit(0), lambda acc, t: acc + F.size(_with_parts(t)) - 1)


def tokens(c: ColumnLike) -> Column:
    """Terms of a text, with repeats."""
    return F.flatten(F.transform(words(c), _with_parts))


def identifiers(c: ColumnLike) -> Column:
    """Identifiers of the upper-cased text, in order, with repeats."""
    return F.regexp_extract_all(F.upper(known(c)), F.lit(fixed.IDENTIFIER), F.lit(0))


def value_pattern(c: ColumnLike) -> Column:
    """A pattern, for each row, that finds a value as a whole token whatever its separators; null if it has no letters.

    Atoms between separators are joined by any separators; inside an atom digits, letters and
    signs may stand apart.  A leading ``v`` is allowed before a digit.
    """
    atoms = F.filter(F.split(strip(c), rf"(?U)(?:{BLANK}|[-.·_])+"), lambda a: a != "")
    quoted = lambda x: F.regexp_replace(x, r"([^\p{L}\p{N}])", r"\\$1")
    pieces = lambda a: F.regexp_extract_all(a, F.lit(r"(?U)\d+|[^\W\d_]+|[^\w\s]"), F.lit(0))
    atom = lambda a: F.when(F.size(pieces(a)) > 0, F.array_join(F.transform(pieces(a), quoted), r"[\s\-]?")).otherwise(quoted(a))
    lead = F.when(F.get(atoms, F.lit(0)).rlike(r"(?U)^\d"), r"(?:(?<![0-9A-Za-z])|(?<=[vV]))").otherwise(r"(?<![0-9A-Za-z])")
    body = F.array_join(F.transform(atoms, atom), r"[\s\-.·_/]*")
    return F.when(F.size(atoms) > 0, F.concat(F.lit("(?iuU)"), lead, body, F.lit(r"(?![0-9A-Za-z])")))


def contains_value(text: ColumnLike, value: ColumnLike) -> Column:
    return F.coalesce(F.rlike(known(text), value_pattern(value)), F.lit(False))


def base_name(c: ColumnLike) -> Column:
    return F.regexp_extract(known(c), r"[^/]*$", 0)


def without_extension(c: ColumnLike) -> Column:
    """A path without its last extension; a name's leading dots are no extension."""
    return F.regexp_replace(known(c), fixed.EXTENSION, "")


def extension(c: ColumnLike) -> Column:
    """The lower-cased last extension with its dot; empty for dot files."""
    return F.lower(F.regexp_extract(known(c), r"[^/.](\.[^./]*)$", 1))


def title_of(path: ColumnLike) -> Column:
    return F.regexp_replace(without_extension(path), fixed.NAME_SIGNS, " ")


def family_key(path: ColumnLike) -> Column:
    """What revisions of one document share: folder and name without lifecycle words and revision marks."""
    path = F.lower(known(path))
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    name = without_extension(base_name(path))
    name = F.regexp_replace(name, rf"(?:^|(?<=[_\-. ]))(?:{fixed.LIFECYCLE})(?=$|[_\-. ])", "")
    name = F.regexp_replace(name, rf"(?U){fixed.NAME_EDGE}(?:{fixed.REVISION_WORDS})[_\-. ]?\d+[a-z]?{fixed.NAME_END}", "")
    return F.concat(folder, F.lit("/"), F.regexp_replace(F.regexp_replace(name, r"[_\-. ]+", "_"), "^_+|_+$", ""))


def revision_number(path: ColumnLike) -> Column:
    """The number of the first revision mark of the name, or -1."""
    digits = F.regexp_extract(F.lower(base_name(path)), rf"{fixed.NAME_EDGE}(?:{fixed.REVISION_WORDS})[_\-. ]?([0-9]+)", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("bigint"), F.lit(-1).cast("bigint"))


def withdrawn_by_name(path: ColumnLike) -> Column:
    return base_name(path).rlike(f"(?i){fixed.WITHDRAWN_NAME}")


def withdrawn_by_text(c: ColumnLike) -> Column:
    """Over the beginning of a document only, where such notes stand."""
    return F.left(known(c), F.lit(fixed.WITHDRAWN_CHARS)).rlike(f"(?iU){fixed.WITHDRAWN_TEXT}")


def asks_for_old(question: ColumnLike) -> Column:
    return known(question).rlike(f"(?iU){fixed.OLD_REVISION}")


def lines(c: ColumnLike) -> Column:
    """Lines as ``splitlines`` gives them: no empty one after a final line end, none of an empty text."""
    split = F.split(known(c), fixed.LINE_END)
    return F.when(F.element_at(split, -1) == "", F.slice(split, F.lit(1), F.size(split) - 1)).otherwise(split)
