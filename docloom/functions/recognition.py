"""Clean-up of recognised plate and sign text, and confidences."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docloom.functions import fixed
from docloom.functions.replies import unquoted
from docloom.functions.text import ColumnLike, column, known, lines, single_spaced, strip

_TYPE, _TEXT = r"(?iU)^\s*\**TYPE\**\s*[:：]\s*(.+)", r"(?iU)^\s*\**TEXT\**\s*[:：]\s*(.*)"
_LABEL = r"(?iU)^(?:TEXT|ANSWER|PLATE|SIGN)\s*[:：]\s*"


@F.pandas_udf(StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: ColumnLike) -> Column:
    """NFKC, by an Arrow function; it is the one normal form here that no native function gives."""
    return _compatible(column(c))


def reply_kind(raw: ColumnLike) -> Column:
    """``CN_PLATE``, ``US_PLATE``, ``OTHER_PLATE`` or ``SIGN`` by the last TYPE line."""
    typed = F.filter(lines(raw), lambda line: line.rlike(_TYPE))
    said = F.upper(strip(F.regexp_extract(F.try_element_at(typed, F.lit(-1)), _TYPE, 1)))
    kind = F.when(said.contains("CN") | said.contains("CHIN"), "CN_PLATE").when(said.contains("US"), "US_PLATE").when(said.contains("PLATE"), "OTHER_PLATE")
    return F.coalesce(kind, F.lit("SIGN"))


def reply_text(raw: ColumnLike) -> Column:
    """The last TEXT line's text; without one all lines but TYPE lines, joined by spaces."""
    all_lines = lines(raw)
    told = F.filter(all_lines, lambda line: ~line.rlike(_TYPE) & line.rlike(_TEXT))
    rest = F.array_join(F.filter(all_lines, lambda line: ~line.rlike(r"(?iU)^\s*TYPE\s*[:：]")), " ")
    return F.when(F.size(told) > 0, F.regexp_extract(F.try_element_at(told, F.lit(-1)), _TEXT, 1)).otherwise(rest)


def without_banners(c: ColumnLike) -> Column:
    """A plate's text without addresses, states and slogans."""
    phrases = "|".join(p.replace(",", r"\,") for p in sorted({*fixed.STATES, *fixed.SLOGANS}, key=lambda p: (-len(p), p)))
    text = F.translate(F.regexp_replace(known(c), f"(?U){fixed.BANNER_ADDRESS}", " "), ",", "")
    text = F.regexp_replace(text, rf"(?<![A-Z0-9])(?:{phrases})(?![A-Z0-9])", " ")
    text = F.regexp_replace(text, r"(?U)\b(?:THE|OF|STATE)\b", " ")
    return strip(single_spaced(text))


def clean_recognised(text: ColumnLike, kind: ColumnLike, compatible: bool = True) -> Column:
    """A reply's text as it is graded.

    Only US and other plates lose banners, and never all of their letters and digits.
    ``compatible=False`` leaves NFKC out, for texts known to be ASCII.
    """
    text, kind = known(text), column(kind)
    plain = nfkc(text) if compatible else text
    plain = unquoted(F.translate(plain, fixed.DOTS, "·" * len(fixed.DOTS)))
    plain = F.upper(strip(single_spaced(F.regexp_replace(plain, _LABEL, ""))))
    bare = without_banners(plain)
    return F.when(kind.isin("US_PLATE", "OTHER_PLATE") & bare.rlike("[A-Z0-9]"), bare).otherwise(plain)


def confidence(probabilities: ColumnLike) -> Column:
    """Geometric mean of token probabilities, from 1e-9 up, to four digits; 0 without tokens."""
    p = column(probabilities)
    total = F.aggregate(p, F.lit(0.0), lambda acc, x: acc + F.log(F.greatest(x, F.lit(1e-9))))
    return F.when(F.size(p) > 0, F.bround(F.exp(total / F.size(p)), 4)).otherwise(F.lit(0.0))


def model_size(width: ColumnLike, height: ColumnLike, least: int = fixed.OCR_MIN_SIDE, most: int = fixed.OCR_MAX_SIDE) -> Column:
    """``struct<width, height>`` that an image is scaled to: its longer side between ``least`` and ``most``."""
    w, h = column(width), column(height)
    longest = F.greatest(w, h)
    factor = F.when(longest > most, F.lit(float(most)) / longest).when(longest < least, F.lit(float(least)) / longest)
    scaled = lambda side: F.when(factor.isNull(), side).otherwise(F.greatest(F.lit(1), F.bround(side * factor).cast("int")))
    return F.struct(scaled(w).cast("int").alias("width"), scaled(h).cast("int").alias("height"))
