"""Personal data with offset-preserving deobfuscation.

Detectors run twice: over the text, and over a text that transducers have normalised (homoglyphs,
full-width characters, invisible characters, spelled digits, ``[at]`` and ``(dot)`` disguises).
Every normalised character remembers the source characters that it stands for, so spans found
there are mapped back to source offsets.  Spans found in the text itself always stay; those of the
normalised text are added unless spans of their kind already cover them completely.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import byte_blocks, text_or_empty, tidy

KINDS = ("email", "ip", "card", "phone")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


# --- detectors -----------------------------------------------------------------------------------
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match of one of these begins where a run of digits does, so that a long run is tried once.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each ``@``."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            free = domain.end()
            at = text.find("@", free)
        else:
            free, at = at + 1, text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _at_most_255(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) < 4 and int(short or 0) <= 255


def detect(text: str) -> list[Span]:
    """Spans by kind as in :data:`KINDS`, then start; matches that fail their check are dropped."""
    spans = [Span("email", *m) for m in _emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        if text.count(".") > 2:
            spans += [Span("ip", *m.span()) for m in _IP.finditer(text) if all(map(_at_most_255, m.groups()))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() > 12 and 13 <= len(digits := _NO_DIGIT.sub("", m[0])) <= 19 and _luhn(digits):
                spans.append(Span("card", *m.span()))
        if "+" in text:
            spans += [Span("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return spans


# --- transducers -----------------------------------------------------------------------------------
# Characters that look like an ASCII one, by script.
_CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеоресухіјѕһԁԛԝкѵѡүӏҮѴԌӀԚԜ", "ABESIJKMHOPCTYXaeopecyxijshdqwkvwylYVGIQW", strict=True))
_GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοινακρυχγτηεωϲϳ", "ABEZHIKMNOPTYXoivakpuxytnewcj", strict=True))
_LATIN = {"ı": "i", "ɡ": "g", "ſ": "s"}
_SIGNS = {"․": ".", "。": ".", "∙": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹫": "@", " ": " ", " ": " ", " ": " "}
_INVISIBLE = dict.fromkeys("­​‌‍⁠﻿", "")
#: From Unicode's data: the digits of all scripts, and letters, digits and signs in another shape (wide,
#: small, encircled, mathematical), which stand for their plain one; raised and lowered ones do not.
_SHAPES = ("<wide>", "<narrow>", "<small>", "<font>", "<circle>")


def _plain_shapes() -> dict[str, str]:
    found = {}
    for c in map(chr, (*range(0x80, 0xFFFE), *range(0x10000, 0x1FBFF))):
        digit = unicodedata.decimal(c, None)
        if digit is not None:
            found[c] = str(digit)
        elif unicodedata.decomposition(c).startswith(_SHAPES):
            plain = unicodedata.normalize("NFKC", c)
            plain = _GREEK.get(plain, plain)
            if len(plain) == 1 and plain.isascii() and plain.isprintable():
                found[c] = plain
    return found


CHARACTERS = _plain_shapes() | _CYRILLIC | _GREEK | _LATIN | _SIGNS | _INVISIBLE
# Spelled digits, in the languages of the documents.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
SPELLED |= {"null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9"}
SPELLED |= {"zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9"}
SPELLED |= {"cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9"}

#: Beyond the basic plane a whole range, which the matcher takes at once; not all of it are look-alikes.
_LOOKALIKE = re.compile("[" + "".join(re.escape(c) for c in CHARACTERS if c < "\U00010000") + "\U00010000-\U0001FBFF]")
_STARTS: dict[str, list[str]] = {}
for _word in sorted(SPELLED, key=len, reverse=True):
    _STARTS.setdefault(_word[0], []).append(_word[1:])
#: By first letter, which the matcher tells apart at once in lower case.
_NAME = "|".join(f"{first}(?:{'|'.join(rests)})" for first, rests in _STARTS.items())
_TIMES = {"double": 2, "triple": 3, "doppel": 2, "doble": 2}
_PLUS, _DOT, _DASH = "plus|más|mas", "dot|point|punkt|punto", "dash|strich|tiret|guion|guión"
#: Three spelled digits in a row at least, single words between them; "plus", "dot" and "point" may stand among them.
_ONE = rf"(?:(?:{'|'.join(_TIMES)})[ -]?)?(?:{_NAME}|[0-9])"
_SPELLED = re.compile(rf"(?<![^\W_])(?:(?:{_PLUS})[ -]+)?{_ONE}(?:(?:[ ,-]{{1,3}}|[ ]?(?:{_DOT})[ ]?|[ ](?:{_DASH})[ ]|(?<=[0-9])(?=[0-9])){_ONE}){{2,}}(?![^\W_])")
_SPELLED_WORD = re.compile(rf"({_PLUS})[ -]+|(?:({'|'.join(_TIMES)})[ -]?)?({_NAME}|[0-9])|([ ]?(?:{_DOT})[ ]?)|([ ](?:{_DASH})[ ])|([ ,-]{{1,3}})")
#: Four numbers with words for the dots between them.
_DOTTED = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:[ ]?(?:{_DOT})[ ]?[0-9]{{1,3}}){{3}}(?![0-9])")
_DOT_WORD = re.compile(rf"[ ]?(?:{_DOT})[ ]?")
#: Words for the at sign and the dot that belong together; "at .. point" is everyday English.
_AT_DOT = (("at", "dot"), ("at|ät|klammeraffe", "punkt"), ("arobase|arobas", "point"), ("arroba", "punto"))
_AT_WORDS = frozenset(word for ats, _ in _AT_DOT for word in ats.split("|"))
_AT_SIGNS = _AT_WORDS | {"@", "a", "ä"}
_ANY = "|".join(sorted({word for pair in _AT_DOT for words in pair for word in words.split("|")}, key=len, reverse=True)) + r"|@|\."
#: A single letter in brackets stands for the at sign only inside a word.
_TIGHT = re.compile(r"(?<=[A-Za-z0-9])[\[({]([aä])[\])}](?=[A-Za-z0-9])", re.IGNORECASE)
# How the two signs are written in web pages and addresses.
_CODED = re.compile(r"&#0*64;|&#x0*40;|&commat;|(?<=[A-Za-z0-9])%40(?=[A-Za-z0-9])|(&#0*46;|&#x0*2e;|&period;|(?<=[A-Za-z0-9])%2e(?=[A-Za-z0-9]))", re.IGNORECASE)
_BRACKETED = re.compile(rf"[ ]{{0,2}}(?:\[[ ]?({_ANY})[ ]?\]|\([ ]?({_ANY})[ ]?\)|\{{[ ]?({_ANY})[ ]?\}}|<[ ]?({_ANY})[ ]?>)[ ]{{0,2}}", re.IGNORECASE)
#: name at host dot end; the bare words count only together.
_BARE = tuple(
    re.compile(rf"(?<=[A-Za-z0-9._%+-])([ _](?:{ats})[ _])([A-Za-z0-9-]{{1,63}})((?:[ _]{dot}[ _][A-Za-z0-9-]{{2,63}}){{0,2}}[ _]{dot}[ _]([A-Za-z]{{2,63}}))(?![A-Za-z0-9])", re.IGNORECASE)
    for ats, dot in _AT_DOT
)
_BARE_DOT = re.compile(r"[ _](?:dot|punkt|point|punto)[ _]", re.IGNORECASE)
#: Words for dots in the name before a disguised at sign.
_BEFORE_AT = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9-]{1,40})((?:[ _](?:dot|punkt|point|punto)[ _][A-Za-z0-9-]{1,40}){1,3})$", re.IGNORECASE)
#: Words for dots behind an at sign that stands as such.
_AFTER_AT = re.compile(r"(?<=@)[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,3}((?:[ _](?:dot|punkt|point|punto)[ _][A-Za-z0-9-]{2,63}){0,2}[ _](?:dot|punkt|point|punto)[ _]([A-Za-z]{2,63}))(?![A-Za-z0-9])", re.IGNORECASE)
#: Words that are no host of an address, and words that are no top-level domain.
_NO_HOST = frozenset("a an the this that these those my your his her its our their some any each every one der die das dem den ein eine le la les un une el los las una".split())
_NO_END = frozenset("the this that these those and or but with from for was were are his her its our their der die das dem den und oder ein eine mit les des une est avec pour los las una con por que".split())


class Mapped(NamedTuple):
    """A text with, for each of its characters, the source offsets from ``start`` to ``end``."""

    text: str
    start: list[int]
    end: list[int]

    def replaced(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """``edits``: (start, end, new text), ascending and apart, in offsets of this text."""
        parts, start, end, at = [], [], [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            parts += [self.text[at:a], new]
            start += self.start[at:a] + ([self.start[a]] * len(new) if new else [])
            end += self.end[at:a] + ([self.end[b - 1]] * len(new) if new else [])
            at = b
        return Mapped("".join(parts), start, end)


def _spelled_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    text = text.replace("İ", "i").lower()  # the one letter that lower case makes longer
    for run in _SPELLED.finditer(text):
        names = [m for m in _SPELLED_WORD.finditer(text, *run.span()) if m[3] in SPELLED]
        if not names or len(names) == 1 and not names[0][2] and (names[0].start() == run.start() or names[0].end() == run.end()):
            continue  # one such word before or behind digits is rather an article
        for m in _SPELLED_WORD.finditer(text, *run.span()):
            plus, times, name, dot, dash, gap = m.groups()
            if times or plus or dot or dash or name in SPELLED:
                edits.append((*m.span(), "+" if plus else SPELLED.get(name, name) * _TIMES.get(times, 1) if name else "." if dot else "-"))
            elif gap:
                edits.append((*m.span(), ""))
    ends = [0, *(e[1] for e in edits)]
    for run in _DOTTED.finditer(text):
        if bisect_right(ends, run.start()) == bisect_right(ends, run.end()):  # else it is part of a spelled run
            edits += [(*m.span(), ".") for m in _DOT_WORD.finditer(text, *run.span())]
    return sorted(edits)


def _disguise_edits(text: str) -> list[tuple[int, int, str]]:
    edits = [(*m.span(), "@" if m[m.lastindex].lower() in _AT_SIGNS else ".") for m in _BRACKETED.finditer(text)]
    edits += [(*m.span(), "@") for m in _TIGHT.finditer(text)]
    edits += [(*m.span(), "." if m[1] else "@") for m in _CODED.finditer(text)]
    for pattern in _BARE:
        for m in pattern.finditer(text):
            if m[2].lower() not in _NO_HOST and m[4].lower() not in _NO_END:
                edits.append((*m.span(1), "@"))
                edits += [(*d.span(), ".") for d in _BARE_DOT.finditer(text, *m.span(3))]
    for at in [start for start, _, new in edits if new == "@"]:
        low = max(0, at - 170)
        if (m := _BEFORE_AT.search(text[low:at])) and m[1].lower() not in _NO_HOST:
            edits += [(low + d.start(), low + d.end(), ".") for d in _BARE_DOT.finditer(text[low:at], *m.span(2))]
    out: list[tuple[int, int, str]] = []
    for edit in sorted(edits):
        if not out or edit[0] >= out[-1][1]:
            out.append(edit)
    return out


def _ending_edits(text: str) -> list[tuple[int, int, str]]:
    return [(*d.span(), ".") for m in _AFTER_AT.finditer(text) if m[2].lower() not in _NO_END for d in _BARE_DOT.finditer(text, *m.span(1))]


#: Nothing is disguised by at or dot without one of these.
_HINTS = ("dot", "punkt", "punto", "arob", "&#", "%40", "%2e", "&commat", "&period")
_CLOSED_HINTS = tuple(f"{word}{gap}{close}" for word in ("at", "ät", "klammeraffe", "arroba", "point", "@", ".", "a", "ä") for gap in ("", " ") for close in "])}>")


def _hinted(text: str) -> bool:
    lower = text.lower()
    return any(hint in lower for hint in _HINTS) or any(close in lower for close in "])}>") and any(hint in lower for hint in _CLOSED_HINTS)


def normalise(text: str) -> Mapped | None:
    """``text`` without its disguises; None where it has none."""
    mapped: Mapped | None = None

    def edited(find) -> None:
        nonlocal mapped
        edits = find(mapped.text if mapped else text)
        if edits:
            mapped = (mapped or Mapped(text, list(range(len(text))), list(range(1, len(text) + 1)))).replaced(edits)

    if not text.isascii():
        edited(lambda t: [(m.start(), m.end(), CHARACTERS[m[0]]) for m in _LOOKALIKE.finditer(t) if m[0] in CHARACTERS])
    edited(_spelled_edits)
    if _hinted(mapped.text if mapped else text):
        edited(_disguise_edits)
        if "@" in (mapped.text if mapped else text):
            edited(_ending_edits)
    return mapped


def _uncovered(spans: list[Span], known: list[Span]) -> list[Span]:
    """The ``spans`` that those of their kind in ``known``, and those taken before, don't cover, alone
    or together."""
    taken: list[Span] = []
    for kind in KINDS:
        covered: list[list[int]] = []  # what is known, as stretches that are ascending and apart
        for s in sorted(s for s in known if s.kind == kind):
            if covered and s.start <= covered[-1][1]:
                covered[-1][1] = max(covered[-1][1], s.end)
            else:
                covered.append([s.start, s.end])
        reached = 0
        for s in sorted(s for s in spans if s.kind == kind):
            at = max(s.start, reached)
            k = bisect_right(covered, at, key=itemgetter(0)) - 1
            if max(at, covered[k][1] if k >= 0 else 0) < s.end:
                taken.append(s)
                reached = max(reached, s.end)
    return taken


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The spans of the text itself and those that deobfuscation adds, in source code points.

    An added span may overlap spans of the text itself that are only a part of it.
    """
    base = detect(text)
    mapped = normalise(text)
    if not mapped:
        return base, []
    return base, _uncovered([Span(s.kind, mapped.start[s.start], mapped.end[s.end - 1]) for s in detect(mapped.text)], base)


def joined(spans: list[Span]) -> str:
    """kind:start:end by kind as listed in KINDS, then start and end; comma-joined."""
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in sorted(spans, key=lambda s: (KINDS.index(s.kind), s.start, s.end)))


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with each stretch that spans cover replaced by ``<KIND>`` of the first that covers it."""
    parts, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            parts += [text[at : s.start], f"<{s.kind.upper()}>"]
        at = max(at, s.end)
    return "".join([*parts, text[at:]])


# --- on DataFrames ----------------------------------------------------------------------------------
def personal_data(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text), whole texts: doc_id, n_email, n_ip, n_card,
    n_phone, base_sha256, spans, n_added.

    The counts and base_sha256 are of the spans in the text itself; ``spans`` holds these and the
    ``n_added`` that deobfuscation adds.  Null and empty texts have no spans, ``spans`` is then
    empty.  Other columns are ignored; no rows give no rows; repeated rows are repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_blocks(batches, 1, 8_000_000):
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, all_spans, extra = [], [], []
            for text in batch.column(1).to_pylist():
                base, added = find_spans(text)
                for kind, column in zip(KINDS, counts, strict=True):
                    column.append(sum(s.kind == kind for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                all_spans.append(joined(base + added))
                extra.append(len(added))
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(all_spans), pa.array(extra, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return read.mapInArrow(tidy(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by ``<EMAIL>``, ``<IP>``, ``<CARD>`` and
    ``<PHONE>``, and ``n_chars``, where there is one, counted anew.  Null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in byte_blocks(iter([batch]), batch.schema.get_field_index("text"), 8_000_000):
                at = block.schema.get_field_index("text")
                texts = [t if t is None else masked(t, [s for found in find_spans(t) for s in found]) for t in block.column(at).to_pylist()]
                yield block.set_column(at, "text", pa.array(texts, pa.string()))

    out = docs.mapInArrow(tidy(run), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
