"""Quality by ordinal regression: cumulative links over hashed text.

Graded ratings 0 < 1 < ... < K are modelled as P(grade >= k) = sigmoid(w.x - t_k) with one weight
vector for all grades and ordered thresholds t_1 < ... < t_K.  x marks which hashed features a
text has.  The model is fitted on a bounded sample of rated rows; every text is then scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import BoundedWords, byte_blocks, text_or_empty, tidy

BITS = 18
#: Rated rows that a fit uses at most.
SAMPLE_ROWS = 16_000
#: The share of the sample's rows, and the rows, that a feature must stand in to get a weight.
LEAST_SHARE, LEAST_ROWS = 0.00075, 4
ROUNDS = 120
L2 = 2e-4
#: What the first penalty is chosen from, by the ranking of the rows held out, one in HELD_OUT.
L1 = (0.03, 0.06, 0.12)
HELD_OUT = 5
#: The share that the tail probability must reach for a text to be selected.
SELECT_FROM = 0.5

_LETTERS = re.compile(r"[^\W\d_]+")
_REPEATED = re.compile(r"(.)\1+", re.DOTALL)


def _feature(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name) & ((1 << BITS) - 1)


_LOWER, _TITLE = _feature("s:a"), _feature("s:Aa")


class Features(BoundedWords):
    """Feature indices of words: the word without its marks, and the shape of its case and marks.

    ``only``: flags of the indices that matter, others are left out.
    """

    def __init__(self, only: np.ndarray | None = None) -> None:
        super().__init__()
        self.only = only

    def value(self, word: str) -> tuple[int, ...]:
        if word.isalpha() and word[1:].islower():
            found = (_LOWER if word[0].islower() else _TITLE, _feature("w:" + word.lower()))
        else:
            core = "".join(_LETTERS.findall(word))
            shape = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
            found = (_feature("s:" + _REPEATED.sub(r"\1", shape)[:12]), *([_feature("w:" + core.lower())] if core else []))
        return found if self.only is None else tuple(i for i in found if self.only[i])


def _graded(name: str, value: float, steps: int) -> int:
    """A feature for a share from 0 to 1."""
    return _feature(f"{name}={min(steps - 1, int(value * steps))}")


def text_features(text: str, words: Features) -> np.ndarray:
    """Distinct feature indices of the whole text; the empty text has those of its shares only."""
    split = text.split()
    distinct = set(split)
    found = set(chain.from_iterable(map(words.__getitem__, distinct)))
    n = max(1, len(split))
    found.add(_graded("distinct", len(distinct) / n, 20))
    found.add(_graded("upper", sum(map(str.isupper, split)) / n, 10))
    found.add(_graded("plain", sum(map(str.isalpha, split)) / n, 20))
    found.add(_graded("lines", text.count("\n") / n, 10))
    found.add(_graded("length", np.log2(n + 1) / 24, 24))
    return np.fromiter(found, np.int64, len(found))


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, features: np.ndarray) -> float:
        return float(np.sort(self.weights[features]).sum(dtype=np.float64))

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, a row for each score."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -40, 40)))


@dataclass(frozen=True)
class Sample:
    """Feature indices of rows, one row's after the other's, and how many each row has."""

    index: np.ndarray
    lengths: np.ndarray

    @staticmethod
    def of(rows: list[np.ndarray]) -> Sample:
        return Sample(np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int32), np.array([len(r) for r in rows], np.int64))

    def part(self, chosen: np.ndarray) -> Sample:
        return Sample(self.index[np.repeat(chosen, self.lengths)], self.lengths[chosen])

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)

    def frequent(self, least_share: float) -> Sample:
        """Without the features that stand in less than this share of the rows, or in fewer than LEAST_ROWS."""
        kept = (np.bincount(self.index, minlength=1 << BITS) >= max(LEAST_ROWS, least_share * len(self.lengths)))[self.index]
        return Sample(self.index[kept], np.bincount(self.owners()[kept], minlength=len(self.lengths)))


def fit(sample: Sample, grades: np.ndarray, top: int, rounds: int = ROUNDS, l2: float = L2, l1: float = L1[1], least_share: float = LEAST_SHARE) -> OrdinalModel:
    """A cumulative-link model of grades 0 to ``top`` by proximal Adam on the mean log-likelihood, from zero.

    ``l1`` and ``l2`` shrink the weights, the first to nothing where a feature tells little;
    features in less than ``least_share`` of the rows, or in fewer than LEAST_ROWS, have no weight.

    Grades weigh as if each were as frequent as any other.  The result depends on nothing but
    the arguments.
    """
    sample = sample.frequent(least_share)
    n, size = len(sample.lengths), 1 << BITS
    used, index = np.unique(sample.index, return_inverse=True)
    index = index.astype(np.int32)
    # Sums over a row's features, and over a feature's rows, are of neighbours in these orders.
    filled = np.flatnonzero(sample.lengths)
    rows = (np.cumsum(sample.lengths) - sample.lengths)[filled]
    by_feature = sample.owners()[np.argsort(index, kind="stable")]
    features = np.searchsorted(np.sort(index), np.arange(len(used)))
    present = np.bincount(grades, minlength=top + 1)
    weight = (1.0 / np.maximum(1, present))[grades] / max(1, (present > 0).sum())
    w, base, gaps = np.zeros(len(used)), 0.0, np.zeros(max(0, top - 1))
    state = [np.zeros(len(used) + top) for _ in range(2)]
    for step in range(1, rounds + 1):
        t = base + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        score = np.zeros(n)
        if len(used):
            score[filled] = np.add.reduceat(w[index], rows)
        # P(grade = g) = tail(g) - tail(g + 1), tails by the thresholds around g
        tail = np.concatenate((np.ones((n, 1)), 1.0 / (1.0 + np.exp(np.clip(t[None, :] - score[:, None], -40, 40))), np.zeros((n, 1))), 1)
        slope = tail * (1 - tail)
        at = np.arange(n)
        p = np.maximum(tail[at, grades] - tail[at, grades + 1], 1e-9)
        d_score = -weight * (slope[at, grades] - slope[at, grades + 1]) / p
        d_t = np.zeros(top)
        low, high = grades >= 1, grades < top
        np.add.at(d_t, grades[low] - 1, (weight * slope[at, grades] / p)[low])
        np.add.at(d_t, grades[high], (-weight * slope[at, grades + 1] / p)[high])
        grad_w = (np.add.reduceat(d_score[by_feature], features) if len(used) else w) + l2 * w
        grad = np.concatenate((grad_w, [d_t.sum()], np.cumsum(d_t[::-1])[::-1][1:] * np.exp(gaps)))
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        move = 0.3 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8) * (1 - step / (rounds + 1))
        w = w - move[: len(used)]
        w = np.sign(w) * np.maximum(0, np.abs(w) - l1 * 0.3 * (1 - step / (rounds + 1)))
        base, gaps = base - move[len(used)], gaps - move[len(used) + 1 :]
    weights = np.zeros(size, np.float32)
    weights[used] = w
    return OrdinalModel(weights, base + np.concatenate(([0.0], np.cumsum(np.exp(gaps)))))


def rated_sample(docs: DataFrame, ratings: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 7) -> DataFrame:
    """(doc_id, grade, features) of ``rows`` rated documents at most, those whose doc_id hashes lowest.

    ``ratings``: doc_id, grade.  Rows without doc_id or grade are left out; of several ratings of
    a document the lowest counts.
    """
    one = ratings.where("doc_id is not null and grade is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("grade").cast("int").alias("grade"))
    place = F.xxhash64(F.lit(seed), "doc_id")
    # Of many ratings only those that may hash low enough are ordered: over twice as many as wanted are expected.
    share = (2 * rows + 200) / max(1, ratings.count())
    likely = one.where(place < F.lit(int(-(2**63) + share * 2**64))) if share < 0.5 else one
    chosen = likely.orderBy(place, "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Features()
        for batch in byte_blocks(batches, 1, 4_000_000):
            found = [text_features(t, words).astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "grade", "features"])

    return texts.mapInArrow(tidy(run), "doc_id long, grade int, features array<int>")


def ranked_above(scores: np.ndarray, high: np.ndarray) -> float:
    """How often a row of ``high`` scores above another one that is not (ties count half)."""
    _, place, count = np.unique(scores, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[place]
    n = int(high.sum())
    return float((rank[high].sum() - n * (n + 1) / 2) / (n * (len(high) - n))) if 0 < n < len(high) else 0.5


def chosen_penalty(sample: Sample, grades: np.ndarray, top: int) -> float:
    """The first penalty under which held-out rows of higher grades are ranked best above lower ones.

    One row in HELD_OUT, by place, is held out; too few rows for that give the middle choice.
    """
    held = np.arange(len(grades)) % HELD_OUT == HELD_OUT - 1
    if held.sum() < 2 * (top + 1):
        return L1[1]
    fitted, judged, own = sample.part(~held), sample.part(held), grades[held]
    owner = judged.owners()

    def ranking(l1: float) -> float:
        model = fit(fitted, grades[~held], top, l1=l1)
        scores = np.bincount(owner, model.weights[judged.index], len(own))
        return sum(ranked_above(scores, own >= k) for k in range(1, top + 1))

    return max(L1, key=ranking)


def train(docs: DataFrame, ratings: DataFrame, rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """The model of a bounded sample; without rated documents every grade is as likely."""
    found = rated_sample(docs, ratings, rows).toArrow().sort_by([("doc_id", "ascending"), ("grade", "ascending")]).combine_chunks()
    grades = found.column("grade").to_numpy().astype(np.int64)
    features = found.column("features").combine_chunks()
    sample = Sample(features.flatten().to_numpy(), features.value_lengths().to_numpy().astype(np.int64)).frequent(LEAST_SHARE)
    del found, features
    pa.default_memory_pool().release_unused()
    top = int(ratings.agg(F.max("grade")).first()[0] or 1)
    grades = np.clip(grades, 0, top)
    return fit(sample, grades, top, l1=chosen_penalty(sample, grades, top))


def _scorer(docs: DataFrame, model: OrdinalModel):
    """A function, for executors, from texts to tail probabilities, and the broadcast that it reads."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # 2 ** BITS weights, always

    def make():
        own = OrdinalModel(*held.value)
        words = Features(own.weights != 0)
        return lambda texts: own.tails(np.array([own.score(text_features(t or "", words)) for t in texts]))

    return make


def graded_quality(docs: DataFrame, model: OrdinalModel, select_from: float = SELECT_FROM) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, expected_grade, tail_probability, kept.

    expected_grade is the mean grade under the model and tail_probability that of the highest
    grade; a document is kept from ``select_from`` on.  Whole texts count; null is empty.  Repeated
    rows score alike; other columns are ignored; no rows give no rows.
    """
    make = _scorer(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tails_of = make()
        for batch in byte_blocks(batches, 1, 4_000_000):
            tails = tails_of(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= select_from)], names=["doc_id", "expected_grade", "tail_probability", "kept"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return read.mapInArrow(tidy(run), "doc_id long, expected_grade double, tail_probability double, kept boolean")


def kept_rows(docs: DataFrame, model: OrdinalModel, select_from: float = SELECT_FROM) -> DataFrame:
    """The rows of ``docs`` that :func:`graded_quality` keeps, with all their columns; no shuffle."""
    make = _scorer(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tails_of = make()
        for batch in batches:
            for block in byte_blocks(iter([batch]), batch.schema.get_field_index("text"), 4_000_000):
                kept = tails_of(block.column("text").to_pylist())[:, -1] >= select_from
                if kept.any():
                    yield block.filter(pa.array(kept))

    return docs.mapInArrow(tidy(run), docs.schema)


def ratings_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 for low quality, 1 for toxic texts of good quality, 2 for clean ones.

    A null flag counts as 0.
    """
    good, toxic = F.coalesce(F.col("quality"), F.lit(0)) > 0, F.coalesce(F.col("toxic"), F.lit(0)) > 0
    return labels.select("doc_id", F.when(~good, 0).when(toxic, 1).otherwise(2).alias("grade"))
