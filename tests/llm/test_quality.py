import random

import numpy as np
import pytest

from docloom.llm import quality
from tests.llm.fixtures import DOCS

WORDS = ["".join(random.Random(i).choices("abcdefgh", k=5)) for i in range(200)]
TOXIC = ["scumword", "loserword", "stupidword"]


def rated(n=900, seed=1):
    rng = random.Random(seed)
    rows, grades = [], []
    for i in range(n):
        words = rng.choices(WORDS, k=rng.randint(30, 120))
        grade = rng.choice([0, 1, 2, 2, 2, 2])
        if grade == 0:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [words[0]] * len(words)
        elif grade == 1:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(TOXIC)
        rows.append((i, " ".join(words)))
        grades.append((i, grade))
    return rows, grades


@pytest.fixture(scope="module")
def model(spark):
    rows, grades = rated()
    return quality.train(spark.createDataFrame(rows, DOCS), spark.createDataFrame(grades, "doc_id long, grade int"))


def test_held_out_accuracy_and_selection(spark, model):
    rows, grades = rated(400, 2)
    truth = dict(grades)
    out = quality.graded_quality(spark.createDataFrame(rows, DOCS), model).collect()
    right = sum(r.kept == (truth[r.doc_id] == 2) for r in out) / len(out)
    kept_clean = np.mean([r.kept for r in out if truth[r.doc_id] == 2])
    means = [np.mean([r.expected_grade for r in out if truth[r.doc_id] == g]) for g in range(3)]
    assert right > 0.95 and kept_clean > 0.97 and means[0] + 0.5 < means[1] < means[2] - 0.3


def test_thresholds_are_ordered_and_the_fit_repeats(model):
    assert (np.diff(model.thresholds) > 0).all()
    rows, grades = rated(200, 3)
    words = quality.Features()
    features = quality.Sample.of([quality.text_features(t, words) for _, t in rows])
    labels = np.array([g for _, g in grades])
    first, second = (quality.fit(features, labels, 2, 20) for _ in range(2))
    assert (first.weights == second.weights).all() and (first.thresholds == second.thresholds).all()


def test_scores_equal_a_plain_loop(spark, model):
    rows = [*rated(30, 4)[0], (100, None), (101, ""), (101, ""), (None, "x y"), (102, "long " * 50_000)]
    frame = spark.createDataFrame([(i, t, 1.0, True) for i, t in rows], f"{DOCS}, expected_grade double, kept boolean")
    words = quality.Features()
    wanted = []
    for i, t in rows:
        tails = model.tails(np.array([sum(float(w) for w in sorted(model.weights[quality.text_features(t or "", words)]))]))[0]
        wanted.append((str(i), round(tails.sum(), 6), round(tails[-1], 6), bool(tails[-1] >= 0.5)))
    out = [(str(r.doc_id), round(r.expected_grade, 6), round(r.tail_probability, 6), r.kept) for r in quality.graded_quality(frame, model).collect()]
    assert sorted(out) == sorted(wanted)
    stay = quality.kept_rows(frame, model)
    assert stay.columns == frame.columns and stay.count() == sum(w[3] for w in wanted)


def test_empty_tables_and_missing_ratings(spark):
    none = quality.train(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, grade int"))
    assert quality.graded_quality(spark.createDataFrame([], DOCS), none).collect() == []
    assert quality.graded_quality(spark.createDataFrame([(1, "a")], DOCS), none).count() == 1
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 1), (4, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted((r.doc_id or 0, r.grade) for r in quality.ratings_of(labels).collect()) == [(0, 2), (1, 2), (2, 1), (3, 0), (4, 0)]


def test_the_sample_is_bounded_and_each_document_once(spark):
    rows, grades = rated(60, 5)
    ratings = spark.createDataFrame([*grades, *grades, (7, 0)], "doc_id long, grade int")
    out = quality.rated_sample(spark.createDataFrame(rows, DOCS), ratings, 40).collect()
    assert len(out) == 40 == len({r.doc_id for r in out})


def test_held_out_accuracy_on_the_tables(spark):
    """Fitted on the rated documents of even doc_id, judged on the odd ones of the larger test table."""
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")
    ratings = quality.ratings_of(read("labels"))
    model = quality.train(read("documents"), ratings.where("doc_id % 2 = 0"))
    judged = quality.graded_quality(read("documents"), model).join(ratings.where("doc_id % 2 = 1"), "doc_id").toPandas()
    clean, good = (judged.grade == 2).to_numpy(), (judged.grade > 0).to_numpy()
    assert quality.ranked_above(judged.tail_probability.to_numpy(), clean) > 0.9
    assert quality.ranked_above(judged.expected_grade.to_numpy(), good) > 0.95
    assert judged.kept[clean].mean() > 0.9


def test_the_sample_is_those_that_hash_lowest(spark):
    rows, grades = rated(600, 5)
    ratings = spark.createDataFrame(grades, "doc_id long, grade int")
    places = ratings.selectExpr("doc_id", "xxhash64(7, doc_id) AS h").collect()
    for most in (25, 200):  # a small share of the ratings, and a large one
        lowest = {r.doc_id for r in sorted(places, key=lambda r: (r.h, r.doc_id))[:most]}
        assert {r.doc_id for r in quality.rated_sample(spark.createDataFrame(rows, DOCS), ratings, most).collect()} == lowest
