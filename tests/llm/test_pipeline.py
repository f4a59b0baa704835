"""The pipeline against a brute-force version of all its stages."""

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from docloom.llm import pii, quality
from tests.llm.test_exact_dedup import brute as exact
from tests.llm.test_ngram_join import brute as near
from tests.llm.test_packing import check
from tests.llm.test_quality import rated


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rows, grades = rated(300, 6)
    extra = []
    for k, (i, text) in enumerate(rows[:90]):
        words = text.split(" ")
        extra.append((1_000 + i, [text, text.replace(" ", "\n"), " ".join([*words[:-1], "end"]), f"{text} mail a{i}@b.co or +1 202 555 {i:04d}"][k % 4]))
    private = [(7_000 + i, f"{text} mail a{i}@b.co") for i, text in rated(40, 9)[0]]
    rows += [*extra, *private, (5_000, None), (5_001, "")]
    docs = [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(g > 0), int(g == 1)) for i, g in grades]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def test_run_equals_brute_force(spark, sf_dir):
    import public_tokenizers

    folder, rows = sf_dir
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    model = quality.train(read("documents"), quality.ratings_of(read("labels")))
    words = quality.Features()
    left = [(i, t) for i, t in rows if model.tails(np.array([model.score(quality.text_features(t or "", words))]))[0, -1] >= 0.5]
    assert 0 < len(left) < len(rows)
    left = [(i, t) for i, t in left if i in {keep for _, keep, _, _ in exact(left)}]
    components = {i: c for i, _, c in near(left, corpus_pipeline.NEAR_WORDS, *corpus_pipeline.NEAR_FROM)}
    left = [(i, t) for i, t in left if components[i] == i]
    left = [(i, t if t is None else pii.masked(t, [s for found in pii.find_spans(t) for s in found])) for i, t in left]
    assert any("<EMAIL>" in (t or "") for _, t in left)
    out = corpus_pipeline.run(spark, folder).collect()
    check(left, out, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 2_048)


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    folder, _ = sf_dir
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "PII", "best-fit packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes
        docs = out


EXTRA = "id string, row int, keys array<int>, node long, pivot string, recipe string, kept boolean, item long, __key string, __kept int, __rank int, __doc long, n int, digest long, component string"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def folder_of(spark, path, rows, labels, schema=DOCUMENTS):
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), spark.read.parquet(f"{path}/documents.parquet")


def test_stages_of_empty_tables(spark, tmp_path):
    folder, docs = folder_of(spark, tmp_path, [], [])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.collect() == []
        docs = out if out.dtypes == docs.dtypes else docs
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_stages_with_nulls_repeats_ties_and_clashing_columns(spark, tmp_path):
    """Without ratings every document stays; then each stage's law for such rows holds."""
    body = " ".join(f"word{i}" for i in range(60))
    near, long = body + " end", " ".join(f"w{i % 977}x" for i in range(40_000))
    base = [(1, body), (1, body), (2, body.replace(" ", "  ")), (3, near), (4, near), (None, body), (None, None), (5, None), (6, ""), (7, "a@b.co"), (8, long), (9, "one two")]
    rows = [(i, t, None, None, None, "x", 1, [1], 2, "p", "r", False, 3, "k", 4, 5, 6, 7, 8, "c") for i, t in base]
    folder, docs = folder_of(spark, tmp_path, rows, [(1, None, None), (None, 1, 1)], f"{DOCUMENTS}, {EXTRA}")
    held = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes
        held[name] = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
        assert {(r.id, r.row, r.kept, r.component) for r in out.collect()} <= {("x", 1, False, "c")}
        if name == "quality classifier":
            continue  # what a model of one rating keeps is no law
        docs = out
    exact = held["exact dedup"]
    # Of equal texts the longest original stays, of empty ones the smallest doc_id; of repeated rows one.
    assert [(i, t) for i, t in exact if t and t.split() == body.split()] == [(2, body.replace(" ", "  "))]
    assert [i for i, t in exact if not t] == [5] and [i for i, t in exact if t == near] == [3]
    # The near copy goes with the smaller doc_id staying; short texts link with none but their equals.
    assert sorted(i for i, _ in held["n-gram Jaccard join"]) == [2, 5, 7, 8, 9]
    assert dict(held["PII"])[7] == "<EMAIL>" and dict(held["PII"])[5] is None and dict(held["PII"])[8] == long
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == {2, 5, 7, 8, 9} and max(r.piece for r in packed if r.doc_id == 8) > 0
