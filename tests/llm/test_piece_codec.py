import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece

from docloom.llm import piece_codec
from tests.llm.fixtures import DOCS, clashing, corpus


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def soup(seed=1, n=500):
    rng = random.Random(seed)
    bits = ["the", "ing", " ", "  ", "   ", "     ", "\n", "\t", "Zürich", "ß", "123", "!?", "京都", "🙂", "▁", "aaaa", "ational", "ñandú", "x", "<s>", "<0x41>", "é", "Ａ", "ﬁ", "\xa0"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(n)]
    return [*texts, "", " ", "  ", " " * 37, "a" + " " * 16, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=300))]


def test_ids_equal_the_library(path):
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    encoder = piece_codec.PrefixEncoder(piece_codec.PieceModel.load(path))
    texts = soup() + [t or "" for _, t in corpus()]
    for text, (raw, _) in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(text), text


def test_decoding_equals_the_library(path):
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    decoder = piece_codec.PieceDecoder(piece_codec.PieceModel.load(path))
    for text in soup(2):
        ids = library.encode(text)
        assert decoder.decode(np.array(ids, np.int64)) == text.replace("▁", " ")


def test_viterbi_of_scored_pieces():
    rng = random.Random(5)
    pieces = {"▁": -4.0, "a": -3.0, "b": -3.1, "c": -5.0}
    for _ in range(25):
        pieces["".join(rng.choices("▁abc", [0.2, 1, 1, 1], k=1) + rng.choices("abc", k=rng.randint(1, 4)))] = -rng.uniform(2, 9)
    listed = [None, *pieces.items()]
    model = piece_codec.PieceModel(listed, "unigram", None, 0)
    words = {"▁" + "".join(rng.choices("abcd", [1, 1, 1, 0.1], k=rng.randint(0, 9))) for _ in range(300)}

    def best(word):
        table = [(0.0, [])]
        for end in range(1, len(word) + 1):
            options = [(table[end - 1][0] + model.penalty, [*table[end - 1][1], 0])]
            options += [(table[end - n][0] + pieces[word[end - n : end]], [*table[end - n][1], model.ids[word[end - n : end]]]) for n in range(1, end + 1) if word[end - n : end] in pieces]
            table.append(max(options, key=lambda o: o[0]))
        return table[-1]

    out = list(piece_codec.PrefixEncoder(model).encode_words(words))
    assert {word for word, _, _ in out} == words
    for word, ids, score in out:
        assert sum(model.penalty if i == 0 else model.scores[i] for i in ids) == pytest.approx(score) == pytest.approx(best(word)[0])


def real_words():
    import duckdb

    rows = duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' WHERE text IS NOT NULL").fetchall()
    return {piece_codec.MARK + w for (t,) in rows for w in t.split(" ") if w}


def test_forward_scores_of_real_text(path):
    """The path's score is the sum of its pieces' scores, whatever prefixes were shared; the same pieces
    taken as a unigram model get the best path of the whole lattice."""
    words = real_words()
    model = piece_codec.PieceModel.load(path)
    piece_scores = lambda m, ids: sum(m.scores.get(i, 0.0) for i in ids)
    alone = piece_codec.PrefixEncoder(model)
    for word, ids, score in piece_codec.PrefixEncoder(model).encode_words(words):
        if all(i in model.scores for i in ids):
            assert score == pytest.approx(piece_scores(model, ids))
        assert next(alone.encode_words({word}))[1:] == (ids, score)
    scored = piece_codec.PieceModel.load(path, "unigram")
    for word, ids, score in piece_codec.PrefixEncoder(scored).encode_words(set(sorted(words)[:400])):
        table = [0.0]
        for end in range(1, len(word) + 1):
            steps = [table[end - n] + scored.scores[scored.ids[word[end - n : end]]] for n in range(1, end + 1) if word[end - n : end] in scored.ids]
            table.append(max(steps, default=table[end - 1] + scored.penalty))
        assert score == pytest.approx(table[-1])


def test_stable_pairs_are_those_that_merging_leaves(path):
    model = piece_codec.PieceModel.load(path)
    encoder, rng = piece_codec.PrefixEncoder(model), random.Random(3)
    reached = [p for p in model.ids if len(p) == 1 or encoder._split[p]]
    assert all((model.merged(p) == [p]) == (len(p) == 1 or bool(encoder._split[p])) for p in rng.sample(sorted(model.ids), 3_000))
    short = [p for p in reached if len(p) < 4]
    for _ in range(6_000):
        left, right = rng.choice(short if rng.random() < 0.7 else reached), rng.choice(short if rng.random() < 0.7 else reached)
        assert encoder._stable(left, right) == (model.merged(left + right) == [left, right]), (left, right)


def test_round_trip_on_frames(spark, path):
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [*corpus(), (None, None), (500, "a  b"), (500, "a  b")]
    out = sorted(((str(r.doc_id), r.n_ids, r.ids_crc32, r.decoded_sha256) for r in piece_codec.round_trip(clashing(spark, rows), path).collect()))
    wanted = []
    for i, t in rows:
        ids = library.encode(t or "")
        wanted.append((str(i), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256((t or "").encode()).hexdigest()))
    assert out == sorted(wanted)
    assert piece_codec.round_trip(spark.createDataFrame([], DOCS), path).collect() == []
