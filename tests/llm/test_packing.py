import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from docloom.llm import packing
from docloom.llm.registry import vocabulary
from tests.llm.fixtures import DOCS, clashing, corpus


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_tokenizer(tokenizer):
    rng = random.Random(2)
    texts = ["".join(rng.choices(["the", " ", "  ", "\n", "Zürich", "it's", "1234", "!?", "<|endoftext|>", "\t", "京都", "_x", " a", "\xa0", "é"], k=30)) for _ in range(400)]
    texts += ["", " ", "a", " a", "a ", "a\n b", "a \nb", *(t or "" for _, t in corpus())]
    texts += ["".join(rng.choices([chr(c) for c in (*range(0x250), 0x2028, 0x300, 0x4EAC, 0x1F642, 0xFFFD)], k=20)) for _ in range(400)]
    bpe = packing.ByteBpe(*vocabulary())
    for text in texts:
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def check(rows, out, tokenizer, size):
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    seen, places = {}, {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == seen.get(r.doc_id, 0) and 0 < r.length <= size
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(part) == r.ids_crc32
        assert r.piece == 0 or r.length == size
        seen[r.doc_id] = r.start + r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {i: len(x) for i, x in ids.items()}
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(places), sum(map(len, ids.values()))


@pytest.mark.parametrize("size", [2048, 100])
def test_packing_is_whole_and_tight(spark, tokenizer, size):
    rows = corpus()
    docs = clashing(spark, rows).repartition(7)
    bins, tokens = check(rows, packing.packed_documents(docs, *vocabulary(), size=size).collect(), tokenizer, size)
    assert bins <= -(-tokens // size) * 1.05 + 1


def test_tree_with_many_nodes(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 5, 30, 51, 60, 99, 100])) for i in range(500)]
    out = packing.pack(spark.createDataFrame(rows, "item long, length int").repartition(9), 100).collect()
    lengths, bins = dict(rows), {}
    assert sorted(r.item for r in out) == sorted(lengths)
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, lengths[r.item]))
    for parts in bins.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 100


@pytest.mark.parametrize("lengths", [list(range(1_100, 2_041)), [100, 2_000, 1_000, 1_030, 700], list(range(1, 2_049, 3))])
def test_bins_that_are_not_handed_on_would_save_nothing(spark, monkeypatch, lengths):
    """A tree that hands on every bin ends with as many sequences."""
    rng = random.Random(4)
    items = spark.createDataFrame([(i, rng.choice(lengths)) for i in range(3_000)], "item long, length int").repartition(12)
    used = lambda: packing.pack(items).select("sequence_id").distinct().count()
    monkeypatch.setattr(packing, "FAN_IN", 3)
    few = used()
    monkeypatch.setattr(packing, "LEVELS", 10_000)
    assert few == used()


def test_edges(spark):
    assert packing.packed_documents(spark.createDataFrame([], DOCS), *vocabulary()).collect() == []
    out = packing.packed_documents(spark.createDataFrame([(1, None), (1, None), (None, "")], DOCS), *vocabulary()).collect()
    assert [r.length for r in out] == [1, 1, 1] and len({(r.sequence_id, r.offset) for r in out}) == 3
    with pytest.raises(Exception, match="length out of range"):
        packing.pack(spark.createDataFrame([(1, 101)], "item long, length int"), 100).collect()


def test_best_fit_is_best_fit():
    place, offset, fills = packing.best_fit(np.array([60, 50, 40, 30, 10, 100]), 100)
    assert sorted(fills.tolist()) == [90, 100, 100]
    assert place[0] == place[2] and offset[2] == 60
