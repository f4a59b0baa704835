import random
import re

import pytest

from docloom.llm import ngram_join
from docloom.llm.components import connected_components
from tests.llm.fixtures import DOCS, clashing, corpus


def shingles(text, n):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or {tuple(words)}


def brute(rows, n, num, den):
    sets = {i: shingles(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and den * common >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def found(frame):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect())


@pytest.mark.parametrize(("n", "num", "seed"), [(3, 90, 3), (5, 80, 4), (1, 60, 5)])
def test_against_brute_force(spark, n, num, seed):
    rows = corpus(seed, 250)
    assert found(ngram_join.jaccard_components(clashing(spark, rows), n, (num, 100))) == brute(rows, n, num, 100)


def test_a_group_of_near_copies_and_blocks_of_a_large_tile(spark, monkeypatch):
    """Texts around a shared body: neighbours in a tile often don't link while others do."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "FIRST_ALLOWANCE", 1)
    rng = random.Random(9)
    body = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(body)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6])):
            words[rng.randrange(120)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    for num in (80, 90, 95):
        assert found(ngram_join.jaccard_components(spark.createDataFrame(rows, DOCS), 2, (num, 100))) == brute(rows, 2, num, 100)


def test_nulls_ties_and_empty_table(spark):
    rows = [(7, None), (8, ""), (9, "a b c d"), (4, "A b  C\nd"), (5, "é b c d"), (6, "É b c d"), (4, "A b  C\nd"), (None, "a b c d")]
    out = ngram_join.jaccard_components(spark.createDataFrame(rows, DOCS), 3, (90, 100))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str) == sorted([(7, 0, 7), (8, 0, 8), (9, 2, 4), (4, 2, 4), (5, 2, 5), (6, 2, 6), (4, 2, 4), (None, 2, None)], key=str)
    docs = spark.createDataFrame(rows, DOCS)
    stayed = sorted((str(r.doc_id), r.text) for r in ngram_join.one_of_each(docs, out).collect())
    assert stayed == [("4", rows[3][1]), ("4", rows[3][1]), ("5", "é b c d"), ("6", "É b c d"), ("7", None), ("8", ""), ("None", "a b c d")]
    assert ngram_join.jaccard_components(spark.createDataFrame([], DOCS)).collect() == []


def test_components_of_a_long_path(spark):
    rows = [(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 5), (9, 9)]
    out = {r.id: r.component for r in connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert out == {i: 100 for i in range(100, 161)} | {5: 5, 9: 5}


def test_linking_sets_share_a_tile():
    import numpy as np

    rng = np.random.default_rng(2)
    for num, den in ((90, 100), (80, 100), (60, 100)):
        for _ in range(400):
            n = int(rng.integers(2, 400))
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            drop, add = int(rng.integers(0, n // 4 + 1)), int(rng.integers(0, n // 4 + 1))
            b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 2**63, add).astype(np.uint64))))
            common = len(np.intersect1d(a, b))
            if len(b) and common < max(len(a), len(b)) and den * common >= num * (len(a) + len(b) - common):
                assert set(ngram_join.tile_keys(a, num, den)[0].tolist()) & set(ngram_join.tile_keys(b, num, den)[0].tolist())


def test_rows_that_repeat_a_doc_id_with_other_texts(spark):
    words = lambda name: [f"{name}{i}" for i in range(60)]
    rows = []
    for doc, name in ((1, "a"), (2, "b"), (3, "c")):
        rows += [(9, " ".join(words(name))), (doc, " ".join([*words(name)[:-1], "end"]))]
    rows += [(9, rows[0][1]), (9, "alone in the world"), (None, rows[0][1])]
    expected = sorted([(9, 58, 1), (9, 58, 1), (9, 58, 2), (9, 58, 3), (9, 2, 9), (1, 58, 1), (2, 58, 2), (3, 58, 3)])
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        out = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, (90, 100)).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out if r.doc_id is not None) == expected
        assert [(r.n_shingles, r.component_id) for r in out if r.doc_id is None] == [(58, None)]


def test_linking_sets_keep_a_tile_when_each_leaves_its_most_frequent():
    """The rule of the frequent tiles, on sets with much in common."""
    import numpy as np

    rng = np.random.default_rng(7)
    pairs = 0
    for num, den in ((90, 100), (80, 100)):
        for size in (9, 40, 130, 300):
            common = rng.integers(0, 2**63, size).astype(np.uint64)
            sets = []
            for _ in range(40):
                own = rng.integers(0, 2**63, int(rng.integers(0, max(2, size // 3)))).astype(np.uint64)
                sets.append(np.unique(np.concatenate((rng.permutation(common)[: int(rng.integers(size * 3 // 4, size + 1))], own))))
            found = [ngram_join.tile_keys(s, num, den) for s in sets]
            count = {}
            for keys, _ in found:
                for key in keys.tolist():
                    count[key] = count.get(key, 0) + 1
            kept = []
            for keys, spare in found:
                held = set()
                for parity in (0, 1):
                    held |= set(sorted((k for k in keys.tolist() if k % 2 == parity and count[k] > 1), key=lambda k: (-count[k], k))[spare[parity] :])
                kept.append(held)
            for i, a in enumerate(sets):
                for j in range(i):
                    shared = len(np.intersect1d(a, sets[j]))
                    if not np.array_equal(a, sets[j]) and den * shared >= num * (len(a) + len(sets[j]) - shared):
                        pairs += 1
                        assert kept[i] & kept[j]
    assert pairs > 100


def test_signatures_never_rule_out_a_link():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 3_000))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate((rng.permutation(a)[int(rng.integers(0, n // 5 + 1)) :], rng.integers(0, 2**63, int(rng.integers(0, n // 5 + 1))).astype(np.uint64))))
        x, y = (np.frombuffer(ngram_join.bitmap(s), np.uint8) for s in (a, b))
        width = min(len(x), len(y))
        shared = len(np.intersect1d(a, b))
        fits, most = ngram_join.may_link(len(a), len(b), ngram_join.folded(x, width), ngram_join.folded(y, width), 90, 100)
        assert most >= shared and (fits or 100 * shared < 90 * (len(a) + len(b) - shared))
