import math
import random

import pytest

from docloom.llm import topk

SCHEMA = "vec_id long, embedding array<double>"


def taken(v):
    return v is not None and all(x is not None and math.isfinite(x) and math.isfinite(256.0 * x) for x in v)


def brute(rows, asked, k):
    whole = lambda v: [math.floor(256.0 * x) for x in v]
    held = [(i, whole(v)) for i, v in rows if i is not None and taken(v)]
    out = []
    for q, v in asked:
        if q is None or not taken(v):
            continue
        w = whole(v)
        scored = sorted((-sum(a * b for a, b in zip(w, c, strict=True)), i) for i, c in held if i != q and len(c) == len(w))
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def found(frame):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in frame.collect())


@pytest.mark.parametrize("scale", [1.0, 0.01, 1e6])
def test_against_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 31)
    monkeypatch.setattr(topk, "PARTS", 2)
    monkeypatch.setattr(topk, "TOGETHER", 3)
    rng = random.Random(2)
    common = [rng.gauss(0, scale) for _ in range(6)]
    rows = [(i, common if rng.random() < 0.4 else [rng.gauss(0, scale) for _ in range(6)]) for i in range(300)]
    rows += [(None, common), (900, None), (950, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1000, [float("nan")] * 6), (1050, [float("inf")] * 6), (1100, [1.0, 2.0]), (1150, [2.0, 1.0]), (1101, [0.5, 0.5]), (1200, []), (1201, [])]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    asked = [r for r in rows if r[0] is not None and r[0] % 25 == 0]
    out = topk.top_inner_products(frame.selectExpr("*", "1 as block", "2 as n", "'x' as kind"), frame.where("vec_id % 25 = 0"), 5)
    assert found(out) == brute(rows, asked, 5)


def test_exact_beyond_doubles(spark):
    rows = [(0, [3e15, 1.0]), (1, [1.0, 3.0]), (2, [1.0, 5.0]), (3, [1.0, 4.0]), (4, [-1.0, 0.0])]
    out = topk.top_inner_products(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows[:1], SCHEMA), 2)
    capped = [(q, r, v, min(s, 2**62 - 1)) for q, r, v, s in brute(rows, rows[:1], 2)]
    assert [x[:3] for x in found(out)] == [(0, 1, 1), (0, 2, 2)] or found(out) == capped


def test_fewer_candidates_than_k_and_empty(spark):
    rows = [(0, [1.0]), (1, [1.0]), (2, [-1.0])]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert found(topk.top_inner_products(frame, frame, 5)) == brute(rows, rows, 5)
    none = spark.createDataFrame([], SCHEMA)
    assert topk.top_inner_products(none, none, 5).collect() == []
    assert topk.top_inner_products(frame, none, 5).collect() == []
    alone = spark.createDataFrame(rows[:1], SCHEMA)
    assert topk.top_inner_products(alone, alone, 5).collect() == []


def test_blocks_of_small_vectors_are_skipped(spark, monkeypatch):
    """Long vectors first, then short ones whose scores can't reach the k-th: the result is whole."""
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 20)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 50.0 if i < 40 else 0.01) for _ in range(4)]) for i in range(200)]
    frame = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    asked = [r for r in rows if r[0] % 10 == 0]
    assert found(topk.top_inner_products(frame, frame.where("vec_id % 10 = 0"), 5)) == brute(rows, asked, 5)


def test_the_query_with_clashing_columns(spark, tmp_path):
    from docloom.llm import registry

    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(150)]
    wide = [(*r, 1, "x", 2.0, 3, 4) for r in rows]
    spark.createDataFrame(wide, f"{SCHEMA}, block int, kind string, norm double, rank int, query_id int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert found(registry.op9_topk(spark, str(tmp_path))) == brute(rows, [r for r in rows if r[0] % 50 == 0], 5)
