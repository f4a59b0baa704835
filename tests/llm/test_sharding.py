import random
import zlib

import pytest
from pyspark.sql import functions as F

from docloom.llm import sharding
from tests.llm.fixtures import DOCS, clashing, corpus


@pytest.mark.parametrize(("dimensions", "bits"), [(1, 3), (2, 1), (2, 4), (3, 2), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_by_single_steps(dimensions, bits):
    index = sharding.curve(dimensions, bits)
    assert sorted(index) == list(range(len(index)))
    order = sorted(range(len(index)), key=index.__getitem__)
    mask = (1 << bits) - 1
    points = [[cell >> bits * i & mask for i in range(dimensions)] for cell in order]
    for a, b in zip(points, points[1:], strict=False):
        assert sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1


def test_too_many_cells():
    with pytest.raises(ValueError):
        sharding.curve(4, 4)


def rows_of(n=500, seed=1):
    rng = random.Random(seed)
    hot = "x" * 40
    return [(rng.choice([i, i, None]), rng.choice([hot, None, "é" * rng.randrange(90), "y" * rng.randrange(2_000)]), rng.choice(["en", "de", "fr", None]), rng.choice(["src0"] * 5 + [f"src{k}" for k in range(9)])) for i in range(n)]


def dimensions_of():
    return {"lang": F.col("lang"), "source": F.col("source"), "bytes": F.octet_length("text")}


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_laws_slots_and_curve_order(spark, law):
    rows = rows_of()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = sharding.hilbert_shards(docs, dimensions_of(), 7, law).collect()
    wanted = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _, _ in rows), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in out), key=str) == wanted
    assert sorted(r["rank"] for r in out) == list(range(len(rows)))
    ordered = sorted(out, key=lambda r: r["rank"])
    assert [r.curve for r in ordered] == sorted(r.curve for r in out)
    assert [r.shard for r in ordered] == sorted(r.shard for r in out)
    total, before = sum(w[1] for w in wanted), 0
    for k, r in enumerate(ordered):
        assert r.shard == (k * 7 // len(rows) if law == "rows" else before * 7 // total)
        before += r.size
    for shard in range(7):
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))
    counts = [sum(r.shard == s for r in out) for s in range(7)]
    assert law == "bytes" or max(counts) - min(counts) <= 1


def test_clashing_columns_empty_table_and_few_rows(spark):
    rows = corpus()
    docs = clashing(spark, rows)
    out = sharding.hilbert_shards(docs, {"n": F.col("n"), "flag": F.col("kept"), "bytes": F.octet_length("text")}, 5, carry=("id", "n", "text"))
    assert out.count() == len(rows) and {r.carried.id for r in out.collect()} == {"x"}
    ranges = sharding.shard_ranges(out, ["text"]).collect()
    assert sum(r.n for r in ranges) == len(rows)
    assert sharding.hilbert_shards(spark.createDataFrame([], DOCS), {"bytes": F.octet_length("text")}, 3).collect() == []
    few = sharding.hilbert_shards(spark.createDataFrame([(1, "a"), (2, "b")], DOCS), {"bytes": F.octet_length("text")}, 24).collect()
    assert sorted(r.slot for r in few) == [0, 0]


def test_written_shards_prune(spark, tmp_path):
    docs = spark.createDataFrame(rows_of(400, 2), "doc_id long, text string, lang string, source string").withColumn("slot", F.lit(1))
    sharding.write_shards(docs, str(tmp_path / "out"), dimensions_of(), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 400 and set(back.columns) == {*docs.columns, "shard"}
    spread = back.groupBy("lang").agg(F.countDistinct("shard").alias("n")).where("lang is not null").agg(F.min("n")).first()[0]
    assert spread < 4


def test_long_shared_prefixes_get_codes_of_their_own(spark):
    rows = [(i, "x", f"https://example.org/a/very/long/shared/prefix/site{i % 16}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = sharding.hilbert_shards(docs, {"source": F.col("source")}, 16, carry=("source",)).collect()
    assert len({r.curve for r in out}) == 16
    assert all(len({r.carried.source for r in out if r.shard == k}) == 1 for k in range(16))


def test_codes_of_strings_are_equally_filled(spark):
    rng = random.Random(5)
    rows = [(i, None, rng.choice([None, f"{rng.randrange(10**9):x}", "hot"])) for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = sharding.hilbert_shards(docs, {"source": F.col("source")}, 8, bits=3, carry=("source",)).collect()
    found = sorted((r.carried.source, r.curve) for r in out if r.carried.source is not None)
    assert [c for _, c in found] == sorted(c for _, c in found)
    counts = [sum(c == k for _, c in found) for k in {c for s, c in found if s != "hot"}]
    assert max(counts) < 2_000 * 0.5 + 2_000 / 8 + 60 and len({c for _, c in found}) >= 4


def test_written_shards_let_a_reader_skip_files(spark, tmp_path):
    """A filter on any dimension meets fewer shards, by their ranges, than in the order of doc_id."""
    rng = random.Random(9)
    rows = [(i, "y" * rng.randrange(4_000), rng.choice(["de", "en", "es", "fr"]), f"https://host/{rng.randrange(40):02}") for i in range(6_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n", F.length("text"))
    placed = sharding.hilbert_shards(docs, {"lang": F.col("lang"), "source": F.col("source"), "n": F.col("n")}, 64, carry=("lang", "source", "n"))
    curve = sharding.shard_ranges(placed, ["lang", "source", "n"]).collect()
    plain = sharding.shard_ranges(placed.withColumn("shard", F.floor(F.col("doc_id") * 64 / len(rows))), ["lang", "source", "n"]).collect()
    met = lambda ranges, c, v: sum(r[f"min_{c}"] <= v <= r[f"max_{c}"] for r in ranges)
    for column, value in (("lang", "de"), ("source", "https://host/07"), ("n", 3_000)):
        assert met(plain, column, value) == 64 and met(curve, column, value) < 64 * 0.6
