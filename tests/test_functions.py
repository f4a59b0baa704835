"""Golden rows and properties of the column functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import recognition, replies, text
from docloom.operators import context, corpus, retrieve


def one(spark, expression, *values):
    names = [f"v{i}" for i in range(len(values))]
    frame = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return frame.select(expression(*map(F.col, names)).alias("x")).first().x


@pytest.mark.parametrize(("given_text", "wanted"), [("5.0", "5"), (" a  b ", "a b"), (None, ""), ("-12.0", "-12"), ("5.00", "5.00"), ("a \tb", "a b")])
def test_clean_cell(spark, given_text, wanted):
    assert one(spark, text.clean_cell, given_text) == wanted


def test_stem(spark):
    words = "logged logs engages engaged string being pressing falling bring cats buses tq40 running".split()
    wanted = "log logs engag engag str being press fall bring cats bus tq40 run".split()
    assert [one(spark, text.stem, w) for w in words] == wanted


def test_tokens(spark):
    assert one(spark, text.tokens, "TQ-40 fan logged THERM_ALERT#") == ["tq-40", "tq", "40", "tq40", "fan", "log", "therm_alert#", "therm", "alert", "thermalert"]
    assert one(spark, text.tokens, "alert# tq40") == ["alert#", "tq40", "tq", "40"]
    assert one(spark, text.tokens, None) == [] and one(spark, text.tokens, "the of") == []


def test_identifiers(spark):
    found = one(spark, text.identifiers, "see orr-1847, v4.3.2, 4.3.2, 0x1F, E7731, read-only")
    assert set(found) == {"ORR-1847", "4.3.2", "E7731", "READ-ONLY"}
    assert one(spark, text.identifiers, "V4.3.2.1") == ["3.2.1"]


def test_norms(spark):
    assert one(spark, text.norm_value, "4.3·2 - a_b") == "432AB"
    assert one(spark, text.score_norm, " a-b.c·d_ e") == "ABCD E"
    assert one(spark, text.title_of, "specs/tq_40-data.v2.pdf") == "specs/tq 40 data v2"
    assert one(spark, text.title_of, "a/.env") == "a/ env"


def test_families_and_revisions(spark):
    for path in ("specs/tq40_datasheet_r2.pdf", "specs/tq40_datasheet_r1_WITHDRAWN.pdf"):
        assert one(spark, text.family_key, path) == "specs/tq40_datasheet"
    assert [one(spark, text.revision_number, p) for p in ("r_2.txt", "x_v4.3.2.txt", "revision_2.pdf")] == [2, 4, -1]


def test_lines(spark):
    for sample in ("a\nb\r\nc\rd\u0085e f", "a\n", "\n", "", "\n\n", "x\x0by\x1cz"):
        assert one(spark, text.lines, sample) == sample.splitlines()


@settings(max_examples=40, deadline=None)
@given(sample=st.text(alphabet="abcdefgins-_./#019 AX\n", max_size=60))
def test_tokens_are_lower_case_and_never_stop_words(spark, sample):
    for token in one(spark, text.tokens, sample):
        assert token == token.lower() and " " not in token and token


def test_rank_fusion(spark):
    rows = [(1, 7, "bm25", 0, 1.0), (1, 7, "dense", 1, 1.0), (1, 8, "id", 0, 1.5)]
    frame = spark.createDataFrame(rows, "qid int, chunk_id long, source string, rank0 int, weight double")
    out = {r.chunk_id: r.fused for r in retrieve.fused(frame, "chunk_id").collect()}
    assert out[7] == pytest.approx(1 / 61 + 1 / 62) and out[8] == pytest.approx(1.5 / 61)
    assert {r.chunk_id: r.fused for r in retrieve.fused(frame.orderBy(F.desc("rank0")), "chunk_id").collect()} == pytest.approx(out)


@pytest.mark.parametrize("n", [1, 14, 15, 24, 25, 34, 101])
def test_chunk_windows_cover_all_lines(spark, n):
    body = "\n\n".join(f"{i:03d} " + "x" * 2_600 for i in range(1, n + 1))
    frame = spark.createDataFrame([("a/b_c.txt", 5, False, [(body, "file", False)])], "rel string, file_ord long, withdrawn boolean, units array<struct<text:string,loc:string,is_row:boolean>>")
    out = corpus.chunks(frame).orderBy("chunk_id").collect()
    starts = [int(r.text[:3]) for r in out]
    assert starts == [1 + 10 * k for k in range(len(out))] and int(out[-1].text.split("\n")[-1][:3]) == n
    assert all(r.text.count("\n") < 14 for r in out) and out[0].title == "a/b c"
    assert [r.loc for r in out] == [f"file lines {s}-{min(n, s + 13)}" for s in starts]


@settings(max_examples=30, deadline=None)
@given(lengths=st.lists(st.integers(0, 40), max_size=12))
def test_packing_skips_and_goes_on(spark, lengths):
    frame = spark.createDataFrame([(lengths,)], "n array<bigint>")
    taken = frame.select(context.greedy_fit("n", 60, 3).alias("t")).first().t
    used, wanted = 0, []
    for n in lengths:
        wanted.append(used + n <= 60)
        used += n + 3 if wanted[-1] else 0
    assert taken == wanted


def test_row_units(spark):
    rows = [(1, ["Report"]), (2, ["id", "name", ""]), (3, ["1.0", "", "x"]), (4, []), (5, ["2", "b", "y"])]
    frame = spark.createDataFrame(rows, "row_ord int, cells array<string>")
    out = [(r.text, r.loc) for r in corpus.row_units(frame, "csv").orderBy("row_ord").collect()]
    assert out == [("csv | Report", "csv row 1"), ("csv columns: id | name", "csv header"), ("csv | id: 1 | col3: x", "csv row 3"), ("csv | id: 2 | name: b | col3: y", "csv row 5")]
    assert corpus.row_units(frame, "csv", most=1).count() == 2


def test_unit_patterns(spark):
    assert one(spark, replies.clean_answer, None) == ""
    assert one(spark, recognition.without_banners, "TEXAS") == ""
    assert one(spark, replies.safe_name, "../a b") == "a_b"
