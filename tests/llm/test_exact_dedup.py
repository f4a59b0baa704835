import hashlib
import re

from docloom.llm import exact_dedup
from tests.llm.fixtures import DOCS, clashing, corpus


def brute(rows):
    plain = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    groups = {}
    for (doc, text), p in zip(rows, plain, strict=True):
        groups.setdefault(p, []).append((-len(text or ""), doc is None, doc or 0))
    out = []
    for (doc, _), p in zip(rows, plain, strict=True):
        best = min(groups[p])
        keep = None if best[1] else best[2]
        out.append((doc, keep, len(groups[p]), hashlib.sha256(p.encode()).hexdigest()))
    return sorted(out, key=str)


def found(frame):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in frame.collect()), key=str)


def test_against_brute_force(spark):
    rows = corpus()
    out = exact_dedup.exact_duplicates(clashing(spark, rows))
    assert found(out) == brute(rows)
    assert sum(r.kept for r in out.collect()) == len({r[3] for r in brute(rows)})


def test_colliding_digests_are_told_apart(spark):
    rows = corpus(5, 80)
    out = exact_dedup.exact_duplicates(spark.createDataFrame(rows, DOCS), cut=(64, 5, 256), digest_bytes=1)
    assert found(out) == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "ab"), (2, "ab"), (None, None), (None, ""), (3, " ")]
    out = exact_dedup.exact_duplicates(spark.createDataFrame(rows, DOCS))
    assert found(out) == brute(rows)
    assert sum(r.kept for r in out.collect()) == 2
    stayed = exact_dedup.kept_rows(spark.createDataFrame(rows, DOCS), out).collect()
    assert sorted((r.doc_id, r.text) for r in stayed) == [(1, "a b"), (3, " ")]


def test_empty_table(spark):
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_cuts_follow_the_content():
    rng = __import__("random").Random(1)
    data = bytes(rng.randrange(256) for _ in range(120_000))
    ends = exact_dedup.cut_points(data)
    assert ends[-1] == len(data) and all(a < b for a, b in zip(ends, ends[1:], strict=False))
    shifted = exact_dedup.cut_points(b"some new bytes" + data)
    assert len({e - 14 for e in shifted} & set(ends)) > len(ends) // 2
    assert exact_dedup.cut_points(b"") == [] and exact_dedup.cut_points(b"x") == [1]
    assert max(b - a for a, b in zip([0, *ends], ends, strict=False)) <= exact_dedup.MAX_CHUNK
