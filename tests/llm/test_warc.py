import hashlib
import random
from pathlib import Path

from docloom.llm import warc

PAGES = "page_id long, url string, html string"


def pages(n=300):
    rng = random.Random(3)
    rows = [(i, f"http://h{rng.randrange(4)}/é/{i}", "<p>" + "wörd " * rng.randrange(40)) for i in range(n)]
    return [*rows, (None, None, None), (None, "http://x/\r\ny", ""), (7_000, None, "z" * 100_000), rows[3], rows[3]]


def test_records_lie_where_fixity_says(spark, tmp_path):
    frame = spark.createDataFrame(pages(), PAGES).selectExpr("*", "1 as seq", "2 as record", "'a' as warc_file")
    records = warc.warc_records(frame, 40)
    kept = sorted(warc.fixity(records).drop("page_id").collect())
    assert len(kept) == len(pages())
    warc.write_warc(records, str(tmp_path / "w"))
    back = sorted(warc.read_fixity(spark, str(tmp_path / "w")).collect())
    assert [tuple(r) for r in back] == [tuple(r) for r in kept]
    for folder in (tmp_path / "w").glob("warc_file=*"):
        data = next(folder.glob("part-*.txt")).read_bytes()
        number = int(folder.name.split("=")[1])
        for r in kept:
            if r.warc_file == number:
                part = data[r.offset : r.offset + r.length]
                assert part.startswith(b"WARC/1.1\r\n") and hashlib.sha256(part).hexdigest() == r.sha256


def test_audit_of_files_finds_the_corrupt_records(spark, tmp_path):
    records = warc.warc_records(spark.createDataFrame(pages(), PAGES), 40)
    warc.write_warc(records, str(tmp_path / "a"))
    warc.write_warc(records, str(tmp_path / "b"))
    first = warc.read_fixity(spark, str(tmp_path / "a"))
    same, counts = warc.audit(first, warc.read_fixity(spark, str(tmp_path / "b")), 4)
    assert same.collect() == [] and counts == [0]
    target = sorted(first.where("length > 300").collect())[17]
    path = next(Path(tmp_path / "b" / f"warc_file={target.warc_file}").glob("part-*.txt"))
    data = bytearray(path.read_bytes())
    data[target.offset + target.length - 5] ^= 1
    path.write_bytes(data)
    Path(path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    found, counts = warc.audit(first, warc.read_fixity(spark, str(tmp_path / "b")), 4)
    assert [tuple(r) for r in found.collect()] == [(target.warc_file, target.seq, "corrupt")]
    assert set(counts) == {1}


def test_lost_inserted_swapped_and_corrupt_records(spark):
    """Whatever stands behind a damaged place stays intact."""
    rows = [r.asDict() for r in warc.fixity(warc.warc_records(spark.createDataFrame([(i, f"http://h/{i}", f"text {i}") for i in range(80)], PAGES), 100_000)).collect()]
    rows.sort(key=lambda r: r["seq"])
    copy = [dict(r) for r in rows]
    copy[50]["sha256"] = "0" * 64
    copy[30], copy[31] = copy[31], copy[30]
    copy.insert(61, dict(rows[5], record_id="new", sha256="1" * 64))
    copy.append(copy.pop(20))
    del copy[5]
    for seq, r in enumerate(copy):
        r["seq"] = seq
    columns = "warc_file long, seq long, length long, sha256 string, record_id string"
    frame = lambda side: spark.createDataFrame([tuple(r[c.split()[0]] for c in columns.split(", ")) for r in side], columns)
    found, counts = warc.audit(frame(rows), frame(copy), 4)
    out = {(r.seq, r.verdict) for r in found.collect()}
    inserted = next(r["seq"] for r in copy if r["record_id"] == "new")
    assert out - {(30, "moved"), (31, "moved")} == {(5, "missing"), (50, "corrupt"), (inserted, "extra"), (20, "moved")}
    assert len(out) == 5 and counts[0] == 1
    lost = [dict(r) for r in rows if r["seq"] != 17]
    for seq, r in enumerate(lost):
        r["seq"] = seq
    assert [tuple(r) for r in warc.audit(frame(rows), frame(lost), 4)[0].collect()] == [(0, 17, "missing")]
    assert [tuple(r) for r in warc.audit(frame(lost), frame(rows), 4)[0].collect()] == [(0, 17, "extra")]


def test_the_longest_ascending_run():
    assert warc._out_of_order([]) == [] and warc._out_of_order([3, 4, 9]) == [False] * 3
    assert warc._out_of_order([1, 2, 9, 3, 4]) == [False, False, True, False, False]


def test_audited_pages_against_brute_force(spark):
    rows = pages(700)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{PAGES}, seq int, record string")
    out = warc.audited_pages(frame, records_per_file=50).collect()
    wanted = []
    for page, url, html in rows:
        target = (url if url is not None else f"urn:page:{'none' if page is None else page}").replace("\r", " ").replace("\n", " ")
        name = hashlib.md5(f"{'' if page is None else page}|{target}".encode()).hexdigest()
        body = html or ""
        record = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:md5:{name}>\r\nWARC-Date: {warc.DATE}\r\nWARC-Target-URI: {target}\r\nContent-Type: text/html\r\nContent-Length: {len(body.encode())}\r\n\r\n{body}"
        rotten = int(hashlib.md5(b"rot|" + hashlib.md5(record.encode()).hexdigest().encode()).hexdigest()[:8], 16) % 200 == 0
        wanted.append((str(page), len(record.encode()), hashlib.sha256(record.encode()).hexdigest(), "corrupt" if rotten else "intact"))
    assert sorted((str(r.page_id), r.record_length, r.record_sha256, r.verdict) for r in out) == sorted(wanted)
    assert {w[3] for w in wanted} == {"intact", "corrupt"}
    for file in {r.warc_file for r in out}:
        at = 0
        for r in sorted((r for r in out if r.warc_file == file), key=lambda r: r.record_offset):
            assert r.record_offset == at
            at += r.record_length + len(warc.END)
    assert warc.audited_pages(spark.createDataFrame([], PAGES)).collect() == []


def test_unreadable_rest_is_one_record():
    good = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [(a, b) for a, b, *_ in warc.parse_warc(good + b"junk")] == [(0, len(good) - 4), (len(good), 4)]
    assert list(warc.parse_warc(b"")) == []
