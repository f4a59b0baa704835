"""WARC files and their Merkle fixity audit.

Records are hashed one by one.  A file's records, in offset order, are the leaves of a tree whose
inner nodes each hash a range of neighbours in order; the files' roots are the leaves of the tree
above.  A range begins at a record whose identifier's hash says so, and is named by it, so ranges
find each other again behind a record that was lost or put in.  Two replicas are compared from the
root down and only below nodes that differ, so that equal replicas cost one comparison and a corrupt
record one for each level.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import discard, materialise, tidy

FAN_OUT = 16
RECORDS_PER_FILE = 1_000
#: The date that all records written in a run carry.
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"


def _hashed(column: Column, bits: int = 32) -> Column:
    """The first ``bits`` bits of a string's MD5 as a number."""
    return F.conv(F.substring(F.md5(column.cast("binary")), 1, bits // 4), 16, 10).cast("long")


def record_text(url: Column, html: Column, page_id: Column) -> Column:
    """A resource record without its two closing line ends.  Null url: ``urn:page:`` and the id."""
    target = F.regexp_replace(F.coalesce(url, F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")))), "[\r\n]", " ")
    body = F.coalesce(html, F.lit(""))
    name = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), target).cast("binary"))
    length = F.octet_length(body).cast("string")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:md5:"), name,
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), target,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), length, F.lit(END),
    )
    return F.concat(head, body)


def warc_records(pages: DataFrame, records_per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """page_id, warc_file, record of each row of ``pages`` (page_id, url, html).

    Files hold about ``records_per_file`` records each, dealt by a hash of page_id and url (and of
    the page where page_id is null), so that no host and no id fills a file.
    """
    files = max(1, -(-pages.count() // records_per_file))
    page, url, html = F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")
    key = F.concat_ws("|", page.cast("string"), F.coalesce(url, F.lit("")), F.when(page.isNull(), F.md5(F.coalesce(html, F.lit("")).cast("binary"))))
    return pages.select(page.alias("page_id"), F.pmod(_hashed(key), F.lit(files)).alias("warc_file"), record_text(url, html, page).alias("record"))


def _identified(record: Column) -> Column:
    return F.regexp_extract(record, r"\r\nWARC-Record-ID:[ \t]*<([^>\r\n]*)>", 1)


def _placed(hashed: DataFrame, *order: str) -> DataFrame:
    """page_id, warc_file, seq, offset, length, sha256, record_id of records in the ``order`` of their file."""
    rows = Window.partitionBy("warc_file").orderBy(*order)
    before = F.coalesce(F.sum(F.col("length") + len(END)).over(rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return hashed.select("page_id", "warc_file", (F.row_number().over(rows) - 1).cast("long").alias("seq"), before.cast("long").alias("offset"), "length", "sha256", "record_id")


def _hashes(record: str = "record") -> list[Column]:
    return [F.octet_length(record).cast("long").alias("length"), F.sha2(F.col(record).cast("binary"), 256).alias("sha256"), _identified(F.col(record)).alias("record_id")]


def fixity(records: DataFrame) -> DataFrame:
    """page_id, warc_file, seq, offset, length, sha256, record_id of records: where each lies in its file.

    Records of a file stand by page_id, then digest; each is followed by two line ends.
    """
    return _placed(records.select("page_id", "warc_file", *_hashes()), "page_id", "sha256")


class MerkleTree:
    """Levels of (file, key, digest, seq, up_file, up_key): leaves, ranges of ever more leaves, files,
    groups of files; ``up_*`` name the node above.

    A leaf's key is its record's identifier and which of the records with it in the file it is; its
    digest covers these, the length and the content.  A range's key is that of its first leaf, but
    the first range of a file has the empty key.  Levels up to ``own`` are inside files.
    """

    def __init__(self, leaves: DataFrame, depth: int, own: int, fan_out: int = FAN_OUT) -> None:
        rows, same = Window.partitionBy("warc_file").orderBy("seq"), Window.partitionBy("warc_file", "record_id").orderBy("seq")
        name = F.concat_ws("#", "record_id", F.row_number().over(same).cast("string"))
        named = leaves.select("warc_file", "seq", "length", "sha256", name.alias("key")).withColumn("place", F.xxhash64("key"))
        # Where a range of level k begins one of each lower level does.
        above = [F.coalesce(F.last(F.when(F.pmod("place", F.lit(fan_out**k)) == 0, F.col("key")), True).over(rows), F.lit("")).alias(f"up{k}") for k in range(1, own)]
        leaf = F.sha2(F.concat_ws(":", "key", "length", "sha256").cast("binary"), 256)
        level = named.select(F.col("warc_file").alias("file"), "key", leaf.alias("digest"), "seq", *above, *(F.lit("").alias(f"up{k}") for k in range(own, depth + 2)))
        self.levels = []
        for k in range(depth + 1):
            if k:
                name = F.col("key") if k <= own else F.col("seq").cast("string")  # files and their groups go by number
                children = F.transform(F.array_sort(F.collect_list(F.struct("seq", name.alias("name"), "digest"))), lambda c: F.concat(c["name"], F.lit("="), c["digest"]))
                up = [F.min(f"up{j}").alias(f"up{j}") for j in range(k + 1, depth + 2)]
                level = level.groupBy(F.col("up_file").alias("file"), F.col("up_key").alias("key")).agg(F.sha2(F.concat_ws(",", children).cast("binary"), 256).alias("digest"), F.min("seq").alias("seq"), *up)
            if k < own:
                level = level.withColumns({"up_file": F.col("file"), "up_key": F.col(f"up{k + 1}")})
            else:
                level = level.withColumns({"seq": F.col("file"), "up_file": F.floor(F.col("file") / fan_out).cast("long"), "up_key": F.lit("")})
            level = materialise(level, "level")
            self.levels.append(level)


def _depths(replicas: list[DataFrame], fan_out: int) -> tuple[int, int]:
    """Levels in all, and inside files, that both replicas' trees need for a common shape."""
    tops = [r.agg(F.max("seq"), F.max("warc_file")).first() for r in replicas]
    own, depth = 1, 1
    while fan_out**own <= max(t[0] or 0 for t in tops):
        own += 1
    while fan_out**depth <= max(t[1] or 0 for t in tops):
        depth += 1
    return own + depth, own


def _out_of_order(places: list[int]) -> list[bool]:
    """Which of distinct numbers stand outside a longest ascending run of them (gaps allowed)."""
    ends: list[int] = []
    tops, back = [], [-1] * len(places)
    for i, x in enumerate(places):
        k = bisect_left(ends, x)
        back[i] = tops[k - 1] if k else -1
        if k == len(ends):
            ends.append(x)
            tops.append(i)
        else:
            ends[k], tops[k] = x, i
    out, at = [True] * len(places), tops[-1] if tops else -1
    while at >= 0:
        out[at], at = False, back[at]
    return out


def _verdicts(leaves: DataFrame) -> DataFrame:
    """(warc_file, seq, verdict) of the leaves (file, x, y, seq_x, seq_y) of ranges that differ."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = table.select(["x", "y", "seq_x", "seq_y"]).to_pylist()
        both = sorted((r for r in rows if r["x"] is not None and r["y"] is not None), key=lambda r: r["seq_x"])
        found = [(r["seq_x"], "missing") for r in rows if r["y"] is None] + [(r["seq_y"], "extra") for r in rows if r["x"] is None]
        for r, moved in zip(both, _out_of_order([r["seq_y"] for r in both]), strict=True):
            if r["x"] != r["y"]:
                found.append((r["seq_x"], "corrupt"))
            elif moved:
                found.append((r["seq_x"], "moved"))
        return pa.table({"warc_file": pa.array([key[0].as_py()] * len(found), pa.int64()), "seq": pa.array([s for s, _ in found], pa.int64()), "verdict": pa.array([v for _, v in found], pa.string())})

    return leaves.groupBy("file").applyInArrow(run, "warc_file long, seq long, verdict string")


def audit(primary: DataFrame, replica: DataFrame, fan_out: int = FAN_OUT) -> tuple[DataFrame, list[int]]:
    """(warc_file, seq, verdict) of leaves that differ, and how many nodes differ at each level from the root.

    Both sides are as :func:`fixity` gives them.  verdict: ``corrupt`` (both have the record, not
    with the same content), ``missing`` (the replica has none), ``extra`` (only the replica has it;
    seq is the replica's) or ``moved`` (of the records that both have, the fewest that must be put
    elsewhere for their order to be the same).  A record whose identifier was damaged is missing
    and, under the damaged one, extra.  Only the leaves of ranges that differ, in files that
    differ, are looked at, a file's at a time.
    """
    depth, own = _depths([primary, replica], fan_out)
    first, second = (MerkleTree(side, depth, own, fan_out).levels for side in (primary, replica))
    frontier, counts, both = None, [], None
    for level in range(depth, -1, -1):
        sides = []
        for levels, name in ((first, "x"), (second, "y")):
            nodes = levels[level]
            if frontier is not None:
                nodes = nodes.join(frontier.select(F.col("file").alias("up_file"), F.col("key").alias("up_key")), ["up_file", "up_key"], "left_semi")
            sides.append(nodes.select("file", "key", F.col("digest").alias(name), F.col("seq").alias(f"seq_{name}")))
        above, both = both, materialise(sides[0].join(sides[1], ["file", "key"], "full_outer"), "both")
        if above is not None:
            discard(above)
        frontier = both.where(~F.col("x").eqNullSafe(F.col("y")))
        counts.append(frontier.count())
        if not counts[-1]:
            break
    verdicts = materialise(_verdicts(both if counts[-1] else both.where("false")), "verdicts")
    discard(both, *first, *second)
    return verdicts, counts


def decayed(records: DataFrame, one_in: int = 200) -> DataFrame:
    """A replica with simulated bit rot: one record in ``one_in``, chosen by a hash, has its last
    character changed; stands in where a table has no second copy to audit."""
    hit = F.pmod(_hashed(F.concat(F.lit("rot|"), F.md5(F.col("record").cast("binary")))), F.lit(one_in)) == 0
    last = F.when(F.substring("record", -1, 1) == "~", "!").otherwise("~")
    return records.withColumn("record", F.when(hit, F.concat(F.expr("left(record, length(record) - 1)"), last)).otherwise(F.col("record")))


def audited_pages(pages: DataFrame, replica_records: DataFrame | None = None, records_per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """One row for each row of ``pages`` (page_id, url, html): page_id, warc_file, record_offset,
    record_length, record_sha256, verdict (``intact``, ``corrupt``, ``missing`` or ``moved``).

    ``replica_records`` is as :func:`warc_records` gives it; without one a decayed copy is
    audited.  A record's place in the replica is that of the primary, as a replica is a copy of
    the files.  Null html is an empty body; repeated rows are records of their own; other columns
    are ignored; no rows give no rows.
    """
    records = warc_records(pages, records_per_file)
    primary = materialise(fixity(records), "primary")
    if replica_records is None:
        placed = fixity_in_place(records, primary)
    else:
        placed = materialise(fixity(replica_records), "replica")
    differing, _ = audit(primary, placed)
    joined = primary.join(differing.where("verdict <> 'extra'"), ["warc_file", "seq"], "left")
    return joined.select("page_id", "warc_file", F.col("offset").alias("record_offset"), F.col("length").alias("record_length"), F.col("sha256").alias("record_sha256"), F.coalesce("verdict", F.lit("intact")).alias("verdict"))


def fixity_in_place(records: DataFrame, primary: DataFrame) -> DataFrame:
    """The fixity of the decayed copy of ``records``: each record at its original's place."""
    pairs = records.select("page_id", "warc_file", F.sha2(F.col("record").cast("binary"), 256).alias("was"), "record")
    return materialise(_placed(decayed(pairs).select("page_id", "warc_file", "was", *_hashes()), "page_id", "was"), "replica")


# --- files ------------------------------------------------------------------------------------------
def write_warc(records: DataFrame, path: str) -> None:
    """Records as uncompressed WARC files, a folder ``warc_file=k`` with one file for each."""
    rows = records.withColumn("__sha", F.sha2(F.col("record").cast("binary"), 256)).repartition("warc_file").sortWithinPartitions("warc_file", "page_id", "__sha")
    rows.select("record", "warc_file").write.option("lineSep", END).partitionBy("warc_file").text(path)


_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)", re.IGNORECASE)
_RECORD_ID = re.compile(rb"\r\nWARC-Record-ID:[ \t]*<([^>\r\n]*)>", re.IGNORECASE)


def parse_warc(data: bytes) -> Iterator[tuple[int, int, str, str]]:
    """(offset, length, sha256, record_id) of each record, without its closing line ends.

    A record whose header can't be read ends the file: what follows is one record with the rest
    and an empty identifier.
    """
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        size = _LENGTH.search(data, at, head) if head >= 0 and data.startswith(b"WARC/", at) else None
        name = _RECORD_ID.search(data, at, head) if size else None
        end = min(len(data), head + 4 + int(size[1])) if size else len(data)
        yield at, end - at, hashlib.sha256(data[at:end]).hexdigest(), name[1].decode("utf-8", "replace") if name else ""
        at = end + 4 if size else end


def read_fixity(spark: SparkSession, path: str) -> DataFrame:
    """warc_file, seq, offset, length, sha256, record_id of the records of the files that :func:`write_warc` wrote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(parse_warc(batch.column(1)[i].as_buffer().to_pybytes()))
                if rows:
                    offset, length, sha, name = zip(*rows, strict=True)
                    arrays = [pa.array([batch.column(0)[i].as_py()] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int64()), pa.array(offset, pa.int64()), pa.array(length, pa.int64()), pa.array(sha), pa.array(name)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["warc_file", "seq", "offset", "length", "sha256", "record_id"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    number = F.regexp_extract("path", "warc_file=([0-9]+)", 1).cast("long")
    return files.select(number.alias("warc_file"), "content").mapInArrow(tidy(run), "warc_file long, seq long, offset long, length long, sha256 string, record_id string")
