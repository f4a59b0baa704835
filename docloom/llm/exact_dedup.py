"""Exact deduplication by content-defined chunk recipes.

A text is cut at positions that its content chooses (a rolling hash over a window of bytes), each
distinct chunk is moved once from every task and checked byte by byte against the chunks of the
same digest, and documents are then compared as ordered lists of chunk identifiers.  Whole long
texts are never moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import byte_blocks, discard, materialise, text_or_empty, tidy

#: The characters that do not count: the class [\x20\x09-\x0D].
BLANKS = b" \t\n\x0b\x0c\r"

MIN_CHUNK = 2_048
MASK_BITS = 12
MAX_CHUNK = 65_536
DIGEST_BYTES = 16
#: Bytes of chunks that a task remembers in order not to send them twice.
SEEN_BYTES = 16_000_000

_GEAR = np.random.default_rng(20_240_601).integers(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)


def cut_points(data: bytes, least: int = MIN_CHUNK, bits: int = MASK_BITS, most: int = MAX_CHUNK) -> list[int]:
    """Ends of the chunks of ``data``; they depend on the content near them only.

    A chunk has ``least`` bytes at least (but the last) and ``most`` at most; the empty text has
    no chunk.
    """
    n = len(data)
    if n <= 2 * least:
        return [n] if n else []
    rolled = _GEAR[np.frombuffer(data, np.uint8)]
    factor, width = np.uint32(0x9E3779B1), 1
    with np.errstate(over="ignore"):
        while width < 32:  # a polynomial over the last 32 bytes, by doubling
            shifted = np.zeros_like(rolled)
            shifted[width:] = rolled[:-width] * factor
            rolled = rolled + shifted
            factor, width = factor * factor, 2 * width
    marks = np.flatnonzero((rolled >> np.uint32(32 - bits)) == 0) + 1
    ends, start, k = [], 0, 0
    while n - start > least:
        k = k + int(np.searchsorted(marks[k:], start + least))
        end = min(int(marks[k]) if k < len(marks) else n, start + most, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def _chunks(text: bytes, least: int, bits: int, most: int) -> tuple[bytes, list[bytes]]:
    plain = text.translate(None, BLANKS)
    ends = cut_points(plain, least, bits, most)
    return plain, [plain[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _recipes(docs: DataFrame, cut: tuple[int, int, int], size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_blocks(batches, 2, 8_000_000):
            recipes, digests = [], []
            for text in batch.column(2):
                plain, chunks = _chunks(text.as_buffer().to_pybytes(), *cut)
                recipes.append(b"".join(hashlib.blake2b(c, digest_size=size).digest() for c in chunks))
                digests.append(hashlib.sha256(plain).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(recipes, pa.binary()), pa.array(digests, pa.string())], names=["doc_id", "n_chars", "recipe", "text_sha256"])

    return docs.mapInArrow(tidy(run), "doc_id long, n_chars long, recipe binary, text_sha256 string")


def _distinct_chunks(docs: DataFrame, cut: tuple[int, int, int], size: int) -> DataFrame:
    """(digest, chunk) of every chunk, each once from a task as far as the task can remember."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, bytes] = {}
        held = 0
        for batch in byte_blocks(batches, 2, 8_000_000):
            digests, chunks = [], []
            for text in batch.column(2):
                for chunk in _chunks(text.as_buffer().to_pybytes(), *cut)[1]:
                    digest = hashlib.blake2b(chunk, digest_size=size).digest()
                    if seen.get(digest) == chunk:
                        continue
                    if held > SEEN_BYTES:
                        seen.clear()
                        held = 0
                    seen[digest] = chunk
                    held += len(chunk)
                    digests.append(digest)
                    chunks.append(chunk)
            if digests:
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(chunks, pa.binary())], names=["digest", "chunk"])

    return docs.mapInArrow(tidy(run), "digest binary, chunk binary").distinct()


def _positions(docs: DataFrame, cut: tuple[int, int, int], size: int) -> DataFrame:
    """One row for each chunk of each document; used where digests collide, never else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_blocks(batches, 2, 8_000_000):
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                plain, chunks = _chunks(text.as_buffer().to_pybytes(), *cut)
                sha = hashlib.sha256(plain).hexdigest()
                rows += [(doc, sha, seq, hashlib.blake2b(chunk, digest_size=size).digest(), chunk) for seq, chunk in enumerate(chunks)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "text_sha256", "seq", "digest", "chunk"])

    return docs.mapInArrow(tidy(run), "doc_id long, text_sha256 string, seq long, digest binary, chunk binary")


def _told_apart(docs: DataFrame, recipes: DataFrame, chunks: DataFrame, collided: DataFrame, cut: tuple[int, int, int], size: int) -> DataFrame:
    """Recipes that hold a colliding digest get, appended, which of its chunks stands where."""
    variants = chunks.join(collided, "digest").withColumn("variant", F.row_number().over(Window.partitionBy("digest").orderBy("chunk")))
    used = _positions(docs, cut, size).distinct().join(variants, ["digest", "chunk"])
    lists = used.groupBy("doc_id", "text_sha256").agg(F.to_json(F.sort_array(F.collect_list(F.struct("seq", "variant")))).alias("variants"))
    joined = recipes.alias("r").join(lists.alias("l"), F.col("r.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("r.text_sha256") == F.col("l.text_sha256")), "left")
    extra = F.coalesce(F.col("l.variants"), F.lit("")).cast("binary")
    return joined.select("r.doc_id", "r.n_chars", F.concat(F.col("r.recipe"), extra).alias("recipe"), "r.text_sha256")


def exact_duplicates(docs: DataFrame, cut: tuple[int, int, int] = (MIN_CHUNK, MASK_BITS, MAX_CHUNK), digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without the characters of ``[\\x20\\x09-\\x0D]``; of
    equal texts the row with the most code points in the original text, then the smallest doc_id,
    stays.  Null text counts as empty, and empty texts are equal.  A null doc_id loses against any
    other.  Of rows that repeat doc_id and text one is marked kept.  Other columns are ignored.
    An empty table gives an empty result.

    ``cut`` is the least chunk, the bits of the cut mask and the largest chunk; ``digest_bytes``
    the length of chunk digests.  Digests are identifiers only once their chunks were compared.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text_or_empty()).cast("long").alias("n_chars"), text_or_empty().cast("binary").alias("text"))
    recipes = materialise(_recipes(read, cut, digest_bytes), "recipes")
    collided = materialise(_distinct_chunks(read, cut, digest_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "collided", few=True)
    if not collided.isEmpty():
        recipes = materialise(_told_apart(read, recipes, _distinct_chunks(read, cut, digest_bytes), collided, cut, digest_bytes), "told-apart")
    discard(collided)
    order = F.struct((-F.col("n_chars")).alias("longest"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"))
    # Written, so that the join below reads two shuffles and a large group's side can be split.
    groups = materialise(recipes.groupBy("recipe").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size")), "groups", few=True)
    copies = Window.partitionBy("recipe", "doc_id", "n_chars").orderBy("text_sha256")
    return (
        recipes.withColumn("copy", F.row_number().over(copies))
        .join(groups, "recipe")
        .select(
            "doc_id",
            F.col("best.doc_id").alias("keep_id"),
            F.col("group_size").cast("long").alias("group_size"),
            (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("n_chars") == -F.col("best.longest")) & (F.col("copy") == 1)).alias("kept"),
            "text_sha256",
        )
    )


def kept_rows(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, with all their columns.

    Rows are matched by doc_id and the digest of the text; of repeated rows one stays.
    """
    key = lambda doc, sha: F.concat_ws(":", F.coalesce(doc.cast("string"), F.lit("null")), sha)
    kept = verdicts.where("kept").select(key(F.col("doc_id"), F.col("text_sha256")).alias("__key"))
    plain = F.regexp_replace(text_or_empty(), r"[\x20\x09-\x0D]", "")
    row = docs.select(F.struct("*").alias("row"), key(F.col("doc_id").cast("long"), F.sha2(plain.cast("binary"), 256)).alias("__key"), F.length(text_or_empty()).alias("__n"))
    # The join and the choice among repeated rows go by one key: texts are moved once.
    first = Window.partitionBy("__key").orderBy(F.desc("__n"))
    return row.join(kept, "__key", "left_semi").withColumn("__rank", F.row_number().over(first)).where("__rank = 1").select("row.*")
