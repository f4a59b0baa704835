"""Best-fit packing of token sequences with hierarchical merging of residual bins.

Partitions pack their own pieces, longest first, each into the fullest bin that still takes it.
Nearly full bins are done.  Underfull ones go up a tree, a fixed number of nodes to each parent, and
are items for another best-fit round there: whole bins are put into the room of others.

How many bins are underfull is no choice.  A bin was opened because no other had room for its first
item, so two bins of a node never fit together, and a node has one bin of at most half the size.
Such bins alone can move.  In a round of a parent, each of its children's one bin of that kind needs
one bin that takes it in, FAN_IN at most, and whatever fits a fuller bin fits an emptier one.  So
with no more than LEVELS rounds to come, the FAN_IN * LEVELS emptiest bins and one more are all that
these rounds can touch: to hand on every bin would save no further sequence.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import byte_blocks, materialise, text_or_empty, tidy

SEQUENCE = 2_048
#: Pieces that are packed at once, so that a task's memory is bounded.
BLOCK = 200_000
#: Nodes that one parent takes bins from, and rounds that a tree has at most (16 ** 10 first nodes).
FAN_IN, LEVELS = 16, 10
END = 0


class ByteBpe:
    """Token ids of a byte-level BPE vocabulary, as its file gives them.

    The file is read for its table and its one special token; the pattern that splits text before
    merges is given.  A special token's string in a text is that token.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import json

        import tiktoken

        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        special = {t["content"]: t["id"] for t in held["added_tokens"]}
        ranks = {bytes(map(_BYTE_OF.__getitem__, piece)): i for piece, i in held["model"]["vocab"].items() if piece not in special}
        self._encoding = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return self._encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


def _bytes_of_letters() -> dict[str, int]:
    """Byte-level files write a byte as its Latin-1 character, those that don't print from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


_BYTE_OF = _bytes_of_letters()


@lru_cache(maxsize=1)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """The vocabulary, read once by a worker."""
    return ByteBpe(path, pattern)


def token_pieces(docs: DataFrame, vocabulary: str, pattern: str, size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of the token pieces of ``docs`` (doc_id, text).

    A document is its text's ids and the end id 0; null text counts as empty.  Longer ones than
    ``size`` are cut: the first piece takes what is over, all others have ``size`` tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary, pattern)
        end = np.array([END], "<u4").tobytes()
        for batch in byte_blocks(batches, 1, 4_000_000):
            rows: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = bpe.encode(text.as_py()) + end
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % size + 1, n + 1, size)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = ids[4 * a : 4 * b]
                    for column, value in zip(rows, (doc, k, a, b - a, zlib.crc32(part)), strict=False):
                        column.append(value)
                    if with_ids:
                        rows[5].append(part)
            arrays = [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:5])]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(r, "<u4").astype(np.int32) for r in rows[5]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return read.mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and the fill of each bin: longest first, into the fullest bin that takes it."""
    place, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fills: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r: there is a bin with room r
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            k, room = len(fills), size
            fills.append(0)
        place[i], offset[i] = k, fills[k]
        fills[k] += n
        if room > n:
            if not by_room[room - n]:
                rooms |= 1 << (room - n)
            by_room[room - n].append(k)
    return place, offset, np.array(fills, np.int64)


# A bin's number: the level of the tree, the node there (in the first round task and block) and the
# bin in the node; a node has fewer than 2 ** 18 bins.
_LEVEL, _NODE = 58, 18
_BINS = "item long, length long, bin long, offset long, fill long, open boolean"


def _first_round(items: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, blocks = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            nonlocal blocks
            table = pa.Table.from_batches(held)
            held.clear()
            lengths = table.column("length").to_numpy()
            place, offset, fills = best_fit(lengths, size)
            blocks += 1
            return _marked(table.column("item").to_numpy(), lengths, place, offset, fills, ((task << 16) + blocks << _NODE), size)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                yield packed()
        if held:
            yield packed()

    return items.mapInArrow(tidy(run), _BINS)


def _marked(item: np.ndarray, length: np.ndarray, place: np.ndarray, offset: np.ndarray, fills: np.ndarray, base: int, size: int) -> pa.RecordBatch:
    """Rows with their bins; open are the emptiest bins that further rounds can touch."""
    open_bin = np.zeros(len(fills), bool)
    open_bin[np.argsort(fills, kind="stable")[: FAN_IN * LEVELS + 1]] = True
    open_bin &= fills < size
    arrays = [pa.array(item), pa.array(length), pa.array(base + place), pa.array(offset), pa.array(fills[place]), pa.array(open_bin[place])]
    return pa.RecordBatch.from_arrays(arrays, names=["item", "length", "bin", "offset", "fill", "open"])


def _merge_round(rows: DataFrame, level: int, size: int) -> DataFrame:
    """Bins of ``rows`` as items for a best-fit round in each ``node``."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, first, member = np.unique(table.column("bin").to_numpy(), return_index=True, return_inverse=True)
        place, shift, fills = best_fit(table.column("fill").to_numpy()[first], size)
        base = (level << _LEVEL) + (key[0].as_py() << _NODE)
        return pa.Table.from_batches([_marked(table.column("item").to_numpy(), table.column("length").to_numpy(), place[member], table.column("offset").to_numpy() + shift[member], fills, base, size)])

    return rows.groupBy("node").applyInArrow(run, _BINS)


def pack(items: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """(item, sequence_id, offset) of ``items`` (item long, length from 1 to ``size``).

    Every item is in one sequence, sequences hold at most ``size``, offsets have no gaps.  Items
    longer than ``size`` or without a positive length raise an error.
    """
    wrong = F.raise_error(F.concat(F.lit("length out of range: "), F.coalesce(F.col("length").cast("string"), F.lit("null"))))
    checked = items.select("item", F.when(F.col("length").between(1, size), F.col("length")).otherwise(wrong).cast("long").alias("length"))
    state = materialise(_first_round(checked, size), "bins")
    done, level = state.where("not open"), 1
    node = F.shiftright(F.col("bin").bitwiseAND(F.lit((1 << _LEVEL) - 1)), _NODE)
    while nodes := state.where("open").select(node.alias("node")).distinct().count():
        parents = math.ceil(nodes / FAN_IN)
        left = state.where("open").withColumn("node", F.pmod(F.xxhash64(node), F.lit(parents)))
        state = materialise(_merge_round(left, level, size), "bins")
        if parents == 1:
            done = done.unionByName(state)
            break
        done, level = done.unionByName(state.where("not open")), level + 1
    return done.select("item", F.col("bin").alias("sequence_id"), "offset")


def packed_documents(docs: DataFrame, vocabulary: str, pattern: str, size: int = SEQUENCE, **options: Any) -> DataFrame:
    """One row for each piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.

    Null text counts as empty: such a document is the end id alone.  Documents of ``size`` tokens
    or fewer are one piece.  Rows that repeat a document are packed each; a null doc_id is kept.
    Other columns are ignored; no rows give no rows.
    """
    pieces = token_pieces(docs, vocabulary, pattern, size, **options)
    numbered = materialise(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    return numbered.join(pack(numbered.select("item", "length"), size), "item").drop("item")
