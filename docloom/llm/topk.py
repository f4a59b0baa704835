"""Exact top-k inner products by distributed histogram selection.

Vectors are blocks of integers.  Every block of queries meets every block of candidates of its
dimension; scores are never stored.  A pass counts, for each query, how many scores fall into each
bin of a range; summed over all blocks, the counts say in which bin the k-th highest score lies,
and the next pass splits that bin.  When bins are one wide, the k-th score is known, and a last pass
returns what lies above it and, of those equal to it, the smallest ids.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import materialise, tidy

QUERY_BLOCK = 256
CANDIDATE_BLOCK = 4_096
#: Candidate blocks that queries are sent to together, once there are this many times PARTS of them.
TOGETHER, PARTS = 16, 64
BINS = 1_024
SCALE = 256.0
#: Integers up to here are exact in double arithmetic.
EXACT = 2.0**53

_BLOCKS = "block long, dim int, n int, norm double, ids binary, kind string, data binary"


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Vectors (vec_id, embedding) that take part, as blocks of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

        def packed(dim: int) -> pa.RecordBatch:
            ids, rows = held.pop(dim)
            data = np.stack(rows)
            most = float(np.abs(data).max(initial=0.0))
            kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
            norm = float(np.sqrt((data * data).sum(1)).max(initial=0.0))
            return pa.RecordBatch.from_pylist([{"block": 0, "dim": dim, "n": len(ids), "norm": norm, "ids": np.array(ids, "<i8").tobytes(), "kind": kind, "data": data.astype(kind).tobytes()}], schema=pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("norm", pa.float64()), ("ids", pa.binary()), ("kind", pa.string()), ("data", pa.binary())]))

        for batch in batches:
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if vec_id is None or not vector.is_valid or vector.values.null_count:
                    continue
                with np.errstate(all="ignore"):
                    scaled = np.floor(SCALE * vector.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if not np.isfinite(scaled).all():
                    continue
                ids, rows = held.setdefault(len(scaled), ([], []))
                ids.append(vec_id)
                rows.append(scaled)
                if len(ids) >= size:
                    yield packed(len(scaled))
        for dim in list(held):
            yield packed(dim)

    read = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return read.mapInArrow(tidy(run), _BLOCKS).withColumn("block", F.monotonically_increasing_id())


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products as integers; by double arithmetic where that is exact."""
    reach = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if reach < EXACT:
        return (q @ c.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in q], object).dot(np.array([[int(x) for x in row] for row in c], object).T)
    return np.clip(exact, 1 - 2**62, 2**62 - 1).astype(np.int64)


def _scored(pairs: DataFrame, schema: str, use: Callable[..., list[np.ndarray]]) -> DataFrame:
    """Runs ``use(scores, query ids, candidate ids, low, need)`` on each pair of blocks.

    Scores of a query with itself are the least number.  ``use`` returns columns, the first of
    which is the query's place in its block.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name, batch=batch, row=row: batch.column(name)[row]
                low, need = (get(x).values.to_numpy(zero_copy_only=False) for x in ("low", "need"))
                if get("q_norm").as_py() * get("c_norm").as_py() * (1 + 1e-9) + 1 < low.min():
                    continue  # no score of these blocks is as high as any k-th
                shape = (-1, get("dim").as_py())
                q, c = (np.frombuffer(get(f"{x}_data").as_buffer(), get(f"{x}_kind").as_py()).astype(np.float64).reshape(get(f"{x}_n").as_py(), shape[1]) for x in "qc")
                qid, cid = (np.frombuffer(get(f"{x}_ids").as_buffer(), "<i8") for x in "qc")
                scores = _scores(q, c)
                scores[qid[:, None] == cid[None, :]] = np.iinfo(np.int64).min
                columns = use(scores, qid, cid, low, need)
                if len(columns[0]):
                    arrays = [pa.array(np.full(len(columns[0]), get("q_block").as_py(), np.int64)), *(pa.array(x) for x in columns)]
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    return pairs.mapInArrow(tidy(run), schema)


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` highest scores of each row of ``queries`` over all rows of ``vectors`` but those of its vec_id.

    Both have (vec_id, embedding).  Components are floor(256 * x); the score is their inner
    product, ties go to the smaller vec_id.  Returns query_id, rank (from 1), vec_id, score; fewer
    rows where there are fewer candidates.  Rows whose vec_id or vector is null, or whose vector
    holds a null or a non-finite number (also after scaling), take no part; vectors of different
    lengths are not compared; empty vectors score 0.  Repeated rows are candidates, and queries, of
    their own.  Scores beyond 62 bits are the nearest
    number of 62 bits.  Other columns are ignored.
    """
    asked = materialise(_blocks(queries, QUERY_BLOCK), "queries")
    held = materialise(_blocks(vectors, CANDIDATE_BLOCK), "vectors")
    reach = [b.agg(F.max("norm"), F.count(F.lit(1))).first() for b in (asked, held)]
    if not reach[0][1] or not reach[1][1]:
        return asked.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    most = min(math.ceil(reach[0][0] * reach[1][0] * (1 + 1e-9)) + 1, 2**62)  # no score is beyond
    shift = max(0, (2 * most + 1).bit_length() - (BINS.bit_length() - 1))

    # Every block of queries is sent to every part, which is one candidate block or several.
    spread = min(reach[1][1], max(PARTS, math.ceil(reach[1][1] / TOGETHER)))
    parts = held.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(spread)))
    candidates = parts.select("dim", "part", F.col("n").alias("c_n"), F.col("norm").alias("c_norm"), F.col("ids").alias("c_ids"), F.col("kind").alias("c_kind"), F.col("data").alias("c_data"))
    places = parts.select("dim", "part").distinct()
    states = asked.select(F.col("block").alias("q_block"), F.transform(F.sequence(F.lit(1), "n"), lambda _: F.lit(-most).cast("long")).alias("low"), F.transform(F.sequence(F.lit(1), "n"), lambda _: F.lit(k).cast("int")).alias("need"))

    def pairs() -> DataFrame:
        sides = asked.withColumnRenamed("block", "q_block").join(states, "q_block").select("q_block", "dim", F.col("n").alias("q_n"), F.col("norm").alias("q_norm"), F.col("ids").alias("q_ids"), F.col("kind").alias("q_kind"), F.col("data").alias("q_data"), "low", "need")
        return sides.join(places, "dim").join(candidates, ["dim", "part"])

    def histogram(shift: int, bins_used: int) -> Callable[..., list[np.ndarray]]:
        def use(scores: np.ndarray, qid: np.ndarray, cid: np.ndarray, low: np.ndarray, need: np.ndarray) -> list[np.ndarray]:
            # np.int64 differences do not overflow: lows and real scores lie within 2 ** 62
            own = scores == np.iinfo(np.int64).min
            scores[own] = 0
            bins = (scores - low[:, None]) >> shift
            inside = (bins >= 0) & (bins < bins_used) & ~own
            row = np.broadcast_to(np.arange(len(qid))[:, None], bins.shape)
            counts = np.bincount(row[inside] * BINS + bins[inside], minlength=len(qid) * BINS).reshape(-1, BINS)
            # Bins below the one where this block alone reaches the rank can't hold it.
            above = np.cumsum(counts[:, ::-1], 1)[:, ::-1] - counts
            at, bin_ = np.nonzero((counts > 0) & (above < need[:, None]))
            return [at.astype(np.int32), bin_.astype(np.int32), counts[at, bin_].astype(np.int64)]

        return use

    bins_used = BINS
    while True:
        found = _scored(pairs(), "q_block long, at int, bin int, n long", histogram(shift, bins_used))
        summed = found.groupBy("q_block", "at", "bin").agg(F.sum("n").alias("n"))
        below = states.select("q_block", F.posexplode(F.arrays_zip("low", "need")).alias("at", "s")).select("q_block", "at", "s.low", "s.need")
        downwards = Window.partitionBy("q_block", "at").orderBy(F.desc("bin"))
        reached = summed.withColumn("upto", F.sum("n").over(downwards)).join(below, ["q_block", "at"]).where("upto >= need and upto - n < need")
        next_low = reached.select("q_block", "at", (F.col("low") + F.shiftleft(F.col("bin").cast("long"), shift)).alias("new_low"), (F.col("need") - (F.col("upto") - F.col("n"))).cast("int").alias("new_need"))
        # A query with fewer candidates than k has no such bin: it takes all that there are.
        moved = below.join(next_low, ["q_block", "at"], "left").select("q_block", "at", F.coalesce("new_low", F.lit(-(2**62)).cast("long")).alias("low"), F.coalesce("new_need", "need").alias("need"))
        states = materialise(moved.groupBy("q_block").agg(F.sort_array(F.collect_list(F.struct("at", "low", "need"))).alias("s")).select("q_block", F.col("s.low").alias("low"), F.col("s.need").alias("need")), "bounds")
        if shift == 0:
            break
        finer = max(0, shift - (BINS.bit_length() - 1))
        bins_used, shift = 1 << (shift - finer), finer  # the bin that was found, and no more

    def select(scores: np.ndarray, qid: np.ndarray, cid: np.ndarray, low: np.ndarray, need: np.ndarray) -> list[np.ndarray]:
        own = scores == np.iinfo(np.int64).min
        above = (scores > low[:, None]) & ~own
        at, c = np.nonzero(above)
        out = [(at, c)]
        order = np.argsort(cid, kind="stable")
        equal = (scores == low[:, None]) & ~own
        for i in np.flatnonzero(equal.any(1)):
            ties = order[equal[i, order]][: need[i]]
            out.append((np.full(len(ties), i), ties))
        at, c = (np.concatenate(x) for x in zip(*out, strict=True))
        return [at.astype(np.int32), qid[at], cid[c], scores[at, c]]

    chosen = _scored(pairs(), "q_block long, at int, query_id long, vec_id long, score long", select)
    order = Window.partitionBy("q_block", "at").orderBy(F.desc("score"), "vec_id")
    return chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
