"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import discard, materialise, tidy

#: Edges that a task contracts together.
BLOCK = 200_000


def _stars(edges: DataFrame) -> DataFrame:
    """Stars that connect what ``edges`` do in each block of a task: each node and the least it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}
        held = 0

        def find(x: int) -> int:
            top = x
            while (up := root.setdefault(top, top)) != top:
                top = up
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        def done() -> pa.RecordBatch:
            pairs = [(x, top) for x in list(root) if (top := find(x)) != x]
            root.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([t for _, t in pairs], pa.int64())], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(a), find(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
            held += batch.num_rows
            if held >= BLOCK:
                held = 0
                yield done()
        if root:
            yield done()

    return edges.mapInArrow(tidy(run), "a long, b long")


def _contract(edges: DataFrame, both: bool) -> DataFrame:
    """Each node's neighbours point to the least of them and the node.

    ``both``: over all neighbours, larger ones only are moved (large star); else over the smaller
    ones, the node itself too (small star).
    """
    pairs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else edges
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = pairs.join(least, "a")
    if both:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
    return moved.where("a <> b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, which has none itself."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of every node of ``edges`` (a long, b long): its component's least node.

    Every task contracts what it holds; then every round is two shuffles and a written table.  The
    number of rounds grows with the logarithm of the longest path that is left.  No edges, no rows.
    Null ends and loops are dropped.
    """
    edges = materialise(_stars(edges.select("a", "b").where("a <> b")).distinct(), name, few=True)
    while not _are_stars(edges):
        further = materialise(_contract(_contract(edges, True), False), name, few=True)
        discard(edges)
        edges = further
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
