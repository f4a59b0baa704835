"""Shards along a Hilbert curve over quantised metadata, for multidimensional file pruning.

Each dimension is quantised into equally filled codes, the cell of the codes gets its index on a
Hilbert curve, rows are ordered by that index, and the order is cut into runs of equal count or
equal bytes.  Neighbours on the curve are neighbours in every dimension, so a shard covers a small
range of each and filters skip most shards.

Only DataFrame functions run here.  The global order is never sorted in one task: ranks are sums
over cells, sums over salted runs inside a cell, and a row number inside a run.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docloom.llm.common import discard, materialise, text_or_empty

BITS = 4
#: Runs that a cell's rows are dealt to, so that one full cell is many tasks.
SALTS = 256
#: Cells of the curve at most; the table of their indices is part of the plan.
MOST_CELLS = 1 << 15
#: Bytes that a row has besides its text.
ROW_BYTES = 8


def hilbert_index(point: list[int], bits: int) -> int:
    """Index of a point on the Hilbert curve of ``len(point)`` dimensions of ``bits`` bits.

    From the top bit down, each level's orthant is put in Gray-code order, and what lies below is
    seen in that orthant's reflection.
    """
    x, n = list(point), len(point)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            if x[i] >> level & 1:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
    index, parity = 0, 0
    for level in range(bits - 1, -1, -1):
        orthant, seen = 0, 0
        for i in range(n):
            seen ^= x[i] >> level & 1
            orthant = orthant << 1 | seen
        last = orthant & 1
        if parity:
            orthant ^= (1 << n) - 1
        parity ^= last
        index = index << n | orthant
    return index


def curve(dimensions: int, bits: int) -> list[int]:
    """The index of each cell; a cell's number holds the codes one after the other."""
    cells = range(1 << dimensions * bits)
    if len(cells) > MOST_CELLS:
        raise ValueError(f"{len(cells)} cells; at most {MOST_CELLS} are allowed")
    mask = (1 << bits) - 1
    return [hilbert_index([cell >> bits * (dimensions - 1 - i) & mask for i in range(dimensions)], bits) for cell in cells]


def _number(column: Column, kind: T.DataType) -> Column:
    """An order-preserving number; null stays null."""
    return F.unix_date(column).cast("double") if isinstance(kind, T.DateType) else column.cast("double")


def _ordered_cuts(docs: DataFrame, column: Column, codes: int) -> list:
    """Values that cut the rows of ``docs`` into ``codes`` runs of about equal count by whole values.

    The distinct values with their counts are dealt to ranges, counts are summed over ranges, then
    inside them; ``codes`` - 1 values come to the driver.
    """
    values = docs.select(column.alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    ranged = materialise(values.repartitionByRange("v").withColumn("range", F.spark_partition_id()), "values")
    # one row for each range
    ranges = ranged.groupBy("range").agg(F.sum("n").alias("m"))
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("below"), F.sum("m").over(Window.partitionBy(F.lit(0))).alias("all"))
    upto = F.col("below") + F.sum("n").over(Window.partitionBy("range").orderBy("v"))
    placed = ranged.join(ranges, "range").select("v", "all", upto.alias("upto"))
    cuts = placed.agg(*(F.min(F.when(F.col("upto") * codes >= F.col("all") * i, F.col("v"))).alias(f"c{i}") for i in range(1, codes))).first()
    discard(ranged)
    return list(cuts)


def hilbert_shards(docs: DataFrame, dimensions: dict[str, Column], shards: int, law: str = "rows", bits: int = BITS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, curve, rank, shard, slot of each row of ``docs`` (doc_id, text), and ``carry``.

    ``dimensions``: expressions over ``docs`` by name; strings and bytes are cut by whole values.  ``law``: ``rows`` (counts of any two shards
    differ by one at most) or ``bytes`` (a row goes where the bytes before it fall among equal
    parts of all bytes, so a shard is off by one row's size at most).  Shards are runs of the curve
    order; inside a cell rows stand by a hash, then doc_id.  slot counts a shard's rows from 0.

    size is the text's UTF-8 bytes, none for null, plus ROW_BYTES.  Null dimensions have the lowest
    code; null doc_ids are rows like others; repeated rows get a place each; no rows give no rows.
    Columns that are not carried are ignored, ``carry`` comes as one struct column ``carried``.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(law)
    names = [f"d{i}" for i in range(len(dimensions))]
    raw = docs.select(*(c.alias(n) for n, c in zip(names, dimensions.values(), strict=True)))
    kinds = [raw.schema[n].dataType for n in names]
    words = [isinstance(kind, (T.StringType, T.BinaryType)) for kind in kinds]
    compared = [c if w else _number(c, k) for c, w, k in zip(dimensions.values(), words, kinds, strict=True)]
    codes = 1 << bits
    steps = [i / codes for i in range(1, codes)]
    # codes - 1 values for each dimension come to the driver
    numeric = [F.percentile_approx(x, steps, 10_000).alias(n) for n, x, w in zip(names, compared, words, strict=True) if not w]
    found = docs.agg(*numeric).first().asDict() if numeric else {}
    cuts = [_ordered_cuts(docs, x, codes) if w else found[n] or [] for n, x, w in zip(names, compared, words, strict=True)]
    # A value that fills several codes leaves them empty behind it: few values spread over the whole range,
    # so that each dimension has its say in the curve's first turns.
    weights = [Counter(c for c in own if c is not None) for own in cuts]
    code = [sum((F.when(x > F.lit(cut), own[cut]).otherwise(0) for cut in sorted(own)), F.lit(0)) for x, own in zip(compared, weights, strict=True)]
    cell = F.lit(0)
    for c in code:
        cell = cell * codes + c
    table = F.lit(curve(len(names), bits)) if names else F.array(F.lit(0))

    text = F.col("text").cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
        F.get(table, cell).cast("int").alias("curve"),
        *([F.struct(*carry).alias("carried")] if carry else []),
    )
    rows = materialise(rows.withColumn("run", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(SALTS)).cast("int")), "curve")

    counts = rows.groupBy("curve", "run").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    # as many rows as cells, MOST_CELLS at most
    cells = counts.groupBy("curve").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    everything, before = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    cells = cells.select("curve", F.coalesce(F.sum("n").over(before), zero).alias("cell_n"), F.coalesce(F.sum("b").over(before), zero).alias("cell_b"), F.sum("n").over(everything).alias("all_n"), F.sum("b").over(everything).alias("all_b"))
    inside = Window.partitionBy("curve").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.select("curve", "run", F.coalesce(F.sum("n").over(inside), zero).alias("run_n"), F.coalesce(F.sum("b").over(inside), zero).alias("run_b"))
    runs = runs.join(cells, "curve").select("curve", "run", (F.col("cell_n") + F.col("run_n")).alias("first_n"), (F.col("cell_b") + F.col("run_b")).alias("first_b"), "all_n", "all_b")

    own = Window.partitionBy("curve", "run").orderBy("doc_id", "size", "text_crc32")
    placed = rows.withColumn("at", F.row_number().over(own)).withColumn("below", F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)), zero))
    placed = placed.join(runs, ["curve", "run"]).withColumn("rank", F.col("first_n") + F.col("at") - 1)
    columns = ["doc_id", "size", "text_crc32", "curve", "rank", "shard", "slot", *(["carried"] if carry else [])]
    if law == "rows":
        cut = placed.withColumn("shard", F.expr(f"cast(rank * {shards} div all_n as int)"))
        return cut.withColumn("slot", F.expr(f"rank - (shard * all_n + {shards - 1}) div {shards}")).select(*columns)
    part = F.floor((F.col("first_b") + F.col("below")).cast("decimal(38,0)") * shards / F.col("all_b")).cast("int")
    cut = materialise(placed.withColumn("shard", F.least(part, F.lit(shards - 1))), "cut")
    starts = cut.groupBy("shard").agg(F.min("rank").alias("start"))  # one row for each shard
    return cut.join(F.broadcast(starts), "shard").withColumn("slot", F.col("rank") - F.col("start")).select(*columns)


def shard_ranges(placed: DataFrame, columns: list[str]) -> DataFrame:
    """The least and largest value of each carried column in each shard, which a reader prunes by."""
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), *(f(f"carried.{c}").alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))))


def write_shards(docs: DataFrame, path: str, dimensions: dict[str, Column], shards: int, law: str = "rows") -> None:
    """All columns of ``docs`` as Parquet under ``path``, a folder ``shard=k`` for each shard, in slot order."""
    placed = hilbert_shards(docs, dimensions, shards, law, carry=tuple(docs.columns))
    out = placed.select(F.col("shard").alias("__shard"), F.col("slot").alias("__slot"), "carried.*")
    rows = out.repartition(shards, "__shard").sortWithinPartitions("__shard", "__slot").drop("__slot")
    rows.withColumnRenamed("__shard", "shard").write.partitionBy("shard").parquet(path)
