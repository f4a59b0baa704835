"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.stages import shared_folder

#: What a worker's cache holds at most, in bytes.
CACHE_BYTES = 16_000_000


#: Row groups of written tables: a writer holds one in memory.
ROW_GROUP = 16 << 20
#: Files of a table that is written in few, for each core of the cluster.
FILES_A_CORE = 4


def materialise(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    This cuts the lineage: a lost executor costs its running tasks only, and no later action
    evaluates the plan of ``df`` again.  Shuffle files of the plan go as soon as it is written.
    ``few`` is for tables that are narrow beside what they were made from: tasks write several
    partitions, one after the other, to a file, so that rounds over many partitions leave no
    thousands of small files.
    """
    if few:
        df = df.coalesce(max(1, FILES_A_CORE * df.sparkSession.sparkContext.defaultParallelism))
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/docloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_REMOVE_SHUFFLES, None)
    spark.conf.set(_REMOVE_SHUFFLES, "true")
    try:
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        spark.conf.unset(_REMOVE_SHUFFLES) if before is None else spark.conf.set(_REMOVE_SHUFFLES, before)
    read = spark.read.schema(df.schema).parquet(path)
    read._written_to = path
    return read


_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def discard(*tables: DataFrame) -> None:
    """Deletes tables that :func:`materialise` wrote and that no plan will read again."""
    for table in tables:
        session = table.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving freed memory back to the system at its end: workers outlive their tasks."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return held


class BoundedWords(dict):
    """Values of words, computed once each; emptied when words and values take ``most`` bytes."""

    def __init__(self, most: int = CACHE_BYTES) -> None:
        super().__init__()
        self.most, self.held = most, 0

    def value(self, word):
        raise NotImplementedError

    def __missing__(self, word):
        found = self.value(word)
        size = sys.getsizeof(word) + sys.getsizeof(found) + 104  # an entry of a dict that may be half empty
        if self.held + size > self.most:
            self.clear()
            self.held = 0
        self.held += size
        self[word] = found
        return found


def text_or_empty(name: str = "text") -> Column:
    """The text column with null as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def byte_blocks(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``limit`` bytes in each; one row may exceed it."""
    for batch in batches:
        start, held = 0, 0
        lengths = pc.binary_length(batch.column(column)).to_pylist()
        for i, n in enumerate(lengths):
            held += n or 0
            if held >= limit:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)
