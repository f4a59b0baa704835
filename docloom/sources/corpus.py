"""A corpus folder as a Spark data source, and change detection by signatures.

The listing takes every regular file, hidden and empty ones too.  Files are read and parsed on the
executors, a bounded number and size to each partition, in a child process that is replaced when a
file crashes it or takes too long; such a file costs itself only and becomes a row with a reason.
A child serves a whole partition and loads the parsers alone, as starting one costs more than most
files do.  The folder must be one that all executors see.
"""

from __future__ import annotations

import base64
import json
import math
import os
import select
import subprocess
import sys
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docloom.sources import parsers

UNITS = "array<struct<text:string,loc:string,is_row:boolean>>"
SCHEMA = f"rel string, file_ord long, size long, mtime_ns long, kind string, skip string, units {UNITS}"
PAGES = "rel string, page int, name string, content binary, error string"
#: A partition ends at either; a larger file is one of its own.
FILES_PER_PARTITION, BYTES_PER_PARTITION = 1_024, 16 << 20
#: Where no file is opened.
LISTED_PER_PARTITION = 65_536
SECONDS_PER_FILE = 60


def listing(root: str) -> list[tuple[str, int, int]]:
    """(path, size, time of change) of every file, a folder's files before its folders; -1 where unknown."""
    found = []
    for folder, folders, names in os.walk(root, onerror=lambda _: None):
        folders.sort()
        for name in sorted(names):
            path = os.path.join(folder, name)
            rel = os.path.relpath(path, root).replace(os.sep, "/")
            try:
                status = os.stat(path)
            except OSError:
                found.append((rel, -1, -1))
            else:
                found.append((rel, status.st_size, status.st_mtime_ns))
    return found


class ParseProcess:
    """A child that parses or renders files, one line of JSON each way."""

    def __init__(self, root: str, seconds: float = SECONDS_PER_FILE) -> None:
        self.root, self.seconds, self.child = root, seconds, None

    def parse(self, rel: str) -> dict:
        return self._ask("parse", rel)

    def render(self, rel: str) -> dict:
        return self._ask("render", rel)

    def _ask(self, task: str, rel: str) -> dict:
        if self.child is None or self.child.poll() is not None:
            here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
            env = os.environ | {"PYTHONPATH": os.pathsep.join([here, os.environ.get("PYTHONPATH", "")])}
            self.child = subprocess.Popen([sys.executable, "-m", "docloom.sources.parse_child", self.root], stdin=subprocess.PIPE, stdout=subprocess.PIPE, env=env)
        try:
            self.child.stdin.write((json.dumps([task, rel]) + "\n").encode())
            self.child.stdin.flush()
            ready, _, _ = select.select([self.child.stdout], [], [], self.seconds)
            line = self.child.stdout.readline() if ready else b""
            if line.endswith(b"\n"):
                return json.loads(line)
            failure = "no reply" if ready else f"timeout after {self.seconds:g} s"
        except OSError as error:
            failure = str(error)
        self.close()
        return {"skip": f"parser failure: {failure}"}

    def close(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.wait()
            self.child.stdin.close()
            self.child.stdout.close()
            self.child = None


Listed = tuple[int, str, int, int]


class _Files(InputPartition):
    def __init__(self, files: list[Listed]) -> None:
        self.files = files


def dealt(files: Iterable[Listed], most: int, most_bytes: float) -> Iterator[list[Listed]]:
    """``files`` (number, path, size, time of change) in their order, in runs of at most so many files and bytes."""
    run, held = [], 0
    for file in files:
        if run and (len(run) >= most or held + file[2] > most_bytes):
            yield run
            run, held = [], 0
        run.append(file)
        held += max(0, file[2])
    if run:
        yield run


class CorpusReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.parse = options.get("parse", "true").lower() == "true"
        self.per = int(options.get("filesPerPartition", FILES_PER_PARTITION))
        self.bytes = int(options.get("bytesPerPartition", BYTES_PER_PARTITION))
        self.seconds = float(options.get("secondsPerFile", SECONDS_PER_FILE))

    def partitions(self) -> list[InputPartition]:
        files = ((i, *f) for i, f in enumerate(listing(self.root)))
        runs = dealt(files, self.per, self.bytes) if self.parse else dealt(files, LISTED_PER_PARTITION, math.inf)
        return [_Files(run) for run in runs] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        child = ParseProcess(self.root, self.seconds)
        try:
            for number, rel, size, changed in partition.files:
                found = {} if not self.parse else {"skip": "cannot stat"} if size < 0 else child.parse(rel)
                units = [tuple(u) for u in found.get("units", [])]
                yield rel, number, size, changed, found.get("kind"), found.get("skip"), units
        finally:
            child.close()


class CorpusSource(DataSource):
    """``spark.read.format("docloom_corpus").load(folder)``: one row for each file.

    Options: ``parse`` (false lists only), ``filesPerPartition``, ``bytesPerPartition``,
    ``secondsPerFile``.
    """

    @classmethod
    def name(cls) -> str:
        return "docloom_corpus"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> CorpusReader:
        return CorpusReader(dict(self.options))


def read_corpus(spark: SparkSession, root: str, **options: object) -> DataFrame:
    """Parse results (rel, file_ord, size, mtime_ns, kind, skip, units) of a folder."""
    spark.dataSource.register(CorpusSource)
    return spark.read.format("docloom_corpus").options(**options).load(root)


def rendered_pages(parsed: DataFrame, root: str) -> DataFrame:
    """Pages (rel, page, name, content, error) of the images and scanned PDF files among parse results.

    ``name`` is one of its kind in the corpus: the path of an image, a PDF file's path and page.
    A file that can't be rendered has one row, without content and with the reason.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        child = ParseProcess(root)
        try:
            for frame in frames:
                for rel in frame["rel"]:
                    found = child.render(rel)
                    scanned = parsers.kind_of(rel) == "pdf"
                    rows = [(rel, n, f"{rel}#page={n}" if scanned else rel, base64.b64decode(png), None) for n, png in found.get("pages", [])]
                    yield pd.DataFrame(rows or [(rel, None, None, None, found.get("skip", "no pages"))], columns=["rel", "page", "name", "content", "error"]).astype({"page": "Int32"})
        finally:
            child.close()

    return parsed.where(F.col("kind").isin("image", "pdf_scanned") & F.col("skip").isNull()).select("rel").mapInPandas(run, PAGES)


def signature(spark: SparkSession, root: str) -> DataFrame:
    """(rel, size, mtime_ns) of every file."""
    return read_corpus(spark, root, parse="false").select("rel", "size", "mtime_ns")


def same_signature(left: DataFrame, right: DataFrame) -> bool:
    """Whether both hold the same rows equally often; each is read once."""
    both = left.withColumn("__n", F.lit(1)).unionByName(right.withColumn("__n", F.lit(-1)))
    return both.groupBy(*left.columns).agg(F.sum("__n").alias("__n")).where("__n <> 0").isEmpty()
