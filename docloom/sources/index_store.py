"""Index tables on disk, valid as long as the corpus has its signature."""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.models import Embedder, Transcriber
from docloom.operators import corpus, transcribe
from docloom.operators.index import Index, build_index
from docloom.sources.corpus import PAGES, read_corpus, rendered_pages, same_signature, signature


def save_index(files: DataFrame, path: str) -> Index:
    """The index of file records, every table written to ``path`` and made from those written before.

    Term tables are sorted so that a query's terms skip most row groups.
    """
    spark = files.sparkSession

    def keep(table: DataFrame, name: str) -> DataFrame:
        if name in ("tf", "terms"):
            table = table.repartitionByRange("term").sortWithinPartitions("term")
        table.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    return build_index(files, keep=keep)


def load_index(spark: SparkSession, path: str) -> Index:
    made = _made(spark, path)

    def read(name: str) -> DataFrame | None:
        try:
            if name == "vectors" and made and not made[1]:  # an older build's may lie there
                return None
            return spark.read.parquet(f"{path}/{name}")
        except AnalysisException:
            if name == "vectors":
                return None
            raise

    return Index(**{name: read(name) for name in Index.TABLES})


def _made(spark: SparkSession, path: str) -> tuple[bool, bool] | None:
    """Whether the index at ``path`` holds transcriptions and vectors; None where it is not complete."""
    try:
        row = spark.read.parquet(f"{path}/made").first()
    except AnalysisException:
        return None
    return (row.transcribed, row.embedded) if row else None


def _set_made(spark: SparkSession, path: str, rows: list[tuple[bool, bool]]) -> None:
    spark.createDataFrame(rows, "transcribed boolean, embedded boolean").write.mode("overwrite").parquet(f"{path}/made")


def _transcribed(parsed: DataFrame, root: str, path: str, transcriber: Transcriber | None) -> DataFrame:
    """Parse results with the transcriptions of images and scanned PDF files; each is rendered and read once."""
    spark = parsed.sparkSession
    texts = spark.createDataFrame([], "rel string, page int, text string, error string")
    if transcriber is not None:
        rendered_pages(parsed, root).write.mode("overwrite").parquet(f"{path}/rendered")
        transcribe.page_texts(spark.read.parquet(f"{path}/rendered"), transcriber).write.mode("overwrite").parquet(f"{path}/pages")
        spark.createDataFrame([], PAGES).write.mode("overwrite").parquet(f"{path}/rendered")  # images take room
        texts = spark.read.parquet(f"{path}/pages")
    return transcribe.with_transcribed(parsed, texts)


def ensure_index(spark: SparkSession, root: str, path: str, transcriber: Transcriber | None = None, embedder: Embedder | None = None) -> tuple[Index, bool]:
    """The index of a corpus folder, and whether it was built anew.

    It is, where files have changed, and where it lacks what a ``transcriber`` (the texts of images
    and scanned PDF files) or an ``embedder`` (the chunks' vectors) gives.  Without a transcriber such
    files are skipped as not transcribed; without an embedder there is no dense ranking.
    """
    now = signature(spark, root)
    made = _made(spark, path)
    try:
        if made and (made[0] or transcriber is None) and (made[1] or embedder is None) and same_signature(spark.read.parquet(f"{path}/signature"), now):
            return load_index(spark, path), False
    except AnalysisException:
        pass
    _set_made(spark, path, [])
    parsed = read_corpus(spark, root)
    parsed.write.mode("overwrite").parquet(f"{path}/parsed")
    parsed = _transcribed(spark.read.parquet(f"{path}/parsed"), root, path, transcriber)
    index = save_index(corpus.file_records(parsed), path)
    if embedder is not None:
        embedder.chunks(index.chunks).write.mode("overwrite").parquet(f"{path}/vectors")
        index = replace(index, vectors=spark.read.parquet(f"{path}/vectors"))
    corpus.skipped(parsed).write.mode("overwrite").parquet(f"{path}/skipped")
    parsed.select("rel", "size", "mtime_ns").write.mode("overwrite").parquet(f"{path}/signature")
    # Last, so that an index that was broken off is built again.
    _set_made(spark, path, [(transcriber is not None, embedder is not None)])
    return index, True


def report(spark: SparkSession, path: str) -> DataFrame:
    """(files, chunks, n_skipped, skipped): one row; skipped holds (rel, reason) of files that are not indexed."""
    index = load_index(spark, path)
    left_out = spark.read.parquet(f"{path}/skipped").agg(F.count(F.lit(1)).alias("n_skipped"), F.sort_array(F.collect_list(F.struct("rel", "reason"))).alias("skipped"))
    return index.files.agg(F.count(F.lit(1)).alias("files")).crossJoin(index.chunks.agg(F.count(F.lit(1)).alias("chunks"))).crossJoin(left_out)  # one row each
