"""Chunks and identifiers of documents that arrive as a stream (an extension).

Everything that is a function of one document runs on the stream; corpus-wide numbers (idf,
identifier frequencies, revision families) are computed over what has arrived, by reading the
written tables as a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from docloom.operators import corpus
from docloom.operators.index import file_identifiers


def stream_chunks(docs: DataFrame) -> DataFrame:
    """Chunks of a stream of (doc_id, text); stateless, so any output mode and rate will do."""
    return corpus.chunks(corpus.documents_as_files(docs))


def start_ingest(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes chunks and identifiers of arriving documents; a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        files = corpus.documents_as_files(batch)
        corpus.chunks(files).write.mode("overwrite").parquet(f"{path}/chunks/batch={number}")
        file_identifiers(files).write.mode("overwrite").parquet(f"{path}/file_ids/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
