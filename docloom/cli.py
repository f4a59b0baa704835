"""Command line: build or check an index, answer questions from recorded replies.

    python -m docloom.cli --index FOLDER --store FOLDER [--query TEXT | --query-file FILE] [--replies FILE] [--transcriptions FILE] [--vectors FILE] [--query-vectors FILE] [--output-dir FOLDER]
"""

from __future__ import annotations

import argparse
import os
from dataclasses import replace

from pyspark.sql import SparkSession

from docloom import models
from docloom.operators.answer import answer
from docloom.sources import index_store, questions, results


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Index a corpus folder and answer questions on it.")
    parser.add_argument("--index", metavar="FOLDER", help="corpus folder to index")
    parser.add_argument("--store", metavar="FOLDER", required=True, help="where index tables are kept")
    parser.add_argument("--query", help="a question, or a file of questions")
    parser.add_argument("--question", help="a question; --query is its id then")
    parser.add_argument("--query-id", "--query_id", "--qid", "--id", "--question-id", dest="qid")
    parser.add_argument("--query-file", "--input", "--input-file", "--questions", dest="file")
    parser.add_argument("--replies", metavar="FILE", help="JSON lines of qid and reply of the reader model")
    parser.add_argument("--transcriptions", metavar="FILE", help="JSON lines of name (path, or path#page=N) and reply of the transcriber model")
    parser.add_argument("--vectors", metavar="FILE", help="JSON lines of chunk_id and vector of the embedding model")
    parser.add_argument("--query-vectors", metavar="FILE", help="JSON lines of qid and query_vector of the embedding model")
    parser.add_argument("--output-dir", "--output_dir", dest="output", default="output")
    known, rest = parser.parse_known_args(argv)
    known.rest = " ".join(r for r in rest if not r.startswith("-"))
    return known


def asked(spark: SparkSession, args: argparse.Namespace):
    """(qid, question) of the arguments; None without any."""
    path = args.file or (args.query if args.query and os.path.isfile(args.query) else None)
    if path:
        found = questions.read_questions(spark, path).select("qid", "question")
        return found.selectExpr("qid", "question") if not args.qid or found.count() != 1 else found.selectExpr(f"'{args.qid}' as qid", "question")
    text = args.question or args.query or args.rest
    if not text:
        return None
    name = args.qid or (args.query if args.question and args.query else None) or "query"
    return spark.createDataFrame([(name, text)], "qid string, question string")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(argv)
    spark = spark or SparkSession.builder.appName("docloom").getOrCreate()
    read = lambda path, schema: spark.read.schema(schema).json(path) if path else None
    recorded = models.Recorded(
        query_vectors=read(args.query_vectors, "qid string, query_vector array<double>"),
        chunk_vectors=read(args.vectors, "chunk_id long, vector array<double>"),
        transcriptions=read(args.transcriptions, "name string, reply string, probabilities array<double>"),
    )
    if args.index:
        index_store.ensure_index(spark, args.index, args.store, recorded if args.transcriptions else None, recorded if args.vectors else None)
        index_store.report(spark, args.store).show(truncate=False)
    queries = asked(spark, args)
    if queries is None:
        return 0
    schema = "qid string, reply string"
    replies = spark.read.schema(schema).json(args.replies) if args.replies else spark.createDataFrame([], schema)
    found = answer(index_store.load_index(spark, args.store), queries, replace(recorded, reply_table=replies), recorded if args.query_vectors else None)
    return 0 if results.write_files(results.answer_json(found), args.output) else 1


if __name__ == "__main__":
    raise SystemExit(main())
