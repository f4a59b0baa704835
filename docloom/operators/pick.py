"""Choosing the one file that a question is about, by a model that sees a listing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import fixed, replies, text
from docloom.operators.citations import answer_files, resolve_names
from docloom.operators.index import Index
from docloom.stages import staged

INSTRUCTION = "Several files hold the answer to a question. Name the path of the one file that the question is about, and nothing else."


def listing_part(rel: Column | str, parts: Column | str) -> Column:
    """A file in a listing: its path, and its chunks (array of strings), both within their limits."""
    cut = F.transform(parts, lambda t: F.left(t, F.lit(fixed.PICK_CHUNK_CHARS)))
    return F.concat(F.lit("### "), rel, F.lit("\n"), F.left(F.array_join(cut, "\n"), F.lit(fixed.PICK_FILE_CHARS)))


def listings(index: Index, answers: DataFrame) -> DataFrame:
    """(qid, question, answer, files, listing) of answers that several files may be cited for.

    ``answers`` is as :func:`docloom.operators.citations.choose_citations` takes it.  A file is listed
    with those of its chunks that hold the answer.
    """
    found = answer_files(index, answers).select("qid", "question", "answer", "rel", "ord", "shown_ord")
    chunks = index.chunks.select("chunk_id", "rel", F.col("text").alias("body"))
    holding = found.join(chunks, "rel", "left").withColumn("body", F.when(text.contains_value("body", "answer"), F.col("body")))
    parts = holding.groupBy("qid", "question", "answer", "rel", "ord", "shown_ord").agg(F.array_sort(F.collect_list(F.when(F.col("body").isNotNull(), F.struct("chunk_id", "body")))).alias("held"))
    parts = parts.select("qid", "question", "answer", F.struct("ord", "shown_ord", "rel", listing_part("rel", F.transform("held", lambda h: h["body"])).alias("part")).alias("file"))
    every = parts.groupBy("qid", "question", "answer").agg(F.array_sort(F.collect_list("file")).alias("listed")).where(F.size("listed") > 1)
    return every.select("qid", "question", "answer", F.transform("listed", lambda f: f["rel"]).alias("files"), F.array_join(F.transform("listed", lambda f: f["part"]), "\n\n").alias("listing"))


def picked(listed: DataFrame, said: DataFrame) -> DataFrame:
    """(qid, rel): the first file of the listing that a reply (qid, reply) names; no row without one."""
    named = resolve_names(replies.file_names_in("reply"), "files")
    return listed.select("qid", "files").join(said.select("qid", "reply"), "qid").select("qid", F.get(named, F.lit(0)).alias("rel")).where("rel is not null")


@dataclass(frozen=True)
class PromptedPicker:
    """A picker around ``model``, which gives (qid, reply) of (qid, prompt)."""

    model: Callable[[DataFrame], DataFrame]

    def picks(self, index: Index, answers: DataFrame) -> DataFrame:
        listed = staged(listings(index, answers), "listings")
        prompt = F.concat(F.lit(f"{INSTRUCTION}\n\nQuestion: "), "question", F.lit("\nAnswer: "), "answer", F.lit("\n\n"), "listing")
        return picked(listed, self.model(listed.select("qid", prompt.alias("prompt"))))
