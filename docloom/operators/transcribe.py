"""Transcribed images: plates and signs as results, corpus images as units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import recognition
from docloom.functions.text import strip
from docloom.models import Transcriber


def transcriptions(images: DataFrame, transcriber: Transcriber) -> DataFrame:
    """(name, text, kind, confidence) of images (name, content); one that fails is empty with confidence 0."""
    read = transcriber.transcribe(images).select("name", recognition.reply_kind("reply").alias("kind"), recognition.reply_text("reply").alias("told"), recognition.confidence("probabilities").alias("confidence"))
    cleaned = read.select("name", recognition.clean_recognised("told", "kind").alias("text"), "kind", "confidence")
    return images.select("name").join(cleaned, "name", "left").select("name", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("kind", F.lit("SIGN")).alias("kind"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def page_texts(pages: DataFrame, transcriber: Transcriber) -> DataFrame:
    """(rel, page, text, error) of rendered pages (rel, page, name, content, error)."""
    read = transcriber.transcribe(pages.where("content is not null").select("name", "content")).select("name", strip("reply").alias("text"))
    told = pages.select("rel", "page", "name", "error").join(read, "name", "left")
    return told.select("rel", "page", "text", F.coalesce("error", F.when(F.col("text").isNull(), "no reply")).alias("error"))


def with_transcribed(parsed: DataFrame, pages: DataFrame) -> DataFrame:
    """Parse results with units for images and scanned PDF files, from pages (rel, page, text, error).

    An image has one page.  Files whose transcription failed, or that have none, are skipped with
    the reason.
    """
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    told = pages.groupBy("rel").agg(ordered.alias("pages"), F.max("error").alias("error"))
    open_kind = F.coalesce(F.col("kind").isin("image", "pdf_scanned") & F.col("skip").isNull(), F.lit(False))
    joined = parsed.where(open_kind).join(told, "rel", "left")
    loc = lambda p: F.when(F.col("kind") == "image", "text in image").otherwise(F.concat(F.lit("page "), p["page"].cast("string")))
    units = F.transform("pages", lambda p: F.struct(p["text"].alias("text"), loc(p).alias("loc"), F.lit(False).alias("is_row")))
    skip = F.when(F.col("error").isNotNull(), F.concat(F.lit("ocr failed: "), F.col("error"))).when(F.col("pages").isNull(), "not transcribed")
    kept = [c for c in parsed.columns if c not in ("units", "skip")]
    filled = joined.select(*kept, skip.alias("skip"), F.coalesce(units, F.col("units")).alias("units"))
    return parsed.where(~open_kind).select(*kept, "skip", "units").unionByName(filled)  # other files meet no join
