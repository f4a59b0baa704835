"""Sinks: answers and transcriptions as JSON."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import replies


def answer_json(results: DataFrame) -> DataFrame:
    """(name, body): the file name and JSON of each result (qid, answer, citations, confidence)."""
    has = F.coalesce("answer", F.lit("")) != ""
    body = F.struct(F.coalesce("answer", F.lit("")).alias("answer"), F.when(has, F.coalesce("citations", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("citations"), F.coalesce("confidence", F.lit(0.0)).cast("double").alias("confidence"))
    return results.select(F.concat(replies.safe_name("qid"), F.lit("_output.json")).alias("name"), F.to_json(body).alias("body"))


def transcription_json(results: DataFrame) -> DataFrame:
    """(name, body) of transcriptions (name, text, confidence); a missing one is empty."""
    body = F.struct(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(0.0)).cast("double").alias("confidence"))
    stem = F.regexp_replace(F.regexp_extract("name", r"[^/]*$", 0), r"(?<=[^.])\.[^.]*$", "")
    return results.select(F.concat(stem, F.lit("_output.json")).alias("name"), F.to_json(body).alias("body"))


def write_files(named: DataFrame, folder: str) -> int:
    """Writes (name, body) as one file each in a folder that all executors share; returns how many.

    A file appears whole or not at all, so a task that runs twice does no harm.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for frame in frames:
            for name, body in zip(frame["name"], frame["body"], strict=True):
                json.loads(body)
                path = os.path.join(folder, name)
                part = f"{path}.{os.getpid()}.tmp"
                with open(part, "w", encoding="utf-8") as file:
                    file.write(body)
                os.replace(part, path)
            yield pd.DataFrame({"n": [len(frame)]})

    return named.mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0
