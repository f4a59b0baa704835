"""Scoring transcriptions against expected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import fixed, text


def compared(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, want, got, hit, seconds) of expected (name, text) and actual (name, text, seconds, present).

    An image that is not present is no row here but stays in the total; a missing output is
    ``<NO FILE>``.
    """
    joined = expected.select("name", F.col("text").alias("want")).join(actual.select("name", F.col("text").alias("got"), "seconds", "present"), "name", "left")
    there = joined.where(F.coalesce("present", F.lit(False))).withColumn("got", F.coalesce("got", F.lit("<NO FILE>")))
    return there.select("name", "want", "got", (text.score_norm("got") == text.score_norm("want")).alias("hit"), "seconds")


def total_score(expected: DataFrame, rows: DataFrame) -> DataFrame:
    """(points, most, slowest): one row."""
    sums = rows.agg(F.coalesce(F.sum(F.col("hit").cast("int")), F.lit(0)).alias("hits"), F.coalesce(F.max("seconds"), F.lit(0.0)).alias("slowest"))
    return sums.crossJoin(expected.agg(F.count(F.lit(1)).alias("n"))).select((F.col("hits") * fixed.POINTS).alias("points"), (F.col("n") * fixed.POINTS).alias("most"), "slowest")  # one row each
