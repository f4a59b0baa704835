"""Questions from files: JSON lists, objects and strings, or plain text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text

#: Keys of a question and of its id, the preferred ones first.
QUESTION_KEYS = ("question", "query", "text", "q", "prompt")
ID_KEYS = ("id", "query_id", "qid", "query-id", "question_id")


def parse_questions(files: DataFrame) -> DataFrame:
    """(path, n, qid, question) of files (path, content).

    A list's items are numbered from 1 and get ``stem_n`` where they have no id; one item gets the
    stem.  Strings are questions, objects have one under a known key or an empty one, other values
    are left out.  What is no JSON is one question as it stands.
    """
    stem = text.without_extension(text.base_name("path"))
    parsed = files.select("path", stem.alias("stem"), "content", F.try_parse_json("content").alias("v"))
    kind = F.schema_of_variant("v")
    items = F.when(kind.startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    listed = parsed.where("v is not null").select("path", "stem", items.alias("items")).select("path", "stem", F.size("items").alias("many"), F.posexplode("items").alias("n", "item"))
    shape = F.schema_of_variant("item")

    def under(key: str, types: str):
        value = F.try_variant_get("item", f"$['{key}']", "variant")
        return F.when(F.schema_of_variant(value).rlike(types), F.try_variant_get("item", f"$['{key}']", "string"))

    question = F.coalesce(*(under(k, "^STRING$") for k in QUESTION_KEYS), F.lit(""))
    given = F.coalesce(*(F.nullif(under(k, "^(STRING|BIGINT|DECIMAL|DOUBLE|BOOLEAN)"), F.lit("")) for k in ID_KEYS))
    default = F.when(F.col("many") == 1, F.col("stem")).otherwise(F.concat_ws("_", "stem", (F.col("n") + 1).cast("string")))
    told = listed.where(shape.isin("STRING") | shape.startswith("OBJECT")).select(
        "path",
        (F.col("n") + 1).alias("n"),
        F.when(shape == "STRING", default).otherwise(F.coalesce(given, default)).alias("qid"),
        F.when(shape == "STRING", F.try_variant_get("item", "$", "string")).otherwise(question).alias("question"),
    )
    plain = parsed.where("v is null").select("path", F.lit(1).alias("n"), F.col("stem").alias("qid"), text.strip("content").alias("question"))
    return told.unionByName(plain)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, qid, question) of a file or folder of question files."""
    files = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    return parse_questions(files)
