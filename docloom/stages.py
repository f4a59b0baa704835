"""Stage tables: results that several steps read, written once to the folder that all executors see."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset, one of its own is set if driver and executors are one process, as in tests;
    on a cluster that is an error, as no executor sees another machine's folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="docloom-stages-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written as Parquet and read back.

    Later steps plan over a scan, however long the plan of ``df`` is, and a lost executor costs its
    running tasks only.
    """
    path = f"{shared_folder(df.sparkSession)}/docloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], column: str = "number") -> DataFrame:
    """``df`` with running numbers from 1 in ``order``: rows are sorted in ranges, and a range starts
    behind the counts of those before it."""
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    ranged = staged(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranged")
    before = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.join(starts, "__range").withColumn(column, F.col("__start") + inside).drop("__range", "__start")
