"""Text files with line numbers, read in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The numbers that Spark gives within a partition take the lower bits of its row ids.
_LOWER = (1 << 33) - 1


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): lines numbered from 0 within each file.

    Splits are read side by side; a count for each split, a few rows, gives where its lines begin.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().bitwiseAND(F.lit(_LOWER)).alias("at"))
    splits = rows.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("path", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(F.broadcast(splits), ["path", "block"]).select("path", (F.col("before") + F.col("at") - F.col("first")).alias("line"), "value")
