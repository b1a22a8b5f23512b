"""Probe coordinates and time series in CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semspark.sources.lines import numbered


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(probe_id, x, y, z) from lines x,y,z; probes are numbered by line."""
    c = F.split("value", ",")
    rows = numbered(spark, path).where(F.trim("value") != "")
    return rows.select(F.col("line").alias("probe_id"), *(F.trim(c[i]).cast("double").alias(a) for i, a in enumerate("xyz")))


def read_series(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Points (probe_id, x, y, z) and series (probe_id, snapshot, t, fields) of a file written by write_series().

    Line 0 has the number of points, a number and the field names; then come the points, then for each time a line
    t,values for each point.
    """
    lines = numbered(spark, path).where(F.trim("value") != "")
    head = [x.strip() for x in lines.where("line = 0").first()["value"].split(",")]
    n, names = int(float(head[0])), head[2:]
    c = F.split("value", ",")
    body = lines.where("line > 0").withColumn("at", F.col("line") - 1)
    points = body.where(F.col("at") < n).select(F.col("at").alias("probe_id"), *(F.trim(c[i]).cast("double").alias(a) for i, a in enumerate("xyz")))
    at = F.col("at") - n
    series = body.where(F.col("at") >= n).select((at % n).alias("probe_id"), F.floor(at / n).cast("long").alias("snapshot"), F.trim(c[0]).cast("double").alias("t"), *(F.trim(c[i + 1]).cast("double").alias(f) for i, f in enumerate(names)))
    return points, series


def write_series(points: DataFrame, series: DataFrame, names: list[str], path: str) -> None:
    """The file that read_series() reads, as one part: lines sorted by section, snapshot and probe."""
    n = points.count()
    head = points.sparkSession.createDataFrame([(0, 0, 0, ",".join([str(n), "0", *names]))], "section int, snapshot long, probe_id long, value string")
    xyz = points.select(F.lit(1).alias("section"), F.lit(0).cast("long").alias("snapshot"), F.col("probe_id").cast("long").alias("probe_id"), F.concat_ws(",", "x", "y", "z").alias("value"))
    rows = series.select(F.lit(2).alias("section"), F.col("snapshot").cast("long").alias("snapshot"), F.col("probe_id").cast("long").alias("probe_id"), F.concat_ws(",", "t", *names).alias("value"))
    head.unionByName(xyz).unionByName(rows).repartitionByRange(1, "section", "snapshot", "probe_id").sortWithinPartitions("section", "snapshot", "probe_id").select("value").write.mode("overwrite").text(path)


def write_grid(cloud: DataFrame, path: str) -> None:
    """A structured cloud (i, j, k, x, y, z, ...) as Parquet, in grid order."""
    cloud.repartitionByRange("k", "j", "i").sortWithinPartitions("k", "j", "i").write.mode("overwrite").parquet(path)


def grid_to_list(cloud: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Grid points as probes: probe_id runs over i, then j, then k, the last fastest."""
    _, ny, nz = shape
    return cloud.withColumn("probe_id", (F.col("i") * ny + F.col("j")) * nz + F.col("k"))


def list_to_grid(probes: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    _, ny, nz = shape
    p = F.col("probe_id")
    return probes.withColumns({"i": F.floor(p / (ny * nz)), "j": F.floor(p / nz) % ny, "k": p % nz})
