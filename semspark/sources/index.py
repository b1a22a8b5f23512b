"""File indexes from JSON, from a solver's log, and from folders of field files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semspark.operators import timeaverage
from semspark.sources.lines import numbered

CONTENTS = "struct<mesh_fields: int, velocity_fields: int, pressure_fields: int, temperature_fields: int, scalar_fields: int>"
ENTRY = f"struct<fname: string, path: string, time: double, time_previous_output: double, time_interval: double, file_contents: {CONTENTS}>"
START_KEYS = ("simulation_start_time", "statistics_start_time")
#: Numbers of an index that go into one JSON text, about 2 MB.
ENTRIES = 8192


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(idx, fname, path, time, time_previous_output, time_interval, file_contents, start_time) of index files.

    Keys that are whole numbers are entries; the others' only use is the start time, null where there is none.
    """
    text = spark.read.text(path, wholetext=True)
    start = F.coalesce(*(F.get_json_object("value", f"$.{k}").cast("double") for k in START_KEYS))
    entries = F.from_json("value", "map<string, string>")
    text = text.select(start.alias("start_time"), entries.alias("entries"))  # once for each file, not for each entry
    rows = text.select("start_time", F.explode("entries").alias("key", "entry"))
    rows = rows.withColumn("idx", F.expr("try_cast(key AS int)")).where("idx IS NOT NULL")
    return rows.select("idx", F.from_json("entry", ENTRY).alias("e"), "start_time").select("idx", "e.*", "start_time")


def write_json(index: DataFrame, path: str, start_time: float | None = None, start_key: str = START_KEYS[0]) -> None:
    """A folder of JSON texts for the index, each complete and with the start time, of ENTRIES numbers (idx, unique) in order.

    An index of up to ENTRIES files is one text. Executors make the texts; the driver holds none.
    """
    names = [c for c in ("fname", "path", "time", "time_previous_output", "time_interval", "file_contents") if c in index.columns]
    start = [f"{json.dumps(start_key)}: {json.dumps(start_time)}"] if start_time is not None else []
    entry = F.concat(F.lit('"'), F.col("idx").cast("string"), F.lit('": '), F.to_json(F.struct(*names), {"ignoreNullFields": "true"}))
    rows = index.where("idx IS NOT NULL").select(F.floor(F.col("idx") / ENTRIES).cast("long").alias("part"), F.struct(F.col("idx").cast("long").alias("idx"), entry.alias("entry")).alias("e"))
    rows = rows.unionByName(index.sparkSession.range(0, 1, 1, 1).select(F.col("id").alias("part")), allowMissingColumns=True)  # a text even if there is no entry
    entries = F.transform(F.sort_array(F.collect_list("e")), lambda e: e["entry"])
    lines = F.concat(F.array(*map(F.lit, start)).cast("array<string>"), entries)
    texts = rows.groupBy("part").agg(F.concat(F.lit("{\n "), F.array_join(lines, ",\n "), F.lit("\n}")).alias("value"))
    texts.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def from_log(spark: SparkSession, path: str) -> DataFrame:
    """Outputs that a solver's log reports: (log, file, idx, fname, time, time_previous_output, time_interval, start_time).

    File names announced before the first time step are the outputs to look for; the ``t =`` two lines before that step
    is the start. Each "Writer output" line opens a block, up to the next one and 2 * files + 2 lines at most, whose
    lines may name a file (with the output's number on the next line) and a writing time.
    """
    told = F.col("value").rlike(r"File name\s*:|Time-step|Writer output|Output number\s*:|Writing at time:|t =\s*[+-]?\d")
    number = r"([+-]?\d*\.\d+E[+-]?\d+)"
    every = numbered(spark, path)
    lines = every.where(told)
    steps = lines.where(F.col("value").contains("Time-step")).groupBy("path").agg(F.min("line").alias("step"))
    starts = lines.join(F.broadcast(steps), "path").where("line = step - 2").select("path", F.regexp_extract("value", rf"t =\s*{number}", 1).cast("double").alias("start_time"))
    head = steps.join(starts, "path", "left")
    name = F.trim(F.regexp_extract("value", r"File name\s*:\s*(.+)", 1))
    early = lines.join(F.broadcast(head), "path").where(F.col("line") < F.col("step")).where(F.col("value").rlike(r"File name\s*:"))
    files = early.select("path", name.alias("file")).distinct()
    names = sorted({r["file"] for r in files.collect()})  # the outputs that a run announces
    for x in names:
        told = told | F.col("value").contains(f" {x}")
    lines = every.where(told).join(F.broadcast(head), "path")
    counted = files.groupBy("path").agg(F.count("*").alias("files"))
    w = Window.partitionBy("path").orderBy("line")
    later = lines.where(F.col("line") > F.col("step"))
    later = later.withColumn("block", F.last(F.when(F.col("value").contains("Writer output"), F.col("line")), True).over(w))
    later = later.withColumns({"next": F.lead("value").over(w), "next_line": F.lead("line").over(w)}).where("block IS NOT NULL")
    later = later.join(F.broadcast(counted), "path").where(F.col("line") < F.col("block") + 2 * F.col("files") + 2)
    times = later.where(F.col("value").contains("Writing at time:")).groupBy("path", "block").agg(F.max_by(F.regexp_extract("value", r"Writing at time:\s*(\d+\.\d+)", 1).cast("double"), "line").alias("time"))
    number = F.when(F.col("next_line") == F.col("line") + 1, F.expr("try_cast(regexp_extract(next, 'Output number\\\\s*:\\\\s*(\\\\d+)', 1) AS int)"))
    named = later.join(F.broadcast(files), "path").where(F.col("value").contains(F.concat(F.lit(" "), F.col("file"))))
    named = named.groupBy("path", "file", "block", "start_time").agg(F.max_by(number, "line").alias("number"))
    found = named.join(times, ["path", "block"])
    fname = F.concat(F.substring_index("file", ".", 1), F.lit("0.f"), F.lpad(F.col("number").cast("string"), 5, "0"))
    out = timeaverage.intervals(found.withColumn("fname", fname), "time", ["path", "file"], ["block"], F.col("start_time"))
    return out.select(F.col("path").alias("log"), "file", "idx", "fname", "time", "time_previous_output", "time_interval", "start_time")


def from_headers(headers: DataFrame, run_start: float | None = None, statistics_start: float | None = None) -> DataFrame:
    """An index by file type from the headers of field files (source ``semfld_header``).

    A type is a name up to its last digit before the number, with .fld; statistics (names with "stat" or "mean") count
    intervals from their own start.
    """
    kind = F.concat(F.regexp_replace(F.regexp_extract("fname", r"^(.*)\.f\d+$", 1), r"\d$", ""), F.lit(".fld"))
    rows = headers.withColumn("file_type", kind)
    start = F.when(F.col("file_type").rlike("stat|mean"), F.lit(statistics_start).cast("double")).otherwise(F.lit(run_start).cast("double"))
    out = timeaverage.intervals(rows.withColumn("start_time", start), "time", ["file_type"], ["fname"], F.col("start_time"))
    has = lambda letter, n: F.when(F.col("variables").contains(letter), n).otherwise(0)
    dims = F.when(F.col("lz") > 1, 3).otherwise(2)
    scalars = F.coalesce(F.expr("try_cast(regexp_extract(variables, 'S(\\\\d+)', 1) AS int)"), F.lit(0))
    contents = F.struct(has("X", dims).alias("mesh_fields"), has("U", dims).alias("velocity_fields"), has("P", 1).alias("pressure_fields"), has("T", 1).alias("temperature_fields"), scalars.alias("scalar_fields"))
    return out.select("file_type", "idx", "fname", "path", "time", "time_previous_output", "time_interval", contents.alias("file_contents"), "start_time")
