"""File indexes, batches of outputs by accumulated time, and averages over them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that are numbered as a whole are cut into so many slices at most, a power of two.
SLICES = 256


def _sliced(rows: DataFrame, order: Sequence[str], ends: dict[str, Column]) -> DataFrame:
    """Append _slice, _before and what ``ends`` says of the slice before: slices follow each other in the order.

    The cuts are the rows of least hash, as good as drawn by lot, the same however the rows are dealt out, and collected
    at once. A slice is one task's; only rows that agree in all of the order can't be cut apart.
    """
    key = rows.select(F.struct(*order).alias("k"))
    low = key.orderBy(F.xxhash64("k"), "k").limit(SLICES - 1)
    kind, text = f"array<{key.schema[0].dataType.simpleString()}>", low.agg(F.to_json(F.collect_list("k"))).first()[0]
    cuts = F.sort_array(F.from_json(F.lit(text), kind))  # folded to one literal
    row = F.struct(*order)
    steps = [SLICES >> i for i in range(1, SLICES.bit_length())]
    place = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, w: F.when(F.get(cuts, at + w - 1) <= row, at + w).otherwise(at))
    cut_up = rows.withColumn("_slice", place)
    w = Window.orderBy("_slice")  # of SLICES rows at most
    each = cut_up.groupBy("_slice").agg(F.count("*").alias("_n"), *(e.alias(c) for c, e in ends.items()))
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.select("_slice", before.alias("_before"), *(F.lag(c).over(w).alias(c) for c in ends))
    return cut_up.join(F.broadcast(each), "_slice")


def intervals(outputs: DataFrame, time: str = "time", by: Sequence[str] = (), order: Sequence[str] = (), start: Column | float | None = None) -> DataFrame:
    """Append idx (from 0), time_previous_output and time_interval: the first output follows ``start`` (null: itself unknown).

    Without ``by`` all outputs are one list, which is numbered in slices side by side.
    """
    first = start if isinstance(start, Column) else F.lit(start).cast("double")
    if by:
        w = Window.partitionBy(*by).orderBy(time, *order)
        previous, number = F.lag(F.col(time)).over(w), F.row_number().over(w) - 1
    else:
        w = Window.partitionBy("_slice").orderBy(time, *order)
        previous = F.when(F.row_number().over(w) == 1, F.col("_last")).otherwise(F.lag(F.col(time)).over(w))
        number = (F.col("_before") + F.row_number().over(w) - 1).cast("int")
        outputs = _sliced(outputs, [time, *order], {"_last": F.max(time)})
    previous = F.coalesce(previous, first)
    return outputs.withColumns({"idx": number, "time_previous_output": previous, "time_interval": F.col(time) - previous}).drop("_slice", "_before", "_last")


def merge(indexes: Sequence[DataFrame], sort_by_time: bool = True, time: str = "time", start: str = "start_time") -> DataFrame:
    """Rows of several indexes numbered anew, with the least start time (null if none has one).

    Entries of files that are not there (path ``file_not_in_folder``) are left out.
    """
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), indexes)
    if "path" in both.columns:
        both = both.where(F.col("path").isNull() | (F.col("path") != "file_not_in_folder"))
    least = both.agg(F.min(start).alias("_least")) if start in both.columns else None
    order = [*([time] if sort_by_time else []), *(c for c in ("fname", "idx") if c in both.columns)]
    w = Window.partitionBy("_slice").orderBy(*order)
    out = _sliced(both.drop(start) if least is not None else both, order, {})
    out = out.withColumn("idx", (F.col("_before") + F.row_number().over(w) - 1).cast("int")).drop("_slice", "_before")
    return out.join(F.broadcast(least)).withColumnRenamed("_least", start) if least is not None else out


def batches(outputs: DataFrame, length: float, dt: str, by: Sequence[str], order: Sequence[str], keep: Sequence[str], tolerance: float = 0.05) -> DataFrame:
    """Append batch: outputs in order fill a batch while its time and theirs stay within length * (1 + tolerance).

    An output too long for what is left opens the next batch. If the very first one is too long, batch 0 stays empty.
    The fold runs within a key's ordered list of outputs (times only, not fields).
    """
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(dt).cast("double").alias("_dt"), *(c for c in keep if c not in order))))
    grouped = outputs.groupBy(*by).agg(rows.alias("_rows"))
    full = F.lit(length * (1 + tolerance))
    state = F.struct(F.lit(0).cast("long").alias("batch"), F.lit(0.0).alias("filled"), F.array().cast("array<bigint>").alias("done"))

    def step(s: Column, x: Column) -> Column:
        fits = s["filled"] + x["_dt"] <= full
        batch = F.when(fits, s["batch"]).otherwise(s["batch"] + 1)
        return F.struct(batch.alias("batch"), F.when(fits, s["filled"] + x["_dt"]).otherwise(x["_dt"]).alias("filled"), F.concat(s["done"], F.array(batch)).alias("done"))

    numbers = F.aggregate(F.col("_rows"), state, step, lambda s: s["done"])
    both = grouped.select(*by, F.explode(F.arrays_zip(F.col("_rows").alias("r"), numbers.alias("b"))).alias("_x"))
    names = [*order, *(c for c in keep if c not in order)]
    return both.select(*by, *(F.col(f"_x.r.{c}").alias(c) for c in names), F.col("_x.r._dt").alias(dt), F.col("_x.b").alias("batch"))


def time_average(fields: DataFrame, columns: Sequence[str], dt: str, by: Sequence[str]) -> DataFrame:
    """sum(f dt) / sum(dt) by batch and point, with batch_time the sum of dt."""
    return fields.groupBy(*by).agg(*((F.sum(F.col(c) * F.col(dt)) / F.sum(dt)).alias(c) for c in columns), F.sum(dt).alias("batch_time"))


def average_files(elements: DataFrame, index: DataFrame, fields: Sequence[str], key: str = "idx") -> DataFrame:
    """Time averages of element fields (arrays) by batch.

    index (key, batch, dt) is one row for each file; it is joined to the elements by the optimiser's choice of strategy.
    """
    joined = elements.join(index.select(key, "batch", "dt"), key)
    zipped = F.arrays_zip(*(F.col(c).alias(c) for c in fields))
    nodes = joined.select("batch", "elem_id", "dt", F.posexplode(zipped).alias("node", "_f"))
    sums = nodes.groupBy("batch", "elem_id", "node").agg(*((F.sum(F.col("_f")[c] * F.col("dt")) / F.sum("dt")).alias(c) for c in fields), F.sum("dt").alias("batch_time"))
    rows = F.sort_array(F.collect_list(F.struct("node", *fields)))
    packed = sums.groupBy("batch", "elem_id").agg(rows.alias("_r"), F.max("batch_time").alias("batch_time"))
    return packed.select("batch", "elem_id", "batch_time", *(F.col(f"_r.{c}").alias(c) for c in fields))
