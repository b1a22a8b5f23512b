"""Streams of outputs: running moments, time batches and POD by micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from semspark.operators import rom


def running_mean(stream: DataFrame, fields: Sequence[str], by: Sequence[str], weight: str | None = None) -> DataFrame:
    """Means by key (weighted, if a weight is named), with n outputs: state is a few sums for each key. Use mode update or complete."""
    if weight is None:
        return stream.groupBy(*by).agg(*(F.avg(c).alias(c) for c in fields), F.count("*").alias("n"))
    return stream.groupBy(*by).agg(*((F.sum(F.col(c) * F.col(weight)) / F.sum(weight)).alias(c) for c in fields), F.count("*").alias("n"))


def running_nobm(stream: DataFrame, fields: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Running batch means: <f> and <f>_var, as for a table."""
    return stream.groupBy(*by).agg(*(x for c in fields for x in (F.avg(c).alias(c), (F.var_pop(c) / F.count(c)).alias(f"{c}_var"))))


def time_batches(stream: DataFrame, key: str, time: str, dt: str, length: float, tolerance: float = 0.05, lateness: str = "10 minutes") -> DataFrame:
    """(key, time, dt, batch): outputs of each key fill batches by accumulated dt, in time order.

    Outputs wait in the state until the watermark passes them, so that late ones still come in order; the state of a key
    is what waits, a batch number and a sum.
    """

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch, filled, times, spans = state.get if state.exists else (0, 0.0, [], [])
        waiting = list(zip(times, spans, strict=True))
        for f in frames:
            waiting += [(int(t.value // 1000), float(d)) for t, d in zip(f[time], f[dt], strict=True)]
        waiting.sort()
        mark = state.getCurrentWatermarkMs() * 1000
        ready = [x for x in waiting if x[0] <= mark]
        waiting = waiting[len(ready) :]
        rows = []
        for t, d in ready:
            if filled + d <= length * (1 + tolerance):
                filled += d
            else:
                batch, filled = batch + 1, d
            rows.append((keys[0], pd.Timestamp(t, unit="us"), d, batch))
        state.update((batch, filled, [t for t, _ in waiting], [d for _, d in waiting]))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=[key, time, dt, "batch"])

    kind = stream.schema[key].dataType.simpleString()
    marked = stream.withWatermark(time, lateness)
    return marked.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {time} timestamp, {dt} double, batch long", "batch long, filled double, times array<long>, spans array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def pod(stream: DataFrame, state: rom.Streaming, column: str, after: Callable[[rom.Streaming, int], None] | None = None) -> DataStreamWriter:
    """A writer that updates a streaming POD with every micro-batch of snapshots (keys, column an array)."""

    def step(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            state.update(batch, column)
            if after:
                after(state, number)

    return stream.writeStream.foreachBatch(step)
