"""Kernels within elements: one row for each element, fields as arrays of n * n * n nodes (x runs fastest)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

#: Rows of an Arrow batch that a kernel takes at once.
ROWS = 1024


def edge(size: int, dims: int = 3) -> int:
    """Nodes along an edge of an element with so many nodes."""
    n = round(size ** (1 / dims))
    if n**dims != size:
        raise ValueError(f"{size} nodes are no element of {dims} dimensions")
    return n


def matrix(column: pa.Array) -> np.ndarray:
    """An array column as (rows, nodes) of doubles."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def arrays(values: np.ndarray) -> pa.ListArray:
    values = np.ascontiguousarray(values, dtype=np.float64)
    n, m = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), pa.array(values.ravel()))


def kernel(df: DataFrame, inputs: Sequence[str], outputs: Sequence[str], f: Callable[..., Sequence[np.ndarray]], where: Column | None = None) -> DataFrame:
    """Append array columns: f takes the inputs as (rows, nodes) and returns each output so.

    Narrow: elements stay in their partitions, ROWS at a time. Rows with a null input get null outputs.
    """
    whole = F.lit(True) if where is None else where
    for c in inputs:
        whole = whole & F.col(c).isNotNull()
    marked = df.withColumn("_whole", whole)
    kept = [c for c in df.columns if c not in outputs]
    schema = StructType([f_ for f_ in df.schema.fields if f_.name in kept] + [StructField(c, ArrayType(DoubleType())) for c in outputs])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, ROWS):
                batch = big.slice(at, ROWS)
                ok = np.array(batch.column("_whole"), dtype=bool)
                mask = pa.array(ok)
                if ok.any():
                    made = [arrays(x) for x in f(*(matrix(batch.column(c).filter(mask)) for c in inputs))]
                else:
                    made = [pa.array([], pa.list_(pa.float64())) for _ in outputs]
                place = np.where(ok, np.cumsum(ok) - 1, 0)
                made = [x.take(pa.array(place, mask=~ok)) for x in made]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + made, schema=pa.schema([*(batch.schema.field(c) for c in kept), *((c, pa.list_(pa.float64())) for c in outputs)]))

    return marked.mapInArrow(work, schema)


def boxed(u: np.ndarray, dims: int = 3) -> np.ndarray:
    """(rows, nodes) as (rows, t, s, r); two dimensions have one t."""
    n = edge(u.shape[1], dims)
    return u.reshape(len(u), n if dims == 3 else 1, n, n)


def with_field(df: DataFrame, name: str, value: Column, overwrite: bool = False) -> DataFrame:
    """Append a field; replacing one needs overwrite."""
    if name in df.columns and not overwrite:
        raise ValueError(f"there is a field {name}")
    return df.withColumn(name, value)


def points(df: DataFrame, fields: Sequence[str], n: int, dims: int = 3) -> DataFrame:
    """One row for each node: the other columns, k, j, i and the fields' values."""
    others = [c for c in df.columns if c not in fields]
    zipped = F.arrays_zip(*(F.col(c).alias(c) for c in fields))
    out = df.select(*others, F.posexplode(zipped).alias("_node", "_f"))
    node = F.col("_node").cast("long")
    k = F.floor(node / (n * n)) if dims == 3 else F.lit(0)
    return out.select(*others, k.cast("int").alias("k"), (F.floor(node / n) % n).cast("int").alias("j"), (node % n).cast("int").alias("i"), *(F.col("_f")[c].cast("double").alias(c) for c in fields))


def linear_index(i: Column, j: Column, k: Column, e: Column, n: int) -> Column:
    return (i + n * (j + n * (k + n * e.cast("long")))).cast("long")


def nonlinear_index(index: Column, n: int) -> tuple[Column, Column, Column, Column]:
    """i, j, k and the element of a node's number."""
    part = lambda d: F.floor(index / d)
    return (index % n).cast("int"), (part(n) % n).cast("int"), (part(n * n) % n).cast("int"), part(n**3).cast("long")


def facet(name: Column | str, which: str, n: int) -> Column:
    """The n * n values of a facet (r-, r+, s-, s+, t-, t+), the faster axis first, without leaving the JVM."""
    axis, last = "rst".index(which[0]), which[1] == "+"
    step = [1, n, n * n]
    a, b = (step[x] for x in range(3) if x != axis)
    start = (n - 1) * step[axis] if last else 0
    col = F.col(name) if isinstance(name, str) else name
    return F.array(*(F.element_at(col, start + y * b + x * a + 1) for y in range(n) for x in range(n)))


def vertices(name: str, n: int) -> Column:
    """The eight corner values, r fastest."""
    ends = (0, n - 1)
    return F.array(*(F.element_at(F.col(name), (k * n + j) * n + i + 1) for k in ends for j in ends for i in ends))


def edges(name: str, n: int) -> Column:
    """The twelve edges' values: four along r, four along s, four along t."""
    ends, out = (0, n - 1), []
    for axis in range(3):
        for b in ends:
            for a in ends:
                at = [((b * n + a) * n + x) if axis == 0 else ((b * n + x) * n + a) if axis == 1 else ((x * n + b) * n + a) for x in range(n)]
                out.append(F.array(*(F.element_at(F.col(name), x + 1) for x in at)))
    return F.array(*out)
