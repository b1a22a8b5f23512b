"""Field files of spectral-element solvers: a data source for reading, and a writer.

A file has a header of 132 characters, a number that tells the byte order, the numbers of its elements, and a block for
each field over all elements (vectors element by element, component by component). Tasks read ranges of elements by
offset. Files lie in a file system that all machines mount, as solvers write them.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

HEADER, MARK, SUFFIX = 132, 6.54321, ".f"
ELEMENTS = 4096


class Header(NamedTuple):
    word: int
    shape: tuple[int, int, int]
    elements: int
    all_elements: int
    time: float
    step: int
    file: int
    files: int
    variables: str

    @property
    def dims(self) -> int:
        return 3 if self.shape[2] > 1 else 2

    @property
    def nodes(self) -> int:
        return self.shape[0] * self.shape[1] * self.shape[2]

    def blocks(self) -> dict[str, list[str]]:
        """The fields of each block, in the order of the file."""
        axes, out = self.dims, {}
        if "X" in self.variables:
            out["X"] = list("xyz"[:axes])
        if "U" in self.variables:
            out["U"] = list("uvw"[:axes])
        out |= {k: [k.lower()] for k in "PT" if k in self.variables}
        if "S" in self.variables:
            out |= {f"S{i}": [f"s{i}"] for i in range(int(self.variables.split("S")[1]))}
        return out

    def text(self) -> bytes:
        x, y, z = self.shape
        return f"#std {self.word:1d} {x:2d} {y:2d} {z:2d} {self.elements:10d} {self.all_elements:10d} {self.time:20.13E} {self.step:9d} {self.file:6d} {self.files:6d} {self.variables}".ljust(HEADER).encode()


def parse(raw: bytes) -> Header:
    t = raw[:HEADER].decode("ascii", "replace").split()
    if len(t) < 12 or t[0] != "#std":
        raise ValueError("no field file header")
    return Header(int(t[1]), (int(t[2]), int(t[3]), int(t[4])), int(t[5]), int(t[6]), float(t[7]), int(t[8]), int(t[9]), int(t[10]), t[11])


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def _paths(path: str) -> list[str]:
    found = sorted(glob.glob(_local(path)))
    if not found:
        raise FileNotFoundError(path)
    return found


def read_header(path: str) -> Header:
    with open(_local(path), "rb") as f:
        return parse(f.read(HEADER))


class Range(InputPartition):
    def __init__(self, path: str, lo: int, hi: int):
        self.path, self.lo, self.hi = path, lo, hi


class FieldReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.names = options, [f.name for f in schema.fields if f.name not in ("path", "time", "step", "elem_id")]

    def partitions(self) -> list[Range]:
        size = int(self.options.get("elements", ELEMENTS))
        return [Range(p, a, min(a + size, h.elements)) for p in _paths(self.options["path"]) for h in [read_header(p)] for a in range(0, h.elements, size)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        with open(part.path, "rb") as f:
            h = parse(f.read(HEADER))
            mark = f.read(4)
            order = next((o for o in "<>" if abs(float(np.frombuffer(mark, f"{o}f4")[0]) - MARK) < 1e-3), None)
            if order is None:
                raise ValueError(f"{part.path}: no byte order fits")
            n = part.hi - part.lo
            f.seek(HEADER + 4 + 4 * part.lo)
            ids = np.frombuffer(f.read(4 * n), f"{order}i4").astype(np.int64)
            at, got = HEADER + 4 + 4 * h.elements, {}
            for names in h.blocks().values():
                width = h.word * h.nodes * len(names)
                if any(c in self.names for c in names):  # other blocks are never read
                    f.seek(at + part.lo * width)
                    data = np.frombuffer(f.read(n * width), f"{order}f{h.word}").reshape(n, len(names), h.nodes)
                    got |= {c: data[:, i] for i, c in enumerate(names)}
                at += h.elements * width
        columns = []
        for c in self.names:
            if c not in got:
                raise ValueError(f"{part.path} has no field {c}")
            flat = np.ascontiguousarray(got[c], np.float64).ravel()
            columns.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * h.nodes), pa.array(flat)))
        first = [pa.array([part.path] * n), pa.array(np.full(n, h.time)), pa.array(np.full(n, h.step, np.int64)), pa.array(ids)]
        yield pa.RecordBatch.from_arrays(first + columns, names=["path", "time", "step", "elem_id", *self.names])


class FieldSource(DataSource):
    """Format ``semfld``: rows (path, time, step, elem_id, fields as arrays of doubles).

    Options: path (a file or a pattern), fields (comma-separated; others aren't read), elements (for each task).
    """

    @classmethod
    def name(cls) -> str:
        return "semfld"

    def schema(self) -> StructType:
        names = [c for b in read_header(_paths(self.options["path"])[0]).blocks().values() for c in b]
        if "fields" in self.options:
            wanted = [c.strip() for c in self.options["fields"].split(",") if c.strip()]
            if missing := [c for c in wanted if c not in names]:
                raise ValueError(f"no fields {missing}")
            names = [c for c in names if c in wanted]
        first = [StructField("path", StringType()), StructField("time", DoubleType()), StructField("step", LongType()), StructField("elem_id", LongType())]
        return StructType(first + [StructField(c, ArrayType(DoubleType())) for c in names])

    def reader(self, schema: StructType) -> FieldReader:
        return FieldReader(self.options, schema)


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Range]:
        return [Range(p, 0, 0) for p in _paths(self.options["path"])]

    def read(self, part: Range) -> Iterator[tuple]:
        h = read_header(part.path)
        yield (part.path, os.path.basename(part.path), h.word, *h.shape, h.elements, h.all_elements, h.time, h.step, h.file, h.files, h.variables)


class HeaderSource(DataSource):
    """Format ``semfld_header``: a row for each file, from its first 132 bytes."""

    @classmethod
    def name(cls) -> str:
        return "semfld_header"

    def schema(self) -> str:
        return "path string, fname string, word int, lx int, ly int, lz int, elements long, all_elements long, time double, step long, file int, files int, variables string"

    def reader(self, schema: StructType) -> HeaderReader:
        return HeaderReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FieldSource)
    spark.dataSource.register(HeaderSource)


def read(spark: SparkSession, path: str, fields: Sequence[str] | None = None, elements: int = ELEMENTS) -> DataFrame:
    register(spark)
    r = spark.read.format("semfld").option("elements", elements)
    return (r.option("fields", ",".join(fields)) if fields is not None else r).load(path)


def headers(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("semfld_header").load(path)


def write(df: DataFrame, folder: str, case: str, index: int, time: float = 0.0, step: int = 0, word: int = 4, files: int = 1, dims: int = 3) -> None:
    """Write elements (elem_id and any of x, y, z, u, v, w, p, t, s0 ..) as ``files`` files of one output.

    Each task writes the file of one range of elements, numbered in the header, and puts it in place when complete, so
    that a repeated task does no harm. A file's elements are held by its task: choose ``files`` by their size.
    """
    have = df.columns
    scalars = sum(1 for c in have if c[0] == "s" and c[1:].isdigit())
    variables = ("X" if "x" in have else "") + ("U" if "u" in have else "") + ("P" if "p" in have else "") + ("T" if "t" in have else "") + (f"S{scalars:02d}" if scalars else "")
    total = df.count()
    probe = Header(word, (2, 2, 2 if dims == 3 else 1), 0, total, time, step, 0, files, variables)
    names = [c for b in probe.blocks().values() for c in b]
    target = _local(folder)
    os.makedirs(target, exist_ok=True)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = pa.Table.from_batches(batches, schema=None) if (batches := list(batches)) else None
        part = TaskContext.get().partitionId()
        if rows is not None and rows.num_rows:
            rows = rows.combine_chunks().to_batches()[0]
            ids = rows.column("elem_id").to_numpy().astype("<i4")
            data = {c: rows.column(c).flatten().cast(pa.float64()).to_numpy().reshape(len(ids), -1) for c in names}
            size = next(iter(data.values())).shape[1]
            n = round(size ** (1 / dims))
            h = probe._replace(shape=(n, n, n if dims == 3 else 1), elements=len(ids), file=part)
            path = os.path.join(target, f"{case}{part}{SUFFIX}{index:05d}")
            partial = f"{path}.{TaskContext.get().taskAttemptId()}"
            with open(partial, "wb") as f:
                f.write(h.text())
                f.write(np.array([MARK], "<f4").tobytes())
                f.write(ids.tobytes())
                blocks = [np.stack([data[c] for c in b], 1) for b in h.blocks().values()]
                for b in blocks:
                    f.write(b.astype(f"<f{word}").tobytes())
                if dims == 3:  # least and largest value for each element and component
                    for b in blocks:
                        f.write(np.stack((b.min(2), b.max(2)), 2).astype("<f4").tobytes())
            os.replace(partial, path)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], names=["part"])

    ordered = df.select("elem_id", *names).repartitionByRange(files, "elem_id") if files > 1 else df.select("elem_id", *names).coalesce(1)
    ordered.sortWithinPartitions("elem_id").mapInArrow(task, "part int").foreach(lambda _: None)


def visit_file(index: DataFrame, case: str) -> str:
    """The text that tells viewers which files a case has: first number and count."""
    r = index.agg(F.min("idx").alias("a"), F.count("*").alias("n")).first()
    return f"filetemplate: {case}%01d.f%05d\nfirsttimestep: {r['a'] or 0}\nnumtimesteps: {r['n']}\n"
