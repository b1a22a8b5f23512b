"""Reduced-order models of tall snapshot matrices: rows are points with an array of snapshots, a few hundred at most."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from semspark.operators.elements import arrays, kernel, matrix


class Decomposition(NamedTuple):
    """Singular values, right vectors (modes by snapshots), and the modes: the points' columns and ``modes``, an array."""

    d: np.ndarray
    vt: np.ndarray
    modes: DataFrame


def scaled(snapshots: DataFrame, column: str, mass: str, least: float = 1e-12) -> DataFrame:
    """Snapshots times the root of the mass (0 counts as ``least``)."""
    b = F.when(F.col(mass) == 0, least).otherwise(F.col(mass))
    return snapshots.withColumn(column, F.transform(column, lambda x: x * F.sqrt(b)))


def unscaled(modes: DataFrame, column: str, mass: str, least: float = 1e-12) -> DataFrame:
    b = F.when(F.col(mass) == 0, least).otherwise(F.col(mass))
    return modes.withColumn(column, F.transform(column, lambda x: x / F.sqrt(b)))


def _tall(df: DataFrame, column: str, make: Callable[[np.ndarray | None, np.ndarray], np.ndarray], width: str = "long") -> DataFrame:
    """One small matrix for each task, from all its rows in turn, as rows (part, i, values)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                state = make(state, matrix(batch.column(0).slice(at, 4096)))
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(state))), arrays(state)], names=["i", "x"])

    return df.select(column).where(F.col(column).isNotNull()).mapInArrow(work, "i long, x array<double>")


def gram(df: DataFrame, column: str) -> DataFrame:
    """(i, j, value): the products of all pairs of snapshots, summed over points; partial sums within tasks."""
    parts = _tall(df, column, lambda s, x: x.T @ x if s is None else s + x.T @ x)
    return parts.select("i", F.posexplode("x").alias("j", "v")).groupBy("i", F.col("j").cast("long").alias("j")).agg(F.sum("v").alias("value"))


def _triangle(state: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    return np.linalg.qr(x if state is None else np.vstack((state, x)), mode="r")


def triangle(df: DataFrame, column: str, fan: int = 16) -> np.ndarray:
    """R of the tall matrix's QR factorisation, by a tree: tasks' triangles meet ``fan`` at a time, the last few here."""
    parts = _tall(df, column, _triangle).groupBy(F.spark_partition_id().alias("part")).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("r"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for rows in batch.column("r").to_pylist():
                state = _triangle(state, np.array([r["x"] for r in rows]))
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([[{"i": i, "x": x.tolist()} for i, x in enumerate(state)]], pa.list_(pa.struct([("i", pa.int64()), ("x", pa.list_(pa.float64()))])))], names=["part", "r"])

    met = parts.select(F.col("part").cast("int").alias("part"), "r").repartition(fan).mapInArrow(meet, "part int, r array<struct<i: long, x: array<double>>>")
    state = None
    for row in met.toLocalIterator():  # at most fan triangles
        state = _triangle(state, np.array([r["x"] for r in row["r"]]))
    return np.zeros((0, 0)) if state is None else state


def _signed(vt: np.ndarray) -> np.ndarray:
    """Each right vector with its largest component positive, so that results are reproducible."""
    if not vt.size:
        return vt
    lead = vt[np.arange(len(vt)), np.abs(vt).argmax(1)]
    return vt * np.where(lead < 0, -1, 1)[:, None]


def apply(df: DataFrame, column: str, m: np.ndarray, out: str) -> DataFrame:
    """Append the array column times a small matrix."""
    return kernel(df, [column], [out], lambda x: [x @ m])


def pod(df: DataFrame, column: str, modes: int, mass: str | None = None, method: str = "tsqr") -> Decomposition:
    """Proper orthogonal decomposition. tsqr keeps trailing modes accurate; gram takes one pass of sums.

    Modes are orthonormal under the mass, where one is given.
    """
    x = scaled(df, column, mass) if mass else df
    if method == "gram":
        rows = gram(x, column).collect()  # snapshots squared
        n = 1 + max((r["i"] for r in rows), default=-1)
        g = np.zeros((n, n))
        for r in rows:
            g[r["i"], r["j"]] = r["value"]
        values, vectors = np.linalg.eigh(g)
        order = np.argsort(-values)
        d, vt = np.sqrt(np.maximum(values[order], 0)), vectors[:, order].T
    else:
        r = triangle(x, column)
        _, d, vt = np.linalg.svd(r, full_matrices=False) if r.size else (None, np.zeros(0), np.zeros((0, 0)))
    d, vt = d[:modes], _signed(vt[:modes])
    u = apply(x, column, vt.T / np.where(d > 0, d, 1), "modes").drop(column)
    return Decomposition(d, vt, unscaled(u, "modes", mass) if mass else u)


class Streaming:
    """POD of snapshots that come in batches of columns, kept to k modes; the state on the driver is k by snapshots.

    update() takes a table of the points' keys and an array of the batch's snapshots. Left vectors stay a DataFrame.
    """

    def __init__(self, keys: Sequence[str], k: int, keep: Callable[[DataFrame], DataFrame] = lambda df: df):
        self.keys, self.k, self.keep = list(keys), k, keep
        self.d, self.vt, self.u = np.zeros(0), np.zeros((0, 0)), None

    def update(self, batch: DataFrame, column: str) -> None:
        """SVD of [U D, X] through its triangle: V grows by the batch's snapshots, U and D are cut to k."""
        x = batch.select(*self.keys, F.col(column).alias("_x"))
        if self.u is not None:
            old = [F.transform("u", lambda a, i: a * F.element_at(F.lit(self.d.tolist()), i + 1)).alias("_o"), *self.keys]
            x = x.join(self.u.select(*old), self.keys).withColumn("_x", F.concat("_o", "_x")).drop("_o")
        x = self.keep(x)
        r = triangle(x, "_x")
        _, d, vt = np.linalg.svd(r, full_matrices=False)
        d, vt = d[: self.k], _signed(vt[: self.k])
        self.u = self.keep(apply(x, "_x", vt.T / np.where(d > 0, d, 1), "u").drop("_x"))
        held = len(self.d)
        self.vt = np.hstack((vt[:, :held] @ self.vt, vt[:, held:])) if held else vt
        self.d = d


def orthogonal_share(df: DataFrame, modes: str, snapshot: str) -> float:
    """The part of a snapshot's length that lies outside the modes; both are columns of a table by point."""
    k = df.select(F.size(modes)).first()
    n = k[0] if k else 0
    row = df.agg(F.sum(F.col(snapshot) * F.col(snapshot)).alias("s"), *(F.sum(F.col(modes)[i] * F.col(snapshot)).alias(f"a{i}") for i in range(n))).first()
    total = row["s"] or 0.0
    inside = sum((row[f"a{i}"] or 0.0) ** 2 for i in range(n))
    return float(np.sqrt(max(total - inside, 0) / total)) if total else 0.0


def reconstruct(dec: Decomposition, modes: Sequence[int], snapshots: Sequence[int], out: str = "value") -> DataFrame:
    """Append the sum of chosen modes for chosen snapshots, an array."""
    m = np.zeros((len(dec.d), len(snapshots)))
    for k in modes:
        m[k] = dec.d[k] * dec.vt[k, list(snapshots)]
    return apply(dec.modes, "modes", m, out)


def extended(df: DataFrame, column: str, dec: Decomposition, out: str = "modes") -> DataFrame:
    """Extended modes: other fields of the same snapshots on the right vectors, divided by the singular values."""
    return apply(df, column, dec.vt.T / np.where(dec.d > 0, dec.d, 1), out)


def fourier(pencils: DataFrame, column: str) -> DataFrame:
    """Replace pencils (arrays along a homogeneous direction) by rows (kappa, re, im), kappa from 0 to half their length.

    Coefficients are divided by the root of the length; all but the mean (and the Nyquist one of an even length) stand
    for two wavenumbers and are multiplied by the root of 2, so that sums of squares are kept.
    """
    others = [c for c in pencils.columns if c != column]

    def f(x: np.ndarray) -> list[np.ndarray]:
        n = x.shape[1]
        c = np.fft.rfft(x, axis=1) / np.sqrt(n)
        double = np.full(c.shape[1], np.sqrt(2))
        double[0] = 1
        if n % 2 == 0:
            double[-1] = 1
        return [c.real * double, c.imag * double]

    wide = kernel(pencils, [column], ["_re", "_im"], f)
    return wide.select(*others, F.posexplode(F.arrays_zip(F.col("_re").alias("re"), F.col("_im").alias("im"))).alias("kappa", "_c")).select(*others, "kappa", F.col("_c.re").alias("re"), F.col("_c.im").alias("im"))


def inverse_fourier(coefficients: DataFrame, by: Sequence[str], n: int, out: str) -> DataFrame:
    """The inverse of fourier(): rows (by, kappa, re, im) to arrays of length n."""
    rows = F.sort_array(F.collect_list(F.struct(F.col("kappa").cast("int").alias("kappa"), "re", "im")))
    packed = coefficients.groupBy(*by).agg(rows.alias("_r"))
    size = n // 2 + 1
    full = lambda part: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.aggregate("_r", F.lit(0.0), lambda a, r: a + F.when(r["kappa"] == k, r[part]).otherwise(0.0)))
    packed = packed.select(*by, full("re").alias("_re"), full("im").alias("_im"))

    def f(re: np.ndarray, im: np.ndarray) -> list[np.ndarray]:
        double = np.full(size, np.sqrt(2))
        double[0] = 1
        if n % 2 == 0:
            double[-1] = 1
        return [np.fft.irfft((re + 1j * im) / double * np.sqrt(n), n, axis=1)]

    return kernel(packed, ["_re", "_im"], [out], f).drop("_re", "_im")


def fourier_pod(coefficients: DataFrame, modes: int) -> DataFrame:
    """POD for each wavenumber of rows (kappa, point, snapshot, re, im): rows (kappa, mode, d, snapshot, re, im) of right vectors.

    The complex Gram matrix of each wavenumber is summed over points by aggregation (snapshots squared for each); only
    those small matrices meet in a task.
    """
    a = coefficients.select("kappa", "point", F.col("snapshot").alias("i"), F.col("re").alias("ar"), F.col("im").alias("ai"))
    b = coefficients.select("kappa", "point", F.col("snapshot").alias("j"), F.col("re").alias("br"), F.col("im").alias("bi"))
    both = a.join(b, ["kappa", "point"])
    g = both.groupBy("kappa", "i", "j").agg(F.sum(F.col("ar") * F.col("br") + F.col("ai") * F.col("bi")).alias("re"), F.sum(F.col("ar") * F.col("bi") - F.col("ai") * F.col("br")).alias("im"))

    def solve(pdf):
        import pandas as pd

        names = sorted(pdf["i"].unique())
        at = {s: k for k, s in enumerate(names)}
        m = np.zeros((len(names), len(names)), complex)
        m[pdf["i"].map(at), pdf["j"].map(at)] = pdf["re"] + 1j * pdf["im"]
        values, vectors = np.linalg.eigh(m)
        rows = []
        for mode, k in enumerate(np.argsort(-values)[:modes]):
            v = vectors[:, k]
            lead = v[np.abs(v).argmax()]
            v = v * (np.conj(lead) / abs(lead))
            rows += [(int(pdf["kappa"].iloc[0]), mode, float(np.sqrt(max(values[k], 0))), int(s), float(v[at[s]].real), float(v[at[s]].imag)) for s in names]
        return pd.DataFrame(rows, columns=["kappa", "mode", "d", "snapshot", "re", "im"])

    return g.groupBy("kappa").applyInPandas(solve, "kappa int, mode int, d double, snapshot long, re double, im double")


def fourier_modes(coefficients: DataFrame, right: DataFrame) -> DataFrame:
    """Left modes (kappa, point, mode, re, im): coefficients on the right vectors, divided by the singular values."""
    joined = coefficients.join(right.select("kappa", "mode", "d", "snapshot", F.col("re").alias("vr"), F.col("im").alias("vi")), ["kappa", "snapshot"])
    d = F.when(F.max("d") > 0, F.max("d")).otherwise(1.0)
    return joined.groupBy("kappa", "point", "mode").agg((F.sum(F.col("re") * F.col("vr") - F.col("im") * F.col("vi")) / d).alias("re"), (F.sum(F.col("re") * F.col("vi") + F.col("im") * F.col("vr")) / d).alias("im"))


def save(dec: Decomposition, path: str) -> None:
    """Write a decomposition's modes, singular values and right vectors as Parquet."""
    spark = dec.modes.sparkSession
    dec.modes.write.mode("overwrite").parquet(f"{path}/modes")
    rows = [(k, float(d), v.tolist()) for k, (d, v) in enumerate(zip(dec.d, dec.vt, strict=True))]
    spark.createDataFrame(rows, StructType([*StructType.fromDDL("mode int, d double").fields, StructField("vt", ArrayType(DoubleType()))])).coalesce(1).write.mode("overwrite").parquet(f"{path}/values")


def load(spark, path: str) -> Decomposition:
    rows = spark.read.parquet(f"{path}/values").orderBy("mode").collect()
    return Decomposition(np.array([r["d"] for r in rows]), np.array([r["vt"] for r in rows]), spark.read.parquet(f"{path}/modes"))


def filter_modes(column: Column, k: int) -> Column:
    """The first k of an array of modes."""
    return F.slice(column, 1, k)
