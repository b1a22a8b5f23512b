"""Compression of element fields: truncated Legendre spectra, bit planes, and Gaussian-process sampling."""

from __future__ import annotations

import bz2
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from semspark.functions import basis
from semspark.operators import calculus
from semspark.operators.elements import arrays, boxed, kernel, matrix

NOISE = 1e-10
#: Elements that are multiplied at once, always so many, and doubles that the covariances of a slice of elements take at most.
ROWS, DOUBLES = 128, 1 << 19


def keep_largest(df: DataFrame, field: str, keep: int, out: str) -> DataFrame:
    """Zero all but the ``keep`` values of largest magnitude in each element's array, ties to the smaller node.

    Within the JVM, in the row: no shuffle, whatever the number of elements.
    """
    rank = lambda x, i: F.struct((-F.abs(x)).alias("m"), i.alias("i"))
    ranked = F.array_sort(F.transform(F.col(field).cast("array<double>"), rank))
    last = F.get(ranked, F.lit(keep - 1))  # null if there are no more than these
    # bound as a lambda's variable, or the optimizer would rank the array anew for each of its values
    under = lambda t: F.transform(F.col(field).cast("array<double>"), lambda x, i: F.when(F.lit(keep > 0) & F.coalesce(rank(x, i) <= t, F.lit(True)), x).otherwise(0.0))
    return df.withColumn(out, F.transform(F.array(last), under)[0])


def truncate(df: DataFrame, field: str, bitrate: float, out: str | None = None, dims: int = 3) -> DataFrame:
    """Spectral coefficients of a field, only int(nodes * bitrate) of largest magnitude other than 0."""

    def f(u: np.ndarray) -> list[np.ndarray]:
        n = round(u.shape[1] ** (1 / dims))
        m = basis.to_modal(n)
        c = basis.along(boxed(u, dims), m, m, m if dims == 3 else None).reshape(len(u), -1)
        keep = int(c.shape[1] * bitrate)
        order = np.argsort(-np.abs(c), axis=1, kind="stable")
        cleared = c.copy()
        np.put_along_axis(cleared, order[:, keep:], 0.0, 1)
        return [cleared]

    return kernel(df, [field], [out or field], f)


def restore(df: DataFrame, field: str, out: str | None = None, dims: int = 3) -> DataFrame:
    """The field again from its coefficients."""

    def f(c: np.ndarray) -> list[np.ndarray]:
        m = basis.to_nodal(round(c.shape[1] ** (1 / dims)))
        return [basis.along(boxed(c, dims), m, m, m if dims == 3 else None).reshape(len(c), -1)]

    return kernel(df, [field], [out or field], f)


def planes(values: np.ndarray, bits: int) -> np.ndarray:
    """Doubles with all but their ``bits`` leading bits cleared."""
    mask = np.uint64(0xFFFFFFFFFFFFFFFF) << np.uint64(64 - bits)
    return (np.ascontiguousarray(values, np.float64).view(np.uint64) & mask).view(np.float64)


def bit_planes(df: DataFrame, field: str, bits: int, out: str | None = None) -> DataFrame:
    return kernel(df, [field], [out or field], lambda u: [planes(u, bits).reshape(u.shape)])


def _packed(df: DataFrame, inputs: Sequence[str], outputs: dict[str, str], f) -> DataFrame:
    """Append columns made by f from a batch, row for row."""
    schema = StructType([*(x for x in df.schema.fields if x.name not in outputs), *StructType.fromDDL(", ".join(f"{k} {v}" for k, v in outputs.items())).fields])
    kept = [c for c in df.columns if c not in outputs]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 1024):
                batch = big.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *f(*(batch.column(c) for c in inputs))], names=[*kept, *outputs])

    return df.mapInArrow(work, schema)


def pack(df: DataFrame, field: str, out: str | None = None) -> DataFrame:
    """A double array as losslessly compressed bytes."""
    return _packed(df, [field], {out or field: "binary"}, lambda c: [pa.array([None if x is None else bz2.compress(np.array(x, "<f8").tobytes(), 9) for x in c.to_pylist()], pa.binary())])


def unpack(df: DataFrame, field: str, out: str | None = None) -> DataFrame:
    return _packed(df, [field], {out or field: "array<double>"}, lambda c: [pa.array([None if x is None else np.frombuffer(bz2.decompress(x), "<f8").tolist() for x in c.to_pylist()], pa.list_(pa.float64()))])


def regression(covariance: np.ndarray, known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of a Gaussian process at all nodes (rows, nodes), given some nodes (rows, k) and their values."""
    rows = np.arange(len(known))[:, None]
    k11 = covariance[rows[:, :, None], known[:, :, None], known[:, None, :]] + NOISE * np.eye(known.shape[1])
    k21 = covariance[rows, :, known].transpose(0, 2, 1) if known.ndim == 2 else covariance
    gain = np.linalg.solve(k11, k21.transpose(0, 2, 1)).transpose(0, 2, 1)
    mean = (gain @ values[..., None])[..., 0]
    var = np.einsum("eii->ei", covariance) - np.einsum("eik,eik->ei", gain, k21)
    return mean, np.sqrt(np.abs(var))


def covariance(coefficients: np.ndarray, groups: np.ndarray, method: str, keep: int, n: int, dims: int = 3) -> np.ndarray:
    """Nodal covariance (rows, nodes, nodes) from spectra (rows, modes).

    average: outer product of the mean spectrum of each element's group; dlt: of its own ``keep`` largest coefficients;
    bitplane: of its own coefficients with ``keep`` leading bits.
    """
    if method == "average":
        sums = np.zeros((groups.max() + 1, coefficients.shape[1]))
        np.add.at(sums, groups, coefficients)
        c = (sums / np.bincount(groups)[:, None])[groups]
    elif method == "dlt":
        c = coefficients.copy()
        np.put_along_axis(c, np.argsort(-np.abs(c), axis=1, kind="stable")[:, keep:], 0.0, 1)
    elif method == "bitplane":
        c = planes(coefficients, keep).reshape(coefficients.shape)
    else:
        raise ValueError(f"no covariance {method}")
    v = basis.to_nodal(n)
    full = np.kron(np.kron(v, v), v) if dims == 3 else np.kron(v, v)
    # modes of independent amplitude c: the diagonal model keeps the covariance of full rank
    nodes, c = len(full), c**2
    if nodes > 64:  # the products below would be too large
        return np.matmul(full * c[:, None, :], full.T)
    products = (full[:, None, :] * full[None]).reshape(nodes * nodes, -1).T
    out = np.empty((len(c), nodes * nodes))
    for at in range(0, len(c), ROWS):  # padded: the last digits, which ties hang on, mustn't depend on how many rows there are
        part = np.zeros((ROWS, c.shape[1]))
        part[: len(c) - at] = c[at : at + ROWS]
        out[at : at + ROWS] = (part @ products)[: len(c) - at]
    return out.reshape(-1, nodes, nodes)


def _slices(rows: int, nodes: int) -> list[slice]:
    """Slices of elements whose covariances fit into DOUBLES: ROWS at most, an element at least."""
    step = max(1, min(ROWS, DOUBLES // max(nodes, 1) ** 2))
    return [slice(at, at + step) for at in range(0, rows, step)]


def sample(values: np.ndarray, cov: np.ndarray, count: int) -> np.ndarray:
    """Greedy choice of nodes (rows, count): first node 0, then each time the node of largest deviation, ties to the smaller."""
    known = np.zeros((len(values), 1), np.int64)
    while known.shape[1] < count:
        _, std = regression(cov, known, np.take_along_axis(values, known, 1))
        np.put_along_axis(std, known, -1.0, 1)
        known = np.concatenate((known, std.argmax(1)[:, None]), 1)
    return known


def gp_compress(df: DataFrame, field: str, bitrate: float, method: str = "dlt", keep: int = 8, group: str | None = None, dims: int = 3) -> DataFrame:
    """Append nodes, samples and spectrum: int(nodes * bitrate) sampled nodes of each element and the covariance's model.

    With method average, all elements of one ``group`` value share a model, whose spectrum is stored.
    """
    if method == "average" and group:
        spectra = calculus.to_modal(df.select(F.col(group).alias("_group"), field), field, "_c").select("_group", F.posexplode("_c").alias("_at", "_c"))
        means = spectra.groupBy("_group", "_at").agg(F.avg("_c").alias("_c")).groupBy("_group")
        means = means.agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_c"))), lambda x: x["_c"]).alias("_mean"))
        df = df.join(means, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")
    names = {"nodes": "array<int>", "samples": "array<double>", "spectrum": "array<double>"}

    def f(column: pa.Array, *more: pa.Array) -> list[pa.Array]:
        u = matrix(column)
        n = round(u.shape[1] ** (1 / dims))
        m = basis.to_modal(n)
        c = basis.along(boxed(u, dims), m, m, m if dims == 3 else None).reshape(len(u), -1)
        if method == "average":
            spectrum = matrix(more[0]) if more else c
        elif method == "dlt":
            spectrum = c.copy()
            np.put_along_axis(spectrum, np.argsort(-np.abs(c), axis=1, kind="stable")[:, keep:], 0.0, 1)
        else:
            spectrum = planes(c, keep).reshape(c.shape)
        count = max(1, int(u.shape[1] * bitrate))
        cov = lambda c: covariance(c, np.arange(len(c)), "bitplane", 64, n, dims)
        known = np.concatenate([sample(u[part], cov(spectrum[part]), count) for part in _slices(*u.shape)])
        got = np.take_along_axis(u, known, 1)
        size = known.shape[1]
        nodes = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1, dtype=np.int32) * size), pa.array(known.astype(np.int32).ravel()))
        return [nodes, arrays(got), arrays(spectrum)]

    shared = ["_mean"] if method == "average" and group else []
    return _packed(df, [field, *shared], names, f).drop("_mean")


def gp_restore(df: DataFrame, out: str, dims: int = 3, std: str | None = None) -> DataFrame:
    """The field from nodes, samples and spectrum: samples exactly, the rest predicted; optionally the deviation."""
    names = {out: "array<double>"} | ({std: "array<double>"} if std else {})

    def f(nodes: pa.Array, samples: pa.Array, spectrum: pa.Array) -> list[pa.Array]:
        known, values, c = matrix(nodes).astype(np.int64), matrix(samples), matrix(spectrum)
        n = round(c.shape[1] ** (1 / dims))
        both = [regression(covariance(c[part], np.arange(len(c[part])), "bitplane", 64, n, dims), known[part], values[part]) for part in _slices(*c.shape)]
        mean, dev = (np.concatenate(x) for x in zip(*both, strict=True))
        np.put_along_axis(mean, known, values, 1)
        return [arrays(mean)] + ([arrays(dev)] if std else [])

    return _packed(df, ["nodes", "samples", "spectrum"], names, f)


def conjugate_gradient(a: np.ndarray, b: np.ndarray, steps: int = 100, tolerance: float = 1e-12) -> np.ndarray:
    """Solve symmetric positive systems (rows, n, n) for (rows, n), all rows at once."""
    x, r = np.zeros_like(b), b.copy()
    p, rr = r.copy(), (r * r).sum(1)
    for _ in range(steps):
        if rr.max(initial=0.0) < tolerance**2:
            break
        ap = np.einsum("eij,ej->ei", a, p)
        alpha = rr / np.maximum((p * ap).sum(1), 1e-300)
        x, r = x + alpha[:, None] * p, r - alpha[:, None] * ap
        new = (r * r).sum(1)
        p, rr = r + (new / np.maximum(rr, 1e-300))[:, None] * p, new
    return x


def error(df: DataFrame, field: str, other: str, mass: str) -> DataFrame:
    """One row: the mass-weighted root mean square of the difference, and that relative to the field's."""
    add = lambda a, x: a + x
    dot = lambda v: F.aggregate(F.zip_with(v, F.col(mass), lambda p, w: p * p * w), F.lit(0.0), add)
    d = F.zip_with(F.col(field), F.col(other), lambda p, q: p - q)
    total = F.sum(F.aggregate(F.col(mass), F.lit(0.0), add))
    return df.agg(F.sqrt(F.sum(dot(d)) / total).alias("rmse"), F.sqrt(F.sum(dot(d)) / F.sum(dot(F.col(field).cast("array<double>")))).alias("relative"))
