"""Statistics of snapshots as fields: products, their derivatives on the mesh, and the way to budgets at points."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semspark.functions import basis
from semspark.operators import calculus, elements, tensors
from semspark.operators.elements import boxed, kernel

#: Where a two-dimensional statistics file of the older solver holds each scalar of the newer layout
#: (s0 to s38); velocity is s0 to s2 there, pressure s3 and the squared pressure s7.
FROM_2D = [4, 5, 6, 8, 10, 9, 23, 24, 25, 26, 27, 28, 34, 29, 30, 31, 35, 36, 37, 32, 33, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 38, 39, 40, 41, 42, 43]


def from_2d(df: DataFrame) -> DataFrame:
    """The scalars of a two-dimensional file under the names of the three-dimensional layout; s39 is the third velocity."""
    kept = [c for c in df.columns if not (c[0] == "s" and c[1:].isdigit()) and c not in "uvpt"]
    first = {"u": "s0", "v": "s1", "p": "s3", "t": "s7"}
    return df.select(*kept, *(F.col(s).alias(n) for n, s in first.items()), *(F.col(f"s{s}").alias(f"s{i}") for i, s in enumerate(FROM_2D)), F.col("s2").alias("s39"))


def augmented_fields(df: DataFrame, n: int) -> DataFrame:
    """(elem_id, k, j, i and the 44 statistics) of a snapshot: u, v, w, p beside the geometry's columns."""
    g = calculus.gradient(df, ["u", "v", "w"])
    names = ["u", "v", "w", "p", *(f"d{f}d{x}" for f in "uvw" for x in "xyz")]
    nodes = elements.points(g.select("elem_id", *names), names, n)
    grad = [[F.col(f"d{f}d{x}") for x in "xyz"] for f in "uvw"]
    stats = tensors.augmented([F.col(c) for c in "uvw"], F.col("p"), grad)
    return nodes.select("elem_id", "k", "j", "i", *(c.alias(name) for name, c in stats.items()))


def symbol(name: str) -> str:
    """The name of a statistic by indices: uuv is u1u1u2, pv is pu2, pdudy is pd2_u1."""
    at = {"u": "u1", "v": "u2", "w": "u3"}
    if name[0] == "e" or set(name) == {"p"}:
        return name
    if name.startswith("pd"):
        return f"pd{'xyz'.index(name[4]) + 1}_{at[name[2]]}"
    return "".join(at.get(c, c) for c in name)


def derivatives(df: DataFrame, first: Sequence[str], second: Sequence[str]) -> DataFrame:
    """Append d<k>_<f> for the fields of first, and dd<k>_<f>, the diagonal second derivatives, for those of second."""
    metric = [f"d{a}d{x}" for a in "rst" for x in "xyz"]

    def f(*given: np.ndarray) -> list[np.ndarray]:
        m = dict(zip(metric, given[len(first) :], strict=True))
        d = basis.derivative(basis.gll(boxed(given[0]).shape[-1])[0])

        def along(u: np.ndarray) -> list[np.ndarray]:
            parts = [basis.along(boxed(u), **{a: d}).reshape(len(u), -1) for a in "rst"]
            return [sum(p * m[f"d{a}d{x}"] for a, p in zip("rst", parts, strict=True)) for x in "xyz"]

        one = {c: along(u) for c, u in zip(first, given, strict=False)}
        two = {c: [along(one[c][k])[k] for k in range(3)] for c in second}
        return [u for c in first for u in one[c]] + [u for c in second for u in two[c]]

    return kernel(df, [*first, *metric], [f"d{k}_{c}" for c in first for k in (1, 2, 3)] + [f"dd{k}_{c}" for c in second for k in (1, 2, 3)], f)


def budget_fields(df: DataFrame, n: int) -> DataFrame:
    """What budgets() takes, at the nodes of elements: averages named as tensors.STAT_FIELDS beside the geometry's columns."""
    named = df.withColumnsRenamed({c: symbol(c) for c in tensors.STAT_FIELDS})
    velocity = ["u1", "u2", "u3"]
    second = [tensors._name(*ij) for ij in tensors.SIX]
    third = [tensors._name(*ijk) for ijk in combinations_with_replacement((1, 2, 3), 3)]
    first = [*velocity, *second, *third, "p", "pu1", "pu2", "pu3"]
    full = derivatives(named, first, [*velocity, *second])
    names = [*(symbol(c) for c in tensors.STAT_FIELDS), *(f"d{k}_{c}" for c in first for k in (1, 2, 3)), *(f"dd{k}_{c}" for c in [*velocity, *second] for k in (1, 2, 3))]
    return elements.points(full.select("elem_id", *names), names, n)


def pivot(rows: DataFrame, names: dict[int, str], by: Sequence[str], average: Callable[[Column], Column] = F.avg, field: str = "field_id", value: str = "value") -> DataFrame:
    """Interpolated statistics in rows (by, field_id, value) as a column for each name, averaged over all else."""
    chosen = lambda k: F.when(F.col(field) == k, F.col(value))
    return rows.groupBy(*by).agg(*(average(chosen(k)).alias(name) for k, name in names.items()))


def spacing(mesh: DataFrame) -> DataFrame:
    """Append dx, dy, dz: the distance that a node stands for along each axis, from its share of the reference element."""

    def f(*xyz: np.ndarray) -> list[np.ndarray]:
        cubes = [boxed(c) for c in xyz]
        x, _ = basis.gll(cubes[0].shape[-1])
        d = basis.derivative(x)
        half = np.concatenate(([x[1] - x[0]], x[2:] - x[:-2], [x[-1] - x[-2]])) / 2
        share = {"r": half, "s": half[:, None], "t": half[:, None, None]}
        return [np.sqrt(sum((basis.along(c, **{a: d}) * s) ** 2 for a, s in share.items())).reshape(len(c), -1) for c in cubes]

    return kernel(mesh, ["x", "y", "z"], ["dx", "dy", "dz"], f)


def mesh_check(nodes: DataFrame, viscosity: float, by: str = "elem_id") -> DataFrame:
    """(elem_id, eta, dx, dy, dz): spacings in Kolmogorov lengths, averaged over each element.

    nodes are rows (elem_id, dx, dy, dz, b, eps), eps the mean dissipation. The maxima over elements tell the resolution.
    """
    mass = F.sum("b")
    mean = {c: F.sum(F.col(c) * F.col("b")) / mass for c in ("eps", "dx", "dy", "dz")}
    out = nodes.groupBy(by).agg(*(m.alias(c) for c, m in mean.items())).withColumn("eta", calculus.kolmogorov(F.col("eps"), viscosity))
    return out.select(by, "eta", *((F.col(c) / F.col("eta")).alias(c) for c in ("dx", "dy", "dz")))
