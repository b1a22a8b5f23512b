"""Calculus on the mesh: derivatives, geometry, transforms, filters and changes of order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semspark.functions import basis
from semspark.operators.elements import boxed, kernel

AXES = "rst"


def _flat(x: np.ndarray) -> np.ndarray:
    return x.reshape(len(x), -1)


def reference_derivative(df: DataFrame, field: str, axis: str, out: str | None = None, dims: int = 3) -> DataFrame:
    """Derivative of a field along r, s or t within the reference element."""

    def f(u: np.ndarray) -> list[np.ndarray]:
        u = boxed(u, dims)
        return [_flat(basis.along(u, **{axis: basis.derivative(basis.gll(u.shape[-1])[0])}))]

    return kernel(df, [field], [out or f"d{field}d{axis}"], f)


def _metric(xyz: Sequence[np.ndarray], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """J with J[..., a, b] = d x_a / d r_b, and its determinant."""
    x = [boxed(c, dims) for c in xyz[:dims]]
    d = basis.derivative(basis.gll(x[0].shape[-1])[0])
    j = np.stack([np.stack([basis.along(c, **{AXES[b]: d}) for b in range(dims)], -1) for c in x], -2)
    return j, np.linalg.det(j)


INVERSE = [f"d{r}d{x}" for r in AXES for x in "xyz"]


def geometry(mesh: DataFrame, dims: int = 3) -> DataFrame:
    """Append jac, b (the mass matrix) and d(rst)/d(xyz) to a mesh with columns x, y, z (z unused in two dimensions)."""
    names = [f"d{AXES[a]}d{'xyz'[b]}" for a in range(dims) for b in range(dims)]

    def f(*xyz: np.ndarray) -> list[np.ndarray]:
        j, jac = _metric(xyz, dims)
        inverse = np.linalg.inv(j)
        w = basis.gll(jac.shape[-1])[1]
        w3 = w[None, :, None] * w if dims == 2 else w[:, None, None] * w[None, :, None] * w
        return [_flat(jac), _flat(jac * w3), *(_flat(inverse[..., a, b]) for a in range(dims) for b in range(dims))]

    return kernel(mesh, list("xyz"[:dims]), ["jac", "b", *names], f)


def dudxyz(df: DataFrame, field: str, direction: str, out: str | None = None, dims: int = 3) -> DataFrame:
    """Physical derivative along x, y or z; df holds the field beside the geometry's columns."""
    names = [f"d{AXES[a]}d{direction}" for a in range(dims)]

    def f(u: np.ndarray, *metric: np.ndarray) -> list[np.ndarray]:
        u = boxed(u, dims)
        d = basis.derivative(basis.gll(u.shape[-1])[0])
        return [sum(_flat(basis.along(u, **{AXES[a]: d})) * m for a, m in enumerate(metric))]

    return kernel(df, [field, *names], [out or f"d{field}d{direction}"], f)


def gradient(df: DataFrame, fields: Sequence[str], dims: int = 3) -> DataFrame:
    """Append d<field>d<x> for each field and direction, all in one pass."""
    axes = "xyz"[:dims]
    names = [f"d{AXES[a]}d{x}" for a in range(dims) for x in axes]

    def f(*given: np.ndarray) -> list[np.ndarray]:
        metric = dict(zip(names, given[len(fields) :], strict=True))
        out = []
        for u in given[: len(fields)]:
            u = boxed(u, dims)
            d = basis.derivative(basis.gll(u.shape[-1])[0])
            parts = [_flat(basis.along(u, **{AXES[a]: d})) for a in range(dims)]
            out += [sum(p * metric[f"d{AXES[a]}d{x}"] for a, p in enumerate(parts)) for x in axes]
        return out

    return kernel(df, [*fields, *names], [f"d{u}d{x}" for u in fields for x in axes], f)


def second_derivatives(df: DataFrame, field: str, dims: int = 3) -> DataFrame:
    """Append d2<field>d<x>2, the diagonal of the second derivatives."""
    out = df
    for x in "xyz"[:dims]:
        out = dudxyz(dudxyz(out, field, x, "_first", dims), "_first", x, f"d2{field}d{x}2", dims).drop("_first")
    return out


def _pairwise(df: DataFrame, fields: Sequence[str], prefix: str, sign: int) -> DataFrame:
    axes = "xyz"[: len(fields)]
    half = lambda a, b: F.zip_with(a, b, lambda p, q: (p + sign * q) / 2)
    return df.withColumns({f"{prefix}{i + 1}{j + 1}": half(F.col(f"d{fields[i]}d{axes[j]}"), F.col(f"d{fields[j]}d{axes[i]}")) for i in range(len(fields)) for j in range(len(fields))})


def strain(df: DataFrame, fields: Sequence[str] = ("u", "v", "w"), prefix: str = "s") -> DataFrame:
    """Half the gradient and its transpose; df holds gradient()'s columns."""
    return _pairwise(df, fields, prefix, 1)


def rotation(df: DataFrame, fields: Sequence[str] = ("u", "v", "w"), prefix: str = "o") -> DataFrame:
    """Half the gradient less its transpose."""
    return _pairwise(df, fields, prefix, -1)


def tensor_product(df: DataFrame, field: str, out: str, matrix_of: Callable[[int], np.ndarray], dims: int = 3) -> DataFrame:
    """Apply a one-dimensional matrix along each axis in turn: n**4 operations for an element, not n**6."""

    def f(u: np.ndarray) -> list[np.ndarray]:
        u = boxed(u, dims)
        m = matrix_of(u.shape[-1])
        return [_flat(basis.along(u, m, m, m if dims == 3 else None))]

    return kernel(df, [field], [out], f)


def to_modal(df: DataFrame, field: str, out: str, dims: int = 3) -> DataFrame:
    return tensor_product(df, field, out, basis.to_modal, dims)


def to_nodal(df: DataFrame, field: str, out: str, dims: int = 3) -> DataFrame:
    return tensor_product(df, field, out, basis.to_nodal, dims)


def spatial_filter(df: DataFrame, field: str, transfer: Sequence[float], out: str | None = None, dims: int = 3) -> DataFrame:
    m = basis.spatial_filter(np.array(transfer, float))
    return tensor_product(df, field, out or field, lambda n: m, dims)


def p_refine(df: DataFrame, fields: Sequence[str], order: int, equidistant: bool = False, dims: int = 3) -> DataFrame:
    """Interpolate fields to elements with order GLL (or equidistant) points along each edge."""
    for field in fields:
        df = tensor_product(df, field, field, lambda n: basis.refine(n, order, equidistant), dims)
    return df


def extrude(df: DataFrame, fields: Sequence[str], z: Sequence[float]) -> DataFrame:
    """Two-dimensional elements repeated along z: one row for each layer of GLL planes between successive z.

    z are the layer bounds; fields repeat on each plane and a z column holds the planes' heights.
    """
    bounds = F.array(*(F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in zip(z, z[1:], strict=False)))
    size = F.size(F.col(fields[0]))
    layered = df.select("*", F.posexplode(bounds).alias("layer", "_z"), size.alias("_n2"), F.round(F.sqrt(size)).cast("int").alias("_n"))
    nodes = F.lit(None).cast("array<double>")
    for n in range(2, 17):
        nodes = F.when(F.col("_n") == n, F.array(*(F.lit(float(x)) for x in basis.gll(n)[0]))).otherwise(nodes)
    heights = F.transform(nodes, lambda x: F.col("_z.a") + (x + 1) / 2 * (F.col("_z.b") - F.col("_z.a")))
    tiled = {c: F.flatten(F.array_repeat(F.col(c), F.col("_n"))) for c in fields}
    return layered.withColumns(tiled | {"z": F.flatten(F.transform(heights, lambda h: F.array_repeat(h, F.col("_n2"))))}).drop("_z", "_n", "_n2")


def facet_geometry(mesh: DataFrame) -> DataFrame:
    """A row for each facet (r-, r+, s-, s+, t-, t+): area weights and outward unit normals nx, ny, nz at its nodes."""
    facets = [a + s for a in AXES for s in "-+"]
    names = [f"{q}_{i}" for i in range(6) for q in ("area", "nx", "ny", "nz")]

    def f(*xyz: np.ndarray) -> list[np.ndarray]:
        j, _ = _metric(xyz, 3)
        w = basis.gll(j.shape[1])[1]
        weights = (w[:, None] * w).ravel()
        out = []
        for a in range(3):
            b, c = [x for x in range(3) if x != a]
            for side in (0, -1):
                part = np.take(j, side, axis=3 - a).reshape(len(j), -1, 3, 3)
                n = np.cross(part[..., b], part[..., c])
                size = np.linalg.norm(n, axis=-1)
                sign = (1 if a != 1 else -1) * (1 if side else -1)
                n = sign * n / size[..., None]
                out += [size * weights, n[..., 0], n[..., 1], n[..., 2]]
        return out

    wide = kernel(mesh, ["x", "y", "z"], names, f)
    kept = [c for c in mesh.columns if c not in ("x", "y", "z")]
    rows = F.array(*(F.struct(F.lit(facets[i]).alias("facet"), *(F.col(f"{q}_{i}").alias(q) for q in ("area", "nx", "ny", "nz"))) for i in range(6)))
    return wide.select(*kept, F.inline(rows))


def profile_derivative(df: DataFrame, value: str, coordinate: str, out: str) -> DataFrame:
    """Derivative of a profile on one-dimensional elements (arrays of GLL nodes)."""

    def f(u: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        d = basis.derivative(basis.gll(u.shape[1])[0])
        return [(u @ d.T) / (y @ d.T)]

    return kernel(df, [value, coordinate], [out], f)


def dissipation(strain_columns: Sequence[Column], viscosity: float) -> Column:
    """2 nu s_ij s_ij at a point from the six components 11, 22, 33, 12, 13, 23."""
    d, o = strain_columns[:3], strain_columns[3:]
    return 2 * viscosity * (sum(c * c for c in d) + 2 * sum(c * c for c in o))


def kolmogorov(mean_dissipation: Column, viscosity: float) -> Column:
    """The length (nu^3 / eps)^(1/4)."""
    return F.pow(F.lit(viscosity**3) / mean_dissipation, 0.25)


def nusselt(kinetic: Column, thermal: Column, viscosity: float, diffusivity: float, rayleigh: float, prandtl: float) -> tuple[Column, Column]:
    """Nusselt numbers from mean kinetic and thermal dissipation."""
    return 1 + kinetic / (viscosity**3 * rayleigh / prandtl**2), thermal / diffusivity
