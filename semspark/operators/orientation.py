"""Orientation of elements: which global axis each reference axis follows, and nodes reordered accordingly."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semspark.operators.compression import _packed
from semspark.operators.elements import arrays, matrix

XYZ = "xyz"


def directions(xyz: np.ndarray) -> np.ndarray:
    """(rows, 3, 3): for r, s and t the unit vector from the first face to the last; xyz is (rows, 3, t, s, r)."""
    out = []
    for axis in (4, 3, 2):
        d = (np.take(xyz, -1, axis) - np.take(xyz, 0, axis)).mean((2, 3))
        out.append(d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-300))
    return np.stack(out, 1)


def normals(xyz: np.ndarray) -> np.ndarray:
    """(rows, 6, 3): unit normals of the faces r-, r+, s-, s+, t-, t+ from the diagonals of each."""
    out = []
    for axis in (4, 3, 2):
        for side in (0, -1):
            f = np.take(xyz, side, axis)
            n = np.cross(f[:, :, -1, -1] - f[:, :, 0, 0], f[:, :, -1, 0] - f[:, :, 0, -1])
            out.append(n / np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-300))
    return np.stack(out, 1)


def assign(size: np.ndarray) -> np.ndarray:
    """(rows, 3): the global axis of each reference axis, by repeatedly taking the largest entry left of each 3 x 3 matrix."""
    left, out = np.abs(size).astype(float), np.zeros(size.shape[:2], np.int64)
    rows = np.arange(len(size))
    for _ in range(3):
        flat = left.reshape(len(size), -1).argmax(1)
        a, g = flat // 3, flat % 3
        out[rows, a] = g
        left[rows, a, :] = -1
        left[rows, :, g] = -1
    return out


def reorder(xyz: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Fields (rows, f, t, s, r) with axes so that r, s, t follow x, y, z and rise along them."""
    d = directions(xyz)
    axes = assign(d)
    out = np.empty_like(data)
    for e in range(len(data)):  # a permutation and flips for each element
        order = [int(np.flatnonzero(axes[e] == g)[0]) for g in range(3)]
        u = data[e].transpose(0, *(3 - order[g] for g in (2, 1, 0)))
        for g in range(3):
            if d[e, order[g], g] < 0:
                u = np.flip(u, 3 - g)
        out[e] = u
    return out


def _cubes(columns: Sequence[pa.Array]) -> np.ndarray:
    each = [matrix(c) for c in columns]
    n = round(each[0].shape[1] ** (1 / 3))
    return np.stack([u.reshape(-1, n, n, n) for u in each], 1)


def aligned(mesh: DataFrame, fields: Sequence[str] = ()) -> DataFrame:
    """The mesh (x, y, z) and fields with nodes reordered, so that i, j, k rise with x, y, z in every element."""
    names = [*XYZ, *fields]

    def f(*columns: pa.Array) -> list[pa.Array]:
        data = _cubes(columns)
        out = reorder(data[:, :3], data)
        return [arrays(out[:, i].reshape(len(out), -1)) for i in range(len(names))]

    return _packed(mesh, names, dict.fromkeys(names, "array<double>"), f)


def mappings(mesh: DataFrame) -> DataFrame:
    """Append mapping, the global axis of r, s and t, from the faces' differences and by_normals, from their normals."""

    def f(*columns: pa.Array) -> list[pa.Array]:
        xyz = _cubes(columns)
        by_faces, by_normals = assign(directions(xyz)), assign(normals(xyz).reshape(-1, 3, 2, 3).__abs__().mean(2))
        return [pa.array([[XYZ[g] for g in row] for row in m.tolist()], pa.list_(pa.string())) for m in (by_faces, by_normals)]

    return _packed(mesh, list(XYZ), {"mapping": "array<string>", "by_normals": "array<string>"}, f)


def agreement(df: DataFrame, a: str = "mapping", b: str = "by_normals") -> DataFrame:
    """One row: the share of elements for which two methods agree."""
    return df.agg(F.avg((F.col(a) == F.col(b)).cast("double")).alias("share"))
