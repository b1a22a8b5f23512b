"""Point location and interpolation: a join on spatial bins, boxes, a batched Newton search, and the best match."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from semspark.functions import basis
from semspark.operators.elements import matrix

XYZ = ("x", "y", "z")
#: Codes of a location: inside an element, best guess only, not found.
FOUND, GUESS, MISSING = 1, -10, 0


def bins(columns: Sequence[Column], lows: Sequence[float], sizes: Sequence[float], counts: Sequence[int]) -> Column:
    """The number of the grid cell that holds a point, points beyond the grid in the outermost cells."""
    out = F.lit(0).cast("long")
    for c, lo, size, n in reversed(list(zip(columns, lows, sizes, counts, strict=True))):
        place = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((c - lo) / size)))
        out = out * n + place.cast("long")
    return out


def boxes(mesh: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(elem_id, x_min .. z_max): bounding boxes widened by the tolerance times half a side."""
    cols = []
    for c in XYZ:
        lo, hi = F.array_min(c), F.array_max(c)
        pad = (hi - lo) * tolerance / 2
        cols += [(lo - pad).alias(f"{c}_min"), (hi + pad).alias(f"{c}_max")]
    return mesh.select("elem_id", *cols)


def candidates(probes: DataFrame, boxes: DataFrame, cell: Sequence[float], axes: Sequence[str] = XYZ) -> DataFrame:
    """Pairs of probes and boxes that hold them: both sides go to grid cells of a given size, boxes to all they cover.

    The cell should be about a box's size, so that a box covers few cells; the join is then an equi-join by cell.
    """
    at = lambda c, size: F.floor(c / size).cast("long")
    p = probes.withColumns({f"_c{i}": at(F.col(a), s) for i, (a, s) in enumerate(zip(axes, cell, strict=True))})
    b = boxes
    for i, (a, s) in enumerate(zip(axes, cell, strict=True)):
        b = b.withColumn(f"_c{i}", F.explode(F.sequence(at(F.col(f"{a}_min"), s), at(F.col(f"{a}_max"), s))))
    inside = F.lit(True)
    for a in axes:
        inside = inside & (F.col(a) >= F.col(f"{a}_min")) & (F.col(a) <= F.col(f"{a}_max"))
    return p.join(b, [f"_c{i}" for i in range(len(axes))]).where(inside).drop(*(f"_c{i}" for i in range(len(axes))))


def oriented(xyz: np.ndarray, p: np.ndarray, slack: float = 0.05) -> np.ndarray:
    """Which points lie in their element's box along its own axes. xyz is (rows, 3, t, s, r), p (rows, 3)."""
    x, _ = basis.gll(xyz.shape[-1])
    d, mid = basis.derivative(x), basis.lagrange(x, 0.0)[0]
    at = lambda u, *w: np.einsum("ectsr,t,s,r->ec", u, *w)
    centre = at(xyz, mid, mid, mid)
    jac = np.stack([at(xyz, mid, mid, mid @ d), at(xyz, mid, mid @ d, mid), at(xyz, mid @ d, mid, mid)], -1)
    inverse = np.linalg.pinv(jac)
    nodes = np.einsum("eab,ebn->ean", inverse, xyz.reshape(len(xyz), 3, -1) - centre[:, :, None])
    lo, hi = nodes.min(2), nodes.max(2)
    pad = (hi - lo) * slack / 2
    q = np.einsum("eab,eb->ea", inverse, p - centre)
    return ((q >= lo - pad - 1e-6) & (q <= hi + pad + 1e-6)).all(1)


def newton(xyz: np.ndarray, p: np.ndarray, tolerance: float = 1e-12, most: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Reference coordinates (rows, 3) of points in their elements, and whether they converged: all rows at once."""
    x, _ = basis.gll(xyz.shape[-1])
    d = basis.derivative(x)
    rst, ok = np.zeros_like(p), np.zeros(len(p), bool)
    open_ = np.arange(len(p))
    for _ in range(most):
        if not len(open_):
            break
        l = [basis.lagrange(x, rst[open_, a]) for a in range(3)]
        dl = [w @ d for w in l]
        u = xyz[open_]
        half = np.einsum("ectsr,et->ecsr", u, l[2])
        line = np.einsum("ecsr,es->ecr", half, l[1])
        here = np.einsum("ecr,er->ec", line, l[0])
        jac = np.stack([np.einsum("ecr,er->ec", line, dl[0]), np.einsum("ecsr,es,er->ec", half, dl[1], l[0]), np.einsum("ectsr,et,es,er->ec", u, dl[2], l[1], l[0])], -1)
        miss = p[open_] - here
        scale = np.abs(u.reshape(len(u), 3, -1) - here[:, :, None]).max((1, 2)) + 1e-300
        flat = np.abs(np.linalg.det(jac / scale[:, None, None])) < 1e-14
        jac[flat] = np.eye(3) * scale[flat][:, None, None]
        step = np.linalg.solve(jac, miss[..., None])[..., 0]
        rst[open_] = np.clip(rst[open_] + np.clip(step, -1, 1), -3, 3)
        done = np.abs(step).max(1) < tolerance * 10
        ok[open_[done]] = True
        open_ = open_[~done]
    return rst, ok


def values_at(fields: np.ndarray, rst: np.ndarray) -> np.ndarray:
    """Fields (rows, f, t, s, r) at reference coordinates: (rows, f)."""
    x, _ = basis.gll(fields.shape[-1])
    l = [basis.lagrange(x, rst[:, a]) for a in range(3)]
    return np.einsum("eftsr,et,es,er->ef", fields, l[2], l[1], l[0], optimize=True)


def _cubes(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    each = [matrix(batch.column(c)) for c in names]
    n = round(each[0].shape[1] ** (1 / 3)) if each[0].size else 2
    return np.stack([u.reshape(-1, n, n, n) for u in each], 1)


def locate(probes: DataFrame, mesh: DataFrame, cell: Sequence[float], tolerance: float = 1e-6, edge: float = 1e-6, guess: float = 1e-4, obb: bool = False) -> DataFrame:
    """A row for each probe: probe_id, elem_id, r, s, t, err_code and test_pattern (null element: no candidate).

    Candidates are the elements whose box holds the probe (with obb also their oriented box). The reference coordinates
    come from Newton's method; test_pattern is the error of x^2 + y^2 + z^2 there. Both are
    reckoned from the element's first node, so that they don't depend on how far it lies from 0. Of several elements one that holds the
    probe wins, then the smallest error, then the smallest elem_id. err_code is 1 inside, -10 for a guess of error up to
    ``guess``, else 0. Independent of time: keep the result and join fields to it.
    """
    pairs = candidates(probes.select("probe_id", *XYZ), boxes(mesh, tolerance), cell)
    nodes = mesh.select("elem_id", *(F.col(c).cast("array<double>").alias(f"m{c}") for c in XYZ))
    joined = pairs.select("probe_id", *XYZ, "elem_id").join(nodes, "elem_id")
    kind = StructType([joined.schema["probe_id"], joined.schema["elem_id"], *StructType.fromDDL("r double, s double, t double, inside boolean, test_pattern double").fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 512):
                batch = big.slice(at, 512)
                xyz, p = _cubes(batch, ["mx", "my", "mz"]), np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in XYZ], 1)
                origin = xyz[:, :, 0, 0, 0].copy()  # far from 0 its digits would be lost to the search
                xyz, p = xyz - origin[:, :, None, None, None], p - origin
                if obb:
                    kept = oriented(xyz, p)
                    batch, xyz, p, origin = batch.filter(pa.array(kept)), xyz[kept], p[kept], origin[kept]
                    if not batch.num_rows:
                        continue
                rst, ok = newton(xyz, p)
                inside = ok & (np.abs(rst) <= 1 + edge).all(1)
                rst = np.where(inside[:, None], np.clip(rst, -1, 1), rst)
                here = values_at(np.concatenate((xyz, (xyz**2).sum(1)[:, None]), 1), np.clip(rst, -1, 1))
                test = np.abs(here[:, 3] - (p**2).sum(1) + 2 * (origin * (here[:, :3] - p)).sum(1))
                yield pa.RecordBatch.from_arrays([batch.column("probe_id"), batch.column("elem_id"), *(pa.array(rst[:, a]) for a in range(3)), pa.array(inside), pa.array(test)], names=["probe_id", "elem_id", "r", "s", "t", "inside", "test_pattern"])

    best = F.struct((~F.col("inside")).alias("out"), F.when(F.col("inside"), 0.0).otherwise(F.col("test_pattern")).alias("e"), "elem_id", "r", "s", "t", "test_pattern")
    found = joined.mapInArrow(work, kind).groupBy("probe_id").agg(F.min(best).alias("b"))
    code = F.when(F.col("b").isNull(), MISSING).when(~F.col("b.out"), FOUND).when(F.col("b.test_pattern") <= guess, GUESS).otherwise(MISSING)
    return probes.select("probe_id").join(found, "probe_id", "left").select("probe_id", F.col("b.elem_id").alias("elem_id"), F.col("b.r").alias("r"), F.col("b.s").alias("s"), F.col("b.t").alias("t"), code.alias("err_code"), F.col("b.test_pattern").alias("test_pattern"))


def interpolate(locations: DataFrame, fields: DataFrame, names: Sequence[str], keys: Sequence[str] = (), missing: float | None = None) -> DataFrame:
    """probe_id, keys (snapshot, time ..) and the fields' values at located probes; ``missing`` for the others.

    One join by element serves all snapshots and fields.
    """
    put = locations.where(F.col("err_code") != MISSING).select("probe_id", "elem_id", "r", "s", "t")
    joined = put.join(fields.select("elem_id", *keys, *names), "elem_id")
    kept = ["probe_id", *keys]
    kind = StructType([*(joined.schema[c] for c in kept), *(StructField(c, StructType.fromDDL("v double")["v"].dataType) for c in names)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 1024):
                batch = big.slice(at, 1024)
                rst = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in "rst"], 1)
                out = values_at(_cubes(batch, names), np.clip(rst, -1, 1))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(out[:, i]) for i in range(len(names)))], names=[*kept, *names])

    got = joined.mapInArrow(work, kind)
    lost = locations.where(F.col("err_code") == MISSING).select("probe_id")
    if keys:
        lost = lost.join(F.broadcast(fields.select(*keys).distinct()))
    return got.unionByName(lost.select("probe_id", *keys, *(F.lit(missing).cast("double").alias(c) for c in names)))


def interpolate_at(fields: DataFrame, name: str, rst: Sequence[float], out: str, n: int, dims: int = 3) -> DataFrame:
    """A field at fixed reference coordinates of every element: one literal weight for each node, within the JVM."""
    x, _ = basis.gll(n)
    l = [basis.lagrange(x, a)[0] for a in rst]
    w = np.einsum("t,s,r->tsr", l[2] if dims == 3 else np.ones(1), l[1], l[0]).ravel()
    terms = [F.col(name)[i].cast("double") * F.lit(float(v)) for i, v in enumerate(w)]
    return fields.withColumn(out, sum(terms[1:], terms[0]))


def nearest(pairs: DataFrame, probe: str, order: Sequence[Column]) -> DataFrame:
    """The first candidate of each probe in an order."""
    return pairs.withColumn("_n", F.row_number().over(Window.partitionBy(probe).orderBy(*order))).where("_n = 1").drop("_n")


def warnings(locations: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes not found inside an element, with their coordinates."""
    return locations.where(F.col("err_code") != FOUND).join(probes, "probe_id")
