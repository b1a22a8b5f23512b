"""Pointwise tensors: rotations, moments of turbulence, and the Reynolds-stress budgets."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The order of the six components of a symmetric tensor.
SIX = [(1, 1), (2, 2), (3, 3), (1, 2), (1, 3), (2, 3)]
Matrix = list[list[Column]]


def to_matrix(six: Sequence[Column]) -> Matrix:
    at = {p: c for p, c in zip(SIX, six, strict=True)}
    return [[at[min(i, j), max(i, j)] for j in (1, 2, 3)] for i in (1, 2, 3)]


def to_six(m: Matrix) -> list[Column]:
    return [m[i - 1][j - 1] for i, j in SIX]


def cylindrical(x: Column, y: Column, z: Column) -> Matrix:
    """Rotation from Cartesian to (r, theta, z) components; none on the axis (radius up to 1e-7)."""
    axis = F.sqrt(x * x + y * y) <= 1e-7
    angle = F.atan2(y, x)
    c, s = F.when(axis, 1.0).otherwise(F.cos(angle)), F.when(axis, 0.0).otherwise(F.sin(angle))
    zero, one = F.lit(0.0), F.lit(1.0)
    return [[c, s, zero], [-s, c, zero], [zero, zero, one]]


def rotate_vector(r: Matrix, v: Sequence[Column]) -> list[Column]:
    return [r[i][0] * v[0] + r[i][1] * v[1] + r[i][2] * v[2] for i in range(3)]


def rotate_matrix(r: Matrix, t: Matrix) -> Matrix:
    """R T R^T."""
    half = [[sum((r[i][k] * t[k][j] for k in range(1, 3)), r[i][0] * t[0][j]) for j in range(3)] for i in range(3)]
    return [[sum((half[i][k] * r[j][k] for k in range(1, 3)), half[i][0] * r[j][0]) for j in range(3)] for i in range(3)]


def rotate(df: DataFrame, names: Sequence[str], rotation: Callable[[Column, Column, Column], Matrix] = cylindrical, at: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Append rot_<name> for a vector (3 names) or a tensor (9 names, by rows); rotation gives the matrix at a point."""
    r = rotation(*(F.col(c) for c in at))
    v = [F.col(c) for c in names]
    if len(v) == 3:
        out = rotate_vector(r, v)
    elif len(v) == 9:
        out = [c for row in rotate_matrix(r, [v[0:3], v[3:6], v[6:9]]) for c in row]
    else:
        raise ValueError("a tensor has 3 or 9 components")
    return df.withColumns({f"rot_{n}": c for n, c in zip(names, out, strict=True)})


def augmented(u: Sequence[Column], p: Column, grad: Matrix | None = None) -> dict[str, Column]:
    """The 44 statistics of a snapshot at a point; grad[i][j] is d u_i / d x_j (without it, the first 29)."""
    names = "uvw"
    out = dict(zip(names, u, strict=True)) | {"p": p, "pp": p * p}
    for order in (2, 3):
        sets = list(combinations_with_replacement(range(3), order))
        sets.sort(key=lambda s: (len(set(s)) > 1, s))
        for s in sets:
            c = u[s[0]]
            for i in s[1:]:
                c = c * u[i]
            out["".join(names[i] for i in s)] = c
    out |= {names[i] * 4: u[i] * u[i] * u[i] * u[i] for i in range(3)}
    out |= {"ppp": p * p * p, "pppp": p * p * p * p} | {f"p{names[i]}": p * u[i] for i in range(3)}
    if grad is not None:
        out |= {f"pd{names[i]}d{x}": p * grad[i][j] for i in range(3) for j, x in enumerate("xyz")}
        out |= {f"e{i}{j}": sum((grad[i - 1][k] * grad[j - 1][k] for k in (1, 2)), grad[i - 1][0] * grad[j - 1][0]) for i, j in SIX}
    return out


def reynolds_stress(mean: Sequence[Column], second: Sequence[Column]) -> list[Column]:
    """<u_i u_j> - U_i U_j in the order 11, 22, 33, 12, 13, 23."""
    return [s - mean[i - 1] * mean[j - 1] for (i, j), s in zip(SIX, second, strict=True)]


def central_moments(p: Column, p2: Column, p3: Column, p4: Column) -> tuple[Column, Column, Column]:
    """Central moments 2 to 4 from raw ones."""
    m2 = p2 - p * p
    m3 = p3 - p * p * p - 3 * p * m2
    return m2, m3, p4 - p * p * p * p - 6 * p * p * m2 - 4 * p * m3


def _name(*indices: int) -> str:
    return "".join(f"u{i}" for i in sorted(indices))


def budgets(df: DataFrame, reynolds: float) -> DataFrame:
    """Append the terms of the mean-momentum and Reynolds-stress budgets, in Cartesian components, at each point.

    df holds averages: u1.., u1u1.., u1u1u1.., u1u1u1u1 (fourth powers), p, pp, ppp, pppp, pu1.., the gradients
    d<k>_<name> of u<i>, u<i>u<j>, u<i>u<j>u<k>, p and pu<i>, the diagonal second derivatives dd<k>_ of u<i> and u<i>u<j>,
    pd<j>_u<i> = <p du_i/dx_j> and e<i><j> = <du_i/dx_k du_j/dx_k>, indices in products rising.
    """
    three = (1, 2, 3)
    c = F.col
    u = {i: c(f"u{i}") for i in three}
    d = lambda k, *ij: c(f"d{k}_{_name(*ij)}")
    total = lambda terms: sum(terms[1:], terms[0])
    out: dict[str, Column] = {f"R{i}{j}": c(_name(i, j)) - u[i] * u[j] for i, j in SIX}
    df = df.withColumns(out)
    r = lambda i, j: c(f"R{min(i, j)}{max(i, j)}")
    p2, p3, p4 = central_moments(c("p"), c("pp"), c("ppp"), c("pppp"))
    out = {"P2": p2, "P3": p3, "P4": p4}
    third = list(combinations_with_replacement(three, 3))
    out |= {f"T{i}{j}{k}": c(_name(i, j, k)) - u[i] * u[j] * u[k] - u[i] * r(j, k) - u[j] * r(i, k) - u[k] * r(i, j) for i, j, k in third}
    out |= {f"dR{min(i, j)}{max(i, j)}_{k}": d(k, i, j) - u[i] * d(k, j) - u[j] * d(k, i) for i, j in SIX for k in three}
    df = df.withColumns(out)
    dr = lambda i, j, k: c(f"dR{min(i, j)}{max(i, j)}_{k}")
    out = {f"F{i}": c(_name(i, i, i, i)) - u[i] * u[i] * u[i] * u[i] - 6 * u[i] * u[i] * r(i, i) - 4 * u[i] * c(f"T{i}{i}{i}") for i in three}
    for i in three:
        out[f"momentum_convection_{i}"] = total([u[k] * d(k, i) for k in three])
        out[f"momentum_convection_residual_{i}"] = total([u[k] * d(k, i) for k in three if k != i])
        out[f"momentum_pressure_{i}"] = -c(f"d{i}_p")
        out[f"momentum_turbulent_{i}"] = -total([dr(i, k, k) for k in three])
        out[f"momentum_viscous_{i}"] = total([c(f"dd{k}_u{i}") for k in three]) / reynolds
    for i, j in SIX:
        out[f"production_{i}{j}"] = -total([r(i, k) * d(k, j) + r(j, k) * d(k, i) for k in three])
        out[f"convection_{i}{j}"] = -total([u[k] * dr(i, j, k) for k in three])
        out[f"dissipation_{i}{j}"] = (c(f"e{i}{j}") - total([d(k, i) * d(k, j) for k in three])) * (-2.0 / reynolds)
        second = [c(f"dd{k}_{_name(i, j)}") - u[i] * c(f"dd{k}_u{j}") - u[j] * c(f"dd{k}_u{i}") - 2 * d(k, i) * d(k, j) for k in three]
        out[f"viscous_diffusion_{i}{j}"] = total(second) / reynolds
        strain = lambda a, b: c(f"pd{b}_u{a}") - c("p") * d(b, a)
        flux = lambda a, b: c(f"d{b}_pu{a}") - c("p") * d(b, a) - u[a] * c(f"d{b}_p")
        out[f"pressure_strain_{i}{j}"] = strain(i, j) + strain(j, i)
        out[f"pressure_transport_{i}{j}"] = -(flux(i, j) + flux(j, i))
    df = df.withColumns(out)
    out = {}
    for i, j in SIX:
        mean_terms = u[i] * c(f"momentum_convection_{j}") + u[j] * c(f"momentum_convection_{i}") - u[i] * c(f"momentum_turbulent_{j}") - u[j] * c(f"momentum_turbulent_{i}")
        triple = total([c(f"d{k}_{_name(i, j, k)}") for k in three])
        out[f"turbulent_transport_{i}{j}"] = mean_terms - triple - c(f"convection_{i}{j}") - c(f"production_{i}{j}")
        out[f"pressure_gradient_{i}{j}"] = c(f"pressure_transport_{i}{j}") - c(f"pressure_strain_{i}{j}")
    for i in three:
        out[f"momentum_residual_{i}"] = c(f"momentum_viscous_{i}") + c(f"momentum_turbulent_{i}") + c(f"momentum_pressure_{i}") - c(f"momentum_convection_{i}")
    df = df.withColumns(out)
    terms = ["production", "dissipation", "turbulent_transport", "viscous_diffusion", "pressure_gradient", "convection"]
    df = df.withColumns({f"tke_{t}": total([c(f"{t}_{i}{i}") for i in three]) / 2 for t in terms})
    return df.withColumn("tke_residual", total([c(f"tke_{t}") for t in terms]))


#: Where each logical statistic lies in the solver's statistics files (field of file "stats").
STAT_FIELDS = ["p", "u", "v", "w", "pp", "uu", "vv", "ww", "uv", "uw", "vw", "uuu", "vvv", "www", "uuv", "uuw", "uvv", "uvw", "vvw", "uww", "vww", "uuuu", "vvvv", "wwww", "ppp", "pppp", "pu", "pv", "pw", "pdudx", "pdudy", "pdudz", "pdvdx", "pdvdy", "pdvdz", "pdwdx", "pdwdy", "pdwdz", "e11", "e22", "e33", "e12", "e13", "e23"]


def stat_columns(names: Sequence[str] = STAT_FIELDS) -> list[Column]:
    """Logical names for a statistics file's columns: pressure, velocity, temperature, then scalars s0 on."""
    slots = ["p", "u", "v", "w", "t", *(f"s{i}" for i in range(len(names) - 5))]
    return [F.col(s).alias(n) for s, n in zip(slots, names, strict=True)]
