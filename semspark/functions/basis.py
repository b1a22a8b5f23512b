"""One-dimensional polynomial bases on [-1, 1]: small NumPy matrices that operators send along."""

from __future__ import annotations

import numpy as np
from numpy.polynomial import legendre


def gll(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n Gauss-Lobatto-Legendre nodes, rising, and their weights."""
    if n < 2:
        raise ValueError("a Lobatto rule has two nodes at least")
    top = [0.0] * (n - 1) + [1.0]
    inner = np.sort(legendre.legroots(legendre.legder(top)).real) if n > 2 else np.zeros(0)
    x = np.concatenate(([-1.0], inner, [1.0]))
    x = (x - x[::-1]) / 2
    return x, 2 / (n * (n - 1) * legendre.legval(x, top) ** 2)


def chebyshev(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n Gauss-Chebyshev points, rising, and their weights."""
    return -np.cos((2 * np.arange(n) + 1) * np.pi / (2 * n)), np.full(n, np.pi / n)


def barycentric(x: np.ndarray) -> np.ndarray:
    d = x[:, None] - x[None, :]
    np.fill_diagonal(d, 1)
    return 1 / d.prod(1)


def lagrange(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows: the Lagrange polynomials of nodes x at each point."""
    at = np.atleast_1d(np.asarray(at, float))
    w, d = barycentric(x), at[:, None] - x[None, :]
    hit = np.abs(d) < 1e-14
    d = np.where(hit, 1, d)
    out = w / d
    out /= out.sum(1, keepdims=True)
    return np.where(hit.any(1, keepdims=True), hit.astype(float), out)


def derivative(x: np.ndarray) -> np.ndarray:
    """D with (D u)_i the derivative at node i of the polynomial through u. Rows sum to zero exactly."""
    w, d = barycentric(x), x[:, None] - x[None, :]
    np.fill_diagonal(d, 1)
    out = w[None, :] / w[:, None] / d
    np.fill_diagonal(out, 0)
    np.fill_diagonal(out, -out.sum(1))
    return out


def to_nodal(n: int) -> np.ndarray:
    """V: values at the GLL nodes of the Legendre polynomials, scaled to unit length in the discrete norm."""
    x, _ = gll(n)
    scale = np.sqrt((2 * np.arange(n) + 1) / 2)
    scale[-1] = np.sqrt((n - 1) / 2)
    return legendre.legvander(x, n - 1) * scale


def to_modal(n: int) -> np.ndarray:
    """The inverse of V: its transpose times the weights."""
    return to_nodal(n).T * gll(n)[1]


def spatial_filter(transfer: np.ndarray) -> np.ndarray:
    """A one-dimensional filter that multiplies mode k by transfer[k]."""
    n = len(transfer)
    return to_nodal(n) @ np.diag(transfer) @ to_modal(n)


def low_pass(n: int, modes: int, strength: float = 1.0) -> np.ndarray:
    """A transfer function that weakens the last modes quadratically, not below 0."""
    out = np.ones(n)
    for i in range(modes):
        out[n - modes + i] = max(0.0, 1 - strength * ((i + 1) / modes) ** 2)
    return out


def refine(n: int, m: int, equidistant: bool = False) -> np.ndarray:
    """From n GLL nodes to m GLL or equidistant points."""
    return lagrange(gll(n)[0], np.linspace(-1, 1, m) if equidistant else gll(m)[0])


def along(u: np.ndarray, r: np.ndarray | None = None, s: np.ndarray | None = None, t: np.ndarray | None = None) -> np.ndarray:
    """Apply one-dimensional matrices to fields (elements, t, s, r), one axis after the other."""
    if r is not None:
        u = u @ r.T
    if s is not None:
        u = np.matmul(s, u)
    if t is not None:
        u = np.einsum("ab,ebji->eaji", t, u, optimize=True)
    return u
