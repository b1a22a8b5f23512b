from __future__ import annotations

import numpy as np

from semspark.functions import basis
from semspark.operators import compression


def test_group_shares_one_model(spark):
    g = np.random.default_rng(4)
    u = g.normal(size=(12, 64))
    df = spark.createDataFrame([(i, i % 2, u[i].tolist()) for i in range(12)], "elem_id long, part long, u array<double>")
    m = basis.to_modal(4)
    c = basis.along(u.reshape(12, 4, 4, 4), m, m, m).reshape(12, -1)
    for n in (1, 5):
        out = compression.gp_compress(df.repartition(n, "elem_id"), "u", 0.25, "average", group="part")
        assert out.columns == [*df.columns, "nodes", "samples", "spectrum"]
        got = {r["elem_id"]: r["spectrum"] for r in out.collect()}
        assert len(got) == 12 and all(np.allclose(got[i], c[i % 2 :: 2].mean(0), atol=1e-10) for i in range(12))


def test_slices_do_not_matter():
    g = np.random.default_rng(1)
    m = basis.to_modal(4)
    u = g.normal(size=(1024, 64))
    c = basis.along(u.reshape(-1, 4, 4, 4), m, m, m).reshape(len(u), -1)
    v = basis.to_nodal(4)
    full = np.kron(np.kron(v, v), v)
    want = np.einsum("am,em,bm->eab", full, c**2, full, optimize=True)
    cov = lambda x: compression.covariance(x, np.arange(len(x)), "bitplane", 64, 4)
    whole = cov(c)
    assert np.allclose(whole, want, rtol=0, atol=1e-12)
    for step in (1, 7, 64, 300):
        assert all((cov(c[a : a + step]) == whole[a : a + step]).all() for a in range(0, 1024, step))


def test_memory_is_bounded(spark, monkeypatch):
    sizes = []
    real = compression.covariance
    monkeypatch.setattr(compression, "covariance", lambda c, *a: sizes.append(c.shape) or real(c, *a))
    g = np.random.default_rng(2)
    for n, rows in ((2, 300), (4, 300), (8, 3)):
        df = spark.createDataFrame([(i, g.normal(size=n**3).tolist()) for i in range(rows)], "elem_id long, u array<double>")
        found = []

        def here(df, inputs, outputs, f):
            found.append(f)
            return df

        with monkeypatch.context() as p:
            p.setattr(compression, "_packed", here)
            compression.gp_compress(df, "u", 0.05)
            compression.gp_restore(df, "v")
        sizes.clear()
        u = compression.pa.array([r["u"] for r in df.collect()], compression.pa.list_(compression.pa.float64()))
        made = found[0](u)
        back = found[1](*made)[0]
        assert [len(x) for x in (*made, back)] == [rows] * 4
        assert sum(r for r, _ in sizes) == 2 * rows and all(r * m * m <= compression.DOUBLES for r, m in sizes)
