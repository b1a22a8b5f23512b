from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from semspark.functions import basis
from semspark.operators import calculus, compression, elements, locate, orientation, reductions, rom, topology


def mesh(spark, n=5, count=6, curved=True):
    """Elements along x, bent in y and z by smooth functions."""
    x, _ = basis.gll(n)
    rows = []
    for e in range(count):
        t, s, r = np.meshgrid(x, x, x, indexing="ij")
        gx, gy, gz = e + (r + 1) / 2, (s + 1) / 2, (t + 1) / 2
        if curved:
            gy, gz = gy + 0.1 * gx * gz, gz + 0.05 * gx**2
        rows.append((e, gx.ravel().tolist(), gy.ravel().tolist(), gz.ravel().tolist()))
    return spark.createDataFrame(rows, "elem_id long, x array<double>, y array<double>, z array<double>")


def columns(df, *names):
    return [np.array([r[c] for r in df.orderBy("elem_id").collect()]) for c in names]


@pytest.mark.parametrize("n", [2, 4, 8])
def test_basis(n):
    x, w = basis.gll(n)
    d = basis.derivative(x)
    assert abs(w.sum() - 2) < 1e-12
    assert np.allclose(d @ np.ones(n), 0, atol=1e-12) and np.allclose(d @ x, 1)
    assert np.allclose(d @ x ** (n - 1), (n - 1) * x ** (n - 2) if n > 2 else 1)
    assert np.allclose(basis.to_modal(n) @ basis.to_nodal(n), np.eye(n))
    assert np.allclose(basis.refine(n, n + 3) @ x, basis.gll(n + 3)[0])


def test_geometry_and_gradient(spark):
    g = calculus.geometry(mesh(spark))
    grad = calculus.gradient(g, ["x", "y", "z"])
    for f in "xyz":
        for a in "xyz":
            (v,) = columns(grad, f"d{f}d{a}")
            assert np.allclose(v, float(f == a), atol=1e-10)
    (b,) = columns(g, "b")
    assert np.isclose(b[0].sum(), columns(calculus.geometry(mesh(spark, 7)), "b")[0][0].sum())
    (d,) = columns(calculus.dudxyz(g, "y", "y"), "dydy")
    assert np.allclose(d, 1)
    (dd,) = columns(calculus.second_derivatives(g.withColumn("q", F.transform("x", lambda x: x * x)), "q"), "d2qdx2")
    assert np.allclose(dd, 2, atol=1e-8)


def test_two_dimensions(spark):
    x, _ = basis.gll(4)
    s, r = np.meshgrid(x, x, indexing="ij")
    df = spark.createDataFrame([(0, (2 * r).ravel().tolist(), (3 * s + r).ravel().tolist())], "elem_id long, x array<double>, y array<double>")
    g = calculus.geometry(df, 2)
    (b,) = columns(g, "b")
    assert np.isclose(b.sum(), 24)
    v, u = columns(calculus.gradient(g, ["y"], 2), "dydx", "dydy")
    assert np.allclose(v, 0, atol=1e-12) and np.allclose(u, 1)


def test_facets(spark):
    rows = calculus.facet_geometry(mesh(spark, curved=False)).where("elem_id = 0").collect()
    normal = {r["facet"]: np.array([r["nx"][0], r["ny"][0], r["nz"][0]]) for r in rows}
    for facet, want in {"r-": [-1, 0, 0], "r+": [1, 0, 0], "s-": [0, -1, 0], "s+": [0, 1, 0], "t-": [0, 0, -1], "t+": [0, 0, 1]}.items():
        assert np.allclose(normal[facet], want)
    assert all(np.isclose(sum(r["area"]), 1) for r in rows)


def test_null_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(0, [1.0] * 8, "a"), (1, None, "b")], "elem_id long, u array<double>, out string")
    got = calculus.to_modal(df, "u", "c").orderBy("elem_id").collect()
    assert got[1]["c"] is None and len(got[0]["c"]) == 8 and got[0]["out"] == "a"
    assert calculus.to_modal(df.where("false"), "u", "c").count() == 0


def test_interpolating_coordinates_returns_them(spark):
    m = mesh(spark)
    g = np.random.default_rng(0)
    p = np.stack((g.uniform(0, 6, 60), g.uniform(0.05, 0.95, 60), g.uniform(0.05, 0.95, 60)), 1)
    p[:, 1], p[:, 2] = p[:, 1] + 0.1 * p[:, 0] * p[:, 2], p[:, 2] + 0.05 * p[:, 0] ** 2
    probes = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "probe_id long, x double, y double, z double")
    for obb in (False, True):
        places = locate.locate(probes, m, (1.0, 1.5, 2.0), obb=obb)
        assert places.where("err_code = 1").count() == 60
        got = locate.interpolate(places, m, ["x", "y", "z"]).orderBy("probe_id").collect()
        assert np.allclose([[r["x"], r["y"], r["z"]] for r in got], p, atol=1e-7)
    far = spark.createDataFrame([(0, 50.0, 0.0, 0.0), (1, 1.0, 0.5, 0.5)], "probe_id long, x double, y double, z double")
    places = locate.locate(far, mesh(spark, curved=False), (1.0, 1.0, 1.0))
    codes = {r["probe_id"]: (r["err_code"], r["elem_id"]) for r in places.collect()}
    assert codes == {0: (0, None), 1: (1, 0)}  # on a shared face the smallest element has it
    values = {r["probe_id"]: r["x"] for r in locate.interpolate(places, mesh(spark, curved=False), ["x"], missing=0.0).collect()}
    assert values[0] == 0.0 and np.isclose(values[1], 1.0)
    assert locate.warnings(places, far).count() == 1


@pytest.mark.parametrize("obb", [False, True])
def test_locate_far_from_zero(spark, obb):
    at = 2.0**26
    away = mesh(spark, curved=False).withColumn("x", F.transform("x", lambda v: v + at))
    near = [(i, 0.05 + 0.09 * i, 0.07 + 0.08 * i, 0.9 - 0.07 * i) for i in range(10)]
    probes = spark.createDataFrame([(i, at + x, y, z) for i, x, y, z in near], "probe_id long, x double, y double, z double")
    places = locate.locate(probes, away, (1.0, 1.0, 1.0), obb=obb).collect()
    want = {r["probe_id"]: r for r in locate.locate(spark.createDataFrame(near, probes.schema), mesh(spark, curved=False), (1.0, 1.0, 1.0), obb=obb).collect()}
    assert {r["err_code"] for r in places} == {locate.FOUND} == {r["err_code"] for r in want.values()}
    for r in places:
        assert r["elem_id"] == want[r["probe_id"]]["elem_id"] and r["test_pattern"] < 1
        assert np.allclose([r[c] for c in "rst"], [want[r["probe_id"]][c] for c in "rst"], atol=1e-6)


def test_neighbours_at_crowded_places(spark, monkeypatch):
    monkeypatch.setattr(topology, "BLOCK", 8)
    monkeypatch.setattr(topology, "PAIRS", 500)
    at = {i: {("a", i % 3)} | ({("b", 0)} if i % 5 == 0 else set()) | ({("c", i // 20)} if i % 2 else set()) for i in range(120)}
    rows = [(k, i) for i, keys in at.items() for k in keys] + [(("a", 0), 0), (None, 1), (None, 2), (("d", 1), None), (("d", 1), 7)]
    df = spark.createDataFrame(rows, "key struct<p: string, n: int>, elem_id long")
    out = topology.neighbours(df)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i in at for j in at if i != j and at[i] & at[j]}
    pairs = sum(n * n for n in (40, 40, 40, 24, *[10] * 6))
    assert out.rdd.getNumPartitions() >= pairs // 500  # a crowded place isn't one task's


def test_shared_entities(spark):
    m = mesh(spark, curved=False)
    v = topology.entities(m, 5, "vertex")
    assert v.count() == 48 and topology.shared(v).count() == 20
    assert topology.shared(topology.entities(m, 5, "edge")).count() == 20
    f = topology.entities(m, 5, "facet")
    assert topology.shared(f).count() == 5 and topology.boundary(f).count() == 36 - 10
    assert topology.neighbours(v).count() == 10


def test_dssum_is_continuous(spark):
    m = mesh(spark, curved=False).withColumn("u", F.transform("x", lambda x: x + F.col("elem_id")))
    nodes = elements.points(m, ["x", "y", "z", "u"], 5).withColumn("key", topology.node_key([F.col(c) for c in "xyz"]))
    for f in (topology.dssum, topology.dssum_skewed):
        got = f(nodes, ["u"], ["key"])
        assert got.groupBy("key").agg(F.countDistinct("u").alias("n")).where("n > 1").count() == 0
        assert got.where("x = 1").select("u").distinct().collect()[0][0] == 1.5
    many = topology.multiplicity(nodes, ["key"])
    assert many.where("multiplicity = 2").count() == 5 * 25 * 2


def test_orientation(spark):
    m = mesh(spark, curved=False)
    n = 5
    order = np.arange(n**3).reshape(n, n, n).transpose(2, 0, 1)[::-1].ravel().tolist()
    turned = m.select("elem_id", *(F.transform(F.array(*map(F.lit, order)), lambda i, c=None: i).alias(f"o{c}") for c in ()), "x", "y", "z")
    turned = turned.select("elem_id", *(F.array(*(F.col(c)[i] for i in order)).alias(c) for c in "xyz"))
    back = orientation.aligned(turned)
    for c in "xyz":
        assert np.allclose(columns(back, c)[0], columns(m, c)[0])
    assert orientation.agreement(orientation.mappings(m)).first()[0] == 1.0


def test_compression(spark):
    m = mesh(spark).withColumn("u", F.transform("x", lambda x: F.sin(x)))
    cut = compression.restore(compression.truncate(m.select("elem_id", "u"), "u", 0.25), "u", "v")
    a, b = columns(m, "u")[0], columns(cut, "v")[0]
    assert np.abs(a - b).max() < 1e-3
    packed = compression.gp_compress(m.select("elem_id", "u"), "u", 0.3, "dlt", 125)
    v, = columns(compression.gp_restore(packed, "v"), "v")
    assert np.sqrt(((a - v) ** 2).mean()) < 0.05
    nodes = columns(packed, "nodes")[0]
    assert (np.array([len(set(r)) for r in nodes]) == 37).all()
    assert np.allclose(columns(compression.bit_planes(m, "u", 64, "w"), "w")[0], a)
    g = calculus.geometry(m)
    assert compression.error(g.withColumn("v", F.col("u")), "u", "v", "b").first()["rmse"] == 0.0
    s = np.random.default_rng(1).normal(size=(3, 6, 6))
    spd = s @ s.transpose(0, 2, 1) + 6 * np.eye(6)
    x = np.ones((3, 6))
    assert np.allclose(compression.conjugate_gradient(spd, np.einsum("eij,ej->ei", spd, x)), x)


def snapshots(spark, n=100, k=20):
    x = np.random.default_rng(0).random((n, k))
    return x, spark.createDataFrame([(i, r.tolist(), 2.0) for i, r in enumerate(x)], "point long, u array<double>, b double").repartition(5)


@pytest.mark.parametrize("method", ["tsqr", "gram"])
def test_pod(spark, method):
    x, df = snapshots(spark)
    dec = rom.pod(df, "u", 20, "b", method)
    u, d, vt = np.linalg.svd(x * np.sqrt(2), full_matrices=False)
    assert np.allclose(dec.d, d) and np.allclose(dec.vt**2, vt**2, atol=1e-6)
    got = np.array([r["modes"] for r in dec.modes.orderBy("point").collect()])
    assert np.allclose(got**2 * 2, u**2, atol=1e-6)


def test_streaming_pod(spark, tmp_path):
    x, df = snapshots(spark)
    state = rom.Streaming(["point"], 20, keep=lambda d: d.checkpoint())
    for i in range(0, 20, 5):
        state.update(df.select("point", F.slice("u", i + 1, 5).alias("u")), "u")
    _, d, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(state.d, d) and np.allclose(state.vt**2, vt**2, atol=1e-6)
    dec = rom.pod(df, "u", 5)
    rom.save(dec, str(tmp_path))
    again = rom.load(spark, str(tmp_path))
    assert np.allclose(again.d, dec.d) and np.allclose(again.vt, dec.vt) and again.modes.count() == 100
    both = dec.modes.join(df.select("point", F.col("u")[0].alias("s")), "point")
    assert rom.orthogonal_share(both, "modes", "s") < 1
    full = rom.reconstruct(rom.pod(df, "u", 20), range(20), range(20))
    assert np.allclose([r["value"] for r in full.orderBy("point").collect()], x)


def test_fourier(spark):
    x = np.random.default_rng(3).normal(size=(6, 8))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "point long, u array<double>")
    c = rom.fourier(df, "u")
    back = rom.inverse_fourier(c, ["point"], 8, "v").orderBy("point").collect()
    assert np.allclose([r["v"] for r in back], x)
    total = c.agg(F.sum(F.col("re") ** 2 + F.col("im") ** 2)).first()[0]
    assert np.isclose(total, (x**2).sum())  # Parseval
    s = spark.createDataFrame([(i // 2, i % 2, r.tolist()) for i, r in enumerate(x)], "point long, snapshot long, u array<double>")
    coefficients = rom.fourier(s, "u")
    right = rom.fourier_pod(coefficients, 2)
    left = rom.fourier_modes(coefficients, right)
    size = left.groupBy("kappa", "mode").agg(F.sum(F.col("re") ** 2 + F.col("im") ** 2).alias("n")).collect()
    assert all(np.isclose(r["n"], 1) for r in size)


def test_averages(spark):
    m = calculus.geometry(mesh(spark, curved=False))
    nodes = elements.points(m, ["x", "y", "z", "b"], 5).withColumn("group", F.lit(0))
    avg = reductions.space_average(nodes, ["x", "y"], "b", "z", ["elem_id"])
    assert avg.count() == 6 * 25
    back = reductions.extrude_back(avg, 5, "z")
    assert back.count() == 6 * 125
    assert np.isclose(reductions.mean(nodes, ["x"], "b").first()["x"], 3.0)
    keyed = reductions.centroid_keys(m, 5, "z")
    assert keyed.select("c1", "c2").distinct().count() == 6


def test_budgets_of_a_laminar_flow_vanish(spark):
    """Averages that are products of the mean leave no Reynolds terms; of u = (y, 0, 0) the momentum balances."""
    from semspark.operators import statistics, tensors

    m = calculus.geometry(mesh(spark, 4, 2, curved=False))
    value = {"u": F.col("y"), "v": F.transform("x", lambda x: x * 0), "w": F.transform("x", lambda x: x * 0), "p": F.col("z")}
    snap = statistics.augmented_fields(m.withColumns(value), 4)
    assert len([c for c in snap.columns if c not in ("elem_id", "k", "j", "i")]) == 44
    assert set(tensors.STAT_FIELDS) == set(snap.columns) - {"elem_id", "k", "j", "i"}
    rows = F.sort_array(F.collect_list(F.struct("k", "j", "i", *tensors.STAT_FIELDS)))
    packed = snap.groupBy("elem_id").agg(rows.alias("r"))
    stats = packed.select("elem_id", *(F.col(f"r.{c}").alias(c) for c in tensors.STAT_FIELDS))
    full = stats.join(m.drop("x", "y", "z"), "elem_id")
    out = tensors.budgets(statistics.budget_fields(full, 4), 100.0)
    terms = [c for c in out.columns if c.startswith(("R", "production", "dissipation", "turbulent", "viscous", "pressure_strain", "pressure_transport", "convection", "tke", "T", "F"))]
    worst = out.agg(*(F.max(F.abs(c)).alias(c) for c in terms)).first()
    assert all(worst[c] < 1e-9 for c in terms)
    assert np.isclose(out.agg(F.max("momentum_residual_3")).first()[0], -1)  # only the pressure's gradient is left


def test_mesh_check(spark):
    from semspark.operators import statistics

    g = statistics.spacing(calculus.geometry(mesh(spark, curved=False)))
    nodes = elements.points(g.select("elem_id", "dx", "dy", "dz", "b"), ["dx", "dy", "dz", "b"], 5).withColumn("eps", F.lit(1.0))
    got = statistics.mesh_check(nodes, 1.0).collect()
    assert all(r["eta"] == 1.0 and 0.2 < r["dx"] < 0.3 and np.isclose(r["dx"], r["dz"]) for r in got)
    with pytest.raises(ValueError, match="there is a field"):
        elements.with_field(g, "dx", F.lit(1))


def test_two_dimensional_statistics(spark):
    from semspark.operators import statistics

    df = spark.createDataFrame([(0, *map(float, range(44)))], "elem_id long, " + ", ".join(f"s{i} double" for i in range(44)))
    r = statistics.from_2d(df).first()
    assert (r["u"], r["p"], r["t"], r["s39"], r["s0"], r["s12"]) == (0.0, 3.0, 7.0, 2.0, 4.0, 34.0)
