from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from semspark.operators import pointclouds, tensors, timeaverage
from semspark.sources import fld, index, probes
from semspark.streaming import moments

from test_elements import mesh


def outputs(spark):
    return spark.createDataFrame([("a", 0, 20.0, 20.0, 10.0), ("a", 1, 42.0, 22.0, 13.0), ("a", 2, 70.0, 28.0, 17.0)], "k string, idx int, time double, dt double, u double")


@pytest.mark.parametrize(("length", "want"), [(70, [0, 0, 0]), (42, [0, 0, 1]), (10, [1, 2, 3])])
def test_batches(spark, length, want):
    b = timeaverage.batches(outputs(spark), length, "dt", ["k"], ["time"], ["u"])
    assert [r["batch"] for r in b.orderBy("time").collect()] == want
    avg = timeaverage.time_average(b, ["u"], "dt", ["batch"]).orderBy("batch").collect()
    if length == 70:
        assert np.isclose(avg[0]["u"], (10 * 20 + 13 * 22 + 17 * 28) / 70) and avg[0]["batch_time"] == 70
    if length == 42:
        assert np.isclose(avg[0]["u"], (10 * 20 + 13 * 22) / 42) and avg[1]["u"] == 17


def test_index_round_trip(spark, tmp_path):
    rows = timeaverage.intervals(outputs(spark).withColumn("fname", F.concat(F.lit("f"), F.col("idx"))), "time", start=5.0)
    path = str(tmp_path / "index")
    index.write_json(rows, path, 5.0)
    got = index.read_json(spark, path).orderBy("idx").collect()
    assert [(r["fname"], r["time_interval"], r["start_time"]) for r in got] == [("f0", 15.0, 5.0), ("f1", 22.0, 5.0), ("f2", 28.0, 5.0)]
    both = timeaverage.merge([index.read_json(spark, path), index.read_json(spark, path).withColumn("start_time", F.lit(1.0))])
    assert both.count() == 6 and both.agg(F.min("start_time"), F.max("idx")).first() == (1.0, 5)


def test_long_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "ENTRIES", 100)
    n = 1030
    rows = spark.range(n).select(F.concat(F.lit('a"'), "id").alias("fname"), F.when(F.col("id") >= 3, F.floor(F.col("id") / 7) + 0.25).alias("time"), F.col("id").alias("at"))
    rows = timeaverage.intervals(rows.repartition(5, "at"), "time", [], ["at"], 0.1)
    assert rows.columns == ["fname", "time", "at", "idx", "time_previous_output", "time_interval"] and dict(rows.dtypes)["idx"] == "int"
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" in plan  # numbered in slices, not in one task
    times = [None, None, None, *(i // 7 + 0.25 for i in range(3, n))]
    before = [0.1, *(0.1 if t is None else t for t in times[:-1])]
    assert [(r["at"], r["idx"], r["time_previous_output"]) for r in rows.orderBy("at").collect()] == [(i, i, b) for i, b in enumerate(before)]
    path = str(tmp_path / "index")
    index.write_json(rows, path, 0.1)
    texts = [json.loads(f.read_text()) for f in (tmp_path / "index").glob("part-*")]
    assert len(texts) == 11 and all(t.pop("simulation_start_time") == 0.1 for t in texts)
    assert sorted(int(k) for t in texts for k in t) == list(range(n))
    got = index.read_json(spark, path).orderBy("idx").collect()
    assert [(r["idx"], r["fname"], r["time"], r["time_previous_output"], r["start_time"]) for r in got] == [(i, f'a"{i}', t, b, 0.1) for i, (t, b) in enumerate(zip(times, before, strict=True))]
    both = timeaverage.merge([index.read_json(spark, path).drop("idx").withColumn("idx", F.lit(k)) for k in (1, 0)], sort_by_time=False).orderBy("idx").collect()
    assert [(r["idx"], r["fname"]) for r in both] == [(i, f) for i, f in enumerate(sorted(2 * [f'a"{i}' for i in range(n)]))]


def test_empty_index(spark, tmp_path):
    rows = timeaverage.intervals(outputs(spark).where("idx > 5"), "time", start=5.0)
    index.write_json(rows, str(tmp_path / "index"), 5.0)
    assert [json.loads(f.read_text()) for f in (tmp_path / "index").glob("part-*")] == [{"simulation_start_time": 5.0}]
    assert index.read_json(spark, str(tmp_path / "index")).count() == 0


def test_log(spark, tmp_path):
    log = ["File name : field.fld", "File name : stats.fld", " t =  1.0E+00 dt", "x", "Time-step 1", "Writer output", " field.fld", " Output number : 3", "Writing at time: 2.500 s", "y", "Writer output", " stats.fld", " Output number : 7", " field.fld", " Output number : 4", "Writing at time: 4.000 s"]
    (tmp_path / "run.log").write_text("\n".join(log))
    got = index.from_log(spark, str(tmp_path / "run.log")).orderBy("file", "idx").collect()
    assert [(r["fname"], r["time"], r["time_interval"]) for r in got] == [("field0.f00003", 2.5, 1.5), ("field0.f00004", 4.0, 1.5), ("stats0.f00007", 4.0, 3.0)]


@pytest.mark.parametrize("word", [4, 8])
def test_field_files(spark, tmp_path, word):
    m = mesh(spark).withColumns({"u": F.col("x"), "v": F.col("y"), "w": F.col("z"), "p": F.col("x"), "s0": F.col("y"), "s1": F.col("z")})
    for files in (1, 3):
        folder = str(tmp_path / f"o{files}")
        fld.write(m, folder, "field", 2, 1.5, 7, word, files)
        got = fld.read(spark, f"{folder}/field*.f00002", elements=2).orderBy("elem_id").collect()
        want = m.orderBy("elem_id").collect()
        assert [r["elem_id"] for r in got] == [r["elem_id"] for r in want]
        for c in ("x", "y", "z", "u", "v", "w", "p", "s0", "s1"):
            assert np.allclose([r[c] for r in got], [r[c] for r in want], rtol=0, atol=1e-6 if word == 4 else 0)
        assert {(r["time"], r["step"]) for r in got} == {(1.5, 7)}
    one = fld.read(spark, f"{folder}/field0.f00002", ["s1", "p"])
    assert one.columns == ["path", "time", "step", "elem_id", "p", "s1"] and one.count() == 2
    with pytest.raises(Exception, match="no fields"):
        fld.read(spark, f"{folder}/field0.f00002", ["s7"])
    heads = index.from_headers(fld.headers(spark, f"{folder}/field0.f*"), 0.0, 0.0).collect()
    assert heads[0]["file_type"] == "field.fld" and heads[0]["time_interval"] == 1.5 and heads[0]["file_contents"]["scalar_fields"] == 2


def test_probe_series(spark, tmp_path):
    pts = spark.createDataFrame([(0, 0.0, 1.0, 2.0), (1, 3.0, 4.0, 5.0)], "probe_id long, x double, y double, z double")
    ser = spark.createDataFrame([(p, s, float(s), float(p + 10 * s)) for s in range(3) for p in range(2)], "probe_id long, snapshot long, t double, u double")
    probes.write_series(pts, ser, ["u"], str(tmp_path / "p"))
    a, b = probes.read_series(spark, str(tmp_path / "p"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, pts.collect()))
    assert sorted(map(tuple, b.collect())) == sorted(map(tuple, ser.collect()))


def test_lines_are_numbered_across_splits(spark, tmp_path):
    from semspark.sources.lines import numbered

    (tmp_path / "t").write_text("\n".join(str(i) for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    rows = numbered(spark, str(tmp_path / "t"))
    assert rows.where("line <> cast(value AS long)").count() == 0 and rows.count() == 5000
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_cloud(spark):
    turn = 2 * np.pi
    r = pointclouds.spacing(pointclouds.line(spark, 0.0, 0.05, 30))
    th = pointclouds.spacing(pointclouds.line(spark, 0.0, turn, 30, endpoint=False), period=turn)
    z = pointclouds.spacing(pointclouds.line(spark, 0.0, 1.0, 80))
    cloud = pointclouds.cylinder(r, th, z)
    assert cloud.count() == 72000 and np.isclose(cloud.agg(F.sum("mass")).first()[0], 0.007853981, rtol=1e-3)
    grid = probes.list_to_grid(probes.grid_to_list(cloud, (30, 30, 80)).select("probe_id"), (30, 30, 80))
    assert grid.agg(F.max("i"), F.max("j"), F.max("k")).first() == (29, 29, 79)


def test_rotation_to_cylinder(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (0.0, 0.0, 1.0), (-3.0, 0.5, 0.0)], "x double, y double, z double")
    got = tensors.rotate(df.selectExpr("*", "x AS u", "y AS v", "z AS w"), ["u", "v", "w"]).collect()
    for r in got:
        assert np.isclose(r["rot_u"], np.hypot(r["x"], r["y"])) and abs(r["rot_v"]) < 1e-12 and r["rot_w"] == r["z"]


def test_streams(spark, tmp_path):
    rows = [("a" if i % 2 else "b", i, float(i % 7 + 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i int, dt double").select("k", F.timestamp_seconds(F.col("i") * 60 + 86400).alias("ts"), "dt")
    for part in range(3):
        df.where(f"minute(ts) >= {part * 20} AND minute(ts) < {part * 20 + 20}").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = moments.running_mean(source, ["dt"], ["k"], "dt").writeStream.outputMode("complete").format("memory").queryName("means").start()
    q.processAllAvailable()
    q.stop()
    want = {r["k"]: r["m"] for r in df.groupBy("k").agg((F.sum(F.col("dt") * F.col("dt")) / F.sum("dt")).alias("m")).collect()}
    assert all(np.isclose(r["dt"], want[r["k"]]) for r in spark.table("means").collect())
    q = moments.time_batches(source, "k", "ts", "dt", 20.0, lateness="1 minute").writeStream.outputMode("append").format("memory").queryName("batches").start()
    q.processAllAvailable()
    q.stop()
    table = timeaverage.batches(df, 20.0, "dt", ["k"], ["ts"], [])
    whole = {(r["k"], r["ts"]): r["batch"] for r in table.collect()}
    some = {(r["k"], r["ts"]): r["batch"] for r in spark.table("batches").collect()}
    assert len(some) >= 30
    assert {k: whole[k] for k in some} == some


def test_visit_and_cli(spark, tmp_path):
    from semspark.cli.__main__ import main

    fld.write(mesh(spark), str(tmp_path), "field", 0, 2.0)
    main(["visit", str(tmp_path), "field"])
    assert "numtimesteps: 1" in (tmp_path / "field.nek5000").read_text()
    main(["index", str(tmp_path), str(tmp_path / "out")])
    text = next((tmp_path / "out" / "field_index").glob("part-*")).read_text()
    assert json.loads(text)["0"]["time"] == 2.0
    main(["subdomain", str(tmp_path / "field0.f00000"), str(tmp_path / "sub"), "--x", "0,2", "--order", "4"])
    assert fld.read_header(str(tmp_path / "sub" / "sub0.f00000")).elements == 2
