"""Named queries over the test tables, each beside the SQL that gives the same rows.

Embeddings stand for fields on elements of 4 x 4 x 4 nodes, events for outputs with a time, lineitem for a field with a
weight, and box meshes are made from ids. Values are rounded well away from their natural digits.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semspark.functions import basis
from semspark.operators import calculus, compression, elements, locate, orientation, pointclouds, reductions, rom, statistics, tensors, timeaverage, topology
from semspark.sources import fld, index, probes
from semspark.streaming import moments

N = 4
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("elem_id"), F.col("embedding").cast("array<double>").alias("u"), "label")


def near(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)


def seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


def values(m: np.ndarray, name: str) -> str:
    rows = ", ".join(f"({a}, {b}, CAST({float(m[a, b])!r} AS DOUBLE))" for a in range(m.shape[0]) for b in range(m.shape[1]))
    return f"{name}(a, b, m) AS (VALUES {rows})"


def vector(v: np.ndarray, name: str) -> str:
    return f"{name}(a, w) AS (VALUES {', '.join(f'({i}, CAST({float(x)!r} AS DOUBLE))' for i, x in enumerate(v))})"


NODES = """nodes AS (SELECT vec_id AS elem_id, label, CAST(x // 16 AS INTEGER) AS k, CAST((x // 4) % 4 AS INTEGER) AS j, CAST(x % 4 AS INTEGER) AS i,
  CAST(embedding[x + 1] AS DOUBLE) AS u FROM embeddings, (SELECT unnest(range(64)) AS x))"""


def three_passes(m: np.ndarray, digits: int = 6, where: str = "") -> str:
    return f"""WITH {values(m, "t")}, {NODES},
r AS (SELECT elem_id, k, j, t.a AS i, sum(m * u) AS u FROM nodes JOIN t ON t.b = i GROUP BY ALL),
s AS (SELECT elem_id, k, t.a AS j, i, sum(m * u) AS u FROM r JOIN t ON t.b = j GROUP BY ALL),
q AS (SELECT elem_id, t.a AS k, j, i, sum(m * u) AS u FROM s JOIN t ON t.b = k GROUP BY ALL)
SELECT elem_id, k, j, i, round(u, {digits}) + 0.0 AS u FROM q {where}"""


# Reductions


@query("""SELECT l_partkey AS group_id, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean
FROM lineitem GROUP BY l_partkey""")
def mass_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("group_id", F.col("l_partkey"))
    return reductions.mean(lines, ["l_extendedprice"], "l_quantity", ["group_id"]).select("group_id", F.round("l_extendedprice", 4).alias("mean"))


@query("""SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_quantity AS DECIMAL(8,2))) AS DOUBLE) AS total
FROM lineitem GROUP BY l_returnflag""")
def domain_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("decimal(12,2)").alias("total"), F.col("l_quantity").cast("decimal(8,2)").alias("b"))
    return reductions.integral(lines, ["total"], "b", ["l_returnflag"]).withColumn("total", F.col("total").cast("double"))


@query("SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS price, CAST(sum(CAST(l_quantity AS DECIMAL(8,2))) AS DOUBLE) AS quantity FROM lineitem")
def global_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").cast("decimal(12,2)").alias("price"), F.col("l_quantity").cast("decimal(8,2)").alias("quantity"))
    return reductions.glsum(lines, ["price", "quantity"]).select(*(F.col(c).cast("double").alias(c) for c in ("price", "quantity")))


_W = basis.gll(N)[1]


@query(f"""WITH {vector(_W, "w")}, {NODES}
SELECT elem_id, round(sum(u * x.w * y.w * z.w) / sum(x.w * y.w * z.w), 6) + 0.0 AS mean
FROM nodes JOIN w x ON x.a = i JOIN w y ON y.a = j JOIN w z ON z.a = k GROUP BY elem_id""")
def element_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    w3 = np.einsum("k,j,i->kji", _W, _W, _W).ravel()
    out = reductions.element_mean(fields(spark, sf_dir), "u", F.array(*(F.lit(float(x)) for x in w3)), "mean")
    return out.select("elem_id", near("mean").alias("mean"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, max({c}) AS max, min({c}) AS min, floor(avg({c}) * 10000 + 0.5) / 10000 AS avg FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def field_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reductions.inspect(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return out.withColumn("avg", F.floor(F.col("avg") * 10000 + 0.5) / 10000)


@query(f"""WITH {NODES} SELECT label, k, j, i, round(avg(u), 7) + 0.0 AS u, round(var_pop(u) / count(*), 9) + 0.0 AS u_var FROM nodes GROUP BY label, k, j, i""")
def nobm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reductions.nobm(elements.points(fields(spark, sf_dir), ["u"], N), ["u"], ["label", "k", "j", "i"])
    return out.withColumns({"u": near("u", 7), "u_var": near("u_var", 9)})


@query(f"""WITH {vector(_W, "w")}, {NODES} SELECT label, j, i, round(sum(u * w) / sum(w), 7) + 0.0 AS u FROM nodes JOIN w ON w.a = k GROUP BY label, j, i""")
def space_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.element_at(F.array(*(F.lit(float(x)) for x in _W)), F.col("k") + 1)
    nodes = elements.points(fields(spark, sf_dir), ["u"], N).withColumn("b", weight)
    return reductions.space_average(nodes, ["u"], "b", "z", ["label"]).withColumn("u", near("u", 7))


@query("""WITH e AS (SELECT vec_id // 10 AS section, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)
SELECT CAST(section AS BIGINT) AS section, round(avg(x), 7) + 0.0 AS x, round(avg(y), 7) + 0.0 AS y FROM e GROUP BY section""")
def section_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fields(spark, sf_dir).select("elem_id", F.col("u")[0].alias("x"), F.col("u")[1].alias("y"))
    return reductions.section_centres(e, 10, ["x", "y"]).withColumns({"x": near("x", 7), "y": near("y", 7)})


_MODES = """modes AS (SELECT x AS point, vec_id AS mode, CAST(embedding[x + 1] AS DOUBLE) AS phi FROM embeddings, (SELECT unnest(range(64)) AS x) WHERE vec_id < 3)"""


@query(f"""WITH {_MODES}, s AS (SELECT x AS point, vec_id AS snapshot, CAST(embedding[x + 1] AS DOUBLE) AS value FROM embeddings, (SELECT unnest(range(64)) AS x)),
c AS (SELECT point, avg(value) AS m FROM s GROUP BY point)
SELECT mode, snapshot, round(sum(phi * (1 + point % 3) * (value - m)), 6) + 0.0 AS a FROM s JOIN c USING (point) JOIN modes USING (point) GROUP BY mode, snapshot""")
def mode_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fields(spark, sf_dir).select(F.col("elem_id").alias("snapshot"), F.posexplode("u").alias("point", "value"))
    m = s.where("snapshot < 3").select("point", F.col("snapshot").alias("mode"), F.col("value").alias("phi"))
    return reductions.projection(s.withColumn("b", 1 + F.col("point") % 3), m).withColumn("a", near("a"))


@query(f"""WITH {_MODES} SELECT a.mode AS k, b.mode AS m, c.mode AS n, round(sum(a.phi * b.phi * c.phi), 7) + 0.0 AS value
FROM modes a JOIN modes b USING (point) JOIN modes c USING (point) GROUP BY 1, 2, 3""")
def galerkin_quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fields(spark, sf_dir).where("elem_id < 3").select(F.col("elem_id").alias("mode"), F.posexplode("u").alias("point", "phi"))
    return reductions.galerkin(s.withColumn("b", F.lit(1.0)))[1].withColumn("value", near("value", 7))


# Time


_EVENTS = "e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS time, value FROM events)"


@query(f"""WITH {_EVENTS} SELECT user_id, event_id, CAST(row_number() OVER w - 1 AS INTEGER) AS idx,
  round(time - coalesce(lag(time) OVER w, 0.0), 3) AS time_interval FROM e WINDOW w AS (PARTITION BY user_id ORDER BY time, event_id)""")
def file_index_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("time", seconds(F.col("ts")))
    return timeaverage.intervals(e, "time", ["user_id"], ["event_id"], 0.0).select("user_id", "event_id", "idx", F.round("time_interval", 3).alias("time_interval"))


@query("""WITH o AS (SELECT o_orderkey AS fname, epoch_us(o_orderdate) / 1e6 AS time, CASE o_orderstatus WHEN 'O' THEN CAST(5 AS DOUBLE) WHEN 'F' THEN CAST(3 AS DOUBLE) END AS start_time FROM orders)
SELECT CAST(row_number() OVER (ORDER BY time, fname) - 1 AS INTEGER) AS idx, fname, time, (SELECT min(start_time) FROM o) AS start_time FROM o""")
def merge_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    start = {"O": 5.0, "F": 3.0, "P": None}
    parts = [o.where(F.col("o_orderstatus") == s).select(F.col("o_orderkey").alias("fname"), seconds(F.col("o_orderdate")).alias("time"), F.lit(t).cast("double").alias("start_time")) for s, t in start.items()]
    return timeaverage.merge(parts)


@query("""SELECT event_id, regexp_extract(props, '"k": ?([0-9]+)', 1) AS k, event_type || '0.f' || lpad(CAST(event_id % 100000 AS VARCHAR), 5, '0') AS fname FROM events""")
def log_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    fname = F.concat("event_type", F.lit("0.f"), F.lpad((F.col("event_id") % 100000).cast("string"), 5, "0"))
    return table(spark, sf_dir, "events").select("event_id", F.regexp_extract("props", '"k": ?([0-9]+)', 1).alias("k"), fname.alias("fname"))


_LENGTH = 250.0
_BATCHES = f"""RECURSIVE {_EVENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY time, event_id) AS n FROM e),
b AS (SELECT user_id, event_id, value, n, CAST(CASE WHEN value <= {_LENGTH} * 1.05 THEN 0 ELSE 1 END AS BIGINT) AS batch, value AS filled FROM o WHERE n = 1
  UNION ALL SELECT o.user_id, o.event_id, o.value, o.n, CASE WHEN b.filled + o.value <= {_LENGTH} * 1.05 THEN b.batch ELSE b.batch + 1 END,
    CASE WHEN b.filled + o.value <= {_LENGTH} * 1.05 THEN b.filled + o.value ELSE o.value END FROM b JOIN o ON o.user_id = b.user_id AND o.n = b.n + 1)"""


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("time", seconds(F.col("ts")))
    return timeaverage.batches(e, _LENGTH, "value", ["user_id"], ["time", "event_id"], [])


@query(f"WITH {_BATCHES} SELECT user_id, event_id, batch FROM b")
def time_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir).select("user_id", "event_id", "batch")


@query(f"""WITH {_BATCHES} SELECT user_id, batch, round(sum((event_id % 7) * value) / sum(value), 6) + 0.0 AS f, round(sum(value), 4) + 0.0 AS batch_time FROM b
GROUP BY user_id, batch HAVING sum(value) > 0""")
def time_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _batches(spark, sf_dir).withColumn("f", (F.col("event_id") % 7).cast("double"))
    filled = b.join(b.groupBy("user_id", "batch").agg(F.sum("value").alias("_t")).where("_t > 0").drop("_t"), ["user_id", "batch"], "left_semi")
    out = timeaverage.time_average(filled, ["f"], "value", ["user_id", "batch"])
    return out.select("user_id", "batch", near("f").alias("f"), near("batch_time", 4).alias("batch_time"))


@query(f"""WITH {NODES}, s AS (SELECT *, elem_id % 2 AS batch, 1.0 + label AS dt FROM nodes)
SELECT batch, elem_id // 40 AS elem_id, CAST(k * 16 + j * 4 + i AS BIGINT) AS node, round(sum(u * dt) / sum(dt), 7) + 0.0 AS u FROM s GROUP BY ALL""")
def average_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fields(spark, sf_dir).withColumns({"idx": F.col("elem_id"), "elem_id": F.floor(F.col("elem_id") / 40)})
    index = f.select("idx", (F.col("idx") % 2).alias("batch"), (F.col("label") + 1.0).alias("dt"))
    out = timeaverage.average_files(f.drop("label"), index, ["u"])
    return out.select("batch", "elem_id", F.posexplode("u").alias("node", "v")).select("batch", "elem_id", F.col("node").cast("long").alias("node"), near("v", 7).alias("u"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS value FROM events GROUP BY event_type")
def stream_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    name = f"stream_moments_{abs(hash(sf_dir))}"
    q = moments.running_mean(source, ["value"], ["event_type"]).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select("event_type", "n", F.round("value", 6).alias("value"))


# Elements


def _derivative(axis: str, join: str, cols: str):
    sql = f"""WITH {values(basis.derivative(basis.gll(N)[0]), "d")}, {NODES}
SELECT elem_id, {cols}, round(sum(m * u), 6) + 0.0 AS du FROM nodes JOIN d ON d.b = {join} GROUP BY ALL"""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = calculus.reference_derivative(fields(spark, sf_dir), "u", axis, "du").drop("u", "label")
        return elements.points(out, ["du"], N).withColumn("du", near("du"))

    run.__name__ = f"derivative_{axis}"
    return query(sql)(run)


derivative_r = _derivative("r", "i", "k, j, d.a AS i")
derivative_s = _derivative("s", "j", "k, d.a AS j, i")
derivative_t = _derivative("t", "k", "d.a AS k, j, i")


@query(f"""WITH {values(basis.derivative(basis.gll(N)[0]), "d")}, {NODES},
g AS (SELECT elem_id, k, j, d.a AS i, sum(m * u * u) AS dx FROM nodes JOIN d ON d.b = i GROUP BY ALL),
h AS (SELECT elem_id, k, d.a AS j, i, sum(m * u) AS dy FROM nodes JOIN d ON d.b = j GROUP BY ALL)
SELECT g.elem_id, g.k, g.j, g.i, round((h.dy + g.dx) / 2, 6) + 0.0 AS s12, round((h.dy - g.dx) / 2, 6) + 0.0 AS o12
FROM g JOIN h ON g.elem_id = h.elem_id AND g.k = h.k AND g.j = h.j AND g.i = h.i""")
def strain_and_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    three = fields(spark, sf_dir).select("elem_id", "u", F.transform("u", lambda x: x * x).alias("v"))
    for f in "uv":
        for a, x in zip("rs", "xy", strict=True):
            three = calculus.reference_derivative(three, f, a, f"d{f}d{x}")
    out = calculus.rotation(calculus.strain(three, ("u", "v")), ("u", "v")).select("elem_id", "s12", "o12")
    return elements.points(out, ["s12", "o12"], N).withColumns({"s12": near("s12"), "o12": near("o12")})


def _passes(name: str, m: np.ndarray, f: Callable[[DataFrame], DataFrame], n: int = N):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return elements.points(f(fields(spark, sf_dir).drop("label")).select("elem_id", "u"), ["u"], n).withColumn("u", near("u"))

    run.__name__ = name
    return query(three_passes(m))(run)


_LOW = basis.low_pass(N, 2, 0.5)
legendre_transform = _passes("legendre_transform", basis.to_modal(N), lambda df: calculus.to_modal(df, "u", "u"))
spatial_filter = _passes("spatial_filter", basis.spatial_filter(_LOW), lambda df: calculus.spatial_filter(df, "u", _LOW))
p_refine = _passes("p_refine", basis.refine(N, 6), lambda df: calculus.p_refine(df, ["u"], 6), 6)
p_map = _passes("p_map", basis.refine(N, 5, True), lambda df: calculus.p_refine(df, ["u"], 5, True), 5)
legendre_round_trip = _passes("legendre_round_trip", np.eye(N), lambda df: calculus.to_nodal(calculus.to_modal(df, "u", "u"), "u", "u"))


@query(f"""WITH {values(basis.to_modal(N), "t")}, {NODES},
r AS (SELECT elem_id, k, j, t.a AS i, sum(m * u) AS u FROM nodes JOIN t ON t.b = i GROUP BY ALL),
s AS (SELECT elem_id, k, t.a AS j, i, sum(m * u) AS u FROM r JOIN t ON t.b = j GROUP BY ALL),
q AS (SELECT elem_id, t.a AS k, j, i, sum(m * u) AS u FROM s JOIN t ON t.b = k GROUP BY ALL)
SELECT elem_id, k, j, i, round(u, 6) + 0.0 AS u FROM q QUALIFY row_number() OVER (PARTITION BY elem_id ORDER BY abs(u) DESC, k, j, i) <= 16""")
def legendre_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compression.truncate(fields(spark, sf_dir).drop("label"), "u", 0.25)
    return elements.points(out, ["u"], N).where("u <> 0").withColumn("u", near("u"))


@query("""WITH v AS (SELECT vec_id AS elem_id, x AS node, CAST(embedding[x + 1] AS DOUBLE) AS u FROM embeddings, (SELECT unnest(range(64)) AS x))
SELECT elem_id, node, round(u, 6) + 0.0 AS u FROM v QUALIFY row_number() OVER (PARTITION BY elem_id ORDER BY abs(u) DESC, node) <= 8""")
def keep_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compression.keep_largest(fields(spark, sf_dir), "u", 8, "c").select("elem_id", F.posexplode("c").alias("node", "u")).where("u <> 0")
    return out.select("elem_id", F.col("node").cast("long").alias("node"), near("u").alias("u"))


@query("""SELECT vec_id AS elem_id, CAST(x AS BIGINT) AS node, CAST(embedding[x + 1] AS DOUBLE) AS u FROM embeddings, (SELECT unnest(range(64)) AS x)""")
def lossless_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compression.unpack(compression.pack(fields(spark, sf_dir).drop("label"), "u"), "u")
    return out.select("elem_id", F.posexplode("u").alias("node", "u")).withColumn("node", F.col("node").cast("long"))


@query()
def gaussian_process_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = compression.gp_compress(fields(spark, sf_dir).drop("label"), "u", 0.25, "dlt", 32)
    return compression.gp_restore(packed, "v").select("elem_id", F.size("nodes").alias("samples"), near(F.aggregate(F.zip_with("u", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x), 4).alias("error"))


@query(f"""WITH {vector(basis.gll(N)[0], "g")}, z(layer, lo, hi) AS (VALUES (0, 0.0, 1.0), (1, 1.0, 3.0))
SELECT vec_id AS elem_id, layer, CAST(g.a AS INTEGER) AS k, CAST(x // 4 AS INTEGER) AS j, CAST(x % 4 AS INTEGER) AS i, round(CAST(embedding[x + 1] AS DOUBLE), 6) + 0.0 AS u, round(CAST(lo + (w + 1) / 2 * (hi - lo) AS DOUBLE), 6) AS z
FROM embeddings, (SELECT unnest(range(16)) AS x), z, g""")
def extrude(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = fields(spark, sf_dir).select("elem_id", F.slice("u", 1, 16).alias("u"))
    return elements.points(calculus.extrude(flat, ["u"], [0.0, 1.0, 3.0]), ["u", "z"], N).withColumns({"u": near("u"), "z": near("z")})


_D8, _X8 = basis.derivative(basis.gll(8)[0]), basis.gll(8)[0]


@query(f"""WITH {values(_D8, "d")}, {vector(_X8, "g")}, p AS (SELECT vec_id, g.a AS i, CAST(embedding[g.a + 1] AS DOUBLE) AS u, w * (1 + vec_id % 3) AS y FROM embeddings, g)
SELECT vec_id AS elem_id, CAST(d.a AS BIGINT) AS i, round(sum(m * u) / sum(m * y), 6) + 0.0 AS du FROM p JOIN d ON d.b = p.i GROUP BY 1, 2""")
def profile_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.transform(F.array(*(F.lit(float(x)) for x in _X8)), lambda x: x * (1 + F.col("elem_id") % 3))
    p = fields(spark, sf_dir).select("elem_id", F.slice("u", 1, 8).alias("u"), y.alias("y"))
    out = calculus.profile_derivative(p, "u", "y", "du").select("elem_id", F.posexplode("du").alias("i", "du"))
    return out.select("elem_id", F.col("i").cast("long").alias("i"), near("du").alias("du"))


@query("""SELECT vec_id AS elem_id, round(list_sum(CAST([embedding[x * 4 + 1] FOR x IN range(16)] AS DOUBLE[])), 5) + 0.0 AS left_sum,
round(CAST(embedding[1] AS DOUBLE) + CAST(embedding[4] AS DOUBLE) + CAST(embedding[13] AS DOUBLE) + CAST(embedding[16] AS DOUBLE) + CAST(embedding[49] AS DOUBLE) + CAST(embedding[52] AS DOUBLE) + CAST(embedding[61] AS DOUBLE) + CAST(embedding[64] AS DOUBLE), 5) + 0.0 AS corner_sum FROM embeddings""")
def entity_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    add = lambda c: near(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 5)
    return fields(spark, sf_dir).select("elem_id", add(elements.facet("u", "r-", N)).alias("left_sum"), add(elements.vertices("u", N)).alias("corner_sum"))


@query("""SELECT x AS node, CAST(x % 4 AS INTEGER) AS i, CAST((x // 4) % 4 AS INTEGER) AS j, CAST((x // 16) % 4 AS INTEGER) AS k, CAST(x // 64 AS BIGINT) AS e FROM (SELECT unnest(range(640)) AS x)""")
def node_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, j, k, e = elements.nonlinear_index(F.col("id"), N)
    parts = spark.range(640).select(i.alias("i"), j.alias("j"), k.alias("k"), e.alias("e"))
    return parts.select(elements.linear_index(F.col("i"), F.col("j"), F.col("k"), F.col("e"), N).alias("node"), "i", "j", "k", "e")


# A box mesh: element e has sides 1 + e % 2, 1 and 0.5 + e % 3 and begins at (3 e, 0, 0)


def box_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("elem_id").cast("double")
    xi = [float(v) for v in (basis.gll(N)[0] + 1) / 2]
    node = lambda axis: F.array(*(F.lit(xi[(p // N**axis) % N]) for p in range(N**3)))
    side = [1 + F.col("elem_id") % 2, F.lit(1), 0.5 + F.col("elem_id") % 3]
    start = [3 * e, F.lit(0.0), F.lit(0.0)]
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("elem_id"))
    along = lambda a: F.transform(node(a), lambda t: start[a] + t * side[a])
    return ids.select("elem_id", *(along(a).alias(c) for a, c in enumerate("xyz")))


@query("SELECT vec_id AS elem_id, round(CAST((1 + vec_id % 2) * (0.5 + vec_id % 3) AS DOUBLE), 6) AS volume FROM embeddings")
def mesh_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = calculus.geometry(box_mesh(spark, sf_dir))
    return g.select("elem_id", near(F.aggregate("b", F.lit(0.0), lambda a, x: a + x)).alias("volume"))


@query("SELECT vec_id AS elem_id, CAST(2 AS DOUBLE) AS dfdx, CAST(3 AS DOUBLE) AS dfdy, CAST(-1 AS DOUBLE) AS dfdz FROM embeddings")
def physical_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = calculus.geometry(box_mesh(spark, sf_dir))
    f = F.transform(F.arrays_zip("x", "y", "z"), lambda p: 2 * p["x"] + 3 * p["y"] - p["z"])
    out = calculus.gradient(g.withColumn("f", f), ["f"])
    mid = lambda c: near((F.array_max(c) + F.array_min(c)) / 2)
    return out.select("elem_id", *(mid(c).cast("double").alias(c) for c in ("dfdx", "dfdy", "dfdz")))


@query("""SELECT vec_id AS elem_id, facet, round(area, 6) AS area FROM embeddings, LATERAL (SELECT unnest(['r-', 'r+', 's-', 's+', 't-', 't+']) AS facet,
  unnest([0.5 + vec_id % 3, 0.5 + vec_id % 3, (1 + vec_id % 2) * (0.5 + vec_id % 3), (1 + vec_id % 2) * (0.5 + vec_id % 3), 1 + vec_id % 2, 1 + vec_id % 2]::DOUBLE[]) AS area)""")
def facet_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = calculus.facet_geometry(box_mesh(spark, sf_dir))
    return out.select("elem_id", "facet", near(F.aggregate("area", F.lit(0.0), lambda a, x: a + x)).alias("area"))


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, p = F.col("vec_id"), F.col("vec_id") % 10
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(e.alias("probe_id"), (3 * e + (1 + e % 2) * (0.05 + p * 0.09)).alias("x"), (0.07 + p * 0.08).alias("y"), ((0.5 + e % 3) * (0.9 - p * 0.07)).alias("z"))


@query("""SELECT vec_id AS probe_id, vec_id AS elem_id, 1 AS err_code, round(CAST(3 * vec_id + (1 + vec_id % 2) * (0.05 + vec_id % 10 * 0.09) AS DOUBLE), 5) AS x,
round(CAST(0.07 + vec_id % 10 * 0.08 AS DOUBLE), 5) AS y, round(CAST((0.5 + vec_id % 3) * (0.9 - vec_id % 10 * 0.07) AS DOUBLE), 5) AS z FROM embeddings""")
def locate_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = box_mesh(spark, sf_dir)
    places = locate.locate(_probes(spark, sf_dir), mesh, (2.0, 1.0, 2.0))
    values_ = locate.interpolate(places, mesh, ["x", "y", "z"])
    return places.select("probe_id", "elem_id", "err_code").join(values_, "probe_id").withColumns({c: near(c, 5) for c in "xyz"})


_RST = (0.3, -0.2, 0.55)
_L = [basis.lagrange(basis.gll(N)[0], a)[0] for a in _RST]


@query(f"""WITH {vector(_L[0], "l0")}, {vector(_L[1], "l1")}, {vector(_L[2], "l2")}, {NODES}
SELECT elem_id, round(sum(u * l0.w * l1.w * l2.w), 6) + 0.0 AS value FROM nodes JOIN l0 ON l0.a = i JOIN l1 ON l1.a = j JOIN l2 ON l2.a = k GROUP BY elem_id""")
def probe_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.interpolate_at(fields(spark, sf_dir), "u", _RST, "value", N).select("elem_id", near("value").alias("value"))


@query("""SELECT p_partkey, CAST(least(9, greatest(0, floor((p_retailprice - 900) / 10))) + 10 * least(4, greatest(0, floor((p_size - 1) / 10.0))) AS BIGINT) AS bin FROM part""")
def bin_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", locate.bins([F.col("p_retailprice"), F.col("p_size")], [900.0, 1.0], [10.0, 10.0], [10, 5]).alias("bin"))


@query("""WITH b AS (SELECT p_brand AS elem_id, min(p_retailprice) + 20 AS x_min, min(p_retailprice) + 35 AS x_max, 10.0 AS y_min, 22.0 AS y_max FROM part GROUP BY p_brand)
SELECT p_partkey AS probe_id, elem_id FROM part, b WHERE p_retailprice BETWEEN x_min AND x_max AND p_size BETWEEN y_min AND y_max""")
def range_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    low = F.min("p_retailprice")
    b = part.groupBy(F.col("p_brand").alias("elem_id")).agg((low + 20).alias("x_min"), (low + 35).alias("x_max")).withColumns({"y_min": F.lit(10.0), "y_max": F.lit(22.0)})
    p = part.select(F.col("p_partkey").alias("probe_id"), F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    return locate.candidates(p, b, (15.0, 12.0), ("x", "y")).select("probe_id", "elem_id")


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY abs(o_totalprice - 1000), o_orderkey) = 1""")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return locate.nearest(pairs, "o_custkey", [F.abs(F.col("o_totalprice") - 1000), F.col("o_orderkey")])


# Topology


@query("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_partkey) AS multiplicity FROM lineitem")
def multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return topology.multiplicity(lines, ["l_partkey"]).drop("l_partkey")


@query("""SELECT l_orderkey, l_linenumber, floor(avg(l_extendedprice) OVER (PARTITION BY l_partkey) * 10000 + 0.5) / 10000 AS price FROM lineitem""")
def dssum(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("price"))
    return topology.dssum(lines, ["price"], ["l_partkey"]).drop("l_partkey").withColumn("price", F.floor(F.col("price") * 10000 + 0.5) / 10000)


@query("SELECT o_orderkey FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) = 1")
def boundary_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    return topology.boundary(entities).select("o_orderkey")


@query("""SELECT s_nationkey AS nation, count(*) AS members, min(s_suppkey) AS first, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) AS ids
FROM supplier GROUP BY s_nationkey HAVING count(*) > 1""")
def shared_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("elem_id"), F.lit(0).alias("entity"))
    ids = F.transform("members", lambda m: m["elem_id"].cast("string"))
    return topology.shared(e).select(F.col("key").alias("nation"), F.size("members").cast("long").alias("members"), F.col("members")[0]["elem_id"].alias("first"), F.array_join(ids, ",").alias("ids"))


@query("""SELECT DISTINCT a.s_suppkey AS elem_id, b.s_suppkey AS other FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey""")
def shared_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("elem_id"))
    return topology.neighbours(e)


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON abs(s_acctbal - c_acctbal) <= 2")
def tolerance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("x"))
    return topology.within(s, c, 2.0, ["x"]).select("s_suppkey", F.col("r_c_custkey").alias("c_custkey"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49 AND l_discount > 0.05)")
def element_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return topology.partition(lines, (F.col("l_quantity") >= 49) & (F.col("l_discount") > 0.05), "l_orderkey").select("l_orderkey", "l_linenumber")


@query("""WITH b AS (SELECT vec_id AS elem_id, CAST(list_min(embedding[1:32]) AS DOUBLE) AS a, CAST(list_max(embedding[1:32]) AS DOUBLE) AS b,
CAST(list_min(embedding[33:64]) AS DOUBLE) AS c, CAST(list_max(embedding[33:64]) AS DOUBLE) AS d FROM embeddings)
SELECT elem_id FROM b WHERE (a + b) / 2 > -0.02 AND (a + b) / 2 < 0.05 AND (c + d) / 2 > -0.1 AND (c + d) / 2 < 0.03""")
def subdomain(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fields(spark, sf_dir).select("elem_id", F.slice("u", 1, 32).alias("x"), F.slice("u", 33, 32).alias("y"))
    return topology.subdomain(m, {"x": (-0.02, 0.05), "y": (-0.1, 0.03)}).select("elem_id")


@query("""SELECT vec_id AS elem_id, CAST(list_min(embedding) AS DOUBLE) AS u_min, CAST(list_max(embedding) AS DOUBLE) AS u_max FROM embeddings""")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.bounding_box(fields(spark, sf_dir), ["u"]).select("elem_id", "u_min", "u_max")


@query("""WITH n AS (SELECT count(*) AS n FROM embeddings), p AS (SELECT n // 7 AS size, n % 7 AS more FROM n)
SELECT vec_id AS elem_id, CAST(CASE WHEN vec_id < more * (size + 1) THEN vec_id // (size + 1) ELSE (vec_id - more * (size + 1)) // size + more END AS INTEGER) AS rank FROM embeddings, p""")
def redistribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("elem_id"))
    return topology.balanced_ranks(e, 7, e.count())


@query("""WITH c AS (SELECT p_partkey AS elem_id, p_brand AS section, CAST(p_size AS DOUBLE) AS x, floor(p_retailprice / 50) AS y FROM part),
g AS (SELECT x, y, list(elem_id ORDER BY section, elem_id) AS ids FROM c GROUP BY x, y)
SELECT x, y, ids[1] AS source, CAST(len(ids) - 1 AS BIGINT) AS copies, coalesce(list_sum(ids[2:]), 0)::BIGINT AS copy_sum FROM g""")
def grouped_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("elem_id"), F.col("p_brand").alias("section"), F.col("p_size").cast("double").alias("x"), F.floor(F.col("p_retailprice") / 50).cast("double").alias("y"))
    out = topology.grouped_sections(c, "section")
    return out.select("place.x", "place.y", "source", F.size("copies").cast("long").alias("copies"), F.aggregate("copies", F.lit(0).cast("long"), lambda a, x: a + x).alias("copy_sum"))


# Tensors


_P = "WITH p AS (SELECT vec_id AS elem_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS v{i}" for i in range(12)) + " FROM embeddings), r AS (SELECT *, cos(atan2(v10, v9)) AS c, sin(atan2(v10, v9)) AS s FROM p)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields(spark, sf_dir).select("elem_id", *(F.col("u")[i].alias(f"v{i}") for i in range(12)))


@query(f"{_P} SELECT elem_id, round(c * v0 + s * v1, 6) + 0.0 AS rot_v0, round(c * v1 - s * v0, 6) + 0.0 AS rot_v1, round(v2, 6) + 0.0 AS rot_v2 FROM r")
def rotate_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tensors.rotate(_points(spark, sf_dir), ["v0", "v1", "v2"], at=("v9", "v10", "v11"))
    return out.select("elem_id", *(near(f"rot_v{i}").alias(f"rot_v{i}") for i in range(3)))


@query(f"""{_P} SELECT elem_id, round(c * c * v0 + c * s * (v1 + v3) + s * s * v4, 6) + 0.0 AS rot_v0, round(c * c * v1 - c * s * v0 + c * s * v4 - s * s * v3, 6) + 0.0 AS rot_v1,
round(c * v2 + s * v5, 6) + 0.0 AS rot_v2, round(c * v7 - s * v6, 6) + 0.0 AS rot_v7, round(v8, 6) + 0.0 AS rot_v8 FROM r""")
def rotate_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tensors.rotate(_points(spark, sf_dir), [f"v{i}" for i in range(9)], at=("v9", "v10", "v11"))
    return out.select("elem_id", *(near(f"rot_v{i}").alias(f"rot_v{i}") for i in (0, 1, 2, 7, 8)))


@query("""WITH p AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS u, CAST(embedding[2] AS DOUBLE) AS v, CAST(embedding[3] AS DOUBLE) AS w FROM embeddings)
SELECT label, round(avg(u * u) - avg(u) * avg(u), 8) + 0.0 AS r11, round(avg(v * v) - avg(v) * avg(v), 8) + 0.0 AS r22, round(avg(w * w) - avg(w) * avg(w), 8) + 0.0 AS r33,
round(avg(u * v) - avg(u) * avg(v), 8) + 0.0 AS r12, round(avg(u * w) - avg(u) * avg(w), 8) + 0.0 AS r13, round(avg(v * w) - avg(v) * avg(w), 8) + 0.0 AS r23 FROM p GROUP BY label""")
def reynolds_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = [F.col("u")[i] for i in range(3)]
    m = [F.avg(c) for c in u]
    s = [F.avg(u[i - 1] * u[j - 1]) for i, j in tensors.SIX]
    return fields(spark, sf_dir).groupBy("label").agg(*(near(c, 8).alias(f"r{i}{j}") for (i, j), c in zip(tensors.SIX, tensors.reynolds_stress(m, s), strict=True)))


@query("""WITH m AS (SELECT event_type, avg(value) AS p, avg(value * value) AS p2, avg(value * value * value) AS p3, avg(value * value * value * value) AS p4 FROM events GROUP BY event_type),
c AS (SELECT *, p2 - p * p AS m2 FROM m), d AS (SELECT *, p3 - p * p * p - 3 * p * m2 AS m3 FROM c)
SELECT event_type, round(m2, 2) + 0.0 AS m2, round(m3 / 1e6, 4) + 0.0 AS m3, round((p4 - p * p * p * p - 6 * p * p * m2 - 4 * p * m3) / 1e9, 4) + 0.0 AS m4 FROM d""")
def central_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    raw = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg(v).alias("p"), F.avg(v * v).alias("p2"), F.avg(v * v * v).alias("p3"), F.avg(v * v * v * v).alias("p4"))
    m2, m3, m4 = tensors.central_moments(*(F.col(c) for c in ("p", "p2", "p3", "p4")))
    return raw.select("event_type", near(m2, 2).alias("m2"), near(m3 / 1e6, 4).alias("m3"), near(m4 / 1e9, 4).alias("m4"))


_STATS = {"u": "u", "v": "v", "w": "w", "p": "p", "pp": "p*p"} | {n: "*".join(n) for n in "uu vv ww uv uw vw uuu vvv www uuv uuw uvv uvw uww vvw vww uuuu vvvv wwww ppp pppp pu pv pw".split()}


@query("WITH q AS (SELECT vec_id AS elem_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate("uvwp")) + " FROM embeddings) SELECT elem_id, " + ", ".join(f"round({x}, 7) + 0.0 AS {n}" for n, x in _STATS.items()) + " FROM q")
def augmented_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = [F.col("u")[i] for i in range(4)]
    return fields(spark, sf_dir).select("elem_id", *(near(c, 7).alias(n) for n, c in tensors.augmented(u[:3], u[3]).items()))


def budget_inputs() -> list[str]:
    three = (1, 2, 3)
    second = [tensors._name(*ij) for ij in tensors.SIX]
    third = [tensors._name(*ijk) for ijk in tensors.combinations_with_replacement(three, 3)]
    names = [f"u{i}" for i in three] + second + third + [tensors._name(i, i, i, i) for i in three] + ["p", "pp", "ppp", "pppp"]
    names += [f"d{k}_{x}" for x in [*(f"u{i}" for i in three), *second, *third, "p", *(f"pu{i}" for i in three)] for k in three]
    names += [f"dd{k}_{x}" for x in [*(f"u{i}" for i in three), *second] for k in three]
    return names + [f"pd{j}_u{i}" for i in three for j in three] + [f"e{i}{j}" for i, j in tensors.SIX]


_IN = budget_inputs()
_RE = 180.0


@query("WITH q AS (SELECT vec_id AS elem_id, " + ", ".join(f"CAST(embedding[{k % 64 + 1}] AS DOUBLE) * {1 + k // 64} AS {n}" for k, n in enumerate(_IN)) + f""" FROM embeddings),
r AS (SELECT *, u1u1 - u1*u1 AS r11, u2u2 - u2*u2 AS r22, u1u2 - u1*u2 AS r12, u1u3 - u1*u3 AS r13, u2u3 - u2*u3 AS r23,
 d1_u1u2 - u1*d1_u2 - u2*d1_u1 AS x1, d2_u1u2 - u1*d2_u2 - u2*d2_u1 AS x2, d3_u1u2 - u1*d3_u2 - u2*d3_u1 AS x3,
 d1_u1u1 - 2*u1*d1_u1 AS y1, d3_u1u3 - u1*d3_u3 - u3*d3_u1 AS y3, d2_u2u2 - 2*u2*d2_u2 AS z2, d3_u2u3 - u2*d3_u3 - u3*d3_u2 AS z3 FROM q),
t AS (SELECT *, -(r11*d1_u2 + r12*d2_u2 + r13*d3_u2 + r12*d1_u1 + r22*d2_u1 + r23*d3_u1) AS prod, -(u1*x1 + u2*x2 + u3*x3) AS conv,
 u1*d1_u1 + u2*d2_u1 + u3*d3_u1 AS c1, u1*d1_u2 + u2*d2_u2 + u3*d3_u2 AS c2 FROM r)
SELECT elem_id, round(prod, 7) + 0.0 AS production_12, round(conv, 7) + 0.0 AS convection_12, round(c1, 7) + 0.0 AS momentum_convection_1,
 round(-2/{_RE} * (e12 - d1_u1*d1_u2 - d2_u1*d2_u2 - d3_u1*d3_u2), 8) + 0.0 AS dissipation_12,
 round((dd1_u1u2 + dd2_u1u2 + dd3_u1u2 - u1*(dd1_u2 + dd2_u2 + dd3_u2) - u2*(dd1_u1 + dd2_u1 + dd3_u1) - 2*(d1_u1*d1_u2 + d2_u1*d2_u2 + d3_u1*d3_u2)) / {_RE}, 8) + 0.0 AS viscous_diffusion_12,
 round(pd2_u1 - p*d2_u1 + pd1_u2 - p*d1_u2, 7) + 0.0 AS pressure_strain_12,
 round(-(d2_pu1 - p*d2_u1 - u1*d2_p + d1_pu2 - p*d1_u2 - u2*d1_p), 7) + 0.0 AS pressure_transport_12,
 round(-(d1_u1u1u2 + d2_u1u2u2 + d3_u1u2u3) + u1*c2 + u2*c1 + u1*(x1 + z2 + z3) + u2*(y1 + x2 + y3) - conv - prod, 7) + 0.0 AS turbulent_transport_12,
 round((dd1_u1 + dd2_u1 + dd3_u1) / {_RE} - (y1 + x2 + y3) - d1_p - c1, 7) + 0.0 AS momentum_residual_1,
 round(u1u1u2 - u1*u1*u2 - 2*u1*r12 - u2*r11, 7) + 0.0 AS "T112"
FROM t""")
def reynolds_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fields(spark, sf_dir).select("elem_id", *((F.col("u")[k % 64] * float(1 + k // 64)).alias(n) for k, n in enumerate(_IN)))
    digits = {"dissipation_12": 8, "viscous_diffusion_12": 8}
    names = ["production_12", "convection_12", "momentum_convection_1", "dissipation_12", "viscous_diffusion_12", "pressure_strain_12", "pressure_transport_12", "turbulent_transport_12", "momentum_residual_1", "T112"]
    return tensors.budgets(df, _RE).select("elem_id", *(near(c, digits.get(c, 7)).alias(c) for c in names))


@query("""WITH m AS (SELECT label, avg(2 * 0.01 * CAST(embedding[1] AS DOUBLE) * CAST(embedding[1] AS DOUBLE) + 4 * 0.01 * CAST(embedding[4] AS DOUBLE) * CAST(embedding[4] AS DOUBLE)) AS eps FROM embeddings GROUP BY label)
SELECT label, round(eps, 9) AS eps, round(pow(pow(0.01, 3) / eps, 0.25), 6) AS eta FROM m""")
def kolmogorov_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0.0)
    eps = F.avg(calculus.dissipation([F.col("u")[0], zero, zero, F.col("u")[3], zero, zero], 0.01))
    out = fields(spark, sf_dir).groupBy("label").agg(eps.alias("eps"))
    return out.select("label", F.round("eps", 9).alias("eps"), F.round(calculus.kolmogorov(F.col("eps"), 0.01), 6).alias("eta"))


_HALF = np.concatenate(([basis.gll(N)[0][1] + 1], basis.gll(N)[0][2:] - basis.gll(N)[0][:-2], [1 - basis.gll(N)[0][-2]])) / 2


@query(f"""WITH {vector(_HALF, "h")}, n AS (SELECT unnest(range(64)) AS x)
SELECT vec_id AS elem_id, x AS node, round(a.w * (1 + vec_id % 2) / 2, 6) AS dx, round(b.w / 2, 6) AS dy, round(c.w * (0.5 + vec_id % 3) / 2, 6) AS dz
FROM embeddings, n JOIN h a ON a.a = x % 4 JOIN h b ON b.a = (x // 4) % 4 JOIN h c ON c.a = x // 16""")
def mesh_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = statistics.spacing(box_mesh(spark, sf_dir)).select("elem_id", F.posexplode(F.arrays_zip("dx", "dy", "dz")).alias("node", "s"))
    return s.select("elem_id", F.col("node").cast("long").alias("node"), *(near(f"s.{c}").alias(c) for c in ("dx", "dy", "dz")))


@query("""SELECT user_id, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'view'), 6) AS view FROM events GROUP BY user_id""")
def statistics_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2)
    rows = table(spark, sf_dir, "events").withColumn("field_id", kinds)
    return statistics.pivot(rows, {1: "click", 2: "view"}, ["user_id"], lambda c: F.round(F.avg(c), 6))


# Reduced-order models


@query("""WITH v AS (SELECT vec_id, x AS i, CAST(embedding[x + 1] AS DOUBLE) AS u FROM embeddings, (SELECT unnest(range(64)) AS x))
SELECT a.i AS i, b.i AS j, round(sum(a.u * b.u), 6) + 0.0 AS value FROM v a JOIN v b USING (vec_id) GROUP BY 1, 2""")
def pod_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rom.gram(fields(spark, sf_dir), "u").withColumn("value", near("value"))


@query()
def pod_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    dec = rom.pod(fields(spark, sf_dir), "u", 5)
    return dec.modes.select("elem_id", F.posexplode("modes").alias("mode", "phi")).withColumn("phi", near("phi"))


@query("""SELECT vec_id AS elem_id, x AS node, round(CAST(embedding[x + 1] AS DOUBLE), 5) + 0.0 AS value FROM embeddings, (SELECT unnest(range(64)) AS x)""")
def pod_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    dec = rom.pod(fields(spark, sf_dir), "u", 64)
    out = rom.reconstruct(dec, range(64), range(64)).select("elem_id", F.posexplode("value").alias("node", "value"))
    return out.select("elem_id", F.col("node").cast("long").alias("node"), near("value", 5).alias("value"))


@query("""WITH v AS (SELECT vec_id AS elem_id, x, CAST(embedding[x + 1] AS DOUBLE) AS u FROM embeddings, (SELECT unnest(range(8)) AS x)), k AS (SELECT unnest(range(5)) AS kappa)
SELECT elem_id, CAST(kappa AS INTEGER) AS kappa, round(sum(u * cos(2 * pi() * kappa * x / 8)) / sqrt(8) * CASE WHEN kappa IN (0, 4) THEN 1 ELSE sqrt(2) END, 6) + 0.0 AS re,
round(-sum(u * sin(2 * pi() * kappa * x / 8)) / sqrt(8) * CASE WHEN kappa IN (0, 4) THEN 1 ELSE sqrt(2) END, 6) + 0.0 AS im FROM v, k GROUP BY elem_id, kappa""")
def fourier_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fields(spark, sf_dir).select("elem_id", F.slice("u", 1, 8).alias("u"))
    return rom.fourier(p, "u").withColumns({"re": near("re"), "im": near("im")})


@query()
def fourier_pod(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fields(spark, sf_dir).select((F.col("elem_id") % 8).alias("snapshot"), F.floor(F.col("elem_id") / 8).alias("point"), F.slice("u", 1, 8).alias("u"))
    return rom.fourier_pod(rom.fourier(p, "u"), 3).select("kappa", "mode", "snapshot", near("d").alias("d"))


@query("""WITH v AS (SELECT vec_id AS elem_id, label, x AS point, CAST(embedding[x + 1] AS DOUBLE) AS value FROM embeddings, (SELECT unnest(range(64)) AS x))
SELECT elem_id, point, round(value - avg(value) OVER (PARTITION BY point), 7) + 0.0 AS value FROM v""")
def centred_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fields(spark, sf_dir).select("elem_id", F.posexplode("u").alias("point", "value")).withColumn("point", F.col("point").cast("long"))
    return reductions.centred(s).select("elem_id", "point", near("value", 7).alias("value"))


# Points and orientation


@query("""WITH p AS (SELECT x AS i, 0.5 - 0.5 * cos(pi() * x / 29) AS c, tanh(2.0 * (2 * x / 29.0 - 1)) / tanh(2.0) AS t, CAST(x / 29.0 AS DOUBLE) AS e FROM (SELECT unnest(range(30)) AS x))
SELECT i, round(c, 9) + 0.0 AS cheb, round(0.5 + 0.5 * t, 9) + 0.0 AS tanh, round((coalesce(lead(c) OVER w, c) - coalesce(lag(c) OVER w, c)) / 2, 9) + 0.0 AS dx FROM p WINDOW w AS (ORDER BY i)""")
def grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    cheb = pointclouds.spacing(pointclouds.line(spark, 0.0, 1.0, 30, "cheb"))
    tanh = pointclouds.line(spark, 0.0, 1.0, 30, "tanh", 2.0).withColumnRenamed("x", "t")
    return cheb.join(tanh, "i").select("i", near("x", 9).alias("cheb"), near("t", 9).alias("tanh"), near("dx", 9).alias("dx"))


@query("""WITH a AS (SELECT unnest(range(10)) AS i), r AS (SELECT i, i / 9.0 * 0.05 AS r, CASE WHEN i IN (0, 9) THEN 0.5 ELSE 1 END * 0.05 / 9 AS dr FROM a)
SELECT r.i AS i, t.i AS j, z.i AS k, round(r * dr * (2 * pi() / 10) * CASE WHEN z.i IN (0, 9) THEN 0.5 ELSE 1 END / 9.0 * 1e6, 6) + 0.0 AS mass FROM r, a t, a z""")
def cylinder_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = 2 * float(np.pi)
    r = pointclouds.spacing(pointclouds.line(spark, 0.0, 0.05, 10))
    th = pointclouds.spacing(pointclouds.line(spark, 0.0, turn, 10, endpoint=False), period=turn)
    z = pointclouds.spacing(pointclouds.line(spark, 0.0, 1.0, 10))
    return pointclouds.cylinder(r, th, z).select("i", "j", "k", near(F.col("mass") * 1e6).alias("mass"))


@query("SELECT vec_id AS elem_id, 'x,y,z' AS mapping, 'x,y,z' AS by_normals FROM embeddings")
def element_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = box_mesh(spark, sf_dir).select("elem_id", *(F.reverse(c).alias(c) for c in "xyz"))
    out = orientation.mappings(orientation.aligned(turned))
    return out.select("elem_id", F.array_join("mapping", ",").alias("mapping"), F.array_join("by_normals", ",").alias("by_normals"))


@query("""SELECT vec_id AS probe_id, CAST(vec_id // 100 AS BIGINT) AS i, CAST((vec_id // 10) % 10 AS BIGINT) AS j, vec_id % 10 AS k FROM embeddings""")
def grid_and_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("probe_id"))
    grid = probes.list_to_grid(e, (0, 10, 10)).drop("probe_id")
    return probes.grid_to_list(grid, (0, 10, 10)).select("probe_id", "i", "j", "k")


# Files


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or f"file://{tempfile.mkdtemp(prefix='semspark-')}"
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


@query("""SELECT vec_id AS elem_id, x AS node, 2 * CAST(embedding[x + 1] AS DOUBLE) AS s0 FROM embeddings, (SELECT unnest(range(64)) AS x)""")
def field_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fields(spark, sf_dir).select("elem_id", F.col("u").alias("p"), F.transform("u", lambda x: 2 * x).alias("s0"))
    path = folder(spark)
    fld.write(e, path, "field", 1, 2.5, 7, 8, 3)
    got = fld.read(spark, f"{path}/field*.f00001", ["s0"])
    return got.select("elem_id", F.posexplode("s0").alias("node", "s0")).withColumn("node", F.col("node").cast("long"))


@query("""SELECT f AS fname, CAST(count(*) AS BIGINT) AS elements, 2.5 AS time FROM (SELECT 1) o, (VALUES ('field0.f00001'), ('field1.f00001')) t(f), embeddings WHERE vec_id % 2 = CAST(substr(f, 6, 1) AS INTEGER) GROUP BY f""".replace("2.5 AS time", "CAST(2.5 AS DOUBLE) AS time"))
def field_file_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fields(spark, sf_dir).withColumn("elem_id", F.col("elem_id") % 2 * 10_000_000 + F.col("elem_id")).select("elem_id", F.col("u").alias("p"))
    path = folder(spark)
    for part in (0, 1):
        half = e.where(F.floor(F.col("elem_id") / 10_000_000) == part)
        fld.write(half, f"{path}/{part}", "field", 1, 2.5)
    heads = [fld.headers(spark, f"{path}/{part}/field0.f00001").withColumn("fname", F.lit(f"field{part}.f00001")) for part in (0, 1)]
    return heads[0].unionByName(heads[1]).select("fname", "elements", "time")


@query(f"""WITH {_EVENTS} SELECT CAST(row_number() OVER w - 1 AS INTEGER) AS idx, 'out' || event_id AS fname, time, round(time - coalesce(lag(time) OVER w, 5.0), 3) AS time_interval, CAST(5 AS DOUBLE) AS start_time
FROM e WINDOW w AS (ORDER BY time, event_id)""")
def index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("time", seconds(F.col("ts")))
    rows = timeaverage.intervals(e, "time", [], ["event_id"], 5.0).withColumn("fname", F.concat(F.lit("out"), F.col("event_id")))
    path = folder(spark)
    index.write_json(rows, path, 5.0)
    return index.read_json(spark, path).select("idx", "fname", "time", F.round("time_interval", 3).alias("time_interval"), "start_time")


@query("""SELECT vec_id % 20 AS probe_id, CAST(vec_id // 20 AS BIGINT) AS snapshot, CAST(vec_id // 20 AS DOUBLE) AS t, CAST(embedding[1] AS DOUBLE) AS u FROM embeddings""")
def probe_series_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fields(spark, sf_dir)
    points = e.where("elem_id < 20").select(F.col("elem_id").alias("probe_id"), *(F.col("u")[i].alias(a) for i, a in enumerate("xyz")))
    s = F.floor(F.col("elem_id") / 20)
    series = e.select((F.col("elem_id") % 20).alias("probe_id"), s.alias("snapshot"), s.cast("double").alias("t"), F.col("u")[0].alias("u"))
    path = folder(spark)
    probes.write_series(points, series, ["u"], path)
    return probes.read_series(spark, path)[1]


# More of the reduced-order models


@query("SELECT CAST(1 AS BIGINT) AS n, round(sum(u * u), 5) AS energy FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS u FROM embeddings)")
def streaming_pod_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All modes of 64 snapshots, a point for each element, in four batches, hold the snapshots' energy."""
    rows, state = fields(spark, sf_dir), rom.Streaming(["elem_id"], 64)
    for i in range(0, 64, 16):
        state.update(rows.select("elem_id", F.slice("u", i + 1, 16).alias("u")), "u")
    return spark.createDataFrame([(1, round(float((state.d**2).sum()), 5))], "n long, energy double")

