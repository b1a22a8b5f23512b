"""Mass-weighted sums and means, over a domain, groups, elements, snapshots or homogeneous directions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_mean(value: Column, weight: Column) -> Column:
    """sum(f b) / sum(b): partial sums before any shuffle. Null without weight."""
    return F.sum(value * weight) / F.nullif(F.sum(weight), F.lit(0.0))


def glsum(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row: the sums of all values of the fields."""
    return df.agg(*(F.sum(c).alias(c) for c in fields))


def integral(df: DataFrame, fields: Sequence[str], mass: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*(F.sum(F.col(c) * F.col(mass)).alias(c) for c in fields))


def mean(df: DataFrame, fields: Sequence[str], mass: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*(weighted_mean(F.col(c), F.col(mass)).alias(c) for c in fields))


def element_mean(df: DataFrame, field: str, mass: str | Column, out: str) -> DataFrame:
    """Mean over an element's nodes, within its row: field and mass are arrays."""
    b = F.col(mass) if isinstance(mass, str) else mass
    add = lambda a, x: a + x
    top = F.aggregate(F.zip_with(F.col(field).cast("array<double>"), b, lambda f, w: f * w), F.lit(0.0), add)
    return df.withColumn(out, top / F.aggregate(b, F.lit(0.0), add))


def inspect(df: DataFrame, fields: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows (by, field, max, min, avg), by one scan of the wide table: fields are aggregated, then unpivoted."""
    stats = [f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in fields for n, f in (("max", F.max), ("min", F.min), ("avg", F.avg))]
    wide = df.groupBy(*by).agg(*stats)
    rows = F.array(*(F.struct(F.lit(c).alias("field"), *(F.col(f"{c}_{n}").alias(n) for n in ("max", "min", "avg"))) for c in fields))
    return wide.select(*by, F.inline(rows))


def nobm(df: DataFrame, fields: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Non-overlapping batch means: for each field its mean over the batches and the variance of that mean, <f>_var.

    The variance is that of the batches divided by their number, batches being of equal length.
    """
    return df.groupBy(*by).agg(*(x for c in fields for x in (F.avg(c).alias(c), (F.var_pop(c) / F.count(c)).alias(f"{c}_var"))))


def centroid_keys(mesh: DataFrame, n: int, direction: str, digits: int = 6) -> DataFrame:
    """Append c1, c2: the rounded centroid in the plane across a direction; elements stacked along it share them."""
    others = [a for a in "xyz" if a != direction]
    mid = lambda a: F.round((F.array_max(a) + F.array_min(a)) / 2, digits) + 0.0
    return mesh.withColumns({"c1": mid(others[0]), "c2": mid(others[1])})


def space_average(nodes: DataFrame, fields: Sequence[str], mass: str, direction: str, group: Sequence[str]) -> DataFrame:
    """Average along a homogeneous direction of the mesh: over the node axis along it and all elements of a group.

    nodes are rows (group, k, j, i, mass, fields); the result has a row for each group and node across the direction.
    """
    axis = {"x": "i", "y": "j", "z": "k"}[direction]
    return mean(nodes, fields, mass, [*group, *(a for a in ("k", "j", "i") if a != axis)])


def extrude_back(average: DataFrame, n: int, direction: str) -> DataFrame:
    """A slice again on all n planes along the direction."""
    axis = {"x": "i", "y": "j", "z": "k"}[direction]
    return average.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def projection(snapshots: DataFrame, modes: DataFrame, mass: str = "b") -> DataFrame:
    """Amplitudes a(mode, snapshot) = sum over points of mode * mass * (x - mean over snapshots).

    snapshots are (point, snapshot, value, b), modes (point, mode, phi). The mean needs no window over snapshots:
    sum(phi b x) - sum(phi b mean), both by aggregation.
    """
    centre = snapshots.groupBy("point").agg(F.avg("value").alias("centre"))
    joined = snapshots.join(centre, "point").join(modes, "point")
    return joined.groupBy("mode", "snapshot").agg(F.sum(F.col("phi") * F.col(mass) * (F.col("value") - F.col("centre"))).alias("a"))


def centred(snapshots: DataFrame, value: str = "value", by: Sequence[str] = ("point",)) -> DataFrame:
    """Snapshots less their mean at each point."""
    centre = snapshots.groupBy(*by).agg(F.avg(value).alias("_centre"))
    return snapshots.join(centre, list(by)).withColumn(value, F.col(value) - F.col("_centre")).drop("_centre")


def section_centres(elements: DataFrame, per_section: int, columns: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Mean centre of each run of per_section elements."""
    return elements.groupBy(F.floor(F.col("elem_id") / per_section).alias("section")).agg(*(F.avg(c).alias(c) for c in columns))


def element_centres(mesh: DataFrame, columns: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Each element's mean coordinates, within its row."""
    mid = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x) / F.size(c)
    return mesh.select("elem_id", *(mid(c).alias(c) for c in columns))


def galerkin(modes: DataFrame, weight: str = "b") -> tuple[DataFrame, DataFrame]:
    """Linear (m, n) and quadratic (k, m, n) products of modes (point, mode, phi, b), summed over points.

    Joined by point: a point has as many rows as there are modes, a bounded number.
    """
    one = modes.select("point", F.col("mode").alias("m"), F.col("phi").alias("pm"), F.col(weight).alias("w"))
    two = modes.select("point", F.col("mode").alias("n"), F.col("phi").alias("pn"))
    three = modes.select("point", F.col("mode").alias("k"), F.col("phi").alias("pk"))
    pair = one.join(two, "point")
    linear = pair.groupBy("m", "n").agg(F.sum(F.col("w") * F.col("pm") * F.col("pn")).alias("value"))
    quadratic = pair.join(three, "point").groupBy("k", "m", "n").agg(F.sum(F.col("w") * F.col("pk") * F.col("pm") * F.col("pn")).alias("value"))
    return linear, quadratic
