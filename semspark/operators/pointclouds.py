"""Point generators: one-dimensional distributions, spacings and structured clouds with their mass."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def line(spark: SparkSession, lo: float, hi: float, n: int, mode: str = "equal", gain: float = 1.0, endpoint: bool = True) -> DataFrame:
    """(i, x): n points from lo to hi; equal, cheb, tanh (dense at both ends) or half_tanh (dense at hi)."""
    i = F.col("i").cast("double")
    steps = n - 1 if endpoint else n
    s = i / max(steps, 1)
    if mode == "equal":
        x = lo + (hi - lo) * s
    elif mode == "cheb":
        x = (lo + hi) / 2 - (hi - lo) / 2 * F.cos(math.pi * s)
    elif mode == "tanh":
        x = (lo + hi) / 2 + (hi - lo) / 2 * F.tanh(gain * (2 * s - 1)) / math.tanh(gain)
    elif mode == "half_tanh":
        x = lo + (hi - lo) * F.tanh(gain * s) / math.tanh(gain)
    else:
        raise ValueError(f"no distribution {mode}")
    return spark.range(n).select(F.col("id").alias("i")).select("i", x.alias("x"))


def spacing(points: DataFrame, x: str = "x", order: str = "i", by: Sequence[str] = (), period: float | None = None) -> DataFrame:
    """Append dx: half the distance between both neighbours; at an end half that to the one, or around a period."""
    w = Window.partitionBy(*by).orderBy(order)
    back, ahead, here = F.lag(x).over(w), F.lead(x).over(w), F.col(x)
    if period is None:
        return points.withColumn("dx", (F.coalesce(ahead, here) - F.coalesce(back, here)) / 2)
    ends = Window.partitionBy(*by)
    first, last = F.min(x).over(ends), F.max(x).over(ends)
    raw = (F.coalesce(ahead, first + period) - F.coalesce(back, last - period)) / 2
    out = points.withColumn("dx", raw)
    return out.withColumn("dx", F.col("dx") * period / F.sum("dx").over(ends))


def cylinder(r: DataFrame, theta: DataFrame, z: DataFrame) -> DataFrame:
    """The cloud of three axes (i, x, dx): x, y, z, r, th, mass = r dr dth dz and mass_area = r dr dth.

    The axes are a few hundred values each; the cloud is their stated product.
    """
    axis = lambda df, i, x, d: df.select(F.col("i").alias(i), F.col("x").alias(x), F.col("dx").alias(d))
    cloud = axis(r, "i", "r", "dr").crossJoin(F.broadcast(axis(theta, "j", "th", "dth"))).crossJoin(F.broadcast(axis(z, "k", "z", "dz")))
    area = F.col("r") * F.col("dr") * F.col("dth")
    return cloud.select("i", "j", "k", (F.col("r") * F.cos("th")).alias("x"), (F.col("r") * F.sin("th")).alias("y"), "z", "r", "th", (area * F.col("dz")).alias("mass"), area.alias("mass_area"))


def vectors(elements: DataFrame, centre: Sequence[Column], axis: Sequence[Column]) -> dict[str, list[Column]]:
    """Unit radial, theta (= z x r) and axial vectors at element centres x, y, z."""
    def unit(v: list[Column]) -> list[Column]:
        size = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
        return [F.when(size > 0, c / size).otherwise(0.0) for c in v]

    r = unit([F.col(a) - c for a, c in zip("xyz", centre, strict=True)])
    z = unit(list(axis))
    theta = [z[1] * r[2] - z[2] * r[1], z[2] * r[0] - z[0] * r[2], z[0] * r[1] - z[1] * r[0]]
    return {"r": r, "theta": unit(theta), "z": z}
