"""Mesh frames, facades and normals: points as rows or columns, axes numbered +x, -x, +y, -y, +z, -z from 0."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
RELIEF_RATIO, NOT_A_WALL, NEAR_WALL, LEAST_POINTS = 0.25, 0.5, 0.8, 8


def turned(axis: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Coordinates after the shortest rotation that takes the axis to +z."""
    return (
        F.when(axis == 0, -z).when(axis == 1, z).otherwise(x),
        F.when(axis == 2, -z).when(axis == 3, z).when(axis == 5, -y).otherwise(y),
        F.when(axis == 0, x).when(axis == 1, -x).when(axis == 2, y).when(axis == 3, -y).when(axis == 5, -z).otherwise(z),
    )


def front_angle(axis: Column) -> Column:
    """Angle of the model's front (+z) after that rotation; null where +z is vertical, as the front is unknown then."""
    x, y, _ = turned(axis, F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return F.when(axis < 4, F.atan2(y, x))


def rank_axes(scores: Column, most: int = 3) -> Column:
    """Axes of the best scores, best first; ties give the higher axis, null scores come last."""
    entry = F.transform(scores, lambda s, i: F.struct((-F.coalesce(s, F.lit(-math.inf))).alias("neg"), (-i).alias("i")))
    return F.transform(F.slice(F.array_sort(entry), 1, most), lambda e: -e["i"])


def canonicalise(points: DataFrame, key: str, axis: str) -> DataFrame:
    """``points`` (key, axis, x, y, z, ...) turned, centred in plan, the first height percentile at zero, and ``height``.

    One row of offsets a mesh is joined back; heights above that percentile count to the 99th, 1e-6 at least.
    """
    x, y, z = turned(F.col(axis), F.col("x"), F.col("y"), F.col("z"))
    t = points.withColumns({"x": x, "y": y, "z": z})
    frame = t.groupBy(key).agg(F.avg("x").alias("ox"), F.avg("y").alias("oy"), F.percentile("z", F.array(F.lit(0.01), F.lit(0.99))).alias("pz"))
    height = F.greatest(F.col("pz")[1] - F.col("pz")[0], F.lit(1e-6))
    moved = {"x": F.col("x") - F.col("ox"), "y": F.col("y") - F.col("oy"), "z": F.col("z") - F.col("pz")[0], "height": height}
    return t.join(frame, key).withColumns(moved).drop("ox", "oy", "pz")


def bas_relief(points: DataFrame, key: str, aspect: str) -> DataFrame:
    """(key, extent_ratio, is_relief) of canonical points; long footprints (``aspect``) may be as flat as they are long."""
    e = points.groupBy(key).agg((F.max("x") - F.min("x")).alias("ex"), (F.max("y") - F.min("y")).alias("ey"), F.first(aspect).alias("aspect"))
    long = F.greatest("ex", "ey")
    ratio = F.when(long > 1e-9, F.least("ex", "ey") / long).otherwise(1.0)
    relief = (F.col("extent_ratio") < RELIEF_RATIO) & ~(F.col("aspect") > 0.5 / F.greatest("extent_ratio", F.lit(1e-6)))
    return e.withColumn("extent_ratio", ratio).select(key, "extent_ratio", relief.alias("is_relief"))


def facade_detail(points: DataFrame, key: str) -> DataFrame:
    """(key, side, score) for the sides +x, +y, -x, -y of every mesh, shares of one.

    A side's score is its points a unit of wall against the mesh's mean, raised by the spread of their depth behind
    the wall and of their heights. Sides with under eight points score zero, and all do where none has more.
    """
    two = lambda c: F.percentile(c, F.array(F.lit(0.02), F.lit(0.98)))
    b = points.groupBy(key).agg(two("x").alias("px"), two("y").alias("py"), F.count("*").alias("n"))
    mid = lambda c: (F.col(c)[0] + F.col(c)[1]) / 2
    half = lambda c: F.greatest((F.col(c)[1] - F.col(c)[0]) / 2, F.lit(1e-9))
    b = b.select(key, "n", mid("px").alias("mx"), mid("py").alias("my"), half("px").alias("ex"), half("py").alias("ey"))
    q = points.join(b, key).withColumn("nx", (F.col("x") - F.col("mx")) / F.col("ex")).withColumn("ny", (F.col("y") - F.col("my")) / F.col("ey"))
    ax, ay = F.round(F.abs("nx"), 9), F.round(F.abs("ny"), 9)
    side = F.when(ax >= ay, F.when(F.col("nx") > 0, 0).otherwise(2)).otherwise(F.when(F.col("ny") > 0, 1).otherwise(3))
    depth = F.when(ax >= ay, (1 - F.abs("nx")) * F.col("ex")).otherwise((1 - F.abs("ny")) * F.col("ey"))
    s = q.where(F.greatest(ax, ay) >= NEAR_WALL).withColumn("side", side).withColumn("depth", depth)
    g = s.groupBy(key, "side").agg(F.count("*").alias("m"), F.stddev_pop("depth").alias("sd"), F.stddev_pop("z").alias("sz"), F.avg("z").alias("az"))
    wall = F.when(F.col("side") % 2 == 0, F.col("ey")).otherwise(F.col("ex"))
    density = F.col("m") / F.col("n") / (wall / (2 * (F.col("ex") + F.col("ey"))))
    raw = density * (1 + F.col("sd") / F.greatest(F.least("ex", "ey"), F.lit(1e-9))) * (1 + F.col("sz") / F.greatest("az", F.lit(1e-6)))
    four = b.withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(3)))).join(g, [key, "side"], "left")
    four = four.select(key, "side", F.when(F.col("m") >= LEAST_POINTS, raw).otherwise(0.0).alias("raw"))
    totals = four.groupBy(key).agg(F.sum("raw").alias("total"))
    return four.join(totals, key).select(key, "side", F.when(F.col("total") > 1e-9, F.col("raw") / F.col("total")).otherwise(F.col("raw")).alias("score"))


def snap_normal(x: Column, y: Column, z: Column, turn: Column, to_x: Column, to_y: Column) -> Column:
    """STRUCT<wall, off_deg, horizontal>: the nearest of four walls facing ``turn`` and its quarter turns, z up.

    Surfaces with less than half their normal horizontal (roofs, ground) are 90 degrees off; where nothing is
    horizontal the direction to the camera picks the wall, and without one the first does. Ties go to the lower wall.
    Normals of no length count as vertical.
    """
    length = F.sqrt(x * x + y * y + z * z)
    flat = F.when(length > 0, F.hypot(x, y) / length).otherwise(0.0)
    level, seen = flat > 1e-9, F.hypot(to_x, to_y) > 1e-9
    hx = F.when(level, x).when(seen, to_x).otherwise(F.cos(turn))
    hy = F.when(level, y).when(seen, to_y).otherwise(F.sin(turn))
    cosine = lambda k: (hx * F.cos(turn + k * (math.pi / 2)) + hy * F.sin(turn + k * (math.pi / 2))) / F.hypot(hx, hy)
    best = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct((-F.round(cosine(k), 9)).alias("neg"), k.alias("k"), cosine(k).alias("c"))))
    off = F.when(flat < NOT_A_WALL, 90.0).otherwise(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), best["c"])))))
    return F.struct(F.coalesce(best["k"], F.lit(0)).alias("wall"), off.alias("off_deg"), flat.alias("horizontal"))


def normal_bearing(m: Column, x: Column, y: Column, z: Column) -> Column:
    """Compass bearing of a normal under a 3 x 3 matrix (or larger) given by rows: the inverse transpose is applied, as cofactors over the determinant; singular ones give null."""
    cof = lambda i, j: m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
    det = sum((m[0][j] * cof(0, j) for j in (1, 2)), m[0][0] * cof(0, 0))
    east, north = ((cof(i, 0) * x + cof(i, 1) * y + cof(i, 2) * z) / F.nullif(det, F.lit(0.0)) for i in (0, 1))
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))
