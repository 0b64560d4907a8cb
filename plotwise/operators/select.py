"""Footprint selection and spatial joins on grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Street classes and the service kinds that don't count.
STREETS = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "living_street", "service", "road", "motorway_link", "trunk_link", "primary_link", "secondary_link")
NOT_STREETS = ("parking_aisle", "driveway", "drive-through")


def cells(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """ARRAY<STRUCT<cx, cy>>: grid cells that a box touches."""
    span = lambda a, b: F.sequence(F.floor(a / size).cast("int"), F.floor(b / size).cast("int"))
    return F.flatten(F.transform(span(x0, x1), lambda i: F.transform(span(y0, y1), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def box_distance(x: Column, y: Column) -> Column:
    """From a point to the box x0, y0, x1, y1; zero inside."""
    dx = F.greatest(F.col("x0") - x, x - F.col("x1"), F.lit(0.0))
    dy = F.greatest(F.col("y0") - y, y - F.col("y1"), F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def near_boxes(points: DataFrame, boxes: DataFrame, reach: float, size: float = 128.0) -> DataFrame:
    """Points (px, py, ...) with every box within ``reach``, and ``d``: an equi-join on cells of the grown boxes.

    A point lies in one cell, so no pair comes up twice. Both sides are keyed by cell; crowded cells are left to
    the adaptive skew join.
    """
    p = points.withColumn("cx", F.floor(F.col("px") / size).cast("int")).withColumn("cy", F.floor(F.col("py") / size).cast("int"))
    grown = cells(F.col("x0") - reach, F.col("y0") - reach, F.col("x1") + reach, F.col("y1") + reach, size)
    b = boxes.withColumn("cell", F.explode(grown)).select("*", "cell.cx", "cell.cy").drop("cell")
    return p.join(b, ["cx", "cy"]).withColumn("d", box_distance(F.col("px"), F.col("py"))).where(F.col("d") <= reach).drop("cx", "cy")


def overlapping(a: DataFrame, b: DataFrame, size: float = 128.0) -> DataFrame:
    """Pairs of boxes a (x0..y1) and b (u0..v1) with common area, once each, with ``common``.

    Joined on cells; a pair counts in the cell that holds the lower corner of what they share.
    """
    a = a.withColumn("c", F.explode(cells(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), size))).select("*", "c.cx", "c.cy").drop("c")
    b = b.withColumn("c", F.explode(cells(F.col("u0"), F.col("v0"), F.col("u1"), F.col("v1"), size))).select("*", "c.cx", "c.cy").drop("c")
    lx, ly = F.greatest("x0", "u0"), F.greatest("y0", "v0")
    w, h = F.least("x1", "u1") - lx, F.least("y1", "v1") - ly
    joined = a.join(b, ["cx", "cy"]).where((w > 0) & (h > 0) & (F.floor(lx / size) == F.col("cx")) & (F.floor(ly / size) == F.col("cy")))
    return joined.withColumn("common", w * h).drop("cx", "cy")


def select_footprint(candidates: DataFrame, key: str, building: str, cutoff: float = 50.0) -> DataFrame:
    """(key, building, match_quality, status) from rows of (key, building, d, contained, named).

    Contained and named, first in file order; else the only one that contains; else, if any is named, the nearest
    named within the cutoff; else the only one within the cutoff. Keys without an answer are quarantined.
    """
    b, d = F.col(building), F.col("d")
    near = d <= cutoff
    facts = candidates.groupBy(key).agg(
        F.min(F.when(F.col("contained") & F.col("named"), b)).alias("both"),
        F.count_if(F.col("contained")).alias("n_contained"),
        F.min(F.when(F.col("contained"), b)).alias("contains"),
        F.count_if(F.col("named")).alias("n_named"),
        F.min(F.when(F.col("named") & near, F.struct(d.alias("d"), b.alias("b"))))["b"].alias("nearest"),
        F.count_if(near).alias("n_near"),
        F.min(F.when(near, b)).alias("only"),
    )
    ladder = [
        (F.col("both").isNotNull(), F.col("both"), "contained_and_named"),
        (F.col("n_contained") == 1, F.col("contains"), "contained"),
        (F.col("n_named") > 0, F.col("nearest"), "name_match"),
        (F.col("n_near") == 1, F.col("only"), "unnamed_sole_candidate"),
    ]
    chosen, quality = F.lit(None).cast("long"), F.lit(None).cast("string")
    for test, value, name in reversed(ladder):
        chosen, quality = F.when(test, value).otherwise(chosen), F.when(test, F.lit(name)).otherwise(quality)
    out = facts.select(key, chosen.alias(building), quality.alias("match_quality"))
    found = F.col(building).isNotNull()
    return out.withColumn("match_quality", F.when(found, F.col("match_quality"))).withColumn("status", F.when(found, "ok").otherwise("quarantined"))


def is_street() -> Column:
    """Street elements: highway of a street class, not one of the service kinds; a missing kind passes."""
    return F.col("highway").isin(*STREETS) & ~F.coalesce(F.col("service").isin(*NOT_STREETS), F.lit(False))
