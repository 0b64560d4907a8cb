"""Polygon measures over ARRAY<STRUCT<x, y>>, open rings, as higher-order functions; one row in, one value out."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rotate_by_one(ring: Column) -> Column:
    return F.concat(F.slice(ring, F.lit(2), F.size(ring) - 1), F.slice(ring, F.lit(1), F.lit(1)))


def edges(ring: Column) -> Column:
    """ARRAY<STRUCT<ax, ay, bx, by>> of a ring's sides, the closing one included."""
    return F.zip_with(ring, rotate_by_one(ring), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))


def fold(array: Column, term) -> Column:
    """Sum of ``term`` over the array, in its order."""
    return F.aggregate(array, F.lit(0.0), lambda acc, e: acc + term(e))


def cross(e: Column) -> Column:
    return e["ax"] * e["by"] - e["bx"] * e["ay"]


def signed_area(ring: Column) -> Column:
    return fold(edges(ring), cross) / 2.0


def perimeter(ring: Column) -> Column:
    return fold(edges(ring), lambda e: F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"]))


def centroid(ring: Column) -> Column:
    """Area-weighted; the vertices' mean where the area vanishes."""
    sides, area, n = edges(ring), signed_area(ring), F.size(ring)
    x = fold(sides, lambda e: (e["ax"] + e["bx"]) * cross(e)) / (6.0 * area)
    y = fold(sides, lambda e: (e["ay"] + e["by"]) * cross(e)) / (6.0 * area)
    flat = F.abs(area) < 1e-12
    return F.struct(
        F.when(flat, fold(ring, lambda p: p["x"]) / n).otherwise(x).alias("x"),
        F.when(flat, fold(ring, lambda p: p["y"]) / n).otherwise(y).alias("y"),
    )


def principal_orientation(ring: Column) -> Column:
    """STRUCT<theta, r>: length-weighted circular mean of four times the sides' angles; (0, 0) without length."""
    sides = edges(ring)
    length = lambda e: F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"])
    angle = lambda e: 4.0 * F.atan2(e["by"] - e["ay"], e["bx"] - e["ax"])
    total = fold(sides, length)
    c, s = fold(sides, lambda e: length(e) * F.cos(angle(e))), fold(sides, lambda e: length(e) * F.sin(angle(e)))
    flat = total < 1e-9
    return F.struct(
        F.when(flat, 0.0).otherwise(F.atan2(s, c) / 4.0).alias("theta"),
        F.when(flat, 0.0).otherwise(F.hypot(c, s) / total).alias("r"),
    )


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Crossing-number test of a point."""
    hits = F.filter(edges(ring), lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]))
    return F.size(hits) % 2 == 1


def segment_distance(e: Column, x: Column, y: Column) -> Column:
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
    d2 = dx * dx + dy * dy
    t = F.when(d2 == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["ax"]) * dx + (y - e["ay"]) * dy) / d2)))
    return F.hypot(x - e["ax"] - t * dx, y - e["ay"] - t * dy)


def boundary_distance(ring: Column, x: Column, y: Column) -> Column:
    return F.array_min(F.transform(edges(ring), lambda e: segment_distance(e, x, y)))


def distance(ring: Column, x: Column, y: Column) -> Column:
    """Zero inside."""
    return F.when(contains(ring, x, y), 0.0).otherwise(boundary_distance(ring, x, y))


def hausdorff(a: Column, b: Column) -> Column:
    """Symmetric, from each ring's vertices to the other's sides."""
    one = lambda p, q: F.array_max(F.transform(p, lambda v: boundary_distance(q, v["x"], v["y"])))
    return F.greatest(one(a, b), one(b, a))


def ombb(ring: Column) -> Column:
    """STRUCT<area, angle, a, b, cx, cy>: the rotated box of least area; a >= b, angle of the longer side in [0, pi).

    Some side of the least box lies along a side of the hull, and every hull side joins two vertices; trying the
    ring's own sides covers convex stretches, so rings are tried at all vertex pairs that are hull sides. Boxes are
    rounded to 1e-9 before they are compared, then the smallest angle wins.
    """
    hull = F.filter(
        F.flatten(F.transform(ring, lambda p: F.transform(ring, lambda q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by"))))),
        lambda e: (F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"]) > 1e-9)
        & F.forall(ring, lambda v: (e["bx"] - e["ax"]) * (v["y"] - e["ay"]) - (e["by"] - e["ay"]) * (v["x"] - e["ax"]) >= -1e-9),
    )

    def box(e: Column) -> Column:
        n = F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"])
        ux, uy = (e["bx"] - e["ax"]) / n, (e["by"] - e["ay"]) / n
        along, across = F.transform(ring, lambda v: v["x"] * ux + v["y"] * uy), F.transform(ring, lambda v: v["y"] * ux - v["x"] * uy)
        s, t = F.array_max(along) - F.array_min(along), F.array_max(across) - F.array_min(across)
        cs, ct = (F.array_max(along) + F.array_min(along)) / 2, (F.array_max(across) + F.array_min(across)) / 2
        angle = F.pmod(F.atan2(uy, ux) + F.when(s >= t, 0.0).otherwise(math.pi / 2), F.lit(math.pi))
        return F.struct(
            F.round(s * t, 6).alias("rank"), F.round(angle, 6).alias("turn"), (s * t).alias("area"), angle.alias("angle"),
            F.greatest(s, t).alias("a"), F.least(s, t).alias("b"), (cs * ux - ct * uy).alias("cx"), (cs * uy + ct * ux).alias("cy"),
        )

    return F.array_min(F.transform(hull, box))


def stratum(r: Column, aspect: Column) -> Column:
    return F.when(r < 0.85, "complex").when(aspect < 1.15, "near_square").otherwise("rectangular")


def transform_ring(ring: Column, theta: Column, sx: Column, sy: Column, tx: Column, ty: Column) -> Column:
    """Scale along the axes, rotate, translate."""
    return F.transform(
        ring,
        lambda p: F.struct(
            (F.cos(theta) * sx * p["x"] - F.sin(theta) * sy * p["y"] + tx).alias("x"),
            (F.sin(theta) * sx * p["x"] + F.cos(theta) * sy * p["y"] + ty).alias("y"),
        ),
    )


def contains_polygon(outer: Column, holes: Column, x: Column, y: Column) -> Column:
    """Inside the outer ring and in none of the holes, an ARRAY of rings."""
    return contains(outer, x, y) & ~F.exists(holes, lambda h: contains(h, x, y))
