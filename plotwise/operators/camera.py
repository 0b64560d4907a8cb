"""Pinhole cameras as expressions: rays through pixels, projection, and hits on prism walls."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DIAGONAL_35MM, TOLERANCE_DEG, TOLERANCE_M = 43.2666, 1.25, 0.5


def focal_px(f35: Column, width: Column, height: Column) -> Column:
    return f35 * F.hypot(width, height) / DIAGONAL_35MM


def basis(yaw_deg: Column, pitch_deg: Column) -> tuple[tuple[Column, ...], ...]:
    """Right, up and forward in east, north, up; no roll."""
    y, p = F.radians(yaw_deg), F.radians(pitch_deg)
    sy, cy, sp, cp = F.sin(y), F.cos(y), F.sin(p), F.cos(p)
    return (cy, -sy, F.lit(0.0)), (-sy * sp, -cy * sp, cp), (sy * cp, cy * cp, sp)


def ray(yaw: Column, pitch: Column, f: Column, w: Column, h: Column, px: Column, py: Column) -> tuple[Column, Column, Column]:
    """Unit direction through a pixel."""
    right, up, ahead = basis(yaw, pitch)
    a, b = (px - w / 2) / f, (py - h / 2) / f
    d = [ahead[i] + a * right[i] - b * up[i] for i in range(3)]
    n = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    return d[0] / n, d[1] / n, d[2] / n


def project(yaw: Column, pitch: Column, f: Column, w: Column, h: Column, rel: tuple[Column, Column, Column]) -> tuple[Column, Column]:
    """Pixel of a point given relative to the camera; null behind it."""
    right, up, ahead = basis(yaw, pitch)
    dot = lambda v: v[0] * rel[0] + v[1] * rel[1] + v[2] * rel[2]
    z = F.when(dot(ahead) > 0, dot(ahead))
    return w / 2 + f * dot(right) / z, h / 2 - f * dot(up) / z


def wall_hit(origin: tuple[Column, Column, Column], d: tuple[Column, Column, Column], e: Column, roof: Column, tolerance: Column) -> Column:
    """STRUCT<t, along, z, valid> where a ray meets the vertical plane of a wall ``e`` (ax, ay, bx, by; outside on its right)."""
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
    n = F.hypot(dx, dy)
    nx, ny = dy / n, -dx / n
    toward = d[0] * nx + d[1] * ny
    t = F.when(toward < -1e-9, ((e["ax"] - origin[0]) * nx + (e["ay"] - origin[1]) * ny) / F.when(toward < -1e-9, toward))
    along = ((origin[0] + t * d[0] - e["ax"]) * dx + (origin[1] + t * d[1] - e["ay"]) * dy) / n
    z = origin[2] + t * d[2]
    valid = F.coalesce((t > 0) & along.between(-tolerance, n + tolerance) & (z >= -tolerance) & (z <= roof), F.lit(False))
    return F.struct(t.alias("t"), along.alias("along"), z.alias("z"), valid.alias("valid"))


def corner_tolerance(distance: Column) -> Column:
    return F.greatest(F.lit(TOLERANCE_M), distance * math.tan(math.radians(TOLERANCE_DEG)))


def reliable(iou: Column, at_edge: Column) -> Column:
    return (iou >= 0.6) & ~at_edge
