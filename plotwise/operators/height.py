"""Building heights by priority: OSM tag, sane depth estimate, Microsoft, proportions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotwise.functions.strings import parse_osm_length

# Fixed values.
LEVEL_M, MIN_M, MAX_M, SLENDER = 3.0, 2.5, 300.0, (0.1, 8.0)


def from_osm(height_tag: Column, levels_tag: Column) -> tuple[Column, Column]:
    """(metres, source), null where neither tag gives a height in band."""
    h = parse_osm_length(height_tag)
    v = F.split(F.trim(levels_tag), ";")[0].try_cast("double") * LEVEL_M
    tagged, levelled = h.between(MIN_M, MAX_M), v.between(MIN_M, MAX_M)
    return F.when(tagged, h).when(levelled, v), F.when(tagged, "osm_height").when(levelled, "osm_levels")


def from_microsoft(h: Column) -> Column:
    return F.when(h.between(MIN_M, MAX_M), h)


def _root(area: Column) -> Column:
    return F.sqrt(F.greatest(area, F.lit(1.0)))


def proportional(units: Column, scale: Column, area: Column) -> Column:
    h = F.greatest(F.lit(MIN_M), F.least(units * scale, F.lit(MAX_M)))
    return F.greatest(SLENDER[0] * _root(area), F.least(h, SLENDER[1] * _root(area)))


def sane(h: Column, area: Column) -> Column:
    return h.between(MIN_M, MAX_M) & (h / _root(area)).between(*SLENDER)


def resolve(height_tag: Column, levels_tag: Column, microsoft: Column, depth: Column, units: Column, scale: Column, area: Column) -> Column:
    """``resolve_from`` with the tags read in place."""
    return resolve_from(*from_osm(height_tag, levels_tag), microsoft, depth, units, scale, area)


def resolve_from(osm: Column, osm_source: Column, microsoft: Column, depth: Column, units: Column, scale: Column, area: Column) -> Column:
    """STRUCT<height_m, source, notes>; notes name disagreements of over 30 % with a tag and what was passed over.

    ``osm`` and ``osm_source`` are best columns of an earlier projection: they come up often, and parsing is dear.
    """
    ms, depth_ok = from_microsoft(microsoft), F.coalesce(sane(depth, area), F.lit(False))
    far = lambda other: osm.isNotNull() & (other > 0) & (F.abs(other - osm) / osm > 0.30)
    no_tag = osm.isNull()
    notes = F.array_compact(
        F.array(
            F.when(far(depth), F.lit("depth disagrees")),
            F.when(far(microsoft), F.lit("microsoft disagrees")),
            F.when(no_tag & depth_ok & ms.isNotNull(), F.lit("microsoft below depth")),
            F.when(no_tag & depth.isNotNull() & ~depth_ok, F.lit("depth rejected")),
            F.when(no_tag & ~depth_ok & ms.isNotNull(), F.lit("microsoft not authoritative")),
            F.when(no_tag & ~depth_ok & ms.isNull(), F.lit("proportional fallback")),
        )
    )
    return F.struct(
        F.coalesce(osm, F.when(depth_ok, depth), ms, proportional(units, scale, area)).alias("height_m"),
        F.coalesce(osm_source, F.when(depth_ok, "monocular_depth"), F.when(ms.isNotNull(), "microsoft"), F.lit("proportional_fallback")).alias("source"),
        notes.alias("notes"),
    )
