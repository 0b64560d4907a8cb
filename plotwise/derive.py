"""Geometry and metrics derived from the driver's tables by plain arithmetic, in Spark and as SQL for the oracles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.session import table

ORIGIN = (37.23, -80.42)


def r6(c: Column, digits: int = 6) -> Column:
    """Rounded, with negative zero as zero."""
    return F.round(c, digits) + F.lit(0.0)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def star_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ring): 32 vertices at equal angles and radius 30 (1 + embedding)."""
    e = F.col("embedding")
    ring = F.transform(
        F.sequence(F.lit(0), F.lit(31)),
        lambda i: point(30.0 * (1.0 + e[i].cast("double")) * F.cos(F.lit(2 * math.pi / 32) * i), 30.0 * (1.0 + e[i].cast("double")) * F.sin(F.lit(2 * math.pi / 32) * i)),
    )
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), ring.alias("ring"))


def l_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, w, h, f, turn, ring): an L of w by h with a notch of f of each side, turned by the id in degrees."""
    k = F.col("p_partkey")
    base = table(spark, sf_dir, "part").select(
        k.alias("id"), (10.0 + F.col("p_size")).alias("w"), (1.0 + (k % 20) / 10.0).alias("aspect"), (0.3 + (k % 5) / 10.0).alias("f"), F.radians((k % 360).cast("double")).alias("turn")
    )
    base = base.withColumn("h", F.col("w") / F.col("aspect"))
    w, h, f, t = (F.col(c) for c in ("w", "h", "f", "turn"))
    zero = F.lit(0.0)
    flat = F.array(point(zero, zero), point(w, zero), point(w, h * (1 - f)), point(w * (1 - f), h * (1 - f)), point(w * (1 - f), h), point(zero, h))
    ring = F.transform(flat, lambda p: point(F.cos(t) * p["x"] - F.sin(t) * p["y"], F.sin(t) * p["x"] + F.cos(t) * p["y"]))
    return base.select("id", "w", "h", "f", "turn", ring.alias("ring"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, lat, lon, h, heading) around the origin."""
    e, u, v = F.col("event_id"), F.col("user_id"), F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", (ORIGIN[0] + (u % 50) * 0.0004).alias("lat"), (ORIGIN[1] + (e % 60) * 0.0005).alias("lon"), v.alias("h"), ((e * 7) % 400).cast("double").alias("heading")
    )


def fit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit metrics, one row a line item, on coarse grids."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 997).alias("building_id"),
        F.col("l_returnflag").alias("config"),
        F.concat("l_linestatus", (F.col("l_linenumber") % 4).cast("string")).alias("corruption"),
        (0.3 + F.col("l_quantity") * 0.014).alias("iou"),
        ((F.col("l_partkey") % 70) / 10.0).alias("hausdorff_m"),
        (0.6 + (F.col("l_suppkey") % 90) / 100.0).alias("area_ratio"),
        F.col("l_discount").alias("margin"),
        (0.5 + (F.col("l_linenumber") % 6) * 0.1).alias("rectilinearity"),
        (F.col("l_tax") * 2.0).alias("aniso"),
        ((F.col("l_orderkey") % 13) / 100.0).alias("overlap"),
        (F.col("l_partkey") % 11 == 0).alias("mirrored"),
        (F.col("l_suppkey") % 7 == 0).alias("multipart"),
        F.when(F.col("l_partkey") % 5 != 0, F.element_at(F.array(F.lit("contained"), F.lit("name_match"), F.lit("unnamed_sole_candidate")), (F.col("l_partkey") % 3 + 1).cast("int"))).alias("match_quality"),
        F.element_at(F.array(*map(F.lit, ("exif_heading", "silhouette", "facade_detail", "road_normal", "aspect_ratio", "arbitrary_symmetric"))), (F.col("l_orderkey") % 6 + 1).cast("int")).alias("disambiguated_by"),
        F.element_at(F.array(*map(F.lit, ("osm_height", "osm_levels", "monocular_depth", "microsoft", "proportional_fallback"))), (F.col("l_suppkey") % 5 + 1).cast("int")).alias("height_source"),
        F.when(F.col("l_orderkey") % 3 != 0, F.col("l_orderkey") % 4 == 0).alias("exif_silhouette_disagree"),
        F.when(((F.col("l_quantity") + F.col("l_partkey") % 20) > 30) & (F.col("l_suppkey") % 9 != 0), 1).otherwise(0).alias("label"),
        (F.col("l_extendedprice") % 1000).alias("ms"),
        F.least(F.lit(1.0), F.col("l_quantity") / 50.0).alias("p"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections: (photo, box, x0, y0, x1, y1, type, score), 20 boxes a photo."""
    k = F.col("p_partkey")
    x0, y0 = ((k * 37) % 900).cast("double"), ((k * 53) % 700).cast("double")
    return table(spark, sf_dir, "part").select(
        F.floor(k / 20).alias("photo"), k.alias("box"), x0.alias("x0"), y0.alias("y0"),
        (x0 + 20.0 + F.col("p_size") * 3.0).alias("x1"), (y0 + 30.0 + (k * 7) % 90).alias("y1"),
        F.element_at(F.array(*map(F.lit, ("window", "door", "garage_door", "entrance", "other"))), (k % 5 + 1).cast("int")).alias("type"),
        ((k * 13) % 101 / 100.0).alias("score"),
    )


#: The same tables for the oracles.
SQL = {
    "star_v": """star_v AS (SELECT vec_id AS id, i, 30.0*(1.0+CAST(embedding[i+1] AS DOUBLE))*cos(2*pi()/32*i) AS x,
        30.0*(1.0+CAST(embedding[i+1] AS DOUBLE))*sin(2*pi()/32*i) AS y, 32 AS n FROM embeddings, range(32) r(i))""",
    "l_base": """l_base AS (SELECT p_partkey AS id, 10.0+p_size AS w, CAST(10.0+p_size AS DOUBLE)/(1.0+(p_partkey%20)/10.0::DOUBLE) AS h,
        0.3::DOUBLE+(p_partkey%5)/10.0::DOUBLE AS f, radians((p_partkey%360)::DOUBLE) AS turn FROM part)""",
    "l_v": """l_v AS (SELECT id, i, cos(turn)*px-sin(turn)*py AS x, sin(turn)*px+cos(turn)*py AS y, 6 AS n, w, h, f, turn FROM (
        SELECT *, CASE i WHEN 0 THEN 0 WHEN 1 THEN w WHEN 2 THEN w WHEN 3 THEN w*(1-f) WHEN 4 THEN w*(1-f) ELSE 0 END::DOUBLE AS px,
        CASE i WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN h*(1-f) WHEN 3 THEN h*(1-f) WHEN 4 THEN h ELSE h END::DOUBLE AS py
        FROM l_base, range(6) r(i)))""",
    "pt": """pt AS (SELECT event_id, 37.23::DOUBLE+(user_id%50)*0.0004::DOUBLE AS lat, -80.42::DOUBLE+(event_id%60)*0.0005::DOUBLE AS lon, value AS h,
        ((event_id*7)%400)::DOUBLE AS heading FROM events)""",
    "fit": """fit AS (SELECT l_orderkey%997 AS building_id, l_returnflag AS config, l_linestatus||(l_linenumber%4)::VARCHAR AS corruption,
        0.3::DOUBLE+l_quantity*0.014::DOUBLE AS iou, (l_partkey%70)/10.0::DOUBLE AS hausdorff_m, 0.6::DOUBLE+(l_suppkey%90)/100.0::DOUBLE AS area_ratio,
        l_discount AS margin, 0.5::DOUBLE+(l_linenumber%6)*0.1::DOUBLE AS rectilinearity, l_tax*2.0::DOUBLE AS aniso, (l_orderkey%13)/100.0::DOUBLE AS overlap,
        l_partkey%11=0 AS mirrored, l_suppkey%7=0 AS multipart,
        CASE WHEN l_partkey%5<>0 THEN ['contained','name_match','unnamed_sole_candidate'][l_partkey%3+1] END AS match_quality,
        ['exif_heading','silhouette','facade_detail','road_normal','aspect_ratio','arbitrary_symmetric'][l_orderkey%6+1] AS disambiguated_by,
        ['osm_height','osm_levels','monocular_depth','microsoft','proportional_fallback'][l_suppkey%5+1] AS height_source,
        CASE WHEN l_orderkey%3<>0 THEN l_orderkey%4=0 END AS exif_silhouette_disagree,
        CASE WHEN l_quantity+l_partkey%20>30 AND l_suppkey%9<>0 THEN 1 ELSE 0 END AS label, l_extendedprice%1000 AS ms, least(1.0::DOUBLE,l_quantity/50.0::DOUBLE) AS p FROM lineitem)""",
    "box": """box AS (SELECT p_partkey//20 AS photo, p_partkey AS box, ((p_partkey*37)%900)::DOUBLE AS x0, ((p_partkey*53)%700)::DOUBLE AS y0,
        ((p_partkey*37)%900)::DOUBLE+20.0::DOUBLE+p_size*3.0::DOUBLE AS x1, ((p_partkey*53)%700)::DOUBLE+30.0::DOUBLE+(p_partkey*7)%90 AS y1,
        ['window','door','garage_door','entrance','other'][p_partkey%5+1] AS type, (p_partkey*13)%101/100.0::DOUBLE AS score FROM part)""",
}


def ctes(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + " "
