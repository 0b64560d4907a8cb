"""Queries over rings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plotwise import kernels
from plotwise.derive import ctes, l_rings, points, r6, star_rings
from plotwise.functions import rings as g


QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def both(spark, d):
    """Star rings as kind s and L rings as kind l."""
    return star_rings(spark, d).select(F.lit("s").alias("kind"), "id", "ring").unionAll(l_rings(spark, d).select(F.lit("l").alias("kind"), "id", "ring"))


V = ctes("star_v", "l_base", "l_v") + """, v AS (SELECT 's' AS kind, id, i, x, y, n FROM star_v UNION ALL SELECT 'l', id, i, x, y, n FROM l_v),
e AS (SELECT a.kind, a.id, a.i, a.n, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS yb FROM v a JOIN v b ON a.kind=b.kind AND a.id=b.id AND b.i=(a.i+1)%a.n)"""
STAR = ctes("star_v") + """, e AS (SELECT a.id, a.i, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS yb FROM star_v a JOIN star_v b ON a.id=b.id AND b.i=(a.i+1)%32)"""


@query("ring_area", V + " SELECT kind, id, round(sum(ax*yb-bx*ay)/2,6) AS area FROM e GROUP BY kind, id")
def ring_area(spark, d):
    return both(spark, d).select("kind", "id", r6(g.signed_area(F.col("ring"))).alias("area"))


@query("ring_perimeter", V + " SELECT kind, id, round(sum(sqrt(pow(bx-ax,2)+pow(yb-ay,2))),6) AS perimeter FROM e GROUP BY kind, id")
def ring_perimeter(spark, d):
    return both(spark, d).select("kind", "id", r6(g.perimeter(F.col("ring"))).alias("perimeter"))


@query("ring_centroid", V + """ SELECT kind, id, round(sum((ax+bx)*(ax*yb-bx*ay))/(3*sum(ax*yb-bx*ay)),6)+0.0::DOUBLE AS cx, round(sum((ay+yb)*(ax*yb-bx*ay))/(3*sum(ax*yb-bx*ay)),6)+0.0::DOUBLE AS cy FROM e GROUP BY kind, id""")
def ring_centroid(spark, d):
    p = both(spark, d).withColumn("c", g.centroid(F.col("ring")))
    return p.select("kind", "id", r6(F.col("c.x")).alias("cx"), r6(F.col("c.y")).alias("cy"))


_TURN = """, l AS (SELECT kind, id, sqrt(pow(bx-ax,2)+pow(yb-ay,2)) AS len, 4*atan2(yb-ay,bx-ax) AS q FROM e),
m AS (SELECT kind, id, sum(len*cos(q)) AS c, sum(len*sin(q)) AS s, sum(len) AS total FROM l GROUP BY kind, id)"""


@query("ring_orientation", V + _TURN + " SELECT kind, id, round(sqrt(c*c+s*s)/total,6) AS r, round(cos(atan2(s,c)),5)+0.0::DOUBLE AS c4, round(sin(atan2(s,c)),5)+0.0::DOUBLE AS s4 FROM m")
def ring_orientation(spark, d):
    """The angle comes out as cosine and sine of four times itself, which have no jump."""
    p = both(spark, d).withColumn("o", g.principal_orientation(F.col("ring")))
    return p.select("kind", "id", r6(F.col("o.r")).alias("r"), r6(F.cos(F.col("o.theta") * 4), 5).alias("c4"), r6(F.sin(F.col("o.theta") * 4), 5).alias("s4"))


_BOX = """, pair AS (SELECT a.id, a.x AS ax, a.y AS ay, b.x-a.x AS dx, b.y-a.y AS dy, sqrt(pow(b.x-a.x,2)+pow(b.y-a.y,2)) AS len, a.i AS i, b.i AS j FROM pv a JOIN pv b ON a.id=b.id AND a.i<>b.i),
hull AS (SELECT p.id, p.i, p.j, any_value(dx/len) AS ux, any_value(dy/len) AS uy FROM pair p JOIN pv v ON v.id=p.id GROUP BY p.id, p.i, p.j HAVING min(dx*(v.y-ay)-dy*(v.x-ax))>=-1e-9),
ext AS (SELECT h.id, h.i, h.j, max(v.x*ux+v.y*uy)-min(v.x*ux+v.y*uy) AS s, max(v.y*ux-v.x*uy)-min(v.y*ux-v.x*uy) AS t FROM hull h JOIN pv v ON v.id=h.id GROUP BY h.id, h.i, h.j)"""


@query("ring_ombb", ctes("star_v") + ", pv AS (SELECT * FROM star_v)" + _BOX + """ SELECT id, round(min(s*t),5) AS area FROM ext GROUP BY id""")
def ring_ombb(spark, d):
    """By the numpy kernel: trying every pair of 32 vertices as an expression costs a thousand times the hull's work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [kernels.ombb(np.array([(p["x"], p["y"]) for p in ring])) for ring in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([b["a"] * b["b"] for b in found])], names=["id", "area"])

    return star_rings(spark, d).select("id", "ring").mapInArrow(run, "id long, area double").select("id", F.round("area", 5).alias("area"))


@query("ring_stratum", ctes("l_base", "l_v") + ", pv AS (SELECT * FROM l_v)" + _BOX + """, best AS (SELECT id, min(struct_pack(k := round(s*t,6), a := round(greatest(s,t)/least(s,t),6))) AS b FROM ext GROUP BY id)
SELECT id, b.a AS aspect, CASE WHEN b.a<1.15 THEN 'near_square' ELSE 'rectangular' END AS stratum FROM best""")
def ring_stratum(spark, d):
    """R is 1 for these rings; of boxes with one area the squarest counts."""
    p = l_rings(spark, d).withColumn("o", g.ombb(F.col("ring"))).withColumn("r", F.round(g.principal_orientation(F.col("ring"))["r"], 6))
    aspect = F.round(F.col("o.a") / F.col("o.b"), 6)
    return p.select("id", aspect.alias("aspect"), g.stratum(F.col("r"), aspect).alias("stratum"))


@query("ring_walls", V + """ SELECT id, i AS wall, round(sqrt(pow(bx-ax,2)+pow(yb-ay,2)),6) AS length, round((yb-ay)/sqrt(pow(bx-ax,2)+pow(yb-ay,2)),6)+0.0::DOUBLE AS nx, round(-(bx-ax)/sqrt(pow(bx-ax,2)+pow(yb-ay,2)),6)+0.0::DOUBLE AS ny FROM e WHERE kind='l' AND sqrt(pow(bx-ax,2)+pow(yb-ay,2))>=1e-6""")
def ring_walls(spark, d):
    """Prism walls of counter-clockwise rings, with outward normals."""
    e = l_rings(spark, d).select("id", F.posexplode(g.edges(F.col("ring"))).alias("wall", "e"))
    n = F.hypot(F.col("e.bx") - F.col("e.ax"), F.col("e.by") - F.col("e.ay"))
    return e.withColumn("n", n).where("n >= 1e-6").select("id", F.col("wall").cast("long").alias("wall"), F.round("n", 6).alias("length"), r6((F.col("e.by") - F.col("e.ay")) / F.col("n")).alias("nx"), r6(-(F.col("e.bx") - F.col("e.ax")) / F.col("n")).alias("ny"))


def ring_points(spark, d):
    """Every star ring with the point of the event of its number."""
    p = points(spark, d).select(F.col("event_id").alias("id"), (F.pmod(F.col("lat") * 100000, F.lit(70.0)) - 35.0).alias("px"), (F.pmod(-F.col("lon") * 100000, F.lit(70.0)) - 35.0).alias("py"))
    return star_rings(spark, d).join(p, "id")


_P = """, p AS (SELECT event_id AS id, (lat*100000-floor(lat*100000/70)*70)-35 AS px, (-lon*100000-floor(-lon*100000/70)*70)-35 AS py FROM pt),
seg AS (SELECT e.*, px, py, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((px-ax)*(bx-ax)+(py-ay)*(yb-ay))/(pow(bx-ax,2)+pow(yb-ay,2)))) AS t FROM e JOIN p USING (id)),
dist AS (SELECT id, i, sqrt(pow(px-ax-t*(bx-ax),2)+pow(py-ay-t*(yb-ay),2)) AS d, (ay>py)<>(yb>py) AND px<(bx-ax)*(py-ay)/(yb-ay)+ax AS hit FROM seg)"""


def _with_pt(sql: str) -> str:
    from plotwise.derive import SQL

    return "WITH " + SQL["pt"] + ", " + sql.removeprefix("WITH ")


@query("point_in_ring", _with_pt(STAR) + _P + " SELECT id, sum(CASE WHEN hit THEN 1 ELSE 0 END)%2=1 AS inside FROM dist GROUP BY id")
def point_in_ring(spark, d):
    return ring_points(spark, d).select("id", g.contains(F.col("ring"), F.col("px"), F.col("py")).alias("inside"))


@query("point_ring_distance", _with_pt(STAR) + _P + " SELECT id, CASE WHEN sum(CASE WHEN hit THEN 1 ELSE 0 END)%2=1 THEN 0.0::DOUBLE ELSE round(min(d),5) END AS distance FROM dist GROUP BY id")
def point_ring_distance(spark, d):
    return ring_points(spark, d).select("id", F.round(g.distance(F.col("ring"), F.col("px"), F.col("py")), 5).alias("distance"))


@query("nearest_wall", _with_pt(STAR) + _P + " SELECT id, (min(struct_pack(d := round(d,6), i := i))).i::BIGINT AS wall, round(min(d),5) AS distance FROM dist GROUP BY id")
def nearest_wall(spark, d):
    walls = F.transform(g.edges(F.col("ring")), lambda e, i: F.struct(F.round(g.segment_distance(e, F.col("px"), F.col("py")), 6).alias("d"), i.alias("i")))
    return ring_points(spark, d).withColumn("w", F.array_min(walls)).select("id", F.col("w.i").cast("long").alias("wall"), F.round(g.boundary_distance(F.col("ring"), F.col("px"), F.col("py")), 5).alias("distance"))


@query("hausdorff_vertices", STAR + """, one AS (SELECT v.id AS p, e.id AS q, v.i, min(sqrt(pow(v.x-ax-t*(bx-ax),2)+pow(v.y-ay-t*(yb-ay),2))) AS d FROM star_v v JOIN (SELECT * FROM e) e ON abs(e.id-v.id)=1,
LATERAL (SELECT greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((v.x-ax)*(bx-ax)+(v.y-ay)*(yb-ay))/(pow(bx-ax,2)+pow(yb-ay,2)))) AS t) GROUP BY v.id, e.id, v.i)
SELECT least(p,q) AS id, round(max(d),5) AS hausdorff FROM one GROUP BY least(p,q)""")
def hausdorff_vertices(spark, d):
    a = star_rings(spark, d)
    b = a.select((F.col("id") - 1).alias("id"), F.col("ring").alias("other"))
    return a.join(b, "id").select("id", F.round(g.hausdorff(F.col("ring"), F.col("other")), 5).alias("hausdorff"))
