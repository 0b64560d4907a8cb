"""Queries over tiles, classes, masks, cameras, textures and meshes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plotwise import kernels
from plotwise.derive import boxes, ctes, l_rings, r6
from plotwise.functions import rings as g
from plotwise.operators import camera, perception, texture
from plotwise.plans.placement import _WALL, cloud
from plotwise.session import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("tile_grid", """WITH t AS (SELECT p_partkey AS id, 300+p_partkey%900 AS length, greatest(1,least(100+p_size*4,300+p_partkey%900)) AS size FROM part), u AS (SELECT *, floor(size*0.2::DOUBLE) AS lap FROM t), n AS (SELECT *, CASE WHEN length<=size*1.1::DOUBLE THEN 1 ELSE greatest(2,ceil((length-lap)/(size-lap)))::BIGINT END AS n FROM u)
SELECT id, i::BIGINT AS place, CASE WHEN n=1 THEN 0 ELSE round_even(i*(length-size)/(n-1)::DOUBLE,0)::BIGINT END AS a, CASE WHEN n=1 THEN length ELSE round_even(i*(length-size)/(n-1)::DOUBLE,0)::BIGINT+size END::BIGINT AS b FROM n, LATERAL (SELECT unnest(range(n)) AS i)""")
def tile_grid(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (300 + F.col("p_partkey") % 900).alias("length"), (100 + F.col("p_size") * 4).alias("size"))
    return t.select("id", F.posexplode(perception.spans(F.col("length"), F.col("size"))).alias("place", "s")).select("id", F.col("place").cast("long").alias("place"), "s.a", "s.b")


@query("tile_starts", """WITH t AS (SELECT p_partkey AS id, p_partkey%3000 AS length FROM part), s AS (SELECT id, length, CASE WHEN length<=1024 THEN [0] ELSE range(0,length-1024+1,896) END AS r FROM t)
SELECT id, unnest(CASE WHEN length>1024 AND r[-1]+1024<length THEN list_append(r,length-1024) ELSE r END)::BIGINT AS start FROM s""")
def tile_starts(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(perception.tile_starts(F.col("p_partkey") % 3000, 1024, 128)).alias("start"))


@query("detection_filter", ctes("box") + " SELECT photo, box FROM box WHERE x1-x0>=12 AND y1-y0>=12 AND (x1-x0)*(y1-y0)<=0.06::DOUBLE*500*400 AND (box%10)/10.0::DOUBLE>=0.4::DOUBLE AND NOT ((box%3>0 AND x0<4) OR (box%3<2 AND x1>900-4) OR y0<4)")
def detection_filter(spark, d):
    b = boxes(spark, d)
    third = F.col("box") % 3
    cut = perception.cut_by_interior_edge((third * 900, F.lit(1), third * 900 + 900, F.lit(900)), (F.lit(0), F.lit(0), F.lit(2700), F.lit(900)))
    return b.where(perception.keep_detection(F.lit(500), F.lit(400), (F.col("box") % 10) / 10.0) & ~cut).select("photo", "box")


_PRIOR = """pri AS (SELECT *, box%2=0 AS t, (y1-y0)/(x1-x0) AS a, (x1-x0)/1000 AS wf, box%4 AS pe, box%7=0 AS co FROM box),
pr AS (SELECT *, (CASE WHEN t THEN 1.0::DOUBLE ELSE 0.3 END)*(CASE WHEN a BETWEEN 1.5 AND 3.5 THEN 1 ELSE 0.5::DOUBLE END)*(CASE WHEN pe>=2 OR co THEN CASE WHEN t AND a>=1.5 THEN 0.5::DOUBLE ELSE 0.05 END ELSE 1 END) AS door,
CASE WHEN pe>=2 OR co THEN 1.0::DOUBLE ELSE (CASE WHEN t THEN 0.45::DOUBLE ELSE 1 END)*(CASE WHEN pe>=1 THEN 1.0::DOUBLE ELSE 0.8 END) END AS window_,
(CASE WHEN t THEN 1.0::DOUBLE ELSE 0.2 END)*(CASE WHEN a BETWEEN 0.45 AND 1.2 THEN 1.0::DOUBLE ELSE 0.4 END)*(CASE WHEN wf>=0.06 THEN 1.0::DOUBLE ELSE 0.5 END) AS garage,
(CASE WHEN t THEN 1.0::DOUBLE ELSE 0.3 END)*(CASE WHEN a BETWEEN 0.6 AND 2.2 THEN 1.0::DOUBLE ELSE 0.6 END)*(CASE WHEN pe>=2 OR co THEN 0.5::DOUBLE ELSE 1 END) AS entrance FROM pri)"""


def with_priors(spark, d):
    b = boxes(spark, d)
    w, h, k = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("box")
    p = perception.priors(k % 2 == 0, h / w, w / 1000, k % 4, k % 7 == 0)
    return b.select("photo", "box", *[v.alias(n) for n, v in p.items()])


@query("opening_priors", ctes("box") + ", " + _PRIOR + " SELECT photo, box, round(door,6) AS door, round(window_,6) AS window, round(garage,6) AS garage_door, round(entrance,6) AS entrance FROM pr")
def opening_priors(spark, d):
    return with_priors(spark, d).select("photo", "box", *[F.round(c, 6).alias(c) for c in perception.CLASSES])


_NAMES = [*perception.CLASSES, *perception.DISTRACTORS]
_COMB = " UNION ALL ".join(f"SELECT photo, box, {i} AS rank, '{n}' AS name, ((box*{7 + 2 * i})%97)/97.0::DOUBLE*{ {'door': 'door', 'window': 'window_', 'garage_door': 'garage', 'entrance': 'entrance'}.get(n, '1.0::DOUBLE') } AS s FROM pr" for i, n in enumerate(_NAMES))
_GROUP = "CASE WHEN {0} IN ('door','garage_door','entrance') THEN 'passable' WHEN {0}='window' THEN 'window' ELSE 'other' END"


@query("opening_classify", ctes("box") + ", " + _PRIOR + f""", sc AS ({_COMB}), f AS (SELECT photo, box, min(struct_pack(n:=-s,r:=rank,c:=name)) AS best, min(struct_pack(n:=-s,r:=rank,c:=name)) FILTER (rank<4) AS op FROM sc GROUP BY photo, box),
h AS (SELECT *, best.c IN ('lamp','column','sign') AND -best.n<1.3::DOUBLE*-op.n AS hid FROM f), t AS (SELECT photo, box, hid, CASE WHEN hid THEN best.c END AS occluded_by, CASE WHEN hid THEN op.c ELSE best.c END AS top, CASE WHEN hid THEN -op.n ELSE -best.n END AS s1 FROM h),
r AS (SELECT t.photo, t.box, any_value(hid) AS hid, any_value(occluded_by) AS occluded_by, any_value(top) AS top, any_value(s1) AS s1, max(s) FILTER ({_GROUP.format('name')}<>{_GROUP.format('top')}) AS rv FROM t JOIN sc ON sc.photo=t.photo AND sc.box=t.box GROUP BY t.photo, t.box)
SELECT photo, box, CASE WHEN {_GROUP.format('top')}='other' THEN 'other' ELSE top END AS type, {_GROUP.format('top')} AS grp, CASE WHEN hid OR s1<0.2::DOUBLE OR CASE WHEN s1>0 THEN (s1-rv)/s1 ELSE 0 END<0.35::DOUBLE THEN 'REVIEW' ELSE 'ACCEPT' END AS decision, round(s1,4)+0.0::DOUBLE AS score, occluded_by FROM r""")
def opening_classify(spark, d):
    b = with_priors(spark, d)
    scores = {n: ((F.col("box") * (7 + 2 * i)) % 97) / 97.0 * F.col(n) for i, n in enumerate(_NAMES)}
    return b.withColumn("o", perception.classify(scores)).select("photo", "box", "o.type", "o.grp", "o.decision", r6(F.col("o.score"), 4).alias("score"), "o.occluded_by")


@query("mask_checks", "SELECT user_id, event_id, CASE WHEN value/100>0.9 THEN 'covers the frame' WHEN value/100<0.04 THEN 'tiny' WHEN user_id%5>3 THEN 'touches edges' WHEN event_id%20>12 THEN 'ragged' END AS note FROM events")
def mask_checks(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", perception.mask_note(F.col("value") / 100, F.col("user_id") % 5, F.col("event_id") % 20).alias("note"))


@query("select_box", ctes("box") + ", m AS (SELECT photo, box, greatest(0,x1-x0)*greatest(0,y1-y0)/(1000*800.0::DOUBLE)*greatest(0,1-sqrt(pow((x0+x1)/2-500,2)+pow((y0+y1)/2-400,2))/(sqrt(1000*1000+800*800.0::DOUBLE)/2)) AS merit FROM box) SELECT photo, (min(struct_pack(n:=-round(merit,9),b:=box))).b AS box FROM m GROUP BY photo")
def select_box(spark, d):
    return perception.select_box(boxes(spark, d), "photo", 1000.0, 800.0)


_TEX = "tex AS (SELECT l_suppkey AS building, l_linenumber AS wall, l_orderkey%97 AS col, l_partkey%89 AS row, bool_or(l_discount>=0.01*l_linenumber) AS visible, max(l_quantity)*5 AS value FROM lineitem GROUP BY ALL)"


def texels(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("building"), F.col("l_linenumber").alias("wall"), (F.col("l_orderkey") % 97).alias("col"), (F.col("l_partkey") % 89).alias("row"))
    return t.agg(F.bool_or(F.col("l_discount") >= F.lit(0.01) * F.col("l_linenumber")).alias("visible"), (F.max("l_quantity") * 5).alias("value"))


_TEX = _TEX.replace("0.01*", "0.01::DOUBLE*")


@query("wall_source_tier", "WITH " + _TEX + ", c AS (SELECT building, wall, avg(visible::INT) AS c FROM tex GROUP BY ALL) SELECT building, wall, round(c,6) AS coverage, CASE WHEN c>=0.4::DOUBLE THEN 'photo' WHEN c>=0.15::DOUBLE THEN 'partial' ELSE 'procedural' END AS source FROM c")
def wall_source_tier(spark, d):
    return texture.coverage(texels(spark, d), "building", "wall").withColumn("coverage", F.round("coverage", 6))


@query("interior_holes", "WITH " + _TEX + ", s AS (SELECT building, wall, col, min(row) FILTER (visible) AS a, max(row) FILTER (visible) AS b FROM tex GROUP BY ALL) SELECT building, wall, col, row FROM tex JOIN s USING (building, wall, col) WHERE NOT visible AND row>a AND row<b")
def interior_holes(spark, d):
    return texture.interior_holes(texels(spark, d), "building", "wall").select("building", "wall", "col", "row")


@query("normalise_walls", "WITH " + _TEX + """, s AS (SELECT building, wall, avg(visible::INT) AS c, avg(value) FILTER (visible) AS mu, stddev_pop(value) FILTER (visible) AS sd FROM tex GROUP BY ALL HAVING avg(visible::INT)>=0.15::DOUBLE),
r AS (SELECT building, min(struct_pack(n:=-c,w:=wall,mu:=mu,sd:=sd)) AS r FROM s GROUP BY building), b AS (SELECT s.building, s.wall, s.mu, r.mu AS rm, CASE WHEN s.wall=r.w THEN 1.0::DOUBLE ELSE greatest(0.8::DOUBLE,least(1.25::DOUBLE,r.sd/greatest(sd,1e-3))) END AS k FROM s JOIN r ON s.building=r.building)
SELECT building, wall, round(sum(coalesce(greatest(0,least(255,(value-mu)*k+rm)),value)),3) AS total FROM tex LEFT JOIN b USING (building, wall) GROUP BY ALL""".replace("r.mu AS rm", "r.r.mu AS rm").replace("s.wall=r.w", "s.wall=r.r.w").replace("r.sd/", "r.r.sd/"))
def normalise_walls(spark, d):
    return texture.normalise(texels(spark, d)).groupBy("building", "wall").agg(F.round(F.sum("matched"), 3).alias("total"))


@query("camera_project", """SELECT p_partkey, round(500+800*rx/z,4)+0.0::DOUBLE AS px, round(400-800*ry/z,4)+0.0::DOUBLE AS py FROM (SELECT p_partkey, e*cos(y)-n*sin(y) AS rx, -e*sin(y)*sin(0.1)-n*cos(y)*sin(0.1)+u*cos(0.1) AS ry, e*sin(y)*cos(0.1)+n*cos(y)*cos(0.1)+u*sin(0.1) AS z FROM (SELECT p_partkey, radians((p_partkey%30)::DOUBLE) AS y, (p_partkey%17)::DOUBLE AS e, 40.0::DOUBLE+p_size AS n, (p_partkey%9)::DOUBLE AS u FROM part))""")
def camera_project(spark, d):
    k = F.col("p_partkey")
    px, py = camera.project((k % 30).cast("double"), F.lit(math.degrees(0.1)), F.lit(800.0), F.lit(1000.0), F.lit(800.0), ((k % 17).cast("double"), 40.0 + F.col("p_size"), (k % 9).cast("double")))
    return table(spark, d, "part").select("p_partkey", r6(px, 4).alias("px"), r6(py, 4).alias("py"))


@query("openings_on_walls", _WALL + """, c AS (SELECT id, wall, ax, ay, dx, dy, sqrt(dx*dx+dy*dy) AS n FROM e), h AS (SELECT *, (ax-300)*dy/n+(ay-200)*(-dx)/n AS num, (-0.8::DOUBLE)*dy/n+(-0.6::DOUBLE)*(-dx)/n AS tw FROM c), t AS (SELECT *, num/tw AS t FROM h WHERE tw<-1e-9),
a AS (SELECT *, ((300-0.8::DOUBLE*t-ax)*dx+(200-0.6::DOUBLE*t-ay)*dy)/n AS al FROM t) SELECT id, wall::BIGINT AS wall, round(t,4) AS t, round(al,4)+0.0::DOUBLE AS along FROM a WHERE t>0 AND al>=-greatest(0.5::DOUBLE,t*tan(radians(1.25::DOUBLE))) AND al<=n+greatest(0.5::DOUBLE,t*tan(radians(1.25::DOUBLE)))""")
def openings_on_walls(spark, d):
    """A level ray from a fixed camera at every wall's plane, with the fit's angular tolerance."""
    e = l_rings(spark, d).select("id", F.posexplode(g.edges(F.col("ring"))).alias("wall", "e"))
    origin, ray = (F.lit(300.0), F.lit(200.0), F.lit(1.7)), (F.lit(-0.8), F.lit(-0.6), F.lit(0.0))
    first = camera.wall_hit(origin, ray, F.col("e"), F.lit(10.0), F.lit(0.0))
    hit = e.withColumn("t0", first["t"]).withColumn("h", camera.wall_hit(origin, ray, F.col("e"), F.lit(10.0), camera.corner_tolerance(F.col("t0"))))
    return hit.where("h.valid").select("id", F.col("wall").cast("long").alias("wall"), F.round("h.t", 4).alias("t"), r6(F.col("h.along"), 4).alias("along"))


@query("up_axis")
def up_axis(spark, d):
    """Up axis of each mesh's points: the second axis unless another's cross-sections are clearly more constant."""

    def run(t: pa.Table) -> pa.Table:
        axis, sign = kernels.up_axis(np.column_stack([t[c].to_numpy() for c in "xyz"]))
        return pa.table({"mesh": t["mesh"].slice(0, 1), "axis": pa.array([axis], pa.int32()), "sign": pa.array([sign], pa.int32())})

    return cloud(spark, d).select("mesh", "x", "y", "z").groupBy("mesh").applyInArrow(run, "mesh long, axis int, sign int")


@query("atlas_shelves")
def atlas_shelves(spark, d):
    """Shelf layout of each photo's boxes."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("box")
        sizes = [(int(w), int(h)) for w, h in zip(t["w"].to_pylist(), t["h"].to_pylist(), strict=True)]
        places, (wide, tall) = texture.shelves(sizes, 1024) or ([(-1, -1)] * len(sizes), (0, 0))
        return pa.table({"photo": t["photo"], "box": t["box"], "x": pa.array([p[0] for p in places], pa.int32()), "y": pa.array([p[1] for p in places], pa.int32()), "wide": pa.array([wide] * len(sizes), pa.int32()), "tall": pa.array([tall] * len(sizes), pa.int32())})

    return boxes(spark, d).select("photo", "box", (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h")).groupBy("photo").applyInArrow(run, "photo long, box long, x int, y int, wide int, tall int")


@query("camera_fit")
def camera_fit(spark, d):
    """Camera offsets recovered from the silhouette of every L prism, over a small grid."""

    def run(rings):
        fits = []
        for p in rings:
            at = p.mean(0) - [0, 90]
            cam = {"position": np.array([*at, 1.7]), "yaw": 0.0, "pitch": 5.0, "f": 60.0}
            truth = cam | {"yaw": 2.0, "position": cam["position"] + [4.0, 0.0, 0.0]}
            fits.append(kernels.fit_camera(p, 12.0, kernels.silhouette(p, 12.0, truth, 64, 48), cam, yaws=np.arange(-4, 5, 2.0), pitches=np.array([0.0]), shifts=np.arange(-8, 9, 4.0), fine=np.array([-2.0, 0.0, 2.0])))
        return [[f[c] for f in fits] for c in ("iou", "yaw", "dx", "dy")]

    from plotwise.plans.placement import ring_kernel

    return ring_kernel(l_rings(spark, d).select("id", "ring"), run, "id long, iou double, yaw double, dx double, dy double")


@query("roof_frames")
def roof_frames(spark, d):
    from plotwise.plans.placement import kernel_rows

    def run(id, ring):  # noqa: A002
        _, (low, high) = kernels.roof_frame(np.array([(q["x"], q["y"]) for q in ring]))
        return id, round(float(high[0] - low[0]), 6), round(float(high[1] - low[1]), 6)

    return kernel_rows(l_rings(spark, d), run, "id long, along double, across double", "id", "ring")
