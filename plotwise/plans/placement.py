"""Queries over selection, poses, orientation, box relations, cameras and the numeric kernels."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plotwise import batches, kernels
from plotwise.derive import boxes, ctes, l_rings, points, r6, star_rings
from plotwise.functions import rings as g
from plotwise.operators import detect, gate, orient, select
from plotwise.session import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


# ---------------------------------------------------------------- selection


def buildings(spark, d):
    k = F.col("p_partkey")
    x, y = ((k * 3701) % 9000).cast("double"), ((k * 5303) % 7000).cast("double")
    return table(spark, d, "part").select(k.alias("bid"), (k % 40).alias("number"), x.alias("x0"), y.alias("y0"), (x + 20.0 + F.col("p_size") * 3).alias("x1"), (y + 30.0 + (k * 7) % 90).alias("y1"))


def addresses(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("aid"), (k % 40).alias("wanted"), ((k * 977) % 9000).cast("double").alias("px"), ((k * 613) % 7000).cast("double").alias("py"))


_AB = """b AS (SELECT p_partkey AS bid, p_partkey%40 AS number, ((p_partkey*3701)%9000)::DOUBLE AS x0, ((p_partkey*5303)%7000)::DOUBLE AS y0, ((p_partkey*3701)%9000)::DOUBLE+20+p_size*3 AS x1, ((p_partkey*5303)%7000)::DOUBLE+30+(p_partkey*7)%90 AS y1 FROM part),
a AS (SELECT s_suppkey AS aid, s_suppkey%40 AS wanted, ((s_suppkey*977)%9000)::DOUBLE AS px, ((s_suppkey*613)%7000)::DOUBLE AS py FROM supplier),
"""
_B = _AB + """nb AS (SELECT * FROM (SELECT a.*, b.*, sqrt(pow(greatest(x0-px,px-x1,0),2)+pow(greatest(y0-py,py-y1,0),2)) AS d FROM a, b) WHERE d<=60),
c AS (SELECT aid, bid, d, d=0 AS contained, number=wanted AS named FROM nb)"""
_CHOSEN = """, f AS (SELECT aid, min(bid) FILTER (contained AND named) AS both_, count(*) FILTER (contained) AS nc, min(bid) FILTER (contained) AS cont, count(*) FILTER (named) AS nn, (min(struct_pack(d:=d,b:=bid)) FILTER (named AND d<=50)).b AS near_, count(*) FILTER (d<=50) AS nr, min(bid) FILTER (d<=50) AS only_ FROM c GROUP BY aid),
s AS (SELECT aid, CASE WHEN both_ IS NOT NULL THEN both_ WHEN nc=1 THEN cont WHEN nn>0 THEN near_ WHEN nr=1 THEN only_ END AS bid, CASE WHEN both_ IS NOT NULL THEN 'contained_and_named' WHEN nc=1 THEN 'contained' WHEN nn>0 THEN 'name_match' WHEN nr=1 THEN 'unnamed_sole_candidate' END AS q FROM f)"""


def near(spark, d):
    return select.near_boxes(addresses(spark, d), buildings(spark, d), 60.0).select("aid", "bid", "d", (F.col("d") == 0).alias("contained"), (F.col("number") == F.col("wanted")).alias("named"))


@query("footprint_select_ladder", "WITH " + _B + _CHOSEN + " SELECT aid, bid, CASE WHEN bid IS NOT NULL THEN q END AS match_quality, CASE WHEN bid IS NULL THEN 'quarantined' ELSE 'ok' END AS status FROM s")
def footprint_select_ladder(spark, d):
    return select.select_footprint(near(spark, d), "aid", "bid")


@query("neighbours_anti", "WITH " + _B + _CHOSEN + " SELECT c.aid, c.bid FROM c ANTI JOIN s ON c.aid=s.aid AND c.bid=s.bid")
def neighbours_anti(spark, d):
    n = near(spark, d)
    return n.select("aid", "bid").join(select.select_footprint(n, "aid", "bid"), ["aid", "bid"], "left_anti")


@query("street_filter", """WITH e AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'residential' WHEN 'click' THEN 'service' WHEN 'error' THEN 'footway' WHEN 'signup' THEN 'primary' ELSE 'steps' END AS highway, CASE user_id%4 WHEN 0 THEN 'parking_aisle' WHEN 1 THEN 'alley' END AS service FROM events)
SELECT highway, service, count(*)::BIGINT AS n FROM e WHERE highway IN ('residential','service','primary') AND (service IS NULL OR service<>'parking_aisle') GROUP BY ALL""")
def street_filter(spark, d):
    t = F.col("event_type")
    e = table(spark, d, "events").select(F.when(t == "view", "residential").when(t == "click", "service").when(t == "error", "footway").when(t == "signup", "primary").otherwise("steps").alias("highway"), F.when(F.col("user_id") % 4 == 0, "parking_aisle").when(F.col("user_id") % 4 == 1, "alley").alias("service"))
    return e.where(select.is_street()).groupBy("highway", "service").agg(F.count("*").alias("n"))


@query("road_nearest_vertex", """WITH a AS (SELECT s_suppkey AS aid, ((s_suppkey*977)%9000)::DOUBLE AS px, ((s_suppkey*613)%7000)::DOUBLE AS py FROM supplier), r AS (SELECT c_custkey AS rid, ((c_custkey*7919)%9000)::DOUBLE AS x, ((c_custkey*3571)%7000)::DOUBLE AS y FROM customer),
m AS (SELECT aid, min(struct_pack(d:=sqrt(pow(x-px,2)+pow(y-py,2)), rid:=rid, e:=x-px, n:=y-py)) AS m FROM a, r WHERE sqrt(pow(x-px,2)+pow(y-py,2))<=120 GROUP BY aid) SELECT aid, m.rid AS rid, round(m.d,6) AS d, round(atan2(m.n,m.e),6)+0.0::DOUBLE AS normal FROM m""")
def road_nearest_vertex(spark, d):
    """The nearest road vertex within 120 m of each footprint's middle, over grid cells."""
    k = F.col("c_custkey")
    x, y = ((k * 7919) % 9000).cast("double"), ((k * 3571) % 7000).cast("double")
    roads = table(spark, d, "customer").select(k.alias("rid"), x.alias("x0"), y.alias("y0"), x.alias("x1"), y.alias("y1"))
    n = select.near_boxes(addresses(spark, d), roads, 120.0)
    m = n.groupBy("aid").agg(F.min(F.struct("d", "rid", (F.col("x0") - F.col("px")).alias("e"), (F.col("y0") - F.col("py")).alias("n"))).alias("m"))
    return m.select("aid", "m.rid", r6(F.col("m.d")).alias("d"), r6(F.atan2("m.n", "m.e")).alias("normal"))


_OVER = _B + ", o AS (SELECT p.bid AS bid, q.bid AS other, (least(p.x1,q.x1)-greatest(p.x0,q.x0))*(least(p.y1,q.y1)-greatest(p.y0,q.y0)) AS common, (p.x1-p.x0)*(p.y1-p.y0) AS area, q.number AS h FROM b p JOIN b q ON p.bid<>q.bid AND p.x0<q.x1 AND q.x0<p.x1 AND p.y0<q.y1 AND q.y0<p.y1)"


def overlaps(spark, d):
    b = buildings(spark, d)
    other = b.select(F.col("bid").alias("other"), F.col("number").alias("h"), F.col("x0").alias("u0"), F.col("y0").alias("v0"), F.col("x1").alias("u1"), F.col("y1").alias("v1"))
    return select.overlapping(b, other).where("bid <> other").withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))


@query("neighbour_overlap_boxes", "WITH " + _OVER + " SELECT bid, round(max(common/area),6) AS overlap FROM o GROUP BY bid")
def neighbour_overlap_boxes(spark, d):
    return overlaps(spark, d).groupBy("bid").agg(r6(F.max(F.col("common") / F.col("area"))).alias("overlap"))


@query("overlap_best_match", "WITH " + _OVER + " SELECT bid, (max(struct_pack(c:=common, h:=h, o:=other))).o AS other, round(sum(common)/any_value(area),6) AS coverage, min(h) AS low, max(h) AS high FROM o GROUP BY bid")
def overlap_best_match(spark, d):
    """Pairs are made and summed up by cell in numpy, so only a row a box and cell is grouped; crowded maps have pairs by the square of the boxes."""
    size = 128.0
    b = buildings(spark, d)
    cell = F.explode(select.cells(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), size)).alias("c")
    dealt = b.select("bid", "number", "x0", "y0", "x1", "y1", cell).select("*", "c.cx", "c.cy").drop("c").repartition(SOLVER_TASKS, "cx", "cy").sortWithinPartitions("cx", "cy")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in found:  # a cell's rows may go on in the next batch
            t = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(8)])
            t = t if carried is None else np.concatenate([carried, t])
            cuts = np.flatnonzero((np.diff(t[:, 6:], axis=0) != 0).any(1)) + 1
            *whole, carried = np.split(t, cuts)
            for part in whole:
                yield from best_in_cell(part, size)
        if carried is not None:
            yield from best_in_cell(carried, size)

    part = dealt.mapInArrow(run, "bid long, area double, common double, h long, other long, total double, low long, high long")
    best = F.max(F.struct("common", "h", "other"))["other"]
    return part.groupBy("bid").agg(best.alias("other"), r6(F.sum("total") / F.first("area")).alias("coverage"), F.min("low").alias("low"), F.max("high").alias("high"))


def best_in_cell(t: np.ndarray, size: float) -> Iterator[pa.RecordBatch]:
    """Rows (bid, h, x0, y0, x1, y1, cx, cy) of one cell: of each box with a neighbour whose common area's lower corner lies
    in the cell, the largest (common, h, other), the sum of common areas and the range of h."""
    t = t[np.lexsort((t[:, 0], t[:, 1]))]  # by h, then bid: the last of equal areas is the best
    bid, h, x0, y0, x1, y1 = t[:, :6].T
    cx, cy = t[0, 6], t[0, 7]
    rows, last = max(1, (1 << 18) // len(t)), len(t) - 1
    for i in range(0, len(t), rows):
        at = slice(i, i + rows)
        lx, ly = np.maximum(x0[at, None], x0), np.maximum(y0[at, None], y0)
        w, tall = np.minimum(x1[at, None], x1) - lx, np.minimum(y1[at, None], y1) - ly
        # The lower corner lies within both boxes, so it's in the cell if it isn't below or left of it, nor beyond it.
        ok = (w > 0) & (tall > 0) & (np.floor(lx / size) == cx) & (np.floor(ly / size) == cy) & (bid[at, None] != bid)
        met = ok.any(1)
        if not met.any():
            continue
        ok, common = ok[met], (w[met] * tall[met])
        common[~ok] = -1.0
        best = last - common[:, ::-1].argmax(1)
        every = np.arange(len(best))
        own = np.arange(len(t))[at][met]
        area = (x1[own] - x0[own]) * (y1[own] - y0[own])
        low, high = h[ok.argmax(1)], h[last - ok[:, ::-1].argmax(1)]
        whole = lambda v: pa.array(v.astype(np.int64))
        columns = [whole(bid[own]), pa.array(area), pa.array(common[every, best]), whole(h[best]), whole(bid[best]), pa.array(np.where(ok, common, 0.0).sum(1)), whole(low), whole(high)]
        yield pa.RecordBatch.from_arrays(columns, names=["bid", "area", "common", "h", "other", "total", "low", "high"])


# ---------------------------------------------------------------- poses


def fitted(spark, d):
    """Footprint and model boxes of every L ring in closed form: the model is the unturned ring, half as large."""
    r = l_rings(spark, d)
    long = F.col("w") >= F.col("h")
    angle = F.pmod(F.col("turn") + F.when(long, 0.0).otherwise(math.pi / 2), F.lit(math.pi))
    c, s = F.cos("turn"), F.sin("turn")
    return r.select(
        "id", "w", "h", "f", "turn", F.greatest("w", "h").alias("f_a"), F.least("w", "h").alias("f_b"), angle.alias("f_angle"), ((c * F.col("w") - s * F.col("h")) / 2).alias("f_cx"), ((s * F.col("w") + c * F.col("h")) / 2).alias("f_cy"),
        (F.greatest("w", "h") / 2).alias("m_a"), (F.least("w", "h") / 2).alias("m_b"), F.when(long, 0.0).otherwise(math.pi / 2).alias("m_angle"), (F.col("w") / 4).alias("m_cx"), (F.col("h") / 4).alias("m_cy"),
    )


_FIT = ctes("l_base") + """, p AS (SELECT *, greatest(w,h) AS fa, least(w,h) AS fb, CASE WHEN w>=h THEN 0 ELSE pi()/2 END AS ma, turn+CASE WHEN w>=h THEN 0 ELSE pi()/2 END AS ra FROM l_base),
q AS (SELECT p.*, k, ra-floor(ra/pi())*pi()-ma+k*pi()/2 AS theta, CASE WHEN k%2=0 THEN 2.0::DOUBLE ELSE (fb/(fa/2)+fa/(fb/2))/2 END AS s FROM p, range(4) r(k))"""


@query("ombb_candidates", _FIT + """ SELECT id, k::INTEGER AS k, round(cos(theta),6)+0.0::DOUBLE AS c, round(sin(theta),6)+0.0::DOUBLE AS sn, round(s,6) AS s, round((cos(turn)*w-sin(turn)*h)/2-s*(cos(theta)*w/4-sin(theta)*h/4),5)+0.0::DOUBLE AS tx, round((sin(turn)*w+cos(turn)*h)/2-s*(sin(theta)*w/4+cos(theta)*h/4),5)+0.0::DOUBLE AS ty FROM q""")
def ombb_candidates(spark, d):
    c = orient.candidates(fitted(spark, d))
    return c.select("id", "k", r6(F.cos("theta")).alias("c"), r6(F.sin("theta")).alias("sn"), r6(F.col("s")).alias("s"), r6(F.col("tx"), 5).alias("tx"), r6(F.col("ty"), 5).alias("ty"))


_IOUS = "[0.5::DOUBLE+(p_partkey%11)/40.0::DOUBLE, 0.4::DOUBLE+(p_partkey%7)/20.0::DOUBLE, 0.5::DOUBLE+(p_partkey%13)/50.0::DOUBLE, 0.3::DOUBLE+(p_partkey%5)/20.0::DOUBLE]"


def cues(spark, d):
    """Each part with four overlaps, an aspect and the turns that the cues would choose."""
    k = F.col("p_partkey")
    ious = F.array(0.5 + (k % 11) / 40.0, 0.4 + (k % 7) / 20.0, 0.5 + (k % 13) / 50.0, 0.3 + (k % 5) / 20.0)
    pick = lambda m, n: F.when(k % m == 0, (F.floor(k / n) % 4).cast("int"))
    return table(spark, d, "part").select(k.alias("id"), ious.alias("ious"), (1.0 + (k % 20) / 40.0).alias("aspect"), pick(5, 3).alias("exif"), pick(2, 7).alias("sil"), ((k % 9) / 50.0).alias("sil_margin"), pick(3, 11).alias("road"), ((k % 8) / 80.0).alias("spread"), ((k % 6) / 5.0).alias("off"))


_CUES = f"""WITH q AS (SELECT p_partkey AS id, {_IOUS} AS ious, 1.0::DOUBLE+(p_partkey%20)/40.0::DOUBLE AS aspect, CASE WHEN p_partkey%5=0 THEN (p_partkey//3)%4 END AS exif, CASE WHEN p_partkey%2=0 THEN (p_partkey//7)%4 END AS sil0, (p_partkey%9)/50.0::DOUBLE AS sm, CASE WHEN p_partkey%3=0 THEN (p_partkey//11)%4 END AS road, (p_partkey%8)/80.0::DOUBLE AS spread, (p_partkey%6)/5.0::DOUBLE AS off FROM part),
u AS (SELECT q.*, k, ious[k+1] AS v FROM q, range(4) r(k)), rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, k) AS r FROM u),
z AS (SELECT id, any_value(ious) AS ious, any_value(aspect) AS aspect, any_value(exif) AS exif, CASE WHEN any_value(sm)>=0.08 THEN any_value(sil0) END AS sil, any_value(sm) AS sm, any_value(road) AS road, any_value(spread) AS spread, any_value(off) AS off, max(v) FILTER (r=1)-max(v) FILTER (r=2) AS m, (min(struct_pack(r:=r,k:=k)) FILTER (aspect<=1.1 OR k%2=0)).k AS best FROM rk GROUP BY id),
l AS (SELECT *, exif<>sil AS conflict, CASE WHEN exif IS NOT NULL THEN 'exif_heading' WHEN aspect<1.1 AND m<0.05 AND sm<0.05 THEN 'arbitrary_symmetric' WHEN sil IS NOT NULL THEN 'silhouette' WHEN road IS NOT NULL AND spread>0.05 AND off<pi()/4 THEN 'facade_detail' WHEN road IS NOT NULL THEN 'road_normal' ELSE 'aspect_ratio' END AS by_ FROM z)"""


@query("candidate_margin", _CUES + " SELECT id, best::INTEGER AS best, round(m,6)+0.0::DOUBLE AS margin FROM z")
def candidate_margin(spark, d):
    c = cues(spark, d)
    best = F.filter(orient.ranked(F.col("ious")), lambda x: orient.viable(x["k"], F.col("aspect")))[0]["k"]
    return c.select("id", best.alias("best"), r6(orient.margin(F.col("ious"))).alias("margin"))


@query("viable_by_aspect", _CUES + " SELECT id, list_filter([0,1,2,3], lambda k: aspect<=1.1 OR k%2=0)::VARCHAR AS turns FROM q")
def viable_by_aspect(spark, d):
    turns = F.filter(F.sequence(F.lit(0), F.lit(3)), lambda k: orient.viable(k, F.col("aspect")))
    return cues(spark, d).select("id", F.concat(F.lit("["), F.array_join(turns.cast("array<string>"), ", "), F.lit("]")).alias("turns"))


@query("orientation_ladder", _CUES + " SELECT id, (CASE by_ WHEN 'exif_heading' THEN exif WHEN 'arbitrary_symmetric' THEN best WHEN 'silhouette' THEN sil WHEN 'facade_detail' THEN road WHEN 'road_normal' THEN road ELSE best END)::INTEGER AS k, by_ AS disambiguated_by, conflict FROM l")
def orientation_ladder(spark, d):
    o = orient.ladder(*[F.col(c) for c in ("exif", "sil", "sil_margin", "road", "spread", "off", "ious", "aspect")])
    return cues(spark, d).withColumn("o", o).select("id", "o.k", F.col("o.by").alias("disambiguated_by"), "o.conflict")


@query("exif_silhouette_conflict", _CUES + " SELECT conflict, by_ AS disambiguated_by, count(*)::BIGINT AS n FROM l GROUP BY ALL")
def exif_silhouette_conflict(spark, d):
    o = orient.ladder(*[F.col(c) for c in ("exif", "sil", "sil_margin", "road", "spread", "off", "ious", "aspect")])
    return cues(spark, d).withColumn("o", o).groupBy("o.conflict", F.col("o.by").alias("disambiguated_by")).agg(F.count("*").alias("n"))


@query("symmetry_label", _CUES + " SELECT CASE WHEN m<0.05 AND greatest(aspect,1/aspect)<1.1 THEN 'symmetric' ELSE 'distinct' END AS label, count(*)::BIGINT AS n FROM z GROUP BY ALL")
def symmetry_label(spark, d):
    return cues(spark, d).groupBy(orient.symmetry_label(orient.margin(F.col("ious")), F.col("aspect")).alias("label")).agg(F.count("*").alias("n"))


@query("umeyama_closed_form", ctes("l_base") + " SELECT id, round(cos(turn),6)+0.0::DOUBLE AS c, round(sin(turn),6)+0.0::DOUBLE AS s, 1.5::DOUBLE AS scale, round(10.0::DOUBLE,5) AS tx, round(-4.0::DOUBLE,5) AS ty FROM l_base")
def umeyama_closed_form(spark, d):
    """Each L ring against itself turned, scaled by 1.5 and shifted by (10, -4): the closed form gets all four back."""
    r = l_rings(spark, d).select("id", "turn", F.explode("ring").alias("p"))
    c, s = F.cos("turn"), F.sin("turn")
    x1, x2 = F.col("p.x"), F.col("p.y")
    u = orient.umeyama(r.select("id", x1.alias("x1"), x2.alias("x2"), (1.5 * (c * x1 - s * x2) + 10.0).alias("y1"), (1.5 * (s * x1 + c * x2) - 4.0).alias("y2")), "id")
    return u.select("id", r6(F.cos("theta")).alias("c"), r6(F.sin("theta")).alias("s"), r6(F.col("scale")).alias("scale"), r6(F.col("tx"), 5).alias("tx"), r6(F.col("ty"), 5).alias("ty"))


@query("mesh_to_enu_matrix", ctes("l_base") + """ SELECT id, round(2*cos(turn),6)+0.0::DOUBLE AS m00, round(-3*sin(turn),6)+0.0::DOUBLE AS m01, round(2*cos(turn)*(-w/2)-3*sin(turn)*(-h/2)+7,6)+0.0::DOUBLE AS m03, round(2*sin(turn)*(-w/2)+3*cos(turn)*(-h/2)-2,6)+0.0::DOUBLE AS m13, round(-0.5::DOUBLE*4+1,6) AS m23 FROM l_base""")
def mesh_to_enu_matrix(spark, d):
    r = l_rings(spark, d)
    zero, one = F.lit(0.0), F.lit(1.0)
    canonical = F.array(F.array(one, zero, zero, -F.col("w") / 2), F.array(zero, one, zero, -F.col("h") / 2), F.array(zero, zero, one, F.lit(-0.5)), F.array(zero, zero, zero, one))
    m = orient.matmul(orient.pose_matrix(F.col("turn"), F.lit(2.0), F.lit(3.0), F.lit(4.0), F.lit(7.0), F.lit(-2.0), one), canonical)
    return r.withColumn("m", m).select("id", r6(F.col("m")[0][0]).alias("m00"), r6(F.col("m")[0][1]).alias("m01"), r6(F.col("m")[0][3]).alias("m03"), r6(F.col("m")[1][3]).alias("m13"), r6(F.col("m")[2][3]).alias("m23"))


# ---------------------------------------------------------------- boxes of a photo

_PAIR = ctes("box") + """, pr AS (SELECT a.photo, a.box AS abox, o.box AS obox, a.type AS atype, o.type AS otype, a.x1-a.x0 AS w, a.y1-a.y0 AS h, o.x1-o.x0 AS ow, o.y1-o.y0 AS oh, (a.y0+a.y1)/2 AS acy, (o.y0+o.y1)/2 AS ocy, a.y0 AS ay0, o.y1 AS oy1,
greatest(0,least(a.x1,o.x1)-greatest(a.x0,o.x0)) AS ix, greatest(0,least(a.y1,o.y1)-greatest(a.y0,o.y0)) AS iy FROM box a JOIN box o ON a.photo=o.photo AND a.box<>o.box)"""


@query("box_iou_pairs", _PAIR + " SELECT photo, abox AS box, obox AS other, round(ix*iy/(w*h+ow*oh-ix*iy),6) AS iou FROM pr WHERE ix*iy>0 AND abox<obox")
def box_iou_pairs(spark, d):
    p = detect.pairs(boxes(spark, d), (detect.common() > 0) & (F.col("a.box") < F.col("o.box")))
    return p.select("a.photo", "a.box", F.col("o.box").alias("other"), r6(detect.iou()).alias("iou"))


@query("row_peers", _PAIR + " SELECT b.photo, b.box, count(abox)::BIGINT AS peers FROM box b LEFT JOIN pr ON pr.abox=b.box AND abs(ocy-acy)<0.35*h AND oh/h>0.7 AND oh/h<1.4 GROUP BY ALL")
def row_peers(spark, d):
    return detect.row_peers(boxes(spark, d))


@query("window_above", _PAIR + " SELECT DISTINCT photo, abox AS box FROM pr WHERE otype='window' AND ow>=0.8*w AND ow<=1.2*w AND ix/least(w,ow)>0.6 AND ocy<acy AND oy1<=ay0+0.25*h")
def window_above(spark, d):
    return detect.window_above(boxes(spark, d))


@query("containment_relabel", _PAIR + """, held AS (SELECT abox, bool_or(otype IN ('door','garage_door','entrance')) AS passable FROM pr WHERE atype<>'other' AND otype<>'other' AND ix*iy/(ow*oh)>0.7 AND ow*oh<0.5*w*h GROUP BY abox)
SELECT photo, box, CASE WHEN passable IS NULL THEN type ELSE 'other' END AS type, CASE WHEN passable THEN 'recess' WHEN NOT passable THEN 'facade_section' END AS label FROM box LEFT JOIN held ON abox=box""")
def containment_relabel(spark, d):
    return detect.relabel(boxes(spark, d))


@query("openings_counts", ctes("box") + " SELECT type, CASE WHEN score>=0.5 THEN 'accept' ELSE 'review' END AS decision, count(*)::BIGINT AS n FROM box WHERE least(x1-x0,y1-y0)>=12 AND (x1-x0)*(y1-y0)<=0.06*1000*800 GROUP BY ALL")
def openings_counts(spark, d):
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    kept = boxes(spark, d).where((F.least(w, h) >= 12) & (w * h <= 0.06 * 1000 * 800))
    return kept.groupBy("type", F.when(F.col("score") >= 0.5, "accept").otherwise("review").alias("decision")).agg(F.count("*").alias("n"))


@query("reading_order", ctes("box") + " SELECT photo, box, row_number() OVER (PARTITION BY photo ORDER BY floor(y0/64.0::DOUBLE), x0, box)::INTEGER AS place FROM box")
def reading_order(spark, d):
    return detect.reading_order(boxes(spark, d))


@query("openings_kept", ctes("box") + """, o AS (SELECT photo, box, x0+(box%3)*4 AS x0, y0+(box%4)*5 AS y0, x1+(box%3)*4 AS x1, y1+(box%4)*5 AS y1 FROM box),
j AS (SELECT a.photo, a.box, o.box AS m, greatest(0,least(a.x1,o.x1)-greatest(a.x0,o.x0))*greatest(0,least(a.y1,o.y1)-greatest(a.y0,o.y0)) AS c, (a.x1-a.x0)*(a.y1-a.y0)+(o.x1-o.x0)*(o.y1-o.y0) AS s FROM box a JOIN o ON a.photo=o.photo)
SELECT photo, box, (min(struct_pack(n:=-round(c/(s-c),9), m:=m))).m AS match FROM j WHERE c/(s-c)>0.5 GROUP BY ALL""")
def openings_kept(spark, d):
    b = boxes(spark, d)
    dx, dy = (F.col("box") % 3) * 4, (F.col("box") % 4) * 5
    return detect.best_match(b, b.select("photo", "box", (F.col("x0") + dx).alias("x0"), (F.col("y0") + dy).alias("y0"), (F.col("x1") + dx).alias("x1"), (F.col("y1") + dy).alias("y1")))


# ---------------------------------------------------------------- walls, cameras, meshes

_WALL = ctes("l_base", "l_v") + """, e AS (SELECT a.id, a.i AS wall, a.x AS ax, a.y AS ay, b.x-a.x AS dx, b.y-a.y AS dy FROM l_v a JOIN l_v b ON a.id=b.id AND b.i=(a.i+1)%6)"""


@query("ray_wall_hits", _WALL + """, ray AS (SELECT e.*, rr, cos(0.5::DOUBLE+pi()+(rr-3.5)*0.02) AS rx, sin(0.5::DOUBLE+pi()+(rr-3.5)*0.02) AS ry, ax-cos(0.5::DOUBLE)*500 AS ox, ay-sin(0.5::DOUBLE)*500 AS oy FROM e, range(8) r(rr)),
t AS (SELECT id, rr, wall, (ox*dy-oy*dx)/nullif(rx*dy-ry*dx,0) AS t, (ox*ry-oy*rx)/nullif(rx*dy-ry*dx,0) AS s FROM ray)
SELECT id, rr AS ray, (min(struct_pack(t:=round(t,6), w:=wall))).w AS wall, round(min(t),4) AS t FROM t WHERE t>0 AND s>=0 AND s<=1 GROUP BY ALL""")
def ray_wall_hits(spark, d):
    """Eight rays from a camera 500 m out at every ring: nearest wall hit, each ray exploded against its ring's walls only."""
    e = l_rings(spark, d).select("id", F.posexplode(g.edges(F.col("ring"))).alias("wall", "e"), F.sequence(F.lit(0), F.lit(7)).alias("rays"))
    a = 0.5 + math.pi + (F.col("ray") - 3.5) * 0.02
    rx, ry = F.cos(a), F.sin(a)
    ox, oy = F.col("e.ax") - math.cos(0.5) * 500, F.col("e.ay") - math.sin(0.5) * 500
    dx, dy = F.col("e.bx") - F.col("e.ax"), F.col("e.by") - F.col("e.ay")
    det = F.when(rx * dy - ry * dx != 0, rx * dy - ry * dx)
    hits = e.select("id", F.col("wall").cast("long").alias("wall"), "e", F.explode(F.col("rays").cast("array<bigint>")).alias("ray")).select("id", "wall", "ray", ((ox * dy - oy * dx) / det).alias("t"), ((ox * ry - oy * rx) / det).alias("s"))
    hits = hits.where("t > 0 and s >= 0 and s <= 1")
    return hits.groupBy("id", "ray").agg(F.min(F.struct(F.round("t", 6).alias("t"), F.col("wall").alias("w")))["w"].alias("wall"), F.round(F.min("t"), 4).alias("t"))


@query("per_wall_group", ctes("l_base") + ", e AS (SELECT event_id, event_id%(SELECT count(*) FROM l_base) AS id, user_id%6 AS wall, value FROM events) SELECT id, wall, count(*)::BIGINT AS n, round(sum(value),4) AS total FROM e GROUP BY ALL")
def per_wall_group(spark, d):
    n = l_rings(spark, d).count()
    return table(spark, d, "events").groupBy((F.col("event_id") % n).alias("id"), (F.col("user_id") % 6).alias("wall")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("facade_mode_bearing", """WITH c AS (SELECT user_id, round(value)::BIGINT AS bearing, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, (max(struct_pack(n:=n, b:=-bearing))).b*-1 AS bearing, (max(struct_pack(n:=n, b:=-bearing))).n::BIGINT AS n FROM c GROUP BY user_id""")
def facade_mode_bearing(spark, d):
    c = table(spark, d, "events").groupBy("user_id", F.round("value").cast("long").alias("bearing")).agg(F.count("*").alias("n"))
    m = F.max(F.struct("n", (-F.col("bearing")).alias("b")))
    return c.groupBy("user_id").agg(m.alias("m")).select("user_id", (-F.col("m.b")).alias("bearing"), "m.n")


@query("robust_base", "SELECT l_suppkey, round(quantile_cont(l_extendedprice,0.01),4) AS base, round(quantile_cont(l_extendedprice,0.99)-quantile_cont(l_extendedprice,0.01),4) AS height FROM lineitem GROUP BY l_suppkey")
def robust_base(spark, d):
    p = F.percentile("l_extendedprice", F.array(F.lit(0.01), F.lit(0.99)))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(p.alias("p")).select("l_suppkey", F.round(F.col("p")[0], 4).alias("base"), F.round(F.col("p")[1] - F.col("p")[0], 4).alias("height"))


_PTS = "p AS (SELECT l_suppkey AS mesh, l_quantity-25 AS x, (l_extendedprice%1000)/20-25 AS y, l_discount*100 AS z FROM lineitem)"


def cloud(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("mesh"), (F.col("l_quantity") - 25).alias("x"), ((F.col("l_extendedprice") % 1000) / 20 - 25).alias("y"), (F.col("l_discount") * 100).alias("z"))


@query("side_density", "WITH " + _PTS + """, b AS (SELECT mesh, quantile_cont(x,0.02) AS lx, quantile_cont(x,0.98) AS hx, quantile_cont(y,0.02) AS ly, quantile_cont(y,0.98) AS hy, count(*) AS n FROM p GROUP BY mesh),
q AS (SELECT p.mesh, z, b.n, (hx-lx)/2 AS ex, (hy-ly)/2 AS ey, (x-(lx+hx)/2)/greatest((hx-lx)/2,1e-9) AS nx, (y-(ly+hy)/2)/greatest((hy-ly)/2,1e-9) AS ny FROM p JOIN b USING (mesh)),
s AS (SELECT *, CASE WHEN round(abs(nx),9)>=round(abs(ny),9) THEN CASE WHEN nx>0 THEN 0 ELSE 2 END ELSE CASE WHEN ny>0 THEN 1 ELSE 3 END END AS side FROM q WHERE round(greatest(abs(nx),abs(ny)),9)>=0.8)
SELECT mesh, side::INTEGER AS side, count(*)::BIGINT AS n, round(count(*)::DOUBLE/any_value(n)/((CASE WHEN side%2=0 THEN any_value(ey) ELSE any_value(ex) END)/(2*(any_value(ex)+any_value(ey)))),5) AS density FROM s GROUP BY mesh, side HAVING count(*)>=8""")
def side_density(spark, d):
    """Points near each side of a mesh's plan, per unit of wall, against its mean; sides with under eight points have none."""
    p = cloud(spark, d)
    two = lambda c: F.percentile(c, F.array(F.lit(0.02), F.lit(0.98)))
    b = p.groupBy("mesh").agg(two("x").alias("px"), two("y").alias("py"), F.count("*").alias("n"))
    ex, ey = (F.col("px")[1] - F.col("px")[0]) / 2, (F.col("py")[1] - F.col("py")[0]) / 2
    q = p.join(b, "mesh").select("mesh", "n", ex.alias("ex"), ey.alias("ey"), ((F.col("x") - (F.col("px")[0] + F.col("px")[1]) / 2) / F.greatest(ex, F.lit(1e-9))).alias("nx"), ((F.col("y") - (F.col("py")[0] + F.col("py")[1]) / 2) / F.greatest(ey, F.lit(1e-9))).alias("ny"))
    ax, ay = F.round(F.abs("nx"), 9), F.round(F.abs("ny"), 9)
    side = F.when(ax >= ay, F.when(F.col("nx") > 0, 0).otherwise(2)).otherwise(F.when(F.col("ny") > 0, 1).otherwise(3))
    s = q.where(F.greatest(ax, ay) >= 0.8).withColumn("side", side)
    length = F.when(F.col("side") % 2 == 0, F.first("ey")).otherwise(F.first("ex"))
    return s.groupBy("mesh", "side").agg(F.count("*").alias("n"), F.round(F.count("*") / F.first("n") / (length / (2 * (F.first("ex") + F.first("ey")))), 5).alias("density")).where("n >= 8")


@query("slab_areas_axis_extent", "WITH " + _PTS + """, b AS (SELECT mesh, min(z) AS lo, max(z) AS hi FROM p GROUP BY mesh HAVING max(z)-min(z)>1e-9), s AS (SELECT p.mesh, least(floor(round((z-lo)/(hi-lo)*20,6)),19) AS slab, x, y FROM p JOIN b USING (mesh)),
a AS (SELECT mesh, slab, (max(x)-min(x))*(max(y)-min(y)) AS area FROM s GROUP BY mesh, slab HAVING count(*)>=3) SELECT mesh, count(*)::BIGINT AS slabs, round(-stddev_pop(area)/avg(area),5)+0.0::DOUBLE AS score FROM a GROUP BY mesh HAVING count(*)>=6""")
def slab_areas(spark, d):
    """Cross-section constancy along z with box areas; slabs are keyed by mesh and slab, so one mesh spreads over tasks."""
    p = cloud(spark, d)
    b = p.groupBy("mesh").agg(F.min("z").alias("lo"), F.max("z").alias("hi")).where("hi - lo > 1e-9")
    s = p.join(b, "mesh").withColumn("slab", F.least(F.floor(F.round((F.col("z") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 20, 6)), F.lit(19)))
    a = s.groupBy("mesh", "slab").agg(((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area"), F.count("*").alias("n")).where("n >= 3")
    return a.groupBy("mesh").agg(F.count("*").alias("slabs"), r6(-F.stddev_pop("area") / F.avg("area"), 5).alias("score")).where("slabs >= 6")


@query("camera_grid_best", ctes("pt") + """, c AS (SELECT event_id, y, p, abs((y-15)*2.0::DOUBLE-(event_id%30))+abs((p-3)*3.0::DOUBLE-(event_id%11)) AS miss, y*7+p AS ord FROM pt, range(31) a(y), range(7) b(p)) SELECT event_id, (min(struct_pack(m:=round(miss,6),o:=ord))).o//7 AS yaw, (min(struct_pack(m:=round(miss,6),o:=ord))).o%7 AS pitch FROM c GROUP BY event_id""")
def camera_grid_best(spark, d):
    """Best of 31 x 7 yaw and pitch offsets in enumeration order; the grid is folded inside the row, nothing is exploded."""
    n, m = F.col("event_id") % 30, F.col("event_id") % 11
    grid = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(6)), lambda p: F.struct(F.round(F.abs((y - 15) * 2.0 - n) + F.abs((p - 3) * 3.0 - m), 6).alias("m"), (y * 7 + p).cast("long").alias("o")))))
    return points(spark, d).withColumn("b", F.array_min(grid)).select("event_id", F.floor(F.col("b.o") / 7).alias("yaw"), (F.col("b.o") % 7).alias("pitch"))


# ---------------------------------------------------------------- kernels


def kernel_rows(frame, run, schema: str, *columns: str):
    """A row-wise numpy kernel over Arrow batches."""
    names = [p.split()[0] for p in schema.split(",")]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [run(**r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=pa.schema([(p.split()[0], {"long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "string": pa.string()}[p.split()[1]]) for p in schema.split(",")]))

    return frame.select(*columns).mapInArrow(over, schema)


def ring_arrays(column: pa.ListArray) -> list[np.ndarray]:
    """Rings of an Arrow column as views of one flattened coordinate array."""
    xy = np.column_stack([c.to_numpy(zero_copy_only=False) for c in column.flatten().flatten()])
    ends = column.offsets.to_numpy()
    return [xy[a:b] for a, b in zip(ends[:-1] - ends[0], ends[1:] - ends[0], strict=True)]


#: Rings that a solver takes at once.
SOLVER_ROWS = 1024


def ring_kernel(frame, run, schema: str):
    """(id, ring) rows through a numpy kernel that takes many rings at once: run(rings) gives every column of ``schema`` but the id.

    The result must rest on the ring alone: equal rings are solved once.
    """
    names = ["ring", *(p.split()[0] for p in schema.split(",")[1:])]
    kinds = [pa.int32() if p.split()[1] == "int" else pa.float64() for p in schema.split(",")[1:]]

    def over(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for i in range(0, batch.num_rows, SOLVER_ROWS):
                part = batch.slice(i, SOLVER_ROWS)
                columns = run(ring_arrays(part.column(0)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    once = frame.select("ring").repartition(solver_tasks(frame.sparkSession, frame.count()), "ring").dropDuplicates(["ring"])
    solved = once.mapInArrow(over, f"ring {frame.schema['ring'].dataType.simpleString()}, " + schema.split(",", 1)[1])
    return frame.join(solved, "ring").select(F.col("id").cast("long").alias("id"), *names[1:])


def _ring(rows: list[dict]) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in rows])


@query("polygon_iou_general")
def polygon_iou_general(spark, d):
    """Overlap of each star ring with the next."""
    a = star_rings(spark, d)
    both = a.join(a.select((F.col("id") - 1).alias("id"), F.col("ring").alias("other")), "id")
    return kernel_rows(both, lambda id, ring, other: (id, round(kernels.iou([_ring(ring)], [_ring(other)]), 9)), "id long, iou double", "id", "ring", "other")


#: Most tasks that solvers' rows are dealt over.
SOLVER_TASKS = 64


def solver_tasks(spark, rows: int) -> int:
    """A batch's calls cost as much as some hundreds of rows: beyond a task a core, none gets fewer than 512."""
    return max(1, min(SOLVER_TASKS, max(rows // 512, min(spark.sparkContext.defaultParallelism, rows // 16))))


def _solver(**options):
    def run(targets):
        s = batches.Solver(targets, [(t @ kernels.rotation(0.4)) * 0.5 + [3.0, -7.0] for t in targets]).solve(**options)
        return s["k"], s["iou"], s["hausdorff_m"], s["margin"], s["sx"]

    return run


_SOLVED = "id long, k int, iou double, hausdorff_m double, margin double, scale double"


@query("icp_solve")
def icp_solve(spark, d):
    return ring_kernel(l_rings(spark, d).select("id", "ring"), _solver(use_refine=False), _SOLVED)


@query("nelder_mead_solve")
def nelder_mead_solve(spark, d):
    return ring_kernel(l_rings(spark, d).select("id", "ring"), _solver(), _SOLVED)


@query("nms_merge")
def nms_merge(spark, d):
    """Greedy suppression within each photo; the survivor keeps the best score of what it suppressed."""

    def run(table_: pa.Table) -> pa.Table:
        t = table_.sort_by("box")
        b = np.column_stack([t[c].to_numpy() for c in ("x0", "y0", "x1", "y1")])
        kept, merged = kernels.suppress(b, t["score"].to_numpy()[:, None], 0.3)
        return pa.table({"photo": t["photo"].take(kept), "box": t["box"].take(kept), "score": merged[:, 0]})

    return boxes(spark, d).select("photo", "box", "x0", "y0", "x1", "y1", "score").groupBy("photo").applyInArrow(run, "photo long, box long, score double")


@query("ring_stitch")
def ring_stitch(spark, d):
    """Each L ring split into three ways, one flipped, and walked together again."""

    def run(id, ring):  # noqa: A002
        p = [(q["x"], q["y"]) for q in ring]
        rings = kernels.stitch([p[:3], [p[4], p[3], p[2]], [p[4], p[5], p[0]]])
        return id, len(rings), round(abs(kernels.area(np.array(rings[0][:-1]))), 6)

    return kernel_rows(l_rings(spark, d), run, "id long, rings int, area double", "id", "ring")


@query("ground_outline")
def ground_outline(spark, d):
    """Outline of each mesh's point cloud in plan."""

    def run(table_: pa.Table) -> pa.Table:
        xy = np.column_stack([table_["x"].to_numpy(), table_["y"].to_numpy()])
        ring = kernels.ground_outline(xy, cells=16) if len(xy) >= 8 else xy
        return pa.table({"mesh": table_["mesh"].slice(0, 1), "corners": pa.array([len(ring)], pa.int32()), "area": [abs(kernels.area(ring)) if len(ring) > 2 else 0.0]})

    return cloud(spark, d).select("mesh", "x", "y").groupBy("mesh").applyInArrow(run, "mesh long, corners int, area double")


KINDS = ("clean", "noise", "lobe", "missing_wing", "anisotropy", "mirror", "mislabel_90")
CONFIGS = {"ombb": {"use_icp": False, "use_refine": False}, "+icp": {"use_refine": False}, "+nm": {}, "+nm_aniso": {"anisotropic": True}}


_TRIAL = "building_id long, corruption string, config string, gt_iou double, gt_hausdorff_m double, rot_err_deg double, rot_err_mod90_deg double, scale_err double, iou double, hausdorff_m double, area_ratio double, margin double, aniso double, rectilinearity double, label int, ms double"


def benchmark_rows(spark, d, reps: int = 1, rings=None):
    """Corrupted, randomly posed models of every ring, solved by each configuration: one row a solve.

    A stretch or a mirror is the placement's to undo or refuse, so the damaged outline is scored; other damage isn't,
    so the clean outline is, at the pose found. A mislabelled trial is made to start a quarter turn off the true
    candidate. A placement is good if it overlaps the truth by 0.8, is turned right to 10 degrees, and isn't a mirror
    that shows. Each trial's random numbers come from its own key, so neither order nor partitions change a row.
    Trials whose models have about as many points are solved together, and configurations share the steps they have in common; ``ms`` is
    a trial's share of the time that its steps took.
    """
    r = l_rings(spark, d) if rings is None else rings
    trials = r.select(F.col("id").cast("long").alias("id"), "ring").withColumn("kind", F.explode(F.array(*map(F.lit, KINDS)))).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    trials = trials.repartition(solver_tasks(spark, trials.count()), "id", "kind", "rep")
    whole = lambda x, period: np.degrees(np.abs(x - period * np.rint(x / period)))

    def trial(id, target, kind, rep):  # noqa: A002
        rng = np.random.default_rng([id, KINDS.index(kind), rep])
        box, middle = kernels.ombb(target), target.mean(0)
        theta, scale, shift = rng.uniform(0, 2 * math.pi), box["a"] * math.exp(rng.uniform(-0.3, 0.3)), rng.normal(0, 0.1, 2)
        to_model = lambda x: (x - middle) @ kernels.rotation(theta) / scale + shift
        damaged = kernels.corrupt(target, kind, rng, box=box)
        model = to_model(damaged)
        k, of_model = -1, kernels.ombb(model)
        if kind == "mislabel_90":
            off = [abs(math.remainder(c["theta"] - theta, 2 * math.pi)) for c in kernels.candidates(box, of_model)]
            k = (off.index(min(off)) + 1) % 4
        return id, kind, target, damaged, model, model if kind in ("anisotropy", "mirror") else to_model(target), box, of_model, theta, scale, k, abs(kernels.area(target)) / max(box["a"] * box["b"], 1e-9)

    def solved(some: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, kinds, targets, damaged, models, scored, *of, theta, scale, k, right = map(list, zip(*some, strict=True))
        theta, scale, k, right = map(np.array, (theta, scale, k, right))
        solver, scored = batches.Solver(targets, models, k, tuple(of)), batches.listed(scored)
        shows = (np.array(kinds) == "mirror") & (batches.iou(batches.listed(damaged), solver.target) < 0.95)
        for config, options in CONFIGS.items():
            s = solver.solve(**options)
            on = batches.placed(scored, s["pose"])
            gt, off = batches.iou(on, solver.target), whole(s["theta"] - theta, 2 * math.pi)
            label = (gt >= 0.8) & (off < 10) & ~shows
            columns = [
                gt, batches.hausdorff(on.points, solver.target.points), off, whole(s["theta"] - theta, math.pi / 2), np.abs(np.sqrt(s["sx"] * s["sy"]) / scale - 1),
                s["iou"], s["hausdorff_m"], s["area_ratio"], s["margin"], s["aniso"], right,
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(kinds), pa.array([config] * len(ids)), *map(pa.array, columns), pa.array(label.astype(np.int32)), pa.array(np.full(len(ids), s["seconds"] * 1000))],
                names=[p.split()[0] for p in _TRIAL.split(",")],
            )

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            alike: dict[int, list[tuple]] = {}  # models by their number of points, as shorter rings are padded
            for row in zip(batch.column(0).to_pylist(), ring_arrays(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                made = trial(*row)
                own = alike.setdefault(sum(len(made[4]) > most for most in (9, 16, 24)), [])
                own.append(made)
                if len(own) == SOLVER_ROWS:
                    yield from solved(own)
                    own.clear()
            for own in alike.values():
                if own:
                    yield from solved(own)

    return trials.mapInArrow(run, _TRIAL)


def gated(rows):
    """The trials with the table's decision, their footprints and heights taken as beyond doubt."""
    sure = {"overlap": 0.0, "mirrored": False, "multipart": False, "match_quality": "contained", "disambiguated_by": "aspect_ratio", "height_source": "osm_height", "exif_silhouette_disagree": False}
    return gate.evaluate(rows.select("*", *[F.lit(v).alias(c) for c, v in sure.items()]))


@query("solver_benchmark")
def solver_benchmark(spark, d):
    """The trials by configuration and corruption; false accepts as a share of what is accepted."""
    rows = gated(benchmark_rows(spark, d)).withColumn("accepted", F.col("decision") == gate.ACCEPT)
    at = lambda c, q: F.percentile(c, F.lit(q))
    return rows.groupBy("config", "corruption").agg(
        F.count("*").alias("n"), at("gt_iou", 0.5).alias("gt_iou_med"), at("gt_iou", 0.1).alias("gt_iou_p10"), at("iou", 0.5).alias("iou_med"), at("gt_hausdorff_m", 0.9).alias("haus_p90"),
        at("rot_err_mod90_deg", 0.9).alias("rot_err_mod90_p90"), F.avg((F.col("rot_err_deg") < 10).cast("double")).alias("orient_ok"), F.avg("label").alias("good"),
        F.avg(F.col("accepted").cast("double")).alias("accepted"), F.avg(F.when(F.col("accepted"), 1.0 - F.col("label"))).alias("false_accepts"), at("ms", 0.5).alias("ms_med"),
    )


@query("leave_one_building_out")
def leave_one_building_out(spark, d):
    """Accuracy of the learned gate on the solver benchmark, every building scored by a model of the others."""
    from plotwise.operators import learn
    from plotwise.operators.evaluate import metrics

    scored = learn.leave_one_out(benchmark_rows(spark, d), ["iou", "hausdorff_m"])
    return metrics(scored.select("p", "label"))
