"""Orientation: candidate poses, margins and the ladder of evidence, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
SYMMETRIC_ASPECT, MIN_MARGIN, SILHOUETTE_MARGIN, DETAIL_SPREAD = 1.10, 0.05, 0.08, 0.05


def candidates(boxes: DataFrame) -> DataFrame:
    """Four rows a box pair (f_a, f_b, f_angle, f_cx, f_cy for the footprint, m_... for the model): k, theta, s, tx, ty."""
    k = F.col("k")
    even = k % 2 == 0
    pair = (F.when(even, F.col("f_a")).otherwise(F.col("f_b")), F.when(even, F.col("f_b")).otherwise(F.col("f_a")))
    s = (pair[0] / F.greatest(F.col("m_a"), F.lit(1e-9)) + pair[1] / F.greatest(F.col("m_b"), F.lit(1e-9))) / 2.0
    theta = F.col("f_angle") - F.col("m_angle") + k * (math.pi / 2)
    out = boxes.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("theta", theta).withColumn("s", s)
    c, n = F.cos("theta"), F.sin("theta")
    return out.withColumn("tx", F.col("f_cx") - F.col("s") * (c * F.col("m_cx") - n * F.col("m_cy"))).withColumn("ty", F.col("f_cy") - F.col("s") * (n * F.col("m_cx") + c * F.col("m_cy")))


def viable(k: Column, aspect: Column) -> Column:
    """Elongated footprints keep even turns only."""
    return (aspect <= SYMMETRIC_ASPECT) | (k % 2 == 0)


def ranked(ious: Column) -> Column:
    """ARRAY<STRUCT<neg, k>> of four overlaps, best first; ties keep the lower turn."""
    return F.array_sort(F.transform(ious, lambda v, k: F.struct((-v).alias("neg"), k.alias("k"))))


def margin(ious: Column) -> Column:
    """Best minus second of all candidates, viable or not."""
    r = ranked(ious)
    return r[1]["neg"] - r[0]["neg"]


def closest_turn(theta0: Column, front: Column, facing: Column, aspect: Column) -> Column:
    """The viable turn whose front points nearest to ``facing``; null if the front is unknown."""
    gap = lambda k: F.abs(F.pmod(theta0 + k * (math.pi / 2) + front - facing + math.pi, F.lit(2 * math.pi)) - math.pi)
    turns = F.filter(F.sequence(F.lit(0), F.lit(3)), lambda k: viable(k, aspect))
    return F.when(front.isNotNull() & facing.isNotNull(), F.array_min(F.transform(turns, lambda k: F.struct(F.round(gap(k), 9).alias("g"), k.alias("k"))))["k"])


def ladder(exif_k: Column, silhouette_k: Column, silhouette_margin: Column, road_k: Column, detail_spread: Column, detail_off: Column, ious: Column, aspect: Column) -> Column:
    """STRUCT<k, by, conflict, reasons> from each cue's turn (null: the cue says nothing)."""
    best = F.coalesce(F.filter(ranked(ious), lambda c: viable(c["k"], aspect))[0]["k"], ranked(ious)[0]["k"])
    m = margin(ious)
    sil = F.when(silhouette_margin >= SILHOUETTE_MARGIN, silhouette_k)
    conflict = F.when(exif_k.isNotNull() & sil.isNotNull(), exif_k != sil)
    symmetric = (aspect < SYMMETRIC_ASPECT) & (m < MIN_MARGIN) & (F.coalesce(silhouette_margin, F.lit(0.0)) < 0.05)
    detail = F.coalesce((detail_spread > DETAIL_SPREAD) & (detail_off < math.pi / 4), F.lit(False))
    rungs = [
        (exif_k.isNotNull(), exif_k, "exif_heading"),
        (symmetric, best, "arbitrary_symmetric"),
        (sil.isNotNull(), sil, "silhouette"),
        (road_k.isNotNull() & detail, road_k, "facade_detail"),
        (road_k.isNotNull(), road_k, "road_normal"),
    ]
    k, by = best, F.lit("aspect_ratio")
    for test, value, name in reversed(rungs):
        k, by = F.when(test, value).otherwise(k), F.when(test, F.lit(name)).otherwise(by)
    reasons = F.array_compact(
        F.array(
            F.when(F.coalesce(conflict, F.lit(False)), F.lit("exif and silhouette conflict")),
            F.when(by == "arbitrary_symmetric", F.lit("symmetric footprint, orientation is arbitrary")),
            F.when((by == "silhouette") & (m > MIN_MARGIN) & (sil != best), F.lit("silhouette and overlap conflict")),
            F.when(by == "facade_detail", F.lit("facade detail corroborates the street")),
            F.when(by == "road_normal", F.lit("street prior alone")),
            F.when((by == "aspect_ratio") & (m < MIN_MARGIN), F.lit("margin below 0.05 without a cue")),
        )
    )
    return F.struct(k.cast("int").alias("k"), by.alias("by"), conflict.alias("conflict"), reasons.alias("reasons"))


def umeyama(pairs: DataFrame, key: str) -> DataFrame:
    """(key, theta, scale, tx, ty) from rows of (key, x1, x2, y1, y2): sums only, so it combines map-side.

    Sums of raw products are centred afterwards; coordinates should be local (metres), not thousands of kilometres off.
    """
    s = {n: F.sum(e) for n, e in {"n": F.lit(1.0), "a": F.col("x1"), "b": F.col("x2"), "c": F.col("y1"), "d": F.col("y2"), "ac": F.col("x1") * F.col("y1"), "bd": F.col("x2") * F.col("y2"), "ad": F.col("x1") * F.col("y2"), "bc": F.col("x2") * F.col("y1"), "aa": F.col("x1") * F.col("x1") + F.col("x2") * F.col("x2")}.items()}
    g = pairs.groupBy(key).agg(*[v.alias(k) for k, v in s.items()])
    v = {k: F.col(k) for k in s}
    c = v["ac"] + v["bd"] - (v["a"] * v["c"] + v["b"] * v["d"]) / v["n"]
    d = v["ad"] - v["bc"] - (v["a"] * v["d"] - v["b"] * v["c"]) / v["n"]
    spread = v["aa"] - (v["a"] * v["a"] + v["b"] * v["b"]) / v["n"]
    g = g.withColumn("theta", F.atan2(d, c)).withColumn("scale", F.hypot(c, d) / spread)
    cs, sn = F.cos("theta"), F.sin("theta")
    return g.select(
        key, "theta", "scale",
        ((v["c"] - F.col("scale") * (cs * v["a"] - sn * v["b"])) / v["n"]).alias("tx"),
        ((v["d"] - F.col("scale") * (sn * v["a"] + cs * v["b"])) / v["n"]).alias("ty"),
    )


def matmul(a: Column, b: Column) -> Column:
    """Product of two 4 x 4 matrices, ARRAY<ARRAY<DOUBLE>> by rows."""
    cell = lambda row, j: F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(0.0), lambda acc, i: acc + row[i] * b[i][j])
    return F.transform(a, lambda row: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: cell(row, j)))


def pose_matrix(theta: Column, sx: Column, sy: Column, sz: Column, tx: Column, ty: Column, tz: Column) -> Column:
    """Rotation about z times scale, then translation."""
    c, s, zero, one = F.cos(theta), F.sin(theta), F.lit(0.0), F.lit(1.0)
    return F.array(F.array(c * sx, -s * sy, zero, tx), F.array(s * sx, c * sy, zero, ty), F.array(zero, zero, sz, tz), F.array(zero, zero, zero, one))


def symmetry_label(margin_: Column, aspect: Column) -> Column:
    return F.when((margin_ < MIN_MARGIN) & (F.greatest(aspect, 1 / aspect) < SYMMETRIC_ASPECT), "symmetric").otherwise("distinct")


def three_rungs(heading: Column, scores: Column, margin_: Column, road: Column, facades: Column, symmetric: Column) -> Column:
    """STRUCT<k, by, review, conflict>: the shorter ladder over any number of candidates, numbered from 0.

    ``facades`` holds each candidate's compass bearing (null array: the front is unknown, bearings say nothing) and
    ``scores`` its silhouette score (null: none). A plausible heading decides, then silhouettes that lead by 0.08,
    then the street; the last two rungs are guesses for review. Equal distances go to the better score, then in order.
    """
    score = lambda k: F.get(scores, k)
    gap = lambda a, b: F.round(F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0), 6)
    nearest = lambda b: F.array_min(F.transform(facades, lambda f, k: F.struct(gap(f, b).alias("gap"), (-F.coalesce(score(k), F.lit(0.0))).alias("neg"), k.alias("k"))))["k"]
    known = F.coalesce(F.exists(scores, lambda s: s.isNotNull()), F.lit(False))
    top = F.array_min(F.transform(scores, lambda s, k: F.struct((-F.coalesce(s, F.lit(-math.inf))).alias("neg"), k.alias("k"))))["k"]
    plausible = F.coalesce(~F.isnan(heading) & (heading >= 0) & (heading < 360), F.lit(False))
    exif = F.when(plausible, nearest(F.pmod(heading + 180.0, F.lit(360.0))))
    silhouette = F.when(known & (margin_ >= SILHOUETTE_MARGIN), top)
    street = nearest(F.pmod(road, F.lit(360.0)))
    last = F.when(symmetric, F.lit("arbitrary_symmetric")).otherwise("aspect_ratio")
    street = F.when(road.isNotNull(), street)
    by = F.when(exif.isNotNull(), F.lit("exif_heading")).when(silhouette.isNotNull(), "silhouette").when(street.isNotNull(), "road_normal").otherwise(last)
    conflict = F.when(exif.isNotNull() & silhouette.isNotNull(), exif != silhouette)
    return F.struct(F.coalesce(exif, silhouette, street, top, F.lit(0)).cast("int").alias("k"), by.alias("by"), (exif.isNull() & silhouette.isNull()).alias("review"), conflict.alias("conflict"))


def reviewed(choices: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """``choices`` (key, k, ...) with ``auto_k`` kept beside the latest review's turn; ``reviews`` is (key, at, forced).

    Later reviews win, of those at one time the higher turn; only the turn is overruled.
    """
    last = reviews.where(F.col("forced").isNotNull()).groupBy(key).agg(F.max(F.struct("at", "forced"))["forced"].alias("forced"))
    forced = F.pmod(F.col("forced"), F.lit(4)).cast("int")
    return choices.join(last, key, "left").withColumn("auto_k", F.col("k")).withColumn("k", F.coalesce(forced, F.col("k"))).withColumn("by_reviewer", F.col("forced").isNotNull()).drop("forced")


def true_turn(candidates_: DataFrame, key: str, truth: Column) -> DataFrame:
    """(key, k): the candidate whose angle is nearest to the true one; ties keep the lower turn."""
    off = F.abs(F.pmod(F.col("theta") - truth + math.pi, F.lit(2 * math.pi)) - math.pi)
    return candidates_.groupBy(key).agg(F.min(F.struct(F.round(off, 9).alias("off"), "k"))["k"].alias("k"))
