"""Polygons against brute force, known frames, and the rules of reviews, training, masks and caches."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotwise.functions import coords, rings
from plotwise.operators import detect, gate, learn, meshes, orient, perception
from plotwise.plans import evidence
from plotwise.sources import osm


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_common_areas_against_sampling(spark):
    rng = np.random.default_rng(7)
    ring = lambda c: [{"x": float(c[0] + r * math.cos(a)), "y": float(c[1] + r * math.sin(a))} for a, r in zip(np.linspace(0, 6, 9), rng.uniform(2, 4, 9), strict=True)]
    rows = [(i, ring((0, 0)), ring((i * 0.7, 1))) for i in range(5)]
    p = spark.createDataFrame(rows, "id long, a array<struct<x: double, y: double>>, b array<struct<x: double, y: double>>")
    got = {r["id"]: r["common"] for r in evidence.common_areas(p, "a", "b", "common").collect()}
    xy = rng.uniform(-8, 8, (200_000, 2))

    def inside(ring_):
        v = np.array([(q["x"], q["y"]) for q in ring_])
        odd = np.zeros(len(xy), bool)
        for (ax, ay), (bx, by) in zip(v, np.roll(v, -1, axis=0), strict=True):
            odd ^= ((ay > xy[:, 1]) != (by > xy[:, 1])) & (xy[:, 0] < (bx - ax) * (xy[:, 1] - ay) / (by - ay + 1e-300) + ax)
        return odd

    for i, a, b in rows:
        assert got[i] == pytest.approx((inside(a) & inside(b)).mean() * 256, abs=0.6)


def test_points_in_holes_are_outside(spark):
    box = lambda s: F.array(*[F.struct(F.lit(float(x * s)).alias("x"), F.lit(float(y * s)).alias("y")) for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
    hit = lambda x: one(spark, rings.contains_polygon(box(4), F.array(box(1)), F.lit(x), F.lit(0.5)))
    assert [hit(0.0), hit(2.0), hit(5.0)] == [False, True, False]
    assert one(spark, rings.contains_polygon(box(4), F.array().cast("array<array<struct<x:double,y:double>>>"), F.lit(0.0), F.lit(0.0)))


@pytest.mark.parametrize("axis", range(6))
def test_axes_turn_to_z_without_a_reflection(spark, axis):
    unit = np.zeros(3)
    unit[axis // 2] = 1 if axis % 2 == 0 else -1
    columns = [meshes.turned(F.lit(axis), *[F.lit(float(v)) for v in e]) for e in (unit, *np.eye(3))]
    rows = np.array([[one(spark, c) for c in p] for p in columns])
    assert rows[0].tolist() == [0, 0, 1]
    assert np.linalg.det(rows[1:].T) == pytest.approx(1)
    front = one(spark, meshes.front_angle(F.lit(axis)))
    assert front is None if axis > 3 else front == pytest.approx(math.atan2(rows[3][1], rows[3][0]))


def test_normals_under_uneven_scale_stay_square_to_their_wall(spark):
    rng = np.random.default_rng(3)
    m, n = rng.normal(size=(3, 3)), rng.normal(size=3)
    m[2] = [0, 0, 1.5]
    e, u, _ = np.linalg.inv(m).T @ n
    matrix = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in m])
    got = one(spark, meshes.normal_bearing(matrix, *[F.lit(float(v)) for v in n]))
    assert got == pytest.approx(math.degrees(math.atan2(e, u)) % 360)


def test_roofs_snap_to_the_wall_by_the_camera(spark):
    snap = lambda *v: one(spark, meshes.snap_normal(*[F.lit(float(x)) for x in v]))
    assert (snap(0, 0, 1, 0, -1, 0.1)["wall"], snap(0, 0, 1, 0, -1, 0.1)["off_deg"]) == (2, 90)
    assert snap(0.1, 1, 0.2, 0, 0, 0)["wall"] == 1 and snap(0.1, 1, 0.2, 0, 0, 0)["off_deg"] == pytest.approx(math.degrees(math.atan(0.1)))
    assert snap(0, 0, 1, 0, 0, 0)["wall"] == 0


def test_facades_with_few_points_score_nothing(spark):
    p = spark.createDataFrame([("a", 0.0, float(i), 0.0) for i in range(5)], "mesh string, x double, y double, z double")
    assert {r["score"] for r in meshes.facade_detail(p, "mesh").collect()} == {0.0}
    assert meshes.facade_detail(p.limit(0), "mesh").count() == 0


def rungs(spark, heading, scores, margin, road, facades, symmetric=False):
    d = lambda v: F.lit(v).cast("double")
    array = lambda v: F.lit(None).cast("array<double>") if v is None else F.array(*map(d, v))
    return one(spark, orient.three_rungs(d(heading), array(scores), d(margin), d(road), array(facades), F.lit(symmetric)))


def test_three_rungs(spark):
    faces, scores = [0, 90, 180, 270], [0.2, 0.9, 0.3, None]
    r = rungs(spark, 10.0, scores, 0.2, None, faces)
    assert (r["k"], r["by"], r["review"], r["conflict"]) == (2, "exif_heading", False, True)
    assert rungs(spark, 45.0, scores, 0.0, None, faces)["k"] == 2, "equal distances: the better score"
    for bad in (360.0, -1.0, float("nan"), None):
        assert rungs(spark, bad, scores, 0.2, None, faces)["by"] == "silhouette"
    assert rungs(spark, 10.0, scores, 0.07, 185.0, faces)["by"] == "exif_heading"
    r = rungs(spark, None, scores, 0.07, 185.0, faces)
    assert (r["k"], r["by"], r["review"]) == (2, "road_normal", True)
    assert rungs(spark, 10.0, scores, 0.0, 20.0, None, True)["by"] == "arbitrary_symmetric"
    r = rungs(spark, None, [None] * 4, 0.5, None, faces)
    assert (r["k"], r["by"]) == (0, "aspect_ratio")


def test_reviews_overrule_and_keep_the_automatic_turn(spark):
    choices = spark.createDataFrame([(1, 2), (2, 3), (3, 0)], "id long, k int")
    reviews = spark.createDataFrame([(1, 10, 1), (1, 11, 7), (2, 5, None)], "id long, at long, forced int")
    got = {r["id"]: (r["k"], r["auto_k"], r["by_reviewer"]) for r in orient.reviewed(choices, reviews, "id").collect()}
    assert got == {1: (3, 2, True), 2: (3, 3, False), 3: (0, 0, False)}


def test_methods_resolve():
    real, made = {"trained_on_synthetic": False}, {"trained_on_synthetic": True}
    assert gate.resolve_method() == ("table", None) and gate.resolve_method(flag="1", model=real) == ("learned", None)
    assert gate.resolve_method("table", "1", made)[0] == "table" and gate.resolve_method("learned") == ("table", "no learned model")
    for bad in ({"asked": "other"}, {"flag": "maybe"}, {"asked": "learned", "model": made}):
        with pytest.raises(ValueError):
            gate.resolve_method(**bad)


def test_both_forms_of_the_table_agree(spark, sf):
    assert evidence.threshold_decision(spark, sf).where("differ > 0").count() == 0


def test_training_setup_and_coefficients(spark):
    rows = spark.createDataFrame([("a", int(i < 2)) for i in range(70)] + [("b", i % 2) for i in range(10)], "g string, label int")
    got = {r["g"]: tuple(r)[1:] for r in learn.training_setup(rows, "g").collect()}
    assert got == {"a": (70, 2, "balanced", "full", False), "b": (10, 5, None, "reduced", True)}
    t = learn.coefficient_table(spark.createDataFrame([("footprint_iou", -0.2), ("hausdorff_m", -1.0)], "feature string, coef double")).orderBy("place").collect()
    assert [(r["feature"], r["sign_matches"]) for r in t] == [("hausdorff_m", True), ("footprint_iou", False)]


def test_masks_and_factors(spark):
    runs = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 0, 5), (2, 3, 4, 4)], "mask long, y long, x0 long, x1 long")
    assert [tuple(r) for r in perception.mask_features(runs, "mask", 10, 10).collect()] == [(1, 0, 0, 10, 2, 0.15, 3)]
    f = perception.edge_factors(F.lit(1.0), F.lit(4), F.lit(-1.0))
    assert one(spark, f["window"]) == pytest.approx(1.1) and one(spark, f["door"]) == pytest.approx(0.88)


def test_shifts_without_a_partner_fail(spark):
    m = spark.createDataFrame([(1, None), (2, 0.01), (2, None)], "photo long, shift double")
    got = {r["photo"]: (r["matched"], r["unmatched"], r["passes"]) for r in detect.shift_stats(m, "photo").collect()}
    assert got == {1: (0, 1, False), 2: (1, 1, True)}


def test_undulation_needs_all_four_nodes(spark):
    grid = spark.createDataFrame([(r, c, 10.0 * r + c) for r in range(3) for c in range(3) if (r, c) != (2, 2)], "row long, col long, n double")
    p = spark.createDataFrame([(0.5, 1.25), (1.5, 1.5), (9.0, 9.0), (None, 1.0)], "lat double, lon double")
    got = [(r["undulation"], r["method"]) for r in coords.with_undulation(p, grid, 1.0, 0.0, 0.0).orderBy("lat").collect()]
    assert got == [(None, "grid_unavailable"), (6.25, "grid"), (None, "grid_unavailable"), (None, "grid_unavailable")]


def test_caches_are_kept_apart_by_fingerprint(spark, tmp_path):
    mark = lambda t: one(spark, osm.fingerprint(threshold=F.lit(t), crop=F.lit("a")))
    assert mark(0.5) != mark(0.6) and mark(0.5) == one(spark, osm.fingerprint(crop=F.lit("a"), threshold=F.lit(0.5)))
    rows = lambda m, n: spark.range(n).withColumn("fingerprint", F.lit(m))
    path = str(tmp_path / "cache")
    osm.write_cache(rows("a", 3), path)
    osm.write_cache(rows("b", 2), path)
    osm.write_cache(rows("a", 4), path)
    assert osm.read_cache(spark, path, "a").count() == 4 and osm.read_cache(spark, path, "b").count() == 2
    osm.write_results(spark.range(2).withColumn("s", F.struct(F.lit(1).alias("a"))), str(tmp_path / "csv"))
    assert {r["s"] for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()} == {'{"a":1}'}


def test_runs_that_do_not_parse_are_left_out(spark):
    text = '{"asset_id": "x", "decision": "review", "fit": {"iou": 0.5}, "mesh_to_enu": {"mesh_frame": "gltf_scene"}}'
    r = osm.list_runs(spark.createDataFrame([(1, text), (2, text[:20]), (3, "{}"), (4, None)], "at long, value string")).collect()
    assert [(x["label"], x["kind"]) for x in r] == [("? · mesh · review · IoU 0.50", "mesh")]


def test_conforming_finds_the_stretch(spark, sf):
    r = evidence.conform_solve(spark, sf).collect()
    assert all(x["conformed_iou"] > x["uniform_iou"] - 1e-6 for x in r)
    assert np.median([x["stretch_ratio"] for x in r]) == pytest.approx(1.5, abs=0.05)
