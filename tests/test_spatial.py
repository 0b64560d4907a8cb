"""Known answers, invariances and parity for the spatial engine."""

import math
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotwise import catalogue, derive, kernels
from plotwise.functions import coords, rings, strings
from plotwise.operators import detect, evaluate, gate, height, learn, orient, select
from plotwise.plans import placement

RECT = np.array([(0, 0), (30, 0), (30, 18), (0, 18)], float)
SQUARE = np.array([(0, 0), (20, 0), (20, 20), (0, 20)], float)
LSHAPE = np.array([(0, 0), (30, 0), (30, 12), (14, 12), (14, 26), (0, 26)], float)
POSES = ((0, 1, 0, 0), (0.35, 2.5, 14, -8), (-1.1, 0.4, -30, 22), (2.7, 1.7, 5, 5))


def moved(ring, theta, s, tx, ty):
    return ring * s @ kernels.rotation(theta).T + [tx, ty]


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def ring_column(ring):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring])


@pytest.mark.parametrize("pose", POSES)
def test_similarities_are_recovered(pose):
    for ring in (RECT, LSHAPE):
        s = kernels.solve([moved(ring, *pose)], [ring])
        assert s["iou"] > 0.999 and s["sx"] == pytest.approx(pose[1], rel=1e-3) and s["hausdorff_m"] < 1e-2


def test_square_is_ambiguous_and_l_is_not():
    assert kernels.solve([SQUARE], [SQUARE])["margin"] < 0.05
    assert kernels.solve([LSHAPE], [LSHAPE])["margin"] > 0.05


def test_mirror_is_never_a_reflection():
    s = kernels.solve([LSHAPE], [(LSHAPE * [-1, 1])[::-1]], anisotropic=True)
    assert s["sx"] > 0 and s["sy"] > 0 and s["iou"] < 0.95


def test_conform_stretches_further_than_the_default():
    target, model = RECT, RECT * [0.6, 1.0]
    plain, conform = kernels.solve([target], [model], anisotropic=True), kernels.solve([target], [model], anisotropic=True, cap=math.log(2.5))
    assert plain["aniso"] <= math.log(1.15) + 0.01 and conform["iou"] > plain["iou"] and conform["aniso"] == pytest.approx(math.log(1 / 0.6), abs=0.02)


def test_placement_does_not_depend_on_the_models_frame():
    a = kernels.solve([LSHAPE], [LSHAPE])
    b = kernels.solve([LSHAPE], [moved(LSHAPE, 0.65, 1000, 1200, -50)])
    assert b["iou"] == pytest.approx(a["iou"], abs=2e-3) and b["sx"] * 1000 == pytest.approx(a["sx"], rel=1e-3)


def test_areas_of_intersections():
    area = kernels.intersection_area
    assert area([SQUARE], [SQUARE]) == pytest.approx(400)
    assert area([SQUARE], [SQUARE + 100]) == 0
    assert area([SQUARE], [SQUARE + 10]) == pytest.approx(100)
    hole = SQUARE * 0.5 + 5
    assert area([SQUARE, hole], [SQUARE]) == pytest.approx(300)
    assert area([LSHAPE], [RECT]) == pytest.approx(30 * 12 + 14 * 6)
    for seed in range(20):  # inclusion and exclusion over random convex shapes, by sampling
        rng = np.random.default_rng(seed)
        a, b = kernels.hull(rng.random((9, 2))), kernels.hull(rng.random((9, 2)) + 0.2)
        ab = area([a], [b])
        assert ab == pytest.approx(area([b], [a])) and 0 <= ab <= min(abs(kernels.area(a)), abs(kernels.area(b))) + 1e-9
    theta = 0.7
    assert area([moved(RECT, theta, 1, 3, 4)], [moved(LSHAPE, theta, 1, 3, 4)]) == pytest.approx(area([RECT], [LSHAPE]))


def test_umeyama_is_exact_and_never_reflects():
    rng = np.random.default_rng(0)
    x = rng.random((50, 2))
    scale, theta, shift = kernels.umeyama(x, moved(x, 1.1, 2.0, 5, -3))
    assert (scale, theta) == pytest.approx((2.0, 1.1), abs=1e-9) and shift == pytest.approx([5, -3], abs=1e-9)
    assert kernels.umeyama(x, x * [-1, 1])[0] >= 0


def test_boxes_hulls_and_simplification():
    b = kernels.ombb(moved(RECT, 0.3, 1, 0, 0))
    assert (b["a"], b["b"], b["angle"]) == pytest.approx((30, 18, 0.3))
    assert len(kernels.hull(np.vstack([RECT, [[5, 5], [15, 0]]]))) == 4
    dense = kernels.resample(LSHAPE, 300)
    assert kernels.iou([kernels.simplify(dense, 0.4)], [LSHAPE]) > 0.97


def test_stitching_joins_flips_and_closes():
    p = [(0, 0), (1, 0), (1, 1), (0, 1)]
    assert len(kernels.stitch([p[:2], [p[2], p[1]], [p[2], p[3], p[0]]])) == 1
    closed = [*p, p[0]]
    assert kernels.stitch([closed]) == [closed]
    assert len(kernels.stitch([closed, [(9, 9), (8, 9), (8, 8), (9, 9)]])) == 2
    (ring,) = kernels.stitch([p])  # open, but long enough to close
    assert ring[0] == ring[-1] and len(ring) == 5
    assert kernels.stitch([p[:2]]) == []


def test_suppression_merges_and_assignment_is_least():
    boxes = np.array([[0, 0, 10, 10], [1, 1, 10, 10], [50, 50, 60, 60]], float)
    scores = np.array([[0.9, 0.1], [0.2, 0.8], [0.5, 0.5]])
    kept, merged = kernels.suppress(boxes, scores)
    assert kept.tolist() == [0, 2] and merged[0].tolist() == [0.9, 0.8]
    for seed in range(10):
        c = np.random.default_rng(seed).random((5, 6))
        best = min(sum(c[i, p[i]] for i in range(5)) for p in permutations(range(6), 5))
        assert sum(c[a, b] for a, b in kernels.assign(c)) == pytest.approx(best)
        assert sum(c.T[a, b] for a, b in kernels.assign(c.T)) == pytest.approx(best)


def test_ground_outline_of_an_l():
    p = np.random.default_rng(1).random((20000, 2)) * [30, 26]
    p = p[(p[:, 0] < 14) | (p[:, 1] < 12)]
    assert kernels.iou([kernels.ground_outline(p)], [LSHAPE]) > 0.9


def test_corruptions():
    rng = np.random.default_rng(0)
    assert (kernels.corrupt(LSHAPE, "clean", rng) == LSHAPE).all()
    assert kernels.area(kernels.corrupt(LSHAPE, "mirror", rng)) > 0
    assert kernels.area(kernels.corrupt(RECT, "anisotropy", rng)) == pytest.approx(540 * 1.15)
    assert kernels.area(kernels.corrupt(RECT, "missing_wing", rng)) < 540
    assert kernels.solve([LSHAPE], [kernels.corrupt(LSHAPE, "mislabel_90", rng)])["iou"] > 0.99


def test_ring_expressions_agree_with_kernels(spark):
    ring = moved(LSHAPE, 0.4, 1.3, 7, -2)
    col = ring_column(ring)
    r = one(spark, area=rings.signed_area(col), c=rings.centroid(col), o=rings.principal_orientation(col), b=rings.ombb(col), inside=rings.contains(col, F.lit(float(ring[0, 0]) + 0.5), F.lit(float(ring[0, 1]) + 1.5)), h=rings.hausdorff(col, ring_column(ring + 1)))
    assert r["area"] == pytest.approx(kernels.area(ring)) and r["o"]["r"] == pytest.approx(1.0)
    assert r["b"]["area"] == pytest.approx(kernels.ombb(ring)["a"] * kernels.ombb(ring)["b"])
    assert r["h"] == pytest.approx(kernels.hausdorff(ring, ring + 1))
    flat = ring_column([(0, 0), (1, 0), (2, 0)])
    assert one(spark, c=rings.centroid(flat))["c"]["x"] == pytest.approx(1.0)


def test_coordinates(spark):
    o = [F.lit(37.23), F.lit(-80.42), F.lit(600.0)]
    e = coords.geodetic_to_enu(F.lit(37.24), F.lit(-80.41), F.lit(640.0), *o)
    back = coords.enu_to_geodetic(e["x"], e["y"], e["z"], *o)
    r = one(spark, e=e, b=back, n=coords.wrap_pi(F.lit(-math.pi)), q=coords.wrap_half_pi(F.lit(math.pi / 4)), h=coords.theta_to_heading(coords.theta_to_heading(F.lit(1.0))), d=coords.angular_diff_deg(F.lit(350.0), F.lit(10.0)), bad=coords.plausible_height(F.lit(float("nan"))))
    assert r["b"]["lat"] == pytest.approx(37.24, abs=1e-9) and r["b"]["h"] == pytest.approx(640, abs=1e-5)
    assert r["n"] == pytest.approx(-math.pi) and r["q"] == pytest.approx(-math.pi / 4) and r["h"] == pytest.approx(1.0) and r["d"] == 20 and not r["bad"]


@pytest.mark.parametrize(("tag", "metres"), [("25'6\"", 7.7724), ("82'", 24.9936), ("82 ft", 24.9936), ("20,7 m", 20.7), ("20.7", 20.7), (" 3 metres ", 3.0), ("tall", None), ("5 km", None), (None, None), ("", None)])
def test_length_tags(spark, tag, metres):
    got = spark.createDataFrame([(tag,)], "t string").select(strings.parse_osm_length(F.col("t")).alias("m")).first()["m"]
    assert got == (pytest.approx(metres) if metres is not None else None)


def test_names(spark):
    rows = [("Classroom Building", None, "New Classroom Building, 1 Rd", True), ("Hall", None, "1 Main St", False), (None, "12", "12 Main St", True), ("", None, "x", False), ("Center Hall", None, "hall of center", False), ("Maple Hall", None, None, False)]
    frame = spark.createDataFrame([r[:3] for r in rows], "name string, number string, address string")
    assert [r["m"] for r in frame.select(strings.names_match(F.col("name"), F.col("number"), F.col("address")).alias("m")).collect()] == [r[3] for r in rows]


FIT = {"iou": 0.9, "hausdorff_m": 1.0, "area_ratio": 1.0, "margin": 0.2, "rectilinearity": 0.9, "aniso": 0.0, "overlap": 0.0, "mirrored": False, "multipart": False, "match_quality": "contained", "disambiguated_by": "exif_heading", "height_source": "osm_height", "exif_silhouette_disagree": None}
FIT_SCHEMA = "iou double, hausdorff_m double, area_ratio double, margin double, rectilinearity double, aniso double, overlap double, mirrored boolean, multipart boolean, match_quality string, disambiguated_by string, height_source string, exif_silhouette_disagree boolean"


def decide(spark, rows, model=None):
    frame = spark.createDataFrame([tuple((FIT | r).values()) for r in rows], FIT_SCHEMA)
    return gate.evaluate(frame, model).collect()


def test_gate_edges_and_floors(spark):
    cases = [
        ({}, "auto_accept"), ({"iou": 0.75}, "auto_accept"), ({"iou": 0.7499}, "review"), ({"iou": 0.4999}, "reject"), ({"hausdorff_m": 2.0}, "auto_accept"), ({"hausdorff_m": 5.01}, "reject"),
        ({"area_ratio": 0.85}, "auto_accept"), ({"area_ratio": 0.84}, "review"), ({"area_ratio": 1.31}, "reject"), ({"margin": 0.049}, "review"), ({"aniso": -0.15}, "reject"), ({"overlap": 0.1}, "review"),
        ({"mirrored": True}, "reject"), ({"disambiguated_by": "road_normal"}, "review"), ({"disambiguated_by": "aspect_ratio"}, "auto_accept"), ({"match_quality": None}, "review"), ({"match_quality": "unnamed_sole_candidate"}, "review"),
        ({"multipart": True}, "review"), ({"exif_silhouette_disagree": True}, "review"), ({"exif_silhouette_disagree": False}, "auto_accept"), ({"height_source": "microsoft"}, "review"), ({"height_source": "osm_levels"}, "auto_accept"),
    ]
    for (change, want), row in zip(cases, decide(spark, [c for c, _ in cases]), strict=True):
        assert row["decision"] == want, change
    bad = decide(spark, [{"hausdorff_m": float("inf")}, {"iou": float("nan")}, {"area_ratio": -0.1}, {"margin": None}])
    assert all(r["status"] == "quarantined" and r["decision"] is None for r in bad)


def test_learned_gate_only_lowers_by_floors(spark):
    model = {"feature_names": ["footprint_iou"], "scaler_mean": [0.5], "scaler_scale": [0.1], "coef_standardised": [1.0], "intercept": 0.0, "thresholds": {"p_accept": 0.9, "p_reject": None}}
    a, b, c = decide(spark, [{}, {"mirrored": True}, {"iou": 0.1}], model)
    assert (a["decision"], b["decision"], c["decision"]) == ("auto_accept", "reject", "review")
    assert a["probability"] == pytest.approx(1 / (1 + math.exp(-4)))


def test_height_chain(spark):
    rows = [("25 ft", None, 20.0, None), (None, "3;4", -1.0, 30.0), (None, None, 12.0, 10.0), (None, None, 12.0, 900.0), (None, None, -1.0, None), ("500", "x", None, None)]
    frame = spark.createDataFrame(rows, "h string, l string, ms double, depth double")
    got = frame.select(height.resolve(F.col("h"), F.col("l"), F.col("ms"), F.col("depth"), F.lit(0.5), F.lit(10.0), F.lit(400.0)).alias("r")).select("r.*").collect()
    assert [r["source"] for r in got] == ["osm_height", "osm_levels", "monocular_depth", "microsoft", "proportional_fallback", "proportional_fallback"]
    assert got[0]["height_m"] == pytest.approx(7.62) and got[1]["height_m"] == 9.0 and got[4]["height_m"] == 5.0
    assert got[0]["notes"] == ["microsoft disagrees"] and got[3]["notes"] == ["depth rejected", "microsoft not authoritative"]


def test_orientation_ladder_precedence(spark):
    rows = [(1, 2, 0.2, 3, 0.1, 0.1), (None, 2, 0.2, 3, 0.1, 0.1), (None, 2, 0.01, 3, 0.1, 0.1), (None, None, 0.0, 3, 0.1, 2.0), (None, None, 0.0, None, 0.0, 0.0)]
    frame = spark.createDataFrame(rows, "e int, s int, m double, r int, sp double, off double")
    o = orient.ladder(*[F.col(c) for c in ("e", "s", "m", "r", "sp", "off")], F.array(*map(F.lit, (0.5, 0.9, 0.6, 0.2))), F.lit(1.5))
    got = frame.select(o.alias("o")).select("o.*").collect()
    assert [(r["k"], r["by"], r["conflict"]) for r in got] == [(1, "exif_heading", True), (2, "silhouette", None), (3, "facade_detail", None), (3, "road_normal", None), (2, "aspect_ratio", None)]
    square = frame.limit(1).select(orient.ladder(F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(0.0), F.lit(None).cast("int"), F.lit(0.0), F.lit(0.0), F.array(*map(F.lit, (0.5, 0.5, 0.5, 0.5))), F.lit(1.0)).alias("o")).first()["o"]
    assert square["by"] == "arbitrary_symmetric" and square["k"] == 0


def test_selection_ladder(spark):
    rows = [(1, 10, 0.0, True, True), (1, 9, 0.0, True, False), (2, 5, 0.0, True, False), (3, 5, 20.0, False, True), (3, 4, 10.0, False, True), (4, 7, 30.0, False, False), (5, 7, 30.0, False, False), (5, 8, 31.0, False, False), (6, 1, 55.0, False, True), (6, 2, 10.0, False, False)]
    got = {r["a"]: (r["b"], r["match_quality"], r["status"]) for r in select.select_footprint(spark.createDataFrame(rows, "a long, b long, d double, contained boolean, named boolean"), "a", "b").collect()}
    assert got == {1: (10, "contained_and_named", "ok"), 2: (5, "contained", "ok"), 3: (4, "name_match", "ok"), 4: (7, "unnamed_sole_candidate", "ok"), 5: (None, None, "quarantined"), 6: (None, None, "quarantined")}


def test_spatial_joins_lose_and_repeat_nothing(spark):
    rng = np.random.default_rng(0)
    b = [(i, *map(float, p), *map(float, p + s)) for i, (p, s) in enumerate(zip(rng.uniform(-500, 500, (120, 2)), rng.uniform(1, 300, (120, 2)), strict=True))]
    p = [(i, *map(float, q)) for i, q in enumerate(rng.uniform(-500, 500, (80, 2)))]
    boxes, points = spark.createDataFrame(b, "bid long, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(p, "pid long, px double, py double")
    want = sorted((i, j) for i, x, y in p for j, x0, y0, x1, y1 in b if math.hypot(max(x0 - x, x - x1, 0), max(y0 - y, y - y1, 0)) <= 60)
    assert sorted((r["pid"], r["bid"]) for r in select.near_boxes(points, boxes, 60.0, size=50.0).collect()) == want
    other = boxes.toDF("other", "u0", "v0", "u1", "v1")
    pairs = sorted((r["bid"], r["other"]) for r in select.overlapping(boxes, other, size=70.0).collect())
    assert pairs == sorted((i, j) for i, a0, c0, a1, c1 in b for j, e0, f0, e1, f1 in b if min(a1, e1) > max(a0, e0) and min(c1, f1) > max(c0, f0))


def test_box_relations(spark):
    rows = [(1, 0, 0, 0, 100, 100, "entrance"), (1, 1, 10, 10, 40, 40, "door"), (1, 2, 200, 0, 230, 30, "window"), (1, 3, 200, 60, 230, 100, "door"), (2, 4, 0, 0, 10, 10, "other")]
    b = spark.createDataFrame([(p, i, *map(float, r), t) for p, i, *r, t in rows], "photo long, box long, x0 double, y0 double, x1 double, y1 double, type string")
    labels = {r["box"]: (r["type"], r["label"]) for r in detect.relabel(b).collect()}
    assert labels[0] == ("other", "recess") and labels[4] == ("other", None) and labels[1] == ("door", None)
    assert [r["box"] for r in detect.window_above(b).collect()] == [3]


def test_thresholds_bins_and_metrics(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(300), 2)
    y = (rng.random(300) < p).astype(int)
    frame = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "p double, label int")
    t = evaluate.choose_thresholds(frame, 0.8, 0.8).first()
    want = next((v for v in np.unique(p) if (p >= v).sum() >= 5 and y[p >= v].mean() >= 0.8), None)
    assert t["p_accept"] == pytest.approx(want)
    low = [v for v in np.unique(p) if (p <= v).sum() >= 5 and 1 - y[p <= v].mean() >= 0.8 and v < want]
    assert t["p_reject"] == pytest.approx(max(low))
    none = evaluate.choose_thresholds(frame.withColumn("label", F.lit(0))).first()
    assert none["p_accept"] is None and none["p_reject"] == pytest.approx(p.max())
    order = np.argsort(np.argsort(p, kind="stable")) + 1.0
    for v in np.unique(p):
        order[p == v] = order[p == v].mean()
    auc = (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (300 - y.sum()))
    assert evaluate.metrics(frame).first()["auc"] == pytest.approx(auc, abs=1e-6)
    bins = evaluate.reliability(frame.where("p < 0.5")).orderBy("bin").collect()
    assert [r["n"] for r in bins][2:] == [0, 0] and bins[3]["observed"] is None


def test_logistic_finds_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = (x @ [1.5, -1, 0] + rng.normal(size=200) > 0).astype(float)
    w, b = learn.logistic(x, y, c=0.5)
    loss = lambda w, b: (w @ w) / 2 + 0.5 * np.log1p(np.exp(-(2 * y - 1) * (x @ w + b))).sum()
    for _ in range(50):
        d = rng.normal(size=4) * 0.01
        assert loss(w, b) <= loss(w + d[:3], b + d[3]) + 1e-9


def test_leave_one_out_never_sees_its_own_building(spark):
    rows = [(g, float(g == 3) * 5 + i % 2, i % 2 if g != 3 else 1 - i % 2) for g in range(5) for i in range(20)]
    frame = spark.createDataFrame(rows, "building_id long, f double, label int")
    got = learn.leave_one_out(frame, ["f"]).collect()
    assert len(got) == 100
    own = [r for r in got if r["group"] == 3]
    assert np.mean([(r["p"] >= 0.5) == r["label"] for r in own]) <= 0.5


def test_flagship_and_catalogue(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) >= 70


def test_up_axis_prefers_the_prior_and_finds_the_base():
    rng = np.random.default_rng(0)
    tall = np.column_stack([rng.uniform(-1, 1, 4000), rng.uniform(0, 5, 4000), rng.uniform(-1, 1, 4000)])
    assert kernels.up_axis(tall) == (1, 1)
    assert kernels.up_axis(tall * [1, -1, 1]) == (1, -1)
    t = rng.uniform(0, 1, 4000)
    turn = rng.uniform(0, 2 * math.pi, 4000)
    cone = np.column_stack([t * np.cos(turn), rng.uniform(-0.3, 0.3, 4000) * t, 3 + 6 * t])  # only even along y within its wedge
    assert kernels.prismatic_score(cone, 2) < kernels.prismatic_score(tall, 1)
    p, high = kernels.canonical(tall, 1, 1)
    assert abs(p[:, :2].mean()) < 1e-9 and np.percentile(p[:, 2], 1) == pytest.approx(0) and high == pytest.approx(4.9, abs=0.1)


def test_shelves_never_overlap():
    from plotwise.operators import texture

    sizes = [(int(w), int(h)) for w, h in np.random.default_rng(2).integers(5, 60, (40, 2))]
    places, (wide, tall) = texture.shelves(sizes, 512)
    boxes = [(x, y, x + w, y + h) for (x, y), (w, h) in zip(places, sizes, strict=True)]
    assert all(0 <= a and 0 <= b and c <= wide and d <= tall for a, b, c, d in boxes)
    for i, a in enumerate(boxes):
        for b in boxes[:i]:
            assert a[2] <= b[0] or b[2] <= a[0] or a[3] <= b[1] or b[3] <= a[1]
    assert texture.shelves([(600, 10)], 512) is None


def test_camera_rays_and_projection_are_inverse(spark):
    from plotwise.operators import camera

    c = [F.lit(30.0), F.lit(5.0), F.lit(900.0), F.lit(1000.0), F.lit(800.0)]
    d = camera.ray(*c, F.lit(120.0), F.lit(640.0))
    px, py = camera.project(*c, tuple(x * 7.0 for x in d))
    behind = camera.project(*c, tuple(x * -7.0 for x in d))[0]
    r = one(spark, px=px, py=py, behind=behind)
    assert (r["px"], r["py"]) == pytest.approx((120.0, 640.0)) and r["behind"] is None


def test_holes_by_join_and_by_window_agree(spark):
    from plotwise.operators import texture

    rng = np.random.default_rng(1)
    frame = spark.createDataFrame([(w, r, c, bool(rng.random() < 0.4)) for w in range(2) for r in range(12) for c in range(6)], "wall int, row int, col int, visible boolean")
    a, b = texture.interior_holes(frame, "wall"), texture.running_rows(frame, "wall")
    key = lambda f: sorted((r["wall"], r["row"], r["col"]) for r in f.collect())
    assert key(a) == key(b) and key(a)


def test_silhouettes_and_camera_fit():
    cam = {"position": np.array([15.0, -60.0, 1.7]), "yaw": 0.0, "pitch": 5.0, "f": 60.0}
    mask = kernels.silhouette(RECT, 12.0, cam, 64, 48)
    rows = np.flatnonzero(mask.any(1))
    assert mask.any() and not mask.all() and abs(np.flatnonzero(mask.any(0)).mean() - 31.5) < 1
    assert 48 / 2 - 60 * (12 - 1.7) / 60 - 1 < rows.min() + 60 * math.tan(math.radians(5)) + 6
    assert not kernels.silhouette(RECT, 12.0, cam | {"yaw": 180.0}, 64, 48).any()
    truth = cam | {"yaw": 4.0, "position": cam["position"] + [-4.0, 0, 0]}
    fit = kernels.fit_camera(RECT, 12.0, kernels.silhouette(RECT, 12.0, truth, 64, 48), cam, yaws=np.arange(-8, 9, 4.0), pitches=np.array([0.0]), shifts=np.array([-8.0, -4.0, 0.0, 4.0, 8.0]), fine=np.array([-1.0, 0.0, 1.0]))
    assert fit["iou"] == 1.0 and (fit["yaw"], fit["dx"]) == (4.0, -4.0) and fit["reliable"]
    assert kernels.mask_iou(np.zeros((2, 2), bool), np.zeros((2, 2), bool)) == 0.0


def test_near_clip_roof_and_weights():
    square = np.array([[-1, 0, -1], [1, 0, -1], [1, 0, 1], [-1, 0, 1]], float)
    assert kernels.clip_near(square)[:, 2].min() == pytest.approx(0.1) and len(kernels.clip_near(square - [0, 0, 5])) == 0
    axes, (low, high) = kernels.roof_frame(moved(RECT, 0.4, 1, 3, 3))
    assert high - low == pytest.approx([30, 18]) and abs(axes @ axes.T - np.eye(2)).max() < 1e-9
    w = kernels.blend_weights((20, 30), (True, False, False, True), 5)
    assert w[0, 0] == pytest.approx(0.02) and w[19, 0] == 1.0 and w[19, 29] == pytest.approx(0.02)


def test_corruptions_are_what_they_say():
    for seed in range(8):
        rng = np.random.default_rng(seed)
        for kind in ("lobe", "missing_wing"):
            ring = kernels.corrupt(moved(RECT, 0.4, 1, 3, 3), kind, rng)
            common = kernels.intersection_area([ring], [moved(RECT, 0.4, 1, 3, 3)])
            if kind == "missing_wing":  # a corner of 0.4 by 0.4 of the sides is gone, all else is there
                assert kernels.area(ring) == pytest.approx(540 * 0.84, rel=1e-6) and common == pytest.approx(540 * 0.84, rel=1e-6) and len(ring) == 6
            else:  # nothing is gone, about half a disk is added away from corners
                assert common == pytest.approx(540, rel=1e-6) and 0.4 < (kernels.area(ring) - 540) / (np.pi * 0.18**2 * 540) < 0.8


def test_benchmark_trials(spark, sf):
    rows = placement.gated(placement.benchmark_rows(spark, sf, rings=derive.l_rings(spark, sf).where("id <= 12"))).collect()
    by = {k: [r for r in rows if r["corruption"] == k and r["config"] == "+nm"] for k in placement.KINDS}
    assert all(r["gt_iou"] > 0.99 for r in by["clean"]) and sum(r["label"] for r in by["clean"]) >= 10
    assert all(r["decision"] in ("auto_accept", "review", "reject") for r in rows)
    assert sum(r["rot_err_deg"] < 10 for r in by["mislabel_90"]) <= 2  # started a quarter turn off
    assert sum(r["gt_iou"] for r in by["mislabel_90"]) < sum(r["gt_iou"] for r in by["clean"])
    assert all(abs(r["aniso"]) < 1e-9 for r in rows if r["config"] != "+nm_aniso")


def test_solvers_take_every_ring(spark, sf):
    rings = {r["id"] for r in derive.l_rings(spark, sf).select("id").collect()}
    for name in ("icp_solve", "nelder_mead_solve", "camera_fit"):
        assert sorted(r["id"] for r in catalogue.QUERIES[name](spark, sf).collect()) == sorted(rings)
    assert {r["n"] for r in catalogue.QUERIES["solver_benchmark"](spark, sf).select(F.col("n")).collect()} == {len(rings)}


def test_leave_one_out_matches_one_fit_a_fold(spark):
    rng = np.random.default_rng(3)
    g, x = rng.integers(0, 30, 300), rng.normal(size=300)
    y = (x + rng.normal(size=300) > 0).astype(int)
    rows = spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in zip(g, x, y, strict=True)], "building_id long, f double, label int")
    got = sorted((r["group"], round(r["p"], 9)) for r in learn.leave_one_out(rows, ["f"], tasks=7).collect())
    want = []
    for k in np.unique(g):
        own = g == k
        p = learn.probability(learn.fit(x[~own, None], y[~own].astype(float)), x[own, None])
        want += [(int(k), round(float(v), 9)) for v in p]
    assert got == sorted(want)


def test_leave_one_out_takes_near_folds_from_one_series(spark):
    rng = np.random.default_rng(4)
    g = np.sort(np.concatenate([rng.integers(0, 1500, 4000), np.full(900, 1500)]))
    x = np.column_stack([rng.normal(3, 2, len(g)), rng.exponential(5, len(g))])
    x[7] = 4, 3000  # a row far out
    y = (x[:, 0] - 0.1 * np.minimum(x[:, 1], 50) + rng.normal(size=len(g)) > 2).astype(int)
    frame = spark.createDataFrame([(int(a), *map(float, b), int(c)) for a, b, c in zip(g, x, y, strict=True)], "building_id long, u double, v double, label int")
    rows = learn.leave_one_out(frame, ["u", "v"], tasks=5).collect()
    assert sorted((r["group"], r["label"]) for r in rows) == sorted(zip(g.tolist(), y.tolist(), strict=True))
    for k in [0, 1, int(g[7]), 700, 1499, 1500]:
        own = g == k
        want = learn.probability(learn.fit(x[~own], y[~own].astype(float)), x[own])
        assert np.allclose(sorted(r["p"] for r in rows if r["group"] == k), np.sort(want), rtol=0, atol=2e-10)
    model = learn.fit(x, y.astype(float))
    out = np.argsort(-(((x - model["mean"]) / model["scale"]) ** 2).sum(1))[:256]
    series = learn.Series(model | {"used": np.ptp(x, axis=0) > 0}, x[out], y[out])
    p = series.folds(series.sums(g, x, y), g, x, y, 1.0)
    assert 900 <= np.isnan(p).sum() < 1200  # only these need fits over all rows


def test_leave_one_out_of_odd_tables(spark):
    score = lambda rows: [(r["group"], r["p"]) for r in learn.leave_one_out(spark.createDataFrame(rows, "building_id long, f double, h double, label int"), ["f", "h"]).collect()]
    assert score([]) == []
    assert score([(1, 2.0, 3.0, 1), (1, 4.0, 3.0, 0)]) == [(1, 0.5)] * 2
    rows = [(g, 7.0 if g else 9.0, float(i), i % 2) for g in range(4) for i in range(6)]  # without group 0 a constant column
    for group, p in score(rows):
        rest = [r for r in rows if r[0] != group]
        model = learn.fit(np.array([r[1:3] for r in rest]), np.array([r[3] for r in rest], float))
        assert any(abs(p - q) < 1e-9 for q in learn.probability(model, np.array([r[1:3] for r in rows if r[0] == group])))
    assert {p for _, p in score([(g, float(g), 1.0, 1) for g in range(4)])} == {3.5 / 4}
