"""Detection post-processing as expressions: tiles, filters, soft priors, the three-group decision, masks by numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Classes, thresholds.
CLASSES = ("door", "window", "garage_door", "entrance")
DISTRACTORS = ("vent", "sign", "lamp", "column", "chimney", "balcony")
OCCLUDERS = ("lamp", "column", "sign")
PASSABLE = ("door", "garage_door", "entrance")
ACCEPT_SCORE, GROUP_MARGIN, OCCLUSION_RATIO = 0.20, 0.35, 1.3
MIN_BOX_PX, MAX_BOX_SHARE, MIN_IN_MASK, EDGE_PX = 12, 0.06, 0.40, 4


def spans(length: Column, size: Column, overlap: float = 0.2) -> Column:
    """ARRAY<STRUCT<a, b>>: evenly spaced stretches of ``size`` that cover ``length`` and overlap by a share at least."""
    size = F.greatest(F.lit(1), F.least(F.floor(size), length))
    lap = F.floor(size * overlap)
    n = F.greatest(F.lit(2), F.ceil((length - lap) / (size - lap)))
    many = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.struct(F.bround(i * (length - size) / (n - 1)).cast("bigint").alias("a"), (F.bround(i * (length - size) / (n - 1)) + size).cast("bigint").alias("b")))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("a"), length.cast("bigint").alias("b")))
    return F.when(length <= size * 1.1, whole).otherwise(many)


def tile_starts(length: Column, tile: int, overlap: int) -> Column:
    """Offsets of tiles of at most ``tile``; the last is pulled back to the edge."""
    regular = F.sequence(F.lit(0).cast("bigint"), F.greatest(length - tile, F.lit(0)), F.lit(tile - overlap).cast("bigint"))
    return F.when(length <= tile, F.array(F.lit(0).cast("bigint"))).when(F.element_at(regular, -1) + tile < length, F.concat(regular, F.array(length - tile))).otherwise(regular)


def keep_detection(mask_w: Column, mask_h: Column, in_mask: Column) -> Column:
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return (w >= MIN_BOX_PX) & (h >= MIN_BOX_PX) & (w * h <= MAX_BOX_SHARE * mask_w * mask_h) & (in_mask >= MIN_IN_MASK)


def cut_by_interior_edge(tile: tuple[Column, ...], crop: tuple[Column, ...]) -> Column:
    """Whether a box (tile coordinates) touches an edge of its tile that is not an edge of the crop."""
    (tx0, ty0, tx1, ty1), (cx0, cy0, cx1, cy1) = tile, crop
    return ((tx0 > cx0) & (F.col("x0") < EDGE_PX)) | ((tx1 < cx1) & (F.col("x1") > tx1 - tx0 - EDGE_PX)) | ((ty0 > cy0) & (F.col("y0") < EDGE_PX)) | ((ty1 < cy1) & (F.col("y1") > ty1 - ty0 - EDGE_PX))


def priors(touches: Column, aspect: Column, width_share: Column, peers: Column, column: Column) -> dict[str, Column]:
    """Soft plausibility of each class; row peers or a window above speak for a window."""
    pick = lambda test, a, b: F.when(test, a).otherwise(b)
    row = (peers >= 2) | column
    door = pick(touches, 1.0, 0.3) * pick(aspect.between(1.5, 3.5), 1.0, 0.5)
    entrance = pick(touches, 1.0, 0.3) * pick(aspect.between(0.6, 2.2), 1.0, 0.6)
    window = pick(touches, 0.45, 1.0) * pick(peers >= 1, 1.0, 0.8)
    return {
        "door": door * pick(row, pick(touches & (aspect >= 1.5), 0.5, 0.05), 1.0),
        "window": pick(row, 1.0, window),
        "garage_door": pick(touches, 1.0, 0.2) * pick(aspect.between(0.45, 1.2), 1.0, 0.4) * pick(width_share >= 0.06, 1.0, 0.5),
        "entrance": entrance * pick(row, 0.5, 1.0),
    } | {c: F.lit(1.0) for c in DISTRACTORS}


def group_of(name: Column) -> Column:
    return F.when(name.isin(*PASSABLE), "passable").when(name == "window", "window").otherwise("other")


def classify(scores: dict[str, Column]) -> Column:
    """STRUCT<type, grp, decision, score, occluded_by> from combined scores; ties go to the class named first.

    An occluder that doesn't clearly beat the best opening class gives way to it, and the opening goes to review.
    """
    order = [*CLASSES, *DISTRACTORS]
    entry = lambda names: F.array_sort(F.array(*[F.struct((-scores[n]).alias("neg"), F.lit(order.index(n)).alias("rank"), F.lit(n).alias("name")) for n in names]))
    ranked, opening = entry(order), entry(CLASSES)[0]
    hidden = ranked[0]["name"].isin(*OCCLUDERS) & (-ranked[0]["neg"] < OCCLUSION_RATIO * -opening["neg"])
    top = F.when(hidden, opening).otherwise(ranked[0])
    rival = F.filter(ranked, lambda c: group_of(c["name"]) != group_of(top["name"]))[0]
    s1 = -top["neg"]
    margin = F.when(s1 > 0, (s1 + rival["neg"]) / s1).otherwise(0.0)
    review = hidden | (s1 < ACCEPT_SCORE) | (margin < GROUP_MARGIN)
    group = group_of(top["name"])
    return F.struct(
        F.when(group == "other", "other").otherwise(top["name"]).alias("type"), group.alias("grp"), F.when(review, "REVIEW").otherwise("ACCEPT").alias("decision"),
        F.round(s1, 4).alias("score"), F.when(hidden, ranked[0]["name"]).alias("occluded_by"),
    )


def mask_note(share: Column, edges: Column, complexity: Column) -> Column:
    """What is wrong with a mask, null if nothing: covers over 90 %, under 4 %, touches over 3 edges, ragged."""
    return F.when(share > 0.9, "covers the frame").when(share < 0.04, "tiny").when(edges > 3, "touches edges").when(complexity > 12, "ragged")


def select_box(boxes: DataFrame, key: str, width: float, height: float) -> DataFrame:
    """(key, box): the box of largest area times centrality."""
    area = F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")) * F.greatest(F.lit(0.0), F.col("y1") - F.col("y0")) / (width * height)
    off = F.hypot((F.col("x0") + F.col("x1")) / 2 - width / 2, (F.col("y0") + F.col("y1")) / 2 - height / 2)
    merit = area * F.greatest(F.lit(0.0), 1 - off / ((width**2 + height**2) ** 0.5 / 2))
    return boxes.groupBy(key).agg(F.min(F.struct((-F.round(merit, 9)).alias("neg"), "box")).alias("m")).select(key, "m.box")


def edge_factors(frame_score: Column, mullions: Column, contrast: Column) -> dict[str, Column]:
    """Multiplier of each class, 0.8 to 1.1: frames raise all, mullions and dark insides speak for windows."""
    clip = lambda v, low, high: F.least(F.lit(high), F.greatest(F.lit(low), v))
    frame = 0.9 + 0.2 * clip((frame_score - 0.45) / 0.25, 0.0, 1.0)
    bars, dark = F.least(F.lit(1.0), mullions / 4.0), clip(-contrast / 0.2, -1.0, 1.0)
    favour = {"window": (1.0 + 0.1 * bars) * (1.0 + 0.05 * dark)} | {c: 1.0 - 0.2 * bars for c in PASSABLE}
    return {c: clip(frame * favour.get(c, F.lit(1.0)), 0.8, 1.1) for c in (*CLASSES, *DISTRACTORS)}


def mask_features(runs: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """(key, x0, y0, x1, y1, share, edges) of masks stored as disjoint runs (key, y, x0, x1), ends exclusive.

    One map-side combined aggregate; empty masks have no runs and thus no row.
    """
    box = runs.where("x1 > x0").groupBy(key).agg(F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), (F.max("y") + 1).alias("y1"), F.sum(F.col("x1") - F.col("x0")).alias("pixels"))
    touched = [F.col("x0") <= 0, F.col("y0") <= 0, F.col("x1") >= width, F.col("y1") >= height]
    return box.select(key, "x0", "y0", "x1", "y1", (F.col("pixels") / (width * height)).alias("share"), sum((t.cast("int") for t in touched[1:]), touched[0].cast("int")).alias("edges"))
