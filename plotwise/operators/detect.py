"""Relations between detected boxes of one photo: joins keyed by photo, with the geometric test in the join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
PASSABLE = ("door", "garage_door", "entrance")
BOX = ("x0", "y0", "x1", "y1")

# Openings count as kept in place below these shares of the building's width.
SHIFT_MEDIAN, SHIFT_P90 = 0.02, 0.05


def pairs(boxes: DataFrame, test: Column, how: str = "inner") -> DataFrame:
    """Boxes ``a`` with other boxes ``o`` of their photo for which the test (over a.*, o.*) holds."""
    a, o = boxes.alias("a"), boxes.alias("o")
    return a.join(o, (F.col("a.photo") == F.col("o.photo")) & (F.col("a.box") != F.col("o.box")) & test, how)


def _size(side: str) -> tuple[Column, Column]:
    return F.col(f"{side}.x1") - F.col(f"{side}.x0"), F.col(f"{side}.y1") - F.col(f"{side}.y0")


def common(a: str = "a", o: str = "o") -> Column:
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(F.col(f"{a}.{hi}"), F.col(f"{o}.{hi}")) - F.greatest(F.col(f"{a}.{lo}"), F.col(f"{o}.{lo}")))
    return side("x0", "x1") * side("y0", "y1")


def iou(a: str = "a", o: str = "o") -> Column:
    (w, h), (u, v) = _size(a), _size(o)
    return common(a, o) / (w * h + u * v - common(a, o))


def is_peer() -> Column:
    """Same row: centres within 0.35 of the height, heights within 0.7 to 1.4."""
    (_, h), (_, oh) = _size("a"), _size("o")
    centre = lambda s: (F.col(f"{s}.y0") + F.col(f"{s}.y1")) / 2
    return (F.abs(centre("o") - centre("a")) < 0.35 * h) & (oh / h > 0.7) & (oh / h < 1.4)


def row_peers(boxes: DataFrame) -> DataFrame:
    """(photo, box, peers) of every box, those without peers included."""
    found = pairs(boxes, is_peer()).groupBy(F.col("a.photo").alias("photo"), F.col("a.box").alias("box")).agg(F.count("*").alias("peers"))
    return boxes.select("photo", "box").join(found, ["photo", "box"], "left").select("photo", "box", F.coalesce("peers", F.lit(0)).alias("peers"))


def is_window_above(tolerance: float = 0.2, overlap: float = 0.6) -> Column:
    (w, h), (ow, _) = _size("a"), _size("o")
    wide = F.greatest(F.lit(0.0), F.least(F.col("a.x1"), F.col("o.x1")) - F.greatest(F.col("a.x0"), F.col("o.x0")))
    centre = lambda s: (F.col(f"{s}.y0") + F.col(f"{s}.y1")) / 2
    return (F.col("o.type") == "window") & (ow >= (1 - tolerance) * w) & (ow <= (1 + tolerance) * w) & (wide / F.least(w, ow) > overlap) & (centre("o") < centre("a")) & (F.col("o.y1") <= F.col("a.y0") + 0.25 * h)


def window_above(boxes: DataFrame) -> DataFrame:
    """Boxes with a window of like width above them in their column."""
    return pairs(boxes, is_window_above(), "left_semi").select("photo", "box")


def contains_box(inner_share: float = 0.7, ratio: float = 0.5) -> Column:
    (w, h), (u, v) = _size("a"), _size("o")
    return (u * v > 0) & (common() / (u * v) > inner_share) & (u * v < ratio * w * h)


def relabel(boxes: DataFrame) -> DataFrame:
    """(photo, box, type, label): boxes that hold others become recess or facade_section; judged on the types before."""
    real = boxes.where("type <> 'other'")
    held = pairs(real, contains_box()).groupBy(F.col("a.photo").alias("photo"), F.col("a.box").alias("box")).agg(F.bool_or(F.col("o.type").isin(*PASSABLE)).alias("passable"))
    joined = boxes.join(held, ["photo", "box"], "left")
    label = F.when(F.col("passable"), "recess").when(~F.col("passable"), "facade_section")
    return joined.select("photo", "box", F.when(label.isNotNull(), "other").otherwise(F.col("type")).alias("type"), label.alias("label"))


def reading_order(boxes: DataFrame) -> DataFrame:
    """(photo, box, place): rows of 0.08 of the photo's height, left to right."""
    from pyspark.sql import Window

    by = Window.partitionBy("photo").orderBy(F.floor(F.col("y0") / (0.08 * 800)), "x0", "box")
    return boxes.select("photo", "box", F.row_number().over(by).alias("place"))


def best_match(originals: DataFrame, others: DataFrame, least: float = 0.5) -> DataFrame:
    """(photo, box, match): for every original the other box that overlaps it most, above ``least``; many may share one."""
    a, o = originals.alias("a"), others.alias("o")
    joined = a.join(o, (F.col("a.photo") == F.col("o.photo")) & (iou() > least))
    best = F.min(F.struct((-F.round(iou(), 9)).alias("neg"), F.col("o.box").alias("box")))
    return joined.groupBy(F.col("a.photo").alias("photo"), F.col("a.box").alias("box")).agg(best.alias("m")).select("photo", "box", F.col("m.box").alias("match"))


def shift_stats(matched: DataFrame, key: str) -> DataFrame:
    """(key, originals, matched, unmatched, median_shift, p90_shift, passes) from one row an accepted opening.

    ``shift`` is its move as a share of the building's width, null where it has no partner; none matched fails.
    """
    g = matched.groupBy(key).agg(F.count("*").alias("originals"), F.count("shift").alias("matched"), F.percentile("shift", F.array(F.lit(0.5), F.lit(0.9))).alias("q"))
    median, p90 = F.round(F.col("q")[0], 4), F.round(F.col("q")[1], 4)
    ok = F.coalesce((median < SHIFT_MEDIAN) & (p90 < SHIFT_P90), F.lit(False))
    return g.select(key, "originals", "matched", (F.col("originals") - F.col("matched")).alias("unmatched"), median.alias("median_shift"), p90.alias("p90_shift"), ok.alias("passes"))
