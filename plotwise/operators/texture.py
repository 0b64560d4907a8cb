"""Wall textures as rows of texels (wall, row, col, visible, value): coverage, holes, colour matching, atlas layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
STRONG, KEEP, WALL_CLIP, PHOTO_CLIP = 0.4, 0.15, (0.8, 1.25), (0.6, 1.6)


def coverage(texels: DataFrame, *keys: str) -> DataFrame:
    """Seen share of each wall and where its texture comes from."""
    share = F.avg(F.col("visible").cast("double"))
    return texels.groupBy(*keys).agg(share.alias("coverage")).withColumn("source", F.when(F.col("coverage") >= STRONG, "photo").when(F.col("coverage") >= KEEP, "partial").otherwise("procedural"))


def interior_holes(texels: DataFrame, *keys: str) -> DataFrame:
    """Unseen texels with seen ones above and below in their column: the column's first and last seen rows, joined back."""
    seen = texels.where("visible").groupBy(*keys, "col").agg(F.min("row").alias("first"), F.max("row").alias("last"))
    return texels.where("not visible").join(seen, [*keys, "col"]).where("row > first and row < last").drop("first", "last")


def normalise(texels: DataFrame, building: str = "building") -> DataFrame:
    """``texels`` with ``matched``: every well-seen wall's mean moved onto the best-seen wall's, contrast within limits."""
    seen = F.when(F.col("visible"), F.col("value"))
    stats = texels.groupBy(building, "wall").agg(F.avg(F.col("visible").cast("double")).alias("cover"), F.avg(seen).alias("mu"), F.stddev_pop(seen).alias("sd")).where(F.col("cover") >= KEEP)
    best = stats.groupBy(building).agg(F.min(F.struct((-F.col("cover")).alias("neg"), "wall", "mu", "sd")).alias("ref"))
    both = stats.join(best, building).select(building, "wall", "mu", F.col("ref.mu").alias("ref_mu"), F.when(F.col("wall") == F.col("ref.wall"), 1.0).otherwise(match_scale(F.col("ref.sd"), F.col("sd"), WALL_CLIP)).alias("scale"))
    moved = (F.col("value") - F.col("mu")) * F.col("scale") + F.col("ref_mu")
    return texels.join(both, [building, "wall"], "left").withColumn("matched", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(255.0), moved)), F.col("value"))).drop("mu", "ref_mu", "scale")


def match_scale(wanted: Column, own: Column, clip: tuple[float, float]) -> Column:
    return F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), wanted / F.greatest(own, F.lit(1e-3))))


def running_rows(texels: DataFrame, *keys: str) -> DataFrame:
    """The same holes by a window, for stores already dealt by wall and column."""
    by = Window.partitionBy(*keys, "col")
    seen = F.when(F.col("visible"), F.col("row"))
    return texels.withColumn("first", F.min(seen).over(by)).withColumn("last", F.max(seen).over(by)).where("not visible and row > first and row < last").drop("first", "last")


def shelves(sizes: list[tuple[int, int]], most: int = 4096, pad: int = 2) -> tuple[list[tuple[int, int]], tuple[int, int]] | None:
    """Places of rectangles on shelves, tallest first, and the atlas size in fours; None if they don't fit."""
    places: list = [None] * len(sizes)
    left = top = tall = wide = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i][1], i)):
        w, h = sizes[i][0] + 2 * pad, sizes[i][1] + 2 * pad
        if left + w > most:
            left, top, tall = 0, top + tall, 0
        if w > most or top + h > most:
            return None
        places[i] = (left + pad, top + pad)
        left, tall, wide = left + w, max(tall, h), max(wide, left + w)
    return places, (-(-wide // 4) * 4, -(-(top + tall) // 4) * 4)
