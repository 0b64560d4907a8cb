"""An extension: the gate over a stream of fit records, tallied by event time with late data bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.operators import gate

SCHEMA = (
    "building_id long, at timestamp, iou double, hausdorff_m double, area_ratio double, margin double, rectilinearity double, aniso double, overlap double, "
    "mirrored boolean, multipart boolean, match_quality string, disambiguated_by string, height_source string, exif_silhouette_disagree boolean"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """New JSON records as they arrive."""
    return spark.readStream.schema(SCHEMA).json(path)


def decided(records: DataFrame, model: dict | None = None) -> DataFrame:
    """The gate is row by row, so a stream passes through it without state."""
    return gate.evaluate(records, model)


def tally(records: DataFrame, late: str = "10 minutes", window: str = "5 minutes", model: dict | None = None) -> DataFrame:
    """Decisions in windows of event time; windows close, and their state goes, once the watermark passes."""
    d = decided(records, model).withWatermark("at", late)
    return d.groupBy(F.window("at", window).alias("window"), F.coalesce("decision", "status").alias("decision")).agg(F.count("*").alias("n")).select("window.start", "window.end", "decision", "n")
