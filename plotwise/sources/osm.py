"""Readers of map payloads, geocodes and footprint files, and the record sink. Schemas are given, never inferred."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise import kernels
from plotwise.functions.strings import cache_slug
from plotwise.operators import select

POINT = "struct<lat:double,lon:double>"
ELEMENT = f"struct<type:string,id:bigint,version:int,tags:map<string,string>,geometry:array<{POINT}>,members:array<struct<type:string,role:string,geometry:array<{POINT}>>>>"
GEOCODE = "provider string, lat double, lon double, location_type string, normalized string"
FEATURES = "features array<struct<type:string,properties:struct<height:double,confidence:double>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"
FEATURE = "type string, properties struct<height:double,confidence:double>, geometry struct<type:string,coordinates:array<array<array<double>>>>"
POLYGONS = "payload string, id long, parts array<struct<outer:array<struct<x:double,y:double>>,holes:array<array<struct<x:double,y:double>>>>>"


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """One row an element of every payload under ``path``: payload (file), place (order in it) and the element's fields."""
    raw = spark.read.schema(f"elements array<{ELEMENT}>").option("multiLine", True).json(path)
    return raw.select(F.input_file_name().alias("payload"), F.posexplode("elements").alias("place", "e")).select("payload", "place", "e.*")


def buildings(elements: DataFrame) -> DataFrame:
    return elements.where("tags['building'] is not null")


def streets(elements: DataFrame) -> DataFrame:
    """Elements of the street classes with a geometry."""
    flat = elements.select("*", F.col("tags")["highway"].alias("highway"), F.col("tags")["service"].alias("service"))
    return flat.where(select.is_street() & (F.size("geometry") > 0)).drop("highway", "service")


def polygons(elements: DataFrame) -> DataFrame:
    """(payload, id, parts) of ways and relations: outers with the holes inside them, x = lon and y = lat, largest first.

    A way needs four points; a relation's members are stitched by role, and an inner ring belongs to the outer that
    holds its first corner. Elements that give no area are left out.
    """

    def ring(points: list[tuple]) -> np.ndarray:
        r = np.array(points[:-1] if points[0] == points[-1] else points, float)
        return r if kernels.area(r) > 0 else r[::-1]

    def holds(outer: np.ndarray, p: np.ndarray) -> bool:
        a, b = outer, np.roll(outer, -1, axis=0)
        across = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
        x = a[across, 0] + (p[1] - a[across, 1]) / (b[across, 1] - a[across, 1]) * (b[across, 0] - a[across, 0])
        return bool((x > p[0]).sum() % 2)

    def one(e: dict) -> list[dict]:
        if e["members"]:
            ways = {role: [[(q["lon"], q["lat"]) for q in m["geometry"] or []] for m in e["members"] if m["role"] == role] for role in ("outer", "inner")}
            outers, inners = ([ring(r) for r in kernels.stitch([w for w in ways[k] if len(w) >= 2])] for k in ("outer", "inner"))
        else:
            own = [(q["lon"], q["lat"]) for q in e["geometry"] or []]
            outers, inners = ([ring(own)] if len(own) >= 4 else []), []
        outers = sorted((o for o in outers if abs(kernels.area(o)) > 0), key=lambda o: -abs(kernels.area(o)))
        xy = lambda r: [{"x": float(x), "y": float(y)} for x, y in r]
        return [{"outer": xy(o), "holes": [xy(h) for h in inners if holds(o, h[0])]} for o in outers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xy = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        schema = pa.schema([("payload", pa.string()), ("id", pa.int64()), ("parts", pa.list_(pa.struct([("outer", xy), ("holes", pa.list_(xy))])))])
        for batch in batches:
            rows = [{"payload": e["payload"], "id": e["id"], "parts": parts} for e in batch.to_pylist() if (parts := one(e))]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return elements.select("payload", "id", "geometry", "members").mapInArrow(run, POLYGONS)


def read_geocodes(spark: SparkSession, path: str) -> DataFrame:
    """Cached geocodes with the slug that names their file."""
    name = F.regexp_extract(F.input_file_name(), r"geocode_([^/]+)\.json$", 1)
    return spark.read.schema(GEOCODE).option("multiLine", True).json(path).withColumn("slug", name)


def geocode(addresses: DataFrame, cache: DataFrame, address: str = "address") -> DataFrame:
    """Addresses with their cached fix; those without one get status ``quarantined``."""
    keyed = addresses.withColumn("slug", cache_slug(F.col(address)))
    joined = keyed.join(cache, "slug", "left")
    return joined.withColumn("status", F.when(F.col("lat").isNull(), "quarantined").otherwise("ok"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Footprint polygons of a GeoJSON collection: height (null for -1), confidence, outer ring of (x, y)."""
    raw = spark.read.schema(FEATURES).option("multiLine", True).json(path)
    return _features(raw.select(F.posexplode("features").alias("idx", "f")).select("idx", "f.properties", "f.geometry"))


def read_feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same from gzipped lines laid out as ``quadkey=...`` folders; a filter on quadkey prunes files."""
    raw = spark.read.schema(FEATURE + ", quadkey string").json(path)
    return _features(raw.select("quadkey", F.lit(None).cast("int").alias("idx"), "properties", "geometry"), "quadkey")


def _features(raw: DataFrame, *keep: str) -> DataFrame:
    ring = F.col("geometry.coordinates")[0]
    xy = F.transform(F.slice(ring, F.lit(1), F.size(ring) - 1), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    height = F.col("properties.height")
    return raw.select(*keep, "idx", F.when(height >= 0, height).alias("height"), F.col("properties.confidence").alias("confidence"), xy.alias("ring"))


def write_records(records: DataFrame, path: str) -> None:
    """One JSON object a line, keys and nesting as the columns'; Spark's commit makes the folder appear whole."""
    records.select(F.to_json(F.struct(*records.columns)).alias("value")).write.mode("overwrite").text(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records back; lines that don't parse are quarantined in ``bad``."""
    return spark.read.schema(f"{schema}, bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").json(path)


def list_runs(records: DataFrame) -> DataFrame:
    """(asset_id, label, decision, kind, at) of records (at, value: JSON text), for showing newest first.

    Text that doesn't parse, or has no asset_id, is left out. Order by ``at`` where rows are shown.
    """
    schema = "asset_id string, address_raw string, decision string, fit struct<iou: double>, mesh_to_enu struct<mesh_frame: string>"
    r = records.select("at", F.from_json("value", schema).alias("r")).select("at", "r.*").where(F.col("asset_id").isNotNull())
    frame = F.col("mesh_to_enu.mesh_frame")
    kind = F.when(frame == "gltf_scene", "mesh").when(frame == "unit_box_centred", "prism").otherwise("?")
    iou = F.col("fit.iou")
    label = F.concat(F.coalesce("address_raw", F.lit("?")), F.lit(" \u00b7 "), kind, F.lit(" \u00b7 "), F.coalesce("decision", F.lit("?")), F.when(iou.isNotNull(), F.concat(F.lit(" \u00b7 IoU "), F.format_string("%.2f", iou))).otherwise(""))
    return r.select("asset_id", label.alias("label"), "decision", kind.alias("kind"), "at")


def fingerprint(**settings: Column) -> Column:
    """SHA-256 of a configuration as JSON, keys in order: results made with other settings are never read as these."""
    return F.sha2(F.to_json(F.struct(*[settings[k].alias(k) for k in sorted(settings)])), 256)


def write_cache(rows: DataFrame, path: str) -> None:
    """Rows with a ``fingerprint`` column, a folder each; only the fingerprints written are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fingerprint").parquet(path)


def read_cache(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """What one fingerprint holds: the filter prunes all other folders."""
    return spark.read.parquet(path).where(F.col("fingerprint") == mark)


def write_results(rows: DataFrame, path: str) -> None:
    """Flat columns as CSV with a header; nested ones as JSON text."""
    flat = [F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(path)
