"""Photos and meshes from binary files: EXIF fields and glTF vertices, parsed in Arrow functions."""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# TIFF tags.
_EXIF, _GPS = 0x8769, 0x8825
_GPS_TAGS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon", 17: "heading"}
_EXIF_TAGS = {0x920A: "focal_mm", 0xA405: "focal_35mm"}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def exif(content: bytes) -> dict:
    """heading [0, 360), focal_mm, focal_35mm, lat and lon of a JPEG; absent or unreadable fields are None."""
    out: dict = dict.fromkeys(("heading", "focal_mm", "focal_35mm", "lat", "lon"))
    at = content.find(b"Exif\x00\x00")
    if at < 0:
        return out
    tiff = content[at + 6 :]
    order = "<" if tiff[:2] == b"II" else ">"
    unpack = lambda kind, at: struct.unpack_from(order + kind, tiff, at)

    def entries(start: int) -> Iterator[tuple[int, object]]:
        for i in range(unpack("H", start)[0]):
            tag, kind, n = unpack("HHI", start + 2 + 12 * i)
            size = _SIZES.get(kind, 0) * n
            place = start + 10 + 12 * i if size <= 4 else unpack("I", start + 10 + 12 * i)[0]
            if kind == 2:
                yield tag, tiff[place : place + n].rstrip(b"\x00").decode("ascii", "replace")
            elif kind == 3:
                yield tag, [*unpack(f"{n}H", place)]
            elif kind in (4, 9):
                yield tag, [*unpack(f"{n}{'I' if kind == 4 else 'i'}", place)]
            elif kind in (5, 10):
                pair = unpack(f"{2 * n}{'I' if kind == 5 else 'i'}", place)
                yield tag, [a / b if b else math.nan for a, b in zip(pair[::2], pair[1::2], strict=True)]

    try:
        found: dict = {}
        for tag, value in entries(unpack("I", 4)[0]):
            if tag == _EXIF:
                found |= {_EXIF_TAGS[t]: v for t, v in entries(value[0]) if t in _EXIF_TAGS}
            elif tag == _GPS:
                found |= {_GPS_TAGS[t]: v for t, v in entries(value[0]) if t in _GPS_TAGS}
    except (struct.error, IndexError, TypeError):
        return out
    degrees = lambda v: v[0] + v[1] / 60 + v[2] / 3600
    for name, negative in (("lat", "S"), ("lon", "W")):
        if len(found.get(name) or ()) == 3:
            value = degrees(found[name]) * (-1 if found.get(f"{name}_ref") == negative else 1)
            out[name] = value if math.isfinite(value) else None
    for name in ("heading", "focal_mm", "focal_35mm"):
        value = float(found[name][0]) if found.get(name) else math.nan
        out[name] = value if math.isfinite(value) and (name != "heading" or 0 <= value < 360) else None
    return out


def glb_vertices(content: bytes) -> np.ndarray:
    """(n, 3) vertices of every mesh node of a binary glTF, in scene coordinates."""
    length = struct.unpack_from("<I", content, 12)[0]
    doc = json.loads(content[20 : 20 + length])
    blob = content[20 + length + 8 :]

    def local(node: dict) -> np.ndarray:
        if "matrix" in node:
            return np.array(node["matrix"], float).reshape(4, 4).T
        x, y, z, w = node.get("rotation", (0, 0, 0, 1))
        turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
        m = np.eye(4)
        m[:3, :3] = turn * np.array(node.get("scale", (1, 1, 1)), float)
        m[:3, 3] = node.get("translation", (0, 0, 0))
        return m

    out: list[np.ndarray] = []

    def walk(i: int, above: np.ndarray) -> None:
        node = doc["nodes"][i]
        m = above @ local(node)
        for p in doc["meshes"][node["mesh"]]["primitives"] if "mesh" in node else ():
            accessor = doc["accessors"][p["attributes"]["POSITION"]]
            view = doc["bufferViews"][accessor["bufferView"]]
            start, stride = view.get("byteOffset", 0) + accessor.get("byteOffset", 0), view.get("byteStride", 12)
            v = np.stack([np.frombuffer(blob, "<f4", 3, start + stride * k) for k in range(accessor["count"])]).astype(float)
            out.append(v @ m[:3, :3].T + m[:3, 3])
        for child in node.get("children", ()):
            walk(child, m)

    for root in doc["scenes"][doc.get("scene", 0)]["nodes"]:
        walk(root, np.eye(4))
    return np.concatenate(out) if out else np.zeros((0, 3))


def read_photos(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 and the EXIF fields of every photo."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = [exif(c) for c in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array([f[n] for f in fields], pa.float64()) for n in ("heading", "focal_mm", "focal_35mm", "lat", "lon"))], names=["path", "sha256", "heading", "focal_mm", "focal_35mm", "lat", "lon"])

    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "content")
    return files.mapInArrow(run, "path string, sha256 string, heading double, focal_mm double, focal_35mm double, lat double, lon double")


def read_meshes(spark: SparkSession, path: str) -> DataFrame:
    """(path, vid, x, y, z): the vertices of every binary glTF, one file after another in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = glb_vertices(content)
                yield pa.record_batch([pa.array([name] * len(v)), pa.array(range(len(v)), pa.int64()), *(pa.array(v[:, i]) for i in range(3))], names=["path", "vid", "x", "y", "z"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, vid long, x double, y double, z double")
