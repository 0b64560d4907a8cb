"""Readers over tiny hand-written files, the record sink, and the streaming gate."""

import gzip
import json
import struct

import numpy as np
from pyspark.sql import functions as F

from plotwise.sources import binary, osm
from plotwise.streaming import gate_stream


def pts(*xy):
    return [{"lat": y, "lon": x} for x, y in xy]


def test_elements_polygons_and_streets(spark, tmp_path):
    outer, hole = [(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
    payload = {
        "version": 0.6,
        "elements": [
            {"type": "way", "id": 1, "tags": {"building": "yes", "name": "A"}, "geometry": pts(*outer, outer[0])},
            {"type": "relation", "id": 2, "tags": {"building": "stadium"}, "members": [{"type": "way", "role": "outer", "geometry": pts(*outer[:3])}, {"type": "way", "role": "outer", "geometry": pts(outer[0], outer[3], outer[2])}, {"type": "way", "role": "inner", "geometry": pts(*hole)}, {"type": "way", "role": "outer", "geometry": pts((9, 9), (10, 9), (10, 10), (9, 9))}]},
            {"type": "way", "id": 3, "tags": {"highway": "residential"}, "geometry": pts((0, 0), (1, 1))},
            {"type": "way", "id": 4, "tags": {"highway": "service", "service": "driveway"}, "geometry": pts((0, 0), (1, 1))},
            {"type": "way", "id": 5, "tags": {"building": "yes"}, "geometry": pts((0, 0), (1, 1))},
            {"type": "node", "id": 6},
        ],
    }
    (tmp_path / "osm.json").write_text(json.dumps(payload))
    e = osm.read_elements(spark, str(tmp_path / "osm.json"))
    assert e.count() == 6
    assert [r["id"] for r in osm.streets(e).collect()] == [3]
    parts = {r["id"]: r["parts"] for r in osm.polygons(osm.buildings(e)).collect()}
    assert set(parts) == {1, 2} and len(parts[2]) == 2 and len(parts[2][0]["holes"]) == 1 and parts[2][1]["holes"] == []
    assert len(parts[1][0]["outer"]) == 4


def test_geocodes(spark, tmp_path):
    from plotwise.functions.strings import cache_slug

    slug = spark.range(1).select(cache_slug(F.lit("1 Main St")).alias("s")).first()["s"]
    (tmp_path / f"geocode_{slug}.json").write_text(json.dumps({"provider": "nominatim", "lat": 1.5, "lon": 2.5, "location_type": "ROOFTOP", "normalized": "1 Main St"}))
    cache = osm.read_geocodes(spark, str(tmp_path))
    got = {r["address"]: (r["lat"], r["status"]) for r in osm.geocode(spark.createDataFrame([("1 Main St",), ("nowhere",)], "address string"), cache).collect()}
    assert got == {"1 Main St": (1.5, "ok"), "nowhere": (None, "quarantined")}


def test_features(spark, tmp_path):
    feature = lambda h: {"type": "Feature", "properties": {"height": h, "confidence": 0.9}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}
    (tmp_path / "f.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature(7.5), feature(-1)]}))
    rows = osm.read_features(spark, str(tmp_path / "f.geojson")).orderBy("idx").collect()
    assert [r["height"] for r in rows] == [7.5, None] and len(rows[0]["ring"]) == 3
    folder = tmp_path / "tiles" / "quadkey=0320"
    folder.mkdir(parents=True)
    with gzip.open(folder / "a.json.gz", "wt") as f:
        f.write(json.dumps(feature(3.0)) + "\n")
    lines = osm.read_feature_lines(spark, str(tmp_path / "tiles"))
    assert lines.where("quadkey = '0320'").first()["height"] == 3.0


def test_records_round_trip(spark, tmp_path):
    records = spark.createDataFrame([("a", 1.5, ["x"])], "asset_id string, iou double, reasons array<string>")
    osm.write_records(records, str(tmp_path / "records"))
    (tmp_path / "records" / "bad.txt").write_text("{not json\n")
    got = osm.read_records(spark, str(tmp_path / "records"), "asset_id string, iou double, reasons array<string>").collect()
    assert sorted((r["asset_id"] or "", r["bad"] is not None) for r in got) == [("", True), ("a", False)]


def jpeg(lat=(37, 13, 48), ref=b"N\x00"):
    gps = struct.pack("<H", 5)
    data = b""
    base = 8 + 2 + 12 + 4 + 2 + 5 * 12 + 4

    def entry(tag, kind, n, value):
        nonlocal data
        if len(value) <= 4:
            return struct.pack("<HHI", tag, kind, n) + value.ljust(4, b"\x00")
        out = struct.pack("<HHII", tag, kind, n, base + len(data))
        data += value
        return out

    rational = lambda *v: b"".join(struct.pack("<II", int(x * 100), 100) for x in v)
    gps += entry(1, 2, 2, ref) + entry(2, 5, 3, rational(*lat)) + entry(3, 2, 2, b"W\x00") + entry(4, 5, 3, rational(80, 25, 12)) + entry(17, 5, 1, rational(142.5)) + struct.pack("<I", 0)
    head = b"II*\x00" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x8825, 4, 1, 26) + struct.pack("<I", 0)
    return b"\xff\xd8\xff\xe1\x00\x00Exif\x00\x00" + head + gps + data


def test_photos(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(jpeg())
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8 nothing")
    (tmp_path / "c.jpg").write_bytes(jpeg()[:60])
    rows = {r["path"].rsplit("/", 1)[1]: r for r in binary.read_photos(spark, str(tmp_path / "*.jpg")).collect()}
    a = rows["a.jpg"]
    assert abs(a["lat"] - 37.23) < 1e-6 and abs(a["lon"] + 80.42) < 1e-6 and a["heading"] == 142.5 and len(a["sha256"]) == 64
    assert rows["b.jpg"]["lat"] is None and rows["c.jpg"]["lat"] is None


def test_meshes(spark, tmp_path):
    v = np.array([[0, 0, 0], [1, 0, 0], [0, 2, 0]], "<f4")
    doc = {"scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"translation": [5, 0, 0], "children": [1]}, {"mesh": 0, "scale": [2, 2, 2], "rotation": [0, 0, 2**-0.5, 2**-0.5]}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0}}]}], "accessors": [{"bufferView": 0, "count": 3}], "bufferViews": [{"byteLength": 36}]}
    text = json.dumps(doc).encode()
    text += b" " * (-len(text) % 4)
    blob = v.tobytes()
    (tmp_path / "m.glb").write_bytes(b"glTF" + struct.pack("<II", 2, 28 + len(text) + len(blob)) + struct.pack("<I", len(text)) + b"JSON" + text + struct.pack("<I", len(blob)) + b"BIN\x00" + blob)
    got = np.array([(r["x"], r["y"], r["z"]) for r in binary.read_meshes(spark, str(tmp_path)).orderBy("vid").collect()])
    assert np.allclose(got, [[5, 0, 0], [5, 2, 0], [1, 0, 0]])


def test_streaming_gate(spark, tmp_path):
    base = {"iou": 0.9, "hausdorff_m": 1.0, "area_ratio": 1.0, "margin": 0.2, "rectilinearity": 0.9, "aniso": 0.0, "overlap": 0.0, "mirrored": False, "multipart": False, "match_quality": "contained", "disambiguated_by": "exif_heading", "height_source": "osm_height"}
    rows = [base | {"building_id": i, "at": f"2024-01-01T00:0{i}:00Z", "iou": 0.9 if i % 2 else 0.3} for i in range(8)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = gate_stream.tally(gate_stream.read(spark, str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("gate_tally").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["decision"], r["n"]) for r in spark.sql("select decision, sum(n) n from gate_tally group by decision").collect()} == {("auto_accept", 4), ("reject", 4)}
