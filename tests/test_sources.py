"""Rasters written here and read back, feeds, sinks and streaming ingest."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlattice.functions import geo
from airlattice.sources import feeds, raster, sinks
from airlattice.streaming import ingest


def write_tiff(path, a, *, compression=1, predictor=1, tile=None, nodata=None, origin=(1000.0, 2000.0), scale=10.0, epsg=25833, point=False, mask=None, sparse=()):
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]

    def pack(block):
        if predictor == 2:
            block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1).astype(a.dtype)
        raw = block.tobytes()
        if predictor == 3:
            b = block.astype(a.dtype.newbyteorder(">")).view(np.uint8).reshape(block.shape[0], block.shape[1], -1).transpose(0, 2, 1).reshape(block.shape[0], -1)
            raw = np.concatenate([b[:, :1], np.diff(b, axis=1)], axis=1).astype(np.uint8).tobytes()
        if compression in (8, 32946):
            return zlib.compress(raw)
        if compression == 50000:
            import zstandard

            return zstandard.ZstdCompressor().compress(raw)
        if compression == 32773:
            return b"".join(bytes([len(raw[i : i + 100]) - 1]) + raw[i : i + 100] for i in range(0, len(raw), 100))
        return raw

    h, w = a.shape
    blocks = []
    if tile:
        for r in range(0, h, tile):
            for c in range(0, w, tile):
                b = np.zeros((tile, tile), a.dtype)
                part = a[r : r + tile, c : c + tile]
                b[: part.shape[0], : part.shape[1]] = part
                blocks.append(pack(b))
    else:
        blocks = [pack(a[r : r + 4]) for r in range(0, h, 4)]
    data, offsets, counts = b"", [], []
    for i, b in enumerate(blocks):
        offsets.append(0 if i in sparse else 8 + len(data))
        counts.append(0 if i in sparse else len(b))
        data += b"" if i in sparse else b
    keys = (1, 1, 0, 2, 3072, 0, 1, epsg, 1025, 0, 1, 2 if point else 1)
    tags = {256: ("I", [w]), 257: ("I", [h]), 258: ("H", [a.dtype.itemsize * 8]), 259: ("H", [compression]), 277: ("H", [1]), 317: ("H", [predictor]), 339: ("H", [kind]),
            33550: ("d", [scale, scale, 0.0]), 33922: ("d", [0.0, 0.0, 0.0, origin[0], origin[1], 0.0]), 34735: ("H", list(keys))}
    if tile:
        tags |= {322: ("I", [tile]), 323: ("I", [tile]), 324: ("I", offsets), 325: ("I", counts)}
    else:
        tags |= {278: ("I", [4]), 273: ("I", offsets), 279: ("I", counts)}
    if nodata is not None:
        tags[42113] = ("c", [bytes([x]) for x in str(nodata).encode() + b"\0"])
    images = [tags]
    if mask is not None:
        bits = np.packbits(mask.astype(np.uint8), axis=1).tobytes()
        images.append({254: ("I", [4]), 256: ("I", [w]), 257: ("I", [h]), 258: ("H", [1]), 259: ("H", [1]), 277: ("H", [1]), 278: ("I", [h]), 273: ("I", [8 + len(data)]), 279: ("I", [len(bits)])})
        data += bits
    types, at, out, first = {"H": 3, "I": 4, "d": 12, "c": 2}, 8 + len(data), b"", []
    for n, t in enumerate(images):
        extra_at, extra, entries = at + len(out) + 2 + 12 * len(t) + 4, b"", b""
        for tag, (fmt, values) in sorted(t.items()):
            raw = struct.pack("<" + fmt * len(values), *values)
            if len(raw) > 4:
                entries += struct.pack("<HHII", tag, types[fmt], len(values), extra_at + len(extra))
                extra += raw
            else:
                entries += struct.pack("<HHI", tag, types[fmt], len(values)) + raw.ljust(4, b"\0")
        end = extra_at + len(extra)
        first.append(at + len(out))
        out += struct.pack("<H", len(t)) + entries + struct.pack("<I", end if n + 1 < len(images) else 0) + extra
    path.write_bytes(b"II" + struct.pack("<HI", 42, first[0]) + data + out)
    return str(path)


GRID = np.arange(13 * 9).reshape(13, 9)


@pytest.mark.parametrize("options", [
    {}, {"compression": 8, "predictor": 2}, {"compression": 32946, "tile": 16}, {"compression": 50000, "predictor": 3}, {"compression": 32773}, {"tile": 16, "predictor": 2},
])
@pytest.mark.parametrize("kind", ["<u1", "<i2", "<f4", "<f8"])
def test_blocks(tmp_path, options, kind):
    if options.get("predictor") == 3 and kind[1] != "f" or options.get("predictor") == 2 and kind[1] == "f":
        pytest.skip("predictor of another kind")
    a = GRID.astype(kind)
    t = raster.Tiff(write_tiff(tmp_path / "a.tif", a, **options))
    whole = np.zeros(a.shape)
    for i, r, c in t.blocks(t.images[0]):
        b = t.read_block(t.images[0], i)
        whole[r : r + b.shape[0], c : c + b.shape[1]] = b
    assert (whole == a).all() and t.epsg == 25833 and t.geotransform() == (1000.0, 2000.0, 10.0, 10.0)


def test_lzw():
    # "aaab": clear, a, aa, b, end, in 9-bit codes
    bits = "".join(f"{c:09b}" for c in (256, 97, 258, 98, 257))
    data = int(bits.ljust(48, "0"), 2).to_bytes(6, "big")
    assert raster.decompress(data, 5, 4) == b"aaab"


def test_mosaic(spark, tmp_path):
    first = GRID.astype("<f8").copy()
    first[0, 0], first[0, 1] = -9999, np.nan
    a = write_tiff(tmp_path / "a.tif", first, nodata=-9999, tile=16)
    b = write_tiff(tmp_path / "b.tif", (GRID + 1000).astype("<f8"), sparse=(3,))
    blocks = raster.read_blocks(spark, [a, b])
    points = [(1005.0, 1995.0), (1015.0, 1995.0), (1025.0, 1995.0), (1085.0, 1875.0), (999.0, 1995.0), (1000.0, 2000.0)]
    got = raster.sample(spark.createDataFrame(points, "x double, y double"), blocks).collect()
    z = {(r.x, r.y): r.z for r in got}
    assert z[1005.0, 1995.0] == 1000  # masked in the first image
    assert z[1015.0, 1995.0] is None  # not a number in an unmasked pixel wins, and is missing
    assert z[1025.0, 1995.0] == 2 and z[1085.0, 1875.0] == 116 and z[999.0, 1995.0] is None
    mask = np.ones((13, 9), bool)
    mask[0, 2] = False
    c = raster.read_blocks(spark, [write_tiff(tmp_path / "c.tif", GRID.astype("<i2"), mask=mask, point=True)])
    row = {(r.x, r.y): r.z for r in raster.sample(spark.createDataFrame([(1020.0, 2000.0), (1030.0, 2000.0)], "x double, y double"), c).collect()}
    assert row == {(1020.0, 2000.0): None, (1030.0, 2000.0): 3.0}
    other = write_tiff(tmp_path / "d.tif", GRID.astype("<i2"), epsg=25832)
    with pytest.raises(Exception, match="different coordinate systems"):
        raster.read_blocks(spark, [a, other]).count()


def test_feeds(spark, tmp_path):
    (tmp_path / "p.csv").write_text("﻿gain_dbi,note,elevation_deg\n1.5,x,10\n2,y,-5\nbad,z,1\n")
    assert [tuple(r) for r in feeds.antenna(spark, str(tmp_path / "p.csv")).collect()] == [(-5.0, 2.0), (10.0, 1.5)]
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [10, 60]}, "properties": {"name": "p", "minimum_margin_db": 3}},
        {"type": "Feature", "geometry": {"type": "MultiPoint", "coordinates": []}, "properties": {}},
        {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[10, 60], [11, 60]]}, "properties": {}}]}
    (tmp_path / "t.json").write_text(json.dumps(fc))
    assert [(r.id, r.geometry_type, r.minimum_margin_db) for r in feeds.targets(spark, str(tmp_path / "t.json")).collect()] == [("T1", "Point", 3.0), ("T3", "LineString", 0.0)]
    way = {"type": "way", "id": 1, "geometry": [{"lat": "60.0", "lon": 10.0}, {"lat": 60.0, "lon": 10.5}, {"lat": 61, "lon": 10.5}]}
    (tmp_path / "r.json").write_text(json.dumps({"elements": [way, way, {"type": "node", "id": 2}]}))
    segments = feeds.roads(spark, str(tmp_path / "r.json"))
    assert segments.count() == 2
    points = spark.createDataFrame([(10.2, 60.05), (10.2, 60.5), (10.52, 60.9)], "x double, y double")
    assert sorted((r.x, round(r.road_m, 6)) for r in feeds.near_roads(points, segments, 0.1).collect()) == [(10.2, 0.05), (10.52, 0.02)]
    (tmp_path / "bad.json").write_text(json.dumps({"remark": "timeout", "elements": []}))
    with pytest.raises(Exception, match="timeout"):
        feeds.roads(spark, str(tmp_path / "bad.json")).collect()


def test_cell_round_trip(spark, tmp_path):
    rows = [("j", i, i * 1.0, 0.0, "covered" if i % 2 else "outside_area") for i in range(45)]
    cells = spark.createDataFrame(rows, "job_id string, index bigint, x double, y double, state string")
    sinks.write_cell_lines(cells, str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c")).count() == 3
    back = feeds.cells(spark, str(tmp_path / "c"))
    assert sorted((r["index"], r.x, r.state) for r in back.collect()) == [(r[1], r[2], r[4]) for r in rows]
    f = {r["index"]: json.loads(r.value) for r in sinks.cell_features(cells, 0.5).collect()}
    assert f[0]["geometry"] is None and f[1]["geometry"]["coordinates"][0][0] == [0.5, -0.5]
    flat = spark.createDataFrame([("j", float(x), float(y), "covered") for x in range(4) for y in range(4)], "job_id string, x double, y double, state string")
    pixels = sinks.overlay(flat, 1.0, side=10).collect()
    assert len({(p.px, p.py) for p in pixels}) == len(pixels) == 100
    s = spark.range(5000).select(F.lit("l").alias("link_id"), F.col("id").cast("int").alias("i"), F.lit(5000).alias("n"), F.when(F.col("id") == 1234, 99.0).otherwise(F.col("id") % 7).alias("h"))
    kept = sinks.thin_profile(s, 100).collect()
    assert len(kept) <= 104 and {0, 1234, 4999} <= {r.i for r in kept}


def test_ingest(spark, tmp_path):
    """Replay changes nothing, later rows fill nulls, expanded receptions replace the packet's own row."""
    pages, store = tmp_path / "pages", ingest.ReceptionStore(spark, str(tmp_path / "store"), ingest.COLUMNS, 4)
    pages.mkdir()
    packet = lambda i, **more: {"id": i, "hash": f"h{i}", "observer_id": "o", "rssi": None, **more}
    (pages / "1.json").write_text(json.dumps({"packets": [packet(2), packet(1)], "total": 2, "offset": 0}))
    run = lambda: ingest.ingest(spark, str(pages), store, str(tmp_path / "ck"), "e")
    run()
    assert sorted((r.packet_id, r.observation_key, r.rssi) for r in store.read().collect()) == [(1, "observer:o", None), (2, "observer:o", None)]
    run()
    expanded = packet(2, observations=[{"id": 7, "observer_id": "a", "rssi": -90.0}, {"id": 8, "observer_id": "b", "rssi": -91.0}])
    (pages / "2.json").write_text(json.dumps({"packets": [packet(3), expanded, packet(1, rssi=-80.0)], "total": 3, "offset": 0}))
    run()
    want = [(1, "observer:o", -80.0), (2, "id:7", -90.0), (2, "id:8", -91.0), (3, "observer:o", None)]
    assert sorted((r.packet_id, r.observation_key, r.rssi) for r in store.read().collect()) == want
    last, where = store.committed()
    batch = store.read().limit(1).withColumn("arrival", F.lit(0).cast("bigint"))
    store.upsert(batch, last)  # a replayed batch is left out
    assert store.committed() == (last, where)
    assert ingest.poll_window(None, 5) == (None, 5) and ingest.poll_window(1_000_000, 2_000_000)[0] == 100_000


def test_geometry():
    lon, lat, zone = np.array([10.75, 5.3, 30.0]), np.array([59.91, 60.39, 70.0]), np.array([33.0, 32.0, 35.0])
    e, n = geo.utm_forward(lon, lat, zone)
    assert abs(e[1] - 296207.0) < 3000 and abs(n[1] - 6700000) < 10000
    back = geo.utm_inverse(e, n, zone)
    assert np.abs(back[0] - lon).max() < 1e-9 and np.abs(back[1] - lat).max() < 1e-9
    e, n = geo.utm_forward(np.array([9.0]), np.array([0.0]), np.array([32.0]))
    assert abs(e[0] - 500000) < 1e-6 and abs(n[0]) < 1e-6
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    assert geo.clip_area(square, 1, 1, 2, 3) == 2 and geo.clip_area(square, 3, 3, 9, 9) == 1 and geo.clip_area(square, 5, 5, 6, 6) == 0
    assert geo.nice_resolution(3.1) == 5 and geo.nice_resolution(10) == 10 and geo.axis_pixels(0, 100.0000001, 10) == 10
    res, tiles = geo.download_tiles(0, 0, 100_000, 50_000, 1.0)
    assert len(tiles) <= 64 and res >= 1 and max(t[2] for t in tiles) == 100_000
    assert geo.simplify([(10.0, 0.0), (5.0, 1.0), (0.0, 0.0)]) == [(0.0, 0.0), (10.0, 0.0)]
    assert [geo.backoff_seconds(n) for n in (1, 2, 9)] == [60, 120, 3600] and geo.backoff_seconds(1, 500) == 500
