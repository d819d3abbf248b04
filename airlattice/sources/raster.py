"""Elevation rasters: a Python data source that reads GeoTIFF blocks, and sampling of points over a mosaic of them.

Read are single-band grey images of 8 to 64 bits, in strips or tiles, plain, LZW, Deflate, PackBits or Zstandard, with
predictors 1 to 3, north up. Blocks that are not stored hold nodata, or zero where none is named. A mask image in the file
decides over nodata. Other storage, sidecar files and rotated images are errors, not guesses.
"""

from __future__ import annotations

import io
import os
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the file format: type sizes, and the tags and keys used here.
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 16: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SUB_IFDS, SUBFILE, FORMAT = 317, 322, 323, 324, 325, 330, 254, 339
PIXEL_SCALE, TIEPOINT, MATRIX, GEOKEYS, NODATA = 33550, 33922, 34264, 34735, 42113
COMPRESSIONS = {1, 5, 8, 32773, 32946, 50000}
MAX_BLOCK_BYTES = 32 << 20
SCHEMA = "path string, priority int, row0 int, col0 int, rows int, cols int, west double, north double, dx double, dy double, epsg int, z array<double>, masked array<boolean>"


@dataclass
class Tiff:
    """A file's header: its image directories and geography."""

    path: str
    order: str = "<"
    images: list[dict[int, tuple]] = field(default_factory=list)
    content: bytes | None = None  #: the file itself, where it was read by another file system

    def _open(self):
        return open(self.path, "rb") if self.content is None else io.BytesIO(self.content)

    def __post_init__(self):
        for side in (".msk", ".aux.xml"):
            if self.content is None and os.path.exists(self.path + side):
                raise ValueError(f"{self.path} has a sidecar file {side}")
        with self._open() as f:
            head = f.read(8)
            self.order = {b"II": "<", b"MM": ">"}.get(head[:2]) or self._bad("no TIFF file")
            magic, at = struct.unpack(self.order + "HI", head[2:])
            if magic != 42:
                self._bad("no classic TIFF file")
            queue = [at]
            while queue and len(self.images) < 64:
                if at := queue.pop(0):
                    tags, following = self._directory(f, at)
                    self.images.append(tags)
                    queue += [following, *tags.get(SUB_IFDS, ())]
        if not self.images:
            self._bad("no image")
        self._validate()

    def _bad(self, why: str):
        raise ValueError(f"{self.path}: {why}")

    def _directory(self, f, at: int) -> tuple[dict[int, tuple], int]:
        f.seek(at)
        (n,) = struct.unpack(self.order + "H", f.read(2))
        raw, tags = f.read(12 * n), {}
        (following,) = struct.unpack(self.order + "I", f.read(4))
        for i in range(n):
            tag, kind, count, value = struct.unpack(self.order + "HHI4s", raw[12 * i : 12 * i + 12])
            if kind not in _TYPES:
                continue
            fmt = self.order + _TYPES[kind] * count
            size = struct.calcsize(fmt)
            if size > 4:
                f.seek(struct.unpack(self.order + "I", value)[0])
                value = f.read(size)
            tags[tag] = struct.unpack(fmt, value[:size])
        return tags, following

    def _validate(self):
        t = self.images[0]
        if t.get(SAMPLES, (1,))[0] != 1 or len(t.get(BITS, (1,))) != 1:
            self._bad("more than one band")
        if t.get(COMPRESSION, (1,))[0] not in COMPRESSIONS:
            self._bad(f"compression {t[COMPRESSION][0]}")
        if t.get(PREDICTOR, (1,))[0] not in (1, 2, 3):
            self._bad(f"predictor {t[PREDICTOR][0]}")
        self.dtype(t)
        h, w = self.block_shape(t)
        if h * w * self.dtype(t).itemsize > MAX_BLOCK_BYTES:
            self._bad("blocks beyond 32 MiB")
        self.geotransform()

    def dtype(self, t: dict) -> np.dtype:
        kind, bits = t.get(FORMAT, (1,))[0], t.get(BITS, (1,))[0]
        name = {(1, 1): "u1", (1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}.get((kind, bits))
        return np.dtype(self.order + name) if name else self._bad(f"sample format {kind} of {bits} bits")

    @staticmethod
    def block_shape(t: dict) -> tuple[int, int]:
        if TILE_WIDTH in t:
            return t[TILE_HEIGHT][0], t[TILE_WIDTH][0]
        return min(t.get(ROWS_PER_STRIP, (t[HEIGHT][0],))[0], t[HEIGHT][0]), t[WIDTH][0]

    def _geokey(self, key: int) -> int | None:
        k = self.images[0].get(GEOKEYS, ())
        return next((k[i + 3] for i in range(4, len(k) - 3, 4) if k[i] == key and k[i + 1] == 0), None)

    @property
    def epsg(self) -> int | None:
        return self._geokey(3072)

    def geotransform(self) -> tuple[float, float, float, float]:
        """(west, north, dx, dy) of the image's upper left corner; a point pixel's place is its centre."""
        t = self.images[0]
        if MATRIX in t:
            m = t[MATRIX]
            if m[1] or m[4]:
                self._bad("rotated image")
            west, north, dx, dy = m[3], m[7], m[0], -m[5]
        elif PIXEL_SCALE in t and TIEPOINT in t:
            dx, dy = t[PIXEL_SCALE][:2]
            col, row, _, x, y, _ = t[TIEPOINT][:6]
            west, north = x - col * dx, y + row * dy
        else:
            self._bad("no geography")
        if self._geokey(1025) == 2:
            west, north = west - dx / 2, north + dy / 2
        if not (dx > 0 and dy > 0):
            self._bad("image is not north up")
        return west, north, dx, dy

    def nodata(self) -> float | None:
        raw = self.images[0].get(NODATA)
        return float(b"".join(raw).split(b"\0")[0]) if raw else None

    def mask_image(self) -> dict | None:
        return next((t for t in self.images[1:] if t.get(SUBFILE, (0,))[0] & 4), None)

    def blocks(self, t: dict) -> list[tuple[int, int, int]]:
        """(number, first row, first column) of each block."""
        h, w = self.block_shape(t)
        across = -(-t[WIDTH][0] // w)
        return [(i, i // across * h, i % across * w) for i in range(across * -(-t[HEIGHT][0] // h))]

    def read_block(self, t: dict, number: int) -> np.ndarray | None:
        """A block's samples, cut at the image's edge; None where it isn't stored."""
        offsets, counts = (t[TILE_OFFSETS], t[TILE_COUNTS]) if TILE_WIDTH in t else (t[STRIP_OFFSETS], t[STRIP_COUNTS])
        h, w = self.block_shape(t)
        _, row0, col0 = self.blocks(t)[number]
        if TILE_WIDTH not in t:
            h = min(h, t[HEIGHT][0] - row0)
        if offsets[number] == 0 and counts[number] == 0:
            return None
        with self._open() as f:
            f.seek(offsets[number])
            data = f.read(counts[number])
        kind = self.dtype(t)
        bits = t.get(BITS, (1,))[0]
        row_bytes = -(-w * bits // 8)
        data = decompress(data, t.get(COMPRESSION, (1,))[0], h * row_bytes)
        if bits == 1:
            a = np.unpackbits(np.frombuffer(data, np.uint8).reshape(h, row_bytes), axis=1)[:, :w]
        elif (p := t.get(PREDICTOR, (1,))[0]) == 3:
            b = np.cumsum(np.frombuffer(data, np.uint8).reshape(h, w * kind.itemsize), axis=1, dtype=np.uint8)
            a = np.ascontiguousarray(b.reshape(h, kind.itemsize, w).transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(h, w)
        else:
            a = np.frombuffer(data, kind).reshape(h, w)
            if p == 2:
                a = np.cumsum(a.astype(kind.newbyteorder("=")), axis=1, dtype=kind.newbyteorder("="))
        return a[: t[HEIGHT][0] - row0, : t[WIDTH][0] - col0]


def decompress(data: bytes, kind: int, size: int) -> bytes:
    if kind == 1:
        return data[:size]
    if kind in (8, 32946):
        return zlib.decompress(data)[:size]
    if kind == 50000:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    if kind == 32773:
        out, i = bytearray(), 0
        while i < len(data) and len(out) < size:
            n = data[i]
            i += 1
            if n < 128:
                out += data[i : i + n + 1]
                i += n + 1
            elif n > 128:
                out += data[i : i + 1] * (257 - n)
                i += 1
        return bytes(out[:size])
    out, table, width, held, bits, old = bytearray(), [], 9, 0, 0, None
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        while bits >= width:
            code = (held >> (bits - width)) & ((1 << width) - 1)
            bits -= width
            held &= (1 << bits) - 1
            if code == 256:
                table, width, old = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
                continue
            if code == 257 or len(out) >= size:
                return bytes(out[:size])
            entry = table[code] if code < len(table) else old + old[:1]
            out += entry
            if old is not None:
                table.append(old + entry[:1])
            old = entry
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out[:size])


class _Part(InputPartition):
    def __init__(self, path: str, priority: int, numbers: list[int]):
        self.path, self.priority, self.numbers = path, priority, numbers


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], blocks_per_task: int):
        self.paths, self.per = paths, blocks_per_task

    def partitions(self):
        parts, crs = [], set()
        for priority, path in enumerate(self.paths):
            t = Tiff(path)
            crs.add(t.epsg)
            n = len(t.blocks(t.images[0]))
            parts += [_Part(path, priority, list(range(i, min(i + self.per, n)))) for i in range(0, n, self.per)]
        if len(crs) > 1:
            raise ValueError(f"tiles of different coordinate systems: {sorted(map(str, crs))}")
        return parts

    def read(self, part):
        yield from block_rows(Tiff(part.path), part.priority, part.numbers)


def block_rows(tiff: Tiff, priority: int, numbers: list[int]):
    """Rows of SCHEMA of an image's blocks. The mask is read in its own blocks, those that a block of the image meets."""
    t, mask, nodata = tiff.images[0], tiff.mask_image(), tiff.nodata()
    west, north, dx, dy = tiff.geotransform()
    places = tiff.blocks(t)
    for i in numbers:
        _, r, c = places[i]
        h, w = tiff.block_shape(t)
        rows, cols = min(h, t[HEIGHT][0] - r), min(w, t[WIDTH][0] - c)
        a = tiff.read_block(t, i)
        a = np.full((rows, cols), nodata if nodata is not None else 0.0) if a is None else a.astype(float)
        if mask is not None:
            out = ~mask_window(tiff, mask, r, c, rows, cols)
        elif nodata is not None:
            out = np.isnan(a) if np.isnan(nodata) else a == nodata
        else:
            out = np.zeros((rows, cols), bool)
        z = np.where(out | np.isnan(a), None, a).ravel().tolist()
        yield tiff.path, priority, r, c, rows, cols, west, north, dx, dy, tiff.epsg, z, out.ravel().tolist()


def mask_window(tiff: Tiff, mask: dict, row: int, col: int, rows: int, cols: int) -> np.ndarray:
    """The mask's part that covers a window of the image; True where the image holds."""
    out = np.zeros((rows, cols), bool)
    for i, r, c in tiff.blocks(mask):
        h, w = tiff.block_shape(mask)
        top, left, bottom, right = max(r, row), max(c, col), min(r + h, row + rows, mask[HEIGHT][0]), min(c + w, col + cols, mask[WIDTH][0])
        if top < bottom and left < right and (b := tiff.read_block(mask, i)) is not None:
            out[top - row : bottom - row, left - col : right - col] = b[top - r : bottom - r, left - c : right - c] != 0
    return out


class RasterSource(DataSource):
    """spark.read.format("elevation").option("paths", "a.tif,b.tif"): blocks, the first path first in a mosaic."""

    @classmethod
    def name(cls):
        return "elevation"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader([p for p in self.options["paths"].split(",") if p], int(self.options.get("blocksPerTask", "16")))


def read_blocks(spark: SparkSession, paths: list[str]) -> DataFrame:
    spark.dataSource.register(RasterSource)
    return spark.read.format("elevation").option("paths", ",".join(paths)).load()


def decoded(files: DataFrame) -> DataFrame:
    """Blocks of whole files: path, priority, content, as spark.read.format("binaryFile") gives them from any file system. Each
    file, held whole by one task, is decoded block by block."""

    def run(batches):
        for b in batches:
            for path, priority, content in zip(*(b.column(c) for c in ("path", "priority", "content")), strict=True):
                tiff = Tiff(path.as_py(), content=content.as_py())
                rows = block_rows(tiff, priority.as_py(), list(range(len(tiff.blocks(tiff.images[0])))))
                for row in rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema=kind)

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<boolean>": pa.list_(pa.bool_())}
    kind = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SCHEMA.split(", ")])
    return files.select("path", F.col("priority").cast("int"), "content").mapInArrow(run, SCHEMA)


def encode(a: np.ndarray, west: float, north: float, step: float, epsg: int, *, tile: int = 16, compressed: bool = True, nodata: float | None = None, mask: np.ndarray | None = None) -> bytes:
    """A file of one band of doubles in square tiles, its upper left corner at (west, north); mask: where it holds, as an
    image of its own."""
    h, w = a.shape
    data, images = bytearray(8), []

    def put(block: bytes) -> tuple[int, int]:
        at = len(data)
        data.extend(block)
        return at, len(block)

    def tiles(v: np.ndarray):
        for r in range(0, h, tile):
            for c in range(0, w, tile):
                b = np.zeros((tile, tile), v.dtype)
                part = v[r : r + tile, c : c + tile]
                b[: part.shape[0], : part.shape[1]] = part
                yield b

    pack = zlib.compress if compressed else bytes
    stored = [put(pack(b.tobytes())) for b in tiles(a.astype("<f8"))]
    common = {WIDTH: ("I", [w]), HEIGHT: ("I", [h]), SAMPLES: ("H", [1]), TILE_WIDTH: ("I", [tile]), TILE_HEIGHT: ("I", [tile])}
    keys = [1, 1, 0, 2, 1025, 0, 1, 1, 3072, 0, 1, epsg]
    first = common | {BITS: ("H", [64]), FORMAT: ("H", [3]), COMPRESSION: ("H", [8 if compressed else 1]), TILE_OFFSETS: ("I", [x for x, _ in stored]), TILE_COUNTS: ("I", [n for _, n in stored]),
                      PIXEL_SCALE: ("d", [step, step, 0.0]), TIEPOINT: ("d", [0.0, 0.0, 0.0, west, north, 0.0]), GEOKEYS: ("H", keys)}
    if nodata is not None:
        first[NODATA] = ("c", [bytes([x]) for x in repr(nodata).encode() + b"\0"])
    images.append(first)
    if mask is not None:
        held = [put(np.packbits(b, axis=1).tobytes()) for b in tiles(mask.astype(np.uint8))]
        images.append(common | {SUBFILE: ("I", [4]), BITS: ("H", [1]), COMPRESSION: ("H", [1]), TILE_OFFSETS: ("I", [x for x, _ in held]), TILE_COUNTS: ("I", [n for _, n in held])})
    number = {v: k for k, v in _TYPES.items() if len(v) == 1}
    link = 4  # where the place of the next directory is written
    for tags in images:
        entries = b""
        for tag, (fmt, values) in sorted(tags.items()):
            raw = struct.pack("<" + fmt * len(values), *values)
            entries += struct.pack("<HHI", tag, number[fmt], len(values)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", put(raw)[0]))
        at, _ = put(struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0))
        data[link : link + 4] = struct.pack("<I", at)
        link = len(data) - 4
    data[:4] = b"II" + struct.pack("<H", 42)
    return bytes(data)


def sample(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """points (x, y, other columns) with z: the pixel that holds the point in the first image with an unmasked pixel there,
    even if its value is missing; null outside all images. Points and blocks meet in squares a few blocks wide."""
    b = blocks.withColumns({"bw": F.col("west") + F.col("col0") * F.col("dx"), "bn": F.col("north") - F.col("row0") * F.col("dy")})
    b = b.withColumns({"be": F.col("bw") + F.col("cols") * F.col("dx"), "bs": F.col("bn") - F.col("rows") * F.col("dy")})
    side = b.agg(F.max(F.greatest(F.col("be") - F.col("bw"), F.col("bn") - F.col("bs")))).first()[0] or 1.0
    key = lambda c: F.floor(c / F.lit(side)).cast("bigint")
    b = b.withColumn("gx", F.explode(F.sequence(key(F.col("bw")), key(F.col("be"))))).withColumn("gy", F.explode(F.sequence(key(F.col("bs")), key(F.col("bn")))))
    p = points.withColumns({"__id": F.monotonically_increasing_id(), "gx": key(F.col("x")), "gy": key(F.col("y"))})
    from airlattice.tables import cut

    p = cut(p)  # the row numbers must not change between the two uses
    inside = (F.col("x") >= F.col("bw")) & (F.col("x") < F.col("be")) & (F.col("y") <= F.col("bn")) & (F.col("y") > F.col("bs"))
    hit = p.select("__id", "x", "y", "gx", "gy").join(b, ["gx", "gy"]).filter(inside)
    at = F.floor((F.col("bn") - F.col("y")) / F.col("dy")).cast("int") * F.col("cols") + F.floor((F.col("x") - F.col("bw")) / F.col("dx")).cast("int")
    hit = hit.select("__id", "priority", F.get("z", at).alias("z"), F.get("masked", at).alias("m")).filter(~F.col("m"))
    best = hit.groupBy("__id").agg(F.min_by(F.struct("z"), "priority").alias("s"))
    return p.join(best, "__id", "left").select(*points.columns, F.col("s.z").alias("z"))
